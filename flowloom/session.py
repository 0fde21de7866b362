"""Session settings the plans were written for.

Only runtime SQL settings are touched, so `tune` may be called on a session
that somebody else built; results never depend on it.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def tune(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    local = spark.sparkContext.master.startswith("local")
    if local and spark.conf.get("spark.sql.shuffle.partitions") == "200":
        # the untouched default is far more than a local session has threads
        spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    return spark


#: Bytes of input behind one partition that a shuffle begins with; adaptive execution puts small ones together.
SHUFFLE_BYTES = 1 << 22


PARTITIONS, METHOD_LIMIT = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.codegen.hugeMethodLimit"
_own: dict[tuple[str, str], str | None] = {}


def widen(spark: SparkSession, folder: str | None) -> None:
    """Let shuffles begin with as many partitions as the tables of `folder` ask for; None: as the session has it.

    Adaptive execution puts small partitions together but cuts none of an aggregate or a window, so
    a fixed number of them would make tasks grow with the tables.  The JVM compiles no method of more than
    8000 bytes, so a stage with very many columns is cut into several instead of being interpreted row by row.
    """
    app = spark.sparkContext.applicationId
    own = {name: _own.setdefault((app, name), spark.conf.get(name, None)) for name in (PARTITIONS, METHOD_LIMIT)}
    if folder is None:
        for name, value in own.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)
        return
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    size = place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
    least = int(own[PARTITIONS] or spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set(PARTITIONS, str(max(least, min(-(-size // SHUFFLE_BYTES), 1 << 14))))
    spark.conf.set(METHOD_LIMIT, "8000")


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    # one BLAS thread per task; on a cluster: spark.executorEnv.OMP_NUM_THREADS
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("flowloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)
