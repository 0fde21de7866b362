"""Written intermediate tables.

A plan that reads one intermediate result twice, or a loop, cuts its lineage by
writing the result to the folder that all executors share.  The written table
survives the loss of executors, keeps column pruning for its readers, and its
file size is what lets Spark decide by itself whether a join with it may be a
broadcast: state tables carry no hint, so a state that has grown past
`spark.sql.autoBroadcastJoinThreshold` is shuffled instead.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder named by `spark.checkpoint.dir`; a local session without one gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named
    if spark.sparkContext.getCheckpointDir():
        return spark.sparkContext.getCheckpointDir()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="flowloom-"))
    return spark.sparkContext.getCheckpointDir()


_recorded: list[list[str]] = []


def materialize(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write `df` once and return a reader of the written table; `options` are the writer's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    for record in _recorded:
        record.append(path)
    return spark.read.schema(df.schema).parquet(path)


def task_count(spark: SparkSession) -> int:
    """Explicit number of tasks for work per key that adaptive execution would merge by its few bytes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Most bytes of a written state table (about one row a silo) that may be broadcast on request.
SMALL_BYTES = 1 << 25


def estimated_bytes(df: DataFrame) -> int:
    """Spark's estimate before anything runs: the file size for a written table or a scan, of the columns that are read."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def small(table: DataFrame) -> DataFrame | None:
    """`table` with a broadcast hint if its files have at most SMALL_BYTES, else None."""
    return F.broadcast(table) if estimated_bytes(table) <= SMALL_BYTES else None


#: Bytes of files behind one partition of a table that is sorted or dealt anew: about a million flows, whose
#: rows take ten times as much in a sort, so that a task sorts in memory whatever the size of the table.
PARTITION_BYTES = 1 << 24


def read_bytes(df: DataFrame) -> int:
    """Bytes of all files that a plan reads; joins do not multiply it, as they do the estimate of their result."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.length()))


def partition_count(df: DataFrame, each: int = PARTITION_BYTES) -> int:
    """Partitions of `each` bytes of the files that the rows come from, at least the session's shuffle partitions."""
    return max(task_count(df.sparkSession), min(-(-read_bytes(df) // each), 1 << 20))


@contextmanager
def own_tables(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that `materialize` writes inside, at the end: for loops that never end, like streams."""
    record: list[str] = []
    _recorded.append(record)
    try:
        yield
    finally:
        _recorded.remove(record)
        for path in record:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
