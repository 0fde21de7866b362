"""Flow tables: reading, ordering, capping, cleaning and the column lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions import scalar as S
from flowloom.operators.prefix import prefix_index
from flowloom.stage import materialize

SRC, DST, LABEL = "IPV4_SRC_ADDR", "IPV4_DST_ADDR", "Label"

# Names of the flow export format and the published column choices.
CATEGORICAL = ("PROTOCOL", "L4_SRC_PORT", "L4_DST_PORT")
BASELINE_COLUMNS = (
    "PROTOCOL", "L4_SRC_PORT", "L4_DST_PORT", "MIN_TTL",
    "FLOW_DURATION_MILLISECONDS", "TOTAL_PKTS", "TOTAL_BYTES",
)
BASELINE_LOG1P = ("FLOW_DURATION_MILLISECONDS", "TOTAL_PKTS", "TOTAL_BYTES")
ALL_COLUMNS = (
    "L7_PROTO", "IN_BYTES", "IN_PKTS", "OUT_BYTES", "OUT_PKTS", "TCP_FLAGS",
    "CLIENT_TCP_FLAGS", "SERVER_TCP_FLAGS", "FLOW_DURATION_MILLISECONDS",
    "DURATION_IN", "DURATION_OUT", "MIN_TTL", "MAX_TTL", "LONGEST_FLOW_PKT",
    "SHORTEST_FLOW_PKT", "MIN_IP_PKT_LEN", "MAX_IP_PKT_LEN",
    "SRC_TO_DST_SECOND_BYTES", "DST_TO_SRC_SECOND_BYTES",
    "RETRANSMITTED_IN_BYTES", "RETRANSMITTED_IN_PKTS", "RETRANSMITTED_OUT_BYTES",
    "RETRANSMITTED_OUT_PKTS", "SRC_TO_DST_AVG_THROUGHPUT", "DST_TO_SRC_AVG_THROUGHPUT",
    "NUM_PKTS_UP_TO_128_BYTES", "NUM_PKTS_128_TO_256_BYTES", "NUM_PKTS_256_TO_512_BYTES",
    "NUM_PKTS_512_TO_1024_BYTES", "NUM_PKTS_1024_TO_1514_BYTES",
    "TCP_WIN_MAX_IN", "TCP_WIN_MAX_OUT", "ICMP_TYPE", "ICMP_IPV4_TYPE",
    "DNS_QUERY_ID", "DNS_QUERY_TYPE", "DNS_TTL_ANSWER", "FTP_COMMAND_RET_CODE",
    "SRC_TO_DST_IAT_MIN", "SRC_TO_DST_IAT_MAX", "SRC_TO_DST_IAT_AVG", "SRC_TO_DST_IAT_STDDEV",
    "DST_TO_SRC_IAT_MIN", "DST_TO_SRC_IAT_MAX", "DST_TO_SRC_IAT_AVG", "DST_TO_SRC_IAT_STDDEV",
)
DERIVED = {
    "TOTAL_PKTS": "CAST(IN_PKTS AS DOUBLE) + CAST(OUT_PKTS AS DOUBLE)",
    "TOTAL_BYTES": "CAST(IN_BYTES AS DOUBLE) + CAST(OUT_BYTES AS DOUBLE)",
}


def _listed(text: str) -> list[str]:
    return [part.strip() for part in text.split(",") if part.strip()]


def resolve_columns(spec: str) -> list[str]:
    """'baseline', 'all' or a comma-separated list."""
    named = {"baseline": BASELINE_COLUMNS, "all": ALL_COLUMNS}
    return list(named[spec]) if spec in named else _listed(spec)


def resolve_log1p(spec: str, columns: Sequence[str]) -> list[str]:
    """'none', 'baseline', 'all' (= every selected column) or a comma-separated list."""
    named = {"none": (), "baseline": BASELINE_LOG1P, "all": columns}
    return list(named[spec]) if spec in named else _listed(spec)


@dataclass(frozen=True)
class FeatureSpec:
    """What the edge vector is made of.  `derived` maps a name to a Spark SQL expression."""

    columns: tuple[str, ...] = BASELINE_COLUMNS
    log1p: tuple[str, ...] = BASELINE_LOG1P
    top_protocols: int = 4
    top_ports: int = 4
    scale: bool = True
    derived: Mapping[str, str] = field(default_factory=lambda: dict(DERIVED))

    @classmethod
    def resolve(cls, columns: str = "baseline", log1p: str = "baseline", **more) -> FeatureSpec:
        chosen = resolve_columns(columns)
        return cls(tuple(chosen), tuple(resolve_log1p(log1p, chosen)), **more)

    @property
    def numeric(self) -> list[str]:
        return [c for c in self.columns if c not in CATEGORICAL]

    @property
    def categorical(self) -> list[str]:
        return [c for c in self.columns if c in CATEGORICAL]

    @property
    def width(self) -> int:
        """Width of the vector with padded vocabularies, known without looking at data."""
        blocks = {"PROTOCOL": self.top_protocols + 1, "L4_SRC_PORT": 3, "L4_DST_PORT": self.top_ports + 2}
        return len(self.numeric) + sum(blocks[c] for c in self.categorical)

    def source_columns(self, available: Sequence[str]) -> list[str]:
        """Raw columns a plan has to read: selected ones and the inputs of derived ones."""
        wanted = set()
        for c in self.columns:
            text = self.derived.get(c, c)
            wanted |= {a for a in available if a in text.replace("(", " ").replace(")", " ").split()}
        return [a for a in available if a in wanted]


def read_flows(
    spark: SparkSession, paths: Mapping[str, str], split: str, spec: FeatureSpec | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """One table from one parquet path per silo, tagged with `silo` and `split`.

    With `spec`, only the addresses, the label, the inputs of its features and `keep` (such as
    the order key) are read: what an index would else sort and write for nothing.
    """

    def read(path: str) -> DataFrame:
        table = spark.read.parquet(path)
        if spec is None:
            return table
        wanted = {SRC, DST, LABEL, *keep, *spec.source_columns(table.columns)}
        return table.select(*[c for c in table.columns if c in wanted])

    parts = [read(p).withColumn("silo", F.lit(s)) for s, p in paths.items()]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table.withColumn("split", F.lit(split))


# Unique order of the order-line table.
ORDER_KEY = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
# The other columns that flows are made of; nothing else is sorted and written by an index.
LINE_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def lineitem_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order-line table with the columns that rows are grouped and filtered by.

    Ordering and filtering work on these raw rows; `as_flows` is a projection to be
    put on top, so the shuffles carry numbers and not the address texts.
    """
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        *ORDER_KEY,
        *LINE_COLUMNS,
        "l_returnflag AS silo",
        "CASE WHEN l_orderkey % 5 = 4 THEN 'holdout' ELSE 'train' END AS split",
        f"CASE WHEN l_quantity >= 45 AND l_discount >= 0.08 THEN 1 ELSE 0 END AS {LABEL}",
    )


def as_flows(rows: DataFrame) -> DataFrame:
    """Flow columns of order-line rows, and the columns that are no raw order-line columns."""
    address = "concat('10.', cast({0} % 7 as string), '.', cast({0} % 13 as string), '.', cast({0} as string))"
    quantity = "cast(l_quantity as int)"
    kept = [c for c in rows.columns if c in ORDER_KEY or not c.startswith("l_")]
    return rows.selectExpr(
        *kept,
        address.format("((l_suppkey * 7 + l_linenumber) % 251)") + f" AS {SRC}",
        address.format("(l_partkey % 251)") + f" AS {DST}",
        "CASE WHEN l_linenumber <= 3 THEN 6 WHEN l_linenumber <= 5 THEN 17 "
        "WHEN l_linenumber = 6 THEN 1 ELSE 47 END AS PROTOCOL",
        "cast((l_orderkey * 7919) % 65536 as int) AS L4_SRC_PORT",
        f"CASE WHEN {quantity} <= 10 THEN {quantity} * 80 ELSE {quantity} * 1297 END AS L4_DST_PORT",
        f"{quantity} AS IN_PKTS",
        "l_linenumber AS OUT_PKTS",
        "l_extendedprice AS IN_BYTES",
        "l_extendedprice * l_discount AS OUT_BYTES",
        "l_tax * 100000 AS FLOW_DURATION_MILLISECONDS",
        "cast(32 * (1 + l_partkey % 4) as int) AS MIN_TTL",
    )


#: How much larger than asked the part below the first bound is meant to be, and by how much it grows if it is too small.
HEAD_ROOM = 4


def read_head(flows: DataFrame, keys: Sequence[str], order: Sequence[str], n: int | None) -> DataFrame:
    """The first `n` rows of every group in file order, with `flow_id` and the group's `n_rows`; 0 or None keeps all.

    Only rows up to a bound of the first order column are sorted: an approximate quantile per
    group that leaves HEAD_ROOM times `n` rows below it, widened until every group has `n` rows
    at or below its bound (equal values all count, so the head is exact).
    """
    if not n:
        return prefix_index(flows, keys, order, name="flow_id")
    first = order[0]
    sizes = materialize(flows.groupBy(*keys).agg(F.count("*").alias("n_rows")), "sizes")
    room = HEAD_ROOM
    while True:
        share = [min(1.0, room * n / r.n_rows) for r in sizes.groupBy().agg(F.max("n_rows").alias("n_rows")).collect() if r.n_rows]
        # one quantile serves all groups if it is the one of the largest; smaller groups get more rows than they need
        bounds = flows.groupBy(*keys).agg(F.percentile_approx(first, F.lit(share[0] if share else 1.0), 10_000).alias("_bound"))
        bounds = materialize(bounds.join(sizes, list(keys)), "bounds")
        below = flows.join(bounds, list(keys)).filter((F.col(first) <= F.col("_bound")) | F.col(first).isNull())
        short = below.groupBy(*keys).agg(F.count("*").alias("held"), F.max("n_rows").alias("n_rows")).filter((F.col("held") < n) & (F.col("held") < F.col("n_rows")))
        if short.isEmpty():
            break
        room *= HEAD_ROOM
    indexed = prefix_index(below.drop("_bound"), keys, order, name="flow_id", total=None)
    return indexed.filter(F.col("flow_id") < n)


def benign_only(flows: DataFrame, label: str = LABEL) -> DataFrame:
    """Drop attack rows.  To be used after `read_head`: the cap counts attack rows too."""
    return flows.filter(F.col(label) == 0) if label in flows.columns else flows


def dropped_counts(flows: DataFrame, keys: Sequence[str], label: str = LABEL) -> DataFrame:
    """Rows before the benign filter, rows dropped by it, and the dropped share in percent."""
    dropped = F.count_if(~(F.col(label) == 0) | F.col(label).isNull())
    return flows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_before"),
        dropped.alias("n_dropped"),
        (F.lit(100.0) * dropped / F.count(F.lit(1))).alias("pct_dropped"),
    )


def drop_incomplete(flows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null or NaN in `columns` (all columns if not given, which reads them all)."""
    return flows.na.drop("any", subset=list(columns) if columns else None)


def pool_silos(*tables: DataFrame) -> DataFrame:
    """Rows of several silo tables as one table for a shared fit."""
    pooled = tables[0]
    for table in tables[1:]:
        pooled = pooled.unionByName(table)
    return pooled


def numeric_value(spec: FeatureSpec, name: str):
    """One numeric feature before scaling: derived or raw, in double, compressed where asked."""
    value = F.expr(spec.derived[name]) if name in spec.derived else F.col(name).cast("double")
    return S.log1p_clip(value) if name in spec.log1p else value
