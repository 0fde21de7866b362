"""Shared inputs of the registered queries, and the same inputs as SQL text."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.scalar import r6
from flowloom.operators.features import encode, fit_encoder
from flowloom.operators.prefix import prefix_index
from flowloom.operators.windows import row_windows
from flowloom.plans.training import RunConfig, in_place, ordered_flows
from flowloom.sources.flows import ORDER_KEY, FeatureSpec, as_flows, lineitem_rows
from flowloom.stage import materialize

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

SPEC = FeatureSpec()
CONFIG = RunConfig(window=200, step=200, dim=4)
GROUP = ("silo", "window_id")


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query, with its SQL where SQL can say the same."""

    def register(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


_kept: dict[tuple, DataFrame] = {}


def _state_of(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes and times of the files of a folder, so that a changed folder is read again."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files.listStatus(place)))


def once(fn: QueryFn) -> QueryFn:
    """Keep a written input table for the other queries of the same session and folder."""

    @wraps(fn)
    def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, spark.sparkContext.startTime, sf_dir, _state_of(spark, sf_dir), fn.__name__)
        if key not in _kept:
            _kept[key] = fn(spark, sf_dir)
        return _kept[key]

    return lookup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@once
def all_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows with `flow_id`, `n_rows` per (silo, split), in file order."""
    return as_flows(prefix_index(lineitem_rows(spark, sf_dir), ["silo", "split"], ORDER_KEY, name="flow_id"))


@once
def train_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benign training rows, numbered per silo."""
    return as_flows(ordered_flows(lineitem_rows(spark, sf_dir), ORDER_KEY, "train", CONFIG))


@once
def holdout_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_flows(ordered_flows(lineitem_rows(spark, sf_dir), ORDER_KEY, "holdout", CONFIG))


@once
def silo_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(fit_encoder(train_flows(spark, sf_dir), SPEC, ["silo"]), "encoder")


def train_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_windows(train_flows(spark, sf_dir), CONFIG.window, CONFIG.step, pos="flow_id")


def train_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windowed and encoded benign training flows."""
    windows = train_windows(spark, sf_dir)
    edges = in_place([silo_encoder(spark, sf_dir)], CONFIG, lambda state: encode(windows, state, SPEC, ["silo"]))
    return edges.withColumn("label", F.col("Label"))


def r6_all(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumns({n: r6(F.col(n)) for n in names})


def r6_items(array: str, width: int, prefix: str) -> list:
    """Entries of an array column as rounded columns prefix0, prefix1, ..."""
    return [r6(F.col(array).getItem(i)).alias(f"{prefix}{i}") for i in range(width)]


# The same inputs as SQL ------------------------------------------------------------


def q6(text: str) -> str:
    return f"(CASE WHEN round({text}, 6) = 0 THEN CAST(0 AS DOUBLE) ELSE round({text}, 6) END)"


def each6(prefix: str, width: int, source: str = "") -> str:
    return ", ".join(f"{q6(f'{source}{prefix}{i}')} AS {prefix}{i}" for i in range(width))


ORDER_SQL = ", ".join(ORDER_KEY)
_ADDRESS = "'10.' || CAST({0} % 7 AS VARCHAR) || '.' || CAST({0} % 13 AS VARCHAR) || '.' || CAST({0} AS VARCHAR)"
NAMED = f"""named AS (
  SELECT l_returnflag AS silo, CASE WHEN l_orderkey % 5 = 4 THEN 'holdout' ELSE 'train' END AS split, {ORDER_SQL},
    {_ADDRESS.format('((l_suppkey * 7 + l_linenumber) % 251)')} AS src,
    {_ADDRESS.format('(l_partkey % 251)')} AS dst,
    CASE WHEN l_linenumber <= 3 THEN 6 WHEN l_linenumber <= 5 THEN 17 WHEN l_linenumber = 6 THEN 1 ELSE 47 END AS protocol,
    CAST((l_orderkey * 7919) % 65536 AS INTEGER) AS src_port,
    CASE WHEN CAST(l_quantity AS INTEGER) <= 10 THEN CAST(l_quantity AS INTEGER) * 80
         ELSE CAST(l_quantity AS INTEGER) * 1297 END AS dst_port,
    CAST(l_quantity AS INTEGER) AS in_pkts, l_linenumber AS out_pkts,
    l_extendedprice AS in_bytes, l_extendedprice * l_discount AS out_bytes,
    l_tax * 100000 AS duration, CAST(32 * (1 + l_partkey % 4) AS INTEGER) AS min_ttl,
    CASE WHEN l_quantity >= 45 AND l_discount >= 0.08 THEN 1 ELSE 0 END AS label
  FROM lineitem)"""


def flows_sql(where: str = "TRUE", keys: str = "silo") -> str:
    """CTEs ending in `flows`: rows with flow_id and n_rows."""
    return f"""{NAMED},
flows AS (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {ORDER_SQL}) - 1 AS flow_id,
    count(*) OVER (PARTITION BY {keys}) AS n_rows
  FROM named WHERE {where})"""


TRAIN_SQL = flows_sql("split = 'train' AND label = 0")

WINDOWED_SQL = f"""{TRAIN_SQL},
windowed AS (
  SELECT *, flow_id // 200 AS window_id, flow_id % 200 AS pos
  FROM flows WHERE (flow_id // 200) * 200 + 200 <= n_rows)"""

#: The same flows in windows of 200 that begin at every 100th.
OVERLAPPING_SQL = f"""{TRAIN_SQL},
windowed AS (
  SELECT *, flow_id - window_id * 100 AS pos FROM (SELECT *, unnest([flow_id // 100 - 1, flow_id // 100]) AS window_id FROM flows)
  WHERE window_id >= 0 AND window_id * 100 + 200 <= n_rows)"""

#: All flows of a silo as one window.
FRAME_WINDOW_SQL = f"""{TRAIN_SQL},
windowed AS (SELECT *, 0 AS window_id, flow_id AS pos FROM flows)"""

#: Every window once for each silo `model` whose encoder it gets.
CROSSED_SQL = f"""{TRAIN_SQL},
windowed AS (
  SELECT f.* EXCLUDE (silo), m.silo || '>' || f.silo AS silo, f.silo AS test_silo, m.silo AS model, flow_id // 200 AS window_id, flow_id % 200 AS pos
  FROM flows f, (SELECT DISTINCT silo FROM flows) m WHERE (flow_id // 200) * 200 + 200 <= n_rows)"""

NUMERIC_SQL = (
    "CAST(min_ttl AS DOUBLE)",
    "ln(1 + greatest(duration, 0.0))",
    "ln(1 + greatest(CAST(in_pkts AS DOUBLE) + CAST(out_pkts AS DOUBLE), 0.0))",
    "ln(1 + greatest(in_bytes + out_bytes, 0.0))",
)


def vocab_sql(keys: str = "silo", protocols: int = 4, ports: int = 4) -> str:
    """CTE `vocab` (keys, col, rank, value) on `flows`."""
    return f"""counted AS (
  SELECT {keys}, 'PROTOCOL' AS col, protocol AS value, count(*) AS n FROM flows GROUP BY {keys}, protocol
  UNION ALL
  SELECT {keys}, 'L4_DST_PORT' AS col, dst_port AS value, count(*) AS n FROM flows WHERE dst_port <= 49151 GROUP BY {keys}, dst_port),
vocab AS (
  SELECT {keys}, col, value, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY {keys}, col ORDER BY n DESC, value) AS rank FROM counted)
  WHERE rank <= CASE WHEN col = 'PROTOCOL' THEN {protocols} ELSE {ports} END)"""


def _moments_sql() -> str:
    cols = []
    for i, e in enumerate(NUMERIC_SQL):
        cols.append(f"avg({e}) AS m{i}")
        cols.append(f"CASE WHEN stddev_pop({e}) = 0 THEN 1.0 ELSE stddev_pop({e}) END AS s{i}")
    return f"moments AS (SELECT silo, {', '.join(cols)} FROM flows GROUP BY silo)"


def features_sql(windowed: str = WINDOWED_SQL, encoder: str = "silo") -> str:
    """CTEs ending in `edges`: windowed training flows with the scaled vector f0 .. f17, by the encoder of the silo in that column."""
    scaled = ", ".join(f"({e} - m{i}) / s{i} AS f{i}" for i, e in enumerate(NUMERIC_SQL))
    hot = [f"CASE WHEN pcode = {i} THEN 1.0 ELSE 0.0 END" for i in range(5)]
    hot += [f"CASE WHEN bucket = {i} THEN 1.0 ELSE 0.0 END" for i in range(3)]
    hot += [f"CASE WHEN qcode = {i} THEN 1.0 ELSE 0.0 END" for i in range(6)]
    blocks = ", ".join(f"CAST({h} AS DOUBLE) AS f{4 + i}" for i, h in enumerate(hot))
    return f"""{windowed},
{_moments_sql()},
{vocab_sql()},
lists AS (
  SELECT silo, list(value ORDER BY value) FILTER (WHERE col = 'PROTOCOL') AS pvocab,
    list(value ORDER BY rank) FILTER (WHERE col = 'L4_DST_PORT') AS qvocab
  FROM vocab GROUP BY silo),
coded AS (
  SELECT w.*, m.* EXCLUDE (silo),
    coalesce(nullif(list_position(pvocab, protocol), 0), 5) - 1 AS pcode,
    CASE WHEN src_port <= 1023 THEN 0 WHEN src_port <= 49151 THEN 1 ELSE 2 END AS bucket,
    CASE WHEN dst_port > 49151 THEN 5 ELSE coalesce(nullif(list_position(qvocab, dst_port), 0), 5) - 1 END AS qcode
  FROM windowed w JOIN moments m ON w.{encoder} = m.silo JOIN lists l ON w.{encoder} = l.silo),
edges AS (SELECT *, {scaled}, {blocks} FROM coded)"""


def octet_sql(i: int, ip: str = "ip") -> str:
    part = f"split_part({ip}, '.', {i + 1})"
    return f"(CASE WHEN regexp_matches({part}, '^[0-9]+$') THEN coalesce(TRY_CAST({part} AS INTEGER), 0) ELSE 0 END / 255.0)"


def nodes_sql(edges: str = "windowed", group: str = "silo, window_id", pos: str = "pos") -> str:
    """CTEs `ends` and `nodes` (group, ip, node_id, first)."""
    return f"""ends AS (
  SELECT {group}, src AS ip, 0 AS side, {pos} AS place FROM {edges} UNION ALL SELECT {group}, dst, 1, {pos} FROM {edges}),
nodes AS (
  SELECT {group}, ip, row_number() OVER (PARTITION BY {group} ORDER BY min(side * CAST(1000000000 AS BIGINT) + place)) - 1 AS node_id
  FROM ends GROUP BY {group}, ip)"""


def embeddings_sql(edges: str = "windowed", group: Sequence[str] = GROUP) -> str:
    """CTEs ending in `emb` (group, node_id, ip, v0 .. v3): three hops in four dimensions."""
    g = ", ".join(group)
    on_src = " AND ".join(f"e.{c} = x.{c}" for c in group)
    same = " AND ".join(f"x.{c} = y.{c}" for c in group)

    def unit(names: Sequence[str], weight: str) -> str:
        length = "sqrt(" + " + ".join(f"{n} * {n}" for n in names) + ")"
        return ", ".join(f"{n} / CASE WHEN {length} < 1e-9 THEN 1.0 ELSE {length} END * {weight} AS e{i}" for i, n in enumerate(names))

    octets = ", ".join(f"{octet_sql(i)} AS o{i}" for i in range(4))
    text = f"""oct AS (SELECT {g}, ip, node_id, {octets} FROM nodes),
h0 AS (SELECT {g}, ip, node_id, {unit([f'o{i}' for i in range(4)], '1.0')} FROM oct),
s0 AS (SELECT {g}, ip, node_id, e0 AS g0, e1 AS g1, e2 AS g2, e3 AS g3, e0 AS t0, e1 AS t1, e2 AS t2, e3 AS t3 FROM h0)"""
    for d in (1, 2, 3):
        mean = ", ".join(f"avg(g{i}) AS r{i}" for i in range(4))
        text += f""",
a{d} AS (SELECT {', '.join('e.' + c for c in group)}, e.src AS ip, {mean}
  FROM {edges} e JOIN s{d - 1} x ON {on_src} AND e.dst = x.ip GROUP BY {', '.join('e.' + c for c in group)}, e.src),
b{d} AS (SELECT {', '.join('x.' + c for c in group)}, x.ip, x.node_id, x.t0, x.t1, x.t2, x.t3, {', '.join(f'coalesce(r{i}, 0.0) AS r{i}' for i in range(4))}
  FROM s{d - 1} x LEFT JOIN a{d} y ON {same} AND x.ip = y.ip),
c{d} AS (SELECT *, {unit([f'r{i}' for i in range(4)], f'(1.0 / {d + 1})')} FROM b{d}),
s{d} AS (SELECT {g}, ip, node_id, {', '.join(f'r{i} - e{i} AS g{i}' for i in range(4))}, {', '.join(f't{i} + e{i} AS t{i}' for i in range(4))} FROM c{d})"""
    return text + f",\nemb AS (SELECT {g}, node_id, ip, t0 AS v0, t1 AS v1, t2 AS v2, t3 AS v3 FROM s3)"
