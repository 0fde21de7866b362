"""Sources, projections, row windows and feature fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.catalog.common import (
    ORDER_SQL, SPEC, NAMED, NUMERIC_SQL, TRAIN_SQL, all_flows, each6, features_sql, flows_sql, holdout_flows, octet_sql,
    q6, query, r6_all, r6_items, silo_encoder, table, train_edges, train_flows, train_windows, vocab_sql,
)
from flowloom.functions import scalar as S
from flowloom.functions.scalar import r6
from flowloom.operators import features as FE
from flowloom.operators.windows import coverage, row_windows
from flowloom.sources.flows import (
    DST, LABEL, ORDER_KEY, SRC, FeatureSpec, as_flows, benign_only, drop_incomplete, dropped_counts, lineitem_rows,
    numeric_value, pool_silos, read_flows, read_head,
)

ALL_SQL = flows_sql(keys="silo, split")


@query(
    "flow_features",
    f"""WITH {ALL_SQL} SELECT silo, split, flow_id,
      CAST(in_pkts AS DOUBLE) + CAST(out_pkts AS DOUBLE) AS total_pkts, {q6('in_bytes + out_bytes')} AS total_bytes,
      {', '.join(f'{q6(e)} AS x{i}' for i, e in enumerate(NUMERIC_SQL))}
    FROM flows""",
)
def flow_features(spark, sf):
    derived = FE.derive_totals(all_flows(spark, sf), SPEC)
    values = [r6(numeric_value(SPEC, n)).alias(f"x{i}") for i, n in enumerate(SPEC.numeric)]
    return derived.select(
        "silo", "split", "flow_id", F.col("TOTAL_PKTS").alias("total_pkts"), r6(F.col("TOTAL_BYTES")).alias("total_bytes"), *values
    )


@query(
    "read_flows",
    """SELECT 'first' AS silo, 'train' AS split, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem
    UNION ALL SELECT 'second', 'train', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM lineitem""",
)
def read_flows_query(spark, sf):
    path = f"{sf}/lineitem.parquet"
    rows = read_flows(spark, {"first": path, "second": path}, "train")
    return rows.groupBy("silo", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))


@query(
    "read_head",
    f"WITH {ALL_SQL} SELECT silo, split, flow_id, {ORDER_SQL}, label AS \"Label\" FROM flows WHERE flow_id < 1000 AND label = 0",
)
def read_head_query(spark, sf):
    head = read_head(lineitem_rows(spark, sf), ["silo", "split"], ORDER_KEY, 1000)
    return benign_only(head).select("silo", "split", "flow_id", *ORDER_KEY, LABEL)


@query(
    "feature_spec",
    f"""WITH {ALL_SQL} SELECT silo, split, flow_id, {q6('ln(1 + greatest(CAST(min_ttl AS DOUBLE), 0.0))')} AS "MIN_TTL",
      {q6('ln(1 + greatest(in_bytes + out_bytes, 0.0))')} AS "TOTAL_BYTES", {q6('ln(1 + greatest(duration, 0.0))')} AS "FLOW_DURATION_MILLISECONDS", 3 + 5 AS width
    FROM flows""",
)
def feature_spec(spark, sf):
    """A comma-separated column list with every numeric column compressed."""
    spec = FeatureSpec.resolve("MIN_TTL, PROTOCOL ,TOTAL_BYTES,FLOW_DURATION_MILLISECONDS", "all")
    values = [r6(numeric_value(spec, name)).alias(name) for name in spec.numeric]
    return all_flows(spark, sf).select("silo", "split", "flow_id", *values, F.lit(spec.width).alias("width"))


@query(
    "unscored_flows",
    f"""WITH {flows_sql("split = 'holdout'")}, steps AS (SELECT unnest([200, 100, 150]) AS step, unnest([200, 200, 100]) AS size),
    placed AS (SELECT *, flow_id // step AS w FROM flows, steps)
    SELECT CAST(step AS INTEGER) AS step, CAST(size AS INTEGER) AS size, silo, count(*) AS n_rows, CASE WHEN count(*) >= size THEN (count(*) - size) // step + 1 ELSE 0 END AS n_windows,
      count(*) FILTER (WHERE (w * step + size <= n_rows AND flow_id - w * step < size) OR (w >= 1 AND (w - 1) * step + size <= n_rows AND flow_id - (w - 1) * step < size)) AS n_covered
    FROM placed GROUP BY step, size, silo""",
)
def unscored_flows(spark, sf):
    """Flows in full windows, for tumbling, overlapping windows and windows with gaps."""
    sizes = holdout_flows(spark, sf).groupBy("silo").agg(F.max("n_rows").alias("n_rows"))
    parts = [coverage(sizes, ["silo"], size, step).withColumns({"step": F.lit(step), "size": F.lit(size)}) for step, size in ((200, 200), (100, 200), (150, 100))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("step", "size", "silo", "n_rows", "n_windows", "n_covered")


@query("benign_only", f"WITH {ALL_SQL} SELECT silo, split, flow_id, in_pkts FROM flows WHERE label = 0")
def benign_only_query(spark, sf):
    return benign_only(all_flows(spark, sf)).select("silo", "split", "flow_id", F.col("IN_PKTS").alias("in_pkts"))


@query(
    "dropped_counts",
    f"""WITH {NAMED} SELECT silo, split, count(*) AS n_before, count(*) FILTER (WHERE label <> 0) AS n_dropped,
      {q6('100.0 * count(*) FILTER (WHERE label <> 0) / count(*)')} AS pct_dropped FROM named GROUP BY silo, split""",
)
def dropped_counts_query(spark, sf):
    return r6_all(dropped_counts(lineitem_rows(spark, sf), ["silo", "split"]), ["pct_dropped"])


@query(
    "drop_incomplete",
    """SELECT l_returnflag AS silo, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem
    WHERE l_tax <> 0 AND l_discount <> 0 GROUP BY l_returnflag""",
)
def drop_incomplete_query(spark, sf):
    holes = lineitem_rows(spark, sf).withColumns(
        {
            "l_tax": F.when(F.col("l_tax") == 0, F.lit(None)).otherwise(F.col("l_tax")),
            "l_discount": F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_discount")),
        }
    )
    kept = drop_incomplete(holes, ["l_tax", "l_discount"])
    return kept.groupBy("silo").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))


@query(
    "pool_silos",
    f"""WITH {NAMED} SELECT count(*) AS n, {q6(f'avg({NUMERIC_SQL[3]})')} AS mean_bytes
    FROM named WHERE split = 'train' AND label = 0""",
)
def pool_silos_query(spark, sf):
    flows = train_flows(spark, sf)
    silos = [r[0] for r in flows.select("silo").distinct().collect()]
    pooled = pool_silos(*[flows.filter(F.col("silo") == s) for s in silos])
    mean = F.avg(numeric_value(SPEC, "TOTAL_BYTES"))
    return pooled.agg(F.count(F.lit(1)).alias("n"), r6(mean).alias("mean_bytes"))


@query(
    "port_buckets",
    f"""WITH {NAMED} SELECT silo, split,
      CASE WHEN src_port <= 1023 THEN 0 WHEN src_port <= 49151 THEN 1 ELSE 2 END AS src_bucket,
      CASE WHEN dst_port <= 1023 THEN 0 WHEN dst_port <= 49151 THEN 1 ELSE 2 END AS dst_bucket, count(*) AS n
    FROM named GROUP BY ALL""",
)
def port_buckets(spark, sf):
    flows = as_flows(lineitem_rows(spark, sf))
    return flows.groupBy(
        "silo", "split",
        S.port_bucket(F.col("L4_SRC_PORT")).alias("src_bucket"), S.port_bucket(F.col("L4_DST_PORT")).alias("dst_bucket"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "client_name",
    """WITH names AS (
      SELECT l_returnflag || '#' || l_linestatus || '#' || CAST(l_orderkey % 4 AS VARCHAR) AS client FROM lineitem
      UNION ALL SELECT l_returnflag || '#' || CAST(l_linenumber AS VARCHAR) FROM lineitem
      UNION ALL SELECT l_returnflag FROM lineitem)
    SELECT client, CASE WHEN contains(client, '#') THEN regexp_extract(client, '^(.*)#([^#]*)$', 1) ELSE client END AS base,
      CASE WHEN contains(client, '#') THEN CAST(regexp_extract(client, '#([^#]*)$', 1) AS INTEGER) END AS shard, count(*) AS n
    FROM names GROUP BY client""",
)
def client_name(spark, sf):
    flag, rest = F.col("l_returnflag"), table(spark, sf, "lineitem")
    names = F.array(
        F.concat_ws("#", flag, "l_linestatus", (F.col("l_orderkey") % 4).cast("string")),
        F.concat_ws("#", flag, F.col("l_linenumber").cast("string")),
        flag,
    )
    counted = rest.select(F.explode(names).alias("client")).groupBy("client").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        "client", S.client_base(F.col("client")).alias("base"), S.client_shard(F.col("client")).alias("shard"), "n"
    )


@query("row_index", f"WITH {ALL_SQL} SELECT silo, split, {ORDER_SQL}, flow_id, n_rows FROM flows")
def row_index(spark, sf):
    return all_flows(spark, sf).select("silo", "split", *ORDER_KEY, "flow_id", "n_rows")


def _windows_sql(size: int, step: int) -> str:
    return f"""WITH {TRAIN_SQL},
    starts AS (SELECT silo, unnest(range(0, CAST(max(n_rows) AS BIGINT) - {size} + 1, {step})) AS start FROM flows GROUP BY silo)
    SELECT f.silo, start // {step} AS window_id, CAST(flow_id - start AS INTEGER) AS pos_in_window, flow_id
    FROM starts s JOIN flows f ON f.silo = s.silo AND flow_id >= start AND flow_id < start + {size}"""


def _windows(spark, sf, size, step):
    windowed = row_windows(train_flows(spark, sf), size, step, pos="flow_id")
    return windowed.select("silo", "window_id", "pos_in_window", "flow_id")


@query("row_windows_tumbling", _windows_sql(200, 200))
def row_windows_tumbling(spark, sf):
    return _windows(spark, sf, 200, 200)


@query("row_windows_overlap", _windows_sql(200, 100))
def row_windows_overlap(spark, sf):
    return _windows(spark, sf, 200, 100)


@query("row_windows_gap", _windows_sql(100, 150))
def row_windows_gap(spark, sf):
    return _windows(spark, sf, 100, 150)


def _scaler_sql(silo: str, group: str) -> str:
    parts = [
        f"""SELECT {silo} AS silo, '{name}' AS feature, {i} AS pos, {q6(f'avg({e})')} AS mean,
        {q6(f'CASE WHEN stddev_pop({e}) = 0 THEN 1.0 ELSE stddev_pop({e}) END')} AS scale FROM flows {group}"""
        for i, (name, e) in enumerate(zip(SPEC.numeric, NUMERIC_SQL, strict=True))
    ]
    return f"WITH {TRAIN_SQL} " + " UNION ALL ".join(parts)


@query("fit_scaler_silo", _scaler_sql("silo", "GROUP BY silo"))
def fit_scaler_silo(spark, sf):
    return r6_all(FE.fit_scaler(train_flows(spark, sf), SPEC, ["silo"]), ["mean", "scale"])


@query("fit_scaler_pooled", _scaler_sql("'all'", ""))
def fit_scaler_pooled(spark, sf):
    pooled = train_flows(spark, sf).withColumn("silo", F.lit("all"))
    return r6_all(FE.fit_scaler(pooled, SPEC, ["silo"]), ["mean", "scale"])


@query("scaled_features", f"WITH {features_sql()} SELECT silo, window_id, flow_id, {each6('f', 4)} FROM edges")
def scaled_features(spark, sf):
    state = silo_encoder(spark, sf)
    joined = train_windows(spark, sf).join(state, "silo")
    scaled = [r6(v).alias(f"f{i}") for i, v in enumerate(FE.numeric_block(SPEC))]
    return joined.select("silo", "window_id", "flow_id", *scaled)


def _vocab_query(column: str, k: int):
    def run(spark, sf):
        spec = FeatureSpec(top_protocols=k, top_ports=k)
        state = FE.fit_vocab(train_flows(spark, sf), spec, ["silo"]).filter(F.col("column") == column)
        return state.select("silo", F.col("slot").cast("bigint").alias("slot"), "value")

    return run


def _vocab_sql(column: str, k: int, order: str) -> str:
    return f"""WITH {TRAIN_SQL}, {vocab_sql(protocols=k, ports=k)}
    SELECT silo, row_number() OVER (PARTITION BY silo ORDER BY {order}) - 1 AS slot, value FROM vocab WHERE col = '{column}'"""


query("protocol_vocab", _vocab_sql("PROTOCOL", 2, "value"))(_vocab_query("PROTOCOL", 2))
query("port_vocab", _vocab_sql("L4_DST_PORT", 16, "rank"))(_vocab_query("L4_DST_PORT", 16))


@query(
    "pad_vocab",
    f"""WITH {TRAIN_SQL}, {vocab_sql(protocols=7, ports=4)},
    real AS (SELECT silo, row_number() OVER (PARTITION BY silo ORDER BY value) - 1 AS slot, value FROM vocab WHERE col = 'PROTOCOL'),
    sized AS (SELECT silo, count(*) AS n FROM real GROUP BY silo)
    SELECT silo, slot, value FROM real
    UNION ALL SELECT silo, n + i - 1, CAST(-i AS INTEGER) FROM (SELECT silo, n, unnest(range(1, 7 - n + 1)) AS i FROM sized)""",
)
def pad_vocab(spark, sf):
    spec = FeatureSpec(top_protocols=7)
    state = FE.fit_vocab(train_flows(spark, sf), spec, ["silo"])
    padded = FE.vocab_arrays(state, spec, ["silo"])
    rows = padded.select("silo", F.posexplode("protocol_vocab").alias("slot", "value"))
    return rows.select("silo", F.col("slot").cast("bigint").alias("slot"), "value")


@query(
    "one_hot",
    f"WITH {features_sql()} SELECT silo, window_id, flow_id, {', '.join(f'f{i}' for i in range(4, 18))} FROM edges",
)
def one_hot(spark, sf):
    joined = train_windows(spark, sf).join(silo_encoder(spark, sf), "silo").withColumns(FE.categorical_codes(SPEC))
    hot = [c.alias(f"f{4 + i}") for i, c in enumerate(FE.categorical_block(SPEC))]
    return joined.select("silo", "window_id", "flow_id", *hot)


@query("edge_vector", f"WITH {features_sql()} SELECT silo, window_id, flow_id, {each6('f', 18)} FROM edges")
def edge_vector(spark, sf):
    return train_edges(spark, sf).select("silo", "window_id", "flow_id", *r6_items("features", SPEC.width, "f"))


@query(
    "feature_names",
    f"""WITH {TRAIN_SQL}, {vocab_sql()},
    parts AS (
      SELECT silo, 0 AS block, unnest(range(4)) AS place, unnest(['MIN_TTL', 'FLOW_DURATION_MILLISECONDS', 'TOTAL_PKTS', 'TOTAL_BYTES']) AS name
        FROM (SELECT DISTINCT silo FROM flows)
      UNION ALL SELECT silo, 1, row_number() OVER (PARTITION BY silo ORDER BY value), 'PROTOCOL=' || value FROM vocab WHERE col = 'PROTOCOL'
      UNION ALL SELECT DISTINCT silo, 1, 1000, 'PROTOCOL=other' FROM flows
      UNION ALL SELECT silo, 2, unnest(range(3)), unnest(['SRC_PORT=wellknown', 'SRC_PORT=registered', 'SRC_PORT=ephemeral'])
        FROM (SELECT DISTINCT silo FROM flows)
      UNION ALL SELECT silo, 3, rank, 'DST_PORT=' || value FROM vocab WHERE col = 'L4_DST_PORT'
      UNION ALL SELECT silo, 3, unnest([1000, 1001]), unnest(['DST_PORT=other', 'DST_PORT=ephemeral']) FROM (SELECT DISTINCT silo FROM flows))
    SELECT silo, row_number() OVER (PARTITION BY silo ORDER BY block, place) - 1 AS feature_pos, name FROM parts""",
)
def feature_names(spark, sf):
    state = FE.fit_vocab(train_flows(spark, sf), SPEC, ["silo"])
    names = FE.feature_names(state, SPEC, ["silo"])
    return names.select("silo", F.col("feature_pos").cast("bigint").alias("feature_pos"), "name")


@query(
    "check_feature_dim",
    f"""WITH {TRAIN_SQL}, {vocab_sql(protocols=9, ports=4)}
    SELECT silo, CAST(count(*) + 4 + 1 + 3 + 2 AS INTEGER) AS n_features, 23 AS expected FROM vocab GROUP BY silo
    HAVING count(*) + 4 + 1 + 3 + 2 <> 23""",
)
def check_feature_dim(spark, sf):
    spec = FeatureSpec(top_protocols=9)
    return FE.check_width(FE.fit_encoder(train_flows(spark, sf), spec, ["silo"]), spec, ["silo"])


@query(
    "ip_octets",
    f"""WITH texts AS (
      SELECT src AS ip FROM (WITH {NAMED} SELECT * FROM named)
      UNION ALL SELECT CAST(user_id AS VARCHAR) || '.' || event_type FROM events
      UNION ALL SELECT CAST(event_id AS VARCHAR) || '.1.2.3.4' FROM events)
    SELECT ip, {', '.join(f'{q6(octet_sql(i))} AS o{i}' for i in range(4))}, count(*) AS n FROM texts GROUP BY ip""",
)
def ip_octets(spark, sf):
    flows = as_flows(lineitem_rows(spark, sf)).select(F.col(SRC).alias("ip"))
    events = table(spark, sf, "events")
    texts = F.array(
        F.concat_ws(".", F.col("user_id").cast("string"), "event_type"),
        F.concat(F.col("event_id").cast("string"), F.lit(".1.2.3.4")),
    )
    counted = flows.unionByName(events.select(F.explode(texts).alias("ip"))).groupBy("ip").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("ip", *[r6(o).alias(f"o{i}") for i, o in enumerate(S.ip_octets(F.col("ip")))], "n")


def _project_sql(dim: int) -> str:
    matrix = S.projection(dim)
    columns = ", ".join(q6(" + ".join(f"{octet_sql(k)} * {float(matrix[k, j])!r}" for k in range(4))) + f" AS p{j}" for j in range(dim))
    return f"WITH {NAMED} SELECT DISTINCT ip, {columns} FROM (SELECT src AS ip FROM named UNION SELECT dst FROM named)"


@query("project_vector", _project_sql(8))
def project_vector(spark, sf):
    flows = as_flows(lineitem_rows(spark, sf)).select(F.explode(F.array(SRC, DST)).alias("ip")).distinct()
    vector = S.project(S.ip_octets(F.col("ip")), S.projection(8))
    return flows.select("ip", *[r6(v).alias(f"p{i}") for i, v in enumerate(vector)])


def _norm_sql(width: int) -> str:
    total = " + ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) * CAST(embedding[{i + 1}] AS DOUBLE)" for i in range(width))
    cols = ", ".join(f"{q6(f'CAST(embedding[{i + 1}] AS DOUBLE) / CASE WHEN len < 1e-9 THEN 1.0 ELSE len END')} AS u{i}" for i in range(width))
    return f"SELECT vec_id, {cols} FROM (SELECT *, sqrt({total}) AS len FROM embeddings)"


@query("unit_norm", _norm_sql(64))
def unit_norm(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    rows = rows.withColumn("length", S.norm(S.items("v", 64)))
    unit = S.unit(S.items("v", 64), F.col("length"))
    return rows.select("vec_id", *[r6(u).alias(f"u{i}") for i, u in enumerate(unit)])





@query(
    "vocab_lookup",
    f"WITH {features_sql()} SELECT silo, window_id, flow_id, CAST(pcode AS INTEGER) AS protocol_code, bucket AS src_bucket, CAST(qcode AS INTEGER) AS dst_code FROM edges",
)
def vocab_lookup(spark, sf):
    joined = train_windows(spark, sf).join(silo_encoder(spark, sf), "silo").withColumns(FE.categorical_codes(SPEC))
    return joined.select(
        "silo", "window_id", "flow_id", F.col("_code_PROTOCOL").alias("protocol_code"),
        F.col("_code_L4_SRC_PORT").alias("src_bucket"), F.col("_code_L4_DST_PORT").alias("dst_code"),
    )


@query(
    "silo_local_fit",
    f"""WITH {TRAIN_SQL}, {vocab_sql(protocols=7, ports=4)},
    real AS (SELECT silo, count(*) AS n FROM vocab WHERE col = 'PROTOCOL' GROUP BY silo)
    SELECT f.silo, 21 AS n_features, 7 AS n_protocol_slots, CAST(7 - max(n) AS INTEGER) AS n_filled, {q6(f'avg({NUMERIC_SQL[2]})')} AS mean_pkts
    FROM flows f JOIN real ON f.silo = real.silo GROUP BY f.silo""",
)
def silo_local_fit(spark, sf):
    """Every silo's own scaler and vocabularies, filled to one width."""
    spec = FeatureSpec(top_protocols=7)
    state = FE.fit_encoder(train_flows(spark, sf), spec, ["silo"], padded=True)
    filled = F.size(F.filter("protocol_vocab", lambda v: v < 0))
    return state.select(
        "silo", "n_features", F.size("protocol_vocab").alias("n_protocol_slots"), filled.alias("n_filled"),
        r6(F.col("means")[2]).alias("mean_pkts"),
    )
