"""Window graphs, node vectors, context, attention and normalisation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowloom.catalog.common import (
    CONFIG, CROSSED_SQL, FRAME_WINDOW_SQL, GROUP, OVERLAPPING_SQL, SPEC, TRAIN_SQL, WINDOWED_SQL, each6, embeddings_sql, features_sql, flows_sql, nodes_sql, q6,
    query, r6_all, r6_items, silo_encoder, table, train_edges, train_flows, train_windows,
)
from flowloom.functions.scalar import r6
from flowloom.operators import combine, graph, reconstruct, wholegraph
from flowloom.operators import context
from flowloom.operators.context import ContextSpec
from flowloom.operators.features import encode
from flowloom.plans import training
from flowloom.sources.flows import DST, SRC
from flowloom.stage import materialize

G = list(GROUP)
SPEC4 = ContextSpec(GROUP, SPEC.width, 4, rows=CONFIG.window)
ON = "e.silo = {0}.silo AND e.window_id = {0}.window_id"


@query("node_ids", f"WITH {WINDOWED_SQL}, {nodes_sql()} SELECT silo, window_id, node_id, ip FROM nodes")
def node_ids(spark, sf):
    return graph.node_ids(train_windows(spark, sf), G).select(*G, F.col("node_id").cast("bigint").alias("node_id"), "ip")


EDGES_SQL = f"""WITH {WINDOWED_SQL}, {nodes_sql()}
  SELECT e.silo, e.window_id, CAST(pos AS INTEGER) AS pos_in_window, flow_id, s.node_id AS src_node, d.node_id AS dst_node
  FROM windowed e JOIN nodes s ON {ON.format('s')} AND e.src = s.ip JOIN nodes d ON {ON.format('d')} AND e.dst = d.ip"""


@query("edge_list", EDGES_SQL)
def edge_list(spark, sf):
    edges = graph.edge_list(train_windows(spark, sf), G, ["flow_id"])
    return edges.withColumns({c: F.col(c).cast("bigint") for c in ("src_node", "dst_node")})


@query(
    "out_degree",
    f"""WITH {WINDOWED_SQL}, {nodes_sql()},
    deg AS (SELECT silo, window_id, src AS ip, count(*) AS n FROM windowed GROUP BY ALL)
    SELECT e.silo, e.window_id, node_id, e.ip, coalesce(n, 0) AS out_degree
    FROM nodes e LEFT JOIN deg ON {ON.format('deg')} AND e.ip = deg.ip""",
)
def out_degree(spark, sf):
    out = graph.out_degree(train_windows(spark, sf), G)
    return out.withColumn("node_id", F.col("node_id").cast("bigint"))


@query(
    "propagate_1hop",
    f"""WITH {WINDOWED_SQL}, {nodes_sql()}, {embeddings_sql()}
    SELECT silo, window_id, node_id, {each6('r', 4)} FROM b1""",
)
def propagate_1hop(spark, sf):
    out = graph.propagate(train_windows(spark, sf), G, 4)
    return out.select(*G, F.col("node_id").cast("bigint").alias("node_id"), *r6_items("vector", 4, "r"))


@query(
    "node_embeddings",
    f"""WITH {WINDOWED_SQL}, {nodes_sql()}, {embeddings_sql()}
    SELECT silo, window_id, node_id, ip, {each6('v', 4)} FROM emb""",
)
def node_embeddings(spark, sf):
    out = context.node_embeddings(train_windows(spark, sf), SPEC4)
    return out.select(*G, "node_id", "ip", *r6_items("embedding", 4, "v"))


@query(
    "graph_windows",
    f"""WITH {features_sql()}, {nodes_sql()}, {embeddings_sql()}
    SELECT e.silo, e.window_id, e.flow_id, e.label, s.node_id AS src_node, d.node_id AS dst_node, {each6('f', 18)},
      {', '.join(f'{q6(f"s.v{i}")} AS s{i}' for i in range(4))}, {', '.join(f'{q6(f"d.v{i}")} AS d{i}' for i in range(4))}
    FROM edges e JOIN emb s ON {ON.format('s')} AND e.src = s.ip JOIN emb d ON {ON.format('d')} AND e.dst = d.ip""",
)
def graph_windows(spark, sf):
    out = context.graph_windows(train_edges(spark, sf), SPEC4)
    return out.select(
        *G, "flow_id", "label", "src_node", "dst_node",
        *r6_items("features", SPEC.width, "f"), *r6_items("src_embedding", 4, "s"), *r6_items("dst_embedding", 4, "d"),
    )


FRAME_SQL = f"""WITH {TRAIN_SQL},
  windowed AS (SELECT *, flow_id AS pos FROM flows), {nodes_sql(group='silo')}, {embeddings_sql(group=('silo',))}
  SELECT silo, node_id, ip, {each6('v', 4)} FROM emb"""


@query("single_graph", FRAME_SQL)
def single_graph(spark, sf):
    flows = train_flows(spark, sf)
    nodes = wholegraph.frame_nodes(flows, ["silo"], "flow_id")
    out = wholegraph.frame_embeddings(flows, nodes, ["silo"], 4)
    return out.select("silo", "node_id", "ip", *r6_items("embedding", 4, "v"))


@query(
    "window_mean",
    f"""WITH {features_sql()} SELECT silo, window_id, count(*) AS n_edges,
      {', '.join(f'{q6(f"avg(f{i})")} AS c{i}' for i in range(18))} FROM edges GROUP BY silo, window_id""",
)
def window_mean(spark, sf):
    out = graph.window_mean(train_edges(spark, sf), G, SPEC.width)
    return out.select(*G, "n_edges", *r6_items("context", SPEC.width, "c"))


PANE_SQL = f"""{TRAIN_SQL},
windowed AS (SELECT * FROM (SELECT *, unnest(range(flow_id // 80 - 2, flow_id // 80 + 1)) AS window_id FROM flows)
  WHERE window_id >= 0 AND flow_id < window_id * 80 + 200 AND window_id * 80 + 200 <= n_rows)"""


@query(
    "pane_means",
    f"""WITH {features_sql(PANE_SQL)} SELECT silo, window_id, count(*) AS n_edges,
      {', '.join(f'{q6(f"avg(f{i})")} AS c{i}' for i in range(18))} FROM edges GROUP BY silo, window_id""",
)
def pane_means(spark, sf):
    """Means of windows of 200 flows that begin at every 80th, from panes of 40."""
    edges = encode(train_flows(spark, sf), silo_encoder(spark, sf), SPEC, ["silo"])
    out = graph.pane_means(edges, ["silo"], 200, 80, SPEC.width)
    return out.select(*G, "n_edges", *r6_items("context", SPEC.width, "c"))


def _context_cte(windowed: str = WINDOWED_SQL, encoder: str = "silo") -> str:
    """`pred`: every flow with its contexts (a, b, w), end vectors (sv, dv) and features."""

    def other(i: int, keys: str) -> str:
        over = f"OVER (PARTITION BY {keys})"
        return f"CASE WHEN count(*) {over} = 1 THEN 0.0 ELSE (sum(f{i}) {over} - f{i}) / (count(*) {over} - 1) END"

    parts = {"a": "silo, window_id, src", "b": "silo, window_id, dst", "w": "silo, window_id"}
    cols = ", ".join(f"{other(i, k)} AS {p}{i}" for p, k in parts.items() for i in range(18))
    ends = ", ".join(f"{p}.v{i} AS {p}v{i}" for p in ("s", "d") for i in range(4))
    return f"""WITH {features_sql(windowed, encoder)}, {nodes_sql()}, {embeddings_sql()}, ctx AS (SELECT *, {cols} FROM edges),
    pred AS (SELECT e.*, {ends} FROM ctx e
      JOIN emb s ON {ON.format('s')} AND e.src = s.ip JOIN emb d ON {ON.format('d')} AND e.dst = d.ip)"""


PREDICTORS = [f"{p}{i}" for p in "abw" for i in range(18)] + [f"{p}v{i}" for p in "sd" for i in range(4)]


def _context_sql() -> str:
    return f"{_context_cte()} SELECT silo, window_id, flow_id, {', '.join(f'{q6(c)} AS {c}' for c in PREDICTORS)} FROM pred"


def _gram_sql() -> str:
    """Mean products of all pairs of [1, predictors, features] per silo."""
    entries = ["1.0", *PREDICTORS, *[f"f{i}" for i in range(18)]]
    n = len(entries)
    cells = [(i, j) for i in range(n) for j in range(i, n)]
    sums = ", ".join(f"avg({entries[i]} * {entries[j]})" for i, j in cells)
    return f"""{_context_cte()}, sums AS (SELECT silo, [{sums}] AS v FROM pred GROUP BY silo)
    SELECT silo AS model, CAST(unnest({[i for i, _ in cells]}) AS INTEGER) AS i, CAST(unnest({[j for _, j in cells]}) AS INTEGER) AS j,
      {q6('unnest(v) + 1.3e-9')} AS value FROM sums"""


def fixed_coefficient(i: int, j: int) -> float:
    """Coefficients that need no fit, for comparing scores."""
    return ((7 * i + 3 * j) % 11 - 5) / 100


def _fixed_error() -> str:
    """Error of a flow of `pred` under the fixed coefficients."""
    entries = ["1.0", *PREDICTORS]
    errors = []
    for j in range(18):
        predicted = " + ".join(f"{fixed_coefficient(i, j)} * {x}" for i, x in enumerate(entries))
        errors.append(f"({predicted} - f{j}) ** 2")
    return "(" + " + ".join(errors) + ") / 18"


def _score_sql() -> str:
    return f"{_context_cte()} SELECT silo, window_id, flow_id, label, {q6(_fixed_error())} AS score FROM pred"


def fixed_models(silos, spec: ContextSpec):
    """The same coefficients for every row of (model)."""
    coef = [[fixed_coefficient(i, j) for j in range(spec.width)] for i in range(spec.size)]
    return silos.select("model", F.posexplode(F.lit(coef)).alias("i", "coef"))


@query("endpoint_context", _context_sql())
def endpoint_context_query(spark, sf):
    edges = train_edges(spark, sf)
    out = context.endpoint_context(edges, SPEC4)
    x = F.col("predictors")
    return out.select(*G, "flow_id", *[r6(x.getItem(1 + i)).alias(n) for i, n in enumerate(PREDICTORS)])


@query("gram_sums", _gram_sql())
def gram_sums(spark, sf):
    """Sums of products per silo, divided by the number of flows.

    Many are ratios of whole numbers that lie on a border of rounding; the same small number
    moves them off it on both sides.
    """
    edges = train_edges(spark, sf).withColumn("model", F.col("silo"))
    sums = reconstruct.gram_sums(edges, context.ContextSpec(("model", *G), SPEC.width, 4, rows=CONFIG.window), "model")
    count = F.max(F.when((F.col("i") == 0) & (F.col("j") == 0), F.col("value"))).over(Window.partitionBy("model"))
    return sums.select("model", "i", "j", r6(F.col("value") / count + 1.3e-9).alias("value"))


@query("score_flows", _score_sql())
def score_flows(spark, sf):
    """Scores under coefficients that are the same for all silos."""
    edges = train_edges(spark, sf).withColumn("model", F.col("silo"))
    spec = context.ContextSpec(("model", *G), SPEC.width, 4, rows=CONFIG.window)
    out = reconstruct.score_flows(edges, fixed_models(edges.select("model").distinct(), spec), spec)
    return out.select(*G, "flow_id", "label", r6(F.col("score")).alias("score"))


@query(
    "overlap_scores",
    f"""{_context_cte(OVERLAPPING_SQL)}, scored AS (SELECT silo, flow_id, label, {_fixed_error()} AS score FROM pred)
    SELECT silo, flow_id, count(*) AS n_windows, {q6('max(score)')} AS largest, {q6('avg(score)')} AS mean, max(label) AS label FROM scored GROUP BY silo, flow_id""",
)
def overlap_scores(spark, sf):
    """Overlapping windows: a flow has a score for every window it lies in, reduced to the largest and to the mean."""
    cfg = replace(CONFIG, step=100)
    edges = training.encoded_windows(train_flows(spark, sf), silo_encoder(spark, sf).withColumnRenamed("silo", "enc"), cfg, False)
    scores = materialize(reconstruct.score_flows(edges, fixed_models(edges.select("model").distinct(), cfg.context), cfg.context), "scores")
    both = training.flow_scores(scores, "max").withColumnRenamed("score", "largest").join(training.flow_scores(scores, "avg").select("silo", "flow_id", F.col("score").alias("mean")), ["silo", "flow_id"])
    counted = both.join(scores.groupBy("silo", "flow_id").agg(F.count(F.lit(1)).alias("n_windows")), ["silo", "flow_id"])
    return r6_all(counted, ["largest", "mean"])


@query(
    "validation_error",
    f"""{_context_cte()}, windows AS (SELECT DISTINCT silo, window_id FROM pred),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY silo ORDER BY md5('42|' || silo || '|' || CAST(window_id AS VARCHAR)), window_id) - 1 AS r, count(*) OVER (PARTITION BY silo) AS n FROM windows)
    SELECT p.silo, {q6(f'avg({_fixed_error()})')} AS val_mse, count(*) AS n_edges FROM pred p JOIN ranked w ON p.silo = w.silo AND p.window_id = w.window_id
    WHERE r >= floor(n * 0.8) GROUP BY p.silo""",
)
def validation_error(spark, sf):
    """Element mean of the squared error over the validation windows, under the fixed coefficients."""
    flows = train_flows(spark, sf)
    encoder = silo_encoder(spark, sf).withColumnRenamed("silo", "enc")
    edges = training.training_part(flows, encoder, training.window_cuts(flows, CONFIG), CONFIG, False, "val")
    scores = reconstruct.score_flows(edges, fixed_models(edges.select("model").distinct(), CONFIG.context), CONFIG.context)
    return r6_all(reconstruct.validation_mse(scores, ["silo"]), ["val_mse"])


@query(
    "transfer_errors",
    f"""{_context_cte(CROSSED_SQL, 'model')} SELECT model AS train_silo, test_silo, count(*) AS n, {q6(f'avg({_fixed_error()})')} AS mean_score,
      {q6(f'max({_fixed_error()})')} AS max_score FROM pred GROUP BY model, test_silo""",
)
def transfer_errors(spark, sf):
    """Every silo's flows under every silo's encoder, and the fixed coefficients."""
    encoder = silo_encoder(spark, sf).withColumnRenamed("silo", "enc")
    models = materialize(fixed_models(encoder.select(F.col("enc").alias("model")), CONFIG.context), "coefficients")
    trained = training.Training("per_silo", CONFIG, encoder, None, None, models)
    scores = training.transfer_scores(train_flows(spark, sf), trained)
    found = scores.groupBy(F.col("model").alias("train_silo"), F.col("silo").alias("test_silo"))
    return r6_all(found.agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score")), ["mean_score", "max_score"])


@query(
    "frame_predictors",
    f"{_context_cte(FRAME_WINDOW_SQL)} SELECT silo, flow_id, {', '.join(f'{q6(c)} AS {c}' for c in PREDICTORS)} FROM pred",
)
def frame_predictors(spark, sf):
    """All flows of a silo as one graph: predictors by joins and aggregates."""
    flows = train_flows(spark, sf).withColumns({"window_id": F.lit(0).cast("bigint"), "pos_in_window": F.col("flow_id")})
    edges = encode(flows, silo_encoder(spark, sf), SPEC, ["silo"])
    out = wholegraph.single_graph(edges, ContextSpec(("silo",), SPEC.width, 4))
    x = F.col("predictors")
    return out.select("silo", "flow_id", *[r6(x.getItem(1 + i)).alias(n) for i, n in enumerate(PREDICTORS)])


@query(
    "endpoint_gather",
    f"""WITH {features_sql()}, {nodes_sql()}, {embeddings_sql()},
    ctx AS (SELECT silo, window_id, {', '.join(f'avg(f{i}) AS c{i}' for i in range(18))} FROM edges GROUP BY silo, window_id)
    SELECT e.silo, e.window_id, e.flow_id, {', '.join(f'{q6(f"{p}.v{i}")} AS {p}{i}' for p in 'sd' for i in range(4))}, {each6('c', 18)}
    FROM windowed e JOIN emb s ON {ON.format('s')} AND e.src = s.ip JOIN emb d ON {ON.format('d')} AND e.dst = d.ip
    JOIN ctx ON {ON.format('ctx')}""",
)
def endpoint_gather(spark, sf):
    edges = graph.edge_list(train_windows(spark, sf), G, ["flow_id"])
    nodes = context.node_embeddings(train_windows(spark, sf), SPEC4)
    contexts = graph.window_mean(train_edges(spark, sf), G, SPEC.width)
    out = combine.endpoint_gather(edges, nodes, contexts, G)
    return out.select(
        *G, "flow_id", *r6_items("src_embedding", 4, "s"), *r6_items("dst_embedding", 4, "d"), *r6_items("context", SPEC.width, "c")
    )


@query(
    "attention_aggregate",
    f"""WITH {features_sql()}, {nodes_sql()}, {embeddings_sql()},
    pairs AS (SELECT e.silo, e.window_id, d.node_id AS dst_node, s.v0, s.v1, s.v2, s.v3,
        (s.v0 * d.v0 + s.v1 * d.v1 + s.v2 * d.v2 + s.v3 * d.v3) / 2.0 + 0.5 * f0 - 0.25 * f3 AS score
      FROM edges e JOIN emb s ON {ON.format('s')} AND e.src = s.ip JOIN emb d ON {ON.format('d')} AND e.dst = d.ip),
    soft AS (SELECT *, exp(score - max(score) OVER (PARTITION BY silo, window_id, dst_node)) AS mass FROM pairs)
    SELECT silo, window_id, dst_node, count(*) AS n_in,
      {', '.join(f'{q6(f"sum(mass * v{i}) / sum(mass)")} AS g{i}' for i in range(4))}
    FROM soft GROUP BY silo, window_id, dst_node""",
)
def attention_aggregate(spark, sf):
    edges = context.graph_windows(train_edges(spark, sf), SPEC4, ["features"])
    weights = [0.5, 0.0, 0.0, -0.25] + [0.0] * (SPEC.width - 4)
    out = graph.attention_aggregate(edges, G, 4, SPEC.width, weights)
    return out.select(*G, "dst_node", "n_in", *r6_items("aggregated", 4, "g"))


@query(
    "combine_by_flow",
    f"""WITH {flows_sql()} SELECT silo, split, flow_id, src, dst,
      CASE WHEN split = 'holdout' THEN in_bytes END AS probability_anomalous FROM (
        SELECT * EXCLUDE (flow_id), row_number() OVER (PARTITION BY silo, split
          ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS flow_id FROM flows)""",
)
def combine_by_flow(spark, sf):
    from flowloom.catalog.common import all_flows

    flows = all_flows(spark, sf)
    scores = flows.filter(F.col("split") == "holdout").select("silo", "split", "flow_id", F.col("IN_BYTES").alias("score"))
    out = combine.combine_by_flow(flows, scores, ["silo", "split", "flow_id"])
    return out.select("silo", "split", "flow_id", F.col(SRC).alias("src"), F.col(DST).alias("dst"), "probability_anomalous")


@query(
    "combine_by_pair",
    f"""WITH {WINDOWED_SQL},
    sc AS (SELECT silo, window_id, src, dst, arg_min(in_bytes, pos) AS p FROM windowed WHERE pos < 150 GROUP BY ALL)
    SELECT e.silo, e.window_id, e.flow_id, sc.p AS probability_anomalous
    FROM windowed e LEFT JOIN sc ON {ON.format('sc')} AND e.src = sc.src AND e.dst = sc.dst""",
)
def combine_by_pair(spark, sf):
    flows = train_windows(spark, sf)
    scores = flows.filter(F.col("pos_in_window") < 150).withColumn("score", F.col("IN_BYTES"))
    out = combine.combine_by_pair(flows, scores, G, SRC, DST, "pos_in_window")
    return out.select(*G, "flow_id", "probability_anomalous")


STATS_SQL = """stats AS (SELECT label, pos, avg(v) AS mean, var_pop(v) AS var FROM (
    SELECT label, unnest(range(64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY label, pos)"""


@query(
    "silo_norm_stats",
    f"WITH {STATS_SQL} SELECT label, CAST(pos AS INTEGER) AS pos, {q6('mean')} AS mean, {q6('var')} AS var FROM stats",
)
def silo_norm_stats(spark, sf):
    stats = combine.silo_norm_stats(table(spark, sf, "embeddings"), ["label"], "embedding", 64)
    return r6_all(stats, ["mean", "var"])


@query(
    "batch_norm_apply",
    f"""WITH {STATS_SQL},
    long AS (SELECT vec_id, label, unnest(range(64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
    SELECT vec_id, CAST(l.pos AS INTEGER) AS pos, {q6('(v - mean) / sqrt(var + 1e-5) * 1.5 + 0.25')} AS normalised
    FROM long l JOIN stats s ON l.label = s.label AND l.pos = s.pos""",
)
def batch_norm_apply(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    stats = combine.silo_norm_stats(rows, ["label"], "embedding", 64)
    out = combine.batch_norm_apply(rows, stats, ["label"], "embedding", gamma=1.5, beta=0.25)
    return out.select("vec_id", F.posexplode("normalised").alias("pos", "v")).select("vec_id", "pos", r6(F.col("v")).alias("normalised"))


