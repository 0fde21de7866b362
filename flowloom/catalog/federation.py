"""Federated aggregation and streaming."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.catalog.common import CONFIG, holdout_flows, once, q6, query, r6_all, table, train_flows
from flowloom.functions.scalar import client_base
from flowloom.operators import federated as fed
from flowloom.operators import reconstruct as rec
from flowloom.operators.features import fit_encoder
from flowloom.operators.split import leave_one_out
from flowloom.operators.windows import aligned_prefix_index, row_windows
from flowloom.plans import federated as plan
from flowloom.plans import training
from flowloom.sources.flows import DST, SRC, FeatureSpec
from flowloom.stage import materialize, shared_dir
from flowloom.streaming.score_stream import score_batch, start_scoring

# Vectors as updates: a client per vector, a round per label, a parameter per entry.
UPDATES_SQL = """updates AS (SELECT label AS round, CAST(vec_id AS VARCHAR) AS client,
    unnest([CASE WHEN i < 16 THEN 'encoder.batch_norm.weight' WHEN i < 32 THEN 'encoder.conv1.lin' WHEN i < 63 THEN 'decoder.fc.weight'
      ELSE 'encoder.batch_norm.num_batches_tracked' END FOR i IN range(64)]) AS key,
    CAST(unnest(range(64)) AS INTEGER) AS pos, CAST(unnest(embedding) AS DOUBLE) AS value, CAST(vec_id % 7 + 1 AS INTEGER) AS weight FROM embeddings)"""


def updates(spark, sf):
    rows = table(spark, sf, "embeddings")
    i = F.col("pos")
    key = (
        F.when(i < 16, "encoder.batch_norm.weight").when(i < 32, "encoder.conv1.lin").when(i < 63, "decoder.fc.weight")
        .otherwise("encoder.batch_norm.num_batches_tracked")
    )
    long = rows.select(
        F.col("label").alias("round"), F.col("vec_id").cast("string").alias("client"),
        F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "value"),
        (F.col("vec_id") % 7 + 1).cast("int").alias("weight"),
    )
    return long.withColumn("key", key)


BASE_SQL = "base AS (SELECT round, key, pos, avg(value) AS value FROM updates GROUP BY round, key, pos)"


def _base(spark, sf):
    return materialize(fed.fed_average(updates(spark, sf)), "base")


@query(
    "fed_average",
    f"""WITH {UPDATES_SQL} SELECT 'equal' AS weighting, round, key, pos, {q6('avg(value)')} AS value FROM updates GROUP BY round, key, pos
    UNION ALL SELECT 'examples', round, key, pos, {q6('sum(weight * value) / sum(weight)')} FROM updates GROUP BY round, key, pos""",
)
def fed_average(spark, sf):
    rows = updates(spark, sf)
    both = [fed.fed_average(rows, w).withColumn("weighting", F.lit(w)) for w in ("equal", "examples")]
    return r6_all(both[0].unionByName(both[1]), ["value"]).select("weighting", "round", "key", "pos", "value")


NORMS_SQL = """norms AS (SELECT u.round, client, sqrt(sum((u.value - b.value) * (u.value - b.value))) AS norm
  FROM updates u JOIN base b ON u.round = b.round AND u.key = b.key AND u.pos = b.pos GROUP BY u.round, client)"""


@query("update_norms", f"WITH {UPDATES_SQL}, {BASE_SQL}, {NORMS_SQL} SELECT round, client, {q6('norm')} AS norm FROM norms")
def update_norms(spark, sf):
    return r6_all(fed.update_norms(updates(spark, sf), _base(spark, sf)), ["norm"])


@query(
    "clip_mean",
    f"""WITH {UPDATES_SQL}, {BASE_SQL}, {NORMS_SQL}
    SELECT u.round, u.key, u.pos, {q6('max(b.value) + avg((u.value - b.value) * least(1.0, 0.9 / norm))')} AS value
    FROM updates u JOIN base b ON u.round = b.round AND u.key = b.key AND u.pos = b.pos
    JOIN norms n ON u.round = n.round AND u.client = n.client GROUP BY u.round, u.key, u.pos""",
)
def clip_mean(spark, sf):
    out = fed.clip_and_noise(updates(spark, sf), _base(spark, sf), clip=0.9, sigma=0.0)
    return r6_all(out, ["value"]).select("round", "key", "pos", "value")


def _uniform_sql(salt: int) -> str:
    return f"(CAST(('0x' || substr(md5('7|{salt}|' || u.round || '|' || u.key || '|' || u.pos), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0"


@query(
    "clip_and_noise",
    f"""WITH {UPDATES_SQL}, {BASE_SQL}, {NORMS_SQL}
    SELECT u.round, u.key, u.pos, {q6(f"""max(b.value) + avg((u.value - b.value) * least(1.0, 0.9 / norm))
      + max(sqrt(-2.0 * ln({_uniform_sql(1)})) * cos({_uniform_sql(2)} * 6.283185307179586)) * 0.45 / count(*)""")} AS value
    FROM updates u JOIN base b ON u.round = b.round AND u.key = b.key AND u.pos = b.pos
    JOIN norms n ON u.round = n.round AND u.client = n.client GROUP BY u.round, u.key, u.pos""",
)
def clip_and_noise(spark, sf):
    out = fed.clip_and_noise(updates(spark, sf), _base(spark, sf), clip=0.9, sigma=0.5, seed=7)
    return r6_all(out, ["value"]).select("round", "key", "pos", "value")


KEEP = {
    "na": "NOT ends_with(key, 'num_batches_tracked')",
    "fedbn": "NOT ends_with(key, 'num_batches_tracked') AND NOT starts_with(key, 'encoder.batch_norm.')",
    "fedrep": "NOT ends_with(key, 'num_batches_tracked') AND starts_with(key, 'encoder.')",
}


@query(
    "keys_exchanged",
    f"WITH {UPDATES_SQL} "
    + " UNION ALL ".join(f"SELECT '{m}' AS mode, key, count(*) AS n FROM updates WHERE {c} GROUP BY key" for m, c in KEEP.items()),
)
def keys_exchanged(spark, sf):
    return _by_mode(updates(spark, sf), fed.keys_exchanged)


@query(
    "keys_private",
    f"WITH {UPDATES_SQL} "
    + " UNION ALL ".join(f"SELECT '{m}' AS mode, key, count(*) AS n FROM updates WHERE NOT ({c}) GROUP BY key" for m, c in KEEP.items()),
)
def keys_private(spark, sf):
    return _by_mode(updates(spark, sf), fed.keys_private)


def _by_mode(rows, pick):
    parts = [pick(rows, m).groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("mode", F.lit(m)) for m in KEEP]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("mode", "key", "n")


@query(
    "merge_state",
    f"""WITH {UPDATES_SQL}, {BASE_SQL}, shared AS (SELECT c.client, b.key, b.pos, b.value FROM base b JOIN (SELECT DISTINCT round, client FROM updates) c ON b.round = c.round
      WHERE {KEEP['fedbn']}),
    private AS (SELECT client, key, pos, value FROM updates WHERE NOT ({KEEP['fedbn']}))
    SELECT coalesce(s.client, p.client) AS client, coalesce(s.key, p.key) AS key, coalesce(s.pos, p.pos) AS pos, {q6('coalesce(p.value, s.value)')} AS value
    FROM shared s FULL OUTER JOIN private p ON s.client = p.client AND s.key = p.key AND s.pos = p.pos""",
)
def merge_state(spark, sf):
    rows = updates(spark, sf)
    clients = rows.select("round", "client").distinct()
    shared = fed.keys_exchanged(_base(spark, sf), "fedbn").join(clients, "round").select("client", "key", "pos", "value")
    return r6_all(fed.merge_state(shared, fed.keys_private(rows, "fedbn")), ["value"])


@query(
    "silo_metrics",
    f"""WITH h AS (SELECT l_linenumber AS round, l_returnflag AS silo, avg(l_tax) AS val_mse, avg(l_discount) AS train_mse, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT round, {', '.join(f'''{q6(f"max({m}) FILTER (WHERE silo = '{s}')")} AS "{m}/{s}"''' for m in ('train_mse', 'val_mse') for s in 'ANR')},
      {q6('sum(val_mse * n) / sum(n)')} AS loss FROM h GROUP BY round""",
)
def silo_metrics(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("round"), F.col("l_returnflag").alias("silo"))
    history = rows.agg(
        F.avg("l_tax").alias("val_mse"), F.avg("l_discount").alias("train_mse"), F.count(F.lit(1)).alias("n_val_edges")
    )
    out = fed.silo_metrics(history, ["train_mse", "val_mse"], silos=["A", "N", "R"])
    return out.select("round", *[F.expr(f"CASE WHEN round(`{c}`, 6) = 0 THEN 0.0D ELSE round(`{c}`, 6) END").alias(c) for c in out.columns if c != "round"])


# Rounds over the flow silos ----------------------------------------------------------


@once
def _clients(spark, sf):
    return plan.prepare_clients(train_flows(spark, sf), CONFIG)


def _fit(spark, sf, cfg: plan.FederatedConfig):
    ready = _clients(spark, sf)
    return ready, plan.federated_fit(ready.train_gram, ready.val_gram, ready.weights, CONFIG.context, cfg)


@query("federated_fit")
def federated_fit(spark, sf):
    _, result = _fit(spark, sf, plan.FederatedConfig(rounds=3, weighting="examples"))
    return result.parameters


@query("fed_prox")
def fed_prox(spark, sf):
    _, result = _fit(spark, sf, plan.FederatedConfig(rounds=2, mu=0.1))
    return result.norms


@query("fed_personalise")
def fed_personalise(spark, sf):
    """Own heads on a shared basis: history of every round."""
    _, result = _fit(spark, sf, plan.FederatedConfig(rounds=2, mode="fedrep"))
    return result.history


@query("round_history")
def round_history(spark, sf):
    _, result = _fit(spark, sf, plan.FederatedConfig(rounds=2, mode="fedbn", clip=5.0, sigma=0.001))
    return fed.silo_metrics(result.history, ["train_mse", "val_mse"])


@query("federated_eval")
def federated_eval(spark, sf):
    ready, result = _fit(spark, sf, plan.FederatedConfig(rounds=2, mode="fedbn"))
    coefficients = materialize(
        plan.federated_coefficients(result.parameters, result.private, ready.weights, CONFIG.context), "coefficients"
    )
    return _holdout_metrics(spark, sf, ready, coefficients)


@query("held_out_eval")
def held_out_eval(spark, sf):
    """Leave one out: every silo is scored once by rounds of the others, with its own normalisation."""
    ready = _clients(spark, sf)
    folds = leave_one_out(ready.weights.select(F.col("client").alias("silo")))
    parts = []
    for held_out in sorted(r[0] for r in folds.select("held_out").distinct().collect()):  # one run for each fold
        chosen = F.col("client") != held_out
        result = plan.federated_fit(
            ready.train_gram.filter(chosen), ready.val_gram.filter(chosen), ready.weights.filter(chosen),
            CONFIG.context, plan.FederatedConfig(rounds=2, mode="fedbn"),
        )
        coefficients = plan.held_out_coefficients(result.parameters, ready.val_gram.filter(~chosen), CONFIG.context)
        parts.append(_holdout_metrics(spark, sf, ready, materialize(coefficients, "coefficients")))
    return reduce(DataFrame.unionByName, parts)


SHARDS = 2


@query("federated_shards")
def federated_shards(spark, sf):
    """Every silo in two clients: their rounds, and every client on the holdout of its silo."""
    from flowloom.operators import evaluate as ev

    ready = plan.prepare_clients(train_flows(spark, sf), CONFIG, SHARDS)
    result = plan.federated_fit(ready.train_gram, ready.val_gram, ready.weights, CONFIG.context, plan.FederatedConfig(rounds=2, mode="fedbn"))
    coefficients = materialize(plan.federated_coefficients(result.parameters, result.private, ready.weights, CONFIG.context), "coefficients")
    edges = training.encoded_windows(holdout_flows(spark, sf), ready.encoder, CONFIG, shared=False)
    # every flow is scored by each client of its silo, as the evaluation asks for
    clients = ready.weights.select(F.col("client").alias("model"), client_base(F.col("client")).alias("silo"))
    edges = edges.drop("model").join(clients, "silo")
    # copies of a window for several clients are put together by an exchange
    scores = rec.score_flows(edges, coefficients, replace(CONFIG.context, rows=None))
    found = ev.metrics(scores.select(F.col("model").alias("client"), "score", "label"), ["client"])
    return found.join(ready.weights, "client")


def _holdout_metrics(spark, sf, ready, coefficients):
    from flowloom.operators import evaluate as ev

    edges = training.encoded_windows(holdout_flows(spark, sf), ready.encoder, CONFIG, shared=False)
    named = materialize(coefficients.select("model").distinct(), "models")
    known = training.in_place([named], CONFIG, lambda models: edges.join(models, "model", "left_semi"))
    return ev.metrics(rec.score_flows(known, coefficients, CONFIG.context).select("silo", "score", "label"), ["silo"])


# Streaming: the event table as a stream of flows from a user to an event type ------------

EVENT_SPEC = FeatureSpec(columns=("value",), log1p=("value",), derived={})
EVENT_CONFIG = replace(CONFIG, features=EVENT_SPEC, window=100, step=100)


def event_flows(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", "value", F.col("user_id").cast("string").alias(SRC), F.col("event_type").alias(DST)
    )


@once
def event_model(spark, sf):
    """Encoder and coefficients, fitted on windows of the event table."""
    from flowloom.operators.features import encode

    flows = aligned_prefix_index(event_flows(spark, sf).withColumn("silo", F.lit("events")), ["silo"], ["event_id"], EVENT_CONFIG.step, name="flow_id")
    encoder = materialize(fit_encoder(flows.withColumn("enc", F.lit("all")), EVENT_SPEC, ["enc"]), "encoder")
    windowed = row_windows(flows, EVENT_CONFIG.window, EVENT_CONFIG.step, pos="flow_id").withColumn("enc", F.lit("all"))
    edges = encode(windowed, F.broadcast(encoder), EVENT_SPEC, ["enc"]).withColumns({"model": F.lit("events"), "label": F.lit(0)})
    gram = rec.gram_sums(edges, EVENT_CONFIG.context, "model")
    coefficients = materialize(rec.fit_reconstruction(gram, EVENT_CONFIG.context), "coefficients")
    return encoder, rec.model_matrix(coefficients, "events")


@query("stream_score")
def stream_score(spark, sf):
    """The event table in four files, each one micro-batch and one graph; output as a batch table."""
    import uuid

    encoder, model = event_model(spark, sf)
    source = materialize(event_flows(spark, sf).repartitionByRange(4, "event_id").sortWithinPartitions("event_id"), "stream")
    path = source.inputFiles()[0].rsplit("/", 1)[0]
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(path)
    root = f"{shared_dir(spark)}/scored-{uuid.uuid4().hex}"

    def score(batch, keep):
        return score_batch(batch, encoder, model, EVENT_SPEC, EVENT_CONFIG.dim, "event_id", keep)

    start_scoring(stream, score, f"{root}/out", f"{root}/progress").awaitTermination()
    return spark.read.parquet(f"{root}/out")
