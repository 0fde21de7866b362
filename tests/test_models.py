"""Graph and model operators against direct NumPy computations."""

from functools import partial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowloom.catalog import common as C
from flowloom.catalog import federation
from flowloom.functions.scalar import projection
from flowloom.operators import context, federated as fed
from flowloom.operators import reconstruct as rec
from flowloom.operators import wholegraph
from flowloom.operators.features import encode
from flowloom.operators.context import ContextSpec
from flowloom.plans import federated as plan
from flowloom.plans import training
from flowloom.sources.flows import DST, SRC

GROUP = ("silo", "window_id")


def random_edges(n=40, hosts=12, width=3, windows=3, seed=1):
    rng = np.random.RandomState(seed)
    rows = []
    for w in range(windows):
        for i in range(n):
            a, b = rng.randint(0, hosts, 2)
            rows.append(("s", w, i, w * n + i, 0, width, f"10.{a}.{a % 5}.{a}", f"10.{b}.{b % 5}.{b}", [float(v) for v in rng.randn(width)]))
    cols = ["silo", "window_id", "pos_in_window", "flow_id", "label", "n_features", SRC, DST, "features"]
    return pd.DataFrame(rows, columns=cols)


SCHEMA = (
    f"silo string, window_id long, pos_in_window int, flow_id long, label int, n_features int, {SRC} string, {DST} string, features array<double>"
)


def matrix_embeddings(src, dst, ips, dim, hops=3):
    """Powers of the row-normalised adjacency, the direct form."""
    a = np.zeros((len(ips), len(ips)))
    np.add.at(a, (src, dst), 1.0)
    degree = a.sum(1, keepdims=True)
    p = np.divide(a, degree, out=np.zeros_like(a), where=degree > 0)
    octets = np.array([[int(o) / 255 for o in ip.split(".")] for ip in ips])
    e0 = octets if dim == 4 else octets @ projection(dim)

    def unit(v):
        length = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.where(length < 1e-9, 1.0, length)

    e0 = unit(e0)
    parts = [e0]
    for d in range(1, hops + 1):
        r = np.linalg.matrix_power(p, d) @ e0
        for i in range(1, d):
            r = r - np.linalg.matrix_power(p, d - i) @ parts[i]
        parts.append(unit(r) / (d + 1))
    return sum(parts)


@pytest.mark.parametrize("dim", [4, 8])
def test_embeddings_equal_matrix_form(spark, dim):
    pdf = random_edges()
    spec = ContextSpec(GROUP, 3, dim)
    got = context.node_embeddings(spark.createDataFrame(pdf, SCHEMA).orderBy(F.rand(2)), spec).toPandas()
    for w, part in pdf.groupby("window_id"):
        ips = list(dict.fromkeys([*part[SRC], *part[DST]]))
        index = {ip: i for i, ip in enumerate(ips)}
        want = matrix_embeddings(part[SRC].map(index), part[DST].map(index), ips, dim)
        mine = got[got.window_id == w].sort_values("node_id")
        assert list(mine.ip) == ips
        np.testing.assert_allclose(np.vstack(mine.embedding), want, atol=1e-9)


@pytest.mark.parametrize("hub_rows", [wholegraph.HUB_ROWS, 3])
def test_frame_as_one_graph_equals_window(spark, monkeypatch, hub_rows):
    """Also when hosts with more than a few edges are split."""
    monkeypatch.setattr(wholegraph, "find_hubs", partial(wholegraph.find_hubs, least=hub_rows))
    pdf = random_edges(windows=1)
    edges = spark.createDataFrame(pdf, SCHEMA)
    spec = ContextSpec(("window_id",), 3, 8)
    a = context.endpoint_context(edges, spec).toPandas().sort_values("flow_id")
    b = wholegraph.single_graph(edges, spec).toPandas().sort_values("flow_id")
    np.testing.assert_allclose(np.vstack(a.predictors), np.vstack(b.predictors), atol=1e-9)
    hubs = wholegraph.find_hubs(edges, ["window_id"], len(pdf))
    assert (hubs.table is None) == (hub_rows > len(pdf))
    if hubs.table is not None:
        assert hubs.table.filter("parts > 1").count() > 0
    coef = np.random.default_rng(4).normal(size=(spec.size, 3))
    want = ((np.vstack(a.predictors) @ coef - np.vstack(a.features)) ** 2).sum(1) / a.n_features
    scored = wholegraph.score_frame(edges, coef, spec, hubs).toPandas().sort_values("flow_id")
    np.testing.assert_allclose(scored.score, want, atol=1e-9)


def test_a_split_window_is_an_error(spark):
    """Flows that are said to lie window by window and do not are refused, wherever the cut is."""
    pdf = random_edges(windows=2)
    spec = ContextSpec(GROUP, 3, 4, rows=len(pdf) // 2)
    whole = spark.createDataFrame(pdf.sort_values(["window_id", "pos_in_window"]), SCHEMA).coalesce(1)
    assert context.graph_windows(whole, spec).count() == len(pdf)
    with pytest.raises(Exception, match="a window has not"):
        context.graph_windows(whole.repartition(3, "flow_id"), spec).count()


def test_more_models_than_are_sent_are_joined(spark):
    pdf = random_edges(windows=4)
    spec = ContextSpec(("model", *GROUP), 3, 4)
    edges = spark.createDataFrame(pdf, SCHEMA).withColumn("model", F.concat(F.lit("m"), F.col("window_id").cast("string")))
    rng = np.random.default_rng(5)
    rows = [(f"m{w}", i, rng.normal(size=3).tolist()) for w in range(3) for i in range(spec.size)]
    models = spark.createDataFrame(rows, rec.COEFFICIENTS)
    a, b = (rec.score_flows(edges, models, spec, most=most).toPandas().sort_values("flow_id").score for most in (1 << 20, 8))
    np.testing.assert_allclose(a, b, atol=1e-12)
    assert 0 < a.isna().sum() < len(a)


def test_aligned_index_of_a_dominant_silo_is_spread(spark):
    from flowloom.operators.windows import aligned_index

    rows = spark.range(60_000).select(F.when(F.col("id") % 10 < 9, "big").otherwise("small").alias("silo"), F.col("id").alias("at"))
    indexed = rows.withColumn("row_pos", F.row_number().over(Window.partitionBy("silo").orderBy("at")) - 1)
    got = aligned_index(indexed, 100, ["silo"]).withColumn("task", F.spark_partition_id())
    windows = got.groupBy("silo", F.expr("row_pos div 100").alias("w")).agg(F.countDistinct("task").alias("tasks"))
    assert windows.filter("tasks > 1").count() == 0
    sizes = [r["count"] for r in got.groupBy("task").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 60_000 / 2


def test_predictors_do_not_see_their_own_flow(spark):
    pdf = random_edges(windows=1)
    changed = pdf.copy()
    changed.at[7, "features"] = [100.0, -50.0, 7.0]
    spec = ContextSpec(GROUP, 3, 4)
    x = [context.endpoint_context(spark.createDataFrame(p, SCHEMA), spec).toPandas().set_index("flow_id").predictors for p in (pdf, changed)]
    np.testing.assert_allclose(x[0][7], x[1][7], atol=1e-12)
    assert not np.allclose(x[0][8], x[1][8])


def test_sums_fit_and_scores(spark):
    pdf = random_edges(windows=5)
    spec = ContextSpec(("model", *GROUP), 3, 4)
    edges = spark.createDataFrame(pdf, SCHEMA).withColumn("model", F.col("silo")).repartition(5)
    rows = context.endpoint_context(edges, spec).toPandas().sort_values("flow_id")
    x, y = np.vstack(rows.predictors), np.vstack(rows.features)
    gram = rec.gram_sums(edges, spec, "model").toPandas()
    both = np.hstack((x, y))
    np.testing.assert_allclose(rec.gram_matrix(gram), both.T @ both, atol=1e-8)
    coefficients = rec.fit_reconstruction(spark.createDataFrame(gram), spec, penalty=1e-6)
    coef = rec.model_matrix(coefficients, "s")
    want = ((x @ coef - y) ** 2).mean(1)
    scores = rec.score_flows(edges, coefficients, spec).toPandas().sort_values("flow_id").score
    np.testing.assert_allclose(scores, want, atol=1e-9)
    other = edges.withColumn("model", F.lit("unknown"))
    assert rec.score_flows(other, coefficients, spec).filter(F.isnan("score")).count() == len(pdf)
    assert want.mean() <= ((y - y.mean(0)) ** 2).mean() + 1e-9
    assert rec.squared_error(rec.gram_matrix(gram), coef) == pytest.approx(want.mean())


@pytest.fixture(scope="module")
def gram(spark, sf):
    return federation._clients(spark, sf).train_gram.withColumnRenamed("client", "model")


SPEC = C.CONFIG.context


def _models(df):
    rows = df.toPandas().sort_values("i")
    return {name: np.vstack(part["coef"].to_list()) for name, part in rows.groupby("model")}


def test_full_basis_is_no_restriction(gram):
    own = _models(rec.fit_reconstruction(gram, SPEC, penalty=1e-9))
    shared = _models(rec.fit_personalised(gram, SPEC, rank=SPEC.size, penalty=1e-9))
    matrices = {k: rec.gram_matrix(p) for k, p in gram.toPandas().groupby("model")}
    for silo, coef in own.items():
        assert rec.squared_error(matrices[silo], shared[silo]) == pytest.approx(rec.squared_error(matrices[silo], coef), abs=1e-6)


def test_adapted_models_fit_their_silo_no_worse(gram):
    combined = _models(rec.fit_combined(gram, SPEC))["combined"]
    tuned = _models(rec.fit_adapted(gram, SPEC, "fedbn"))
    for silo, part in gram.toPandas().groupby("model"):
        g = rec.gram_matrix(part)
        assert rec.squared_error(g, tuned[silo]) <= rec.squared_error(g, combined) + 1e-12


def test_renormalised_prediction():
    rng = np.random.RandomState(0)
    x = np.hstack((np.ones((50, 1)), rng.randn(50, 3) * 2 + 5))
    coef, base = rng.randn(4, 2), (np.array([1.0, 2.0, 3.0]), np.array([0.5, 1.0, 2.0]))
    own = (x[:, 1:].mean(0), x[:, 1:].std(0))
    moved = np.hstack((np.ones((50, 1)), (x[:, 1:] - own[0]) / own[1] * base[1] + base[0]))
    np.testing.assert_allclose(x @ rec.renormalised(coef, own, base), moved @ coef, atol=1e-9)


def _rounds(ready, **settings):
    cfg = plan.FederatedConfig(**settings)
    return plan.federated_fit(ready.train_gram, ready.val_gram, ready.weights, SPEC, cfg)


def test_rounds_depend_on_the_incoming_model(spark, sf):
    ready = federation._clients(spark, sf)
    losses = _rounds(ready, rounds=3).history.groupBy("round").agg(F.avg("train_mse").alias("x")).orderBy("round").collect()
    assert losses[0].x > losses[1].x + 1e-6 > losses[2].x + 2e-6


def test_no_step_leaves_the_model(spark, sf):
    ready = federation._clients(spark, sf)
    got = plan.shared_values(_rounds(ready, rounds=2, local_steps=0).parameters)
    start = plan.initial_parameters(SPEC, plan.FederatedConfig())
    assert all(np.allclose(got[k], np.ravel(v)) for k, v in start.items())


def test_equal_clients_reach_the_pooled_fit(spark, sf):
    """Three clients with the same sums: many rounds end at the ridge solution of these sums."""
    ready = federation._clients(spark, sf)
    one = ready.train_gram.filter("client = 'A'").drop("penalty")
    same = [one.withColumn("client", F.lit(c)) for c in "xyz"]
    grams = same[0].unionByName(same[1]).unionByName(same[2])
    weights = spark.createDataFrame([(c, 1) for c in "xyz"], "client string, weight long")
    cfg = plan.FederatedConfig(rounds=3, local_steps=20_000, penalty=0.1)
    got = plan.shared_values(plan.federated_fit(grams, grams, weights, SPEC, cfg).parameters)[plan.COEF]
    g = rec.gram_matrix(one.toPandas())
    own = rec._in_basis(g, plan._standardiser(*rec.predictor_moments(g, SPEC.size)), SPEC.size)
    np.testing.assert_allclose(got.reshape(SPEC.size, -1), rec.ridge(own, SPEC.size, 0.1), atol=1e-4)


def test_strong_pull_stays_near_the_global_parameters(spark, sf):
    ready = federation._clients(spark, sf)

    def norm(mu):
        return _rounds(ready, rounds=1, mu=mu, mode="fedbn").norms.agg(F.max("norm")).first()[0]

    assert norm(1e6) < 1e-3 < norm(0.0)


@pytest.mark.parametrize("mode", ["na", "fedbn", "fedrep"])
@pytest.mark.parametrize("kept", [3, 6])
def test_few_windows_do_not_give_the_target_away(spark, sf, mode, kept):
    """With 3 or 6 training windows a client, no model is much worse than the mean on validation windows."""
    flows = C.train_flows(spark, sf).filter(F.col("flow_id") < 200 * (kept + 2)).withColumn("n_rows", F.least("n_rows", F.lit(200 * (kept + 2)).cast("long")))
    ready = plan.prepare_clients(flows, C.CONFIG)
    result = _rounds(ready, rounds=3, mode=mode)
    for client, rows in ready.val_gram.toPandas().groupby("client"):
        g = rec.gram_matrix(rows)
        size, n = SPEC.size, g[0, 0]
        variance = float((np.diag(g)[size:] / n - (g[0, size:] / n) ** 2).mean())
        last = result.history.filter((F.col("round") == 3) & (F.col("silo") == client)).first().val_mse
        assert last <= 1.2 * variance, client


@pytest.mark.parametrize("settings", [{"mode": "fedbn"}, {"mode": "na", "clip": 5.0, "sigma": 0.01}])
def test_a_resumed_run_equals_an_unbroken_one(spark, sf, tmp_path, settings):
    """Stopped after round 2 and started again: the same parameters, private parts, norms and history."""
    ready = federation._clients(spark, sf)

    def run(rounds, log=None, **more):
        cfg = plan.FederatedConfig(rounds=rounds, **(settings | more))
        return plan.federated_fit(ready.train_gram, ready.val_gram, ready.weights, SPEC, cfg, log)

    def rows(df):
        return None if df is None else sorted(map(tuple, df.collect()), key=str)

    log = str(tmp_path / "log")
    run(2, log)
    (tmp_path / "log" / "round=000003").mkdir()  # a round that was broken off
    resumed, whole = run(3, log), run(3)
    for part in ("parameters", "private", "norms", "history"):
        a, b = rows(getattr(resumed, part)), rows(getattr(whole, part))
        assert a == b if a is None else all(x == pytest.approx(y, rel=1e-9) if isinstance(x, float) else x == y for p, q in zip(a, b, strict=True) for x, y in zip(p, q, strict=True))
    with pytest.raises(ValueError, match="other settings"):
        run(4, log, mu=1.0)


def test_a_parameter_without_a_base_is_an_error(spark):
    updates = spark.createDataFrame([(1, "c", "k", 0, 1.0), (1, "c", "k", 1, 1.0)], "round int, client string, key string, pos int, value double")
    with pytest.raises(Exception, match="no base value"):
        fed.update_norms(updates, updates.filter("pos = 0")).collect()


def test_private_parameters_stay_out_of_the_average(spark, sf):
    ready = federation._clients(spark, sf)
    result = _rounds(ready, rounds=1, mode="fedrep")
    assert {r[0] for r in result.private.select("key").distinct().collect()} == {plan.HEAD}
    assert fed.keys_private(result.private, "fedrep").count() == result.private.count()


def test_split_sizes(spark, sf):
    windows = C.QUERIES["train_val_split"](spark, sf).groupBy("silo").pivot("part").count().collect()
    for r in windows:
        assert r.train == int((r.train + r.val) * 0.8)


def test_overlap_scores_every_window(spark, sf):
    model = training.fit(C.train_flows(spark, sf), C.CONFIG, "combined")
    scores = training.score_holdout(C.holdout_flows(spark, sf), model)
    assert scores.filter(F.col("score").isNull()).count() == 0
    assert scores.groupBy("silo", "window_id").count().filter("count <> 200").count() == 0


def test_stream_equals_batch(spark, sf):
    """Each micro-batch scores like one window of a batch job."""
    out = C.QUERIES["stream_score"](spark, sf)
    encoder, coef = federation.event_model(spark, sf)
    assert out.count() == C.table(spark, sf, "events").count()
    rows = out.filter("batch_id = 2").select("event_id", "value", SRC, DST, "probability_anomalous").toPandas()
    keyed = spark.createDataFrame(rows).withColumns({"enc": F.lit("all"), "model": F.lit("m"), "label": F.lit(0), "window_id": F.lit(2).cast("bigint")})
    edges = encode(keyed, encoder, federation.EVENT_SPEC, ["enc"])
    edges = edges.withColumns({"flow_id": F.col("event_id"), "pos_in_window": F.row_number().over(Window.orderBy("event_id")) - 1})
    spec = context.ContextSpec(("model", "window_id"), federation.EVENT_SPEC.width, 4)
    models = spark.createDataFrame([("m", k, r.tolist()) for k, r in enumerate(coef)], rec.COEFFICIENTS)
    got = rec.score_flows(edges, models, spec).toPandas().sort_values("flow_id").score
    np.testing.assert_allclose(got, rows.sort_values("event_id").probability_anomalous, atol=1e-9)


def test_all_modes_from_two_looks_at_the_flows(spark, sf, monkeypatch):
    """Eight modes compute the sums twice, once per kind of encoder, and no two modes are the same model."""
    calls = []
    sums = rec.gram_sums
    monkeypatch.setattr(training.reconstruct, "gram_sums", lambda *a: calls.append(a) or sums(*a))
    models = training.fit_all(C.train_flows(spark, sf), C.CONFIG)
    assert len(models) == len(training.MODES) == 8 and len(calls) == 2
    found = {mode: _models(m.coefficients) for mode, m in models.items()}
    names = [m for m in found if m not in ("per_silo", "combined")]
    for k, a in enumerate(names):
        for b in names[k + 1 :]:
            assert max(np.abs(found[a][s] - found[b][s]).max() for s in found[a]) > 1e-6, (a, b)


def test_joint_basis_fits_no_worse_than_its_start(gram):
    start = _models(rec.fit_personalised(gram, SPEC, rank=6, rounds=0))
    joint = _models(rec.fit_personalised(gram, SPEC, rank=6, rounds=5))
    parts = {k: rec.gram_matrix(p) for k, p in gram.toPandas().groupby("model")}
    total = [sum(rec.squared_error(parts[s], m[s]) for s in parts) for m in (start, joint)]
    assert total[1] < total[0]


def test_shards_are_clients(spark, sf):
    """Shards split the windows of their silo and add up to its sums."""
    one = plan.prepare_clients(C.train_flows(spark, sf), C.CONFIG)
    two = plan.prepare_clients(C.train_flows(spark, sf), C.CONFIG, 2)
    weights = {r.client: r.weight for r in two.weights.collect()}
    assert sorted(weights) == [f"{s}#{k}" for s in "ANR" for k in (0, 1)]
    for r in one.weights.collect():
        assert weights[f"{r.client}#0"] + weights[f"{r.client}#1"] == r.weight
    whole = {(r.client, r.i, r.j): r.value for r in one.train_gram.collect()}
    parts = two.train_gram.groupBy(F.substring("client", 1, 1).alias("c"), "i", "j").agg(F.sum("value").alias("v")).collect()
    assert len(parts) == len(whole)
    assert all(r.v == pytest.approx(whole[r.c, r.i, r.j], rel=1e-9, abs=1e-9) for r in parts)


def test_shards_by_cuts_equal_the_listed_shards(spark, sf):
    from flowloom.operators.split import iid_shards, shard_cuts, shard_flows
    from flowloom.operators.windows import window_list

    sizes = C.train_flows(spark, sf).groupBy("silo").agg(F.max("n_rows").alias("n_rows"))
    windows = window_list(sizes, ["silo"], 100, 100)
    want = {(r.silo, r.window_id): r.shard for r in iid_shards(windows, ["silo"], 3).collect()}
    got = {(r.silo, r.window_id): r.shard for r in shard_flows(windows, shard_cuts(windows, ["silo"], 3), ["silo"]).collect()}
    assert got == want
