"""Small cases with known answers."""

import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from flowloom.functions import scalar as S
from flowloom.operators import combine, evaluate, federated, features, graph, reports
from flowloom.operators.prefix import prefix_index, prefix_sums
from flowloom.operators.windows import row_windows
from flowloom.sources.flows import DST, SRC, FeatureSpec, read_head, resolve_columns, resolve_log1p


def numbered(spark, n):
    return spark.range(n).select(F.lit("s").alias("silo"), F.col("id").alias("row_pos"), F.lit(n).cast("bigint").alias("n_rows"))


@pytest.mark.parametrize(
    "n, size, step, starts",
    [(4, 5, 5, []), (5, 5, 5, [0]), (10, 4, 3, [0, 3, 6]), (10, 2, 4, [0, 4, 8]), (9, 3, 3, [0, 3, 6]), (10, 10, 1, [0])],
)
def test_row_windows(spark, n, size, step, starts):
    rows = row_windows(numbered(spark, n), size, step).collect()
    got = {}
    for r in rows:
        got.setdefault(r.window_id, []).append((r.pos_in_window, r.row_pos))
    assert sorted(got) == list(range(len(starts)))
    for w, s in enumerate(starts):
        assert sorted(got[w]) == [(i, s + i) for i in range(size)]


def test_row_windows_refuse_bad_sizes(spark):
    with pytest.raises(ValueError):
        row_windows(numbered(spark, 3), 0, 1)


def test_prefix_index_and_duplicates(spark):
    rows = spark.createDataFrame([("a", 3), ("b", 1), ("a", 1), ("a", 2), (None, 7), (None, 5)], "k string, o int")
    got = {(r.k, r.o): (r.row_pos, r.n_rows) for r in prefix_index(rows, ["k"], ["o"]).collect()}
    assert got == {("a", 1): (0, 3), ("a", 2): (1, 3), ("a", 3): (2, 3), ("b", 1): (0, 1), (None, 5): (0, 2), (None, 7): (1, 2)}
    with pytest.raises(PySparkException):
        prefix_index(rows.union(rows), ["k"], ["o"]).collect()


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_prefix_does_not_depend_on_partitions(spark, partitions):
    rows = spark.range(500).select((F.col("id") % 3).alias("k"), F.xxhash64("id").alias("o"), F.col("id").alias("v"))
    want = {}
    for r in sorted(rows.collect(), key=lambda r: (r.k, -r.o)):
        want[(r.k, r.o)] = want.get(("sum", r.k), 0) + r.v
        want[("sum", r.k)] = want[(r.k, r.o)]
    got = prefix_sums(rows, ["k"], ["-o"], {"upto": "v"}, {"all": "v"}, partitions=partitions).collect()
    assert len(got) == 500
    assert all(r.upto == want[(r.k, r.o)] and r.all == want[("sum", r.k)] for r in got)
    mixed = rows.orderBy(F.rand(3))
    index = {(r.k, r.o): r.row_pos for r in prefix_index(mixed, ["k"], ["o"], partitions=partitions).collect()}
    for k in range(3):
        values = sorted(o for kk, o in index if kk == k)
        assert [index[(k, o)] for o in values] == list(range(len(values)))


def test_head_keeps_file_order(spark):
    rows = spark.createDataFrame([("a", i) for i in range(10)], "silo string, o int").orderBy(F.rand(1))
    assert sorted(r.o for r in read_head(rows, ["silo"], ["o"], 4).collect()) == [0, 1, 2, 3]
    assert read_head(rows, ["silo"], ["o"], 0).count() == 10


def test_column_choices():
    assert resolve_columns("baseline")[0] == "PROTOCOL" and len(resolve_columns("all")) == 46
    assert resolve_columns(" a, b ,") == ["a", "b"]
    assert resolve_log1p("none", ["a"]) == [] and resolve_log1p("all", ["a"]) == ["a"]
    spec = FeatureSpec.resolve("MIN_TTL,PROTOCOL,TOTAL_PKTS", "baseline")
    assert spec.numeric == ["MIN_TTL", "TOTAL_PKTS"] and spec.width == 2 + 5
    assert spec.source_columns(["IN_PKTS", "OUT_PKTS", "MIN_TTL", "PROTOCOL", "X"]) == ["IN_PKTS", "OUT_PKTS", "MIN_TTL", "PROTOCOL"]


def test_ports_and_vocabularies(spark):
    ports = spark.createDataFrame([(p,) for p in (1023, 1024, 49151, 49152, 50000)], "p int")
    assert [r[0] for r in ports.select(S.port_bucket(F.col("p"))).collect()] == [0, 1, 1, 2, 2]
    vocab = F.array(F.lit(1024), F.lit(50000))
    # an ephemeral port is ephemeral even if it is listed
    assert [r[0] for r in ports.select(S.port_code(F.col("p"), vocab)).collect()] == [2, 0, 2, 3, 3]
    padded = ports.limit(1).select(features.pad_vocab(F.array(F.lit(7)), 3), features.pad_vocab(F.array(F.lit(7)), 1)).first()
    assert list(padded[0]) == [7, -1, -2] and list(padded[1]) == [7]
    hot = ports.limit(1).select(S.one_hot_array(F.lit(1), F.lit(3))).first()[0]
    assert list(hot) == [0.0, 1.0, 0.0]


def test_octets(spark):
    texts = ["", "1.2", "1.2.3.4.5", "a.2.3.4", "999.0.0.1", "99999999999.1.1.1"]
    rows = spark.createDataFrame([(t,) for t in texts], "ip string").select(F.array(*S.ip_octets(F.col("ip"))))
    got = [[round(v * 255, 6) for v in r[0]] for r in rows.collect()]
    assert got == [[0, 0, 0, 0], [1, 2, 0, 0], [1, 2, 3, 4], [0, 2, 3, 4], [999, 0, 0, 1], [0, 1, 1, 1]]


def test_log1p_keeps_null_and_nan(spark):
    rows = spark.createDataFrame([(-5.0,), (0.0,), (math.e - 1,), (None,), (float("nan"),)], "x double")
    a, b, c, d, e = [r[0] for r in rows.select(S.log1p_clip(F.col("x"))).collect()]
    assert (a, b) == (0.0, 0.0) and abs(c - 1) < 1e-12 and d is None and math.isnan(e)


def test_scaler_of_constants(spark):
    rows = spark.createDataFrame([("one", 5.0), ("two", 3.0), ("two", 3.0)], "silo string, x double")
    spec = FeatureSpec(columns=("x",), log1p=(), derived={})
    state = {r.silo: (r["mean"], r.scale) for r in features.fit_scaler(rows, spec, ["silo"]).collect()}
    assert state == {"one": (5.0, 1.0), "two": (3.0, 1.0)}


def test_vocab_ties(spark):
    rows = spark.createDataFrame([("s", p) for p in (9, 9, 4, 4, 7, 60000, 60000, 60000)], "silo string, L4_DST_PORT int")
    spec = FeatureSpec(columns=("L4_DST_PORT",), log1p=(), top_ports=2)
    got = [(r.slot, r.value) for r in features.fit_vocab(rows, spec, ["silo"]).orderBy("slot").collect()]
    assert got == [(0, 4), (1, 9)]


def window_edges(spark, pairs):
    rows = [("s", 0, i, i, a, b) for i, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, f"silo string, window_id long, pos_in_window int, flow_id long, {SRC} string, {DST} string")


def test_degrees_and_one_hop(spark):
    edges = window_edges(spark, [("1.0.0.0", "2.0.0.0"), ("1.0.0.0", "2.0.0.0"), ("2.0.0.0", "0.3.0.0"), ("0.0.9.0", "0.0.9.0")])
    degree = {r.ip: (r.node_id, r.out_degree) for r in graph.out_degree(edges, ["silo", "window_id"]).collect()}
    assert degree == {"1.0.0.0": (0, 2), "2.0.0.0": (1, 1), "0.0.9.0": (2, 1), "0.3.0.0": (3, 0)}
    hop = {r.ip: list(r.vector) for r in graph.propagate(edges, ["silo", "window_id"]).collect()}
    assert hop == {"1.0.0.0": [1, 0, 0, 0], "2.0.0.0": [0, 1, 0, 0], "0.0.9.0": [0, 0, 1, 0], "0.3.0.0": [0, 0, 0, 0]}


def scored(spark, scores, labels, silo="s"):
    rows = [(silo, float(s), l) for s, l in zip(scores, labels)]
    return spark.createDataFrame(rows, "silo string, score double, label int")


def test_areas(spark):
    m = evaluate.metrics(scored(spark, [0.1, 0.4, 0.35, 0.8], [0, 0, 1, 1]), ["silo"]).first()
    assert abs(m.auc_roc - 0.75) < 1e-12 and abs(m.pr_auc - 0.8333333333) < 1e-9
    # equal Youden values: the highest threshold
    assert m.threshold == 0.8 and (m.tp, m.fp, m.tn, m.fn) == (1, 0, 2, 1)


def test_equal_scores_and_missing_classes(spark):
    flat = scored(spark, [0.5] * 4, [0, 1, 0, 1])
    m = evaluate.metrics(flat, ["silo"]).first()
    assert m.auc_roc == 0.5 and m.threshold == float("inf") and m.tp == 0
    assert evaluate.roc_curve(flat, ["silo"]).count() == 2
    none = evaluate.metrics(scored(spark, [0.1, 0.2], [0, 0]), ["silo"]).first()
    assert none.auc_roc is None and none.precision == 0.0 and none.recall == 0.0 and none.tn == 2


def test_scrub(spark):
    bad = scored(spark, [float("nan"), float("inf"), float("-inf"), 2.0], [0] * 4)
    assert sorted(r.score for r in evaluate.scrub_scores(bad, ["silo"]).collect()) == [0.0, 2.0, 2.0, 2.0]
    only = evaluate.scrub_scores(scored(spark, [float("nan"), float("inf")], [0, 0]), ["silo"]).collect()
    assert [r.score for r in only] == [1.0, 1.0] and all(r.was_bad for r in only)


def test_quantiles(spark):
    rows = spark.range(10).select(F.lit("s").alias("silo"), F.col("id").cast("double").alias("score"))
    got = {r.quantile: r.threshold for r in evaluate.exact_quantiles(rows, ["silo"], "score", [0.9, 0.99, 0.0, 1.0]).collect()}
    assert got == pytest.approx({0.9: 8.1, 0.99: 8.91, 0.0: 0.0, 1.0: 9.0})
    hot = spark.range(1000).select(F.lit("s").alias("silo"), F.when(F.col("id") < 700, 1.0).otherwise(F.col("id")).alias("score"))
    exact = hot.select(F.expr("percentile(score, array(0.5, 0.7, 0.75))")).first()[0]
    got = {r.quantile: r.threshold for r in evaluate.exact_quantiles(hot, ["silo"], "score", [0.5, 0.7, 0.75]).collect()}
    assert [got[q] for q in (0.5, 0.7, 0.75)] == pytest.approx(list(exact))


def test_one_seed_has_no_deviation(spark):
    row = spark.createDataFrame([("s", 1, *[0.5] * 6)], ["silo", "seed", *reports.SEED_METRICS])
    out = reports.seed_summary(row).first()
    assert out.auc_roc_mean == 0.5 and out.auc_roc_std is None and out.n_seeds == 1


def test_best_epoch_stops(spark):
    rows = [("r", e, v) for e, v in enumerate([5.0, 3.0, 3.0, 4.0, 4.0, 1.0], start=1)]
    history = spark.createDataFrame(rows, "run string, epoch int, val_mse double")
    assert tuple(reports.best_epoch(history, ["run"], 2).first())[1:] == (2, 3.0, 4)
    assert tuple(reports.best_epoch(history, ["run"], 0).first())[1:] == (6, 1.0, 6)


def parameters(spark, rows):
    return spark.createDataFrame(rows, "round int, client string, key string, pos int, value double, weight int")


def test_federated_average(spark):
    u = parameters(spark, [(1, "a", "w", 0, 0.0, 1), (1, "b", "w", 0, 4.0, 3)])
    assert federated.fed_average(u).first().value == 2.0
    assert federated.fed_average(u, "examples").first().value == 3.0
    with pytest.raises(ValueError):
        federated.clip_and_noise(u, u, 1.0, weighting="examples")


def test_clipping(spark):
    u = parameters(spark, [(1, "a", "w", 0, 0.05, 1), (1, "b", "w", 0, 0.5, 1)])
    base = spark.createDataFrame([(1, "w", 0, 0.0)], "round int, key string, pos int, value double")
    norms = {r.client: r.norm for r in federated.update_norms(u, base).collect()}
    assert norms == pytest.approx({"a": 0.05, "b": 0.5})
    assert federated.clip_and_noise(u, base, 0.13).first().value == pytest.approx((0.05 + 0.13) / 2)
    assert federated.clip_and_noise(u, base, 1e9).first().value == pytest.approx(0.275)


def test_noise_moments_and_repeatability(spark):
    n = 20000
    u = spark.range(n).select(
        F.lit(1).alias("round"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("client"), F.lit("w").alias("key"),
        F.col("id").cast("int").alias("pos"), F.lit(0.0).alias("value"), F.lit(1).alias("weight"),
    )
    base = u.filter("client = 'a'").select("round", "key", "pos", "value")
    noisy = federated.clip_and_noise(u, base, clip=0.4, sigma=2.0, seed=5)
    mean, std = noisy.agg(F.avg("value"), F.stddev_pop("value")).first()
    assert abs(mean) < 0.02 and abs(std - 2.0 * 0.4 / 2) < 0.01
    again = federated.clip_and_noise(u.repartition(3), base.repartition(5), clip=0.4, sigma=2.0, seed=5)
    assert noisy.exceptAll(again).count() == 0


def test_pair_scores_take_the_first(spark):
    schema = "g int, s string, d string, p int"
    flows = spark.createDataFrame([(0, "a", "b", 0), (0, "a", "b", 1), (0, "b", "c", 2)], schema)
    scores = flows.filter("s = 'a'").withColumn("score", F.col("p") + 10.0)
    got = combine.combine_by_pair(flows, scores, ["g"], "s", "d", "p").orderBy("p").collect()
    assert [r.probability_anomalous for r in got] == [10.0, 10.0, None]


def test_flow_without_encoder_is_an_error(spark):
    spec = FeatureSpec(columns=("x",), log1p=(), derived={})
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "silo string, x double")
    encoder = features.fit_encoder(rows, spec, ["silo"])
    assert features.encode(rows, encoder, spec, ["silo"]).count() == 2
    with pytest.raises(PySparkException):
        features.encode(rows, encoder.filter("silo = 'a'"), spec, ["silo"]).collect()


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_next_row_over_partition_borders(spark, partitions):
    rows = spark.range(300).select((F.col("id") % 3).alias("k"), F.xxhash64("id").alias("o"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("v"))
    got = prefix_sums(rows, ["k"], ["-o"], {"upto": "v"}, partitions=partitions, following={"after": "v", "o_after": "o"}).collect()
    for k in range(3):
        group = sorted((r for r in got if r.k == k), key=lambda r: -r.o)
        assert [(r.after, r.o_after) for r in group[:-1]] == [(r.v, r.o) for r in group[1:]]
        assert (group[-1].after, group[-1].o_after) == (None, None)


def test_thin_curve_keeps_the_corners(spark):
    rng = random.Random(5)
    cases = {"mixed": [(float(rng.randint(0, 60)), int(rng.random() < 0.3)) for _ in range(400)], "flat": [(0.5, i % 2) for i in range(4)]}
    cases |= {"straight": [(float(i // 2), i % 2) for i in range(40)], "positive": [(float(i), 1) for i in range(5)]}
    rows = spark.createDataFrame([(name, s, label) for name, c in cases.items() for s, label in c], "silo string, score double, label int")
    got = {}
    for r in evaluate.roc_curve(rows, ["silo"], thin=True).collect():
        got.setdefault(r.silo, set()).add(r.threshold)
    for name, case in cases.items():
        points = [(float("inf"), 0, 0)]
        for score in sorted({s for s, _ in case}, reverse=True):
            points.append((score, sum(l for s, l in case if s >= score), sum(1 - l for s, l in case if s >= score)))
        turns = [b[0] for a, b, c in zip(points, points[1:], points[2:]) if (b[1] - a[1]) * (c[2] - b[2]) != (b[2] - a[2]) * (c[1] - b[1])]
        assert got[name] == {float("inf"), *turns, points[-1][0]}
    assert got["straight"] == {float("inf"), 0.0}


def test_counts_serve_like_scored_flows(spark):
    rng = random.Random(6)
    values = [float("nan"), float("inf"), float("-inf"), None, *[i / 7 for i in range(30)]]
    rows = [(silo, rng.choice(values if silo == "b" else values[4:]), int(rng.random() < 0.4)) for silo in "aab" for _ in range(100)]
    flows = spark.createDataFrame(rows, "silo string, score double, label int")
    twice = evaluate.scrub_scores(flows.unionByName(flows.withColumn("silo", F.lit(evaluate.POOLED))), ["silo"])
    counts = evaluate.score_counts(flows, ["silo"])
    counts = evaluate.scrub_scores(evaluate.pooled_counts(counts, ["silo"]), ["silo"])
    levels = spark.createDataFrame([(s, q, q * 4) for s in ("a", "b", evaluate.POOLED) for q in (0.1, 0.5, 0.9)], "silo string, quantile double, threshold double")

    def same(one, other):
        one, other = [df.orderBy(*[c for c in ("silo", "quantile") if c in df.columns]).collect() for df in (one, other)]
        assert len(one) == len(other) > 0
        for a, b in zip(one, other):
            assert all(x == y or abs(x - y) < 1e-12 for x, y in zip(a[1:], b[1:]))

    same(evaluate.metrics(twice, ["silo"]), evaluate.metrics(counts, ["silo"]))
    same(evaluate.confusion(twice, levels, ["silo"]), evaluate.confusion(counts, levels, ["silo"]))


@pytest.mark.parametrize("n, size, step", [(25, 6, 4), (24, 6, 4), (30, 5, 5), (30, 4, 6), (9, 10, 4), (31, 7, 3)])
def test_panes_equal_windows_with_a_row_per_flow(spark, n, size, step):
    flows = numbered(spark, n).withColumn("features", F.array(F.col("row_pos").cast("double"), F.sin("row_pos")))
    want = graph.window_mean(row_windows(flows, size, step), ["silo", "window_id"], 2).collect()
    got = {r.window_id: r for r in graph.pane_means(flows, ["silo"], size, step, 2, pos="row_pos").collect()}
    assert len(got) == len(want)
    for r in want:
        assert got[r.window_id].n_edges == r.n_edges and got[r.window_id].context == pytest.approx(r.context)


def test_shared_vector_gives_every_encoders_vector(spark):
    """Codes that one silo lists, filled slots, ephemeral and missing ports, a number far from zero."""
    import numpy as np

    from flowloom.operators import transfer

    rng = random.Random(7)
    spec = FeatureSpec(top_protocols=3, top_ports=3)
    names = list(dict.fromkeys([*spec.source_columns(["MIN_TTL", "PROTOCOL", "L4_SRC_PORT", "L4_DST_PORT", "IN_BYTES", "OUT_BYTES", "IN_PKTS", "OUT_PKTS", "FLOW_DURATION_MILLISECONDS"])]))
    draw = {"PROTOCOL": [6, 17, 1, 47], "L4_SRC_PORT": [80, 5000, 60000], "L4_DST_PORT": [22, 53, 80, 443, 8080, 50000, None]}
    rows = [(silo, *[rng.choice(draw[c][at:]) if c in draw else 1e6 + rng.randint(1, 9) for c in names]) for at, silo in enumerate("ab") for _ in range(60)]
    flows = spark.createDataFrame(rows, ", ".join(["silo string", *[f"{c} {'int' if c in draw else 'double'}" for c in names]]))
    flows = features.derive_totals(flows) if hasattr(features, "derive_totals") else flows
    encoder = features.fit_encoder(flows, spec, ["silo"]).withColumnRenamed("silo", "enc")
    encoders = encoder.collect()
    for group in (encoders, encoders[:1]):
        shared = transfer.SharedVector.of(group, spec)
        given = shared.attach(flows).select("features", *names).collect()
        raw = np.array([r.features for r in given])
        assert raw.shape[1] == shared.width
        for e in group:
            own = spark.createDataFrame(given).drop("features").withColumn("enc", F.lit(e.enc))
            want = np.array([r.features for r in features.encode(own, encoder, spec, ["enc"]).collect()])
            np.testing.assert_allclose(raw @ shared.encoder_matrix(e), want, atol=1e-9)
    assert [len(g) for g in transfer.passes(encoders, spec, 1)] == [1, 1]
    assert [len(g) for g in transfer.passes(encoders, spec)] == [2]
