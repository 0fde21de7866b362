"""Shapes of physical plans: what must hold on tables of any size."""

import re
from dataclasses import replace

from pyspark.sql import functions as F

from flowloom.catalog import common as C
from flowloom.operators import context, evaluate, graph, reconstruct
from flowloom.operators.features import encode
from flowloom.operators.transfer import crossed_scores
from flowloom.operators.windows import row_windows
from flowloom.sources.flows import as_flows, lineitem_rows


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(as_flows(lineitem_rows(spark, sf)).filter("l_orderkey > 100").select("IN_PKTS"))
    assert "GreaterThan(l_orderkey,100)" in text
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"l_orderkey", "l_quantity"}


def test_index_result_needs_no_shuffle(spark, sf):
    text = plan(C.train_flows(spark, sf))
    assert "hashpartitioning" not in text and "SinglePartition" not in text and "Join" not in text


def test_tumbling_windows_are_a_projection(spark, sf):
    text = plan(row_windows(C.train_flows(spark, sf), 200, 200, pos="flow_id"))
    assert "Generate" not in text and "hashpartitioning" not in text


def test_encoding_broadcasts_the_state_by_its_size(spark, sf):
    text = plan(encode(C.train_windows(spark, sf), C.silo_encoder(spark, sf), C.SPEC, ["silo"]))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "hashpartitioning" not in text


def test_window_graph_of_an_aligned_index_has_no_exchange(spark, sf):
    """Flows that were laid window by window are not shuffled; without that there is one shuffle."""
    edges = C.train_edges(spark, sf).withColumn("model", F.col("silo"))
    aligned = context.ContextSpec(("model", *C.GROUP), C.SPEC.width, 4, rows=C.CONFIG.window)
    models = spark.createDataFrame([("A", i, [0.0] * C.SPEC.width) for i in range(aligned.size)], reconstruct.COEFFICIENTS)
    for spec, exchanges in ((aligned, 0), (replace(aligned, rows=None), 1)):
        for df in (context.endpoint_context(edges, spec), context.graph_windows(edges, spec), reconstruct.score_flows(edges, models, spec)):
            text = plan(df)
            assert text.count("Exchange hashpartitioning") == exchanges and "SinglePartition" not in text
        sums = plan(reconstruct.gram_sums(edges, spec, "model"))
        assert sums.count("Exchange hashpartitioning(model") == 1 + exchanges


def test_curves_have_no_single_task_step(spark, sf):
    rows = C.all_flows(spark, sf).select("silo", F.col("OUT_BYTES").alias("score"), F.col("Label").alias("label"))
    assert "SinglePartition" not in plan(evaluate.score_curve(rows, ["silo"]))


def test_results_do_not_depend_on_shuffle_partitions(spark, sf):
    rows = C.all_flows(spark, sf).select("silo", F.col("OUT_BYTES").alias("score"), F.col("Label").alias("label"))
    want = evaluate.metrics(rows, ["silo"]).orderBy("silo").select("silo", "tp", "fp", "threshold").collect()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "5"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            mixed = rows.orderBy(F.rand(7))
            assert evaluate.metrics(mixed, ["silo"]).orderBy("silo").select("silo", "tp", "fp", "threshold").collect() == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_crossed_scores_look_at_flows_once(spark, sf):
    """All silos' models meet the flows where they lie: no exchange, no row per flow and model before the tasks."""
    encoder = C.silo_encoder(spark, sf).withColumnRenamed("silo", "enc")
    spec = replace(C.CONFIG.context, group=C.GROUP)
    models = spark.createDataFrame([("A", i, [0.0] * C.SPEC.width) for i in range(spec.size)], reconstruct.COEFFICIENTS)
    scores = crossed_scores(C.train_windows(spark, sf), encoder, models, C.SPEC, spec)
    text = plan(scores)
    assert "Exchange" not in text and "Generate" not in text and text.count("Scan parquet") == 1
    assert sorted(r.model for r in scores.select("model").distinct().collect()) == ["A", "N", "R"]
    assert scores.filter("model <> 'A' AND NOT isnan(score)").count() == 0


def test_panes_are_summed_before_windows_are_made(spark, sf):
    edges = encode(C.train_flows(spark, sf), C.silo_encoder(spark, sf), C.SPEC, ["silo"])
    text = plan(graph.pane_means(edges, ["silo"], 200, 80, C.SPEC.width))
    assert text.index("Generate explode") < text.rindex("HashAggregate") and text.count("HashAggregate") >= 4
    below = text[text.index("Generate explode") :]
    assert below.count("HashAggregate") == 2
