"""What keeps tasks and exchanges from growing faster than the tables."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_models import SCHEMA, random_edges
from test_plans import plan

from flowloom import session, stage
from flowloom.catalog import scoring
from flowloom.operators import context, graph, wholegraph
from flowloom.operators.context import ContextSpec
from flowloom.operators.prefix import prefix_index
from flowloom.operators.windows import aligned_prefix_index


@pytest.mark.parametrize("partitions, step, broadcast", [(1, 10, 1 << 25), (7, 10, 1 << 25), (7, 45, 1 << 25), (5, 5000, 1 << 25), (7, 10, -1)])
def test_aligned_positions_and_whole_windows(spark, monkeypatch, partitions, step, broadcast):
    """As `prefix_index`, with every window in one task and in order, wherever the borders of the sorted files fall."""
    monkeypatch.setattr(stage, "SMALL_BYTES", broadcast)
    silo = F.when(F.col("id") % 9 == 0, None).when(F.col("id") % 9 < 7, "big").otherwise("small")
    rows = spark.range(1000).select(silo.alias("silo"), F.xxhash64("id").alias("o"), F.col("id").alias("v"))
    want = sorted((r.v, r.row_pos, r.n_rows) for r in prefix_index(rows, ["silo"], ["o"]).collect())
    got = aligned_prefix_index(rows, ["silo"], ["o"], step, partitions=partitions)
    assert sorted((r.v, r.row_pos, r.n_rows) for r in got.collect()) == want
    seen = got.select("silo", "row_pos", F.spark_partition_id().alias("task")).collect()
    runs = [(r.silo, r.row_pos // step, r.task) for r in seen]
    starts = Counter(w[:2] for k, w in enumerate(runs) if k == 0 or runs[k - 1] != w)
    assert max(starts.values()) == 1  # no window is in two places
    assert all(b.row_pos == a.row_pos + 1 for a, b, x, y in zip(seen, seen[1:], runs, runs[1:], strict=False) if x == y)


def test_aligned_positions_need_a_unique_order(spark):
    rows = spark.range(50).select(F.lit("s").alias("silo"), (F.col("id") % 40).alias("o"))
    with pytest.raises(Exception, match="is not unique"):
        aligned_prefix_index(rows, ["silo"], ["o"], 10).collect()


def test_only_borders_are_dealt_anew(spark, monkeypatch):
    """One exchange of the rows: of the second one only windows that two files share take part."""
    written = []
    monkeypatch.setattr("flowloom.operators.windows.materialize", lambda df, tag, **o: written.append((tag, df)) or stage.materialize(df, tag, **o))
    rows = spark.range(20_000).select(F.lit("s").alias("silo"), F.col("id").alias("o"))
    aligned_prefix_index(rows, ["silo"], ["o"], 10, partitions=8)
    ((tag, both),) = written
    text = plan(both)
    whole = text[text.index("Union") : text.index("Sort [silo")]
    assert tag == "aligned" and "hashpartitioning" not in whole and "rangepartitioning" not in text


def test_partitions_follow_the_files(spark, tmp_path, monkeypatch):
    spark.range(100_000).select(F.xxhash64("id").alias("x")).write.parquet(f"{tmp_path}/rows.parquet")
    rows = spark.read.parquet(f"{tmp_path}/rows.parquet")
    size = stage.read_bytes(rows)
    assert stage.partition_count(rows, size // 40) in (40, 41)
    assert stage.PARTITION_BYTES <= 1 << 24

    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(name, None)
    monkeypatch.setattr(session, "SHUFFLE_BYTES", size // 40)
    monkeypatch.setattr(session, "_own", {})
    try:
        session.widen(spark, str(tmp_path))
        assert int(spark.conf.get(name)) >= 40
        found = rows.groupBy("x").count()
        assert found.count() == 100_000 and "hashpartitioning(x" in plan(found)
        session.widen(spark, None)
        assert spark.conf.get(name, None) == before
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def test_window_graph_partitions_follow_the_files(spark, monkeypatch):
    edges = stage.materialize(spark.createDataFrame(random_edges(windows=30), SCHEMA), "edges")
    group = ["silo", "window_id"]
    made = (graph.node_ids, graph.edge_list, graph.out_degree, graph.propagate)
    want = [sorted(map(str, f(edges, group).collect())) for f in made]
    monkeypatch.setattr(graph, "ENDS_BYTES", stage.read_bytes(edges) // 24)
    for f, rows in zip(made, want, strict=True):
        found = f(edges, group)
        assert any(f", {n})" in plan(found) for n in (24, 25)) or any(f", {n}), REPARTITION_BY_NUM" in plan(found) for n in (24, 25))
        assert sorted(map(str, found.collect())) == rows


@pytest.mark.parametrize("most, joins", [(1 << 25, 0), (-1, 2)])
def test_few_hosts_are_sent_to_the_edges(spark, monkeypatch, most, joins):
    """As long as the hosts of a frame fit a broadcast, its edges are not shuffled; results are the same either way."""
    monkeypatch.setattr(stage, "SMALL_BYTES", most)
    edges = spark.createDataFrame(random_edges(windows=1), SCHEMA)
    spec = ContextSpec(("window_id",), 3, 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = wholegraph.single_graph(edges, spec)
        assert plan(found).count("SortMergeJoin") == joins
        got = found.toPandas().sort_values("flow_id")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = context.endpoint_context(edges, spec).toPandas().sort_values("flow_id")
    np.testing.assert_allclose(np.vstack(got.predictors), np.vstack(want.predictors), atol=1e-9)


def test_pending_silos_do_not_shuffle_flows(spark, monkeypatch, tmp_path):
    """The list of pending silos is written, so a join that goes by sizes broadcasts it."""
    rows = [("A" if k % 3 else "N" if k % 2 else "R", "train", float(k % 50), k % 2) for k in range(300)]
    spark.createDataFrame(rows, "silo string, split string, score double, label int").write.parquet(f"{tmp_path}/scores")
    monkeypatch.setattr(scoring, "byte_scores", lambda spark, sf: spark.read.parquet(f"{tmp_path}/scores"))
    seen, real = [], scoring.ev.metrics
    monkeypatch.setattr(scoring.ev, "metrics", lambda scores, keys: seen.append(plan(scores)) or real(scores, keys))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(stage.read_bytes(spark.read.parquet(f"{tmp_path}/scores")) // 2))
    try:
        got = scoring.resume_pending(spark, "").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [r.silo for r in got] == ["A", "N", "R"] and got[0].auc_roc == 0.5
    assert "SortMergeJoin" not in seen[0] and "BroadcastHashJoin" in seen[0]


def test_words_are_learnt_by_the_line():
    """ASCII words go through one pattern for a whole call; control characters and special strings through the tokenizer."""
    import public_tokenizers
    from flowloom.llm.packing import WordIds

    words = WordIds(public_tokenizers.path("word_bpe_49k.json"))
    calls = []
    real = words.remember
    words.remember = lambda found, marked, pieces: calls.append(len(found)) or real(found, marked, pieces)
    texts = ["Don't STOP 's'll x9-9 ...", "a\x1cb <|endoftext|>no c\x7f", "Zé ß 漢字 it's", "", "we've 12,5\tdone\nnow"]
    for some in ([t] for t in texts):
        got = np.frombuffer(words.batch([some[0].encode()])[0], "<u4").tolist()
        assert got == [i for w in some[0].encode().split() for i in words.whole.encode(w.decode(), add_special_tokens=False).ids]
    assert calls[0] == 5  # all words of the first text in one call
