"""Evaluation of scores, model runs, splits and reports."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.catalog.common import (
    CONFIG, GROUP, NUMERIC_SQL, ORDER_SQL, SPEC, TRAIN_SQL, all_flows, features_sql, flows_sql, holdout_flows, once,
    q6, query, r6_all, table, train_edges, train_flows, vocab_sql,
)
from flowloom.functions.scalar import r6
from flowloom.operators import evaluate as ev
from flowloom.operators import graph, reports, split
from flowloom.operators.prefix import prefix_index
from flowloom.operators.reconstruct import validation_mse
from flowloom.operators.windows import window_list
from flowloom.plans import training
from flowloom.sources import state
from flowloom.sources.flows import LABEL
from flowloom.stage import materialize

G = list(GROUP)
RATIOS = ["precision", "recall", "f1", "fpr", "tpr"]

# Scores with many ties: length of a text, by language, against its toxicity label.
TEXT_SQL = """scores AS (SELECT lang AS silo, CAST(n_chars AS DOUBLE) AS score, toxic AS label
  FROM labels JOIN documents ON labels.doc_id = documents.doc_id)"""


def text_scores(spark, sf):
    joined = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return joined.select(F.col("lang").alias("silo"), F.col("n_chars").cast("double").alias("score"), F.col("toxic").alias("label"))


# Scores of all flows: bytes sent, by silo, against the attack label.
BYTES_SQL = f"{flows_sql()}, scores AS (SELECT silo, split, flow_id, out_bytes AS score, label FROM flows)"


def byte_scores(spark, sf):
    return all_flows(spark, sf).select("silo", "split", F.col("OUT_BYTES").alias("score"), F.col(LABEL).alias("label"))


def ratios_sql() -> str:
    return f"""{q6('CASE WHEN tp + fp = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END')} AS precision,
      {q6('CASE WHEN tp + fn = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END')} AS recall,
      {q6('CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END')} AS f1,
      {q6('CASE WHEN fp + tn = 0 THEN 0 ELSE CAST(fp AS DOUBLE) / (fp + tn) END')} AS fpr,
      {q6('CASE WHEN tp + fn = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END')} AS tpr"""


def confusion_cte(thresholds: str = "thresholds", scores: str = "scores", keys: str = "silo") -> str:
    """CTE `conf` (keys, quantile, threshold, tp, fp, tn, fn)."""
    return f"""conf AS (SELECT s.{keys}, quantile, threshold,
      count(*) FILTER (WHERE score >= threshold AND label = 1) AS tp, count(*) FILTER (WHERE score >= threshold AND label <> 1) AS fp,
      count(*) FILTER (WHERE score < threshold AND label <> 1) AS tn, count(*) FILTER (WHERE score < threshold AND label = 1) AS fn
      FROM {scores} s JOIN {thresholds} t ON s.{keys} = t.{keys} GROUP BY s.{keys}, quantile, threshold)"""


def curve_cte(keys: str = "silo", scores: str = "scores") -> str:
    """CTEs ending in `best` (keys, auc_roc, pr_auc, threshold, tp, fp, tn, fn, n_eval_edges)."""
    return f"""distinct_scores AS (SELECT {keys}, score, CAST(count(*) FILTER (WHERE label = 1) AS BIGINT) AS dp,
        CAST(count(*) FILTER (WHERE label <> 1) AS BIGINT) AS dn FROM {scores} GROUP BY {keys}, score),
    curve AS (SELECT {keys}, score, dp, dn,
        CAST(sum(dp) OVER (PARTITION BY {keys} ORDER BY score DESC) AS BIGINT) AS tp,
        CAST(sum(dn) OVER (PARTITION BY {keys} ORDER BY score DESC) AS BIGINT) AS fp,
        CAST(sum(dp) OVER (PARTITION BY {keys}) AS DOUBLE) AS p, CAST(sum(dn) OVER (PARTITION BY {keys}) AS DOUBLE) AS n FROM distinct_scores),
    areas AS (SELECT {keys}, max(p) AS p, max(n) AS n, CASE WHEN max(p) > 0 AND max(n) > 0 THEN sum(dn / n * (2 * tp - dp) / p / 2) END AS auc_roc,
        CASE WHEN max(p) > 0 THEN sum(dp / p * (tp / CAST(tp + fp AS DOUBLE))) END AS pr_auc FROM curve GROUP BY {keys}),
    points AS (SELECT {keys}, score AS threshold, tp, fp, CASE WHEN p > 0 AND n > 0 THEN tp / p - fp / n END AS j FROM curve
      UNION ALL SELECT {keys}, CAST('Infinity' AS DOUBLE), 0, 0, 0.0 FROM areas),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY j DESC NULLS LAST, threshold DESC) AS r FROM points),
    best AS (SELECT {', '.join('a.' + k.strip() for k in keys.split(','))}, auc_roc, pr_auc, threshold, tp, fp,
        CAST(n - fp AS BIGINT) AS tn, CAST(p - tp AS BIGINT) AS fn, CAST(p + n AS BIGINT) AS n_eval_edges
      FROM areas a JOIN ranked r ON {' AND '.join(f'a.{k.strip()} = r.{k.strip()}' for k in keys.split(','))} AND r = 1)"""


METRIC_COLS = ["silo", "auc_roc", "pr_auc", "threshold", *RATIOS, "tp", "fp", "tn", "fn", "n_eval_edges"]
METRICS_SQL = f"""SELECT silo, {q6('auc_roc')} AS auc_roc, {q6('pr_auc')} AS pr_auc, threshold, {ratios_sql()}, tp, fp, tn, fn, n_eval_edges FROM best"""


def rounded_metrics(df):
    return r6_all(df, ["auc_roc", "pr_auc", *RATIOS])


@query("label_counts", f"WITH {TEXT_SQL} SELECT silo, label, count(*) AS n FROM scores GROUP BY silo, label")
def label_counts(spark, sf):
    return ev.label_counts(text_scores(spark, sf), ["silo"])


def _bad_sql() -> str:
    return f"""{flows_sql()}, raw AS (SELECT silo, split, l_orderkey, l_linenumber, l_partkey, l_suppkey, label,
      CASE WHEN in_pkts = 1 THEN CAST('NaN' AS DOUBLE) WHEN in_pkts = 2 THEN CAST('Infinity' AS DOUBLE)
           WHEN in_pkts = 3 THEN CAST('-Infinity' AS DOUBLE) ELSE out_bytes END AS score FROM flows)"""


@query(
    "scrub_scores",
    f"""WITH {_bad_sql()}, caps AS (SELECT silo, max(score) FILTER (WHERE isfinite(score)) AS cap FROM raw GROUP BY silo)
    SELECT raw.silo, l_orderkey, l_linenumber, l_partkey, l_suppkey, NOT isfinite(score) AS was_bad,
      CASE WHEN isfinite(score) THEN score WHEN isnan(score) OR score > 0 THEN coalesce(cap, 1.0) ELSE 0.0 END AS score
    FROM raw JOIN caps ON raw.silo = caps.silo""",
)
def scrub_scores(spark, sf):
    packets = F.col("IN_PKTS")
    bad = F.when(packets == 1, float("nan")).when(packets == 2, float("inf")).when(packets == 3, float("-inf"))
    rows = all_flows(spark, sf).withColumn("score", bad.otherwise(F.col("OUT_BYTES")))
    out = ev.scrub_scores(rows, ["silo"])
    return out.select("silo", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "was_bad", "score")


CAL_SQL = f"""{BYTES_SQL}, thresholds AS (
  SELECT silo, unnest([0.9, 0.95, 0.99, 0.995, 0.999]) AS quantile,
    unnest(quantile_cont(score, [0.9, 0.95, 0.99, 0.995, 0.999])) AS threshold, count(*) AS n_edges
  FROM scores WHERE split = 'train' AND label = 0 GROUP BY silo)"""


def _thresholds(spark, sf):
    benign = byte_scores(spark, sf).filter((F.col("split") == "train") & (F.col("label") == 0))
    return ev.exact_quantiles(benign, ["silo"], "score", ev.CALIBRATION_QUANTILES)


@query(
    "quantile_thresholds",
    f"WITH {CAL_SQL} SELECT silo, CAST(quantile AS DOUBLE) AS quantile, {q6('threshold')} AS threshold, n_edges FROM thresholds",
)
def quantile_thresholds(spark, sf):
    return r6_all(_thresholds(spark, sf), ["threshold"])


@query("quantile_thresholds_approx")
def quantile_thresholds_approx(spark, sf):
    benign = byte_scores(spark, sf).filter((F.col("split") == "train") & (F.col("label") == 0))
    return ev.approximate_quantiles(benign, ["silo"], "score", ev.CALIBRATION_QUANTILES)


HOLD = "hold AS (SELECT silo, score, label FROM scores WHERE split = 'holdout')"


@query(
    "confusion",
    f"""WITH {CAL_SQL}, {HOLD}, {confusion_cte(scores='hold')}
    SELECT silo, CAST(quantile AS DOUBLE) AS quantile, {q6('threshold')} AS threshold, tp, fp, tn, fn, {ratios_sql()} FROM conf""",
)
def confusion(spark, sf):
    holdout = byte_scores(spark, sf).filter(F.col("split") == "holdout")
    out = ev.confusion(holdout, _thresholds(spark, sf).drop("n_edges"), ["silo"])
    return r6_all(out, ["threshold", *RATIOS])


@query(
    "classify",
    f"""WITH {CAL_SQL} SELECT s.silo, s.split, s.flow_id, CAST(score >= threshold AS INTEGER) AS attack
    FROM scores s JOIN thresholds t ON s.silo = t.silo AND quantile = 0.99""",
)
def classify(spark, sf):
    from flowloom.functions.scalar import is_attack

    thresholds = materialize(_thresholds(spark, sf).filter(F.col("quantile") == 0.99).select("silo", "threshold"), "thresholds")
    flows = _silo_rows(spark, sf)
    out = flows.join(thresholds, "silo")
    return out.select("silo", "split", "flow_id", is_attack(F.col("OUT_BYTES"), F.col("threshold")).alias("attack"))


def _silo_rows(spark, sf):
    """All flows, numbered per silo over both splits."""
    from flowloom.sources.flows import ORDER_KEY, as_flows, lineitem_rows

    return as_flows(prefix_index(lineitem_rows(spark, sf), ["silo"], ORDER_KEY, name="flow_id"))


@query(
    "roc_curve",
    f"""WITH {TEXT_SQL}, {curve_cte()}
    SELECT silo, threshold, {q6('fp / nullif(n, 0)')} AS fpr, {q6('tp / nullif(p, 0)')} AS tpr
    FROM (SELECT silo, score AS threshold, tp, fp, p, n FROM curve UNION ALL SELECT silo, -1.0, 0, 0, 1, 1 FROM areas)""",
)
def roc_curve(spark, sf):
    points = ev.roc_curve(text_scores(spark, sf), ["silo"])
    # the start point has threshold +inf, shown as -1
    shown = F.when(F.col("threshold") == float("inf"), -1.0).otherwise(F.col("threshold"))
    return r6_all(points.withColumn("threshold", shown), ["fpr", "tpr"])


@query(
    "roc_corners",
    f"""WITH {BYTES_SQL}, {curve_cte()},
    steps AS (SELECT *, lead(dp) OVER w AS dp_next, lead(dn) OVER w AS dn_next FROM curve WINDOW w AS (PARTITION BY silo ORDER BY score DESC))
    SELECT silo, threshold, {q6('fp / nullif(n, 0)')} AS fpr, {q6('tp / nullif(p, 0)')} AS tpr
    FROM (SELECT silo, score AS threshold, tp, fp, p, n FROM steps WHERE dp_next IS NULL OR CAST(dp AS HUGEINT) * dn_next <> CAST(dn AS HUGEINT) * dp_next
      UNION ALL SELECT silo, -1.0, 0, 0, 1, 1 FROM areas)""",
)
def roc_corners(spark, sf):
    points = ev.roc_curve(byte_scores(spark, sf), ["silo"], thin=True)
    shown = F.when(F.col("threshold") == float("inf"), -1.0).otherwise(F.col("threshold"))
    return r6_all(points.withColumn("threshold", shown), ["fpr", "tpr"])


@query("roc_auc", f"WITH {BYTES_SQL}, {curve_cte()} SELECT silo, {q6('auc_roc')} AS auc_roc FROM best")
def roc_auc(spark, sf):
    return rounded_metrics(ev.metrics(byte_scores(spark, sf), ["silo"])).select("silo", "auc_roc")


@query("average_precision", f"WITH {TEXT_SQL}, {curve_cte()} SELECT silo, {q6('pr_auc')} AS pr_auc FROM best")
def average_precision(spark, sf):
    return rounded_metrics(ev.metrics(text_scores(spark, sf), ["silo"])).select("silo", "pr_auc")


@query("youden", f"WITH {TEXT_SQL}, {curve_cte()} SELECT silo, CASE WHEN isinf(threshold) THEN -1.0 ELSE threshold END AS threshold, tp, fp, tn, fn FROM best")
def youden(spark, sf):
    best = ev.metrics(text_scores(spark, sf), ["silo"])
    shown = F.when(F.col("threshold") == float("inf"), -1.0).otherwise(F.col("threshold"))
    return best.select("silo", shown.alias("threshold"), "tp", "fp", "tn", "fn")


@query("metrics", f"WITH {BYTES_SQL}, {curve_cte()} {METRICS_SQL}")
def metrics(spark, sf):
    return rounded_metrics(ev.metrics(byte_scores(spark, sf), ["silo"])).select(*METRIC_COLS)


@query(
    "pooled_eval",
    f"""WITH {BYTES_SQL}, both_ AS (SELECT silo, score, label FROM scores UNION ALL SELECT 'ALL(pooled)', score, label FROM scores),
    {curve_cte(scores='both_')} {METRICS_SQL}""",
)
def pooled_eval(spark, sf):
    counts = materialize(ev.score_counts(byte_scores(spark, sf), ["silo"]), "counts")
    return rounded_metrics(ev.metrics(ev.pooled_counts(counts, ["silo"]), ["silo"])).select(*METRIC_COLS)


@query(
    "threshold_sweep",
    f"""WITH {CAL_SQL}, {HOLD}, {confusion_cte(scores='hold')}, {curve_cte(scores='hold')},
    both_ AS (SELECT silo, 'youden_oracle' AS method, CAST(NULL AS DOUBLE) AS quantile, threshold, tp, fp, tn, fn FROM best
      UNION ALL SELECT silo, 'benign_quantile', CAST(quantile AS DOUBLE), threshold, tp, fp, tn, fn FROM conf)
    SELECT silo, method, quantile, {q6('1 - quantile')} AS expected_fpr, {q6('threshold')} AS threshold, {ratios_sql()}, tp, fp, tn, fn FROM both_""",
)
def threshold_sweep(spark, sf):
    holdout = byte_scores(spark, sf).filter(F.col("split") == "holdout")
    out = ev.threshold_sweep(holdout, _thresholds(spark, sf), ["silo"], ev.metrics(holdout, ["silo"]))
    return r6_all(out, ["expected_fpr", "threshold", *RATIOS])


# The smallest whole path: distance of a flow to the mean of its window, as score.


def _distance_scores(edges):
    context = graph.window_mean(edges, G, SPEC.width)
    from flowloom.functions import scalar as S

    joined = edges.join(context, G)
    score = S.mean_square(S.items("features", 4), S.items("context", 4))
    return joined.select("silo", "flow_id", score.alias("score"), F.col(LABEL).alias("label"))


@query(
    "window_distance_report",
    f"""WITH {features_sql()},
    ctx AS (SELECT silo, window_id, {', '.join(f'avg(f{i}) AS c{i}' for i in range(4))} FROM edges GROUP BY silo, window_id),
    dist AS (SELECT e.silo, ({' + '.join(f'(f{i} - c{i}) * (f{i} - c{i})' for i in range(4))}) / 4 AS score
      FROM edges e JOIN ctx ON e.silo = ctx.silo AND e.window_id = ctx.window_id),
    hold_named AS (SELECT * FROM named WHERE split = 'holdout'),
    hold_flows AS (SELECT *, row_number() OVER (PARTITION BY silo ORDER BY {ORDER_SQL}) - 1 AS flow_id, count(*) OVER (PARTITION BY silo) AS n_rows FROM hold_named),
    hold_windowed AS (SELECT *, flow_id // 200 AS window_id FROM hold_flows WHERE (flow_id // 200) * 200 + 200 <= n_rows),
    hold_scaled AS (SELECT w.silo, window_id, label,
      (CAST(min_ttl AS DOUBLE) - m0) / s0 AS f0, (ln(1 + greatest(duration, 0.0)) - m1) / s1 AS f1,
      (ln(1 + greatest(CAST(in_pkts AS DOUBLE) + CAST(out_pkts AS DOUBLE), 0.0)) - m2) / s2 AS f2,
      (ln(1 + greatest(in_bytes + out_bytes, 0.0)) - m3) / s3 AS f3 FROM hold_windowed w JOIN moments m ON w.silo = m.silo),
    hold_ctx AS (SELECT silo, window_id, avg(f0) AS c0, avg(f1) AS c1, avg(f2) AS c2, avg(f3) AS c3 FROM hold_scaled GROUP BY silo, window_id),
    hold AS (SELECT e.silo, label, ((f0 - c0) * (f0 - c0) + (f1 - c1) * (f1 - c1) + (f2 - c2) * (f2 - c2) + (f3 - c3) * (f3 - c3)) / 4 AS score
      FROM hold_scaled e JOIN hold_ctx c ON e.silo = c.silo AND e.window_id = c.window_id),
    thresholds AS (SELECT silo, 0.99 AS quantile, quantile_cont(score, 0.99) AS threshold FROM dist GROUP BY silo),
    {confusion_cte(scores='hold')}
    SELECT silo, CAST(quantile AS DOUBLE) AS quantile, {q6('threshold')} AS threshold, tp, fp, tn, fn, {ratios_sql()} FROM conf""",
)
def window_distance_report(spark, sf):
    from flowloom.catalog.common import silo_encoder
    from flowloom.operators.features import encode
    from flowloom.operators.windows import row_windows

    train = _distance_scores(train_edges(spark, sf))
    windowed = row_windows(holdout_flows(spark, sf), CONFIG.window, CONFIG.step, pos="flow_id")
    held = _distance_scores(encode(windowed, silo_encoder(spark, sf), SPEC, ["silo"]))
    thresholds = ev.exact_quantiles(train, ["silo"], "score", [0.99]).drop("n_edges")
    return r6_all(ev.confusion(held, thresholds, ["silo"]), ["threshold", *RATIOS])


@query(
    "edge_mse",
    f"""WITH {features_sql()},
    ctx AS (SELECT silo, window_id, {', '.join(f'avg(f{i}) AS c{i}' for i in range(18))} FROM edges GROUP BY silo, window_id)
    SELECT e.silo, e.window_id, e.flow_id, {q6('(' + ' + '.join(f'(f{i} - c{i}) * (f{i} - c{i})' for i in range(18)) + ') / 18')} AS error
    FROM edges e JOIN ctx ON e.silo = ctx.silo AND e.window_id = ctx.window_id""",
)
def edge_mse(spark, sf):
    """Mean squared error of every flow with the window mean as its prediction."""
    from flowloom.functions import scalar as S

    edges = train_edges(spark, sf)
    joined = edges.join(graph.window_mean(edges, G, SPEC.width), G)
    error = S.mean_square(S.items("features", SPEC.width), S.items("context", SPEC.width))
    return joined.select(*G, "flow_id", r6(error).alias("error"))


# Splits ------------------------------------------------------------------------------

WINDOW_LIST_SQL = f"""{TRAIN_SQL},
  windows AS (SELECT silo, unnest(range(0, CAST((max(n_rows) - 200) // 200 AS BIGINT) + 1)) AS window_id FROM flows GROUP BY silo),
  hashed AS (SELECT *, md5('42|' || silo || '|' || CAST(window_id AS VARCHAR)) AS h FROM windows),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY silo ORDER BY h, window_id) - 1 AS r, count(*) OVER (PARTITION BY silo) AS n FROM hashed)"""


def _windows(spark, sf):
    sizes = train_flows(spark, sf).groupBy("silo").agg(F.max("n_rows").alias("n_rows"))
    return window_list(sizes, ["silo"], CONFIG.window, CONFIG.step)


@query(
    "train_val_split",
    f"WITH {WINDOW_LIST_SQL} SELECT silo, window_id, CASE WHEN r < floor(n * 0.8) THEN 'train' ELSE 'val' END AS part FROM ranked",
)
def train_val_split(spark, sf):
    return split.train_val_split(_windows(spark, sf), ["silo"], 0.8, 42)


@query(
    "split_flows",
    f"""WITH {WINDOW_LIST_SQL}
    SELECT f.silo, flow_id // 200 AS window_id, flow_id, CASE WHEN r < floor(n * 0.8) THEN 'train' ELSE 'val' END AS part
    FROM flows f JOIN ranked w ON f.silo = w.silo AND f.flow_id // 200 = w.window_id""",
)
def split_flows(spark, sf):
    from flowloom.catalog.common import train_windows

    cuts = split.split_cuts(_windows(spark, sf), ["silo"], 0.8, 42)
    out = split.split_flows(train_windows(spark, sf), cuts, ["silo"], 42)
    return out.select("silo", "window_id", "flow_id", "part")


@query(
    "iid_shards",
    f"""WITH {WINDOW_LIST_SQL}, ks AS (SELECT unnest(range(4)) AS k)
    SELECT silo, window_id, CAST(max(k) AS INTEGER) AS shard FROM ranked JOIN ks ON k * n // 4 <= r GROUP BY silo, window_id""",
)
def iid_shards(spark, sf):
    return split.iid_shards(_windows(spark, sf), ["silo"], 4, 42)


@query(
    "leave_one_out",
    """WITH s AS (SELECT DISTINCT l_returnflag AS silo FROM lineitem)
    SELECT a.silo AS held_out, b.silo AS client FROM s a JOIN s b ON a.silo <> b.silo""",
)
def leave_one_out(spark, sf):
    return split.leave_one_out(table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("silo")).distinct())


# Histories and reports: monthly means stand for losses per epoch ------------------------

MONTH = "year(l_shipdate) * 12 + month(l_shipdate)"
HISTORY_SQL = f"""history AS (SELECT l_linestatus AS run, l_returnflag AS silo,
    CAST({MONTH} - (SELECT min({MONTH}) FROM lineitem) + 1 AS INTEGER) AS epoch, round(avg(l_tax), 9) AS val_mse
  FROM lineitem GROUP BY ALL)"""


def history(spark, sf):
    rows = table(spark, sf, "lineitem")
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    first = materialize(rows.groupBy(F.lit(1).alias("one")).agg(F.min(month).alias("first")), "first")
    loss = rows.groupBy(F.lit(1).alias("one"), F.col("l_linestatus").alias("run"), F.col("l_returnflag").alias("silo"), month.alias("month")).agg(
        F.round(F.avg("l_tax"), 9).alias("val_mse")
    )
    return loss.join(first, "one").select("run", "silo", (F.col("month") - F.col("first") + 1).cast("int").alias("epoch"), "val_mse")


@query(
    "best_epoch",
    f"""WITH {HISTORY_SQL},
    seen AS (SELECT *, min(val_mse) OVER (PARTITION BY run, silo ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM history),
    marked AS (SELECT *, val_mse < coalesce(before, CAST('Infinity' AS DOUBLE)) AS better FROM seen),
    best AS (SELECT *, max(CASE WHEN better THEN epoch END) OVER (PARTITION BY run, silo ORDER BY epoch) AS best FROM marked),
    stop AS (SELECT run, silo, min(CASE WHEN epoch - best >= 5 THEN epoch END) AS stop FROM best GROUP BY run, silo)
    SELECT b.run, b.silo, max(CASE WHEN better THEN epoch END) AS best_epoch, {q6('min(val_mse)')} AS best_val_mse, max(epoch) AS epochs_trained
    FROM best b JOIN stop s ON b.run = s.run AND b.silo = s.silo WHERE stop IS NULL OR epoch <= stop GROUP BY b.run, b.silo""",
)
def best_epoch(spark, sf):
    return r6_all(reports.best_epoch(history(spark, sf), ["run", "silo"], 5), ["best_val_mse"])


@query(
    "normalised_history",
    f"""WITH {HISTORY_SQL}, rel AS (SELECT *, val_mse / greatest(first_value(val_mse) OVER (PARTITION BY run, silo ORDER BY epoch), 1e-12) AS x FROM history)
    SELECT run, epoch, {q6('avg(x)')} AS mean_norm FROM rel GROUP BY run, epoch""",
)
def normalised_history(spark, sf):
    return r6_all(reports.normalised_history(history(spark, sf)), ["mean_norm"])


RUNS_SQL = f"""{flows_sql()}, scores AS (SELECT silo, l_orderkey % 3 AS seed, out_bytes AS score, label FROM flows),
  {curve_cte('silo, seed')}, runs AS (SELECT silo, seed, auc_roc, pr_auc, {ratios_sql()} FROM best)"""


def per_run(spark, sf):
    rows = all_flows(spark, sf).select(
        "silo", (F.col("l_orderkey") % 3).alias("seed"), F.col("OUT_BYTES").alias("score"), F.col(LABEL).alias("label")
    )
    return r6_all(ev.metrics(rows, ["silo", "seed"]), RATIOS)


def q4(text: str) -> str:
    return f"round({text}, 4)"


@query(
    "seed_summary",
    f"""WITH {RUNS_SQL} SELECT silo,
      {', '.join(f'{q4(f"avg({m})")} AS {m}_mean, {q4(f"stddev_samp({m})")} AS {m}_std' for m in reports.SEED_METRICS)},
      count(*) AS n_seeds FROM runs GROUP BY silo""",
)
def seed_summary(spark, sf):
    return reports.seed_summary(per_run(spark, sf))


SWEEP_SQL = f"""{flows_sql()}, scores AS (SELECT silo, l_orderkey % 3 AS seed, l_partkey % 3 AS level, out_bytes AS score, label FROM flows),
  {curve_cte('silo, seed, level')},
  runs AS (SELECT silo, seed, (level + 1) / 10.0 AS sigma, 100.0 / (level + 1) AS epsilon, auc_roc FROM best)"""


def sweep_runs(spark, sf):
    rows = all_flows(spark, sf).select(
        "silo", (F.col("l_orderkey") % 3).alias("seed"), (F.col("l_partkey") % 3).alias("level"),
        F.col("OUT_BYTES").alias("score"), F.col(LABEL).alias("label"),
    )
    runs = ev.metrics(rows, ["silo", "seed", "level"])
    return runs.withColumns({"sigma": (F.col("level") + 1) / 10.0, "epsilon": 100.0 / (F.col("level") + 1)})


@query(
    "sweep_report",
    f"""WITH {SWEEP_SQL}, per_seed AS (SELECT sigma, seed, avg(auc_roc) AS mean, median(auc_roc) AS median FROM runs GROUP BY sigma, seed),
    long AS (SELECT sigma, silo, avg(auc_roc) AS m FROM runs GROUP BY sigma, silo
      UNION ALL SELECT sigma, 'mean', avg(mean) FROM per_seed GROUP BY sigma UNION ALL SELECT sigma, 'median', avg(median) FROM per_seed GROUP BY sigma)
    SELECT CAST(l.sigma AS DOUBLE) AS sigma, round(CAST(max(epsilon) AS DOUBLE), 2) AS epsilon,
      {', '.join(f'''{q4(f"max(m) FILTER (WHERE l.silo = '{s}')")} AS "{s}"''' for s in ('A', 'N', 'R', 'mean', 'median'))}
    FROM long l JOIN (SELECT sigma, max(epsilon) AS epsilon FROM runs GROUP BY sigma) e ON l.sigma = e.sigma GROUP BY l.sigma""",
)
def sweep_report(spark, sf):
    return reports.sweep_report(materialize(sweep_runs(spark, sf), "runs"))


@query(
    "sweep_rows",
    f"""WITH {SWEEP_SQL}, per_seed AS (SELECT sigma, seed, avg(auc_roc) AS mean, median(auc_roc) AS median FROM runs GROUP BY sigma, seed),
    parts AS (SELECT sigma, silo, auc_roc AS v FROM runs UNION ALL SELECT sigma, 'mean', mean FROM per_seed UNION ALL SELECT sigma, 'median', median FROM per_seed)
    SELECT CAST(sigma AS DOUBLE) AS sigma, silo, {q6('avg(v)')} AS auc_mean, {q6('stddev_samp(v)')} AS auc_std FROM parts GROUP BY sigma, silo""",
)
def sweep_rows(spark, sf):
    return r6_all(reports.sweep_rows(materialize(sweep_runs(spark, sf), "runs")), ["auc_mean", "auc_std"])


@query(
    "resume_pending",
    f"""WITH {BYTES_SQL}, {curve_cte()}, old AS (SELECT 'A' AS silo, 0.5 AS auc_roc)
    SELECT silo, {q6('auc_roc')} AS auc_roc FROM (SELECT silo, CAST(auc_roc AS DOUBLE) AS auc_roc FROM old
      UNION ALL SELECT silo, auc_roc FROM best WHERE silo NOT IN (SELECT silo FROM old))""",
)
def resume_pending(spark, sf):
    flows = byte_scores(spark, sf)
    silos = flows.groupBy("silo").agg(F.min("silo").alias("silo_pos"))
    done = silos.filter(F.col("silo") == "A").select("silo", F.lit(0.5).alias("auc_roc"))
    # written, so that its few rows are broadcast and no flow is shuffled by silo
    todo = materialize(state.pending(silos, done), "pending")
    new = ev.metrics(flows.join(todo.select("silo"), "silo", "left_semi"), ["silo"]).select("silo", "auc_roc")
    return r6_all(state.resume(silos, done, new), ["auc_roc"])


@query(
    "summary_table",
    f"""WITH {BYTES_SQL}, {curve_cte()} SELECT silo AS dataset, {q6('auc_roc')} AS auc_roc, {q6('pr_auc')} AS pr_auc, {ratios_sql()}, threshold, n_eval_edges FROM best""".replace(
        ratios_sql(), ", ".join(part for part in ratios_sql().split(",\n") if not part.endswith("AS tpr"))
    ),
)
def summary_table(spark, sf):
    rows = rounded_metrics(ev.metrics(byte_scores(spark, sf), ["silo"])).withColumnRenamed("silo", "dataset")
    return reports.summary_table(rows, ["R", "A", "N"])


# Model runs: least squares fits are outside SQL, so these have no oracle ------------------


@once
def _prepared_shared(spark, sf):
    return training.prepare(train_flows(spark, sf), CONFIG, shared=True)


def _run(mode: str):
    def fit(spark, sf):
        ready = _prepared_shared(spark, sf) if mode != "per_silo" else None
        model = training.fit(train_flows(spark, sf), CONFIG, mode, ready)
        return training.calibrate(train_flows(spark, sf), model)

    fit.__name__ = f"trained_{mode}"
    return once(fit)


TRAINED = {mode: _run(mode) for mode in training.MODES}


def _mode_query(mode: str):
    def run(spark, sf):
        model = TRAINED[mode](spark, sf)
        scores = training.score_holdout(holdout_flows(spark, sf), model)
        found, _ = training.evaluate_holdout(scores, model, pooled=mode == "combined")
        return found

    return run


for _mode in training.MODES:
    query(f"train_{_mode}")(_mode_query(_mode))


@query("reconstruction_scores")
def reconstruction_scores(spark, sf):
    return training.score_holdout(holdout_flows(spark, sf), TRAINED["per_silo"](spark, sf))


@query("chunked_scoring")
def chunked_scoring(spark, sf):
    """Overlapping windows: a flow has one score per window, reduced to its largest."""
    model = TRAINED["per_silo"](spark, sf)
    overlapping = replace(model, config=replace(CONFIG, step=100))
    return training.flow_scores(training.score_holdout(holdout_flows(spark, sf), overlapping), "max")


@query("validation_mse")
def validation_mse_query(spark, sf):
    model = TRAINED["per_silo"](spark, sf)
    edges = training.training_part(train_flows(spark, sf), model.encoder, model.cuts, CONFIG, False, "val")
    from flowloom.operators.reconstruct import score_flows

    return validation_mse(score_flows(edges, model.coefficients, CONFIG.context), ["silo"])


@query("calibrated_sweep")
def calibrated_sweep(spark, sf):
    model = TRAINED["combined"](spark, sf)
    scores = training.score_holdout(holdout_flows(spark, sf), model)
    return training.evaluate_holdout(scores, model, pooled=True)[1]


@query("transfer_matrix")
def transfer_matrix(spark, sf):
    model = TRAINED["per_silo"](spark, sf)
    scores = training.transfer_scores(holdout_flows(spark, sf), model)
    return training.transfer_matrix(scores)


@query(
    "save_load_state",
    f"""WITH {TRAIN_SQL}, {vocab_sql()}, numbered AS (SELECT silo, col, value, row_number() OVER (PARTITION BY silo, col ORDER BY CASE WHEN col = 'PROTOCOL' THEN value ELSE rank END) - 1 AS slot FROM vocab)
    {' UNION ALL '.join(f"""SELECT silo, 'mean' AS part, '{n}' AS name, {i} AS slot, {q6(f'avg({e})')} AS value FROM flows GROUP BY silo
      UNION ALL SELECT silo, 'scale', '{n}', {i}, {q6(f'stddev_pop({e})')} FROM flows GROUP BY silo""" for i, (n, e) in enumerate(zip(SPEC.numeric, NUMERIC_SQL, strict=True)))}
    UNION ALL SELECT silo, 'vocab', col, CAST(slot AS INTEGER), CAST(value AS DOUBLE) FROM numbered""",
)
def save_load_state(spark, sf):
    """A scaler and vocabularies written as rows, and an encoder restored from them: every number of it."""
    import uuid

    from flowloom.catalog.common import silo_encoder
    from flowloom.operators.features import scaler_rows
    from flowloom.stage import shared_dir

    root = f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"
    tables = state.encoder_state(train_flows(spark, sf), silo_encoder(spark, sf), SPEC, ["silo"])
    state.save_scaler(tables.pop("scaler_state"), f"{root}/scaler")
    state.save_state(tables, root, "first")
    read = state.load_state(spark, root, "first", list(tables)) | {"scaler_state": state.load_scaler(spark, f"{root}/scaler")}
    restored = state.restore_encoder(read, SPEC, ["silo"])
    scaler = scaler_rows(restored, SPEC, ["silo"])
    parts = [scaler.select("silo", F.lit(p).alias("part"), F.col("feature").alias("name"), F.col("pos").alias("slot"), r6(F.col(p)).alias("value")) for p in ("mean", "scale")]
    for column, name in (("protocol_vocab", "PROTOCOL"), ("port_vocab", "L4_DST_PORT")):
        listed = restored.select("silo", F.posexplode(column).alias("slot", "value"))
        parts.append(listed.select("silo", F.lit("vocab").alias("part"), F.lit(name).alias("name"), "slot", F.col("value").cast("double").alias("value")))
    return reduce(DataFrame.unionByName, parts)


@query(
    "write_metrics",
    f"""WITH {BYTES_SQL}, {curve_cte()} SELECT silo AS dataset, {q6('auc_roc')} AS auc_roc, {q6('pr_auc')} AS pr_auc, n_eval_edges, tp, fp FROM best""",
)
def write_metrics(spark, sf):
    """Metric rows written as JSON and CSV, and both read back: the CSV has the listed columns that are there."""
    import uuid

    from flowloom.stage import shared_dir

    rows = rounded_metrics(ev.metrics(byte_scores(spark, sf), ["silo"])).withColumnRenamed("silo", "dataset")
    root = f"{shared_dir(spark)}/metrics-{uuid.uuid4().hex}"
    columns = ["dataset", "auc_roc", "pr_auc", "n_eval_edges", "not_there"]
    state.write_metrics(rows, f"{root}/json", f"{root}/csv", columns)
    schema = "dataset string, auc_roc double, pr_auc double, n_eval_edges bigint"
    listed = spark.read.schema(schema).option("header", True).csv(f"{root}/csv")
    whole = spark.read.schema(rows.schema).json(f"{root}/json")
    return listed.join(whole.select("dataset", "tp", "fp"), "dataset").select("dataset", "auc_roc", "pr_auc", "n_eval_edges", "tp", "fp")
