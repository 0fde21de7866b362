"""Scores to metrics: repair, confusion, curves, areas, thresholds.

All of them work per key group of any size.  Curves and quantiles first count
equal scores, then use running sums over the distinct scores, so neither one
frequent score nor one dominant silo ends up in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions import scalar as S
from flowloom.operators.prefix import prefix_sums
from flowloom.stage import materialize

POOLED = "ALL(pooled)"


def label_counts(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    return scores.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))


def _by_class(rows: DataFrame) -> tuple[Column, Column]:
    """Aggregates for the attacks and the other flows among scored flows (`label`) or `score_counts`."""
    if "n_pos" in rows.columns:
        return F.sum("n_pos"), F.sum("n_neg")
    return F.count_if(F.col("label") == 1), F.count_if(F.col("label") != 1)


def score_counts(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, score, n_pos, n_neg): flows per distinct score.

    Curves, areas, confusion and sweeps take these rows in place of scored flows, so one look at
    the flows serves all of them.  Counts by more keys may be counted again by fewer.
    """
    positives, negatives = _by_class(scores)
    return scores.groupBy(*keys, "score").agg(positives.alias("n_pos"), negatives.alias("n_neg"))


def pooled_counts(counts: DataFrame, keys: Sequence[str], silo: str = "silo") -> DataFrame:
    """`score_counts`, and the same rolled up over `silo` under the name of the pooled group."""
    rest = [k for k in keys if k != silo]
    return counts.unionByName(score_counts(counts, rest).withColumn(silo, F.lit(POOLED)))


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def scrub_scores(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """NaN, null and +inf become the largest finite score of the key (1.0 if none), -inf becomes 0.

    Adds `was_bad`.
    """
    score = F.col("score")
    caps = scores.groupBy(*keys).agg(F.coalesce(F.max(F.when(_finite(score), score)), F.lit(1.0)).alias("_cap"))
    low = score == F.lit(float("-inf"))
    repaired = F.when(_finite(score), score).when(low, 0.0).otherwise(F.col("_cap"))
    joined = scores.join(materialize(caps, "caps"), list(keys))
    return joined.withColumns({"was_bad": ~_finite(score), "score": repaired}).drop("_cap")


def confusion_metrics(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall, f1, fpr and tpr; every 0/0 is 0."""
    precision, recall = S.safe_ratio(tp, tp + fp), S.safe_ratio(tp, tp + fn)
    return {
        "precision": precision,
        "recall": recall,
        "f1": S.safe_ratio(tp * 2.0, tp * 2 + fp + fn),
        "fpr": S.safe_ratio(fp, fp + tn),
        "tpr": recall,
    }


def confusion(scores: DataFrame, thresholds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts and ratios at every row of `thresholds` (keys, threshold, more columns), in one scan.

    A flow is counted once, in the step between two thresholds of its key where its score
    lies; the thresholds then add up steps.
    """
    named = [c for c in thresholds.columns if c not in keys]
    thresholds = materialize(thresholds, "thresholds")
    levels = thresholds.groupBy(*keys).agg(F.array_sort(F.collect_set("threshold")).alias("_levels"))

    def passed(value: str) -> Column:
        return F.size(F.filter("_levels", lambda level: level <= F.col(value)))

    placed = scores.filter(F.col("score").isNotNull()).join(materialize(levels, "levels"), list(keys))
    positives, negatives = _by_class(placed)
    steps = placed.groupBy(*keys, passed("score").alias("_step")).agg(positives.alias("_pos"), negatives.alias("_neg"))
    ranked = thresholds.join(levels, list(keys)).withColumn("_rank", passed("threshold")).drop("_levels")
    attack = F.col("_step") >= F.col("_rank")
    none = F.lit(0).cast("long")
    counted = ranked.join(steps, list(keys)).groupBy(*keys, *named).agg(
        F.sum(F.when(attack, F.col("_pos")).otherwise(none)).alias("tp"),
        F.sum(F.when(attack, F.col("_neg")).otherwise(none)).alias("fp"),
        F.sum(F.when(attack, none).otherwise(F.col("_neg"))).alias("tn"),
        F.sum(F.when(attack, none).otherwise(F.col("_pos"))).alias("fn"),
    )
    return counted.withColumns(confusion_metrics(*[F.col(c) for c in ("tp", "fp", "tn", "fn")]))


def score_curve(scores: DataFrame, keys: Sequence[str], neighbours: bool = False) -> DataFrame:
    """One row per distinct score, from high to low: what `score >= threshold` catches.

    tp, fp are running counts; tp_here, fp_here belong to the score itself;
    positives, negatives are the group's totals.  `neighbours` adds tp_next, fp_next, the
    counts of the next lower score (null at the lowest).
    """
    distinct = score_counts(scores, keys).withColumnsRenamed({"n_pos": "tp_here", "n_neg": "fp_here"})
    running = prefix_sums(
        distinct, keys, ["-score"], {"tp": "tp_here", "fp": "fp_here"},
        {"positives": "tp_here", "negatives": "fp_here"},
        following={"tp_next": "tp_here", "fp_next": "fp_here"} if neighbours else None,
    )
    return running.withColumnRenamed("score", "threshold")


def corners(curve: DataFrame) -> DataFrame:
    """The points of a `score_curve` with neighbours at which the ROC line turns, and the last one.

    Steps are whole counts, so directions are compared exactly.
    """
    here, after = [[F.col(c).cast("decimal(19,0)") for c in pair] for pair in (("tp_here", "fp_here"), ("tp_next", "fp_next"))]
    turns = here[0] * after[1] != here[1] * after[0]
    return curve.filter(F.col("tp_next").isNull() | turns)


def roc_curve(scores: DataFrame, keys: Sequence[str], thin: bool = False) -> DataFrame:
    """(keys, threshold, fpr, tpr), with the start (0, 0) at threshold +inf.

    `thin` leaves out points on the straight line between their neighbours; areas stay the same.
    """
    curve = score_curve(scores, keys, thin)
    curve = corners(curve) if thin else curve
    points = curve.select(
        *keys,
        "threshold",
        (F.col("fp") / F.nullif("negatives", F.lit(0))).alias("fpr"),
        (F.col("tp") / F.nullif("positives", F.lit(0))).alias("tpr"),
    )
    start = curve.groupBy(*keys).agg(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return start.unionByName(points)


def curve_metrics(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Areas and the best Youden point of a `score_curve`, one row per key.

    The point before a score is known from the running counts less the score's own
    counts, so no row has to look at its neighbour.  Areas are null without
    positives or negatives.  Among equal Youden values the highest threshold wins,
    and the start point (nothing caught, threshold +inf) takes part.
    """
    tp, fp = F.col("tp"), F.col("fp")
    p, n = F.nullif("positives", F.lit(0)), F.nullif("negatives", F.lit(0))
    area = F.col("fp_here") / n * (tp * 2 - F.col("tp_here")) / p / 2.0
    step = F.col("tp_here") / p * (tp / (tp + fp))
    youden = tp / p - fp / n
    best = F.max(F.struct(youden.alias("j"), "threshold", "tp", "fp"))
    agg = curve.groupBy(*keys).agg(
        F.sum(area).alias("auc_roc"),
        F.sum(step).alias("pr_auc"),
        best.alias("best"),
        F.max("positives").alias("positives"),
        F.max("negatives").alias("negatives"),
    )
    start = F.struct(
        F.lit(0.0).alias("j"), F.lit(float("inf")).alias("threshold"),
        F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fp"),
    )
    chosen = F.when(F.col("best")["j"] > 0, F.col("best")).otherwise(start)
    valid = (F.col("positives") > 0) & (F.col("negatives") > 0)
    agg = agg.withColumn("best", F.when(valid, chosen).otherwise(start))
    out = agg.select(
        *keys,
        "auc_roc",
        "pr_auc",
        F.col("best")["threshold"].alias("threshold"),
        F.col("best")["tp"].alias("tp"),
        F.col("best")["fp"].alias("fp"),
        (F.col("negatives") - F.col("best")["fp"]).alias("tn"),
        (F.col("positives") - F.col("best")["tp"]).alias("fn"),
        (F.col("positives") + F.col("negatives")).alias("n_eval_edges"),
    )
    return out.withColumns(confusion_metrics(*[F.col(c) for c in ("tp", "fp", "tn", "fn")]))


def metrics(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Areas and the label-aware operating point per key."""
    return curve_metrics(score_curve(scores, keys), keys)


def exact_quantiles(
    rows: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float], counts: str = "n_edges"
) -> DataFrame:
    """(keys, quantile, threshold, n): linear interpolation between order statistics.

    Exact for groups of any size: equal values are counted, running counts say which
    value holds a rank, and only the rows that hold a wanted rank are kept.
    """
    tallied = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    # the columns of the tally keep plain names: underscores are dropped by the running sums
    tallied = tallied.withColumnRenamed("_n", "tally")
    ranked = prefix_sums(tallied, keys, [value], {"upto": "tally"}, {counts: "tally"})
    wanted = F.array(*[F.struct(F.lit(float(q)).alias("quantile")) for q in quantiles])

    def rank_of(quantile: Column) -> Column:
        return quantile * (F.col(counts) - 1)

    def holds(rank: Column) -> Column:
        return (rank >= F.col("upto") - F.col("tally")) & (rank < F.col("upto"))

    # a value gets rows for the ranks that it holds only
    held = F.filter(wanted, lambda w: holds(F.floor(rank_of(w["quantile"]))) | holds(F.ceil(rank_of(w["quantile"]))))
    spread = ranked.select("*", F.inline(held))
    at = rank_of(F.col("quantile"))
    low, high = F.floor(at), F.ceil(at)

    found = spread.groupBy(*keys, "quantile", counts).agg(
        F.max(F.when(holds(low), F.col(value))).alias("_low"), F.max(F.when(holds(high), F.col(value))).alias("_high")
    )
    between = F.col("_low") + (F.col("_high") - F.col("_low")) * (at - low)
    return found.select(*keys, "quantile", between.alias("threshold"), counts)


def approximate_quantiles(
    rows: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float], accuracy: int = 10_000
) -> DataFrame:
    """Fast variant of `exact_quantiles` with a mergeable summary per key."""
    picked = F.percentile_approx(value, [float(q) for q in quantiles], accuracy)
    wide = rows.groupBy(*keys).agg(picked.alias("t"), F.count(value).alias("n_edges"))
    named = F.arrays_zip(F.array(*[F.lit(float(q)) for q in quantiles]).alias("quantile"), F.col("t").alias("threshold"))
    return wide.select(*keys, F.inline(named), "n_edges").select(*keys, "quantile", "threshold", "n_edges")


# Published calibration quantiles.
CALIBRATION_QUANTILES = (0.90, 0.95, 0.99, 0.995, 0.999)

SWEEP = ("threshold", "precision", "recall", "f1", "fpr", "tpr", "tp", "fp", "tn", "fn")


def threshold_sweep(scores: DataFrame, thresholds: DataFrame, keys: Sequence[str], found: DataFrame) -> DataFrame:
    """The Youden point of `found` (`metrics` of the scores) and every calibrated quantile of `thresholds`."""
    oracle = found.select(
        *keys,
        F.lit("youden_oracle").alias("method"),
        F.lit(None).cast("double").alias("quantile"),
        F.lit(None).cast("double").alias("expected_fpr"),
        *SWEEP,
    )
    calibrated = confusion(scores, thresholds.select(*keys, "quantile", "threshold"), keys).select(
        *keys,
        F.lit("benign_quantile").alias("method"),
        "quantile",
        (F.lit(1.0) - F.col("quantile")).alias("expected_fpr"),
        *SWEEP,
    )
    return oracle.unionByName(calibrated)
