"""Training histories, repeated runs and summary tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Metric and summary columns of the published reports.
SEED_METRICS = ("auc_roc", "pr_auc", "precision", "recall", "f1", "fpr")
SUMMARY_COLUMNS = (
    "dataset", "auc_roc", "pr_auc", "precision", "recall", "f1", "fpr", "threshold", "n_eval_edges",
    "best_epoch", "epochs_trained", "best_val_mse", "train_time_sec", "infer_time_sec",
)


def best_epoch(history: DataFrame, keys: Sequence[str], patience: int = 5, loss: str = "val_mse") -> DataFrame:
    """(keys, best_epoch, best_val_mse, epochs_trained): first minimum before training would stop.

    Training stops at the first epoch that is `patience` epochs past its best so
    far; 0 never stops.  A history has one row per epoch, so its groups are small.
    """
    by_epoch = Window.partitionBy(*keys).orderBy("epoch")
    before = by_epoch.rowsBetween(Window.unboundedPreceding, -1)
    upto = by_epoch.rowsBetween(Window.unboundedPreceding, 0)
    improved = F.col(loss) < F.coalesce(F.min(loss).over(before), F.lit(float("inf")))
    marked = history.withColumn("_better", improved)
    marked = marked.withColumn("_best", F.max(F.when(F.col("_better"), F.col("epoch"))).over(upto))
    stale = F.col("epoch") - F.coalesce("_best", F.lit(0))
    if patience > 0:
        stops = F.min(F.when(stale >= patience, F.col("epoch"))).over(Window.partitionBy(*keys))
        marked = marked.withColumn("_stop", stops)
        marked = marked.filter(F.col("_stop").isNull() | (F.col("epoch") <= F.col("_stop")))
    return marked.groupBy(*keys).agg(
        F.max(F.when(F.col("_better"), F.col("epoch"))).alias("best_epoch"),
        F.min(loss).alias("best_val_mse"),
        F.max("epoch").alias("epochs_trained"),
    )


def normalised_history(history: DataFrame, run: str = "run", loss: str = "val_mse") -> DataFrame:
    """(run, epoch, mean_norm): mean over silos of the loss relative to the silo's first epoch."""
    first = F.first(loss).over(Window.partitionBy(run, "silo").orderBy("epoch"))
    relative = F.col(loss) / F.greatest(first, F.lit(1e-12))
    return history.withColumn("_rel", relative).groupBy(run, "epoch").agg(F.avg("_rel").alias("mean_norm"))


def seed_summary(per_run: DataFrame, metrics: Sequence[str] = SEED_METRICS) -> DataFrame:
    """Per silo: mean and sample deviation over seeds, to 4 places; one seed has no deviation."""
    stats = []
    for m in metrics:
        stats += [F.round(F.avg(m), 4).alias(f"{m}_mean"), F.round(F.stddev_samp(m), 4).alias(f"{m}_std")]
    return per_run.groupBy("silo").agg(*stats, F.count(F.lit(1)).alias("n_seeds"))


def sweep_rows(per_run: DataFrame, metric: str = "auc_roc") -> DataFrame:
    """(sigma, silo, auc_mean, auc_std) per silo, and for 'mean' and 'median' over the silos of a seed."""

    def spread(rows: DataFrame) -> DataFrame:
        return rows.groupBy("sigma", "silo").agg(F.avg(metric).alias("auc_mean"), F.stddev_samp(metric).alias("auc_std"))

    per_seed = per_run.groupBy("sigma", "seed").agg(F.avg(metric).alias("mean"), F.median(metric).alias("median"))
    both = F.array(*[F.struct(F.lit(n).alias("silo"), F.col(n).alias(metric)) for n in ("mean", "median")])
    return spread(per_run).unionByName(spread(per_seed.select("sigma", "seed", F.inline(both))))


def sweep_report(per_run: DataFrame, metric: str = "auc_roc", silos: Sequence[str] | None = None) -> DataFrame:
    """One row per sigma, one column per silo, 'mean' and 'median'; a given `epsilon` is kept."""
    rows = sweep_rows(per_run, metric)
    wide = rows.groupBy("sigma").pivot("silo", list(silos) if silos else None).agg(F.round(F.max("auc_mean"), 4))
    if "epsilon" not in per_run.columns:
        return wide
    budget = per_run.groupBy("sigma").agg(F.round(F.max("epsilon"), 2).alias("epsilon"))
    return budget.join(wide, "sigma")


def summary_table(
    metrics: DataFrame, silo_order: Sequence[str], columns: Sequence[str] = SUMMARY_COLUMNS
) -> DataFrame:
    """Known columns that are present, in the canonical silo order."""
    position = F.array_position(F.array(*[F.lit(s) for s in silo_order]), F.col("dataset"))
    unknown_last = F.when(position == 0, len(silo_order) + 1).otherwise(position)
    return metrics.orderBy(unknown_last, "dataset").select(*[c for c in columns if c in metrics.columns])
