"""Bringing scores and private state back to their rows, and statistics per silo."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions import scalar as S
from flowloom.stage import materialize


def combine_by_flow(flows: DataFrame, scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Flows with the score of their own key; null where there is none."""
    named = scores.select(*keys, F.col("score").alias("probability_anomalous"))
    return flows.join(named, list(keys), "left")


def combine_by_pair(
    flows: DataFrame, scores: DataFrame, group: Sequence[str], src: str, dst: str, pos: str
) -> DataFrame:
    """Flows with the score of their (source, destination) pair: the first one by position.

    Scores are reduced to one row per pair before they meet the flows.
    """
    pair = [*group, src, dst]
    first = scores.groupBy(*pair).agg(F.min_by("score", pos).alias("probability_anomalous"))
    return flows.join(first, pair, "left")


def endpoint_gather(edges: DataFrame, nodes: DataFrame, contexts: DataFrame, group: Sequence[str]) -> DataFrame:
    """Both end vectors and the window vector for every edge of an edge table with node numbers."""
    src = nodes.select(*group, F.col("node_id").alias("src_node"), F.col("embedding").alias("src_embedding"))
    dst = nodes.select(*group, F.col("node_id").alias("dst_node"), F.col("embedding").alias("dst_embedding"))
    return (
        edges.join(src, [*group, "src_node"]).join(dst, [*group, "dst_node"]).join(contexts, list(group))
    )


def silo_norm_stats(rows: DataFrame, keys: Sequence[str], array: str, width: int) -> DataFrame:
    """(keys, pos, mean, var): exact pooled mean and population variance per feature."""
    pairs = [F.struct(F.avg(v).alias("mean"), F.var_pop(v).alias("var")) for v in S.items(array, width)]
    wide = rows.groupBy(*keys).agg(F.array(*pairs).alias("stats"))
    long = wide.select(*keys, F.posexplode("stats").alias("pos", "s"))
    return long.select(*keys, "pos", F.col("s")["mean"].alias("mean"), F.col("s")["var"].alias("var"))


def batch_norm_apply(
    rows: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    array: str,
    gamma: float = 1.0,
    beta: float = 0.0,
    eps: float = 1e-5,
) -> DataFrame:
    """(x - mean) / sqrt(var + eps) * gamma + beta with the statistics of the own key."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "mean", "var")))
    packed = materialize(stats.groupBy(*keys).agg(ordered.alias("_stats")), "norm")
    joined = rows.join(packed, list(keys))

    def scaled(v, s):
        return (v - s["mean"]) / F.sqrt(s["var"] + eps) * gamma + beta

    return joined.withColumn("normalised", F.zip_with(array, "_stats", scaled)).drop("_stats")
