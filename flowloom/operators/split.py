"""Choosing windows: train and validation, shards, leave-one-out.

Choices are ranks of a hash of (seed, silo, window), so they have exact sizes
and do not depend on partitioning.  The rank runs over the window list, through
the two-pass index.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.operators.prefix import prefix_index
from flowloom.stage import materialize


def window_hash(seed: int, keys: Sequence[str]) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.col("window_id").cast("string")))


def _ranked(windows: DataFrame, keys: Sequence[str], hashed: Column) -> DataFrame:
    return prefix_index(windows.withColumn("hash", hashed), keys, ["hash", "window_id"], name="rank", total="n_windows")


def _train_size(ratio: float) -> Column:
    return F.floor(F.col("n_windows") * F.lit(float(ratio)))


def train_val_split(windows: DataFrame, keys: Sequence[str], ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """(keys, window_id, part): exactly int(n * ratio) windows of a key are 'train', the rest 'val'."""
    ranked = _ranked(windows, keys, window_hash(seed, keys))
    part = F.when(F.col("rank") < _train_size(ratio), "train").otherwise("val")
    return ranked.select(*keys, "window_id", part.alias("part"))


def split_cuts(windows: DataFrame, keys: Sequence[str], ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """(keys, cut): the last training window of every key in hash order."""
    ranked = _ranked(windows, keys, window_hash(seed, keys))
    last = ranked.filter(F.col("rank") == _train_size(ratio) - 1)
    return materialize(last.select(*keys, F.struct("hash", "window_id").alias("cut")), "cuts")


def split_flows(windowed: DataFrame, cuts: DataFrame, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Add `part` to windowed flows without joining the window list.

    A flow compares the hash of its own window with the cut of its key, so only
    one row per key is joined.
    """
    here = F.struct(window_hash(seed, keys).alias("hash"), F.col("window_id").alias("window_id"))
    joined = windowed.join(cuts, list(keys), "left")
    return joined.withColumn("part", F.when(here <= F.col("cut"), "train").otherwise("val")).drop("cut")


def iid_shards(windows: DataFrame, keys: Sequence[str], shards: int = 4, seed: int = 42) -> DataFrame:
    """(keys, window_id, shard): one permutation per key, cut into contiguous slices.

    Slice k holds the ranks from k*n//shards up to (k+1)*n//shards.
    """
    ranked = _ranked(windows, keys, window_hash(seed, keys))
    # largest k with k*n//shards <= rank
    shard = F.expr(f"((rank + 1) * {shards} - 1) div n_windows").cast("int")
    return ranked.select(*keys, "window_id", shard.alias("shard"))


def shard_cuts(windows: DataFrame, keys: Sequence[str], shards: int, seed: int = 42) -> DataFrame:
    """(keys, shard_ends): the last windows of all shards but the last one, in hash order."""
    ranked = _ranked(windows, keys, window_hash(seed, keys))
    ends = F.array(*[F.expr(f"{k} * n_windows div {shards}") for k in range(1, shards)])
    last = ranked.filter(F.array_contains(ends, F.col("rank") + 1))
    ends = F.sort_array(F.collect_list(F.struct("hash", "window_id"))).alias("shard_ends")
    return materialize(last.groupBy(*keys).agg(ends), "shards")


def shard_flows(windowed: DataFrame, cuts: DataFrame, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Add the `shard` of `iid_shards` to windowed flows, by comparing with one row per key."""
    here = F.struct(window_hash(seed, keys).alias("hash"), F.col("window_id").alias("window_id"))
    joined = windowed.join(cuts, list(keys), "left").withColumn("_here", here)
    before = F.size(F.filter(F.coalesce("shard_ends", F.array().cast(cuts.schema["shard_ends"].dataType)), lambda end: end < F.col("_here")))
    return joined.withColumn("shard", before).drop("shard_ends", "_here")


def leave_one_out(silos: DataFrame) -> DataFrame:
    """(held_out, client): all folds of a list of silos; the list is metadata-sized."""
    listed = silos.groupBy(F.lit(1).alias("one")).agg(F.collect_list("silo").alias("silos"))
    folds = listed.select("silos", F.explode("silos").alias("held_out"))
    return folds.select("held_out", F.explode("silos").alias("client")).filter(F.col("client") != F.col("held_out"))
