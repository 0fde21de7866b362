"""Federated aggregation on long update tables (round, client, key, pos, value, weight)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.stage import materialize

PARAMETER = ("key", "pos")

# Parameter name parts that decide what is exchanged.
ENCODER_PREFIX = "encoder."
BATCH_NORM_PREFIX = "encoder.batch_norm."
COUNTER_SUFFIX = "num_batches_tracked"
PERSONALISATION_MODES = ("na", "fedbn", "fedrep")


def is_exchanged(mode: str, key: str = "key") -> Column:
    """Whether a parameter crosses to the server: 'na' all, 'fedbn' without normalisation,
    'fedrep' the shared representation only; batch counters never."""
    name = F.col(key)
    never = name.endswith(COUNTER_SUFFIX)
    if mode == "na":
        return ~never
    if mode == "fedbn":
        return ~never & ~name.startswith(BATCH_NORM_PREFIX)
    if mode == "fedrep":
        return ~never & name.startswith(ENCODER_PREFIX)
    raise ValueError(f"unknown mode {mode!r}; choices: {PERSONALISATION_MODES}")


def keys_exchanged(parameters: DataFrame, mode: str) -> DataFrame:
    return parameters.filter(is_exchanged(mode))


def keys_private(parameters: DataFrame, mode: str) -> DataFrame:
    """Everything that is not exchanged."""
    return parameters.filter(~is_exchanged(mode))


def merge_state(shared: DataFrame, private: DataFrame, client: str = "client") -> DataFrame:
    """Global parameters of every client, overridden by the client's private ones."""
    own = private.select(client, *PARAMETER, F.col("value").alias("_own"))
    joined = shared.join(own, [client, *PARAMETER], "full_outer")
    return joined.select(client, *PARAMETER, F.coalesce("_own", "value").alias("value"))


def fed_average(updates: DataFrame, weighting: str = "equal", keys: Sequence[str] = ("round",)) -> DataFrame:
    """Weighted mean of the clients' values per parameter; 'equal' or 'examples' (column `weight`)."""
    if weighting not in ("equal", "examples"):
        raise ValueError(weighting)
    w = F.lit(1.0) if weighting == "equal" else F.col("weight").cast("double")
    mean = F.sum(w * F.col("value")) / F.sum(w)
    return updates.groupBy(*keys, *PARAMETER).agg(mean.alias("value"))


def _differences(updates: DataFrame, base: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Changes of all parameters; one that the base lacks fails the query instead of leaving the norm."""
    start = base.select(*keys, *PARAMETER, F.col("value").alias("base"))
    joined = updates.join(start, [*keys, *PARAMETER], "left")
    name = F.concat_ws(" ", F.lit("no base value for parameter"), "key", F.col("pos").cast("string"))
    known = F.when(F.col("base").isNull(), F.raise_error(name).cast("double")).otherwise(F.col("base"))
    return joined.withColumn("base", known).withColumn("delta", F.col("value") - F.col("base"))


def update_norms(updates: DataFrame, base: DataFrame, keys: Sequence[str] = ("round",)) -> DataFrame:
    """L2 norm of every client's change, before any clipping."""
    changes = _differences(updates, base, keys)
    return changes.groupBy(*keys, "client").agg(F.sqrt(F.sum(F.col("delta") * F.col("delta"))).alias("norm"))


def gaussian(seed: int, columns: Sequence[str]) -> Column:
    """Standard normal number made from a hash of the seed and the columns.

    The same row gets the same number in any plan and after any retry, which
    `randn` does not promise.
    """

    def uniform(salt: int) -> Column:
        text = F.concat_ws("|", F.lit(f"{seed}|{salt}"), *[F.col(c).cast("string") for c in columns])
        bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
        return (bits + 0.5) / F.lit(float(1 << 52))

    return F.sqrt(F.log(uniform(1)) * -2.0) * F.cos(uniform(2) * 6.283185307179586)


def clip_and_noise(
    updates: DataFrame,
    base: DataFrame,
    clip: float,
    sigma: float = 0.0,
    seed: int = 0,
    weighting: str = "equal",
    keys: Sequence[str] = ("round",),
) -> DataFrame:
    """New global values: base + mean of the changes cut to norm `clip`, + N(0, sigma*clip/n).

    The noise is calibrated for an unweighted mean, so other weights are refused.
    """
    if weighting != "equal":
        raise ValueError("clipping with noise needs equal client weights")
    norms = materialize(update_norms(updates, base, keys), "norms")
    changes = _differences(updates, base, keys).join(norms, [*keys, "client"])
    factor = F.when(F.col("norm") > clip, F.lit(float(clip)) / F.col("norm")).otherwise(1.0)
    mean = changes.groupBy(*keys, *PARAMETER).agg(
        F.max("base").alias("base"), F.avg(F.col("delta") * factor).alias("step"), F.count(F.lit(1)).alias("n")
    )
    value = F.col("base") + F.col("step")
    if sigma:
        value = value + gaussian(seed, [*keys, *PARAMETER]) * F.lit(float(sigma * clip)) / F.col("n")
    return mean.select(*keys, *PARAMETER, value.alias("value"))


def silo_metrics(history: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("round",), silos: Sequence[str] | None = None) -> DataFrame:
    """One column '<metric>/<silo>' per client and metric, and the loss weighted by validation edges.

    Without `silos` the columns are those of the history, which a pass over its clients lists first.
    """
    names = [f"{m}/{s}" for m in metrics for s in silos] if silos is not None else None
    named = F.array(*[F.struct(F.concat(F.lit(f"{m}/"), F.col("silo")).alias("name"), F.col(m).alias("v")) for m in metrics])
    wide = history.select(*keys, F.inline(named)).groupBy(*keys).pivot("name", names).agg(F.max("v"))
    return wide.join(weighted_loss(history, keys), list(keys))


def weighted_loss(history: DataFrame, keys: Sequence[str] = ("round",), loss: str = "val_mse") -> DataFrame:
    n = F.col("n_val_edges")
    return history.groupBy(*keys).agg((F.sum(F.col(loss) * n) / F.sum(n)).alias("loss"))
