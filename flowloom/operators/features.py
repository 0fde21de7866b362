"""Fitting and applying the feature encoding: scaler, vocabularies, edge vector.

Every fit is grouped by `keys`.  With `keys=("silo",)` each silo has its own
state; with a constant key the silos are pooled and nothing else changes.
Fitted state is one row per key (or per key and feature), never flow-sized.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowloom.functions import scalar as S
from flowloom.sources.flows import FeatureSpec, numeric_value

VOCAB_COLUMNS = ("PROTOCOL", "L4_DST_PORT")


def derive_totals(flows: DataFrame, spec: FeatureSpec = FeatureSpec()) -> DataFrame:
    """Derived columns of the spec, added to the raw ones."""
    return flows.withColumns({n: F.expr(e) for n, e in spec.derived.items() if n in spec.columns})


def _moments(flows: DataFrame, spec: FeatureSpec, keys: Sequence[str]) -> DataFrame:
    """One row per key: arrays `means` and `scales`, from a single aggregate."""
    means, scales = [], []
    for name in spec.numeric:
        value = numeric_value(spec, name)
        spread = F.stddev_pop(value)
        means.append(F.avg(value))
        scales.append(F.when(spread == 0, 1.0).otherwise(spread))
    return flows.groupBy(*keys).agg(F.array(*means).alias("means"), F.array(*scales).alias("scales"))


def fit_scaler(flows: DataFrame, spec: FeatureSpec, keys: Sequence[str]) -> DataFrame:
    """(keys, feature, pos, mean, scale) with population deviation; a constant feature has scale 1."""
    return scaler_rows(_moments(flows, spec, keys), spec, keys)


def scaler_rows(encoder: DataFrame, spec: FeatureSpec, keys: Sequence[str]) -> DataFrame:
    """Scaler part of an encoder as rows, the form it is stored in."""
    names = F.array(*[F.lit(n) for n in spec.numeric])
    zipped = F.arrays_zip(names.alias("feature"), F.col("means").alias("mean"), F.col("scales").alias("scale"))
    rows = encoder.select(*keys, F.posexplode(zipped).alias("pos", "m"))
    return rows.select(*keys, F.col("m")["feature"].alias("feature"), "pos", F.col("m")["mean"].alias("mean"), F.col("m")["scale"].alias("scale"))


def fit_vocab(flows: DataFrame, spec: FeatureSpec, keys: Sequence[str]) -> DataFrame:
    """(keys, column, slot, value): most frequent protocols and non-ephemeral destination ports.

    Protocols are listed by value, ports by count.  Equal counts are broken by the
    smaller value.  Both columns are counted in one scan, and the rank runs on the
    counts: at most one row per (key, code).
    """
    limits = {"PROTOCOL": spec.top_protocols, "L4_DST_PORT": spec.top_ports}
    present = [c for c in VOCAB_COLUMNS if c in spec.columns]
    if not present:
        nothing = {"column": F.lit(""), "slot": F.lit(0), "value": F.lit(0)}
        return flows.select(*keys, *[c.alias(n) for n, c in nothing.items()]).filter(F.lit(False))
    codes = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("int").alias("value")) for c in present])
    counted = (
        flows.select(*keys, F.inline(codes))
        .filter(F.col("value").isNotNull())
        .filter((F.col("column") != "L4_DST_PORT") | (F.col("value") <= S.REGISTERED_PORT_MAX))
        .groupBy(*keys, "column", "value")
        .count()
    )
    by_count = Window.partitionBy(*keys, "column").orderBy(F.desc("count"), "value")
    limit = F.when(F.col("column") == "PROTOCOL", limits["PROTOCOL"]).otherwise(limits["L4_DST_PORT"])
    kept = (
        counted.withColumn("rank", F.row_number().over(by_count))
        .filter(F.col("rank") <= max(limits.values()))
        .filter(F.col("rank") <= limit)
    )
    # a second number inside the same partitioning: no further shuffle
    listing = F.when(F.col("column") == "PROTOCOL", F.col("value")).otherwise(F.col("rank"))
    slot = F.row_number().over(Window.partitionBy(*keys, "column").orderBy(listing)) - 1
    return kept.select(*keys, "column", slot.alias("slot"), "value")


def pad_vocab(vocab: Column, size: int) -> Column:
    """Array filled to `size` with -1, -2, ... so that all silos have vectors of one width."""
    missing = F.lit(size) - F.size(vocab)
    filler = F.transform(F.sequence(F.lit(1), missing), lambda i: -i)
    return F.when(missing > 0, F.concat(vocab, filler)).otherwise(vocab)


def vocab_arrays(vocab_state: DataFrame, spec: FeatureSpec, keys: Sequence[str]) -> DataFrame:
    """One row per key with padded arrays and the number of real entries of both."""

    def column(name: str, size: int) -> Column:
        pairs = F.collect_list(F.when(F.col("column") == name, F.struct("slot", "value")))
        values = F.transform(F.array_sort(pairs), lambda p: p["value"])
        return pad_vocab(values, size)

    real = F.count_if(F.col("value") >= 0)
    return vocab_state.groupBy(*keys).agg(
        column("PROTOCOL", spec.top_protocols).alias("protocol_vocab"),
        column("L4_DST_PORT", spec.top_ports).alias("port_vocab"),
        real.alias("n_vocab"),
    )


def fit_encoder(flows: DataFrame, spec: FeatureSpec, keys: Sequence[str], padded: bool = False) -> DataFrame:
    """One row per key: means, scales, vocabularies, and how many features are real.

    `padded` counts the filled vocabulary slots as features (what all silos of a
    federation must do to agree on the width).
    """
    return _encoder(_moments(flows, spec, keys), fit_vocab(flows, spec, keys), spec, keys, padded)


def encoder_from_state(
    scaler_state: DataFrame, vocab_state: DataFrame, spec: FeatureSpec, keys: Sequence[str], padded: bool = False
) -> DataFrame:
    """The encoder of stored scaler and vocabulary rows."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "mean", "scale")))
    scaler = scaler_state.groupBy(*keys).agg(ordered.alias("s")).select(
        *keys,
        F.transform("s", lambda p: p["mean"]).alias("means"),
        F.transform("s", lambda p: p["scale"]).alias("scales"),
    )
    return _encoder(scaler, vocab_state, spec, keys, padded)


def _encoder(scaler: DataFrame, vocab_state: DataFrame, spec: FeatureSpec, keys: Sequence[str], padded: bool) -> DataFrame:
    slots = spec.top_protocols * ("PROTOCOL" in spec.columns) + spec.top_ports * ("L4_DST_PORT" in spec.columns)
    joined = scaler.join(vocab_arrays(vocab_state, spec, keys), list(keys), "full_outer")
    filled = F.lit(spec.width) if padded else F.lit(spec.width - slots) + F.coalesce("n_vocab", F.lit(0))
    return joined.withColumn("n_features", filled.cast("int")).drop("n_vocab")


def numeric_block(spec: FeatureSpec) -> list[Column]:
    """Scaled numeric columns in selected order; needs `means` and `scales` on the row."""
    values = [numeric_value(spec, c) for c in spec.numeric]
    if not spec.scale:
        return values
    return [(v - F.col("means")[i]) / F.col("scales")[i] for i, v in enumerate(values)]


def categorical_codes(spec: FeatureSpec) -> dict[str, Column]:
    """Slot number of every selected categorical column; needs the vocabularies on the row."""
    codes = {
        "PROTOCOL": lambda c: S.vocab_code(c.cast("int"), F.col("protocol_vocab")),
        "L4_SRC_PORT": S.port_bucket,
        "L4_DST_PORT": lambda c: S.port_code(c.cast("int"), F.col("port_vocab")),
    }
    return {f"_code_{name}": codes[name](F.col(name)) for name in spec.categorical}


def categorical_block(spec: FeatureSpec) -> list[Column]:
    """0/1 columns of the selected categorical columns; needs `categorical_codes` on the row."""
    widths = {"PROTOCOL": spec.top_protocols + 1, "L4_SRC_PORT": 3, "L4_DST_PORT": spec.top_ports + 2}
    return [c for name in spec.categorical for c in S.one_hot(F.col(f"_code_{name}"), widths[name])]


def encode(flows: DataFrame, encoder: DataFrame, spec: FeatureSpec, keys: Sequence[str]) -> DataFrame:
    """Add the array `features` and `n_features`; the encoder is joined on `keys`.

    A flow without an encoder fails the query instead of leaving the result.  The encoder
    carries no hint; `stage.small` gives one to a caller that needs its flows to stay in place.
    """
    codes = categorical_codes(spec)
    joined = flows.join(encoder, list(keys), "left").withColumns(codes)
    missing = F.raise_error(F.lit(f"flow without an encoder for its {list(keys)}")).cast("array<double>")
    vector = F.when(F.col("n_features").isNull(), missing).otherwise(
        F.array(*numeric_block(spec), *categorical_block(spec))
    )
    used = ["means", "scales", "protocol_vocab", "port_vocab", *codes]
    return joined.withColumn("features", vector).drop(*used)


def feature_names(vocab_state: DataFrame, spec: FeatureSpec, keys: Sequence[str]) -> DataFrame:
    """(keys, feature_pos, name) of the unpadded vector, in its order."""
    silos = vocab_state.select(*keys).distinct()
    parts = []

    def fixed(block: int, names: Sequence[str], first: int = 0) -> None:
        rows = F.array(*[F.struct(F.lit(first + i).alias("at"), F.lit(n).alias("name")) for i, n in enumerate(names)])
        parts.append(silos.select(*keys, F.lit(block).alias("block"), F.inline(rows)))

    def listed(block: int, column: str, prefix: str) -> None:
        rows = vocab_state.filter(F.col("column") == column)
        name = F.concat(F.lit(prefix), F.col("value").cast("string"))
        parts.append(rows.select(*keys, F.lit(block).alias("block"), F.col("slot").alias("at"), name.alias("name")))

    last = 1 << 20
    fixed(0, spec.numeric)
    for block, column in enumerate(spec.categorical, start=1):
        if column == "PROTOCOL":
            listed(block, column, "PROTOCOL=")
            fixed(block, ["PROTOCOL=other"], last)
        elif column == "L4_SRC_PORT":
            fixed(block, ["SRC_PORT=wellknown", "SRC_PORT=registered", "SRC_PORT=ephemeral"])
        else:
            listed(block, column, "DST_PORT=")
            fixed(block, ["DST_PORT=other", "DST_PORT=ephemeral"], last)
    table = pool(parts)
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy("block", "at")) - 1
    return table.select(*keys, pos.alias("feature_pos"), "name")


def pool(parts: Sequence[DataFrame]) -> DataFrame:
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table


def check_width(encoder: DataFrame, spec: FeatureSpec, keys: Sequence[str]) -> DataFrame:
    """Keys whose vector width is not the one that follows from the spec; must be empty."""
    return encoder.filter(F.col("n_features") != spec.width).select(
        *keys, "n_features", F.lit(spec.width).alias("expected")
    )
