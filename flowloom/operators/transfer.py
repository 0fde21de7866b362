"""Scores of the same flows under many silos' encoders and models, from one look at the flows.

Every encoder is linear in a vector that all of them share: 1, the numbers before scaling, a 0/1
entry for every code that some silo lists, the buckets.  Means over other flows are linear too (the
mean of the entry 1 tells whether there are any), so window graphs and contexts are made once from the
shared vector, and a silo's encoder and coefficients together are one matrix inside the task.
Nothing is joined, so flows of an aligned index stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from flowloom.functions import scalar as S
from flowloom.operators.context import ContextSpec, _with_columns, context_blocks, window_partitions
from flowloom.operators.reconstruct import packed_models
from flowloom.sources.flows import LABEL, FeatureSpec, numeric_value

#: Widest shared vector of one pass over the flows; silos that would widen it further go into another pass.
SHARED_WIDTH = 256

LISTED = {"PROTOCOL": "protocol_vocab", "L4_DST_PORT": "port_vocab"}


def _listed(encoder: Row, spec: FeatureSpec) -> dict[str, list[int]]:
    return {name: list(encoder[column] or []) for name, column in LISTED.items() if name in spec.categorical}


@dataclass(frozen=True)
class SharedVector:
    """Layout of the shared vector of some encoders: [1, numbers less `centre`, categorical blocks]."""

    spec: FeatureSpec
    centre: tuple[float, ...]
    codes: Mapping[str, tuple[int, ...]]

    @classmethod
    def of(cls, encoders: Iterable[Row], spec: FeatureSpec) -> SharedVector:
        encoders = list(encoders)
        # numbers far from zero would lose digits if the mean were taken off by the matrix alone
        centre = tuple(float(m) for m in np.mean([e["means"] for e in encoders], axis=0))
        codes: dict[str, set[int]] = {name: set() for name in LISTED if name in spec.categorical}
        for encoder in encoders:
            for name, values in _listed(encoder, spec).items():
                codes[name].update(values)
        return cls(spec, centre, {name: tuple(sorted(values)) for name, values in codes.items()})

    @property
    def width(self) -> int:
        own = {"L4_SRC_PORT": 3, "L4_DST_PORT": 1}
        return 1 + len(self.centre) + sum(own.get(n, 0) + len(self.codes.get(n, ())) for n in self.spec.categorical)

    def attach(self, flows: DataFrame) -> DataFrame:
        """Add the shared vector as `features`."""
        numbers = [numeric_value(self.spec, n) - F.lit(c) for n, c in zip(self.spec.numeric, self.centre, strict=True)]
        found, blocks = {}, []
        for name in self.spec.categorical:
            code = f"_code_{name}"
            if name == "L4_SRC_PORT":
                found[code] = S.port_bucket(F.col(name))
                blocks += S.one_hot(F.col(code), 3)
                continue
            value = F.col(name).cast("int")
            listed = F.array(*[F.lit(v) for v in self.codes[name]]).cast("array<int>")
            found[code] = S.vocab_code(value, listed)
            if name == "L4_DST_PORT":
                # as `scalar.port_code`: ephemeral ports use no slot, whatever is listed
                found[code] = F.when(value > S.REGISTERED_PORT_MAX, -1).otherwise(found[code])
            blocks += S.one_hot(F.col(code), len(self.codes[name]))
            if name == "L4_DST_PORT":
                blocks.append(F.when(F.col(code) == -1, 1.0).otherwise(0.0))
        return flows.withColumns(found).withColumn("features", F.array(F.lit(1.0), *numbers, *blocks)).drop(*found)

    def encoder_matrix(self, encoder: Row) -> np.ndarray:
        """Matrix that turns shared vectors into the vectors of `features.encode` with this encoder."""
        out = np.zeros((self.width, self.spec.width))
        for i, centre in enumerate(self.centre):
            mean, scale = (encoder["means"][i], encoder["scales"][i]) if self.spec.scale else (0.0, 1.0)
            out[0, i], out[1 + i, i] = (centre - mean) / scale, 1.0 / scale
        row, at = 1 + len(self.centre), len(self.centre)
        own = _listed(encoder, self.spec)
        for name in self.spec.categorical:
            if name == "L4_SRC_PORT":
                out[row : row + 3, at : at + 3] = np.eye(3)
                row, at = row + 3, at + 3
                continue
            other = at + len(own[name])
            out[0, other] = 1.0
            for slot, value in enumerate(own[name]):
                entry = row + self.codes[name].index(value)
                out[entry, at + slot], out[entry, other] = 1.0, -1.0
            row, at = row + len(self.codes[name]), other + 1
            if name == "L4_DST_PORT":
                out[row, other], out[row, at] = -1.0, 1.0
                row, at = row + 1, at + 1
        return out


def passes(encoders: Iterable[Row], spec: FeatureSpec, widest: int = SHARED_WIDTH) -> Iterator[list[Row]]:
    """Encoders in groups whose shared vector has at most `widest` entries (or one encoder)."""
    group: list[Row] = []
    for encoder in encoders:
        if group and (len(group) >= widest or SharedVector.of([*group, encoder], spec).width > widest):
            yield group
            group = []
        group.append(encoder)
    if group:
        yield group


def crossed_scores(
    windowed: DataFrame, encoder: DataFrame, coefficients: DataFrame, spec: FeatureSpec, context: ContextSpec,
    key: str = "enc", widest: int = SHARED_WIDTH,
) -> DataFrame:
    """(model, group, flow_id, label, score): every windowed flow under the encoder and model of every key of `encoder`.

    Encoders and models come to the driver by one group of `passes` at a time: at most `widest` models, each of as many numbers
    as its vectors ask for.  NaN where an encoder has no model.
    """
    flows = windowed.withColumns({"label": F.col(LABEL).cast("int"), "n_features": F.lit(0)})
    parts = [_one_pass(flows, group, coefficients, spec, context, key) for group in passes(encoder.orderBy(key).toLocalIterator(), spec, widest)]
    if not parts:
        raise ValueError("no encoder to score with")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _one_pass(flows: DataFrame, encoders: list[Row], coefficients: DataFrame, spec: FeatureSpec, context: ContextSpec, key: str) -> DataFrame:
    shared = SharedVector.of(encoders, spec)
    raw = replace(context, width=shared.width)
    names = [e[key] for e in encoders]
    packed = packed_models(coefficients.filter(F.col("model").isin(names)), "_model").collect()
    coef = {r["_model"]: np.array(r["_coef"]).reshape(context.size, context.width) for r in packed}
    models = {}
    for e in encoders:
        if e[key] not in coef:
            models[e[key]] = None
            continue
        turn, own = np.zeros((raw.size, context.size)), shared.encoder_matrix(e)
        turn[0, 0] = 1.0
        for k in range(3):
            turn[1 + k * raw.width : 1 + (k + 1) * raw.width, 1 + k * context.width : 1 + (k + 1) * context.width] = own
        turn[1 + 3 * raw.width :, 1 + 3 * context.width :] = np.eye(2 * context.dim)
        # predictors and shared vector side by side give prediction less vector
        models[e[key]] = np.vstack((raw.lift @ (turn @ coef[e[key]]), -own)), e["n_features"]
    sent = flows.sparkSession.sparkContext.broadcast(models)
    prepared = window_partitions(shared.attach(flows), raw)
    kept = [*context.group, "flow_id", "label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, x, y in context_blocks(batches, raw):
            both, rows = np.hstack((x, y)), table.select(kept)
            for name, model in sent.value.items():
                score = np.full(len(y), np.nan) if model is None else ((both @ model[0]) ** 2).sum(axis=1) / model[1]
                named = rows.add_column(0, "model", pa.array([name] * len(y), pa.string()))
                yield from _with_columns(named, {"score": pa.array(score)})

    schema = prepared.select(F.lit("").alias("model"), *kept, F.lit(None).cast("double").alias("score")).schema
    return prepared.mapInArrow(run, schema)
