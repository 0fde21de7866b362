"""Linear reconstruction of flow vectors: sums, fits, scores.

A fit needs only the sums of products of predictors and targets.  They are
added up inside tasks, then by a Spark aggregate per key, so flow rows never
leave the tasks and every model variant below is a small solve per key on one
set of sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators.context import (
    INPUT, ContextSpec, _rows, _with_columns, context_blocks, matrix, window_partitions,
)
from flowloom.stage import materialize, task_count


def gram_sums(edges: DataFrame, spec: ContextSpec, key: str) -> DataFrame:
    """(key, i, j, value): sums of products of the entries i <= j of [predictors, targets] per key."""
    prepared = window_partitions(edges, spec)
    total = spec.size + spec.width
    # from the entries with coordinates to those with vectors; the targets stay
    lift = np.eye(len(spec.lift) + spec.width, total, spec.size - len(spec.lift))
    lift[: len(spec.lift)] = 0.0
    lift[: len(spec.lift), : spec.size] = spec.lift

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for table, x, y in context_blocks(batches, spec):
            both = np.hstack((x, y))
            codes = table[key].combine_chunks().dictionary_encode()
            which = codes.indices.to_numpy()
            for code, name in enumerate(codes.dictionary.to_pylist()):
                rows = both[which == code]
                sums[name] = sums.get(name, 0) + rows.T @ rows
        for name, reduced in sums.items():
            m = lift.T @ reduced @ lift
            # the matrix is symmetric: row i starts at its diagonal entry
            ends = np.concatenate(([0], np.cumsum(np.arange(total, 0, -1)))).astype(np.int32)
            upper = pa.ListArray.from_arrays(pa.array(ends), pa.array(m[np.triu_indices(total)]))
            i = pa.array(np.arange(total, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array([name] * total), i, upper], [key, "i", "sums"])

    partial = prepared.mapInArrow(run, f"{key} string, i int, sums array<double>")
    cells = partial.select(key, "i", F.posexplode("sums").alias("k", "value"))
    cells = cells.select(key, "i", (F.col("i") + F.col("k")).alias("j"), "value")
    return cells.groupBy(key, "i", "j").agg(F.sum("value").alias("value"))


def gram_matrix(rows: pd.DataFrame, column: str = "value") -> np.ndarray:
    """Cells of one key as the full symmetric matrix."""
    size = int(rows["i"].max()) + 1
    gram = np.zeros((size, size))
    gram[rows["i"], rows["j"]] = rows[column]
    gram[rows["j"], rows["i"]] = rows[column]
    return gram


def ridge(gram: np.ndarray, size: int, penalty: float, towards: np.ndarray | None = None, pull: float = 0.0):
    """Coefficients (size x width) of the penalised least squares fit.

    `penalty` is relative to the number of flows and spares the constant; `pull`
    shrinks towards the coefficients `towards`.
    """
    n = max(gram[0, 0], 1.0)
    xx, xy = gram[:size, :size] / n, gram[:size, size:] / n
    weight = np.full(size, penalty)
    weight[0] = min(penalty, 1e-9)
    if towards is not None:
        xx, xy = xx + pull * np.eye(size), xy + pull * towards
    return np.linalg.solve(xx + np.diag(weight), xy)


COEFFICIENTS = "model string, i int, coef array<double>"


def coefficient_rows(model: str, coef: np.ndarray) -> pd.DataFrame:
    """Coefficients of one model as rows, one per predictor."""
    return pd.DataFrame({"model": model, "i": np.arange(len(coef), dtype=np.int32), "coef": list(coef)})


def pooled_sums(gram: DataFrame, name: str = "combined") -> DataFrame:
    """Sums over all keys: pooling silos needs no further look at flows."""
    return gram.groupBy("i", "j").agg(F.sum("value").alias("value")).withColumn("model", F.lit(name))


def solve_by_key(gram: DataFrame, key: str, solve: Callable[[np.ndarray, np.ndarray | None], np.ndarray]) -> DataFrame:
    """One small solve per key: (model, i, coef).

    A group is one cell per pair of predictors and targets, so its size follows
    from the model and not from the data.  The second argument of `solve` is the
    pooled matrix if `gram` carries it as `pooled`.
    """

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        shared = gram_matrix(cells, "pooled") if "pooled" in cells.columns else None
        return coefficient_rows(str(cells[key].iloc[0]), solve(gram_matrix(cells), shared))

    return gram.repartition(task_count(gram.sparkSession), key).groupBy(key).applyInPandas(run, COEFFICIENTS)


def _with_pooled(gram: DataFrame) -> DataFrame:
    pooled = materialize(pooled_sums(gram).select("i", "j", F.col("value").alias("pooled")), "pooled")
    return gram.join(pooled, ["i", "j"])


def fit_reconstruction(gram: DataFrame, spec: ContextSpec, key: str = "model", penalty: float = 1e-3) -> DataFrame:
    """Own ridge fit per key."""
    return solve_by_key(gram, key, lambda own, _: ridge(own, spec.size, penalty))


def fit_combined(gram: DataFrame, spec: ContextSpec, penalty: float = 1e-3) -> DataFrame:
    """One fit for all keys, under the name 'combined'."""
    return fit_reconstruction(pooled_sums(gram), spec, "model", penalty)


def shared_basis(pooled: np.ndarray, size: int, rank: int) -> np.ndarray:
    """The constant and the leading principal directions of the pooled predictors."""
    mean = pooled[0, 1:size] / pooled[0, 0]
    covariance = pooled[1:size, 1:size] / pooled[0, 0] - np.outer(mean, mean)
    _, directions = np.linalg.eigh(covariance)
    basis = np.zeros((size, min(rank, size - 1) + 1))
    basis[0, 0] = 1.0
    basis[1:, 1:] = directions[:, ::-1][:, : basis.shape[1] - 1]
    return basis


def _in_basis(gram: np.ndarray, basis: np.ndarray, size: int) -> np.ndarray:
    """Sums of products after projecting the predictors on the basis."""
    lift = np.zeros((gram.shape[0], basis.shape[1] + gram.shape[0] - size))
    lift[:size, : basis.shape[1]] = basis
    lift[size:, basis.shape[1] :] = np.eye(gram.shape[0] - size)
    return lift.T @ gram @ lift


def _driver_matrix(pooled: DataFrame) -> np.ndarray:
    """Pooled sums as a matrix: as many numbers as the model has, whatever the data."""
    return gram_matrix(pooled.toPandas())


def fit_heads(gram: DataFrame, spec: ContextSpec, basis: np.ndarray, penalty: float = 1e-3) -> DataFrame:
    """Own head per key on a given basis; the result is the product of both."""

    def solve(own: np.ndarray, _: np.ndarray | None) -> np.ndarray:
        return basis @ ridge(_in_basis(own, basis, spec.size), basis.shape[1], penalty)

    return solve_by_key(gram, "model", solve)


def _basis_gradient(gram: DataFrame, spec: ContextSpec, basis: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Gradient of all keys' errors with respect to the basis, each with its own best head, and its curvature."""
    size = spec.size

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        own = gram_matrix(cells)
        xx, xy = own[:size, :size], own[:size, size:]
        head = ridge(_in_basis(own, basis, size), basis.shape[1], penalty)
        strength = head @ head.T
        slope = xx @ basis @ strength - xy @ head.T
        curvature = float(np.linalg.eigvalsh(xx)[-1] * np.linalg.eigvalsh(strength)[-1])
        return pd.DataFrame({"i": np.repeat(np.arange(size), slope.shape[1]), "j": np.tile(np.arange(slope.shape[1]), size), "slope": slope.ravel(), "curvature": curvature})

    rows = gram.repartition(task_count(gram.sparkSession), "model").groupBy("model").applyInPandas(run, "i int, j int, slope double, curvature double")
    total = rows.groupBy("i", "j").agg(F.sum("slope").alias("slope"), F.sum("curvature").alias("curvature")).toPandas()
    slope = np.zeros_like(basis)
    slope[total["i"], total["j"]] = total["slope"]
    return slope, float(total["curvature"].max())


def fit_personalised(gram: DataFrame, spec: ContextSpec, rank: int = 32, penalty: float = 1e-3, rounds: int = 3) -> DataFrame:
    """Shared basis and own heads, fitted together: from the pooled principal directions, the basis
    takes `rounds` gradient steps over all keys' sums, between which every key solves for its head."""
    basis = shared_basis(_driver_matrix(pooled_sums(gram)), spec.size, rank)
    for _ in range(rounds):
        slope, curvature = _basis_gradient(gram, spec, basis, penalty)
        basis = basis - slope / max(curvature, 1e-12)
    return fit_heads(gram, spec, basis, penalty)


BASIS = "i int, directions array<double>"


def pooled_basis(gram: DataFrame, spec: ContextSpec, rank: int = 32, penalty: float = 1e-3) -> DataFrame:
    """First stage of the frozen modes: the constant and the leading directions of the pooled coefficients, as rows."""
    coef = ridge(_driver_matrix(pooled_sums(gram)), spec.size, penalty)
    left, strength, _ = np.linalg.svd(coef[1:], full_matrices=False)
    kept = left[:, : min(rank, int((strength > 1e-9 * max(strength[0], 1e-30)).sum()))]
    basis = np.zeros((spec.size, kept.shape[1] + 1))
    basis[0, 0], basis[1:, 1:] = 1.0, kept
    return gram.sparkSession.createDataFrame(pd.DataFrame({"i": np.arange(spec.size, dtype=np.int32), "directions": [r.tolist() for r in basis]}), BASIS)


def basis_matrix(rows: DataFrame) -> np.ndarray:
    return np.vstack(rows.toPandas().sort_values("i")["directions"].to_list())


def fit_frozen(gram: DataFrame, spec: ContextSpec, basis: np.ndarray, how: str = "plain", penalty: float = 1e-3) -> DataFrame:
    """Second stage: own heads on a frozen basis.

    'adabn' first brings the predictors of a key to the pooled mean and deviation; 'fedbn'
    also trains a scale per predictor, in turn with the head.
    """
    size = spec.size

    def plain(own: np.ndarray) -> np.ndarray:
        return basis @ ridge(_in_basis(own, basis, size), basis.shape[1], penalty)

    def adabn(own: np.ndarray, pooled: np.ndarray) -> np.ndarray:
        mine, base = predictor_moments(own, size), predictor_moments(pooled, size)
        ratio = np.where(mine[1] < 1e-9, 1.0, base[1] / np.where(mine[1] < 1e-9, 1.0, mine[1]))
        turn = np.diag(np.concatenate(([1.0], ratio)))
        turn[0, 1:] = base[0] - mine[0] * ratio
        return turn @ plain(_in_basis(own, turn, size))

    def fedbn(own: np.ndarray, _: np.ndarray) -> np.ndarray:
        n = own[0, 0]
        xx, xy = own[:size, :size] / n, own[:size, size:] / n
        scale = np.ones(size)
        for _round in range(2):
            inner = plain(_in_basis(own, np.diag(scale), size))
            # the prediction is linear in the scales; they are held near one
            a = xx * (inner @ inner.T) + penalty * np.eye(size)
            scale = np.linalg.solve(a, (xy * inner).sum(1) + penalty)
        return np.diag(scale) @ plain(_in_basis(own, np.diag(scale), size))

    if how == "plain":
        return solve_by_key(gram, "model", lambda own, _: plain(own))
    return solve_by_key(_with_pooled(gram), "model", {"adabn": adabn, "fedbn": fedbn}[how])


def predictor_moments(gram: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the predictors except the constant."""
    mean = gram[0, 1:size] / gram[0, 0]
    var = np.diag(gram)[1:size] / gram[0, 0] - mean**2
    return mean, np.sqrt(np.maximum(var, 0.0))


def renormalised(shared: np.ndarray, own: tuple, base: tuple) -> np.ndarray:
    """Shared coefficients for a key whose predictors are first brought to the base mean and deviation."""
    ratio = np.where(own[1] < 1e-9, 1.0, base[1] / np.where(own[1] < 1e-9, 1.0, own[1]))
    coef = shared.copy()
    coef[1:] = shared[1:] * ratio[:, None]
    coef[0] = shared[0] + (base[0] - own[0] * ratio) @ shared[1:]
    return coef


def fit_adapted(gram: DataFrame, spec: ContextSpec, how: str, penalty: float = 1e-3) -> DataFrame:
    """Shared fit, adapted per key.

    'adabn' re-estimates the normalisation of the predictors per key; 'fedbn'
    fits a scale and an offset per target on top of the shared prediction.
    """
    size = spec.size

    def solve(own: np.ndarray, pooled: np.ndarray) -> np.ndarray:
        shared = ridge(pooled, size, penalty)
        if how == "adabn":
            return renormalised(shared, predictor_moments(own, size), predictor_moments(pooled, size))
        n, xx, xy = own[0, 0], own[:size, :size], own[:size, size:]
        mean_p, mean_y = shared.T @ xx[0] / n, xy[0] / n
        cross = np.einsum("ij,ij->j", shared, xy) / n - mean_p * mean_y
        spread = np.einsum("ij,ik,kj->j", shared, xx, shared) / n - mean_p**2
        scale = np.where(spread < 1e-12, 1.0, cross / np.where(spread < 1e-12, 1.0, spread))
        coef = shared * scale
        coef[0] += mean_y - scale * mean_p
        return coef

    if how not in ("adabn", "fedbn"):
        raise ValueError(how)
    return solve_by_key(_with_pooled(gram), "model", solve)


def squared_error(gram: np.ndarray, coef: np.ndarray) -> float:
    """Mean squared error per element of a model on the flows behind the sums."""
    size = len(coef)
    xx, xy, yy = gram[:size, :size], gram[:size, size:], np.diag(gram)[size:]
    total = yy.sum() - 2.0 * np.sum(coef * xy) + np.sum(coef * (xx @ coef))
    return float(total / (gram[0, 0] * coef.shape[1]))


def packed_models(coefficients: DataFrame, name: str) -> DataFrame:
    """One row per model: `name` and the flat coefficients."""
    rows = coefficients.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("i", "coef"))).alias("c"))
    return rows.select(F.col("model").alias(name), F.flatten(F.transform("c", lambda p: p["coef"])).alias("_coef"))


#: Most bytes of coefficients that go to the tasks as one value.
MODEL_BYTES = 1 << 26


def score_flows(edges: DataFrame, coefficients: DataFrame, spec: ContextSpec, model: str = "model", most: int = MODEL_BYTES) -> DataFrame:
    """(group, flow_id, label, score): mean squared difference of the vector and its prediction.

    Models of at most `most` bytes together are sent to the tasks.  More of them are joined to the first
    flow of every window, which carries the coefficients into the task that holds the window,
    so any number of models may be used and a task holds those it meets.
    One row per flow and window it lies in; NaN if its model is unknown.  The mean runs over the real features
    of the model, so filled vocabulary slots (always 0, predicted as 0) do not count.
    """
    models = materialize(packed_models(coefficients, "_model"), "models")
    sent = None
    if models.count() * spec.size * spec.width * 8 <= most:
        known = {r["_model"]: np.array(r["_coef"]).reshape(spec.size, spec.width) for r in models.toLocalIterator()}
        sent = edges.sparkSession.sparkContext.broadcast(known)
        prepared = window_partitions(edges, spec)
    else:
        # the other flows get keys that match no model and lie spread
        spread = F.concat(F.lit("\0"), F.pmod(F.xxhash64("flow_id"), F.lit(1009)).cast("string"))
        own = edges.withColumn("_model", F.when(F.col("pos_in_window") == 0, F.col(model)).otherwise(spread))
        # the join may shuffle, so that windows have to be put together again
        spec = replace(spec, rows=None)
        prepared = window_partitions(own.join(models, "_model", "left"), spec, (*INPUT, "_coef"))
    kept = [*spec.group, "flow_id", "label"]
    lift = spec.lift

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, x, y in context_blocks(batches, spec):
            codes = table[model].combine_chunks().dictionary_encode()
            which = codes.indices.to_numpy()
            error = np.full(len(y), np.nan)
            for code, name in enumerate(codes.dictionary.to_pylist()):
                rows = np.flatnonzero(which == code)
                if sent is not None:
                    coef = sent.value.get(name)
                else:
                    found = table["_coef"].combine_chunks().take(pa.array(rows)).drop_null()
                    coef = found[0].values.to_numpy().reshape(spec.size, spec.width) if len(found) else None
                if coef is not None:
                    error[rows] = ((x[rows] @ (lift @ coef) - y[rows]) ** 2).sum(axis=1)
            score = error / table["n_features"].to_numpy()
            yield from _with_columns(table.select(kept), {"score": pa.array(score)})

    schema = prepared.select(*kept, F.lit(None).cast("double").alias("score")).schema
    return prepared.mapInArrow(run, schema)


def model_matrix(coefficients: DataFrame, model: str) -> np.ndarray:
    """Coefficients of one model (spec.size rows)."""
    rows = coefficients.filter(F.col("model") == model).toPandas().sort_values("i")
    return np.vstack([np.asarray(v, dtype=float) for v in rows["coef"]])


def score_predictors(rows: DataFrame, coef: np.ndarray, spec: ContextSpec) -> DataFrame:
    """Scores under one model of rows that carry `predictors`, `features` and `n_features`."""
    kept = [*spec.group, "flow_id", "label"]
    sent = rows.sparkSession.sparkContext.broadcast(coef)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            x, y = matrix(table["predictors"], spec.size), matrix(table["features"], spec.width)
            error = ((x @ sent.value - y) ** 2).sum(axis=1)
            yield from _with_columns(table.select(kept), {"score": pa.array(error / table["n_features"].to_numpy())})

    schema = rows.select(*kept, F.lit(None).cast("double").alias("score")).schema
    return rows.select(*kept, "n_features", "features", "predictors").mapInArrow(run, schema)


def validation_mse(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Squared error over all elements; every flow of a key has the same number of elements."""
    return scores.groupBy(*keys).agg(F.avg("score").alias("val_mse"), F.count(F.lit(1)).alias("n_edges"))
