"""Rounds of federated fitting over per-client sums.

Flows are looked at once per client, for the sums of products of training and
validation windows.  A round is then a few gradient steps per client on its own cells, from the incoming
parameters, and an average of parameter rows.  The global parameters are as many numbers
as the model has, whatever the data and the number of clients: they go to the tasks as one
value.  Tables of clients have one row per parameter and client and are written every round.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators import federated as fed
from flowloom.operators import reconstruct as rec
from flowloom.operators.context import ContextSpec
from flowloom.operators.features import fit_encoder
from flowloom.operators.split import shard_cuts, shard_flows
from flowloom.operators.windows import window_list
from flowloom.plans.training import RunConfig, in_place, training_part, window_cuts
from flowloom.sources.state import RoundLog
from flowloom.stage import materialize, shared_dir, task_count

MEAN, SCALE = "encoder.batch_norm.running_mean", "encoder.batch_norm.running_scale"
BASIS, HEAD, COEF = "encoder.basis", "decoder.head", "decoder.coef"
PARAMETERS = "client string, key string, pos int, value double"
TRAIN_LOSS, VAL_LOSS, VAL_EDGES, WEIGHT = "metric.train_mse", "metric.val_mse", "metric.n_val_edges", "metric.weight"


@dataclass(frozen=True)
class FederatedConfig:
    """`mode` 'na', 'fedbn' or 'fedrep'; `mu` > 0 pulls local fits to the global parameters.

    A client takes `local_steps` gradient steps a round.  `penalty` is the least one; a client
    whose validation windows ask for more uses more (`own_penalties`).
    `clip` switches to clipped, noised aggregation with deviation sigma*clip/n.
    """

    rounds: int = 50
    mode: str = "na"
    mu: float = 0.0
    weighting: str = "equal"
    clip: float | None = None
    sigma: float = 0.0
    seed: int = 42
    penalty: float = 1e-3
    rank: int = 16
    local_steps: int = 10

    def __post_init__(self):
        if self.clip is not None and self.weighting != "equal":
            raise ValueError("clipping with noise needs equal client weights")


@dataclass
class FederatedResult:
    parameters: DataFrame
    private: DataFrame | None
    history: DataFrame
    norms: DataFrame


def _nothing(*columns: str) -> pd.DataFrame:
    """No rows; columns of objects become Arrow columns of any type."""
    return pd.DataFrame(columns=list(columns), dtype=object)


def _vectors(rows: pd.DataFrame) -> dict[str, np.ndarray]:
    return {k: p.sort_values("pos")["value"].to_numpy() for k, p in rows.groupby("key")}


def _long(client: str, values: dict[str, np.ndarray]) -> pd.DataFrame:
    parts = [
        pd.DataFrame({"client": client, "key": k, "pos": np.arange(v.size, dtype=np.int32), "value": np.ravel(v)})
        for k, v in values.items()
    ]
    return pd.concat(parts, ignore_index=True)


def _standardiser(mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Matrix that turns [1, x] into [1, (x - mean) / scale]."""
    safe = np.where(np.abs(scale) < 1e-9, 1.0, scale)
    a = np.diag(np.concatenate(([1.0], 1.0 / safe)))
    a[0, 1:] = -mean / safe
    return a


def _combined(values: dict[str, np.ndarray], size: int, width: int) -> np.ndarray:
    """Coefficients on plain predictors of a parameter set."""
    if COEF in values:
        inner = values[COEF].reshape(size, width)
    else:
        inner = values[BASIS].reshape(size, -1) @ values[HEAD].reshape(-1, width)
    return _standardiser(values[MEAN], values[SCALE]) @ inner


#: Penalties a client may choose from, relative to predictors of unit variance.
PENALTIES = (1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0)


def own_penalties(train_gram: DataFrame, val_gram: DataFrame, spec: ContextSpec) -> DataFrame:
    """(client, penalty): the one whose fit on the training sums has the least error on the validation sums.

    With few windows a context is nearly the target itself, and only a strong penalty keeps
    the fit from reading it back.  A client without validation windows takes the strongest.
    """

    def run(cells: pd.DataFrame, checks: pd.DataFrame) -> pd.DataFrame:
        if cells.empty:
            return _nothing("client", "penalty")
        best = PENALTIES[-1]
        if len(checks):
            gram, other = rec.gram_matrix(cells), rec.gram_matrix(checks)
            turn = _standardiser(*rec.predictor_moments(gram, spec.size))
            own = rec._in_basis(gram, turn, spec.size)
            errors = [rec.squared_error(other, turn @ rec.ridge(own, spec.size, p)) for p in PENALTIES]
            best = PENALTIES[int(np.argmin(errors))]
        return pd.DataFrame({"client": [str(cells["client"].iloc[0])], "penalty": [best]})

    pair = [_by_client(g) for g in (train_gram, val_gram)]
    return pair[0].cogroup(pair[1]).applyInPandas(run, "client string, penalty double")


def _by_client(rows: DataFrame):
    """Groups of clients, spread over an explicit number of tasks."""
    return rows.repartition(task_count(rows.sparkSession), "client").groupBy("client")


def _descend(start: np.ndarray, gradient, curvature: float, steps: int) -> np.ndarray:
    for _ in range(steps):
        start = start - gradient(start) / curvature
    return start


def local_fit(gram: np.ndarray, state: dict[str, np.ndarray], spec: ContextSpec, cfg: FederatedConfig, penalty: float) -> dict:
    """A client's parameters after its steps of one round, from its own sums and the incoming parameters."""
    size, width = spec.size, spec.width
    if not cfg.local_steps:
        return dict(state) | {TRAIN_LOSS: np.array([rec.squared_error(gram, _combined(state, size, width))])}
    mean, scale = rec.predictor_moments(gram, size)
    own = rec._in_basis(gram, _standardiser(mean, scale), size)
    xx, xy = own[:size, :size] / own[0, 0], own[:size, size:] / own[0, 0]
    largest = float(np.linalg.eigvalsh(xx)[-1])
    # derivative of (mu/2)|w - g|^2 next to a mean over flows and features
    pull = cfg.mu * width / 2.0
    out = {MEAN: mean, SCALE: scale}
    if cfg.mode == "fedrep":
        start = state[BASIS].reshape(size, -1)
        head = rec.ridge(rec._in_basis(own, start, size), start.shape[1], penalty)
        strength = head @ head.T
        out[HEAD] = head
        out[BASIS] = _descend(
            start,
            lambda b: (xx @ b @ strength - xy @ head.T) + (pull + penalty) * (b - start),
            largest * float(np.linalg.eigvalsh(strength)[-1]) + pull + penalty,
            cfg.local_steps,
        )
    else:
        start = state[COEF].reshape(size, width)
        weight = np.full((size, 1), penalty)
        weight[0] = 0.0
        out[COEF] = _descend(start, lambda w: xx @ w - xy + weight * w + pull * (w - start), largest + penalty + pull, cfg.local_steps)
    out[TRAIN_LOSS] = np.array([rec.squared_error(gram, _combined(out, size, width))])
    return out


def initial_parameters(spec: ContextSpec, cfg: FederatedConfig) -> dict[str, np.ndarray]:
    """Parameters every client starts from, made from the settings alone."""
    values = {MEAN: np.zeros(spec.size - 1), SCALE: np.ones(spec.size - 1)}
    if cfg.mode == "fedrep":
        drawn = np.random.RandomState(cfg.seed).standard_normal((spec.size, min(cfg.rank, spec.size)))
        values[BASIS] = np.linalg.qr(drawn)[0]
        values[HEAD] = np.zeros((values[BASIS].shape[1], spec.width))
    else:
        values[COEF] = np.zeros((spec.size, spec.width))
    return values


def shared_values(shared: DataFrame) -> dict[str, np.ndarray]:
    """The global parameters: as many numbers as the model has."""
    return _vectors(shared.toPandas())


def _with_private(rows: DataFrame, private: DataFrame | None, run) -> DataFrame:
    """`run(rows of a client, its private parameters)` for every client of `rows`."""
    grouped = _by_client(rows)
    if private is None:
        return grouped.applyInPandas(lambda own: run(own, {}), PARAMETERS)

    def both(own: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        return run(own, _vectors(kept)) if len(own) else _nothing("client", "key", "pos", "value")

    return grouped.cogroup(_by_client(private)).applyInPandas(both, PARAMETERS)


def _local_round(gram: DataFrame, shared: dict, private: DataFrame | None, spec: ContextSpec, cfg: FederatedConfig) -> DataFrame:
    def run(cells: pd.DataFrame, own: dict) -> pd.DataFrame:
        penalty = max(cfg.penalty, float(cells["penalty"].iloc[0])) if "penalty" in cells.columns else cfg.penalty
        return _long(str(cells["client"].iloc[0]), local_fit(rec.gram_matrix(cells), shared | own, spec, cfg, penalty))

    return _with_private(gram, private, run)


def _validate(gram: DataFrame, shared: dict, private: DataFrame | None, spec: ContextSpec) -> DataFrame:
    def run(cells: pd.DataFrame, own: dict) -> pd.DataFrame:
        sums = rec.gram_matrix(cells)
        loss = rec.squared_error(sums, _combined(shared | own, spec.size, spec.width))
        return _long(str(cells["client"].iloc[0]), {VAL_LOSS: np.array([loss]), VAL_EDGES: np.array([sums[0, 0]])})

    return _with_private(gram, private, run)


def federated_fit(
    train_gram: DataFrame, val_gram: DataFrame, weights: DataFrame, spec: ContextSpec, cfg: FederatedConfig, log: str | None = None
) -> FederatedResult:
    """All rounds; the last one is kept.

    `train_gram`, `val_gram`: sums per `client` (and the client's `penalty`); `weights`: (client, weight), the
    training windows of a client, used by 'examples'.  With `log`, a folder, every round is
    committed there and a run goes on after the last committed round of an earlier one with the
    same settings; the number of rounds may be raised.
    """
    spark = train_gram.sparkSession
    settings = {k: v for k, v in asdict(cfg).items() if k != "rounds"} | {"size": spec.size, "width": spec.width}
    rounds = RoundLog(spark, log or f"{shared_dir(spark)}/rounds-{uuid.uuid4().hex}", settings)
    start = _long("server", initial_parameters(spec, cfg)).drop(columns="client")
    shared = rounds.read(rounds.last, "parameters") if rounds.last else spark.createDataFrame(start, "key string, pos int, value double")
    values = shared_values(shared)
    private = rounds.read(rounds.last, "private") if rounds.last else None
    history = [rounds.read(n, "history") for n in range(1, min(rounds.last, cfg.rounds) + 1)]
    norms = [rounds.read(n, "norms") for n in range(1, min(rounds.last, cfg.rounds) + 1)]
    if rounds.last > cfg.rounds:
        raise ValueError(f"the log holds {rounds.last} rounds, more than the {cfg.rounds} asked for")
    is_metric = F.col("key").startswith("metric.")
    for number in range(rounds.last + 1, cfg.rounds + 1):
        local = materialize(_local_round(train_gram, values, private, spec, cfg), "local")
        updates = local.filter(~is_metric & fed.is_exchanged(cfg.mode)).join(weights, "client")
        own = local.filter(~is_metric & ~fed.is_exchanged(cfg.mode))
        private = None if cfg.mode == "na" else rounds.write(own, number, "private")
        base = shared.filter(fed.is_exchanged(cfg.mode))
        if cfg.clip is None:
            merged = fed.fed_average(updates, cfg.weighting, keys=())
        else:
            noise_seed = cfg.seed * 1_000_003 + number
            merged = fed.clip_and_noise(updates, base, cfg.clip, cfg.sigma, noise_seed, cfg.weighting, keys=())
        norms.append(rounds.write(fed.update_norms(updates, base, keys=()).withColumn("round", F.lit(number)), number, "norms"))
        # parameters that are never exchanged keep their first value in the global table
        kept = shared.filter(~fed.is_exchanged(cfg.mode))
        shared = rounds.write(merged.unionByName(kept), number, "parameters")
        values = shared_values(shared)
        measured = local.filter(is_metric).unionByName(_validate(val_gram, values, private, spec))
        history.append(rounds.write(measured.withColumn("round", F.lit(number)), number, "history"))
        rounds.commit(number)
    return FederatedResult(shared, private, _round_history(history), _all(norms))


def _all(parts: Sequence[DataFrame]) -> DataFrame:
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table


def _round_history(parts: Sequence[DataFrame]) -> DataFrame:
    """(round, silo, train_mse, val_mse, n_val_edges)."""

    def metric(key: str):
        return F.max(F.when(F.col("key") == key, F.col("value")))

    return _all(parts).groupBy("round", F.col("client").alias("silo")).agg(
        metric(TRAIN_LOSS).alias("train_mse"),
        metric(VAL_LOSS).alias("val_mse"),
        metric(VAL_EDGES).cast("bigint").alias("n_val_edges"),
    )


def federated_coefficients(shared: DataFrame, private: DataFrame | None, clients: DataFrame, spec: ContextSpec) -> DataFrame:
    """(model, i, coef) for scoring, per row of `clients` (column client): global parameters with the private ones on top."""
    values = shared_values(shared)

    def rows_of(client: str, own: dict) -> pd.DataFrame:
        return rec.coefficient_rows(client, _combined(values | own, spec.size, spec.width))

    named = _by_client(clients.select("client").distinct())
    if private is None:
        return named.applyInPandas(lambda c: rows_of(str(c["client"].iloc[0]), {}), rec.COEFFICIENTS)

    def both(c: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
        return rows_of(str(c["client"].iloc[0]), _vectors(kept)) if len(c) else _nothing("model", "i", "coef")

    return named.cogroup(_by_client(private)).applyInPandas(both, rec.COEFFICIENTS)


def held_out_coefficients(shared: DataFrame, val_gram: DataFrame, spec: ContextSpec) -> DataFrame:
    """Coefficients for silos that were no clients: the normalisation is re-estimated on their own
    benign validation windows, everything else is global."""

    def moments(cells: pd.DataFrame) -> pd.DataFrame:
        mean, scale = rec.predictor_moments(rec.gram_matrix(cells), spec.size)
        return _long(str(cells["client"].iloc[0]), {MEAN: mean, SCALE: scale})

    own = materialize(_by_client(val_gram).applyInPandas(moments, PARAMETERS), "moments")
    return federated_coefficients(shared, own, own, spec)


@dataclass
class Clients:
    """Local preparation of every client: encoder, sums of both parts, training windows."""

    encoder: DataFrame
    train_gram: DataFrame
    val_gram: DataFrame
    weights: DataFrame


def prepare_clients(flows: DataFrame, cfg: RunConfig, shards: int = 1) -> Clients:
    """Every silo fits its own scaler and vocabularies, filled to one width; nothing is pooled.

    With `shards`, a silo's windows are dealt to clients '<silo>#<k>', which share its encoder.
    """
    keyed = flows.withColumn("enc", F.col("silo"))
    encoder = materialize(fit_encoder(keyed, cfg.features, ["enc"], padded=True), "encoder")

    cuts = window_cuts(flows, cfg)
    sizes = flows.groupBy("silo").agg(F.max("n_rows").alias("n_rows"))
    if shards > 1:
        # another seed than the split's: else the last shard would hold all validation windows
        ends = shard_cuts(window_list(sizes, ["silo"], cfg.window, cfg.step), ["silo"], shards, cfg.seed + 1)

    def sums(part: str) -> DataFrame:
        edges = training_part(flows, encoder, cuts, cfg, False, part)
        if shards > 1:
            named, flat = F.concat_ws("#", "silo", "shard"), edges
            edges = in_place([ends], cfg, lambda state: shard_flows(flat, state, ["silo"], cfg.seed + 1).withColumn("model", named).drop("shard"))
        gram = rec.gram_sums(edges, cfg.context, "model")
        return materialize(gram.withColumnRenamed("model", "client"), "gram")

    train, val = sums("train"), sums("val")
    flows_of = train.filter("i = 0 and j = 0")
    weights = materialize(flows_of.select("client", F.round(F.col("value") / cfg.window).cast("long").alias("weight")), "weights")
    penalties = materialize(own_penalties(train, val, cfg.context), "penalties")
    return Clients(encoder, materialize(train.join(penalties, "client"), "gram"), val, weights)
