"""From flow tables to scored holdouts: the batch runs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators import evaluate, reconstruct
from flowloom.operators.context import ContextSpec
from flowloom.operators.features import encode, fit_encoder
from flowloom.operators.prefix import prefix_index
from flowloom.operators.split import split_cuts, split_flows
from flowloom.operators.transfer import crossed_scores
from flowloom.operators.windows import aligned_prefix_index, coverage, row_windows, window_list
from flowloom.sources.flows import LABEL, FeatureSpec, benign_only, drop_incomplete
from flowloom.stage import materialize, small


@dataclass(frozen=True)
class RunConfig:
    """Settings of a run.  `window`, `step` count flows; `dim` is the size of a node vector."""

    features: FeatureSpec = field(default_factory=FeatureSpec)
    window: int = 1000
    step: int = 1000
    dim: int = 32
    train_ratio: float = 0.8
    seed: int = 42
    penalty: float = 1e-3
    rank: int = 32
    quantiles: Sequence[float] = evaluate.CALIBRATION_QUANTILES
    max_train_rows: int | None = None
    max_holdout_rows: int | None = None

    @property
    def aligned(self) -> bool:
        """Windows that do not overlap are laid whole into the files of the index."""
        return self.step >= self.window

    @property
    def context(self) -> ContextSpec:
        return ContextSpec(("model", "silo", "window_id"), self.features.width, self.dim, rows=self.window if self.aligned else None)


# How a run shares: (encoder fitted on all silos together, fit).
MODES = (
    "per_silo", "combined", "personalised", "personalised_frozen", "personalised_frozen_adabn", "personalised_frozen_fedbn",
    "combined_adabn", "combined_fedbn",
)


@dataclass
class Prepared:
    """What all modes with the same encoder share: one look at the flows."""

    encoder: DataFrame
    cuts: DataFrame
    gram: DataFrame


@dataclass
class Training:
    """What a run has learnt; tables are small and written."""

    mode: str
    config: RunConfig
    encoder: DataFrame
    cuts: DataFrame
    gram: DataFrame
    coefficients: DataFrame
    thresholds: DataFrame | None = None

    @property
    def shared_encoder(self) -> bool:
        return self.mode != "per_silo"


def ordered_flows(rows: DataFrame, order: Sequence[str], split: str | None, cfg: RunConfig) -> DataFrame:
    """Rows of one split (or of all) with `flow_id` and `n_rows` per silo, in file order, in an aligned index.

    Training rows are capped first, then reduced to complete benign rows and
    numbered again; other rows are only capped.
    """
    part = rows.filter(F.col("split") == split) if split else rows
    cap = cfg.max_train_rows if split == "train" else cfg.max_holdout_rows
    if cap:
        part = prefix_index(part, ["silo"], order, name="file_pos", total=None).filter(F.col("file_pos") < cap)
    if split == "train":
        part = drop_incomplete(benign_only(part))
    if cfg.aligned:
        return aligned_prefix_index(part, ["silo"], order, cfg.step, name="flow_id")
    return prefix_index(part, ["silo"], order, name="flow_id")


def in_place(states: Sequence[DataFrame], cfg: RunConfig, join: Callable[..., DataFrame]) -> DataFrame:
    """`join(*states)`, where every state has about one row a silo.

    Windows of an aligned index stay whole if the states are broadcast, which their size
    decides; if one is too large, the windows are put together again after the joins.
    """
    hinted = [small(s) for s in states]
    if not cfg.aligned or all(h is not None for h in hinted):
        return join(*[s if h is None else h for s, h in zip(states, hinted, strict=True)])
    whole = ["silo", "window_id"]
    return join(*states).repartition(*whole).sortWithinPartitions(*whole, "pos_in_window")


def encoded(windowed: DataFrame, encoder: DataFrame, cfg: RunConfig, shared: bool) -> DataFrame:
    """Encoded windowed flows with `model` (whose coefficients they use) and `label`."""
    keyed = windowed.withColumn("enc", F.lit("all") if shared else F.col("silo"))
    out = encode(keyed, encoder, cfg.features, ["enc"])
    return out.withColumns({"model": F.col("silo"), "label": F.col(LABEL).cast("int")})


def encoded_windows(flows: DataFrame, encoder: DataFrame, cfg: RunConfig, shared: bool) -> DataFrame:
    windowed = row_windows(flows, cfg.window, cfg.step, pos="flow_id")
    return in_place([encoder], cfg, lambda state: encoded(windowed, state, cfg, shared))


def prepare(flows: DataFrame, cfg: RunConfig, shared: bool, cuts: DataFrame | None = None) -> Prepared:
    """Encoder, cuts and sums of benign training flows (`ordered_flows` + flow columns)."""
    keyed = flows.withColumn("enc", F.lit("all") if shared else F.col("silo"))
    encoder = materialize(fit_encoder(keyed, cfg.features, ["enc"]), "encoder")
    cuts = cuts or window_cuts(flows, cfg)
    train = training_part(flows, encoder, cuts, cfg, shared, "train")
    return Prepared(encoder, cuts, materialize(reconstruct.gram_sums(train, cfg.context, "model"), "gram"))


def fit(flows: DataFrame, cfg: RunConfig, mode: str, prepared: Prepared | None = None) -> Training:
    """Fit one mode; `prepared` (of the same kind of encoder) saves the look at the flows."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; choices: {MODES}")
    ready = prepared or prepare(flows, cfg, mode != "per_silo")
    coefficients = materialize(fit_coefficients(ready.gram, cfg, mode), "coefficients")
    return Training(mode, cfg, ready.encoder, ready.cuts, ready.gram, coefficients)


def fit_all(flows: DataFrame, cfg: RunConfig, modes: Sequence[str] = MODES) -> dict[str, Training]:
    """All modes from one preparation per kind of encoder."""
    ready: dict[bool, Prepared] = {}
    out = {}
    for mode in modes:
        shared = mode != "per_silo"
        if shared not in ready:
            ready[shared] = prepare(flows, cfg, shared, next((p.cuts for p in ready.values()), None))
        out[mode] = fit(flows, cfg, mode, ready[shared])
    return out


def fit_coefficients(gram: DataFrame, cfg: RunConfig, mode: str) -> DataFrame:
    """Coefficients of every mode from one table of sums."""
    spec = cfg.context
    if mode == "per_silo":
        return reconstruct.fit_reconstruction(gram, spec, "model", cfg.penalty)
    if mode == "combined":
        return reconstruct.fit_combined(gram, spec, cfg.penalty)
    if mode == "personalised":
        return reconstruct.fit_personalised(gram, spec, cfg.rank, cfg.penalty)
    if mode.startswith("personalised_frozen"):
        # the first stage is stored and read again, as a run that resumes from it would
        stored = materialize(reconstruct.pooled_basis(gram, spec, cfg.rank, cfg.penalty), "basis")
        how = mode.removeprefix("personalised_frozen").lstrip("_") or "plain"
        return reconstruct.fit_frozen(gram, spec, reconstruct.basis_matrix(stored), how, cfg.penalty)
    return reconstruct.fit_adapted(gram, spec, mode.removeprefix("combined_"), cfg.penalty)


def window_cuts(flows: DataFrame, cfg: RunConfig) -> DataFrame:
    """Where the hash order of a silo's windows turns from training to validation."""
    sizes = flows.groupBy("silo").agg(F.max("n_rows").alias("n_rows"))
    return split_cuts(window_list(sizes, ["silo"], cfg.window, cfg.step), ["silo"], cfg.train_ratio, cfg.seed)


def training_part(
    flows: DataFrame, encoder: DataFrame, cuts: DataFrame, cfg: RunConfig, shared: bool, part: str
) -> DataFrame:
    """Encoded windows of the training or validation part; the split is decided before the encoding."""
    windowed = row_windows(flows, cfg.window, cfg.step, pos="flow_id")

    def chosen(ends: DataFrame, state: DataFrame) -> DataFrame:
        return encoded(split_flows(windowed, ends, ["silo"], cfg.seed).filter(F.col("part") == part), state, cfg, shared)

    return in_place([cuts, encoder], cfg, chosen)


def _named_model(edges: DataFrame, mode: str) -> DataFrame:
    return edges.withColumn("model", F.lit("combined")) if mode == "combined" else edges


def calibrate(flows: DataFrame, training: Training) -> Training:
    """Thresholds: quantiles of the scores of benign validation windows (per silo, or pooled for 'combined')."""
    cfg = training.config
    edges = training_part(flows, training.encoder, training.cuts, cfg, training.shared_encoder, "val")
    scores = reconstruct.score_flows(_named_model(edges, training.mode), training.coefficients, cfg.context)
    training.thresholds = materialize(evaluate.exact_quantiles(scores, ["model"], "score", cfg.quantiles), "thresholds")
    return training


def score_holdout(flows: DataFrame, training: Training) -> DataFrame:
    """(model, silo, window_id, flow_id, label, score), one row per flow and window it lies in."""
    cfg = training.config
    edges = encoded_windows(flows, training.encoder, cfg, training.shared_encoder)
    return reconstruct.score_flows(_named_model(edges, training.mode), training.coefficients, cfg.context)


def unscored(flows: DataFrame, cfg: RunConfig) -> DataFrame:
    """(silo, n_rows, n_windows, n_covered, n_uncovered): how many flows of `score_holdout`'s input get no score."""
    return coverage(flows.groupBy("silo").agg(F.max("n_rows").alias("n_rows")), ["silo"], cfg.window, cfg.step)


def evaluate_holdout(scores: DataFrame, training: Training, pooled: bool = False) -> tuple[DataFrame, DataFrame]:
    """(metrics, sweep) per silo, and for all silos together if `pooled`; the flows are looked at once."""
    keys = ["model", "silo"]
    counts = materialize(evaluate.score_counts(scores, keys), "counts")
    if pooled:
        counts = evaluate.pooled_counts(counts, keys)
    models = counts.select(*keys).distinct()
    thresholds = models.join(training.thresholds, "model").select("silo", "quantile", "threshold").distinct()
    counts = materialize(evaluate.score_counts(evaluate.scrub_scores(counts, ["silo"]), ["silo"]), "counts")
    found = materialize(evaluate.metrics(counts, ["silo"]), "metrics")
    return found, evaluate.threshold_sweep(counts, thresholds, ["silo"], found)


def flow_scores(scores: DataFrame, how: str = "max") -> DataFrame:
    """One score per flow when windows overlap: the largest or the mean."""
    pick = {"max": F.max, "avg": F.avg}[how]
    return scores.groupBy("silo", "flow_id").agg(pick("score").alias("score"), F.max("label").alias("label"))


def transfer_scores(holdout: DataFrame, training: Training) -> DataFrame:
    """Holdout scores under every silo's own encoder and model: `model` is the training silo.

    The silos are those of the encoder table; window graphs are built once for all of them.
    """
    cfg = training.config
    windowed = row_windows(holdout, cfg.window, cfg.step, pos="flow_id")
    spec = replace(cfg.context, group=("silo", "window_id"))
    return crossed_scores(windowed, training.encoder, training.coefficients, cfg.features, spec)


def transfer_matrix(scores: DataFrame) -> DataFrame:
    """(train_silo, test_silo, metrics, is_home)."""
    table = evaluate.metrics(scores.withColumnRenamed("silo", "test_silo").withColumnRenamed("model", "train_silo"), ["train_silo", "test_silo"])
    return table.withColumn("is_home", F.col("train_silo") == F.col("test_silo"))
