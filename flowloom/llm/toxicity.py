"""Toxicity by compression distance.

Method: two zstandard dictionaries.  The ordinary one is trained on windows of ordinary
texts.  The toxic one holds the same content and, before it, the words that toxic
texts have far more often than ordinary ones (log-likelihood ratio, over whole words and
word beginnings), so that a window that holds one of them, and no other window, gets
shorter.  A text is cut into windows of eight words; the differences of the two compressed
lengths (mean, largest, largest three, shares above two thresholds) are weighed by a
logistic fit, and the threshold of the best F1 on rows that were not used for the
dictionaries becomes the score 0.7.

The fit uses a bounded sample: SAMPLE_ROWS rows or SAMPLE_BYTES bytes of labelled text,
chosen by a hash of doc_id.  Near copies in it count once.  Every text is scored whole.

Defined results: null and empty texts are one empty window; without toxic and ordinary
labels every score is 0; rows with a null doc_id or label teach nothing; of repeated
labels of one doc_id the largest counts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import LOWER_ASCII, map_batches, remainder, text_bytes

SAMPLE_ROWS, SAMPLE_BYTES, TRAINING_WINDOWS = 12_000, 48_000_000, 200_000
WINDOW_WORDS, LEVEL = 8, 5
COMMON_BYTES, TOXIC_BYTES = 8192, 4096
PREFIX = 5
#: Least log-likelihood ratio, least holders and least ratio of shares of a word of the toxic dictionary.
EVIDENCE, HOLDERS, RATIO = 25.0, 4, 3.0
CUT = 0.7
_FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in LOWER_ASCII)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def windows(words: list[bytes]) -> list[bytes]:
    return [b" %b " % b" ".join(words[k : k + WINDOW_WORDS]) for k in range(0, len(words), WINDOW_WORDS)] or [b"  "]


def first_of_copies(texts: list[bytes]) -> list[bool]:
    """False for texts that share one of four minima of five-word window hashes with an earlier text."""
    seen: set[tuple[int, int]] = set()
    out = []
    for text in texts:
        words = words_of(text)
        grams = np.array([crc32(b" ".join(words[k : k + 5])) for k in range(max(1, len(words) - 4))], np.uint64)
        marks = {(k, int((grams * np.uint64(m) & np.uint64(0xFFFFFFFF)).min())) for k, m in enumerate((1, 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35))}
        out.append(not marks & seen)
        seen |= marks
    return out


def telling_words(texts: list[bytes], toxic: list[int]) -> list[bytes]:
    """Words that toxic texts have far more often, the most frequent last (nearest to the window)."""
    yes: Counter = Counter()
    no: Counter = Counter()
    # words that no toxic text has can't be telling, so they are not counted
    for label in (1, 0):
        for text, own_label in zip(texts, toxic, strict=True):
            if own_label == label:
                own = set(words_of(text))
                own |= {w[:PREFIX] + b"*" for w in own if len(w) >= PREFIX}
                (yes if label else no).update(own if label else own & yes.keys())
    n_yes, n_no = sum(toxic), len(toxic) - sum(toxic)
    share = n_yes / max(1, n_yes + n_no)

    def evidence(key: bytes) -> float:
        a, b = yes[key], no[key]
        p = a / (a + b)
        if p <= share or a < HOLDERS:
            return 0.0
        return 2 * (a * math.log(p / share) + (b * math.log((1 - p) / (1 - share)) if b else 0.0))

    found = {k for k in yes if evidence(k) > EVIDENCE and yes[k] * n_no > RATIO * no[k] * n_yes}
    own = [w for w in yes if not w.endswith(b"*") and (w in found or w[:PREFIX] + b"*" in found) and yes[w] * n_no > RATIO * no[w] * n_yes]
    return sorted(own, key=lambda w: (yes[w], w))


@dataclass
class Model:
    common: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def compressors(self):
        import zstandard as zs

        made = []
        for content in (self.common, self.toxic + self.common):
            held = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
            made.append(zs.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False))
        return made

    def score(self, features: np.ndarray) -> np.ndarray:
        """1 / (1 + e^-z), where the calibrated threshold lies at CUT."""
        z = (features - self.mean) / self.scale @ self.weights[1:] + self.weights[0] - self.cut + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def features(words: list[bytes], pair) -> list[float]:
    ordinary, toxic = pair
    gains = np.array([len(ordinary.compress(w)) - len(toxic.compress(w)) for w in windows(words)], float)
    top = np.sort(gains)[-3:]
    return [gains.mean(), gains.max(), top.mean(), (gains >= 4).mean(), (gains >= 6).mean(), math.log(len(gains))]


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; both classes weigh the same."""
    x = np.c_[np.ones(len(x)), x]
    per = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    ridge = np.diag([0.0] + [penalty] * (x.shape[1] - 1))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (per * p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (per * (p - y)) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """Middle of the gap below the score at which F1 is largest; the higher one of equals."""
    order = np.argsort(-z, kind="stable")
    z, hits = z[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(z) + 1) + y.sum())
    f1[:-1][z[:-1] == z[1:]] = -1  # equal scores stay together
    k = int(f1.argmax())
    return float((z[k] + z[k + 1]) / 2 if k + 1 < len(z) else z[k] - 1e-6)


def build(rows: list[tuple[int, bytes, int]]) -> Model | None:
    """From (doc_id, text, toxic) of the sample; the order of the rows does not matter."""
    import zstandard as zs

    rows = sorted((crc32(str(i).encode()), t, int(y), i) for i, t, y in rows)
    learn = [(t, y) for k, (_, t, y, _) in enumerate(rows) if k % 3]
    learn = [x for x, first in zip(learn, first_of_copies([t for t, _ in learn]), strict=True) if first]
    check = [(t, y) for k, (_, t, y, _) in enumerate(rows) if k % 3 == 0]
    if len({y for _, y in learn}) < 2 or len({y for _, y in check}) < 2:
        return None
    telling = telling_words([t for t, _ in learn], [y for _, y in learn])
    plain = list(islice((x for t, y in learn if not y for x in windows(words_of(t))), TRAINING_WINDOWS))
    try:
        common = zs.train_dictionary(COMMON_BYTES, plain, k=64, d=6).as_bytes()[-COMMON_BYTES + 256 :]
    except zs.ZstdError:  # too little text to train on
        common = b"".join(plain)[-COMMON_BYTES:]
    model = Model(common, b" %b " % b" ".join(telling)[-TOXIC_BYTES:], np.zeros(6), np.ones(6), np.zeros(7), 0.0)
    pair = model.compressors()
    x, y = np.array([features(words_of(t), pair) for t, _ in check]), np.array([y for _, y in check], float)
    model.mean, model.scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    scaled = (x - model.mean) / model.scale
    model.weights = logistic(scaled, y)
    model.cut = best_cut(np.c_[np.ones(len(x)), scaled] @ model.weights, y)
    return model


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1) -> Model | None:
    """From the labelled rows outside the fold; the sample comes to the driver."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.filter(remainder("doc_id", folds) != fold)
    own = F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")
    rows, size = docs.select("doc_id", own).join(known, "doc_id", "left_semi").agg(F.count("*"), F.sum("size")).first()
    part = min(1.0, SAMPLE_ROWS / max(1, rows), SAMPLE_BYTES / max(1, size or 0))
    # the hash decides before the join, so that only the sample's texts are shuffled
    chosen = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(part * (1 << 30)))
    sample = chosen.select("doc_id", text_bytes().alias("text")).join(known, "doc_id").limit(2 * SAMPLE_ROWS).toArrow()
    ids, texts, marks = (sample.column(c).to_pylist() for c in ("doc_id", "text", "toxic"))
    del sample
    return build(list(zip(ids, texts, marks, strict=True)))


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `docs`."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, folds, fold))

    def start() -> Callable[[pa.RecordBatch], list]:
        model = sent.value
        pair = model.compressors() if model else None

        def work(batch: pa.RecordBatch) -> list:
            texts = batch.column(2).to_pylist()
            if model is None or not texts:
                return [batch.column(0), batch.column(1), [0.0] * len(texts)]
            found = np.array([features(words_of(t), pair) for t in texts])
            return [batch.column(0), batch.column(1), model.score(found)]

        return work

    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(remainder("doc_id", folds) == fold, F.lit(False)).alias("held_out"),
        text_bytes().alias("text"),
    )
    return map_batches(slim, _SCORES, start).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
