"""Language identification by prediction by partial matching (PPM).

Method: per language, a tree of byte contexts of up to three bytes.  A byte costs its
code length in the longest context in which it was seen; every longer context that was
seen without it first costs an escape (method C: t of n + t, for t different successors
in n occurrences), and below all contexts every byte is equally likely.  The statistics
are frozen: a text is scored with exact code lengths of all of its bytes, and the language
with the shortest code wins; equal lengths go to the first name.

All training rows are counted, as strings of four and three bytes, by Spark.  The size of the
model is a parameter: per language the strings of the highest counts are kept, down to the
smallest class of counts (sixteen classes for a factor of two) with which there are at most
`most` of them; a byte behind a string that was left out costs what an unseen one does.  Contexts
of two bytes and less are complete.  Languages are handled in blocks of LANGS, one pass over the texts each, so a
task holds one block's tables: at most LANGS * 2 * most strings, whatever the corpus.

Defined results: null texts and texts without a letter are `und` with score 0, as is every
text if nothing can be learned; rows with a null doc_id are never held out nor learned from.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowloom.llm.common import map_batches, remainder, slices, text_bytes
from flowloom.stage import materialize

ORDER = 3
#: Strings of each size that a language keeps at most, languages in one pass.
MOST, LANGS = 1 << 19, 8
_LETTER = re.compile(rb"[A-Za-z]")
_LEAD = b" " * ORDER


def codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the four-byte strings that end at every byte of every text, and where each text begins."""
    joined = np.frombuffer(b"".join(x for t in texts for x in (_LEAD, t)), np.uint8)
    size = max(0, len(joined) - ORDER)
    grams = np.zeros(size, np.uint32)
    for k in range(ORDER + 1):
        grams = grams << np.uint32(8) | joined[k : k + size]
    starts = np.cumsum([0] + [len(t) + ORDER for t in texts])
    # the strings that reach from one text into the lead of the next belong to neither
    keep = np.ones(len(grams), bool)
    for k in range(ORDER):
        cut = starts[1:-1] - ORDER + k
        keep[cut[cut < len(grams)]] = False
    return grams[keep], np.cumsum([0] + [len(t) for t in texts])[:-1]


_GRAMS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
#: Distinct strings that a task holds before it hands them on.
HELD = 1 << 21


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of (lang, text as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            grams, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(grams, kind="stable")
            grams = grams[order]
            first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
            return grams[first], np.add.reduceat(counts[order], first)

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                grams, counts = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(counts)], schema=_GRAMS)
            held.clear()

        for batch in slices(batches):
            langs, texts = (c.to_pylist() for c in batch.columns)
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(langs, texts, strict=True):
                if text:
                    by_lang.setdefault(lang, []).append(text)
            for lang, own in by_lang.items():
                grams = np.sort(codes(own)[0])
                first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
                held.setdefault(lang, []).append((grams[first], np.diff(np.r_[first, len(grams)])))
                size += len(first)
            if size >= HELD:
                held.update({lang: [merged(parts)] for lang, parts in held.items()})
                size = sum(len(parts[0][0]) for parts in held.values())
                if size >= HELD // 2:
                    yield from flush()
                    size = 0
        yield from flush()

    counted = labelled.mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Index:
    """Row of every key in a hash table of open addresses, made on first use in a process."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.table = keys, None
        self.bits = max(4, (4 * len(keys)).bit_length())

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435769)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def _make(self) -> None:
        self.table = np.full(1 << self.bits, -1, np.int32)
        rows, at = np.arange(len(self.keys)), self._slots(self.keys)
        while len(rows):
            free = np.flatnonzero(self.table[at] < 0)
            won = free[np.unique(at[free], return_index=True)[1]]
            self.table[at[won]] = rows[won]
            left = np.ones(len(rows), bool)
            left[won] = False
            rows, at = rows[left], (at[left] + 1) & len(self.table) - 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Rows of the keys, -1 for those that are not there."""
        if self.table is None:
            self._make()
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = self._slots(keys)
        rows = self.table[at]
        other = np.flatnonzero((rows >= 0) & (self.keys[rows] != keys))
        while len(other):
            at[other] = (at[other] + 1) & len(self.table) - 1
            found = self.table[at[other]]
            rows[other] = found
            other = other[(found >= 0) & (self.keys[found] != keys[other])]
        return rows


class Model:
    """Code lengths in bits, one column a language: of strings of four, three and two bytes, and of escapes behind three and two."""

    def __init__(self, langs: list[str], four: Index, bits4: np.ndarray, three: Index, bits3: np.ndarray, escape3: np.ndarray, bits2: np.ndarray, escape2: np.ndarray) -> None:
        self.langs, self.four, self.bits4, self.three, self.bits3, self.escape3, self.bits2, self.escape2 = langs, four, bits4, three, bits3, escape3, bits2, escape2

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length of every text in every language."""
        out = np.zeros((len(texts), len(self.langs)))
        filled = [k for k, t in enumerate(texts) if t]
        if not filled:
            return out
        grams, starts = codes([texts[k] for k in filled])
        at = self.four.find(grams)
        new = np.flatnonzero(at < 0)
        rest = grams[new] & np.uint32(0xFFFFFF)
        last, context = self.three.find(rest), self.three.find(grams[new] >> np.uint32(8))
        unseen = last < 0
        for k in range(0, len(self.langs), 4):
            some = slice(k, k + 4)
            cost = self.bits4[at, some]
            more = self.bits3[last, some]
            more[unseen] = self.escape2[rest[unseen] >> np.uint32(8), some] + self.bits2[rest[unseen] & np.uint32(0xFFFF), some]
            more += np.where((context >= 0)[:, None], self.escape3[context, some], 0)
            cost[new] = more
            out[filled, some] = np.add.reduceat(cost, starts, axis=0, dtype=np.float64)
        return out


def _dense(counts: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Method C for all strings of one size: bits of every (context, byte) and of the escape of every context."""
    table = counts.reshape(-1, 256)
    n, kinds = table.sum(1), (table > 0).sum(1)
    with np.errstate(divide="ignore"):
        escape = np.where(n > 0, np.log2(np.maximum(n + kinds, 1)) - np.log2(np.maximum(kinds, 1)), 0.0)
        own = np.log2(np.maximum(n + kinds, 1))[:, None] - np.log2(table)
    return np.where(table > 0, own, escape[:, None] + below.reshape(-1, 256)).reshape(-1), escape


def _sparse(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Method C for the strings that were seen (keys rising): their bits; contexts and the bits of their escapes."""
    contexts, first, at = np.unique(keys >> np.uint32(8), return_index=True, return_inverse=True)
    if not len(contexts):
        return np.zeros(0), contexts, np.zeros(0)
    total, kinds = np.add.reduceat(n, first), np.diff(np.r_[first, len(keys)])
    size = np.log2(total + kinds)
    return size[at] - np.log2(n), contexts, size - np.log2(kinds)


Counts = tuple[np.ndarray, np.ndarray]


def build(counts: list[tuple[str, Counts, Counts]]) -> Model:
    """From (language, strings of four bytes and their counts, strings of three bytes and theirs); keys rising."""

    def union(parts: list[np.ndarray]) -> np.ndarray:
        return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint32)

    four = Index(union([keys for _, (keys, _), _ in counts]))
    three = Index(union([k for _, (long, _), (keys, _) in counts for k in (keys, long >> np.uint32(8))]))
    size = len(counts)
    bits4, bits3, escape3 = (np.zeros((len(i.keys) or 1, size), np.float32) for i in (four, three, three))
    bits2, escape2 = np.zeros((1 << 16, size), np.float32), np.zeros((1 << 16, size), np.float32)
    for k, (_, (long, n4), (short, n3)) in enumerate(counts):
        pairs = np.bincount(short & np.uint32(0xFFFF), n3, 1 << 16)
        one, _ = _dense(pairs.reshape(256, 256).sum(0), np.full(256, 8.0))
        bits2[:, k], _ = _dense(pairs, np.tile(one, 256))
        own, contexts, escapes = _sparse(short, n3)
        escape2[contexts, k] = escapes
        bits3[:, k] = escape2[three.keys >> np.uint32(8), k] + bits2[three.keys & np.uint32(0xFFFF), k]
        bits3[np.searchsorted(three.keys, short), k] = own
        own, contexts, escapes = _sparse(long, n4)
        escape3[np.searchsorted(three.keys, contexts), k] = escapes
        behind, rest = (np.searchsorted(three.keys, x) for x in (four.keys >> np.uint32(8), four.keys & np.uint32(0xFFFFFF)))
        known = three.keys[np.minimum(rest, len(three.keys) - 1)] == four.keys & np.uint32(0xFFFFFF)
        lower = np.where(known, bits3[np.minimum(rest, len(three.keys) - 1), k], escape2[four.keys >> np.uint32(8) & np.uint32(0xFFFF), k] + bits2[four.keys & np.uint32(0xFFFF), k])
        bits4[:, k] = escape3[behind, k] + lower
        bits4[np.searchsorted(four.keys, long), k] = own
    return Model([lang for lang, _, _ in counts], four, bits4, three, bits3, escape3, bits2, escape2)


def _kept(table: DataFrame, most: int) -> DataFrame:
    """The strings of the highest classes of counts of every language, at most `most` of them."""
    graded = table.withColumn("grade", F.floor(F.log2("n") * 16).cast("int"))
    # some hundred classes a language
    sizes = graded.groupBy("lang", "grade").agg(F.count("*").alias("strings"))
    higher = Window.partitionBy("lang").orderBy(F.col("grade").desc())
    cuts = sizes.withColumn("held", F.sum("strings").over(higher)).filter(F.col("held") <= most).groupBy("lang").agg(F.min("grade").alias("least"))
    return graded.join(cuts, "lang").filter("grade >= least").select("lang", "gram", "n")


def _columns(table: DataFrame) -> Counts:
    """Strings, rising, and their counts of one language."""
    rows = table.select("gram", "n").toArrow()
    grams = rows["gram"].to_numpy()
    order = np.argsort(grams)
    return grams[order].astype(np.uint32), rows["n"].to_numpy()[order].astype(np.float64)


def models(labelled: DataFrame, most: int = MOST, langs: int = LANGS) -> Iterator[Model]:
    """Statistics of all rows of (lang, text as bytes), one model for each block of languages in the order of their names."""
    fours = materialize(gram_counts(labelled), "four-bytes")
    threes = materialize(fours.groupBy("lang", F.col("gram").bitwiseAND(F.lit(0xFFFFFF)).alias("gram")).agg(F.sum("n").alias("n")), "three-bytes")
    names = sorted(r.lang for r in threes.select("lang").distinct().collect())
    kept = [materialize(_kept(t, most), "kept-strings") for t in (fours, threes)]
    for k in range(0, len(names), langs):
        block = names[k : k + langs]
        yield build([(lang, *(_columns(t.filter(F.col("lang") == lang)) for t in kept)) for lang in block])


def has_letter(text: bytes) -> bool:
    return bool(_LETTER.search(text)) or not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace"))


_CODED = pa.schema([("row", pa.int64()), ("lang", pa.string()), ("bits", pa.float64()), ("others", pa.float64())])


def coded(texts: DataFrame, model: Model) -> DataFrame:
    """(row, lang, bits, others): the shortest code of every text in one block, and the sum of 2^(bits - length) over its languages."""
    sent = texts.sparkSession.sparkContext.broadcast(model)

    def start() -> Callable[[pa.RecordBatch], list]:
        own = sent.value

        def work(batch: pa.RecordBatch) -> list:
            lengths = own.lengths(batch.column(1).to_pylist())
            best = lengths.argmin(1)
            least = lengths.min(1)
            return [batch.column(0), [own.langs[k] for k in best], least, np.exp2(-np.minimum(lengths - least[:, None], 1000.0)).sum(1)]

        return work

    return map_batches(texts, _CODED, start)


_FOUND = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _one_block(rows: DataFrame, model: Model | None) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def start() -> Callable[[pa.RecordBatch], list]:
        own = sent.value

        def work(batch: pa.RecordBatch) -> list:
            texts = batch.column(2).to_pylist()
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            if own is not None:
                lengths = own.lengths(texts)
                best = lengths.argmin(1)
                share = 1.0 / np.exp2(-np.minimum(lengths - lengths.min(1, keepdims=True), 1000.0)).sum(1)
                for k, text in enumerate(texts):
                    if has_letter(text):
                        names[k], scores[k] = own.langs[best[k]], float(share[k])
            return [batch.column(0), batch.column(1), names, scores]

        return work

    return map_batches(rows, _FOUND, start)


def predict(rows: DataFrame, blocks: Iterator[Model]) -> DataFrame:
    """`rows`: doc_id, held_out, text as bytes.  One block of languages is one pass; the results of several meet by row."""
    first, second = next(blocks, None), next(blocks, None)
    if second is None:
        return _one_block(rows, first)
    written = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "texts")
    parts = [materialize(coded(written.select("row", "text"), m), "coded-texts") for m in chain([first, second], blocks)]
    least = F.min(F.struct("bits", "lang", "others"))
    every = reduce(DataFrame.unionByName, parts)
    best = every.groupBy("row").agg(least.alias("best"), F.collect_list(F.struct("bits", "others")).alias("all"))
    total = F.aggregate("all", F.lit(0.0), lambda sum_, x: sum_ + x["others"] * F.pow(F.lit(2.0), -F.least(x["bits"] - F.col("best.bits"), F.lit(1000.0))))
    lettered = F.col("text").cast("string").rlike("\\p{L}")
    joined = written.join(best, "row")
    return joined.select("doc_id", "held_out", F.when(lettered, F.col("best.lang")).otherwise("und").alias("lang_pred"), F.when(lettered, 1.0 / total).otherwise(0.0).alias("score"))


def language_id(docs: DataFrame, folds: int = 4, fold: int = 2, most: int = MOST, langs: int = LANGS) -> DataFrame:
    """Learns from the labelled rows outside the fold, predicts all rows."""
    held = remainder("doc_id", folds) == fold
    labelled = docs.filter(~held & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), text_bytes().alias("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held_out"), text_bytes().alias("text"))
    return predict(rows, models(labelled, most, langs))
