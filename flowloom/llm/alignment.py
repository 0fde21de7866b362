"""Cross-tokenizer alignment: how two vocabularies cut the same texts, each distinct text once.

Method: rows are grouped by their whole text, so every distinct text is encoded and aligned
once, by both tokenizers, however many copies it has.  Tokens are laid on the bytes of the
text (a blank before it included): offsets where tokens of both sides end cut them into
groups, and the pieces between all ends are the links, one for each pair of tokens that
overlap.  The number of documents that hold a pair of ids linked is a sum over distinct texts
weighted by their copies.  That table (bounded by the two vocabularies, not by the corpus) is
read in blocks of at most BLOCK_PAIRS pairs, cut between ids of the first vocabulary; every
block is held against the pairs of all texts and the blocks' measures are added.  Measures go
back to the documents by a digest of the text: texts that more than a thousandth of all
rows share (so fewer than a thousand) by a broadcast, the others by a shuffle.

Long texts are encoded in parts cut at a blank between two letters.  The first vocabulary
starts a new piece there, and no entry of the second holds a blank behind another character
(checked), so tokens never reach across such a cut.

Defined results: texts that are null, empty, or that either side does not give back byte for
byte have no tokens: zeros and an empty string; repeated rows count as so many documents and
get equal results each; an empty table gives an empty result; a null doc_id is kept.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator
from functools import cache, reduce
from hashlib import sha256
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import map_batches
from flowloom.llm.packing import byte_letters
from flowloom.stage import materialize

#: Most pairs of one block of the count table (one id's pairs beyond that, at most the second vocabulary).
BLOCK_PAIRS = 4_000_000
#: Distinct pairs that a task holds before it hands them on, and characters in one part of a long text.
HELD, PART_CHARS = 1 << 21, 1 << 15
#: Texts with more than one in so many rows go back to their documents by broadcast.
HOT = 1000
_SAFE = re.compile(r"(?<=[a-zA-ZÀ-ÖØ-öø-ÿ]) (?=[a-zA-ZÀ-ÖØ-öø-ÿ])")
#: Characters for which the rank form of the first vocabulary is the tokenizer itself (compared in the tests).
_PLAIN = re.compile(r"[\t\n\r\x20-\x7EÀ-ÿ]*")


class Side:
    """Ids of a text with a blank before it, and the bytes of every id."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.pieces = pieces
        self.sizes = np.array([len(p) for p in pieces], np.int64)

    def ids(self, parts: list[str]) -> list[int]:
        raise NotImplementedError

    def joined(self, ids: list[int]) -> bytes:
        return b"".join([self.pieces[k] for k in ids])


class ByteLevel(Side):
    """A byte-level vocabulary (.json); special strings inside texts are plain text."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        letters = byte_letters()
        names = [self.whole.id_to_token(k) for k in range(self.whole.get_vocab_size())]
        super().__init__([bytes(letters.get(c, 0) for c in name) for name in names])
        file, self.ranks = Path(path).with_suffix(".tiktoken"), None
        if file.exists():
            import public_tokenizers

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.read_bytes().splitlines())}
            self.ranks = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for part in parts:
            if self.ranks is not None and _PLAIN.fullmatch(part):
                out += self.ranks.encode_ordinary(f" {part}")
            else:
                out += self.whole.encode(f" {part}", add_special_tokens=False).ids
        return out


class Pieces(Side):
    """A vocabulary of pieces (.model) that puts the blank before the text itself."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.whole = SentencePieceProcessor(model_file=path)
        names = [self.whole.id_to_piece(k) for k in range(self.whole.get_piece_size())]
        super().__init__([bytes([int(n[3:5], 16)]) if self.whole.is_byte(k) else n.replace("▁", " ").encode() for k, n in enumerate(names)])
        #: No entry holds a blank behind another character, so a blank behind a letter begins a new token.
        self.cuts = not any(re.search("[^▁]▁", n) for n in names)

    def ids(self, parts: list[str]) -> list[int]:
        return [k for own in self.whole.encode(parts, num_threads=1) for k in own]


class Pair:
    """Both sides, and names of ids with the sign behind them."""

    def __init__(self, byte_level: str, pieces: str) -> None:
        self.a, self.b = ByteLevel(byte_level), Pieces(pieces)
        self.width = max(len(self.a.pieces), len(self.b.pieces))
        self.names = np.array([f"{k}{sign}" for sign in (",", "|", ";", "") for k in range(self.width)], object)

    def parts(self, text: str) -> list[str]:
        """Parts of a text; the blank between two of them is the one before the later one."""
        out, start = [], 0
        while self.b.cuts and len(text) - start > PART_CHARS:
            cut = _SAFE.search(text, start + PART_CHARS)
            if cut is None:
                break
            out.append(text[start : cut.start()])
            start = cut.end()
        return [*out, text[start:]]

    def align(self, text: str) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups, n_links, digest of the groups, linked pairs of ids (a * len(b) + b) and how often."""
        none = 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not text:
            return none
        parts = self.parts(text)
        a_ids, b_ids = self.a.ids(parts), self.b.ids(parts)
        whole = b" " + text.encode()
        if self.a.joined(a_ids) != whole or self.b.joined(b_ids) != whole:
            return none
        a, b = np.array(a_ids, np.int64), np.array(b_ids, np.int64)
        a_ends, b_ends = np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b])
        # both end lists rise strictly, so an end of the union that stands twice is common
        every = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")
        again = every[1:] == every[:-1]
        common, ends = every[1:][again], every[np.r_[True, ~again]]
        pairs, times = np.unique(a[np.searchsorted(a_ends, ends)] * len(self.b.pieces) + b[np.searchsorted(b_ends, ends)], return_counts=True)
        # tokens in the order of their groups, those of a before those of b
        at = np.concatenate([2 * np.searchsorted(common, a_ends), 2 * np.searchsorted(common, b_ends) + 1])
        order = np.argsort(at, kind="stable")
        at = at[order]
        sign = np.r_[np.where(at[1:] == at[:-1], 0, np.where(at[:-1] % 2 == 0, 1, 2)), 3]
        listed = "".join(self.names[np.concatenate([a, b])[order] + self.width * sign])
        return len(a), len(b), len(common), len(ends), sha256(listed.encode()).hexdigest(), pairs, times


@cache
def pair(byte_level: str, pieces: str) -> Pair:
    return Pair(byte_level, pieces)


_MEASURES = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]
_ALIGNED = pa.schema([("key", pa.binary()), ("n_docs", pa.int64()), *_MEASURES, ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])
_SCORED = pa.schema([("key", pa.binary()), ("n_docs", pa.int64()), *_MEASURES, ("n_best", pa.int64()), ("count_sum", pa.int64())])


def digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def aligned_texts(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """One row per distinct text, written: digest, number of rows, measures, distinct linked pairs and how often."""
    distinct = docs.select(F.coalesce("text", F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("n_docs"))

    def start() -> Callable[[pa.RecordBatch], list]:
        sides = pair(byte_level, pieces)

        def work(batch: pa.RecordBatch) -> list:
            found = [sides.align(t) for t in batch.column(2).to_pylist()]
            return [batch.column(0), batch.column(1), *([f[k] for f in found] for k in range(7))]

        return work

    return materialize(map_batches(distinct.select(digest().alias("key"), "n_docs", "text"), _ALIGNED, start), "aligned-texts")


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pairs, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(pairs, kind="stable")
    pairs = pairs[order]
    first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
    return pairs[first], np.add.reduceat(counts[order], first)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): the documents that hold a pair linked, written; tasks add up their own pairs first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            pairs = batch.column(1)
            widths = pairs.value_lengths().to_numpy()
            held.append((pairs.flatten().to_numpy(), np.repeat(batch.column(0).to_numpy(), widths)))
            size += int(widths.sum())
            if size >= HELD:
                held = [_summed(held)]
                size = len(held[0][0])
                if size >= HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], names=["pair", "n"])
                    held, size = [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _summed(held)], names=["pair", "n"])

    parts = aligned.select("n_docs", "pairs").mapInArrow(run, "pair long, n long")
    return materialize(parts.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")


def id_ranges(sizes: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """(first, last) ids of blocks; `sizes`: pairs of every id, ids rising."""
    out: list[list[int]] = []
    room = 0
    for k, n in sizes:
        if not out or n > room:
            out.append([k, k])
            room = most
        out[-1][1] = k
        room -= n
    return [(a, b) for a, b in out]


def _scored(aligned: DataFrame, counts: DataFrame, first: int, last: int, width: int) -> DataFrame:
    """Measures of all texts with the pairs of the ids first .. last."""
    block = counts.filter(F.col("pair").between(first * width, (last + 1) * width - 1)).orderBy("pair").toArrow()
    known, n = block["pair"].to_numpy(), block["n"].to_numpy()
    best = np.zeros(last - first + 1, np.int64)
    np.maximum.at(best, known // width - first, n)
    sent = aligned.sparkSession.sparkContext.broadcast((known, n, best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = sent.value
        for batch in batches:
            lists, times = batch.column(7), batch.column(8).flatten().to_numpy()
            pairs, row = lists.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            own = (pairs >= first * width) & (pairs < (last + 1) * width)
            pairs, times, row = pairs[own], times[own], row[own]
            docs = n[np.searchsorted(known, pairs)]
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            np.add.at(sums[0], row, np.where(docs == best[pairs // width - first], times, 0))
            np.add.at(sums[1], row, docs * times)
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], *map(pa.array, sums)], schema=_SCORED)

    fields = "key binary, n_docs long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return aligned.mapInArrow(run, fields)


def measures(docs: DataFrame, byte_level: str, pieces: str, block: int = BLOCK_PAIRS) -> DataFrame:
    """One row per distinct text, written: digest, number of rows and all measures."""
    aligned = aligned_texts(docs, byte_level, pieces)
    counts = pair_counts(aligned)
    width = len(pair(byte_level, pieces).b.pieces)
    # one row an id of the first vocabulary
    sizes = counts.groupBy(F.floor(F.col("pair") / width).cast("long").alias("id")).agg(F.count("*").alias("n")).collect()
    ranges = id_ranges(sorted((r.id, r.n) for r in sizes), block) or [(0, 0)]
    scored = [_scored(aligned, counts, first, last, width) for first, last in ranges]
    if len(scored) > 1:
        sums = [F.sum(c).alias(c) for c in ("n_best", "count_sum")]
        same = [f.name for f in _SCORED if f.name not in ("n_best", "count_sum")]
        scored = [reduce(DataFrame.unionByName, scored).groupBy(*same).agg(*sums)]
    return materialize(scored[0], "alignment-measures")


def alignment(docs: DataFrame, byte_level: str, pieces: str, block: int = BLOCK_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of `docs`."""
    found = measures(docs, byte_level, pieces, block)
    keyed = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest().alias("key")), "text-keys")
    total = found.agg(F.sum("n_docs")).first()[0] or 0
    often = F.col("n_docs") * HOT > total
    # fewer than HOT texts can be more than one in HOT rows
    hot = F.broadcast(found.filter(often))
    few = keyed.join(hot.select("key"), "key", "left_anti").join(found.filter(~often).hint("merge"), "key")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return keyed.join(hot, "key").select(columns).unionByName(few.select(columns))
