"""Packing of token sequences by linear grouping.

Lengths are whole numbers up to the capacity, so the whole packing is planned on the
number of pieces of each length (at most `capacity` numbers, whatever the corpus), and the
plan is a list of bin classes: so many bins with these lengths each.

Method (after de la Vega and Lueker): large lengths are sorted and cut into groups of equal
cardinality, and each is rounded up to the largest of its group.  With few sizes left, the
number of bins of every configuration is optimised by column generation: prices come from
the linear program over the known configurations, and a knapsack finds a better one until
there is none.  Configurations get whole numbers of bins by rounding down, the rest is
packed best fit by decreasing size.  Then actual pieces take the places of the rounded
ones, largest first, and the small pieces go, largest first, into the bins where they leave
the least room.

Every piece gets its number within its length by counts per written part, and looks up
sequence and offset in the plan: nothing of document size meets in one task.

Defined results: null and empty texts are the end mark alone; repeated rows are packed as
so many documents; an empty table has no sequences.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from flowloom.llm.common import map_batches, text_bytes
from flowloom.stage import materialize, task_count

CAPACITY, END = 4096, 1
#: Lengths from this part of the capacity on are large; numbers of groups of which the best plan is taken.
LARGE, GROUPS = 1 / 4, (8, 16, 32)
#: Words whose ids a task remembers, and words in one call of the encoder.
REMEMBERED, CALL_WORDS = 400_000, 20_000

# ---- token ids


class WordIds:
    """Ids of a tokenizer that drops white space: those of a text are those of its blank-separated words in a row.

    Words of Latin-1 letters, digits and ASCII signs are cut by the pattern of the vocabulary and
    merged by their ranks; a word with any other character goes to the tokenizer itself.
    """

    # The piece pattern of the vocabulary, for the characters that `_PLAIN` lets through.
    _PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
    _PLAIN = re.compile(r"[\x21-\x7eÀ-ÿ]+")
    # The same pattern for ASCII words one to a line.
    _LINES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9\n]+")

    def __init__(self, path: str) -> None:
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        special = {t.content for t in self.whole.get_added_tokens_decoder().values()}
        suffix = model["end_of_word_suffix"]
        byte_of = byte_letters()
        # the mark of a word's end is a zero byte, which `_PLAIN` keeps out of the words
        ranks = {}
        for token, number in model["vocab"].items():
            if token not in special:
                ends = token.endswith(suffix)
                body = token.removesuffix(suffix) if ends else token
                ranks[bytes(byte_of[c] for c in body) + b"\0" * ends] = number
        self.special = tuple(special)
        # what `_LINES` must not see: control characters and special strings
        self.odd = re.compile("|".join([r"[\x00-\x09\x0b-\x1f\x7f]", *map(re.escape, self.special)]))
        self.ranks = tiktoken.Encoding("words", pat_str=r"[^\x00]*\x00", mergeable_ranks=ranks, special_tokens={})
        self.last = np.zeros(max(ranks.values()) + 1, bool)
        self.last[[n for token, n in ranks.items() if token.endswith(b"\0")]] = True
        self.known: dict[bytes, bytes] = {}

    def word(self, word: bytes) -> bytes:
        """Ids of one word by the tokenizer itself."""
        return np.array(self.whole.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: set[bytes]) -> None:
        """Remembers the ids of unknown words; up to CALL_WORDS plain ones go into one call of the encoder."""
        ascii_words = [w for w in words if w.isascii()]
        single = [w for w in words if not w.isascii()] if len(ascii_words) < len(words) else []
        for k in range(0, len(ascii_words), CALL_WORDS):
            call = ascii_words[k : k + CALL_WORDS]
            lines = b"\n".join([*call, b""]).decode()
            if self.odd.search(lines):
                single += call
                continue
            marked = self._LINES.sub("\\g<0>\0", lines.lower())
            signs = np.frombuffer(marked.encode(), np.uint8)
            self.remember(call, marked.replace("\n", ""), np.cumsum(signs == 0)[signs == 10])
        plain: list[tuple[bytes, list[str]]] = []
        for word in single:
            text = word.decode("utf-8", "replace")
            if self._PLAIN.fullmatch(text) and not any(s in text for s in self.special):
                plain.append((word, self._PIECE.findall(text.lower())))
            else:
                self.known[word] = self.word(word)
        for k in range(0, len(plain), CALL_WORDS):
            call = plain[k : k + CALL_WORDS]
            self.remember([w for w, _ in call], "".join([f"{p}\0" for _, own in call for p in own]), np.cumsum([len(own) for _, own in call]))

    def remember(self, words: list[bytes], marked: str, pieces: np.ndarray) -> None:
        """Ids of words from one call: `marked` has their pieces, each with its zero byte, `pieces` how many up to each word's end."""
        ids = self.ranks.encode_to_numpy(marked).astype("<u4")
        # every piece ends with the one token that holds its zero byte
        ends = (4 * (np.flatnonzero(self.last[ids]) + 1)[pieces - 1]).tolist()
        whole = ids.tobytes()
        self.known.update(zip(words, [whole[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))

    def batch(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text."""
        split = [t.split() for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.learn(set().union(*split) - self.known.keys())
        known = self.known
        return [b"".join([known[w] for w in words]) for words in split]

    def __call__(self, text: bytes) -> bytes:
        return self.batch([text])[0]


def byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in byte-level vocabularies: printable Latin-1 as itself, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every row, and the ids themselves if asked."""
    schema = pa.schema([*_PIECES, *([("ids", pa.list_(pa.int32()))] if ids else [])])

    def start() -> Callable[[pa.RecordBatch], list]:
        encode = word_ids(tokenizer)
        end = np.array([END], "<u4").tobytes()

        def work(batch: pa.RecordBatch) -> list:
            out: list[list] = [[] for _ in schema]
            for doc, whole in zip(batch.column(0).to_pylist(), encode.batch(batch.column(1).to_pylist()), strict=True):
                whole += end
                for k, a in enumerate(range(0, len(whole), 4 * capacity)):
                    part = whole[a : a + 4 * capacity]
                    row = [doc, k, a // 4, len(part) // 4, zlib.crc32(part)]
                    for column, value in zip(out, row + [np.frombuffer(part, "<i4")] * ids, strict=True):
                        column.append(value)
            return out

        return work

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return map_batches(slim, schema, start)


# ---- plan over the numbers of lengths

Bin = tuple[tuple[int, int], ...]  # (length, how many), lengths falling


def round_up(counts: dict[int, int], groups: int) -> list[tuple[int, int]]:
    """(largest length, cardinality) of groups of equal cardinality, lengths falling.

    A group takes the next ceil(n / groups) pieces in falling order; the number of groups is
    also bounded by the number of different lengths.
    """
    total = sum(counts.values())
    if len(counts) <= groups:
        return sorted(counts.items(), reverse=True)
    share = -(-total // groups)
    out: list[tuple[int, int]] = []
    room = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append((length, 0))
                room = share
            take = min(left, room)
            out[-1] = (out[-1][0], out[-1][1] + take)
            left, room = left - take, room - take
    merged: dict[int, int] = defaultdict(int)
    for length, n in out:
        merged[length] += n
    return sorted(merged.items(), reverse=True)


def _best_configuration(sizes: np.ndarray, prices: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """Unbounded-by-time knapsack: the configuration of the greatest price, at most `most` of each size."""
    value = np.zeros(capacity + 1)
    taken: list[np.ndarray] = []
    for size, price, limit in zip(sizes, prices, most, strict=True):
        count = np.zeros(capacity + 1, np.int16)
        best = value.copy()
        for n in range(1, int(min(limit, capacity // size)) + 1):
            tried = np.full(capacity + 1, -1.0)
            tried[n * size :] = value[: capacity + 1 - n * size] + n * price
            better = tried > best + 1e-12
            best[better], count[better] = tried[better], n
        value = best
        taken.append(count)
    room, chosen = capacity, np.zeros(len(sizes), np.int64)
    for k in range(len(sizes) - 1, -1, -1):
        chosen[k] = taken[k][room]
        room -= chosen[k] * sizes[k]
    return chosen


def configurations(groups: list[tuple[int, int]], capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """(how many of each size, bins): column generation with a revised simplex, bins rounded down."""
    sizes, need = np.array([s for s, _ in groups]), np.array([n for _, n in groups], float)
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(m))
        fresh = _best_configuration(sizes, np.maximum(prices, 0), need, capacity).astype(float)
        if prices @ fresh <= 1 + 1e-9:
            break
        bins, way = np.linalg.solve(basis, need), np.linalg.solve(basis, fresh)
        steps = np.where(way > 1e-9, bins / np.where(way > 1e-9, way, 1), np.inf)
        if not np.isfinite(steps).any():
            break
        basis[:, int(steps.argmin())] = fresh
    bins = np.floor(np.maximum(np.linalg.solve(basis, need), 0) + 1e-9).astype(np.int64)
    left = need.astype(np.int64)
    out = []
    for k in np.argsort(-bins, kind="stable"):
        column = basis[:, k].astype(np.int64)
        used = column > 0
        n = int(min(bins[k], (left[used] // column[used]).min())) if used.any() else 0
        if n:
            out.append((column, n))
            left -= column * n
    return out


class Bins:
    """Classes of bins by room left; equal bins are one class."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.rooms: list[int] = []  # sorted rooms with a class
        self.at: dict[int, list[list]] = {}

    def add(self, room: int, content: tuple[int, ...], n: int) -> None:
        if n:
            if room not in self.at:
                self.at[room] = []
                self.rooms.insert(bisect_right(self.rooms, room), room)
            self.at[room].append([content, n])

    def best_fit(self, length: int, n: int) -> None:
        """Puts n pieces, as many as fit at once, where the least room is left; opens bins when none has room."""
        while n:
            k = bisect_right(self.rooms, length - 1)
            if k == len(self.rooms):
                each = min(n, self.capacity // length)
                bins = n // each
                self.add(self.capacity - each * length, (length,) * each, bins)
                n -= bins * each
                continue
            room = self.rooms[k]
            content, bins = self.at[room].pop()
            if not self.at[room]:
                del self.at[room]
                self.rooms.pop(k)
            each = min(n, room // length)
            used = min(bins, n // each)
            self.add(room, content, bins - used)
            self.add(room - each * length, content + (length,) * each, used)
            n -= used * each


def pack(counts: dict[int, int], capacity: int = CAPACITY, large: float = LARGE, groups: tuple[int, ...] = GROUPS) -> list[tuple[tuple[int, ...], int]]:
    """Bin classes (lengths, bins) that hold exactly `counts` pieces of each length, for the best number of groups."""
    plans = [_pack(counts, capacity, large, n) for n in groups]
    return min(plans, key=lambda classes: sum(n for _, n in classes))


def _pack(counts: dict[int, int], capacity: int, large: float, groups: int) -> list[tuple[tuple[int, ...], int]]:
    bins = Bins(capacity)
    big = {s: n for s, n in counts.items() if large * capacity <= s < capacity and n}
    if counts.get(capacity):
        bins.add(0, (capacity,), counts[capacity])
    if big:
        sizes = round_up(big, groups)
        queue = {s: [] for s, _ in sizes}  # the actual lengths of every group, largest first
        left = sorted(big.items(), reverse=True)
        for size, n in sizes:
            while n:
                length, there = left[0]
                take = min(n, there)
                queue[size].append([length, take])
                n -= take
                left[0] = (length, there - take)
                if there == take:
                    left.pop(0)
        for column, n in configurations(sizes, capacity):
            while n:
                # as many equal bins as the runs of actual lengths allow
                content: list[int] = []
                run = n
                drawn: dict[int, list] = {}
                for (size, _), k in zip(sizes, column.tolist(), strict=True):
                    if not k:
                        continue
                    length, there = queue[size][0]
                    if there >= k:
                        run = min(run, there // k)
                        drawn[size] = [(length, k)]
                    else:  # one bin across the end of a run
                        run, parts, want = 1, [], k
                        for length, there in queue[size]:
                            take = min(want, there)
                            parts.append((length, take))
                            want -= take
                            if not want:
                                break
                        drawn[size] = parts
                for size, parts in drawn.items():
                    for length, k in parts:
                        content += [length] * k
                        queue[size][0][1] -= k * run
                        if not queue[size][0][1]:
                            queue[size].pop(0)
                bins.add(capacity - sum(content), tuple(content), run)
                n -= run
        rest: dict[int, int] = defaultdict(int)
        for runs in queue.values():
            for length, n in runs:
                rest[length] += n
        for length in sorted(rest, reverse=True):
            bins.best_fit(length, rest[length])
    for length in sorted((s for s in counts if s < large * capacity), reverse=True):
        bins.best_fit(length, counts[length])
    return [(tuple(content), n) for room in bins.rooms for content, n in bins.at[room]]


def slots(classes: list[tuple[tuple[int, ...], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For every length: (first number, per bin, first sequence, offset in the bin) of each run of equal bins, in order."""
    out: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    given: dict[int, int] = defaultdict(int)
    sequence = 0
    for content, bins in classes:
        offset = 0
        k = 0
        while k < len(content):
            length, each = content[k], 1
            while k + each < len(content) and content[k + each] == length:
                each += 1
            out[length].append((given[length], each, sequence, offset))
            given[length] += each * bins
            offset += each * length
            k += each
        sequence += bins
    return dict(out)


def place(runs: list[tuple[int, int, int, int]], firsts: list[int], length: int, number: int) -> tuple[int, int]:
    """Sequence and offset of the piece with this number among the pieces of this length."""
    first, each, sequence, offset = runs[bisect_right(firsts, number) - 1]
    return sequence + (number - first) // each, offset + (number - first) % each * length


# ---- assignment


#: Pieces in one part of the numbering, where that makes more parts than the session has shuffle partitions.
PART_ROWS = 1_000_000


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece (and ids if asked)."""
    cut = materialize(pieces(docs, tokenizer, capacity, ids).withColumn("row", F.monotonically_increasing_id()), "pieces")
    # a length that many pieces have is numbered in all parts at once
    parts = max(task_count(cut.sparkSession), cut.count() // PART_ROWS)
    part = F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")
    slim = cut.select("row", "length", part.alias("part"))
    counts = materialize(slim.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    # at most `capacity` numbers
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    sent = docs.sparkSession.sparkContext.broadcast(slots(pack(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "length", "before")
    own = Window.partitionBy("part", "length").orderBy("row")
    numbered = cut.withColumn("part", part).withColumn("within", F.row_number().over(own)).join(firsts, ["part", "length"])
    numbered = numbered.select(*[f.name for f in cut.schema if f.name != "row"], (F.col("before") + F.col("within") - 1).alias("number"))
    names = [f for f in numbered.columns if f != "number"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = sent.value
        firsts = {length: [r[0] for r in own] for length, own in runs.items()}
        for batch in batches:
            lengths, numbers = batch.column(names.index("length")).to_pylist(), batch.column(len(names)).to_pylist()
            found = [place(runs[a], firsts[a], a, n) for a, n in zip(lengths, numbers, strict=True)]
            more = [pa.array([s for s, _ in found], pa.int64()), pa.array([o for _, o in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *more], names=[*names, "sequence_id", "offset"])

    schema = T.StructType([*numbered.schema.fields[:-1], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    placed = numbered.mapInArrow(run, schema)
    return placed.withColumn("length", F.col("length").cast("long")).select(*names, "sequence_id", "offset")
