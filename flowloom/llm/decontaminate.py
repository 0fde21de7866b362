"""Benchmark decontamination: which words of a text lie in a passage of a benchmark item.

Method: the windows of all items, as normalised words between blanks, become the patterns
of one Aho-Corasick automaton.  A text is normalised the same way and scanned once; the
ends of the hits are mapped to word numbers, and word numbers to places in the original.

The items are a stated query set: their normalised texts are read in blocks of about
BLOCK_CHARS characters of windows and sent to the tasks, block by block.  Windows and automaton
are made in the tasks.  The usual benchmark is one block, whose automaton a worker process makes
once; with more blocks a task holds one automaton at a time and takes each Arrow batch (64 MB at most)
through all of them, so its memory is that of one block and of the texts of the items.

Defined results: null and empty texts have no words and no hits; an item without words
has no window; an item of fewer words than a window is one window; rows that share an
item_id are one item with all their windows; rows with a null item_id are left out;
overlapping and repeated occurrences count each word once; without items nothing is hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from flowloom.llm.common import PLAIN_WORDS, slices, text_bytes

WINDOW = 10
#: Memory of an automaton is about 40 bytes a character of windows.
BLOCK_CHARS = 8_000_000
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def item_windows(words: list[bytes], size: int = WINDOW) -> set[bytes]:
    if not words:
        return set()
    return {b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))}


Block = list[tuple[str, bytes]]


def blocks(items: DataFrame, size: int = WINDOW, most: int = BLOCK_CHARS) -> Iterator[Block]:
    """(item_id, normalised text) in blocks of bounded size; one item never leaves its block."""
    held: Block = []
    chars = 0
    rows = items.filter("item_id is not null").select(F.col("item_id").cast("string").alias("i"), text_bytes().alias("t"))
    for row in rows.toLocalIterator():
        normal = b" ".join(bytes(row.t).translate(PLAIN_WORDS).split())
        held.append((row.i, normal))
        chars += len(normal) * size
        if chars >= most:
            yield held
            held, chars = [], 0
    if held:
        yield held


def automaton(block: Block, size: int = WINDOW):
    """Values: words of the window and the items that have it."""
    import ahocorasick

    owners: dict[str, set[str]] = {}
    for item, text in block:
        for window in item_windows(text.split(), size):
            owners.setdefault(window.decode(), set()).add(item)
    found = ahocorasick.Automaton()
    for window, items in owners.items():
        found.add_word(f" {window} ", (window.count(" ") + 1, frozenset(items)))
    found.make_automaton()
    return found


_made: dict[str, object] = {}


class Tries:
    """The automata of all blocks, one at a time; a single one is kept for the worker process."""

    def __init__(self, spark: SparkSession, items: DataFrame, size: int, most: int = BLOCK_CHARS) -> None:
        self.size, self.mark = size, uuid4().hex
        self.sent = [spark.sparkContext.broadcast(block) for block in blocks(items, size, most)]

    def __iter__(self) -> Iterator:
        for block in self.sent:
            if len(self.sent) > 1:
                yield automaton(block.value, self.size)
            else:
                if self.mark not in _made:
                    _made.clear()
                    _made[self.mark] = automaton(block.value, self.size)
                yield _made[self.mark]


def scan(words: list[bytes], trie) -> tuple[np.ndarray, set[str]]:
    """For every word whether it is hit, and the items with a window in these words."""
    normal = f" {b' '.join(words).decode()} "
    hits = list(trie.iter(normal))
    edge = np.zeros(len(words) + 1, np.int64)
    items: set[str] = set()
    if hits:
        # the blank behind word k stands at the sum of the lengths up to k, with their blanks
        ends = np.cumsum([len(w.decode()) + 1 for w in words])
        last = np.searchsorted(ends, [at for at, _ in hits])
        for k, (_, (size, owners)) in zip(last, hits, strict=True):
            edge[k - size + 1] += 1
            edge[k + 1] -= 1
            items |= owners
    return np.cumsum(edge)[:-1] > 0, items


def hit_spans(text: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words as code point places of the original text."""
    spans: list[list[int]] = []
    for k, m in enumerate(_WORD.finditer(text)):
        if hit[k]:
            if k and hit[k - 1]:
                spans[-1][1] = m.end()
            else:
                spans.append([m.start(), m.end()])
    return [(len(text[:a].decode()), len(text[:b].decode())) for a, b in spans]


_HITS = pa.schema(
    [
        ("n_words", pa.int64()),
        ("hit", pa.list_(pa.int32())),
        ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.list_(pa.int64()))),
    ]
)


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, carry: tuple[str, ...] = ("doc_id",), most: int = BLOCK_CHARS) -> DataFrame:
    """Per row: `carry`, n_words, n_hit, items (sorted ids), spans ([start, end) in code points), contaminated."""
    own = [f"_own{k}" for k in range(len(carry))]
    given = docs.select(*[F.col(c).alias(o) for c, o in zip(carry, own, strict=True)], text_bytes().alias("_text"))
    tries = Tries(docs.sparkSession, items, size, most)
    kept = to_arrow_schema(given.select(*own).schema)
    schema = pa.schema([*kept, *_HITS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if len(tries.sent) > 1 else slices(batches):
            texts = batch.column(len(own)).to_pylist()
            split = [t.translate(PLAIN_WORDS).split() for t in texts]
            hits = [np.zeros(len(words), bool) for words in split]
            ids: list[set[str]] = [set() for _ in split]
            for trie in tries:
                for k, words in enumerate(split):
                    if words:
                        hit, found = scan(words, trie)
                        hits[k] |= hit
                        ids[k] |= found
            columns = [
                pa.array([len(words) for words in split], pa.int64()),
                pa.array([np.flatnonzero(hit).astype(np.int32) for hit in hits], pa.list_(pa.int32())),
                pa.array([sorted(i) for i in ids], pa.list_(pa.string())),
                pa.array([hit_spans(t, hit) if hit.any() else [] for t, hit in zip(texts, hits, strict=True)], pa.list_(pa.list_(pa.int64()))),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], *columns], schema=schema)

    scanned = given.mapInArrow(run, from_arrow_schema(schema))
    return scanned.select(
        *[F.col(o).alias(c) for o, c in zip(own, carry, strict=True)],
        "n_words",
        F.size("hit").cast("long").alias("n_hit"),
        F.col("items").alias("hit_items"),
        F.col("spans").alias("hit_spans"),
        (F.size("hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, size: int = WINDOW, most: int = BLOCK_CHARS) -> DataFrame:
    """The rows of `docs` in which no window occurs, with all their columns."""
    tries = Tries(docs.sparkSession, items, size, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if len(tries.sent) > 1 else slices(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            split = [(t or "").encode().translate(PLAIN_WORDS).split() for t in texts]
            free = np.ones(len(split), bool)
            for trie in tries:
                for k, words in enumerate(split):
                    free[k] = free[k] and not (words and scan(words, trie)[0].any())
            yield batch.filter(pa.array(free))

    return docs.mapInArrow(run, docs.schema)
