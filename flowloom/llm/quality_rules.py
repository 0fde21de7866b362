"""Quality rules: base figures of every text, and lines that too many documents of one host share.

Method: every line is normalised (A-Z lower-cased, digits to 0, runs of blanks to one)
and hashed.  Per host, the different documents that hold a line are counted; lines above
the limit (an absolute number, so that copies and the size of a host do not move it) are removed, and a document of which too little is left is rejected.

A document that was copied counts once, else the lines of a page with a thousand near copies
would look like boilerplate and all copies would go.  A document is told by all of its lines
together, as a set; lines in which words were changed stand for the line that they were.  Such
a line has its first or its last words, or those around the longest word of one of up to CORES
parts between them, in common with a line above the limit and is taken for that line.  So exact copies and copies with changed words are one
document, and any other line, one line more or less, or another choice from a pool of
lines make a different one, whatever share of the text that is.

Defined results: null and empty texts have no words and fail the base rule; a null host
is a host of its own; repeated rows get the same figures each; an empty table gives an
empty result; extra columns are not read by the verdict and are kept by `clean`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import LOWER_ASCII, free_name, map_batches, text_bytes
from flowloom.stage import materialize

BLANKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Words at either end of a line that are looked up, fewer for short lines, which need twice as many;
#: parts of the rest, and words that each of them needs (a rest with fewer for all is one part).
END_WORDS, SHORT_END_WORDS, CORES, CORE_WORDS = 4, 3, 3, 3
_FOLD = bytes(0x30 if 0x30 <= b <= 0x39 else b for b in LOWER_ASCII)
_SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


@dataclass(frozen=True)
class Limits:
    min_words: int = 10
    repeat_percent: int = 20
    #: A line is removed if more documents of its host hold it, the same number for a host of any size.
    most_docs: int = 10
    #: A document is rejected if fewer of its words are left.
    left_percent: int = 30


def normal_line(line: bytes) -> bytes:
    return b" ".join(line.translate(_FOLD).split())


def line_hash(normal: bytes) -> int:
    return int.from_bytes(md5(normal).digest()[:8], "big") >> 1


def window_hashes(normal: bytes) -> list[int | None]:
    """Hashes of the first and the last words of a line, and of three words in each part between; none where they would overlap."""
    words = normal.split(b" ")
    n = END_WORDS if len(words) >= 2 * END_WORDS else SHORT_END_WORDS
    out: list[int | None] = [None] * (2 + CORES)
    if len(words) >= 2 * n:
        out[:2] = line_hash(b"<" + b" ".join(words[:n])), line_hash(b">" + b" ".join(words[-n:]))
        rest = words[n:-n]
        parts = CORES if len(rest) >= CORES * CORE_WORDS else int(len(rest) >= CORE_WORDS)
        for k in range(parts):
            part = rest[k * len(rest) // parts : (k + 1) * len(rest) // parts]
            longest = part.index(max(part, key=len))
            out[2 + k] = line_hash(b"%d|" % k + b" ".join(part[max(0, longest - 1) : longest + 2]))
    return out


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a five-word window found twice or more."""
    n = len(words) - 4
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint64, len(words))
    if len(known) == len(words):
        return 0
    windows = sum(ids[k : k + n] * _SPREAD[k] for k in range(5))
    sums = np.sort(windows)
    if not (sums[1:] == sums[:-1]).any():  # equal windows have equal sums
        return 0
    size = np.uint64(len(known))
    pairs = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1].astype(np.uint64)
    size = np.uint64(len(words))
    fours = np.unique(pairs[:-2] * size + pairs[2:], return_inverse=True)[1].astype(np.uint64)
    _, at, times = np.unique(fours[:n] * size + ids[4:], return_inverse=True, return_counts=True)
    edge = np.zeros(len(words) + 1, np.int64)
    twice = np.flatnonzero(times[at] > 1)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + 5, -1)
    return int((np.cumsum(edge) > 0).sum())


def base_figures(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    solid = text.translate(None, BLANKS)
    chars = len(solid) if solid.isascii() else len(solid.decode("utf-8", "replace"))
    seen: set[bytes] = set()
    again = 0
    for line in text.split(b"\n"):
        if line.strip():
            again += line in seen
            seen.add(line)
    return len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), again, repeated_words(words)


_FIGURES = pa.schema(
    [
        ("row", pa.int64()), ("doc_id", pa.int64()), ("host", pa.string()), ("text_key", pa.string()),
        ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
        ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
        ("lines", pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64()), ("windows", pa.list_(pa.int64()))]))),
    ]
)


def _figures() -> Callable[[pa.RecordBatch], list]:
    def work(batch: pa.RecordBatch) -> list:
        out: list[list] = [[] for _ in range(7)]
        for text in batch.column(3).to_pylist():
            lines: dict[int, dict] = {}
            for line in text.split(b"\n"):
                normal = normal_line(line)
                if normal:
                    key = line_hash(normal)
                    if key not in lines:
                        lines[key] = {"line": key, "words": 0, "windows": window_hashes(normal)}
                    lines[key]["words"] += normal.count(b" ") + 1
            row = (md5(text).hexdigest(), *base_figures(text), [*lines.values()])
            for column, value in zip(out, row, strict=True):
                column.append(value)
        return [*batch.columns[:3], *out]

    return work


def figures(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per document, written: base figures, hashes of lines and of windows in them, words of the lines."""
    slim = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"),
        text_bytes().alias("text"),
    )
    return materialize(map_batches(slim, _FIGURES, _figures), "quality-figures")


def frequent_lines(facts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(host, line) of the lines above the limit, written."""
    lines = facts.select("row", "host", F.explode("lines").alias("at"))
    keyed = lines.select("row", "host", F.col("at.line").alias("line"), F.posexplode(F.concat(F.array("at.line"), "at.windows")).alias("place", "key")).filter("key is not null")
    # the count with all copies is never below the number of documents, so few lines are looked at closely
    often = keyed.groupBy("host", "key").agg(F.count("*").alias("holders"))
    often = materialize(often.filter(F.col("holders") > limits.most_docs).select("host", "key"), "quality-often")
    hits = materialize(keyed.join(often, ["host", "key"]), "quality-hits")

    # what a line stands for follows from the line alone, so each is looked at once, however many rows hold it
    kinds = materialize(hits.select("host", "line", "place", "key").distinct(), "quality-kinds")
    whole = kinds.filter("place = 0").select("host", "line")
    # a window stands for the least of the lines that are themselves above the limit, or for itself
    stands = materialize(kinds.filter("place > 0").join(whole, ["host", "line"]).groupBy("host", "key").agg(F.min("line").alias("stands")), "quality-windows")
    by = [F.max(F.when(F.col("place") == k, F.coalesce("stands", "key"))) for k in (2, 1, *range(3, 3 + CORES))]
    families = kinds.join(stands, ["host", "key"], "left").groupBy("host", "line").agg(F.coalesce(*by, F.col("line")).alias("stands"))
    rows = materialize(hits.groupBy("row", "host", "line").agg(F.min("place").alias("place")), "quality-rows")
    taken = rows.join(materialize(families, "quality-families"), ["host", "line"])
    shared = taken.groupBy("row").agg(F.collect_set("line").alias("shared"), F.collect_set("stands").alias("stand"))
    own = F.filter(F.transform("lines", lambda x: x["line"]), lambda x: ~F.array_contains("shared", x))
    told = facts.join(shared, "row").select("row", F.md5(F.array_join(F.sort_array(F.array_union("stand", own)).cast("array<string>"), " ")).alias("document"))
    held = rows.filter("place = 0").select("row", "host", "line").join(materialize(told, "quality-told"), "row")
    counts = held.groupBy("host", "line").agg(F.countDistinct("document").alias("docs"))
    return materialize(counts.filter(F.col("docs") > limits.most_docs).select("host", "line"), "quality-lines")


def verdicts(facts: DataFrame, frequent: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """`facts` with base_failed, kept, removed_words and the hashes of removed lines."""
    gone = (
        facts.select("row", "host", F.explode("lines").alias("at"))
        .select("row", "host", F.col("at.line").alias("line"), F.col("at.words").alias("words"))
        .join(frequent, ["host", "line"])
        .groupBy("row")
        .agg(F.sum("words").alias("removed_words"), F.sort_array(F.collect_list("line")).alias("removed"))
    )
    failed = (F.col("n_words") < limits.min_words) | (
        100 * F.col("n_repeat_words") > limits.repeat_percent * F.col("n_words")
    )
    left = F.col("n_words") - F.col("removed_words")
    return (
        facts.join(gone, "row", "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (100 * left >= limits.left_percent * F.col("n_words")))
    )


def quality_rules(docs: DataFrame, host: str = "source", limits: Limits = Limits()) -> DataFrame:
    """Figures and verdict of every row of `docs`."""
    facts = figures(docs, host)
    return verdicts(facts, frequent_lines(facts, limits), limits).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"
    )


def without_lines(text: bytes, removed: set[int]) -> bytes:
    return b"\n".join(x for x in text.split(b"\n") if line_hash(normal_line(x)) not in removed)


def clean(docs: DataFrame, host: str = "source", limits: Limits = Limits()) -> DataFrame:
    """The kept documents, with all their columns, without the frequent lines; n_chars follows the text.

    Rows with equal host and text get equal verdicts, so the verdicts are joined by these two.
    """
    facts = figures(docs, host)
    own_host, key, gone = (free_name(docs, n) for n in ("_host", "_text_key", "_removed"))
    known = (
        verdicts(facts, frequent_lines(facts, limits), limits)
        .filter("kept")
        .groupBy(F.col("host").alias(own_host), F.col("text_key").alias(key))
        .agg(F.first("removed", ignorenulls=True).alias(gone))
    )
    keyed = docs.withColumns({own_host: F.coalesce(F.col(host).cast("string"), F.lit("")), key: F.md5(text_bytes())})
    kept = keyed.join(materialize(known, "quality-kept"), [own_host, key])

    @F.pandas_udf("string")
    def shorten(text, removed):
        return text.combine(removed, lambda t, lines: t if lines is None else without_lines(t.encode(), {*lines}).decode())

    kept = kept.withColumn("text", F.when(F.size(gone) > 0, shorten("text", gone)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.size(gone) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)
