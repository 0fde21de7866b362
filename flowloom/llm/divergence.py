"""Source divergence audit: how far the word use of every source is from the others of its language.

Method: terms are counted per (language, source); the terms in enough documents of a language
get ids by falling frequency, so rare terms, which most sources count 0 or 1 times, stand
together.  The ids are cut into blocks of BLOCK, and the counts of one source in one block are
the leaves of a segment tree.  Trees are hash-consed: a node is the pair of its children's
numbers, so equal count subtrees of any sources of a tile are one node.  Two trees are walked
simultaneously from the roots; a pair of nodes that is met again for the same two sources is
not walked again but adds to the weight of the first, and only distinct pairs of leaves are
priced.  Prices depend on the totals of both sources, so nothing is shared beyond the sources.

Tiles are (language, block, two chunks of at most CHUNK sources), so a task holds at most
2 * CHUNK * BLOCK counts whatever the number of sources and terms; the prices of the tiles are
added by Spark.  The list of all ordered pairs of sources is the result itself.

All arithmetic is exact in whole numbers: p = 1 + floor(10^9 * (count + 1) / (N + V)) by long
division in steps that stay below 2^63 for totals up to 9 * 10^15, and f = floor((p - q)^2 / q).

Defined results: null text, language and source are ''; a source without terms has N = 0 and
the pairs of all others; in a language without kept terms every pair has value 0 and there are
no terms; repeated rows count as so many documents; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowloom.llm.common import LOWER_ASCII, slices, text_bytes
from flowloom.stage import materialize, task_count

LEAST_DOCS, TOP, SCALE = 3, 200, 10**9
#: Terms in a block, sources in a chunk.
BLOCK_BITS, CHUNK = 10, 64
BLOCK = 1 << BLOCK_BITS
#: Terms, and bytes of text, after which a task hands its counts on.
HELD, HELD_BYTES = 1 << 19, 1 << 28
#: Bytes outside A-Z, a-z and 0x80-0xFF become blanks, A-Z become a-z.
TERMS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in LOWER_ASCII)


# ---- counts


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs), written; tasks add up their own rows first."""
    slim = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), text_bytes().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (times, rows) in held.items():
                terms = [*times]
                columns = [[lang] * len(terms), [source] * len(terms), [t.decode() for t in terms], [*times.values()], [rows[t] for t in terms]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in slices(batches):
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                terms = text.translate(TERMS).split()
                if terms:
                    times, rows = held.setdefault((lang, source), (Counter(), Counter()))
                    times.update(terms)
                    rows.update(set(terms))
                    size += len(text)
            if size >= HELD_BYTES or sum(len(t) for t, _ in held.values()) >= HELD:
                yield from flush()
                size = 0
        yield from flush()

    parts = slim.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return materialize(parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")


def kept_terms(counts: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, total, id): terms in enough documents, written; ids rise with falling totals within a language, with gaps between partitions."""
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least)
    by = [F.col("lang"), F.col("total").desc(), F.col("term")]
    ranged = terms.repartitionByRange(task_count(counts.sparkSession), *by).sortWithinPartitions(*by)
    return materialize(ranged.select("lang", "term", "total", F.monotonically_increasing_id().alias("id")), "kept-terms")


def sources(docs: DataFrame, counted: DataFrame, kept: DataFrame) -> DataFrame:
    """One row per (lang, source), written: chunk and member number, N of the source, N and V of the language."""
    every = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).distinct()
    own = counted.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_size"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    joined = every.join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["size", "terms", "lang_size"])
    return materialize(joined.select("*", F.floor(number / CHUNK).cast("int").alias("chunk"), (number % CHUNK).alias("member")), "sources")


# ---- prices


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (count + 1) / total) for count + 1 <= total, three digits at a time."""
    rest, out = counts + 1, np.zeros(np.broadcast(counts, total).shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def consed(leaves: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Root of every row, children of the nodes by level from the roots down, and the values of the leaf nodes.

    Equal subtrees of any rows have one number in their level.
    """
    values, at = np.unique(leaves, return_inverse=True)
    at = at.reshape(leaves.shape)
    levels: list[np.ndarray] = []
    while at.shape[1] > 1:
        base = int(at.max()) + 1
        nodes, parent = np.unique(at[:, 0::2] * base + at[:, 1::2], return_inverse=True)
        levels.append(np.stack([nodes // base, nodes % base], 1))
        at = parent.reshape(at.shape[0], -1)
    return at[:, 0], levels[::-1], values


def walk(a: np.ndarray, b: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of leaf nodes under the pairs of roots (a, b): (number of the pair of roots, leaf, leaf, weight)."""
    walker, weight = np.arange(len(a)), np.ones(len(a), np.int64)
    for children in levels:
        walker, weight = np.tile(walker, 2), np.tile(weight, 2)
        a, b = children[a].T.reshape(-1), children[b].T.reshape(-1)
        size = int(max(a.max(), b.max())) + 1
        keys, met = np.unique((walker * size + a) * size + b, return_inverse=True)
        if len(keys) < len(met):
            merged = np.zeros(len(keys), np.int64)
            np.add.at(merged, met, weight)
            walker, a, b, weight = keys // (size * size), keys // size % size, keys % size, merged
    return walker, a, b, weight


def tile_prices(left: np.ndarray, right: np.ndarray, left_size: np.ndarray, right_size: np.ndarray, pairs: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of f over a block for the rows `pairs` of (left, right) in both directions; counts of -1 are no terms."""
    roots, levels, values = consed(np.concatenate([left, right]))
    walker, a, b, weight = walk(roots[pairs[:, 0]], roots[len(left) + pairs[:, 1]], levels)
    a, b = values[a], values[b]
    real = a >= 0  # a block lacks the same terms in all sources
    walker, a, b, weight = walker[real], a[real], b[real], weight[real]
    p = shares(a, left_size[pairs[walker, 0]] + terms)
    q = shares(b, right_size[pairs[walker, 1]] + terms)
    square = (p - q) * (p - q)
    out = []
    for reference in (q, p):
        sums = np.zeros(len(pairs), np.int64)
        np.add.at(sums, walker, weight * (square // reference))
        out.append(sums)
    return out[0], out[1]


def _leaves(entries: pa.StructArray | None, members: int, first: int, last: int) -> np.ndarray:
    """Counts of the members in a block; places outside first .. last hold no term."""
    out = np.zeros((members, BLOCK), np.int64)
    out[:, :first] = out[:, last + 1 :] = -1
    if entries is not None:
        member, place, n = (entries.field(k).to_numpy() for k in range(3))
        out[member, place] = n
    return out


def pair_values(counted: DataFrame, kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of different sources of a language."""
    place = F.col("id").bitwiseAND(F.lit(BLOCK - 1)).cast("int")
    blocks = kept.groupBy("lang", F.shiftright("id", BLOCK_BITS).alias("block")).agg(F.min(place).alias("first"), F.max(place).alias("last"))
    # a language without terms has one block without places
    bare = groups.filter("terms = 0").select("lang", F.lit(-1).cast("long").alias("block"), F.lit(BLOCK).alias("first"), F.lit(BLOCK - 1).alias("last")).distinct()
    heads = materialize(groups.groupBy("lang", "chunk").agg(F.max("terms").alias("terms"), F.sort_array(F.collect_list(F.struct("member", "source", "size"))).alias("members")), "source-chunks")
    # at most CHUNK * BLOCK counts a row
    entry = F.struct("member", place.alias("place"), "n")
    packed = counted.join(groups.select("lang", "source", "chunk", "member"), ["lang", "source"]).groupBy("lang", F.shiftright("id", BLOCK_BITS).alias("block"), "chunk").agg(F.collect_list(entry).alias("entries"))
    packed = materialize(packed, "count-blocks")
    sides = [heads.select("lang", "terms", F.col("chunk").alias(f"{s}_chunk"), F.col("members").alias(f"{s}_members")) for s in ("left", "right")]
    tiles = blocks.unionByName(bare).join(sides[0], "lang").join(sides[1].drop("terms"), "lang").filter("left_chunk <= right_chunk")
    for s in ("left", "right"):
        tiles = tiles.join(packed.select("lang", "block", F.col("chunk").alias(f"{s}_chunk"), F.col("entries").alias(f"{s}_entries")), ["lang", "block", f"{s}_chunk"], "left")
    names = ["lang", "terms", "first", "last", "left_chunk", "right_chunk", "left_members", "right_members", "left_entries", "right_entries"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = dict(zip(names, batch.columns, strict=True))
            for k in range(batch.num_rows):
                lang, terms, first, last, *chunks = (column[c][k].as_py() for c in names[:6])
                members = [column[f"{s}_members"][k].values for s in ("left", "right")]
                entries = [column[f"{s}_entries"][k].values for s in ("left", "right")]
                source = [np.array(m.field(1).to_pylist(), object) for m in members]
                leaves = [_leaves(e, len(m), first, last) for e, m in zip(entries, members, strict=True)]
                every = np.indices((len(source[0]), len(source[1]))).reshape(2, -1).T
                every = every[every[:, 0] < every[:, 1]] if chunks[0] == chunks[1] else every
                if len(every):
                    there, back = tile_prices(*leaves, *(m.field(2).to_numpy() for m in members), every, terms)
                    a, b = source[0][every[:, 0]], source[1][every[:, 1]]
                    columns = [[lang] * (2 * len(every)), [*a, *b], [*b, *a], np.concatenate([there, back])]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["lang", "source", "item", "value"])

    priced = tiles.select(*names).repartition(task_count(tiles.sparkSession)).mapInArrow(run, "lang string, source string, item string, value long")
    return priced.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _share(count: str, size: str) -> Column:
    wide = "cast({} as decimal(20, 0))"
    return F.expr(f"1 + cast({SCALE} as decimal(10, 0)) * {wide.format(f'{count} + 1')} div {wide.format(f'{size} + terms')}")


def term_values(counted: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for the terms that a source uses more than its language does."""
    joined = counted.join(groups, ["lang", "source"])
    priced = joined.select("lang", "source", F.col("term").alias("item"), _share("n", "size").alias("p"), _share("total", "lang_size").alias("q"))
    return priced.filter("p > q").select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))


def divergence(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: all other sources, and the `top` telling terms, of every source."""
    counts = term_counts(docs)
    kept = kept_terms(counts)
    counted = materialize(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "counted-terms")
    groups = sources(docs, counted, kept)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    pairs = pair_values(counted, kept, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    # Spark keeps `top` rows of every source in each task before it shuffles
    terms = term_values(counted, groups).withColumn("rank", rank).filter(F.col("rank") <= top)
    return pairs.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
