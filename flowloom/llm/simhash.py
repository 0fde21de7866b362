"""SimHash near-duplicate groups by the generalised pigeonhole principle.

Method: the 64 bits are grouped into partitions so that correlated bits stand together.
If two fingerprints differ in at most d bits, then for thresholds t_1 .. t_m that add up to
d - m + 1 some partition differs in at most t_i bits (a partition with -1 is left out).
The thresholds, and the number of partitions, are those with the fewest candidates by
dynamic programming over counts on a bounded sample of fingerprints: that choice moves
costs only, every fingerprint is indexed and no link is lost.

A fingerprint is written under its value in every partition (threshold 0), or under that
value with each bit masked (threshold 1).  Those that share such a key are candidates:
- up to PAIRED fingerprints under a key are compared pair by pair;
- the members of larger keys are written once under each of the 65 values at most one bit
  away.  Two fingerprints at most two bits apart share such a value, and all that share
  one are at most two bits apart, at most 65 of them: they are linked in a row.  So dense
  groups cost 65 rows a member instead of pairs.
Verified links go to `components`.  Equal fingerprints are one node throughout.

Defined results: null texts and texts without words have fingerprint 0 and are linked like
any other; a component without any doc_id has a null id; repeated rows fall into one group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.llm.common import LOWER_ASCII, free_name, map_batches, slices, text_bytes
from flowloom.llm.components import components
from flowloom.stage import materialize

BITS, SHINGLE, SEED, DISTANCE = 64, 3, 42, 2
#: Fingerprints in the sample behind the plan, and under a key that is compared pair by pair.
SAMPLE, PAIRED = 20_000, 16


def fingerprint(text: bytes) -> int:
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER_ASCII).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    last = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    hashes = np.array([xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, last, strict=False)], "<u8")
    votes = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 4096):
        votes += np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def _print_batch() -> Callable[[pa.RecordBatch], list]:
    def work(batch: pa.RecordBatch) -> list:
        prints = np.array([fingerprint(t) for t in batch.column(batch.num_columns - 1).to_pylist()], np.uint64)
        return [*batch.columns[:-1], pa.array(prints.view(np.int64))]

    return work


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, print) of every row, written."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("print", pa.int64())])
    return materialize(map_batches(slim, schema, _print_batch), "prints")


# ---- plan: partitions and thresholds


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Greedy: a partition begins with the most correlated free pair and takes the bit with the largest mean correlation."""
    bits = (sample[:, None] >> np.arange(BITS, dtype=np.uint64) & np.uint64(1)).astype(float)
    spread = bits - bits.mean(0) if len(bits) else bits
    size = np.sqrt((spread**2).sum(0))
    near = np.abs(spread.T @ spread) / np.maximum(np.outer(size, size), 1e-9)
    np.fill_diagonal(near, 0)
    free = list(range(BITS))
    groups: list[list[int]] = []
    for part in range(parts):
        width = len(free) // (parts - part)
        own = near[np.ix_(free, free)]
        group = sorted({free[k] for k in np.unravel_index(own.argmax(), own.shape)})
        while len(group) < width:
            rest = [b for b in free if b not in group]
            group.append(rest[int(near[np.ix_(rest, group)].mean(1).argmax())])
        groups.append(sorted(group[:width]))
        free = [b for b in free if b not in groups[-1]]
    return groups


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _pairs(values: np.ndarray) -> float:
    counts = np.unique(values, return_counts=True)[1].astype(float)
    return float((counts * (counts - 1) / 2).sum())


def estimate(sample: np.ndarray, group: list[int], threshold: int, total: int) -> float:
    """Candidates and keys of one partition for all fingerprints."""
    if threshold < 0:
        return 0.0
    grow = (total / max(1, len(sample))) ** 2
    mask = _mask(group)
    masks = [mask] if threshold == 0 else [mask & ~(1 << b) for b in group]
    return sum(_pairs(sample & np.uint64(m)) * grow + total for m in masks)


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (-1, 0 or 1 for each partition, costs in that order) of the least cost that add up to `total`."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, more in zip((-1, 0, 1), own, strict=True):
                if used + t not in step or cost + more < step[used + t][0]:
                    step[used + t] = (cost + more, [*chosen, t])
        best = step
    return best[total]


def plan(sample: np.ndarray, total: int, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(mask of the bits, threshold) of the partitions in use, for the cheapest number of partitions."""
    options = []
    for parts in (2, 3, 4):
        groups = group_bits(sample, parts)
        cost, chosen = allocate([[estimate(sample, g, t, total) for t in (-1, 0, 1)] for g in groups], distance - parts + 1)
        options.append((cost, [(_mask(g), t) for g, t in zip(groups, chosen, strict=True) if t >= 0]))
    return min(options)[1]


# ---- probe and verify


def _long(value: int) -> Column:
    return F.lit(value - (1 << 64) if value >> 63 else value).cast("long")


def keys(prints: DataFrame, parts: list[tuple[int, int]]) -> DataFrame:
    """(print, part, value): the keys of every distinct fingerprint."""
    own = []
    for k, (mask, threshold) in enumerate(parts):
        masks = [mask] if threshold == 0 else [mask & ~(1 << b) for b in range(BITS) if mask >> b & 1]
        own += [F.struct(F.lit(k * BITS + j).alias("part"), F.col("print").bitwiseAND(_long(m)).alias("value")) for j, m in enumerate(masks)]
    return prints.select("print", F.explode(F.array(*own)).alias("key")).select("print", "key.part", "key.value")


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(prints: DataFrame, parts: list[tuple[int, int]]) -> DataFrame:
    """(a, b) with a < b: pairs of distinct fingerprints at most DISTANCE apart that connect all such pairs."""
    table = materialize(keys(prints, parts), "print-keys")
    sizes = table.groupBy("part", "value").agg(F.count("*").alias("n")).filter("n > 1")
    shared = materialize(table.join(sizes, ["part", "value"]), "print-shared")

    few = shared.filter(F.col("n") <= PAIRED).groupBy("part", "value").agg(F.sort_array(F.collect_list("print")).alias("prints"))
    beside = F.transform("prints", lambda a, i: F.transform(F.filter(F.slice("prints", i + 2, PAIRED), lambda b: _apart(a, b) <= DISTANCE), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    pairs = few.select(F.explode(F.flatten(beside)).alias("p")).select("p.a", "p.b")

    dense = shared.filter(F.col("n") > PAIRED).select("print").distinct()
    around = F.array(F.col("print"), *[F.col("print").bitwiseXOR(_long(1 << b)) for b in range(BITS)])
    balls = dense.select("print", F.explode(around).alias("value")).groupBy("value").agg(F.sort_array(F.collect_list("print")).alias("prints"))
    stars = balls.filter(F.size("prints") > 1).select(F.element_at("prints", 1).alias("a"), F.explode(F.slice("prints", 2, BITS)).alias("b"))
    return pairs.unionByName(stars).distinct()


def sample_of(prints: DataFrame) -> tuple[np.ndarray, int]:
    """At most SAMPLE distinct fingerprints, chosen by a hash, and how many there are."""
    total = prints.count()
    part = min(1.0, SAMPLE / max(1, total))
    mark = F.pmod(F.xxhash64("print"), F.lit(1 << 30))
    chosen = prints.filter(mark < int(part * (1 << 30))).limit(2 * SAMPLE).toPandas()["print"]
    return np.sort(chosen.to_numpy(np.int64).view(np.uint64)), total


def groups(prints: DataFrame, ids: Column) -> DataFrame:
    """(print, component): the least `ids` of the component of every distinct fingerprint, written."""
    distinct = materialize(prints.groupBy("print").agg(F.min(ids).alias("least")), "prints-distinct")
    sample, total = sample_of(distinct.select("print"))
    found = materialize(components(links(distinct.select("print"), plan(sample, total))), "print-components")
    rooted = materialize(distinct.join(found, distinct.print == found.node, "left").select("print", "least", F.coalesce("root", "print").alias("root")), "print-roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return materialize(rooted.join(least, "root").select("print", "component"), "print-groups")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of `docs`."""
    prints = fingerprints(docs)
    found = groups(prints, F.col("doc_id"))
    return prints.join(found, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def first_of_groups(docs: DataFrame) -> DataFrame:
    """One row of every group, with all columns of `docs`: the one of the least doc_id (null last), of equals any one.

    The rows get a number when they are written, so exactly one of several equal rows stays.
    """
    row, mark = free_name(docs, "_row"), free_name(docs, "_print")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = np.array([fingerprint((t or "").encode()) for t in batch.column(at).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints.view(np.int64))], names=[*batch.schema.names, mark])

    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    schema = T.StructType([*numbered.schema.fields, T.StructField(mark, T.LongType())])
    written = materialize(numbered.mapInArrow(run, schema), "printed-docs")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
    found = groups(written.select(F.col(mark).alias("print"), order.alias("order")), F.col("order"))
    first = materialize(found.select(F.col("component.row").alias(row)).distinct(), "first-rows")
    # the kept rows grow with the documents: shuffled at every size, not broadcast while they are few
    return written.join(first.hint("merge"), row, "left_semi").select(*docs.columns)
