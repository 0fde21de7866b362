"""Fixed-size row windows over an indexed flow table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators.prefix import _attach, indexed_parts, prefix_index
from flowloom.stage import materialize, partition_count, small

#: Rows that stay together at least; so many blocks of a dominant group are spread over all partitions.
ALIGNED_ROWS = 2_000
#: Files hold one row group, which one task reads whole; far more than a file of `PARTITION_BYTES` needs.
ROW_GROUP_BYTES = 1 << 30


def aligned_index(indexed: DataFrame, step: int, keys: Sequence[str], pos: str = "row_pos") -> DataFrame:
    """The indexed rows, written so that no task of a reader gets a part of a window.

    Positions are cut at multiples of `step` into blocks, the blocks are dealt over the
    partitions by a hash of (keys, block), and every partition is written in order as one file
    of one row group.  A scan may read several files in a task, but never splits one of them
    between tasks, so tumbling windows (and those with gaps) need no further exchange as long
    as nothing between the scan and the window work shuffles: `context` checks that every
    window is whole.
    """
    rows = max(1, -(-ALIGNED_ROWS // step)) * step
    dealt = indexed.repartition(partition_count(indexed), *keys, F.expr(f"{pos} div {rows}"))
    return materialize(dealt.sortWithinPartitions(*keys, pos), "aligned", **{"parquet.block.size": str(ROW_GROUP_BYTES)})


def aligned_prefix_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], step: int, name: str = "row_pos", total: str = "n_rows", partitions: int | None = None
) -> DataFrame:
    """`aligned_index` of `prefix_index`, with one exchange of the rows instead of two.

    The sorted files of the index hold most windows whole already; they get one row group each, so that
    no reader splits them, and their rows are written again where they lie, with their positions.  Only the
    windows on a border between two files, at most two a file and group, are dealt anew.
    """
    rows, offsets = indexed_parts(df, keys, order, partitions, **{"parquet.block.size": str(ROW_GROUP_BYTES)})
    state = small(offsets)
    if state is None:  # more groups than a broadcast should carry: a shuffle gives the positions
        return aligned_index(prefix_index(df, keys, order, name=name, total=total, partitions=partitions), step, keys, name)
    here = F.col("_base") + F.col("_mid") - F.col("_first")
    start, end = F.expr(f"(_base + _mid - _first) div {step} * {step}"), F.col("_base") + F.col("_count")
    # the window began in an earlier file, or goes on in a later one
    torn = (start < F.col("_base")) | ((start + step > end) & (end < F.col("_total")))
    placed = _attach(rows, state, keys, {name: here, total: F.col("_total"), "_torn": torn})
    whole, border = (placed.filter(c).drop("_torn") for c in (~F.col("_torn"), F.col("_torn")))
    dealt = border.repartition(*keys, F.expr(f"{name} div {step}")).sortWithinPartitions(*keys, name)
    return materialize(whole.unionByName(dealt), "aligned", **{"parquet.block.size": str(ROW_GROUP_BYTES)})


def row_windows(
    indexed: DataFrame, size: int, step: int, pos: str = "row_pos", total: str = "n_rows"
) -> DataFrame:
    """Add `window_id` and `pos_in_window`; a row appears once per full window it lies in.

    Windows start at 0, step, 2*step, ... while they fit; the rest of the table is
    left out.  With step >= size a row is in one window at most, so nothing is
    exploded and the plan stays a projection over the scan.
    """
    if size < 1 or step < 1:
        raise ValueError("window size and step must be positive")
    window = F.expr(f"{pos} div {step}")
    fits = F.col("window_id") * step + size <= F.col(total)
    at = (F.col(pos) - F.col("window_id") * step).cast("int")
    if step >= size:
        tagged = indexed.withColumn("window_id", window)
    else:
        first = F.greatest(F.lit(0), F.expr(f"({pos} - {size} + {step}) div {step}"))
        final = F.least(window, F.expr(f"({total} - {size}) div {step}"))
        # sequence(1, 0) would count down, so rows without a window leave first
        inside = indexed.filter((F.col(total) >= size) & (first <= final))
        tagged = inside.withColumn("window_id", F.explode(F.sequence(first, final)))
    return tagged.filter(fits).withColumn("pos_in_window", at).filter(F.col("pos_in_window") < size)


def coverage(sizes: DataFrame, keys: Sequence[str], size: int, step: int, total: str = "n_rows") -> DataFrame:
    """(keys, n_rows, n_windows, n_covered, n_uncovered): rows that lie in a full window and rows that get no score.

    From the group sizes alone: rows behind the last full window, and those in gaps of step > size.
    """
    windows = F.when(F.col(total) >= size, F.expr(f"({total} - {size}) div {step} + 1")).otherwise(0).cast("long")
    counted = sizes.select(*keys, F.col(total).cast("long").alias("n_rows"), windows.alias("n_windows"))
    covered = F.when(F.col("n_windows") == 0, 0).otherwise((F.col("n_windows") - 1) * min(step, size) + size).cast("long")
    return counted.withColumn("n_covered", covered).withColumn("n_uncovered", F.col("n_rows") - F.col("n_covered"))


# Windows listed by one task at a time.
BLOCK = 100_000


def window_list(sizes: DataFrame, keys: Sequence[str], size: int, step: int, total: str = "n_rows") -> DataFrame:
    """(keys, window_id) of all full windows, from the group sizes alone.

    A group of many windows is first cut into blocks that are spread over the
    partitions, so that a dominant group is not listed by one task.
    """
    last = F.expr(f"({total} - {size}) div {step}")
    blocks = sizes.filter(F.col(total) >= size).select(
        *keys, last.alias("last"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"({total} - {size}) div {step} div {BLOCK}"))).alias("block")
    )
    start = F.col("block") * BLOCK
    listed = F.sequence(start, F.least(F.col("last"), start + BLOCK - 1))
    return blocks.repartition(*keys, "block").select(*keys, F.explode(listed).alias("window_id"))
