"""Positions and running sums over a whole ordered table, without a one-task window.

Both functions range-partition the rows on (keys, order), sort inside the
partitions and write the result with the partition number and the local row
number.  One small aggregate per (partition, key group) then gives every
partition its offset.  Because the partition number is stored, the second pass
cannot disagree with the first about where a row was, even after a task is run
again.  The offset table has at most (partitions + key groups) rows,
so it is one partition and needs no exchange of its own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowloom.stage import materialize, partition_count


def _order_columns(order: Sequence[str]) -> list[Column]:
    """'-name' sorts descending, 'name' ascending."""
    return [F.col(o[1:]).desc() if o.startswith("-") else F.col(o).asc() for o in order]


def _sorted_table(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], partitions: int | None, number_copies: bool, **options: str
) -> DataFrame:
    n = partitions or partition_count(df)
    by = [F.col(k).asc() for k in keys] + _order_columns(order)
    ranged = df.repartitionByRange(n, *by)
    if number_copies:
        # no exchange: range partitioning on these columns already clusters equal ones
        names = [*keys, *(o.lstrip("-") for o in order)]
        ranged = ranged.withColumn("_copy", F.row_number().over(Window.partitionBy(*names).orderBy(F.lit(0))))
    tagged = (
        ranged.sortWithinPartitions(*by)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_mid", 33))
    )
    return materialize(tagged, "sorted", **options)


def _same_group(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in names])


def _attach(rows: DataFrame, offsets: DataFrame, keys: Sequence[str], computed: Mapping[str, Column]) -> DataFrame:
    on = _same_group(rows, offsets, ["_part", *keys])
    kept = [rows[c] for c in rows.columns if not c.startswith("_")]
    return rows.join(offsets, on).select(*kept, *[c.alias(n) for n, c in computed.items()])


def prefix_index(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "row_pos",
    total: str | None = "n_rows",
    partitions: int | None = None,
) -> DataFrame:
    """Dense 0-based position of every row inside its key group, in `order`.

    `order` must be unique inside a group; the query fails if it is not, because
    a position would then depend on chance.  `total` adds the size of the group.
    """
    rows, offsets = indexed_parts(df, keys, order, partitions)
    computed = {name: F.col("_base") + F.col("_mid") - F.col("_first")}
    if total:
        computed[total] = F.col("_total")
    return _attach(rows, offsets, keys, computed)


def indexed_parts(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], partitions: int | None = None, **options: str
) -> tuple[DataFrame, DataFrame]:
    """The two written tables behind `prefix_index`: the sorted rows, and one row per (partition, key group) with the
    position `_base` of its first row, its `_count` and the `_total` of the group.  `options` are the writer's."""
    rows = _sorted_table(df, keys, order, partitions, True, **options)
    unique = F.assert_true(F.max("_copy") == 1, F.lit(f"order key {list(order)} is not unique"))
    per_part = rows.groupBy("_part", *keys).agg(
        F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_count"), unique.alias("_checked")
    ).coalesce(1)
    running = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    offsets = materialize(
        per_part.select(
            "_part",
            *keys,
            "_first",
            "_count",
            "_checked",
            (F.sum("_count").over(running) - F.col("_count")).alias("_base"),
            F.sum("_count").over(Window.partitionBy(*keys)).alias("_total"),
        ),
        "offsets",
    )
    return rows, offsets


def prefix_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, str],
    totals: Mapping[str, str] | None = None,
    partitions: int | None = None,
    following: Mapping[str, str] | None = None,
) -> DataFrame:
    """Inclusive running sums `{new column: summed column}` in `order` per key group.

    `totals` adds group totals in the same way, `following` values of the next row of the
    group (null behind its last row): inside a partition by `lead`, for a group's last row there
    from the group's first row in the next partition that has any, one such row per (partition,
    group).  Rows with equal order keys must have been aggregated to one row before.
    """
    totals, following = totals or {}, following or {}
    rows = _sorted_table(df, keys, order, partitions, False)
    summed = sorted({*sums.values(), *totals.values()})
    seen = F.struct(*sorted(set(following.values())))
    head = [F.min(F.struct("_mid", seen.alias("row")))["row"].alias("_head")] if following else []
    per_part = rows.groupBy("_part", *keys).agg(*[F.sum(c).alias(f"_s_{c}") for c in summed], *head).coalesce(1)
    running = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    offsets = materialize(
        per_part.select(
            "_part",
            *keys,
            *[(F.sum(f"_s_{c}").over(running) - F.col(f"_s_{c}")).alias(f"_base_{c}") for c in summed],
            *[F.sum(f"_s_{c}").over(whole).alias(f"_total_{c}") for c in summed],
            *([F.lead("_head").over(whole.orderBy("_part")).alias("_border")] if following else []),
        ),
        "offsets",
    )
    inside = Window.partitionBy("_part", *keys).orderBy("_mid")
    local = inside.rowsBetween(Window.unboundedPreceding, 0)
    after = [F.lead(seen).over(inside).alias("_after")] if following else []
    rows = rows.select("*", *[F.sum(c).over(local).alias(f"_local_{c}") for c in summed], *after)
    computed = {out: F.col(f"_base_{c}") + F.col(f"_local_{c}") for out, c in sums.items()}
    computed |= {out: F.col(f"_total_{c}") for out, c in totals.items()}
    computed |= {out: F.coalesce("_after", "_border")[c] for out, c in following.items()}
    return _attach(rows, offsets, keys, computed)
