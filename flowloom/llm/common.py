"""Registry and helpers of this subpackage: reading tables, Arrow functions, word splitting."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

#: Bytes of the parts in which a task works on an Arrow batch (Spark bounds the batch itself by 64 MB), and what a row counts beside its texts.
SLICE_BYTES, ROW_BYTES = 1 << 21, 1 << 10

UPPER = bytes(range(0x41, 0x5B))
LOWER = bytes(range(0x61, 0x7B))
#: A-Z to a-z, every other byte as it is.
LOWER_ASCII = bytes.maketrans(UPPER, LOWER)
#: Bytes outside 0-9, A-Z, a-z and 0x80-0xFF become blanks, A-Z become a-z: what is left between blanks are the words.
PLAIN_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text column, empty for null."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores added until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remainder(column: str, by: int) -> Column:
    """crc32(column as text) mod `by`; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of the batches with about `most` bytes each, one row at least."""
    for batch in batches:
        sizes = np.full(batch.num_rows, ROW_BYTES, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy()
        part = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                yield batch.slice(a, b - a)


def map_batches(
    df: DataFrame, schema: pa.Schema, start: Callable[[], Callable[[pa.RecordBatch], list]]
) -> DataFrame:
    """`start` runs once in every task; the function that it gives turns a batch into the columns of `schema`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in slices(batches):
            columns = work(batch)
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)],
                schema=schema,
            )

    return df.mapInArrow(run, from_arrow_schema(schema))
