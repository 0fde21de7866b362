"""Column functions on single flows.  All of them are built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# IANA port ranges.
WELL_KNOWN_PORT_MAX = 1023
REGISTERED_PORT_MAX = 49151


def log1p_clip(c: Column) -> Column:
    """log(1 + max(c, 0)); a null stays null (`greatest` alone would make it 0)."""
    return F.when(c.isNotNull(), F.log1p(F.greatest(c, F.lit(0.0))))


def port_bucket(port: Column) -> Column:
    """0 well-known, 1 registered, 2 ephemeral."""
    return F.when(port <= WELL_KNOWN_PORT_MAX, 0).when(port <= REGISTERED_PORT_MAX, 1).otherwise(2)


def vocab_code(value: Column, vocab: Column) -> Column:
    """0-based slot of `value` in the array `vocab`; its length stands for 'other'."""
    found = F.array_position(vocab, value)
    return F.when(found > 0, found - 1).otherwise(F.size(vocab)).cast("int")


def port_code(port: Column, vocab: Column) -> Column:
    """Vocabulary slot, then 'other', then 'ephemeral'; an ephemeral port never uses a slot."""
    return F.when(port > REGISTERED_PORT_MAX, F.size(vocab) + 1).otherwise(vocab_code(port, vocab))


def one_hot(index: Column, width: int) -> list[Column]:
    """0/1 columns of a block with a known width."""
    return [F.when(index == i, 1.0).otherwise(0.0) for i in range(width)]


def one_hot_array(index: Column, width: Column) -> Column:
    """0/1 array of a width that differs from row to row."""
    return F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.when(i == index, 1.0).otherwise(0.0))


def ip_octets(ip: Column) -> list[Column]:
    """Four octets divided by 255; short addresses are filled with 0, other text counts as 0."""
    parts = F.split(ip, r"\.")

    def octet(i: int) -> Column:
        part = F.get(parts, F.lit(i))
        number = F.when(part.rlike("^[0-9]+$"), part.try_cast("int"))
        return F.coalesce(number, F.lit(0)) / F.lit(255.0)

    return [octet(i) for i in range(4)]


def projection(dim: int, seed: int = 42) -> np.ndarray | None:
    """Fixed 4 x dim matrix, uniform on (-1, 1), single precision; none is needed for 4 dimensions."""
    if dim == 4:
        return None
    return np.random.RandomState(seed).uniform(-1, 1, size=(4, dim)).astype(np.float32).astype(float)


def project(vector: Sequence[Column], matrix: np.ndarray | None) -> list[Column]:
    if matrix is None:
        return list(vector)
    return [
        add([v * float(matrix[k, j]) for k, v in enumerate(vector)]) for j in range(matrix.shape[1])
    ]


def add(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def norm(vector: Sequence[Column]) -> Column:
    return F.sqrt(add([v * v for v in vector]))


def items(array: Column | str, width: int) -> list[Column]:
    array = F.col(array) if isinstance(array, str) else array
    return [array.getItem(i) for i in range(width)]


def unit(vector: Sequence[Column], length: Column, weight: float = 1.0) -> list[Column]:
    """Vector divided by its length.  Lengths under 1e-9 are round-off of zero and divide by 1."""
    safe = F.when(length < 1e-9, 1.0).otherwise(length)
    return [v / safe * weight for v in vector]


def mean_square(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return add([(x - y) * (x - y) for x, y in zip(a, b, strict=True)]) / float(len(a))


def is_attack(score: Column, threshold: Column) -> Column:
    return (score >= threshold).cast("int")


def client_base(name: Column) -> Column:
    """Data set of a client name '<base>#<k>'; only the last '#' separates."""
    return F.when(name.contains("#"), F.regexp_extract(name, "^(.*)#([^#]*)$", 1)).otherwise(name)


def client_shard(name: Column) -> Column:
    return F.when(name.contains("#"), F.regexp_extract(name, "#([^#]*)$", 1).cast("int"))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def r6(c: Column) -> Column:
    """Rounded to 6 places, for stable comparison of doubles (never -0.0)."""
    return F.round(c, 6)
