"""What a flow's vector is predicted from, computed window by window inside tasks.

Flows of an aligned index (`windows.aligned_index`) already lie window by window; others are
shuffled by (group, window) and sorted.  A task then holds whole windows, each at most
`size` flows, and the sums over hosts and hops of
all windows of a batch are a few NumPy calls.  Hop vectors are sums of start vectors, and those
lie in the four dimensions of the octets whatever the size of the projection M: hops work on
coordinates u of u * M, sums of products and scores are taken from coordinates too.  The same quantities written as
window functions need six sorts of two rows per flow and took several times as
long (see README).  A graph that is not bounded by a window is `wholegraph`'s.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions import scalar as S
from flowloom.operators.graph import hop_weights
from flowloom.sources.flows import DST, SRC

FLOW = ("pos_in_window", "flow_id")
INPUT = (*FLOW, "label", "n_features", "features")


@dataclass(frozen=True)
class ContextSpec:
    """Group columns of a window, vector width, embedding size and hop weights.

    The predictor of a flow is [1, source context, destination context, window
    context, source vector, destination vector].  `rows`: the flows come from an aligned
    index without a shuffle since, and every window has so many; it is checked in the tasks.
    """

    group: tuple[str, ...]
    width: int
    dim: int = 32
    hops: int = 3
    weights: tuple[float, ...] | None = None
    rows: int | None = None

    @property
    def size(self) -> int:
        return 1 + 3 * self.width + 2 * self.dim

    @property
    def projection(self) -> np.ndarray:
        """4 x dim matrix that turns coordinates into vectors."""
        found = S.projection(self.dim)
        return np.eye(4) if found is None else found

    @property
    def lift(self) -> np.ndarray:
        """Matrix that turns predictors with coordinates of both ends into predictors with their vectors."""
        plain = 1 + 3 * self.width
        out = np.zeros((plain + 8, self.size))
        out[:plain, :plain] = np.eye(plain)
        out[plain : plain + 4, plain : plain + self.dim] = out[plain + 4 :, plain + self.dim :] = self.projection
        return out


def window_partitions(edges: DataFrame, spec: ContextSpec, payload: Sequence[str] = INPUT) -> DataFrame:
    """Whole windows in one partition each, in order; at most one shuffle for a window graph."""
    narrow = edges.select(*spec.group, *payload, SRC, DST)
    return narrow if spec.rows else narrow.repartition(*spec.group).sortWithinPartitions(*spec.group, "pos_in_window")


def octets(address: str | None) -> tuple[float, ...]:
    """Four octets divided by 255, as `scalar.ip_octets`."""
    parts = [*(address or "").split("."), "", "", "", ""][:4]
    numbers = [int(p) if p.isascii() and p.isdigit() else 0 for p in parts]
    return tuple(n / 255.0 if n < 1 << 31 else 0.0 for n in numbers)


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Array column of a fixed length as a matrix."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, width)


def _window_numbers(table: pa.Table, group: Sequence[str]) -> np.ndarray:
    """0, 1, 2, ... per row of a table sorted by `group`."""
    changed = np.zeros(table.num_rows, dtype=bool)
    for name in group:
        codes = pc.dictionary_encode(table[name], null_encoding="encode").combine_chunks().indices.to_numpy()
        changed[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(changed)


def _checked(window: np.ndarray, rows: int | None) -> np.ndarray:
    if rows and (np.bincount(window) != rows).any():
        raise RuntimeError(f"a window has not {rows} flows: flows of an aligned index are asked for, without a shuffle since it was written")
    return window


def _whole_windows(batches: Iterator[pa.RecordBatch], spec: ContextSpec) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that end at a window border, with the window number of every row."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if held.num_rows == 0:
            continue
        window = _window_numbers(held, spec.group)
        cut = int(np.searchsorted(window, window[-1]))
        if cut:
            yield held.slice(0, cut), _checked(window[:cut], spec.rows)
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held, _checked(_window_numbers(held, spec.group), spec.rows)


def _sum_by(keys: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row sums and counts per key 0..n-1."""
    sums = np.empty((n, values.shape[1]))
    for j, column in enumerate(np.ascontiguousarray(values.T)):
        sums[:, j] = np.bincount(keys, weights=column, minlength=n)
    return sums, np.bincount(keys, minlength=n)


def _others_mean(keys: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Mean of the other rows with the same key; zeros if there is none."""
    sums, counts = _sum_by(keys, values, n)
    others = counts[keys] - 1
    return np.where(others[:, None] > 0, (sums[keys] - values) / np.maximum(others, 1)[:, None], 0.0)


def _embeddings(src: np.ndarray, dst: np.ndarray, start: np.ndarray, weights: Sequence[float], projection: np.ndarray) -> np.ndarray:
    """Coordinates: r(1) = P e0, r(d+1) = P (r(d) - e(d)); the result is the weighted sum of the e(d)."""
    products = projection @ projection.T

    def unit(u: np.ndarray) -> np.ndarray:
        length = np.sqrt(np.maximum(((u @ products) * u).sum(axis=1, keepdims=True), 0.0))
        return u / np.where(length < 1e-9, 1.0, length)

    e = unit(start)
    total, message = e * weights[0], e
    for weight in weights[1:]:
        sums, counts = _sum_by(src, message[dst], len(start))
        r = sums / np.maximum(counts, 1)[:, None]
        e = unit(r) * weight
        total, message = total + e, r - e
    return total


@dataclass
class _Graph:
    """The graphs of some whole windows; nodes of different windows are different nodes."""

    table: pa.Table
    window: np.ndarray
    src: np.ndarray
    dst: np.ndarray
    first: np.ndarray  # place where a node is seen first: sources by row, then destinations by row
    places: np.ndarray  # coordinates of the nodes
    projection: np.ndarray

    @property
    def first_row(self) -> np.ndarray:
        return self.first % self.table.num_rows

    @property
    def vectors(self) -> np.ndarray:
        return self.places @ self.projection

    def node_ids(self) -> np.ndarray:
        """Number of every node inside its window, in the order of first appearance."""
        window = self.window[self.first_row]
        order = np.lexsort((self.first, window))
        starts = np.searchsorted(window[order], np.arange(window.max() + 1))
        ids = np.empty(len(order), dtype=np.int64)
        ids[order] = np.arange(len(order)) - starts[window[order]]
        return ids


def _graphs(batches: Iterator[pa.RecordBatch], spec: ContextSpec) -> Iterator[_Graph]:
    weights = hop_weights(spec.hops, spec.weights)
    projection = spec.projection
    for table, window in _whole_windows(batches, spec):
        n = table.num_rows
        ips = pa.concat_arrays([table[c].combine_chunks().cast(pa.string()) for c in (SRC, DST)])
        coded = pc.dictionary_encode(ips, null_encoding="encode")
        ip = coded.indices.to_numpy()
        place = np.concatenate((window, window)) * (int(ip.max()) + 1) + ip
        _, first, node = np.unique(place, return_index=True, return_inverse=True)
        start = np.array([octets(a) for a in coded.dictionary.to_pylist()])[ip[first]]
        src, dst = node[:n], node[n:]
        yield _Graph(table, window, src, dst, first, _embeddings(src, dst, start, weights, projection), projection)


def context_blocks(
    batches: Iterator[pa.RecordBatch], spec: ContextSpec
) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(rows, predictors with coordinates of both ends, targets) of whole windows; `spec.lift` makes the predictors."""
    for g in _graphs(batches, spec):
        y = matrix(g.table["features"], spec.width)
        n_nodes, n_windows = len(g.first), int(g.window[-1]) + 1
        x = np.hstack(
            (
                np.ones((len(y), 1)),
                _others_mean(g.src, y, n_nodes),
                _others_mean(g.dst, y, n_nodes),
                _others_mean(g.window, y, n_windows),
                g.places[g.src],
                g.places[g.dst],
            )
        )
        yield g.table, x, y


def _rows(values: np.ndarray) -> pa.Array:
    """Matrix as an array column."""
    ends = np.arange(values.shape[0] + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(values).ravel()))


def _with_columns(table: pa.Table, columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    for name, values in columns.items():
        table = table.append_column(name, values)
    yield from table.combine_chunks().to_batches()


def endpoint_context(edges: DataFrame, spec: ContextSpec) -> DataFrame:
    """(group, pos, flow_id, label, n_features, features, predictors) for every flow in every window.

    Predictors never contain the flow's own vector: both contexts are means over
    the other flows of its source, of its destination, and of its window.
    """
    prepared = window_partitions(edges, spec)
    kept = [*spec.group, *INPUT]
    lift = spec.lift

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, x, _ in context_blocks(batches, spec):
            yield from _with_columns(table.select(kept), {"predictors": _rows(x @ lift)})

    schema = prepared.select(*kept, F.lit(None).cast("array<double>").alias("predictors")).schema
    return prepared.mapInArrow(run, schema)


def node_embeddings(edges: DataFrame, spec: ContextSpec) -> DataFrame:
    """(group, node_id, ip, embedding): distance-weighted sum of isolated hop vectors."""
    prepared = window_partitions(edges, spec, FLOW)
    group = list(spec.group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _graphs(batches, spec):
            ips = pa.concat_arrays([g.table[c].combine_chunks() for c in (SRC, DST)])
            named = {"node_id": pa.array(g.node_ids()), "ip": ips.take(pa.array(g.first)), "embedding": _rows(g.vectors)}
            yield from _with_columns(g.table.select(group).take(pa.array(g.first_row)), named)

    added = [F.lit(0).cast("bigint").alias("node_id"), F.lit("").alias("ip")]
    schema = prepared.select(*group, *added, F.lit(None).cast("array<double>").alias("embedding")).schema
    return prepared.mapInArrow(run, schema)


def graph_windows(edges: DataFrame, spec: ContextSpec, payload: Sequence[str] = ("label", "features")) -> DataFrame:
    """All window graphs as one edge table with node numbers, addresses and both end vectors."""
    prepared = window_partitions(edges, spec, (*FLOW, *payload))
    kept = [*spec.group, *FLOW, *payload, SRC, DST]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _graphs(batches, spec):
            ids, vectors = g.node_ids(), g.vectors
            named = {
                "src_node": pa.array(ids[g.src]),
                "dst_node": pa.array(ids[g.dst]),
                "src_embedding": _rows(vectors[g.src]),
                "dst_embedding": _rows(vectors[g.dst]),
            }
            yield from _with_columns(g.table.select(kept), named)

    numbers = [F.lit(0).cast("bigint").alias(c) for c in ("src_node", "dst_node")]
    vectors = [F.lit(None).cast("array<double>").alias(c) for c in ("src_embedding", "dst_embedding")]
    return prepared.mapInArrow(run, prepared.select(*kept, *numbers, *vectors).schema)
