"""Window graphs: node numbers, degrees, one hop, window means, attention.

A window holds at most `size` flows, so a (keys, window) group is bounded no
matter how the silos or hosts are distributed.  The functions on windowed flows
therefore shuffle once, by (keys, window_id), and do everything else as window
functions inside that partitioning: a flow becomes two rows, one per end; sorting
by address brings the ends of a host together (sums over a host), sorting by
position brings the two ends of a flow together (a look at the other end).
"""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowloom.functions import scalar as S
from flowloom.operators.windows import row_windows
from flowloom.sources.flows import DST, SRC
from flowloom.stage import partition_count

#: Bytes of files behind one partition of a window graph: a flow becomes two rows that carry vectors and lie in several sorts.
ENDS_BYTES = 1 << 22
WHOLE = (Window.unboundedPreceding, Window.unboundedFollowing)


def hop_weights(hops: int, weights: Sequence[float] | None) -> list[float]:
    """1, 1/2, 1/3, ... unless given; one weight per distance 0..hops."""
    chosen = list(weights) if weights is not None else [1.0 / (d + 1) for d in range(hops + 1)]
    if len(chosen) != hops + 1:
        raise ValueError(f"{hops} hops need {hops + 1} weights")
    return chosen


class _Ends:
    """Window specifications on the two-rows-per-flow table of `group` columns."""

    def __init__(self, group: Sequence[str]):
        self.group = list(group)
        self.host = Window.partitionBy(*group, "ip").rowsBetween(*WHOLE)
        self.flow = Window.partitionBy(*group, "pos_in_window").orderBy("end")


def with_start_vector(df: DataFrame, ip: str, out: str, dim: int) -> DataFrame:
    """Add the unit vector of the projected address octets.

    Octets, projected values and length are columns of their own before the array
    is built, so each is computed once instead of once per place that uses it.
    """
    octets = {f"_{out}_o{k}": o for k, o in enumerate(S.ip_octets(F.col(ip)))}
    projected = S.project([F.col(c) for c in octets], S.projection(dim))
    values = {f"_{out}_p{i}": v for i, v in enumerate(projected)}
    vector = [F.col(c) for c in values]
    length = f"_{out}_norm"
    df = df.withColumns(octets).withColumns(values).withColumn(length, S.norm(vector))
    df = df.withColumn(out, F.array(*S.unit(vector, F.col(length))))
    return df.drop(*octets, *values, length)


def _split_ends(edges: DataFrame, group: Sequence[str], payload: Sequence[str], dim: int | None = None) -> DataFrame:
    """Two rows per flow, after the one shuffle of the window graph.

    With `dim`, a row carries `start` (vector of its own host), and the row of the
    source carries `message` (vector of the other end).
    """
    edges = edges.repartition(partition_count(edges, ENDS_BYTES), *group)
    source = [F.lit(0).alias("end"), F.col(SRC).alias("ip"), F.col(DST).alias("peer_ip")]
    target = [F.lit(1).alias("end"), F.col(DST).alias("ip"), F.col(SRC).alias("peer_ip")]
    if dim:
        edges = with_start_vector(with_start_vector(edges, SRC, "_src", dim), DST, "_dst", dim)
        nothing = F.lit(None).cast("array<double>")
        source += [F.col("_src").alias("start"), F.col("_dst").alias("message")]
        target += [F.col("_dst").alias("start"), nothing.alias("message")]
    ends = F.array(F.struct(*source), F.struct(*target))
    return edges.select(*group, "pos_in_window", *payload, F.inline(ends))


def _first_seen() -> Column:
    """Order of first appearance: all sources by position, then all destinations."""
    return F.struct(F.col("end").alias("end"), F.col("pos_in_window").alias("pos"))


def _with_node_ids(ends: DataFrame, w: _Ends) -> DataFrame:
    seen = ends.withColumn("first", F.min(_first_seen()).over(w.host))
    numbered = Window.partitionBy(*w.group).orderBy("first")
    return seen.withColumn("node_id", F.dense_rank().over(numbered) - 1)


def _is_first(ends: DataFrame) -> Column:
    return F.col("first") == _first_seen()


def node_ids(edges: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, ip, node_id) per window, numbered by first appearance."""
    w = _Ends(group)
    numbered = _with_node_ids(_split_ends(edges, group, []), w)
    return numbered.filter(_is_first(numbered)).select(*group, "node_id", "ip")


def edge_list(edges: DataFrame, group: Sequence[str], payload: Sequence[str] = ()) -> DataFrame:
    """Flows with `src_node` and `dst_node`."""
    w = _Ends(group)
    numbered = _with_node_ids(_split_ends(edges, group, payload), w)
    paired = numbered.withColumn("dst_node", F.lead("node_id").over(w.flow))
    return paired.filter(F.col("end") == 0).select(
        *group, "pos_in_window", *payload, F.col("node_id").alias("src_node"), "dst_node"
    )


def out_degree(edges: DataFrame, group: Sequence[str]) -> DataFrame:
    """Edges leaving every node of a window, parallel ones counted, 0 for pure destinations."""
    w = _Ends(group)
    numbered = _with_node_ids(_split_ends(edges, group, []), w)
    counted = numbered.withColumn("out_degree", F.count_if(F.col("end") == 0).over(w.host))
    return counted.filter(_is_first(counted)).select(*group, "node_id", "ip", "out_degree")


def _mean_over_out_edges(ends: DataFrame, w: _Ends, dim: int, out: str) -> DataFrame:
    """Mean of the messages of a host's outgoing flows; zeros for a host without any."""
    count = F.count_if(F.col("end") == 0).over(w.host)
    sums = [F.sum(m).over(w.host) for m in S.items("message", dim)]
    mean = F.array(*[F.when(F.col("_n_out") == 0, 0.0).otherwise(F.col(f"_m{i}") / F.col("_n_out")) for i in range(dim)])
    ends = ends.withColumns({"_n_out": count, **{f"_m{i}": s for i, s in enumerate(sums)}})
    return ends.withColumn(out, mean).drop("_n_out", *[f"_m{i}" for i in range(dim)])


def propagate(edges: DataFrame, group: Sequence[str], dim: int = 4) -> DataFrame:
    """One hop: mean of the start vectors of a node's destinations."""
    w = _Ends(group)
    ends = _with_node_ids(_split_ends(edges, group, [], dim), w)
    out = _mean_over_out_edges(ends, w, dim, "vector")
    return out.filter(_is_first(out)).select(*group, "node_id", "ip", "vector")


def window_mean(edges: DataFrame, group: Sequence[str], width: int) -> DataFrame:
    """Mean edge vector per window."""
    return edges.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_edges"),
        F.array(*[F.avg(f) for f in S.items("features", width)]).alias("context"),
    )


def pane_means(
    edges: DataFrame, keys: Sequence[str], size: int, step: int, width: int, pos: str = "flow_id", total: str = "n_rows"
) -> DataFrame:
    """`window_mean` of all full windows of indexed edges, for overlapping windows without a row per flow and window.

    Flows are added up once, in panes of gcd(size, step) positions; every window is made of whole
    panes, so windows of panes are row windows over the panes.
    """
    pane = gcd(size, step)
    sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(S.items("features", width))]
    panes = edges.groupBy(*keys, F.expr(f"{pos} div {pane}").alias("pane"), F.expr(f"{total} div {pane}").alias("n_panes")).agg(
        F.count(F.lit(1)).alias("n"), *sums
    )
    windows = row_windows(panes, size // pane, step // pane, pos="pane", total="n_panes")
    means = [F.sum(f"s{i}") / F.sum("n") for i in range(width)]
    return windows.groupBy(*keys, "window_id").agg(F.sum("n").alias("n_edges"), F.array(*means).alias("context"))


def attention_aggregate(
    edges: DataFrame, group: Sequence[str], dim: int, width: int, edge_weights: Sequence[float] | None = None
) -> DataFrame:
    """Per destination: sum of source vectors weighted by a softmax over its incoming flows.

    The score of a flow is the scaled dot product of both end vectors plus
    `edge_weights` times its features.  Needs the columns of `context.graph_windows`.
    """
    src, dst = S.items("src_embedding", dim), S.items("dst_embedding", dim)
    score = S.add([a * b for a, b in zip(src, dst, strict=True)]) / float(dim) ** 0.5
    if edge_weights is not None:
        score = score + S.add([f * float(c) for f, c in zip(S.items("features", width), edge_weights, strict=True)])
    edges = edges.repartition(*group)
    incoming = Window.partitionBy(*group, "dst_node").rowsBetween(*WHOLE)
    scored = edges.withColumn("attention_score", score)
    scored = scored.withColumn("mass", F.exp(F.col("attention_score") - F.max("attention_score").over(incoming)))
    weighted = [F.sum(F.col("mass") * v) / F.sum("mass") for v in S.items("src_embedding", dim)]
    return scored.groupBy(*group, "dst_node").agg(
        F.count(F.lit(1)).alias("n_in"), F.array(*weighted).alias("aggregated")
    )
