"""A whole frame as one graph.

Here a graph is as large as the frame, so nothing may be done per graph: parallel edges are
reduced to one row with a multiplicity before they meet host vectors, and every sum is an
aggregate with map-side combine.

All hop vectors are sums of start vectors, and those lie in the four dimensions of the octets,
whatever the size of the projection.  So hops carry four coordinates u of a vector u * M (M is
the projection), and lengths come from the 4 x 4 products of M.  A hop is one join, with the
pairs that lie where the messages of their destinations are, and one aggregate, which takes the
contributions to a host and the host's own state as rows of one table.  A state is read by the
next hop and by itself, so it is kept (`Keep`): written for frames of any size, or persisted
for the time of a micro-batch.

A host with very many edges would be a hot join key.  Hosts above a limit are found by a count
and split: their rows on the many side are dealt over salts, their one row is repeated for each.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions import scalar as S
from flowloom.operators.context import ContextSpec
from flowloom.operators.graph import hop_weights
from flowloom.operators.prefix import prefix_index
from flowloom.sources.flows import DST, SRC
from flowloom.stage import materialize, small

Keep = Callable[[DataFrame], DataFrame]

#: Rows of one host that a join leaves in one place at least, and the most hosts that are split.
HUB_ROWS, HUBS = 100_000, 10_000
MESSAGE, TOTAL, GOT = (tuple(f"{p}{k}" for k in range(4)) for p in ("m", "t", "g"))


def written(df: DataFrame) -> DataFrame:
    return materialize(df, "hop")


def frame_nodes(edges: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """(keys, node_id, ip): all sources by first position, then the other destinations."""
    ends = F.array(
        F.struct(F.col(SRC).alias("ip"), F.lit(0).alias("end")), F.struct(F.col(DST).alias("ip"), F.lit(1).alias("end"))
    )
    seen = edges.select(*keys, F.col(pos).alias("pos"), F.inline(ends))
    first = seen.groupBy(*keys, "ip").agg(F.min(F.struct("end", "pos")).alias("first"))
    flat = first.select(*keys, "ip", F.col("first")["end"].alias("end"), F.col("first")["pos"].alias("pos"))
    return prefix_index(flat, keys, ["end", "pos"], name="node_id", total=None).drop("end", "pos")


# ---- hot hosts


@dataclass(frozen=True)
class Hubs:
    """(keys, ip, parts): hosts that are split, a table of at most HUBS rows; None if no host can be one."""

    keys: tuple[str, ...]
    table: DataFrame | None = None

    def join(self, many: DataFrame, hosts: DataFrame, at: str, spread: Column, how: str = "inner") -> DataFrame:
        """`many` with the row of `hosts` for its column `at`; both keep their other columns."""
        on = [*self.keys, at]
        one = hosts.withColumnRenamed("ip", at)
        if self.table is None:
            return many.join(one, on, how)
        parts = F.broadcast(self.table.withColumnRenamed("ip", at))
        count = F.coalesce("parts", F.lit(1))
        dealt = many.join(parts, on, "left").withColumn("salt", F.pmod(F.xxhash64(spread), count)).drop("parts")
        copies = F.explode(F.sequence(F.lit(0).cast("bigint"), (count - 1).cast("bigint")))
        return dealt.join(one.join(parts, on, "left").withColumn("salt", copies).drop("parts"), [*on, "salt"], how).drop("salt")


def find_hubs(edges: DataFrame, keys: Sequence[str], rows: int, least: int = HUB_ROWS) -> Hubs:
    """Hosts at either end of more than `least` of the `rows` edges, and of more than one in HUBS of them."""
    limit = max(least, 2 * rows // HUBS)
    if rows <= limit:
        return Hubs(tuple(keys))
    ends = edges.select(*keys, F.explode(F.array(SRC, DST)).alias("ip")).groupBy(*keys, "ip").agg(F.count("*").alias("n"))
    return Hubs(tuple(keys), materialize(ends.filter(F.col("n") > limit).select(*keys, "ip", F.ceil(F.col("n") / limit).alias("parts")), "hubs"))


# ---- hops


def _matrix(dim: int) -> np.ndarray:
    found = S.projection(dim)
    return np.eye(4) if found is None else found


def _length(names: Sequence[str], dim: int) -> str:
    """Length of the vector with these coordinates, as SQL; round-off of zero counts as 1."""
    products = _matrix(dim) @ _matrix(dim).T
    square = " + ".join(f"{float(products[i, j])!r}D * {a} * {b}" for i, a in enumerate(names) for j, b in enumerate(names))
    return f"CASE WHEN sqrt(greatest({square}, 0.0D)) < 1e-9D THEN 1.0D ELSE sqrt(greatest({square}, 0.0D)) END"


def frame_pairs(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, src, dst, n): edges with their multiplicity."""
    return edges.groupBy(*keys, SRC, DST).agg(F.count(F.lit(1)).alias("n"))


def frame_coordinates(pairs: DataFrame, keys: Sequence[str], dim: int, hops: int = 3, weights: Sequence[float] | None = None, hubs: Hubs | None = None, keep: Keep = written) -> DataFrame:
    """(keys, ip, t0 .. t3): coordinates of every host's sum of hop vectors."""
    weight = hop_weights(hops, weights)
    hubs = hubs or Hubs(tuple(keys))
    keys = list(keys)
    # every host once, with the number of edges that leave it
    ends = pairs.select(*keys, F.inline(F.array(F.struct(F.col(SRC).alias("ip"), F.col("n").alias("degree")), F.struct(F.col(DST).alias("ip"), F.lit(0).cast("bigint").alias("degree")))))
    hosts = ends.groupBy(*keys, "ip").agg(F.sum("degree").alias("degree"))
    octets = hosts.select(*keys, "ip", "degree", *[o.alias(f"o{k}") for k, o in enumerate(S.ip_octets(F.col("ip")))])
    sized = octets.selectExpr("*", f"{_length([f'o{k}' for k in range(4)], dim)} AS length")
    state = sized.selectExpr(*keys, "ip", "degree", *[f"o{k} / length AS {MESSAGE[k]}" for k in range(4)], *[f"o{k} / length * {weight[0]!r}D AS {TOTAL[k]}" for k in range(4)])
    for d in range(1, hops + 1):
        state = keep(state)
        sent = state.selectExpr(*keys, "ip", *MESSAGE)
        met = hubs.join(pairs, sent, DST, F.col(SRC))
        parts = met.selectExpr(*keys, f"{SRC} AS ip", "0L AS degree", *[f"n * {m} AS {g}" for m, g in zip(MESSAGE, GOT, strict=True)], *[f"0.0D AS {t}" for t in TOTAL])
        own = state.selectExpr(*keys, "ip", "degree", *[f"0.0D AS {g}" for g in GOT], *TOTAL)
        sums = parts.unionByName(own).groupBy(*keys, "ip").agg(*[F.sum(c).alias(c) for c in ("degree", *GOT, *TOTAL)])
        mean = sums.selectExpr(*keys, "ip", "degree", *TOTAL, *[f"CASE WHEN degree = 0 THEN 0.0D ELSE {g} / degree END AS {g}" for g in GOT])
        scaled = mean.selectExpr("*", f"{weight[d]!r}D / ({_length(GOT, dim)}) AS factor")
        state = scaled.selectExpr(*keys, "ip", "degree", *[f"{g} - {g} * factor AS {m}" for g, m in zip(GOT, MESSAGE, strict=True)], *[f"{t} + {g} * factor AS {t}" for g, t in zip(GOT, TOTAL, strict=True)])
    return keep(state.selectExpr(*keys, "ip", *TOTAL))


def _vector(names: Sequence[str], dim: int) -> Column:
    """The vector of dimension `dim` with these coordinates."""
    matrix = _matrix(dim)
    return F.expr("array(" + ", ".join(" + ".join(f"{float(matrix[k, j])!r}D * {name}" for k, name in enumerate(names)) for j in range(dim)) + ")")


def frame_embeddings(
    edges: DataFrame,
    nodes: DataFrame,
    keys: Sequence[str],
    dim: int = 32,
    hops: int = 3,
    weights: Sequence[float] | None = None,
) -> DataFrame:
    """Nodes with `embedding`."""
    pairs = materialize(frame_pairs(edges, keys), "pairs")
    found = frame_coordinates(pairs, keys, dim, hops, weights, find_hubs(pairs, keys, pairs.count()))
    return nodes.join(found, [*keys, "ip"]).withColumn("embedding", _vector(TOTAL, dim)).drop(*TOTAL)


# ---- predictors and scores


def _names(side: str, width: int) -> list[str]:
    return [f"{side}_s{i}" for i in range(width)]


def _met(edges: DataFrame, keys: list[str], spec: ContextSpec, pairs: DataFrame, hubs: Hubs, keep: Keep = written) -> DataFrame:
    """Edges with the sums, count and coordinates of both ends and the sums of their frame; `features` stay."""
    w = spec.width
    places = frame_coordinates(pairs, keys, spec.dim, spec.hops, spec.weights, hubs, keep)
    out = edges
    for end, side in ((SRC, "src"), (DST, "dst")):
        sums = edges.groupBy(*keys, F.col(end).alias("ip")).agg(*[F.sum(F.col("features")[i]).alias(n) for i, n in enumerate(_names(side, w))], F.count(F.lit(1)).alias(f"{side}_n"))
        named = places.selectExpr(*keys, "ip", *[f"{t} AS {side}_{t}" for t in TOTAL])
        hosts = sums.join(named, [*keys, "ip"])
        # a written table has a known size: as long as the hosts fit a broadcast, no edge is moved to them
        few = small(hosts := written(hosts)) if keep is written else None
        out = hubs.join(out, hosts, end, F.col("flow_id")) if few is None else out.join(few.withColumnRenamed("ip", end), [*keys, end])
    frame = edges.groupBy(*keys).agg(*[F.sum(F.col("features")[i]).alias(n) for i, n in enumerate(_names("frame", w))], F.count(F.lit(1)).alias("frame_n"))
    # one row a frame
    return out.join(F.broadcast(frame), keys) if keys else out.crossJoin(F.broadcast(frame))


def _others(side: str, i: int) -> str:
    """Mean of entry i over the other edges behind the sums of a side; 0 if there is none."""
    return f"CASE WHEN {side}_n = 1 THEN 0.0D ELSE ({side}_s{i} - features[{i}]) / ({side}_n - 1) END"


def frame_addresses(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ip) of all hosts, without numbers."""
    return edges.select(*keys, F.explode(F.array(SRC, DST)).alias("ip")).distinct()


def single_graph(edges: DataFrame, spec: ContextSpec) -> DataFrame:
    """Edges of the frame with predictors, as `context.endpoint_context` has them per window.

    `spec.group` names the frame(s).  Edges need `features`; labels are 0.
    """
    keys = list(spec.group)
    edges = materialize(edges, "edges")
    pairs = materialize(frame_pairs(edges, keys), "pairs")
    met = _met(edges, keys, spec, pairs, find_hubs(edges, keys, edges.count()))
    context = [F.expr("array(" + ", ".join(_others(side, i) for i in range(spec.width)) + ")") for side in ("src", "dst", "frame")]
    ends = [_vector([f"{side}_{t}" for t in TOTAL], spec.dim) for side in ("src", "dst")]
    kept = [c for c in edges.columns if c not in ("label", *keys)]
    return met.select(*keys, *kept, F.lit(0).alias("label"), F.concat(F.array(F.lit(1.0)), *context, *ends).alias("predictors"))


def score_frame(edges: DataFrame, coef: np.ndarray, spec: ContextSpec, hubs: Hubs, keep: Keep = written) -> DataFrame:
    """`edges` with `score` under one model: the error of `single_graph`'s predictors, in column functions alone.

    The prediction is linear in the coordinates of both ends, so no vector is built.
    """
    keys, w = list(spec.group), spec.width
    met = _met(edges, keys, spec, keep(frame_pairs(edges, keys)), hubs, keep)
    blocks = np.split(coef[1:], [w, 2 * w, 3 * w, 3 * w + spec.dim])
    places = [_matrix(spec.dim) @ b for b in blocks[3:]]
    errors = []
    for j in range(w):
        terms = [f"{float(coef[0, j])!r}D"]
        terms += [f"{float(block[i, j])!r}D * c_{side}{i}" for side, block in zip(("src", "dst", "frame"), blocks, strict=False) for i in range(w)]
        terms += [f"{float(place[k, j])!r}D * {side}_{t}" for side, place in zip(("src", "dst"), places, strict=True) for k, t in enumerate(TOTAL)]
        errors.append(f"pow({' + '.join(terms)} - features[{j}], 2)")
    contexts = [f"{_others(side, i)} AS c_{side}{i}" for side in ("src", "dst", "frame") for i in range(w)]
    score = f"({' + '.join(errors)}) / n_features AS score"
    return met.selectExpr("*", *contexts).selectExpr(*edges.columns, score)
