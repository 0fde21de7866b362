"""Scoring micro-batches: every batch is one graph, like one message of flows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowloom.operators.context import ContextSpec
from flowloom.operators.features import encode
from flowloom.operators.wholegraph import HUB_ROWS, Keep, find_hubs, score_frame, written
from flowloom.sources.flows import FeatureSpec
from flowloom.stage import own_tables


def score_batch(
    flows: DataFrame, encoder: DataFrame, coef: np.ndarray, features: FeatureSpec, dim: int, flow_key: str, keep: Keep = written, hub_rows: int = HUB_ROWS
) -> DataFrame:
    """Flows of one batch as one graph, with `probability_anomalous` (a reconstruction error).

    `encoder` holds one row, `coef` the coefficients of the model; `flow_key` is a unique
    number of the flow.  Between hops the hosts' state is persisted, no table is written, and
    nothing in the plan depends on the batch, so all batches share their compiled code.
    """
    spec = ContextSpec((), features.width, dim)
    keyed = flows.withColumns({"enc": F.lit("all"), "flow_id": F.col(flow_key).cast("bigint")})
    edges = keep(encode(keyed, F.broadcast(encoder), features, ["enc"]))
    # a host can be a hub only in a batch of many flows
    scored = score_frame(edges, coef, spec, find_hubs(edges, [], edges.count(), hub_rows), keep)
    return scored.select(*flows.columns, F.col("score").alias("probability_anomalous"))


def start_scoring(
    stream: DataFrame,
    score: Callable[[DataFrame, Keep], DataFrame],
    output: str,
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Score every micro-batch into its own folder of `output`.

    A batch that is replayed after a failure overwrites its own folder, so the
    output holds every flow once.  A table of hubs, where there are any, is removed once the
    scores stand.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        with own_tables(batch.sparkSession):
            held: list[DataFrame] = []

            def keep(df: DataFrame) -> DataFrame:
                # lost blocks are computed again from the source of the batch
                held.append(df.persist())
                return held[-1]

            score(batch, keep).write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")
            for df in held:
                df.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
