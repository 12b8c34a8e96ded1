"""Drift detection driven by the event stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from landwatch.plans.detect import detect_drift
from landwatch.session import free_shuffles
from landwatch.sources.landed_store import read_landed
from landwatch.sources.state import compact_state


def stream_detect_drift(
    syncs: DataFrame,
    landed_fn: Callable[[SparkSession], DataFrame] | str,
    root: str,
    checkpoint: str,
    system_columns: tuple[str, str],
    connections: DataFrame | None = None,
    model_fn: Callable[[str], str] | None = None,
    available_now: bool = False,
    compact_every: int | None = None,
) -> StreamingQuery:
    """Run detection for the connections of every micro-batch.

    ``landed_fn`` returns the current landed columns and is called once per batch; given as a
    path, it names columns stored by ``write_landed``, of which a batch reads the folders of its
    own connections. Every ``compact_every`` batches the state is compacted. Ids depend
    on the content only, so a batch replayed after a failure repeats rows instead of adding
    new ones, and a lost event is made up for by the connection's next sync.
    """

    def run(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            spark = batch.sparkSession
            landed = read_landed(spark, landed_fn, batch) if isinstance(landed_fn, str) else landed_fn(spark)
            detect_drift(batch, landed, root, system_columns, connections, model_fn)
            if compact_every and (number + 1) % compact_every == 0:
                compact_state(spark, root)
            free_shuffles(spark)

    writer = syncs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
