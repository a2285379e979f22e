"""Incremental validation over edge streams (an extension; the batch operators define the semantics).

Edges arrive with an event time; late ones beyond the watermark are dropped by Spark. The running degree
of each room is a streaming aggregate, and each micro-batch is checked against the rooms' exits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def degrees(edges: DataFrame) -> DataFrame:
    """Streaming (graph_id, room_id, d): every edge counts at both ends."""
    ends = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("room_id"))
    return ends.groupBy("graph_id", "room_id").agg(F.count("*").alias("d"))


def windowed_counts(edges: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Edges a graph and tumbling window of the event time `ts`, final once the watermark has passed."""
    return edges.withWatermark("ts", late).groupBy("graph_id", F.window("ts", size).alias("w")).agg(F.count("*").alias("n")).select("graph_id", F.col("w.start").alias("start"), "n")


def fire_exit_changes(edges: DataFrame, nodes: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Start a query that hands each batch's rooms with changed degree and their fire-exit verdict to sink(df, batch)."""
    rooms = nodes.filter("occupancy >= 50").select("graph_id", "room_id", "exits")

    def each(batch: DataFrame, n: int) -> None:
        sink(batch.join(rooms, ["graph_id", "room_id"]).select("graph_id", "room_id", "d", "exits", (F.col("d") >= F.col("exits")).alias("ok")), n)

    return degrees(edges).writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
