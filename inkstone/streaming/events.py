"""Events as a stream: the same validation as in batches, each micro-batch written once, however often it is tried.

Windowed counts with a watermark are an addition of this engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkstone.operators.behaviour import append_events


def ingest(batches: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the valid events of a stream of request bodies to a table, each micro-batch as an ingest of its own.

    A micro-batch that fails half way is run again under its number and replaces what it
    wrote; stored_events reads the table.
    """

    def write(rows: DataFrame, number: int) -> None:
        append_events(rows, path, f"batch-{number}")

    return batches.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """(start, end, event, n) of tumbling windows over created_at; later events than `late` are dropped."""
    timed = events.withColumn("at", F.timestamp_millis("created_at")).withWatermark("at", late)
    rows = timed.groupBy(F.window("at", width).alias("w"), "event").agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event", "n")


def deduplicated(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events without the repeats that a client's retries send."""
    timed = events.withColumn("at", F.timestamp_millis("created_at")).withWatermark("at", late)
    return timed.dropDuplicatesWithinWatermark(["session_id", "event", "extra_json"])
