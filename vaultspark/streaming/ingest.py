"""Documents, queues and notices as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vaultspark.operators import text, workflow
from vaultspark.sources import sinks


def documents(spark: SparkSession, path: str, schema: str, files: int = 1000) -> DataFrame:
    """A stream of document rows from Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def chunks(docs: DataFrame) -> DataFrame:
    """The batch way from documents to chunks: it has no state, so it runs on a stream unchanged."""
    return text.ingest(docs)


def start(df: DataFrame, sink: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append to Parquet; with once, until all that is there is read."""
    writer = df.writeStream.outputMode("append").option("checkpointLocation", checkpoint).format("parquet").option("path", sink)
    return (writer.trigger(availableNow=True) if once else writer).start()


def each_batch(df: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run a batch step, such as an upsert, on every micro-batch."""
    writer = df.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def notices(queue_events: DataFrame, late: str | None = None) -> DataFrame:
    """"You are next", once per appointment: the first event with at most one ahead. queue_events: id, ahead_count, at.

    The ids that were told are the state, one each; with late, an id is
    forgotten, and may be told again, that long after its event.
    """
    near = queue_events.filter(F.col("ahead_count") <= 1)
    once = near.withWatermark("at", late).dropDuplicatesWithinWatermark(["id"]) if late else near.dropDuplicates(["id"])
    return once.select("id", "at")


def counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events of each type in tumbling windows; late ones count until the watermark passes."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs a time zone
    return timed.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def queue_monitor(changes: DataFrame, appointments: Callable[[], DataFrame], staff: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Recompute the queues of the doctors and days that a micro-batch of changed appointments touches, and replace those days in the sink.

    appointments gives all appointments as they are now: a queue depends on
    rows that did not change, too. Only the touched days are read and written.
    """
    def step(batch: DataFrame, _: int) -> None:
        days = batch.select(F.to_date("time").alias("day")).distinct()
        rows = appointments().withColumn("day", F.to_date("time")).join(days, "day", "left_semi")
        found = workflow.queue(rows, staff).join(rows.select("id", "day"), "id")
        sinks.replace_partitions(found, sink, "day")

    return each_batch(changes, step, checkpoint)
