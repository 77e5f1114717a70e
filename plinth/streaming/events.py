"""Progress events as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..storage import scratch

#: job_id, stage, event_id, ts, done (0 started, 1 completed)
EVENT_SCHEMA = "job_id long, stage string, event_id long, ts timestamp, done int"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The event log as a stream; a late subscriber first gets the backlog, then what arrives."""
    return spark.readStream.schema(EVENT_SCHEMA).parquet(path)


def append_events(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to the log, each event once."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def latest_status(events: DataFrame) -> DataFrame:
    """Last stage and state of each job, updated as events arrive; state is one row a job."""
    last = F.max(F.struct("ts", "event_id", "stage", "done")).alias("last")
    return events.groupBy("job_id").agg(last).select("job_id", F.col("last.stage").alias("stage"), F.col("last.done").alias("done"), F.col("last.ts").alias("ts"))


def stage_times(events: DataFrame, late: str = "10 minutes", longest: str = "1 hour") -> DataFrame:
    """Start joined with completion of each stage; watermarks and the time bound let state go."""
    start = events.where("done = 0").select(F.col("job_id").alias("j"), F.col("stage").alias("s"), F.col("ts").alias("started")).withWatermark("started", late)
    done = events.where("done = 1").select("job_id", "stage", F.col("ts").alias("completed")).withWatermark("completed", late)
    inside = (F.col("completed") >= F.col("started")) & (F.col("completed") <= F.col("started") + F.expr(f"interval {longest}"))
    met = start.join(done, (F.col("j") == F.col("job_id")) & (F.col("s") == F.col("stage")) & inside)
    return met.select("job_id", "stage", "started", "completed")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by stage and tumbling window, late ones within the watermark included."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "stage").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "stage", "n")


def deliver(events: DataFrame, path: str, checkpoint: str) -> None:
    """Hand a subscriber what has arrived since the last call, the backlog first.

    The checkpoint knows what was delivered, so each event comes once; a
    delivery that is cut short is made again in place of itself.  Deliveries are
    folders of Parquet below ``path``, numbered from 0 (column ``delivery``).
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/delivery={number}")

    events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what has arrived so far; its result as a table in the shared folder.

    Executors write each batch as Parquet, nothing is collected.  In complete
    mode the last batch is the result, else all of them are.
    """
    spark = stream.sparkSession
    path = scratch(spark)
    batches: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batches/{number}")
        batches.append(number)

    writer = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    if not batches:
        return spark.createDataFrame([], stream.schema)
    kept = batches[-1:] if mode == "complete" else sorted(set(batches))
    return spark.read.schema(stream.schema).parquet(*[f"{path}/batches/{n}" for n in kept])


def upsert_pages(pages: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each batch of arriving pages to ``apply``, which must replace rows by key."""
    return pages.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
