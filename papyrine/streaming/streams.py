"""Streams over growing files: windows, sessions, deduplication and keyed maintenance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.sources.workdir import work_folder


def events_stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """The table as a stream of files; ``ts`` becomes a TIMESTAMP, which watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")
    return files.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str, write: Callable[[DataFrame, int], None], name: str) -> None:
    """Run a stream over all that is there, then stop; progress is kept in the shared folder."""
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", work_folder(stream.sparkSession, f"progress-{name}")).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def drained(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """What a stream has emitted once all input is read; in complete mode the last batch is the whole result."""
    path = work_folder(stream.sparkSession, name)
    how = "overwrite" if mode == "complete" else "append"
    drain(stream, mode, lambda batch, _: batch.write.mode(how).parquet(path), name)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def tumbling(events: DataFrame, width: str, *keys: str, delay: str = "1 day") -> DataFrame:
    """Counts and sums by window; rows later than ``delay`` behind the newest are dropped where the mode allows."""
    w = events.withWatermark("ts", delay).groupBy(F.window("ts", width), *keys)
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, width: str, step: str, *keys: str, delay: str = "1 day") -> DataFrame:
    """Overlapping windows."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width, step), *keys).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, gap: str, key: str, delay: str = "1 day") -> DataFrame:
    """Runs of a key's events with no pause of ``gap``."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n"))


def first_seen(events: DataFrame, *keys: str, delay: str = "60 days") -> DataFrame:
    """Each key once within the watermark; state is dropped behind it."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))
