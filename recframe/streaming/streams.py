"""Structured Streaming forms of the batch operators, and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recframe.session import shared_dir


def events_stream(spark: SparkSession, folder: str, name: str = "*.parquet", files_per_trigger: int = 1) -> DataFrame:
    """The files of a folder whose names match, as a stream; new files are taken up as they appear."""
    schema = spark.read.option("pathGlobFilter", name).parquet(folder).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", name).parquet(folder)
    # event time needs a zone: plain timestamps are taken in the session's, which is UTC
    return rows.select([F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in rows.dtypes])


def access_counts(stream: DataFrame, key: str) -> DataFrame:
    """Running access counts, for update or complete mode; the state has a row for each key."""
    return stream.groupBy(key).agg(F.count(F.lit(1)).alias("cnt"))


def tumbling(stream: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "10 minutes", key: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums by event-time window; rows later than the watermark are dropped, state with it."""
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("window.start").alias("start"), key, "n", "total")


def sessions(stream: DataFrame, ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour", key: str = "user_id") -> DataFrame:
    """Sessions by a gap in event time."""
    s = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), key).agg(F.count(F.lit(1)).alias("n"))
    return s.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and gives the result, written to the folder that all executors share.

    Append mode gives what the watermark has closed; complete mode also what is still open at the end, such as the last
    session of each key: each micro-batch writes the whole result and the last one's is read.
    """
    base = f"{shared_dir(stream.sparkSession)}/{name}"
    writer = stream.writeStream.option("checkpointLocation", f"{base}-progress").trigger(availableNow=True)
    if mode == "append":
        writer.outputMode(mode).format("parquet").start(base).awaitTermination()
        return stream.sparkSession.read.schema(stream.schema).parquet(base)
    last: list[int] = []

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/{batch}")  # a batch that is run again replaces its own files
        last.append(batch)

    writer.outputMode(mode).foreachBatch(write).start().awaitTermination()
    read = stream.sparkSession.read.schema(stream.schema)
    return read.parquet(f"{base}/{max(last)}") if last else stream.sparkSession.createDataFrame([], stream.schema)
