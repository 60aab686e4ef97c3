"""Structured Streaming forms: running totals, first-seen rows with a consistency check, windows on event time."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.session import drop_at_end, shared_folder


def running_totals(stream: DataFrame, by: str = "source") -> DataFrame:
    """Rows and token sums so far, by source (output mode complete)."""
    return stream.groupBy(by).agg(F.count("*").alias("rows"), F.sum("train_tokens").alias("train_tokens"))


def first_seen(stream: DataFrame, key: str = "source_row_hash") -> DataFrame:
    """The first row of each key as it arrives."""
    return stream.dropDuplicates([key])


def single_valued(stream: DataFrame, key: str, values: tuple[str, ...]) -> DataFrame:
    """(key, rows, consistent): whether all rows of a key so far have the values of the first; nulls count as a value (mode complete)."""
    one = F.to_json(F.struct(*values), {"ignoreNullFields": "false"})
    return stream.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows"), (F.min(one) == F.max(one)).alias("consistent"))


def first_seen_within(stream: DataFrame, key: str, event_time: str, lateness: str) -> DataFrame:
    """First rows with bounded state: repeats are dropped if they come within the lateness."""
    return stream.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, event_time: str = "ts", width: str = "1 hour", lateness: str | None = None, by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """(window_start, by, n, total): counts and sums in tumbling windows of the event time, batch or stream.

    The time is cast to a timestamp (of the session zone), which watermarks need.
    """
    timed = events.withColumn("_t", F.col(event_time).cast("timestamp"))
    if lateness:
        timed = timed.withWatermark("_t", lateness)
    out = timed.groupBy(F.window("_t", width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), *by, "n", "total")


def run_available(spark: SparkSession, path: str, build: Callable[[DataFrame], DataFrame], mode: str = "complete") -> DataFrame:
    """Run a query over the files of a table that are there now and return what it has put out.

    Each batch is written to a table in the shared folder: in its place for the output mode complete, else added.
    """
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        reader, path = reader.option("pathGlobFilter", at.getName()), at.getParent().toString()  # a stream reads folders
    out = build(reader.parquet(path))
    folder = f"{shared_folder(spark).rstrip('/')}/gradeloom-stream-{uuid.uuid4().hex}"
    how = "overwrite" if mode == "complete" else "append"

    def write(part: DataFrame, _: int) -> None:
        part.write.mode(how).parquet(folder + "/rows")

    query = out.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", folder + "/state").trigger(availableNow=True).start()
    query.awaitTermination()
    drop_at_end(spark, folder)
    rows = spark._jvm.org.apache.hadoop.fs.Path(folder + "/rows")
    if not rows.getFileSystem(spark._jsc.hadoopConfiguration()).exists(rows):  # nothing came
        return spark.createDataFrame([], out.schema)
    return spark.read.schema(out.schema).parquet(folder + "/rows")
