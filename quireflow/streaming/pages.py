"""Streams: page lifecycle, versioned upserts, debounce and event-time windows."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Events as a stream over a folder of Parquet files, or over one file, in order of their time of writing."""
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        # the source takes folders only
        source, path = source.option("pathGlobFilter", at.getName()), at.getParent().toString()
    rows = source.parquet(path)
    # watermarks need instants, files may hold local times
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.simpleString() == "timestamp_ntz"})


def tumbling(events: DataFrame, ts: str, width: str, late: str) -> DataFrame:
    """Counts and sums by event type in tumbling windows; rows later than the watermark are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("value") * 100).cast("long")).alias("cents")).select(F.col("w.start").alias("start"), "event_type", "n", "cents")


def sliding(events: DataFrame, ts: str, width: str, step: str, late: str) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def bursts(events: DataFrame, ts: str, key: str, pause: str, late: str) -> DataFrame:
    """Session windows: bursts of a key's events that are less than ``pause`` apart, with the last one."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, pause).alias("s"), key).agg(F.count("*").alias("n"), F.max_by("event_id", F.struct(ts, "event_id")).alias("last_id")).select(key, F.col("s.start").alias("start"), "n", "last_id")


def first_of_each(events: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """One row a key within the watermark: requests that are under way aren't made again."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def enriched(events: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Stream-static join."""
    return events.join(dim, key, "left")


def upsert_sink(spark: SparkSession, path: str, keys: list[str], version: str):
    """A foreachBatch function that keeps the newest version of each key in a table of versions.

    Each micro-batch is written under its number, so a batch that is run again replaces its own output; the newest row
    of each key is picked when the table is read. Older results that come late never win.
    """

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), version).alias("r")).select("r.*")
        newest.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def newest_rows(spark: SparkSession, path: str, keys: list[str], version: str) -> DataFrame:
    rows = spark.read.option("basePath", path).parquet(path).drop("batch")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), version).alias("r")).select("r.*")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share. Only a local master (tests) may leave it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        return "file://" + tempfile.mkdtemp(prefix="quireflow-")
    raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")


def drain(stream: DataFrame, name: str, mode: str, checkpoint: str, keys: list[str] | None = None) -> DataFrame:
    """All that a stream gives for what its source holds now, as a Parquet table beside the checkpoint.

    Each micro-batch is written by the executors under its number, so one that is run again replaces its own output. Of
    complete results the last batch counts, of updates the last batch of each key, of appends all batches.
    """
    spark, path = stream.sparkSession, f"{checkpoint}-{name}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.foreachBatch(write).queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).option("basePath", path).parquet(path)
    if mode == "complete":
        return rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0]).drop("batch")
    if mode == "update":
        return rows.withColumn("last", F.max("batch").over(Window.partitionBy(*keys))).where("batch = last").drop("batch", "last")
    return rows.drop("batch")
