"""Pieces that the training-data operators share."""

from __future__ import annotations

import os
import random
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The characters that part words: space, tab, newline, vertical tab, form feed, carriage return.
WS_CHARS = " \t\n\x0b\x0c\r"
WS_CLASS = r"[\x20\x09-\x0D]"
WORD_REGEX = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master (tests) may leave it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_before.isDefined():
            folder = set_before.get()
        elif not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        else:
            folder = "file://" + tempfile.mkdtemp(prefix="quireflow-")
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, lineage cut, readable after the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_path = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by ``written``, once everything that reads them is itself written."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def spill_folder() -> str:
    """On an executor: one of Spark's local directories, which Spark itself removes if the worker is killed."""
    given = [d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if d and os.path.isdir(d)]
    return random.choice(given) if given else tempfile.gettempdir()


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def columns(df: DataFrame) -> list[Column]:
    return [F.col(quoted(c)) for c in df.columns]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until df has no column of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def spread(count: Column, at: str, df: DataFrame, *keep: Column) -> DataFrame:
    """df with ``at`` = 0 .. count - 1, a row each; two steps, so no array holds more than 65,536 numbers or count / 65,536."""
    step = F.lit(1 << 16)
    (chunk,) = fresh(df, "chunk")
    some = df.select(*keep, count.alias(f"{chunk}n"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((count - 1) / step))).alias(chunk))
    first = F.col(chunk) * step
    return some.withColumn(at, F.explode(F.sequence(first, F.least(first + step, F.col(f"{chunk}n")) - 1))).drop(chunk, f"{chunk}n")


def numbered(df: DataFrame, order: list[str], at: str, name: str) -> DataFrame:
    """df with its position (from 0) in a total order: range-sorted, numbered inside each range, moved by the ranges' counts.

    Only a count for each range is summed up in one place. The result reads a table in the shared folder (``written_path``).
    """
    part, before = fresh(df, "part", "before")
    ranges = written(df.repartitionByRange(*[F.col(quoted(c)) for c in order]).withColumn(part, F.spark_partition_id()), name)
    # one row for each range, whatever the rows
    counts = ranges.groupBy(part).agg(F.count("*").alias(before))
    moved = counts.withColumn(before, F.coalesce(F.sum(before).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy(part).orderBy(*[F.col(quoted(c)) for c in order])
    out = ranges.join(F.broadcast(moved), part).withColumn(at, F.col(before) + F.row_number().over(inside) - 1).drop(part, before)
    out.written_path = ranges.written_path
    return out


#: Rows of an Arrow batch for whole texts; Spark's default of 10,000 holds tens of MB on both sides of the pipe.
BATCH_ROWS = 1000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def over_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow in small batches, unless the session sets a size itself; unused Arrow memory goes back after each batch."""
    spark = df.sparkSession
    if spark.conf.get(_BATCH_KEY, None) is None:
        spark.conf.set(_BATCH_KEY, str(BATCH_ROWS))

    def tidy(batches):
        import pyarrow as pa

        for out in run(batches):
            yield out
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(tidy, schema)


def let(value: Column, body) -> Column:
    """body(value) with value computed once. An expression used inside a lambda would be computed for every element."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    flat = F.translate(F.coalesce(text, F.lit("")), WS_CHARS[1:], " " * (len(WS_CHARS) - 1))
    return F.array_remove(F.split(flat, " ", -1), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
