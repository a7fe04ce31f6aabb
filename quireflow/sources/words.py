"""Recognised words with page geometry.

``words`` derives a deterministic table of word boxes from the text of documents: one line a text line, 40 px apart,
10 px a character, with gaps, heights and confidences drawn from a digest of the word's position. A page is a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, word_no, text, x, y, width, height, confidence, h).

    Texts are dealt by document before they are taken apart: the shuffle moves each text once, and every later window
    or aggregate by document finds its rows in place. The number of partitions is given, as adaptive execution would join
    them by their few bytes of text.
    """
    dealt = docs.select("doc_id", "text").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    lines = dealt.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    tokens = lines.select("doc_id", "line_no", F.posexplode(F.split("line", " ")).alias("word_no", "text")).where("text <> ''")
    drawn = tokens.withColumn("h", F.conv(F.substring(F.md5(F.concat_ws(":", "doc_id", "line_no", "word_no")), 1, 4), 16, 10).cast("long"))
    before = Window.partitionBy("doc_id", "line_no").orderBy("word_no").rowsBetween(Window.unboundedPreceding, -1)
    width = 10 * F.length("text")
    gap = F.when(F.col("h") % 7 == 0, 60).otherwise(10)
    return drawn.select(
        "doc_id", "line_no", "word_no", "text", F.coalesce(F.sum(width + gap).over(before), F.lit(0)).cast("long").alias("x"), (40 * F.col("line_no")).cast("long").alias("y"),
        width.cast("long").alias("width"), (20 + F.col("h") % 5).alias("height"), (F.col("h") % 101).alias("confidence"), "h",
    )


def page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(read(spark, sf_dir, "documents"))


#: The same table for DuckDB, as the beginning of a WITH clause.
WORDS_SQL = """
lines AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
tokens AS (SELECT doc_id, line_no, generate_subscripts(w, 1) - 1 AS word_no, unnest(w) AS text FROM (SELECT doc_id, line_no, string_split(line, ' ') AS w FROM lines)),
drawn AS (SELECT *, ('0x' || substr(md5(doc_id || ':' || line_no || ':' || word_no), 1, 4))::BIGINT AS h FROM tokens WHERE text <> ''),
words AS (SELECT doc_id, line_no, word_no, text,
  coalesce(sum(10 * length(text) + CASE WHEN h % 7 = 0 THEN 60 ELSE 10 END) OVER (PARTITION BY doc_id, line_no ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS x,
  (40 * line_no)::BIGINT AS y, (10 * length(text))::BIGINT AS width, (20 + h % 5)::BIGINT AS height, (h % 101)::BIGINT AS confidence, h FROM drawn)"""
