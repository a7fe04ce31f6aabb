import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def doc_rows(docs):
    return docs.toPandas()


def odd_rows() -> pd.DataFrame:
    """Nulls in any column, empty and very long texts, ties, repeated rows, and column names that operators use themselves."""
    long_text = " ".join(f"word{k % 977}" for k in range(60_000))
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \t\n", None), (None, "only text", "b"), (4, "same words here now and then", "b"),
        (5, "same words here now and then", "b"), (5, "same words here now and then", "b"), (6, "same  words here now and then ", None),
        (7, long_text, "c"), (8, "x" * 20_000, "c"), (9, "naïve Ünïcode 😀   tab\tend", None), (10, "<|endoftext|> 's 12 34", "a"),
    ]
    return pd.DataFrame(rows, columns=["doc_id", "text", "source"])


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    pdf = odd_rows()
    df = spark.createDataFrame([tuple(None if v is None or v != v else v for v in r) for r in pdf.itertuples(index=False)], "doc_id double, text string, source string")
    clashing = {c: F.lit(7) for c in ("size", "digest", "cell", "draw", "rank", "cum", "epoch", "finish", "n", "h", "copies", "keep_id", "jump", "slot", "fp", "value", "component_id", "bucket", "score")}
    return df.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.lit(None).cast("long")).withColumns(clashing)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
