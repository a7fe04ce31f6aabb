"""The corpus pipeline: quality rules, exact dedup, SimHash near-dedup, mixing to target weights, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, whatever further ones and whatever names they have.

Nulls, empty and long texts, ties and repeated rows have a defined result in every stage, which its docstring states; an
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quireflow.llm.common import dropped, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose n-grams are likely enough under the trusted documents.

    Null and empty texts have no words and go. Each row is judged by its own text: null and repeated ids, repeated rows too.
    """
    from quireflow.llm.quality import good_rows, trusted_ids

    return good_rows(docs, trusted_ids(table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, white space apart: that of most code points, then of the smallest id, null last.

    Null texts are empty texts. Of rows equal in these, repeated ones say, any one stays.
    """
    from quireflow.llm.exact import kept_rows

    return kept_rows(docs, "doc_id", "text")


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group whose 5-word shingles are similar by 0.8 or more.

    Rows of a null id stay, and link others. Rows that repeat id and text stay or go together; of equal texts with
    different ids the smallest id stays. Texts without words (null, empty) are like each other.
    """
    from quireflow.llm.nearsets import first_of_each

    return first_of_each(docs, "doc_id", "text")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, as often as it takes them: each row by its own text, null and repeated ids too.

    Rows that repeat id and text are served together, as one record; a null source is a source; rows without words go.
    """
    from quireflow.llm.mixing import mixed_rows

    return mixed_rows(docs, "doc_id", "text", "source")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with their digests and those of the decoded text; a null text has none."""
    import public_tokenizers

    from quireflow.llm.bpe import encode_decode
    from quireflow.llm.queries import RANK_FILE

    return encode_decode(docs, "doc_id", "text", public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", simhash_dedup),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: SQL can't express the hashes, the search in Hamming space and the merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
