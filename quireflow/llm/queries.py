"""The registered queries of the training-data operators: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quireflow.llm.common import table
from quireflow.llm.oracles import ORACLES

#: Vocabulary files of the installed package of public tokenizers.
RANK_FILE = "byte_bpe_50k.tiktoken"
JSON_FILE = "byte_bpe_50k.json"


def op1_llr_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quireflow.llm.quality import judge, trusted_ids

    return judge(table(spark, sf_dir, "documents"), trusted_ids(table(spark, sf_dir, "labels")))


def op2_simhash_gph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quireflow.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


def op3_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from quireflow.llm.reputation import judge

    outcomes = table(spark, sf_dir, "labels").select("doc_id", (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    return judge(table(spark, sf_dir, "pages"), outcomes)


def op4_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quireflow.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), "doc_id", "text", 16)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quireflow.llm.bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


def op6_fair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quireflow.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), "doc_id", "text", "source")


def op7_semicrf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quireflow.llm.pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"), "doc_id", "text")


def op8_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quireflow.llm.exact import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"), "doc_id", "text")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quireflow.llm.tokencount import token_counts

    return token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path(JSON_FILE), public_tokenizers.PATTERN)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quireflow.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_llr_quality, op2_simhash_gph, op3_url_reputation, op4_jump_sharding, op5_byte_bpe, op6_fair_mixing, op7_semicrf_pii, op8_grace_dedup, op9_token_counts, op10_license_scan)
}
