"""Words of documents are dealt over all partitions, however few bytes their texts have."""

from quireflow.sources.words import page_words


def test_words_keep_their_partitions(spark):
    assert page_words(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
