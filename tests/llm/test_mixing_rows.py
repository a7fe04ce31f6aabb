"""The mixing stage serves each row by its own count, whatever its id."""

import re
from collections import Counter

import corpus_pipeline
from quireflow.llm import mixing


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_null_and_repeated_ids(spark):
    rows = [(None, f"null {k} " + "a b c " * k, "s1") for k in range(6)] + [(7, f"same {k} " + "d e " * (3 * k), f"s{k % 3}") for k in range(9)]
    rows += [(20, "twice the same row", "s0")] * 4 + [(30 + k, f"row {k} " + "f g " * k, f"s{k % 3}") for k in range(20)] + [(99, None, None), (None, "no source", None)]
    df = spark.createDataFrame([(d, t, "en", s, k) for k, (d, t, s) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.mix_sources(spark, df, "").collect()
    mixed = mixing.mix(df, "doc_id", "text", "source").where("taken > 0").collect()
    # the words that the queue served are those of the rows, id by id
    served, given = Counter(), Counter()
    for r in mixed:
        served[r.doc_id] += r.taken
    for r in got:
        given[r.doc_id] += size(r.text)
    assert None in served and served == given
    assert sum(given.values()) <= sum(size(t) for _, t, _ in rows)
    # every row is one of the input's and none comes more than three times
    assert set(map(tuple, got)) <= set(map(tuple, df.collect())) and max(Counter(map(tuple, got)).values()) <= 3
