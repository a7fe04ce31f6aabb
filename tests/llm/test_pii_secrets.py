"""Secrets, and the field's spans on texts that another generator made: the tables' documents."""

import random
import re

import pytest

from quireflow.llm import pii

PLANTED = re.compile(r'(?i)token = "([0-9a-f]{40})"|password=([0-9a-f]+)|(AKIA[0-9A-Z]{16})')


def added(text):
    return pii.added_spans(text, pii.base_spans(text), pii.trained())


def test_secrets_of_documents(spark):
    """Recall and precision on documents of the tables, which the fit has not seen."""
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").where("text is not null").collect()
    planted = found = extra = 0
    for (text,) in rows:
        gold = {(m.start(m.lastindex), m.end(m.lastindex)) for m in PLANTED.finditer(text)}
        got = {(a, b) for k, a, b in added(text) if k == "secret"}
        planted, found, extra = planted + len(gold), found + len(gold & got), extra + len(got - gold)
    assert planted > 100 and found >= 0.97 * planted and extra <= 0.02 * found


def test_held_out_secrets():
    rng, hit, extra, gold_n = random.Random(77), 0, 0, 0
    for _ in range(1500):
        line, gold = pii._made_secret(rng)
        got = set(added(line))
        hit, extra, gold_n = hit + len(got & set(gold)), extra + len(got - set(gold)), gold_n + len(gold)
    assert hit >= 0.9 * gold_n and extra <= 0.02 * hit


@pytest.mark.parametrize("text", ["commit 9fceb02d0ae598e95dc970b74767f19372d61af8 here", "see page 2024abc or item42345", "http://example.org/en/12345/abcdef99", "Order AB-123456 of 2024-10-11", "the password is secret", "token ring networks, key 12"])
def test_lookalikes_stay(text):
    assert [s for s in added(text) if s[0] == "secret"] == []


def test_many_spans_stay_near_linear():
    import time

    def seconds(n):
        text = " ".join(f"(555) 123-{k:04d} foo +1 (314) 555-{k:04d} password=a{k}b{k}c" for k in range(n))
        start = time.perf_counter()
        assert len(added(text)) >= n
        return time.perf_counter() - start

    seconds(100)
    assert seconds(4000) < 4 * seconds(2000)
