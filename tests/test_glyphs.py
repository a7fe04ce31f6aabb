"""Samples of glyphs: choices by hash, and a plan that sends no table to the driver."""

from quireflow.operators import measures
from quireflow.plans import model_queries


def _hash(at, ch):
    h = 2166136261
    for c in f"{at}:{ch}":
        h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
    return h


def test_choices(spark):
    text = "abababaaaaxb" * 4
    want, last = [], {}
    for at, ch in enumerate(text):
        n = min(4, text.count(ch))
        k = _hash(at, ch) % n
        last[ch] = k = (k + 1) % n if n > 1 and last.get(ch) == k else k
        want.append((at, ch, k))
    marks = spark.createDataFrame([(1, at, ch) for at, ch in enumerate(text)], "id long, at int, ch string")
    assert sorted(tuple(r) for r in measures.sample_choice(marks).select("at", "ch", "choice").collect()) == want


def test_no_join(spark):
    """The counts of samples come from the fold's own group: nothing is broadcast or joined."""
    plan = model_queries.glyph_samples(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
