"""The pipeline's near-dedup stage against the similarity of all pairs, and its recall on planted near copies."""

import random

import corpus_pipeline
from quireflow.llm import nearsets


def test_planted_copies_go(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    rows, copies = [], []
    for k in range(150):
        words = [word() for _ in range(rng.randint(120, 400))]
        rows.append((2 * k, " ".join(words)))
        changed = list(words)
        for at in rng.sample(range(len(words)), max(1, len(words) // rng.choice([50, 70, 100]))):
            changed[at] = word()
        rows.append((2 * k + 1, " ".join(changed)))
    sets = {d: nearsets.shingles(t) for d, t in rows}
    copies = [d + 1 for d in range(0, 300, 2) if nearsets.similar(sets[d], sets[d + 1])]
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, df, "").collect()}
    # nothing that isn't similar goes, and nearly all that is goes
    assert set(sets) - set(copies) <= kept
    assert len(copies) > 50 and len(kept & set(copies)) <= 0.03 * len(copies)


def test_different_texts_near_in_bits_stay(spark):
    """Within four bits by chance or not, a text of another content is no copy."""
    rows = [(1, "one two three four"), (2, "one two three four five"), (3, ""), (4, " \n"), (None, "one two three four")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.simhash_dedup(spark, df, "").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 1), (False, 2), (False, 3), (True, 0)]
