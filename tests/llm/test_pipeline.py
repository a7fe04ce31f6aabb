"""The pipeline's stages against plain Python, each on its own input."""

import hashlib
import os
import re
import shutil
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quireflow.llm import quality
from tests.llm.test_quality_simhash_urls import base, buckets, signed
from tests.llm.test_sharding_mixing_exact import water

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.toPandas()
        stage(spark, docs, SF).write.parquet(str(folder / str(k)))
        docs = spark.read.parquet(str(folder / str(k)))
        out.append((before, docs.toPandas()))
    return out


def rows(pdf):
    return Counter(map(tuple, pdf[COLUMNS].itertuples(index=False)))


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "SimHash near-dedup", "mixing", "byte-level BPE"]
    assert all(list(after.columns) == COLUMNS for _, after in stages[:-1])


def test_quality_stage(stages, spark):
    import math

    before, after = stages[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    good = set(labels[labels.quality == 1].doc_id)
    raw, target = Counter(), Counter()
    for d, t in zip(before.doc_id, before.text):
        raw.update(buckets(t))
        if d in good:
            target.update(buckets(t))
    n, t_n = sum(raw.values()), sum(target.values())
    ratio = {}
    for b, c in raw.items():
        e = target[b] + quality.PRIOR * c / n
        x = math.log(e / ((t_n + quality.PRIOR) * c / n))
        ratio[b] = round(math.copysign(max(0, abs(x) - quality.ERRORS / math.sqrt(e)), x) * quality.UNIT)
    want = [not base(t)[-1] and sum(ratio[b] for b in buckets(t)) >= math.floor(quality.THRESHOLD * quality.UNIT) * len(buckets(t)) for t in before.text]
    assert rows(after) == rows(before[want])
    assert len(after) > 0.3 * len(before)


def test_exact_stage(stages):
    before, after = stages[1]
    best = {}
    for r in before.itertuples():
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text)
        best[key] = min(best.get(key, (1, 0)), (-len(r.text), r.doc_id))
    assert rows(after) == rows(before[before.doc_id.isin({d for _, d in best.values()})])


def near_copies(texts):
    """Class of each text by brute force: shingles of five words, similar by 0.8 or more, all pairs."""
    sets = []
    for t in texts:
        w = [x.translate(LOWER) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    return [find(k) for k in range(len(sets))]


LOWER = {c: c + 32 for c in range(65, 91)}


def stay_of_near(data):
    """Rows (id, text, ...) that stay, by brute force: of a class the least id, of its texts with that id the least hash."""
    texts = sorted({r[1] or "" for r in data})
    of = dict(zip(texts, near_copies(texts), strict=True))
    rank = lambda r: (r[0], signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)))
    low = {}
    for r in data:
        if r[0] is not None:
            low[of[r[1] or ""]] = min(low.get(of[r[1] or ""], rank(r)), rank(r))
    return Counter(r for r in data if r[0] is None or rank(r) == low[of[r[1] or ""]])


def test_near_stage(stages):
    """The rule of the stage is five words and a similarity of 0.8 (not the four bits of the query op2)."""
    before, after = stages[2]
    assert rows(after) == stay_of_near(list(map(tuple, before[COLUMNS].itertuples(index=False))))


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def queue(data):
    """Times that each (id, text, source) is served, by brute force: one queue in order of virtual finish time."""
    size, copies = Counter(), Counter((r[0], r[1] or "", r[3]) for r in data)
    for (_, t, s), n in copies.items():
        size[s] += n * words(t)
    targets, names = water(size), sorted(size, key=lambda s: (s is None, s or ""))
    servings = []
    for k, s in enumerate(names):
        at = 0
        md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
        for draw, key in sorted((md5(f"mix:{'null' if c[0] is None else c[0]}:{md5(c[1])}"), c) for c in copies if c[2] == s):
            n = copies[key] * words(key[1])
            at += n
            servings += [((e * size[s] + at) / targets[s], k, e, at, n, key) for e in range(3) if n]
    used, times = 0, Counter()
    for *_, n, key in sorted(servings, key=lambda x: x[:4]):
        used += n
        if used > sum(size.values()):
            break
        times[key] += 1
    return times


def test_mixing_stage(stages):
    before, after = stages[3]
    data = list(map(tuple, before[COLUMNS].itertuples(index=False)))
    times = queue(data)
    want = Counter()
    for r in data:
        want[r] += times[(r[0], r[1], r[3])]
    assert rows(after) == +want
    largest = max(map(words, before.text))
    assert sum(map(words, before.text)) - largest <= sum(map(words, after.text)) <= sum(map(words, before.text))


def test_encoding_stage(stages):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    before, after = stages[4]
    want = Counter((r.doc_id, tuple(lib.encode_ordinary(r.text)), hashlib.sha256(r.text.encode()).hexdigest()) for r in before.itertuples())
    assert Counter((r.doc_id, tuple(np.asarray(r.ids).tolist()), r.decoded_sha256) for r in after.itertuples()) == want


def test_run_and_odd_rows(spark, odd, empty, tmp_path):
    folder = str(tmp_path / "sf")
    os.makedirs(folder)
    shutil.copy(f"{SF}/labels.parquet", f"{folder}/labels.parquet")
    odd.select(COLUMNS).write.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in got} <= {7, 8}
    for stage in (s for _, s in corpus_pipeline.STAGES[:-1]):
        assert stage(spark, empty.select(COLUMNS), folder).collect() == []
        kept = stage(spark, odd, folder)
        assert kept.columns == odd.columns and kept.count() <= 3 * odd.count()


def test_null_and_repeated_ids_in_every_stage(spark):
    """Each stage's rows, counted, against brute force; names that clash with the stages' own, or have dots, come through."""
    text = lambda k, n: " ".join(f"w{(k * 37 + j * j) % 911}" for j in range(n))
    near = text(1, 90).split()
    near[45] = "other"
    data = [(None, text(1, 90)), (None, text(2, 70)), (None, text(2, 70)), (5, text(3, 80)), (5, text(4, 60)), (5, text(4, 60)), (5, " ".join(near)), (6, text(5, 55)), (6, text(5, 55) + " "),
            (7, None), (7, ""), (None, None), (8, text(6, 3000)), (9, text(7, 20)), (None, " ".join(near)), (10, text(3, 80))]
    rows_in = [(d, t, None if k % 3 else "en", (None, "a", "b", "c")[k % 4], k) for k, (d, t) in enumerate(data)]
    rows_in += rows_in[3:6]
    names = ["_quality", "_digest", "mix_key", "mix_turn", "near_node", "near_low", "kept", "times", "size", "a.b", "node", "text_sha256", "turn", "skey", "draw", "last", "target"]
    df = spark.createDataFrame(rows_in, "doc_id long, text string, lang string, source string, n_chars long")
    wide = df.select("*", *[F.lit(str(k)).alias(n) for k, n in enumerate(names)])
    counted = lambda out: Counter(tuple(r)[:5] for r in out.collect())

    def out(stage):
        got = stage(spark, wide, SF)
        assert got.columns == wide.columns
        return counted(got)

    kept = out(corpus_pipeline.quality_rules)
    judged = {k for k in rows_in if (k in kept)}
    assert kept == Counter(r for r in rows_in if r in judged) and all(not base(r[1])[-1] for r in judged)

    best = {}
    for r in rows_in:
        key, rank = re.sub(r"[\x20\x09-\x0D]", "", r[1] or ""), (-len(r[1] or ""), r[0] is None, r[0] or 0)
        best.setdefault(key, set()).add((rank, r))
    exact = out(corpus_pipeline.exact_dedup)
    assert sum(exact.values()) == len(best)
    for group in best.values():
        top = min(rank for rank, _ in group)
        assert sum(exact[r] for rank, r in group if rank == top) == 1

    assert out(corpus_pipeline.simhash_dedup) == stay_of_near(rows_in)

    times, want = queue(rows_in), Counter()
    for r in rows_in:
        want[r] += times[(r[0], r[1] or "", r[3])]
    assert out(corpus_pipeline.mix_sources) == +want

    assert Counter(r.doc_id for r in corpus_pipeline.encode(spark, wide, SF).collect()) == Counter(r[0] for r in rows_in)
