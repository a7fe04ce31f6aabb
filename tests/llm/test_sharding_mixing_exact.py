"""Sharding, mixing and exact dedup against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from quireflow.llm import exact, mixing, sharding

WS = re.compile(r"[\x20\x09-\x0D]")


def jump(key: int, n: int) -> int:
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (2147483648.0 / ((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_sharding(which, request, spark):
    from pyspark.sql import functions as F

    df = request.getfixturevalue(which)
    got = sharding.shard_documents(df, "doc_id", "text", 16).collect()
    rows = df.select("doc_id", "text", F.xxhash64("doc_id").alias("k")).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()), "key", jump(r.k, 16), jump(r.k, 17)) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_jumps_of_extreme_keys(spark):
    from pyspark.sql import functions as F

    keys = [0, 1, -1, 2**63 - 1, -(2**63), 12345678901234567, 2**32, 2**33 - 1]
    for n in (1, 2, 7, 100):
        got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_shards(F.col("k"), n).alias("j")).collect()
        assert [(r.j.shard, r.j.grown) for r in got] == [(jump(r.k, n), jump(r.k, n + 1)) for r in got]


def water(sizes: dict, weights=(5, 2, 1), repeats=3) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    capped: dict = {}
    while True:
        free = [s for s in names if s not in capped]
        left = sum(sizes.values()) - sum(capped.values())
        over = [s for s in free if left * w[s] / sum(w[x] for x in free) > repeats * sizes[s]]
        if not over:
            return {s: capped[s] if s in capped else left * w[s] / sum(w[x] for x in free) for s in names}
        capped |= {s: float(repeats * sizes[s]) for s in over}


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_mixing(which, request):
    df = request.getfixturevalue(which)
    rows = df.select("doc_id", "text", "source").collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes: Counter = Counter()
    for r in rows:
        sizes[r.source] += count(r.text)
    targets = water(sizes)
    got = mixing.mix(df, "doc_id", "text", "source").collect()
    want = Counter((r.doc_id, count(r.text), sizes[r.source], round(targets[r.source], 6)) for r in rows)
    assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in got) == want
    assert all(r.taken % max(r.size, 1) == 0 and 0 <= r.taken <= 3 * r.size for r in got)
    total, budget = sum(r.taken for r in got), sum(sizes.values())
    largest = max(r.size for r in got)
    assert budget - largest <= total <= budget
    if which == "docs":
        src, taken = {r.doc_id: r.source for r in rows}, Counter()
        for r in got:
            taken[src[r.doc_id]] += r.taken
        assert all(abs(taken[s] - targets[s]) <= largest for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(3), "doc_id", "text", "source").collect()))


def test_targets_cap_and_reshare(spark):
    rows = [("0a", 10), ("0b", 1000), ("0c", 5), ("1", 400)]
    got = {r.skey: r.target for r in mixing.source_targets(spark.createDataFrame(rows, "skey string, size long"), (5, 2, 1), 3).collect()}
    want = water({"a": 10, "b": 1000, "c": 5, None: 400})
    assert got == pytest.approx({"0a": want["a"], "0b": want["b"], "0c": want["c"], "1": want[None]})


@pytest.mark.parametrize("which", ["docs", "odd"])
@pytest.mark.parametrize("limit", [exact.TABLE_BYTES, 2000])
def test_exact(which, limit, request):
    df = request.getfixturevalue(which)
    rows = df.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[WS.sub("", r.text or "")].append(r)
    want = []
    for text, members in groups.items():
        best = min(members, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
        for r in members:
            want.append((r.doc_id, best.doc_id, len(members), r.doc_id == best.doc_id and len(r.text or "") == len(best.text or ""), hashlib.sha256(text.encode()).hexdigest()))
    got = exact.exact_dedup(df, "doc_id", "text", limit).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


@pytest.mark.parametrize("which", ["docs", "odd"])
@pytest.mark.parametrize("limit", [exact.TABLE_BYTES, 2000])
def test_kept_rows(which, limit, request):
    df = request.getfixturevalue(which)
    best: dict = {}
    for r in df.collect():
        key = WS.sub("", r.text or "")
        rank = (-len(r.text or ""), r.doc_id is None, r.doc_id or 0)
        best[key] = min(best.get(key, (rank, r)), (rank, r), key=lambda x: x[0])
    got = exact.kept_rows(df, "doc_id", "text", limit)
    assert got.columns == df.columns
    assert sorted(map(str, got.collect())) == sorted(str(r) for _, r in best.values())


def test_table_compares_contents(tmp_path):
    records = [(5, b"d", b"one", 1, 3, 1, None), (5, b"d", b"two", 1, 3, 2, None), (5, b"d", b"one", 1, 9, 3, None)]
    got = sorted((r[2], r[3], r[5]) for r in exact.grouped(records * 3, str(tmp_path), 0, 100))
    assert got == [(b"one", 6, 3), (b"two", 3, 2)]


def test_empty(empty):
    assert sharding.shard_documents(empty, "doc_id", "text").collect() == []
    assert mixing.mix(empty, "doc_id", "text", "source").collect() == []
    assert exact.exact_dedup(empty, "doc_id", "text").collect() == []


def test_table_spreads_below_the_recursion(tmp_path):
    """Buckets of every depth take about the same time: what the recursion has sorted by still spreads over the slots."""
    import random

    rng, most = random.Random(1), 0
    for depth in (0, 3, 8, 14):
        table, h = exact.OpenTable(), {rng.getrandbits(64) >> 4 * depth << 4 * depth | 5 for _ in range(4000)}
        for k in h:
            table.add((k, b"", b"%d" % k, 1, 1, 1, None))
        runs, run = [], 0
        for s in table.slots:
            run = run + 1 if s >= 0 else 0
            runs.append(run)
        most = max(most, *runs)
    assert most < 200
    records = [(rng.getrandbits(64), b"d", b"%d" % k, 1, 3, k, None) for k in range(3000)]
    assert sorted(r[2] for r in exact.grouped(records, str(tmp_path), 0, 2000)) == sorted(r[2] for r in records)


def test_any_id_type(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c"), (None, "c")], "doc_id long, text string")
    for kind in ("decimal(12,2)", "string", "int", "date", "timestamp", "binary"):
        key = F.to_date(F.from_unixtime("doc_id")) if kind == "date" else F.timestamp_seconds("doc_id") if kind == "timestamp" else F.col("doc_id").cast(kind if kind != "binary" else "string").cast(kind)
        got = exact.exact_dedup(df.select(key.alias("doc_id"), "text"), "doc_id", "text").collect()
        assert sorted(r.group_size for r in got) == [2, 2, 2, 2] and len({r.text_sha256 for r in got}) == 2, kind


def test_many_equal_rows_are_dealt_gapless_slots(spark):
    df = spark.range(150_000).selectExpr("cast(7 as long) as doc_id", "'same' as text")
    got = sharding.shard_documents(df, "doc_id", "text").selectExpr("count(distinct slot) as n", "min(slot) as a", "max(slot) as b").first()
    assert tuple(got) == (150_000, 0, 149_999)
