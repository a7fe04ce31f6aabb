"""Quality rules, SimHash groups and URL verdicts against plain Python."""

import math
import re
from collections import Counter, defaultdict
from urllib.parse import quote

import numpy as np
import pytest
import xxhash

from quireflow.llm import quality, reputation, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    w = WORD.findall(text or "")
    at = defaultdict(list)
    for k in range(len(w) - 2):
        at[tuple(w[k : k + 3])].append(k)
    repeat = len({k + j for v in at.values() if len(v) > 1 for k in v for j in range(3)})
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, repeat, len(w) < 50 or 100 * repeat > 50 * len(w)


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def spark_hash(*longs):
    h = 42
    for x in longs:
        h = xxhash.xxh64_intdigest((x & (1 << 64) - 1).to_bytes(8, "little"), h)
    return signed(h)


def buckets(text):
    h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in WORD.findall(text or "")]
    return [x % quality.BUCKETS for x in h] + [spark_hash(a, b) % quality.BUCKETS for a, b in zip(h, h[1:])]


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_quality(which, request, spark):
    df = request.getfixturevalue(which)
    rows = df.select("doc_id", "text").collect()
    good = [r.doc_id for r in rows if r.doc_id is not None and r.doc_id % 3 == 1]
    trusted = spark.createDataFrame([(d,) for d in set(good)], "doc_id long")
    raw, target = Counter(), Counter()
    for r in rows:
        raw.update(buckets(r.text))
        if r.doc_id in good:
            target.update(buckets(r.text))
    n, t = sum(raw.values()), sum(target.values())
    ratio = {}
    for b, c in raw.items():
        e = target[b] + quality.PRIOR * c / n
        x = math.log(e / ((t + quality.PRIOR) * c / n))
        ratio[b] = round(math.copysign(max(0, abs(x) - quality.ERRORS / math.sqrt(e)), x) * quality.UNIT)
    want = Counter()
    for r in rows:
        b = buckets(r.text)
        s = sum(ratio[x] for x in b)
        v = base(r.text)
        want[(r.doc_id, *v, not v[-1] and s >= math.floor(quality.THRESHOLD * quality.UNIT) * max(len(b), 1))] += 1
    got = quality.judge(df, trusted).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got) == want


def test_repeats(spark):
    texts = ["a b c a b c", "a b c d a b c", "x x x x", "a b a b", "a b c " * 500, "one two", "", "a b c x a b c b c x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in quality.judge(df, df.select("doc_id").limit(0)).collect()}
    assert got == {k: base(t)[4] for k, t in enumerate(texts)}


def test_quality_tells_junk(spark):
    good = [(k, " ".join(f"w{(k * 7 + j * j) % 400}" for j in range(80))) for k in range(300)]
    junk = [(1000 + k, " ".join(f"w{(k * 5 + j * j) % 400}%%%" for j in range(80))) for k in range(100)]
    df = spark.createDataFrame(good + junk, "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in quality.judge(df, df.where("doc_id < 150").select("doc_id")).collect()}
    assert all(kept[k] for k in range(300)) and not any(kept[k] for k in range(1000, 1100))


def fingerprint(text):
    w = (text or "").encode().lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def component_of(fps: dict, distance=4):
    u = np.array(sorted(set(fps.values())), np.uint64)
    parent = list(range(len(u)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[k] ^ u) <= distance):
            parent[find(k)] = find(int(j))
    return {int(f): find(k) for k, f in enumerate(u)}


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_simhash(which, request):
    df = request.getfixturevalue(which)
    rows = df.select("doc_id", "text").collect()
    fps = [(r.doc_id, fingerprint(r.text)) for r in rows]
    comp = component_of({k: f for k, (_, f) in enumerate(fps)})
    low = {}
    for d, f in fps:
        if d is not None:
            low[comp[f]] = min(low.get(comp[f], d), d)
    want = Counter((d, f"{f:016x}", low.get(comp[f])) for d, f in fps)
    got = simhash.near_duplicates(df, "doc_id", "text").collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


@pytest.mark.parametrize("layout", ["four parts", "three parts", "blocks"])
def test_dense_and_chained_fingerprints(spark, layout, monkeypatch):
    """A chain, a dense cloud around one value, and strangers: same components as brute force, in both layouts and with buckets parted."""
    if layout == "three parts":
        monkeypatch.setattr(simhash, "MANY", 1)
    if layout == "blocks":
        monkeypatch.setattr(simhash, "BUCKET_ROWS", 100)
    n_cloud = 400 if layout == "three parts" else 1500
    rng = np.random.default_rng(5)
    one = np.uint64(1)
    chain, x = [], np.uint64(rng.integers(1 << 63))
    for k in range(150):
        chain.append(x)
        for b in rng.choice(64, 4, replace=False):
            x ^= one << np.uint64(b)
    centre = np.uint64(rng.integers(1 << 63))
    cloud = []
    for _ in range(n_cloud):
        y = centre
        for b in rng.choice(64, 3, replace=False):
            y ^= one << np.uint64(b)
        cloud.append(y)
    fps = sorted({int(v) for v in [*chain, *cloud, *rng.integers(1 << 63, size=500 if layout == "three parts" else 2000, dtype=np.int64)]})
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    roots = {r.node % (1 << 64): r.root for r in simhash.components(simhash._links_of(df, 4)).collect()}
    want = component_of(dict(enumerate(fps)))
    groups, mine = defaultdict(set), defaultdict(set)
    for f in fps:
        groups[want[f]].add(f)
        mine[roots.get(f, ("alone", f))].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_allocation_is_least():
    rng = np.random.default_rng(1)
    costs = np.concatenate([np.zeros((20, 4, 1)), np.cumsum(rng.integers(1, 50, (20, 4, 4)), axis=2)], axis=2).astype(float)
    import itertools

    got = simhash.allocate(costs, 1)
    for r in range(20):
        best = min(sum(costs[r, i, t + 1] for i, t in enumerate(ts)) for ts in itertools.product(range(-1, 4), repeat=4) if sum(ts) == 1)
        assert got[r].sum() == 1 and sum(costs[r, i, t + 1] for i, t in enumerate(got[r])) == best


URLS = ["http://A.Example.org/es/1?q", "https://x.org", "https://x.org/", "ftp://b.com/fr/x#f", "https://c.com/de/9", "no scheme", None, "http://b.co.uk:80/p", "http://Ü.example.com/é?x", "http://example.org/en/19", "a://b://c/d", "http://?x", "http://sub.c.com/de/", "http://notorg/x", ""]


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule(host, path):
    fits = [(len(r), r, v) for v, r in reputation.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits)[1:] if fits else (None, None)


def test_urls(spark):
    rng = np.random.default_rng(3)
    rows = [(k, u) for k, u in enumerate(URLS)] + [(100 + k, f"http://{'bad' if k % 2 else 'good'}.site{k % 5}.net/{quote(str(k))}") for k in range(400)] + [(None, "http://q.net/"), (3, URLS[3])]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as host", "2 as n", "3 as k", "4 as bad", "5 as rate")
    bad = [(100 + k, bool(k % 2) if rng.random() < 0.95 else not k % 2) for k in range(400)] + [(1, None), (None, True), (101, True)]
    got = reputation.judge(pages, spark.createDataFrame(bad, "doc_id long, bad boolean")).collect()
    assert len(got) == len(rows)
    want = Counter((i, *parts(u), rule(*parts(u))[0]) for i, u in rows)
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == want
    for r in got:
        r_rule, says = rule(r.host, r.path)
        assert r.verdict == (says or ("block" if r.bound > r.limit else "allow"))
        if r.host.startswith("bad."):
            assert r.verdict == "block"
        if r.host.startswith("good."):
            assert r.verdict == "allow"


def test_planted_hosts_at_table_scale(spark):
    """Pages of sf0.1 with ten hosts made bad at 85 % and others at the tables' own rate: precision and recall of the pages blocked."""
    from pyspark.sql import functions as F

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    host, path = reputation.url_parts(F.col("url"))
    of = pages.select("page_id", host.alias("host"), reputation.matched_rule(host, path)[0].alias("rule")).toPandas()
    hosts = sorted(of.host.unique())
    bad_hosts = set(hosts[::6][:10])
    rng = np.random.default_rng(11)
    seen = of[rng.random(len(of)) < 0.4]
    outcomes = [(int(r.page_id), bool(rng.random() < (0.85 if r.host in bad_hosts else 0.25))) for r in seen.itertuples()]
    got = reputation.judge(pages, spark.createDataFrame(outcomes, "doc_id long, bad boolean")).where("rule is null").collect()
    blocked = [r.host in bad_hosts for r in got if r.verdict == "block"]
    there = sum(r.host in bad_hosts for r in got)
    # hosts of a few labelled pages can't be told: 219 of 260 pages are blocked, and no other
    assert there > 100 and sum(blocked) >= 0.8 * there and sum(blocked) == len(blocked)


def test_suffix_table(spark):
    names = ["a.b.co.uk", "co.uk", "x.y.pvt.k12.ma.us:80", "z.com", "uk", "", "q.example.org"]
    hosts = spark.createDataFrame([(h, 1, 0) for h in names], "host string, n long, k long")
    table = spark.createDataFrame([("co.uk",), ("pvt.k12.ma.us",), ("com",)], "suffix string")
    got = {r.host: (r.domain, r.suffix) for r in reputation.table_levels(hosts, table).collect()}
    assert got == {"a.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "x.y.pvt.k12.ma.us:80": ("y.pvt.k12.ma.us", "pvt.k12.ma.us"), "z.com": ("z.com", "com"), "uk": ("uk", "uk"), "": ("", ""), "q.example.org": ("example.org", "org")}
    pages = spark.createDataFrame([(k, f"http://{h}/p") for k, h in enumerate(names)], "page_id long, url string")
    assert reputation.judge(pages, spark.createDataFrame([(0, True)], "doc_id long, bad boolean"), suffixes=table).count() == len(names)


def test_without_labels_or_rows(spark, empty):
    none = spark.createDataFrame([], "doc_id long, bad boolean")
    pages = spark.createDataFrame([(1, "http://x.net/a")], "page_id long, url string")
    assert [r.verdict for r in reputation.judge(pages, none).collect()] == ["allow"]
    assert reputation.judge(pages.limit(0), none).collect() == []
    assert simhash.near_duplicates(empty, "doc_id", "text").collect() == []
    assert quality.judge(empty, empty.select("doc_id")).collect() == []
