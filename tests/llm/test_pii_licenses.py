"""Personal data and license scans against plain regular expressions, exhaustive search and held-out lines."""

import hashlib
import itertools
import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quireflow.llm import licenses, pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0


def plain(text):
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


bits = st.lists(st.sampled_from(["1", "25", "300", ".", ".", "@", "@", "a", "b.c", "-", " ", "+1", "(5)", "4111 1111 1111 1111", "é", "\n", "٣", "+1 (389) 555-5010", "10.0.0.1", "x@y.zz", "0000", "%"]), max_size=25).map("".join)


@settings(max_examples=1500, deadline=None)
@given(bits)
def test_patterns(text):
    assert sorted(pii.base_spans(text)) == sorted(plain(text))


def test_long_runs_stay_linear():
    for text in ("1" * 300_000, "1." * 100_000, "+1 " * 50_000, "a@" * 50_000, "a." * 100_000 + "@", "1 " * 100_000, ":" * 100_000):
        pii.added_spans(text, pii.base_spans(text), pii.trained())


def test_held_out_lines():
    weights, hit, extra, gold_n = pii.trained(), 0, 0, 0
    for line, gold in pii.examples(1234, 1500):
        base = pii.base_spans(line)
        want = {g for g in gold if not any(b[1] < g[2] and g[1] < b[2] for b in base)}
        got = set(pii.added_spans(line, base, weights))
        hit, extra, gold_n = hit + len(got & want), extra + len(got - want), gold_n + len(want)
    assert hit >= 0.85 * gold_n and extra <= 0.02 * hit


def test_viterbi_is_the_best_path():
    weights = pii.trained()
    for text in ("call (555) 123-4567 or 555.987.6543", "mail jo (at) site (dot) com", "4111/1111/1111/1111 12 34"):
        for a, b in pii.stretches(text):
            tokens, cand = pii.segments(text, a, b)
            arcs = [(i, i + n, y, sum(weights.get((k, f), 0.0) for f in feats)) for i, mine in enumerate(cand) for n, feats in mine for y, k in enumerate(pii.KINDS)]
            arcs = [x for x in arcs if x[3] > 0]
            best = 0.0
            for r in range(1, 4):
                for some in itertools.combinations(arcs, r):
                    s = sorted(some)
                    if all(p[1] <= q[0] for p, q in zip(s, s[1:])):
                        best = max(best, sum(x[3] for x in some))
            got = sum(next(x[3] for x in arcs if x[:3] == m) for m in pii.viterbi(cand, weights))
            assert got == pytest.approx(best)


def test_gradient_is_that_of_the_likelihood():
    text = "x (555) 123-4567 y"
    (a, b), = pii.stretches(text)
    tokens, cand = pii.segments(text, a, b)
    n, feats = next((n, f) for mine in cand for n, f in mine)
    start = next(i for i, mine in enumerate(cand) if mine)
    gold, w = {(start, start + n, 3)}, {("phone", "bias"): 0.3, ("card", "space"): -0.2}

    def log_likelihood(w):
        def paths(i):
            if i == len(cand):
                yield 0.0, frozenset()
                return
            for s, g in paths(i + 1):
                yield s, g
            for m, f in cand[i]:
                for y, k in enumerate(pii.KINDS):
                    for s, g in paths(i + m):
                        yield s + sum(w.get((k, x), 0.0) for x in f), g | {(i, i + m, y)}

        every = list(paths(0))
        return next(s for s, g in every if g == gold) - math.log(sum(math.exp(s) for s, _ in every))

    grad = pii.gradient(cand, gold, w)
    for key in (("phone", "bias"), ("card", "bias"), ("phone", f"n{sum(c.isdigit() for c in text)}")):
        up = log_likelihood({**w, key: w.get(key, 0) + 1e-5}) - log_likelihood({**w, key: w.get(key, 0) - 1e-5})
        assert grad.get(key, 0.0) == pytest.approx(up / 2e-5, abs=1e-4)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_query(which, request):
    df = request.getfixturevalue(which)
    rows = df.select("doc_id", "text").collect()
    want = []
    for r in rows:
        b = plain(r.text or "")
        said = ",".join(f"{k}:{x}:{y}" for kind in pii.BASE_KINDS for k, x, y in sorted(b) if k == kind)
        want.append((r.doc_id, *(sum(s[0] == k for s in b) for k in pii.BASE_KINDS), hashlib.sha256(said.encode()).hexdigest()))
    got = pii.personal_data(df, "doc_id", "text").collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:6]) for r in got)
    texts = {r.doc_id: r.text for r in rows}
    for r in got:
        assert r.n_added == len([s for s in r.spans.split(",") if s]) - (r.n_email + r.n_ip + r.n_card + r.n_phone)
        for s in filter(None, r.spans.split(",")):
            kind, a, b = s.split(":")
            assert kind in pii.KINDS and 0 <= int(a) < int(b) <= len(texts[r.doc_id])


def test_every_license_is_found_whole():
    index = licenses.default_index()
    for name, text in licenses.TEMPLATES.items():
        plain_text = text.replace("{", "").replace("}", "")
        found = licenses.scan_text("Älter foo\n" + plain_text.upper() + "\nbar", index)
        assert [(f[0], f[2]) for f in found] == [(name, 1.0)]
        assert ("Älter foo\n" + plain_text)[found[0][3] : found[0][4]].lower().startswith(plain_text.split()[0].lower().strip('"'))


def test_changed_licenses_and_relatives():
    index = licenses.default_index()
    words = licenses.TEMPLATES["MIT"].split()
    changed = " ".join(["lorem"] * 30 + words[:40] + ["other", "words", "here"] + words[42:90] + words[93:])
    assert [f[0] for f in licenses.scan_text(changed, index)] == ["MIT"]
    assert licenses.scan_text("Released under the XYZ License. This work is licensed under the GNU General Public License, version 4.", index) == []
    twice = licenses.scan_text("Released under the MIT License. foo " * 3, index)
    assert [f[0] for f in twice] == ["MIT:line"] * 3


def longest(a, b, diagonal=0, band=10**9):
    """Longest common subsequence by brute force, of matches within a band around a diagonal."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            same = a[i] == b[j] and abs(j - i - diagonal) <= band
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + same)
    return best[-1][-1]


def test_alignment_is_longest():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(3, 16)), rng.integers(0, 4, rng.integers(3, 30))
        diagonal, band = int(rng.integers(-3, 12)), int(rng.integers(1, 13))
        pairs = licenses.aligned(a, b, diagonal, band)
        assert all(a[i] == b[j] and abs(j - i - diagonal) <= band for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert len(pairs) == longest(a, b, diagonal, band)


def test_spans_and_coverage_of_changed_templates():
    """A changed template among foreign words: matched words, coverage and span against the longest common subsequence."""
    import random

    rng, index = random.Random(4), licenses.default_index()
    for name, text in licenses.TEMPLATES.items():
        words, needed = licenses.tokenised(text)
        for _ in range(4):
            out = []
            for k, w in enumerate(words):
                if k in needed or rng.random() > 0.08:
                    out.append(w)
                elif rng.random() < 0.5:
                    out.append("zzq")
                if rng.random() < 0.03:
                    out.append("zzx")
            before, after = ["zza"] * rng.randint(0, 40), ["zzb"] * rng.randint(0, 40)
            doc, most = " ".join(before + out + after), longest(words, out)
            found = licenses.scan_text(doc, index)
            if most < licenses.COVERAGE * len(words):
                assert name not in [f[0] for f in found]
                continue
            same = [f for f in found if f[0] == name]
            if not same:  # a relative that matches more words took the place, or no run of three words is left
                assert (found and max(f[1] for f in found) >= most) or len(words) < licenses.SHORT
                continue
            (_, n, share, a, b), = same
            assert n == most and share == most / len(words)
            first, last = next(w for w in out if not w.startswith("zz")), next(w for w in reversed(out) if not w.startswith("zz"))
            assert doc[a:b].split()[0] == first and doc[a:b].split()[-1] == last and not {"zza", "zzb"} & set(doc[a:b].split())


def test_templates_from_a_table(spark):
    body = " ".join(f"clause{k} of the {'own' if k % 3 else 'house'} license" for k in range(400))
    table = spark.createDataFrame([("Own-1.0", body), ("Line", "use it as {Bob} says"), ("None", None)], "name string, text string")
    docs = spark.createDataFrame([(1, f"foo {body} bar"), (2, "please use it as Bob says now"), (3, "use it as Eve says"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: (r.licenses, r.best_coverage, r.spans) for r in licenses.scan(docs, "doc_id", "text", templates=table).collect()}
    assert got == {1: ("Own-1.0", 1.0, f"Own-1.0:4:{4 + len(body)}:2000"), 2: ("Line", 1.0, "Line:7:25:5"), 3: ("", 0.0, ""), 4: ("", 0.0, "")}


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_scan_finds_every_notice(which, request):
    df = request.getfixturevalue(which)
    notice = re.compile(r"(?i)this work is licensed under the gnu general public license, version 3|licensed under cc by-nc 4\.0|released under the mit license|licensed under the apache license, version 2\.0")
    texts = {(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()}
    places = {d: [m.span() for m in notice.finditer(t or "")] for d, t in texts}
    got = licenses.scan(df, "doc_id", "text").collect()
    assert len(got) == df.count()
    by = {r.doc_id: r.n_matches for r in got}
    for d, t in texts:
        if d is not None:
            assert by[d] == len(notice.findall(t or ""))
    for r in got:
        spans = [tuple(map(int, s.rsplit(":", 3)[1:3])) for s in filter(None, r.spans.split(","))]
        assert r.doc_id is None or spans == places[r.doc_id]
        assert r.best_coverage == (1.0 if spans else 0.0)


def test_empty(empty):
    assert pii.personal_data(empty, "doc_id", "text").collect() == []
    assert licenses.scan(empty, "doc_id", "text").collect() == []
