"""Edit logs, readings, languages, fonts, files, kernels and streams."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quireflow.operators import edits, editlog, fonts, grids, languages, readings
from quireflow.operators.editlog import History, element
from quireflow.sources import dims, files


def start():
    return {"e": element("Date: 13-09-2024")}


def test_undo_redo_round():
    h = History(start())
    h.execute({"type": "setText", "element_id": "e", "text": "Date: 14"})
    assert h.present["e"]["text"] == "Date: 14" and h.present["e"]["state"] == "edited" and h.present["e"]["source"] == "Date: 13-09-2024"
    h.undo()
    assert h.present["e"]["state"] == "original"
    h.redo()
    assert h.present["e"]["text"] == "Date: 14"
    h.execute({"type": "setText", "element_id": "e", "text": "Date: 13-09-2024"})
    assert h.present["e"]["state"] == "original" and not h.future
    h.undo(), h.undo(), h.undo()
    assert len(h.past) == 0 and len(h.future) == 2


def test_system_commands_reach_every_snapshot_and_are_no_step():
    h = History(start())
    h.execute({"type": "setText", "element_id": "e", "text": "x"})
    h.replace_present({"type": "setTypography", "element_id": "e", "typography": {"alignment": "center"}})
    assert len(h.past) == 1 and h.past[0]["e"]["alignment"] == "center"
    h.execute({"type": "setAlignment", "element_id": "e", "alignment": "right"})
    h.replace_present({"type": "setTypography", "element_id": "e", "typography": {"alignment": "left"}})
    assert h.present["e"]["alignment"] == "right" and h.past[0]["e"]["alignment"] == "left"
    h.replace_present({"type": "setText", "element_id": "nobody", "text": "y"})
    assert h.present["e"]["text"] == "x"


def test_reducer_branches():
    d = start()
    d = editlog.apply_command(d, {"type": "deleteElement", "element_id": "e"})
    d2 = editlog.apply_command(d, {"type": "setSourceText", "element_id": "e", "text": "new"})
    assert d2["e"]["state"] == "deleted" and d2["e"]["text"] == "Date: 13-09-2024"
    assert editlog.apply_command(d, {"type": "restoreElement", "element_id": "e"})["e"]["state"] == "original"
    assert editlog.apply_command(d, {"type": "setText", "element_id": "e", "text": "z"})["e"]["state"] == "edited"
    s = editlog.apply_command(start(), {"type": "applyStyle", "element_id": "e", "styles": {"weight": 700}, "source_id": "f"})
    assert s["e"]["state"] == "edited" and s["e"]["style_from"] == "f"
    s = editlog.apply_command(s, {"type": "applyStyle", "element_id": "e", "styles": {"weight": None}})
    assert s["e"]["state"] == "original" and s["e"]["styles"] == {} and s["e"]["style_from"] is None
    a = editlog.apply_command(start(), {"type": "addElement", "element_id": "n", "text": "t", "x": 1.0, "y": 2.0})
    assert editlog.apply_command(a, {"type": "moveElement", "element_id": "n", "dx": 3, "dy": -1})["n"]["x"] == 4.0
    with pytest.raises(ValueError):
        editlog.apply_command(a, {"type": "moveElement", "element_id": "e", "dx": 3, "dy": -1})
    with pytest.raises(ValueError):
        editlog.apply_command(a, {"type": "setText", "element_id": "?", "text": ""})
    kept = editlog.apply_command({"a": element("x"), "b": element("y", state="edited")}, {"type": "readHandwriting", "groups": [{"element_ids": ["a", "b"], "text": "r"}, {"element_ids": ["a"], "text": "q"}]})
    assert kept["a"]["text"] == "q" and kept["b"]["text"] == "y"


def test_pages_and_patches():
    doc = editlog.Document({"e": element("a"), "f": element("b", page="p1")}, {"p0": {"status": "pending"}, "p1": {"status": "ready"}})
    ready = editlog.apply_command(doc, {"type": "updatePage", "page_id": "p0", "patch": {"status": "ready", "width": 100}})
    assert ready.pages["p0"] == {"status": "ready", "width": 100} and dict(ready) == dict(doc) and doc.pages["p0"]["status"] == "pending"
    read = editlog.apply_command(ready, {"type": "updatePage", "page_id": "p0", "patch": {"elements": {"n": {"source": "new", "text": "new"}}}})
    assert set(read) == {"f", "n"} and editlog.find_element(read, "n")[0] == "p0" and editlog.find_element(read, "f")[0] == "p1"
    for cmd in ({"type": "addElement", "element_id": "x", "page_id": "p7"}, {"type": "updatePage", "page_id": "p7", "patch": {}}, {"type": "nothing"}):
        with pytest.raises(ValueError):
            editlog.apply_command(doc, cmd)
    assert editlog.touched_element({"type": "setText", "element_id": "e"}) == "e" and editlog.touched_element({"type": "updatePage"}) is None


def test_moves_take_boxes_and_frames():
    a = editlog.apply_command(start(), {"type": "addElement", "element_id": "n", "x": 1.0, "y": 2.0})
    a = editlog.apply_command(a, {"type": "setTypography", "element_id": "n", "typography": {"alignment": "left", "frame": {"cx": 5.0, "cy": 6.0, "width": 9.0}}})
    n = editlog.apply_command(a, {"type": "moveElement", "element_id": "n", "dx": 3, "dy": -1})["n"]
    assert (n["x"], n["y"], n["box"], n["typography"]["frame"]) == (4.0, 1.0, {"cx": 4.0, "cy": 1.0}, {"cx": 8.0, "cy": 5.0, "width": 9.0})


def test_rows_that_fail_are_kept_apart():
    h = History(start())
    for payload in ('{"type":"setText","element_id":"e","text":"x"}', '{"type":"setText"}', "no json", None, '{"element_id":"e"}', '{"type":"setText","element_id":"?","text":"y"}', '{"type":"setText","element_id":"e"}'):
        h.feed("user", payload)
    assert h.present["e"]["text"] == "x" and h.failed == 6 and h.error.startswith("KeyError")
    assert History.loaded(h.saved()).saved() == h.saved()


def test_history_is_capped():
    h = History(start())
    for k in range(editlog.MAX_HISTORY + 5):
        h.execute({"type": "setText", "element_id": "e", "text": str(k)})
    assert len(h.past) == editlog.MAX_HISTORY and h.past[0]["e"]["text"] == "4"


def test_stream_folds_as_the_batch_does(spark):
    from quireflow.plans import document_queries as dq

    sf = "/root/testdata/sf0.001"
    batch = {tuple(r) for r in dq.edit_log_fold(spark, sf).collect()}
    assert {tuple(r) for r in dq.stateful_edit_log(spark, sf).collect()} == batch
    log = editlog.from_events(spark.read.parquet(f"{sf}/events.parquet")).where("doc_id = 3").orderBy("seq").collect()
    h = History(editlog.initial())
    for r in log:
        h.feed(r.kind, r.payload)
    assert {r for r in batch if r[0] == 3} == set(editlog._rows(3, h))


def test_lru_keeps_the_page_in_use(spark):
    log = spark.createDataFrame([(1, 1, "a", 50), (1, 2, "b", 50), (1, 3, "a", 50), (1, 4, "c", 50), (1, 5, "d", 200), (1, 6, "a", 50)], "doc_id long, seq long, key string, bytes long")
    got = [(r.seq, r.hit, r.evicted, r.raw) for r in editlog.lru_cache(log, 100).orderBy("seq").collect()]
    assert got == [(1, False, "", 50), (2, False, "", 100), (3, True, "", 100), (4, False, "b", 100), (5, False, "a,c", 200), (6, False, "d", 50)]


def test_readings(spark):
    accept = [("90001", 0.3, True), ("7", 0.5, False), ("Gas", 0.5, False), ("er", 0.9, False), ("Rival Bag House", 0.5, True), ("Rival Bag House", 0.3, False), ("000 000 000", 0.9, False), ("mmmm", 0.9, False)]
    df = spark.createDataFrame(accept, "t string, c double, want boolean")
    for r in df.select("t", "want", readings.accepted(F.col("t"), F.col("c"), F.lit(300.0), F.lit(40.0)).alias("got")).collect():
        assert r.got == r.want, r.t
    assert not spark.createDataFrame([("x" * 20,)], "t string").select(readings.plausible(F.col("t"), F.lit(50), F.lit(50)).alias("p")).first().p


def _el(i, text, x, y, w, h, c):
    return (1, i, text, float(x), float(y), float(w), float(h), float(c), "l0", int(i[1:]), "scan")


def test_readings_replace_fragments(spark):
    els = spark.createDataFrame([_el("e0", "Name:", 10, 10, 80, 30, 95), _el("e1", "Va", 100, 100, 40, 30, 30), _el("e2", "m", 200, 100, 30, 30, 20)], readings.ELEMENTS)
    kind = "doc_id long, ord int, element_ids array<string>, x double, y double, width double, height double, text string, confidence double"
    run = lambda ids, rect, text, c: readings.apply_readings(els, spark.createDataFrame([(1, 0, ids, *map(float, rect), text, c)], kind)).collect()
    line = (90, 90, 300, 50)
    got = run(["e1", "e2"], line, "Rival Bag House", 0.9)
    assert [(r.id, r.text, r.confidence) for r in got] == [("e0", "Name:", 95.0), ("e1", "Rival Bag House", 75.0)]
    got = run([], (100, 300, 200, 40), "208310610", 0.7)
    assert [r.id for r in got] == ["e0", "e1", "e2", "p0-hw100-300"]
    for ids, rect, text, c in ((["e0"], line, "Name you", 0.9), (["e1"], line, "v a", 0.9), (["e1"], line, "an", 0.4), ([], (0, 0, 100, 40), "Nobody", 0.9)):
        assert [r.text for r in run(ids, rect, text, c)] == ["Name:", "Va", "m"]


def test_language_rules(spark):
    rows = [
        (1, "Devanagari", ["ne-NP", "en"], "nep,eng"), (2, "Devanagari", ["en-US"], "hin,eng"), (3, "Han", ["zh-TW"], "chi_tra,eng"), (4, "Han", ["en"], "chi_sim,eng"), (5, "Japanese", [], "jpn,eng"), (6, "Korean", [], "kor,eng"),
        (7, "Arabic", ["ur-PK"], "urd,eng"), (8, "Latin", ["es-MX"], "spa,eng"), (9, "Latin", ["en-GB"], "eng"), (10, "Klingon", ["bn-BD"], "ben,eng"), (11, "Klingon", [], "eng"),
    ]
    ev = spark.createDataFrame([(i, s, 5.0, 0, "", loc) for i, s, loc, _ in rows], "id long, osd_script string, osd_confidence double, headline_words int, probe_text string, locales array<string>")
    assert {r.id: r.languages for r in languages.choose(ev).collect()} == {i: w for i, _, _, w in rows}
    df = spark.createDataFrame([(["nep", "eng", "nep", "xx"],), ([],), (["eng", "auto"],), (["eng", "hin", "nep", "mar"],)], "c array<string>")
    assert [r.n for r in df.select(languages.normalised(F.col("c")).alias("n")).collect()] == [["nep", "eng"], ["auto"], ["auto"], ["eng", "hin", "nep"]]


def test_fonts(spark):
    texts = spark.createDataFrame([(1, "नेपाल सरकार", [], []), (2, "Invoice 17652", [], []), (3, "17652", ["devanagari", "latin"], []), (4, "发票号码", ["han"], ["sc"]), (5, "番号", ["han", "kana"], ["jp"])], "id long, text string, scripts array<string>, regions array<string>")
    got: dict = {}
    for r in fonts.candidates(texts).collect():
        got.setdefault(r.id, set()).add(r.font_id)
    assert {"mukta", "noto-sans-devanagari", "kalam"} <= got[1] and "arimo" not in got[1]
    assert "arimo" in got[2] and not got[2] & {"mukta", "noto-sans-sc", "amiri"}
    assert "mukta" in got[3] and "noto-sans-sc" in got[4] and "noto-sans-jp" not in got[4] and "noto-sans-jp" in got[5] and "noto-sans-sc" not in got[5]
    want = spark.createDataFrame([(1, "Bill नेपाल", "arimo"), (2, "Bill नेपाल", "tinos"), (3, "Invoice", "arimo")], "id long, text string, font_id string")
    faces: dict = {}
    for r in fonts.stacks(want).collect():
        faces.setdefault(r.id, set()).add(r.face_font)
    assert faces == {1: {"arimo", "noto-sans-devanagari"}, 2: {"tinos", "noto-serif-devanagari"}, 3: {"arimo"}}
    assert len(dims.LANGUAGES) == 40 and len(dims.font_rows()) == 86
    w = spark.range(1).select(fonts.nearest_weight(F.array(F.lit(400), F.lit(700)), F.lit(550)).alias("a"), fonts.nearest_weight(F.array(F.lit(400), F.lit(700)), F.lit(600)).alias("b"), fonts.parsed_range(F.lit("600-6ff")).alias("r")).first()
    assert (w.a, w.b, w.r.lo, w.r.hi) == (400, 700, 0x600, 0x6FF)


def test_edit_plans(spark):
    cases = [("Invoice 17652", "Invoice 17653", "3"), ("Total 4250.00", "Total 4380.00", "38"), ("abc", "xyz", "xyz"), ("مرحبا", "مرحبك", "مرحبك"), ("२०८०", "२०८१", "१")]
    df = spark.createDataFrame(cases, "a string, b string, want string")
    for r in df.select("a", "b", "want", edits.edit_plan(F.col("a"), F.col("b"), F.lit(10), F.lit(0), F.lit(0)).alias("p")).collect():
        assert r.p.text == r.want, (r.a, r.b, r.p)


def _jpeg(w, h, n=3):
    return b"\xff\xd8\xff\xe0\x00\x04ab" + b"\xff\xc0\x00\x11\x08" + h.to_bytes(2) + w.to_bytes(2) + bytes([n]) + b"\x00" * 9 + b"\xff\xd9"


def test_pdf_writer(spark):
    pdf = files.image_pdf([files.PdfPage(_jpeg(1200, 1680), 288.0, 403.2), files.PdfPage(_jpeg(10, 20, 1), 612.0, 792.0, (36.0, 18.5, 540.0, 755.0), 90)], "A (b)\\c é")
    assert pdf.startswith(b"%PDF-1.4") and b"/Title (A \\(b\\)\\\\c ?)" in pdf and b"/MediaBox [0 0 288 403.2]" in pdf and b"/DeviceGray" in pdf
    table = pdf[int(pdf.rsplit(b"startxref\n", 1)[1].split()[0]) :].split(b"\n")
    for k, row in enumerate(table[3:12], 1):
        assert pdf[int(row[:10]) :].startswith(b"%d 0 obj" % k)
    with pytest.raises(ValueError):
        files.image_pdf([])
    assert b"q 540 0 0 755 36 18.5 cm" in pdf and pdf.count(b"/Rotate 90") == 1
    with pytest.raises(ValueError):
        files.jpeg_info(_jpeg(8, 8, 2))
    with pytest.raises(ValueError):
        files.jpeg_info(b"\xff\xd8\xff\xc4\x00\x08abcdef\xff\xda\x00\x04")
    # tables, fill bytes and markers without a segment come before the frame header
    frame = _jpeg(70, 50)[_jpeg(70, 50).index(b"\xff\xc0"):]
    assert files.jpeg_info(b"\xff\xd8\xff\xff\xe0\x00\x06\xff\xc0ab\xff\x01\xff\xc4\x00\x04cd" + frame) == (70, 50, 3)
    rows = [(1, 0, bytearray(_jpeg(8, 8)), 10.0, 10.0, "t"), (2, 0, bytearray(b"no"), 10.0, 10.0, "t")]
    got = {r.doc_id: r for r in files.pdf_documents(spark.createDataFrame(rows, "doc_id long, page_no int, jpeg binary, width_pt double, height_pt double, title string")).collect()}
    assert bytes(got[1].pdf).startswith(b"%PDF") and got[2].pdf is None and got[2].error == "no JPEG"


def test_files_from_disk(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n12")
    (tmp_path / "b.bin").write_bytes(b"\x00\x01\x02%PDF-1.7")
    (tmp_path / "c.txt").write_bytes(b"text")
    (tmp_path / "d.jpg").write_bytes(b"\xff\xd8\xff %PDF-1.7")
    got = {r.path.rsplit("/", 1)[1]: (r.mime, r.reason) for r in files.validated(files.read_files(spark, str(tmp_path))).collect()}
    assert got == {"a.png": ("image/png", None), "b.bin": ("application/pdf", None), "c.txt": (None, "unsupported"), "d.jpg": ("image/jpeg", None)}


# ------------------------------------------------------------------ kernels


def test_distance_and_dilation_are_exact():
    rng = np.random.default_rng(0)
    mask = rng.random((23, 31)) < 0.8
    mask[5:15, 8:25] = True
    ys, xs = np.nonzero(~mask)
    want = np.array([[np.hypot(ys - y, xs - x).min() if mask[y, x] else 0 for x in range(31)] for y in range(23)])
    assert np.allclose(grids.distance(mask), want, atol=1e-5)
    assert (grids.dilated(mask, 2) == (grids.distance(~mask) <= 2)).all()


def test_components_like_a_flood():
    rng = np.random.default_rng(1)
    for density in (0.2, 0.5, 0.7):
        mask = rng.random((20, 27)) < density
        labels, box = grids.components(mask)
        seen, k = np.zeros_like(mask, int), 0
        for y, x in zip(*np.nonzero(mask)):
            if seen[y, x]:
                continue
            k += 1
            todo, pixels = [(y, x)], []
            seen[y, x] = k
            while todo:
                a, b = todo.pop()
                pixels.append((a, b))
                for c in range(max(0, a - 1), min(20, a + 2)):
                    for d in range(max(0, b - 1), min(27, b + 2)):
                        if mask[c, d] and not seen[c, d]:
                            seen[c, d] = k
                            todo.append((c, d))
            p = np.array(pixels)
            assert box[k - 1].tolist() == [p[:, 1].min(), p[:, 0].min(), p[:, 1].max() + 1, p[:, 0].max() + 1, len(p)]
        assert (labels == seen).all() and len(box) == k


def test_window_statistics_and_filters():
    rng = np.random.default_rng(2)
    img = rng.integers(0, 256, (14, 17)).astype(np.float64)
    mean, var = grids.window_stats(img, 3)
    for y, x in ((0, 0), (7, 8), (13, 16), (2, 15)):
        part = img[max(0, y - 3) : y + 4, max(0, x - 3) : x + 4]
        assert mean[y, x] == pytest.approx(part.mean()) and var[y, x] == pytest.approx(part.var(), abs=1e-6)
        assert grids.sliding_max(img, 3)[y, x] == part.max()
    flat = np.full((9, 9), 80, np.float32)
    assert np.allclose(grids.gaussian(flat, 2.0), 80, atol=1e-3) and (grids.gaussian(img, 0.01) == img).all()
    assert grids.upscaled(flat, 3).shape == (27, 27) and grids.downscaled(img, 2).shape == (7, 8)


def test_rules_skew_polarity():
    mask = np.zeros((40, 80), bool)
    mask[10, 5:70] = True
    mask[10, 20:22] = False
    mask[20, 5:20] = True
    found = grids.rules(mask, 40)
    assert (found[10] == mask[10]).all() and not found[20].any()
    page = np.zeros((120, 200), bool)
    slope = np.tan(np.deg2rad(2.0))
    for row in range(15, 105, 15):
        for x in range(200):
            page[min(119, int(row + slope * x)), x] = True
    angle, confidence = grids.skew(page)
    assert np.rad2deg(angle) == pytest.approx(2.0, abs=0.3) and confidence > 0.5
    assert grids.skew(np.zeros((10, 10), bool)) == (0.0, 0.0)
    dark = np.full((20, 20), 230.0)
    dark[5:8, 3:17] = 20
    assert grids.polarity(dark) == "dark" and grids.polarity(255 - dark) == "light" and grids.polarity(np.full((20, 20), 99.0)) == "dark"


def test_filling_follows_a_gradient_and_spares_the_rest():
    page = np.broadcast_to(200 + 40 * np.arange(120) / 120, (60, 120)).copy()
    known = np.ones(page.shape, bool)
    known[20:40, 50:70] = False
    hole = page.copy()
    hole[~known] = 0
    filled = grids.push_pull(hole, known)
    assert np.abs(filled - page).max() < 8 and (filled[known] == page[known]).all()
    rng = grids.Mulberry(1)
    assert [rng.draw() for _ in range(3)] == pytest.approx([0.6270739405881613, 0.002735721180215478, 0.5274470399599522])


def test_measures_and_descent():
    a, b = np.zeros((8, 8), bool), np.zeros((8, 8), bool)
    a[2:6, 2:6], b[2:6, 4:8] = True, True
    assert grids.iou(a, b) == pytest.approx(8 / 24) and grids.far_share(a, a, 1) == 0
    best, score, used = grids.coordinate_descent(lambda p: float(((p - np.array([1.3, -2.1])) ** 2).sum()), np.zeros(2), np.array([1.0, 1.0]), rounds=20)
    assert np.allclose(best, [1.3, -2.1], atol=0.1) and used <= 220
    assert grids.stroke_width(np.pad(np.ones((20, 3)), 5)) == pytest.approx(3, rel=0.3)


def test_upserts_keep_the_newest(spark, tmp_path):
    from quireflow.streaming import pages

    write = pages.upsert_sink(spark, str(tmp_path / "t"), ["k"], "v")
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v int, s string")
    write(rows((1, 1, "a"), (2, 5, "b")), 0)
    write(rows((1, 3, "c"), (2, 4, "late")), 1)
    write(rows((1, 3, "c"), (2, 4, "late")), 1)
    assert sorted((r.k, r.s) for r in pages.newest_rows(spark, str(tmp_path / "t"), ["k"], "v").collect()) == [(1, "c"), (2, "b")]


def test_streams_drop_late_rows_and_repeats(spark, tmp_path):
    from quireflow.streaming import pages

    src = str(tmp_path / "in")
    day = lambda d, k: spark.createDataFrame([(k, f"2024-01-{d:02d} 00:00:00", "click", 1.0)], "event_id long, t string, event_type string, value double").selectExpr("event_id", "cast(t as timestamp) ts", "event_type", "value")
    import time

    for k, d in enumerate((1, 10, 11, 2, 12)):
        day(d, k if k < 4 else 1).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    stream = spark.readStream.schema(day(1, 1).schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = pages.drain(pages.tumbling(stream, "ts", "1 day", "1 day"), "tumbles", "append", str(tmp_path / "c1"))
    assert [str(r.start)[:10] for r in out.collect()] .count("2024-01-02") == 0 and out.count() >= 2
    stream = spark.readStream.schema(day(1, 1).schema).option("maxFilesPerTrigger", 1).parquet(src)
    once = pages.drain(pages.first_of_each(stream, ["event_id"], "ts", "60 days"), "once", "append", str(tmp_path / "c2"))
    assert sorted(r.event_id for r in once.collect()) == [0, 1, 2, 3]


def test_small_rules(spark):
    one = spark.range(1)
    r = one.select(
        edits.style_label(F.lit("Arimo"), F.lit(700), F.lit(31.6)).alias("label"), edits.inferred_alignment(F.lit(100.0), F.lit(100.0), F.lit(20.0)).alias("a"), edits.inferred_alignment(F.lit(100.0), F.lit(2.0), F.lit(20.0)).alias("b"),
        edits.resolved_style(F.create_map(F.lit("w"), F.lit("400"), F.lit("s"), F.lit("12")), F.create_map(F.lit("w"), F.lit("700"))).alias("m"), readings.capped_confidence(F.lit(0.9)).alias("c"),
        edits.active_substitutions(F.create_map(F.lit("1"), F.lit("roboto"), F.lit("2"), F.lit("arimo"), F.lit("3"), F.lit("?")), F.lit("arimo"), F.array(F.lit("roboto"), F.lit("arimo"))).alias("g"),
    ).first()
    assert (r.label, r.a, r.b, r.m, r.c, r.g) == ("Arimo Bold 32px", "center", "right", {"w": "700", "s": "12"}, 75, {"1": "roboto"})
    random.seed(0)
