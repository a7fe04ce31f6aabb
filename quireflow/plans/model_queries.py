"""Queries of the document model: recognised words to pages, ink and handwriting, fits and glyphs, styles and small projections."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quireflow.functions import text as tx
from quireflow.functions.geometry import tilted_box, union_box
from quireflow.operators import document as doc
from quireflow.operators import editlog, handwriting, layout, measures
from quireflow.plans.document_queries import _LOG
from quireflow.plans.layout_queries import _RUNS, _kept, _runs
from quireflow.sources import dims
from quireflow.sources.words import WORDS_SQL, page_words, read

SKEW = 0.02

# ------------------------------------------------------------------ recognised words to pages


def _nested(spark, sf_dir):
    """Turns of conversations as recognition results: paragraphs by line, lines by sentence, words by blank, boxes by place."""
    c = read(spark, sf_dir, "conversations")

    def word(w, k):
        return F.struct(w.alias("text"), (k * 50).alias("x0"), (k * 7 % 30).alias("y0"), (k * 50 + F.length(w) * 9).alias("x1"), (k * 7 % 30 + 20).alias("y1"), (k * 13 % 101).alias("confidence"))

    line = lambda s: F.struct(F.transform(F.split(s, " "), word).alias("words"))
    para = lambda p: F.struct(F.transform(F.split(p, r"\."), line).alias("lines"))
    block = F.struct(F.transform(F.split("text", "\n"), para).alias("paragraphs"))
    return c.select("conv_id", "turn", F.array(block, block).alias("blocks"))


def ocr_flatten(spark, sf_dir):
    words = doc.scaled(doc.flattened(_nested(spark, sf_dir), ["conv_id", "turn"], "blocks"), F.lit(1.0) / (F.col("turn") + 1))
    return words.select("conv_id", "turn", "line_key", "text", *[F.round(c, 6).alias(c) for c in ("x", "y", "width", "height")], F.col("confidence").cast("long").alias("confidence"))


def _styled(words):
    """Words with a measured style by their digest; one in five has none."""
    h = F.col("h")
    stroke = F.when(h % 3 == 0, 3.5).otherwise(2.0) + h % 7 / 10.0
    colour = [(h * k % 256).alias(c) for k, c in ((1, "red"), (3, "green"), (7, "blue"))]
    return words.withColumn("style", F.when(h % 5 != 0, F.struct(stroke.alias("stroke_width"), (F.col("height") - 4 + h % 2).alias("glyph_height"), *colour)))


def run_visual_style(spark, sf_dir):
    runs = layout.gap_runs(_styled(_kept(spark, sf_dir)))
    out = measures.run_styles(runs, ["doc_id", "line_no", "run_no"])
    return out.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "run_no", F.round("stroke_width", 6).alias("stroke_width"), *[F.col(c).cast("long").alias(c) for c in ("glyph_height", "red", "green", "blue")])


def _elements(spark, sf_dir):
    return doc.page_elements(layout.reading_order(_runs(spark, sf_dir)), doc.page_id(F.lit(0)), F.lit(SKEW))


def build_elements(spark, sf_dir):
    return _elements(spark, sf_dir).select("doc_id", "element_id", "line_id", "text", F.col("reading_order").cast("long").alias("reading_order"), *[F.round(c, 6).alias(c) for c in ("cx", "cy", "width", "height")], "confidence", "state", "alignment")


def build_document(spark, sf_dir):
    pages = doc.skeleton(read(spark, sf_dir, "documents"), "text")
    return doc.ready(pages, _elements(spark, sf_dir)).select("doc_id", "id", "page_id", "status", "n_elements", "n_lines")


PATTERNS = ["^[A-Z]", "an", "^[a-z]+$", "zzz", "^[A-Z]", "e.e"]


def planned_edits(spark, sf_dir):
    runs = layout.reading_order(_runs(spark, sf_dir))
    return doc.planned_edits(runs, PATTERNS).select("doc_id", F.col("edit").cast("long").alias("edit"), F.col("reading_order").cast("long").alias("reading_order"))


def find_element(spark, sf_dir):
    """Targets of an edit log in documents of two pages: the page that holds them."""
    e = read(spark, sf_dir, "events")
    ids = lambda page, n, first: e.select(F.col("user_id").alias("doc_id")).distinct().select("doc_id", F.lit(page).alias("page_id"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.concat(F.lit("e"), k + first))).alias("element_id"))
    wanted = e.select(F.col("user_id").alias("doc_id"), F.concat(F.lit("e"), F.col("event_id") % 9).alias("element_id"))
    found = doc.found_elements(wanted, ids("p0", 4, 0).unionByName(ids("p1", 3, 4)))
    return found.groupBy("doc_id", "page_id").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ ink


#: Words of a line that are one region of ink: a long line of text stands for several of paper.
REGION = 64


def _components(words):
    """A component for each word: its box, and ink by the word's digest."""
    return words.select("doc_id", "line_no", F.floor(F.col("word_no") / REGION).alias("part"), F.concat_ws(".", "line_no", "word_no").alias("label"), "x", "y", "width", "height", F.floor(F.col("width") * F.col("height") * (F.col("h") % 90 + 5) / 100).cast("long").alias("area"), F.floor(F.col("width") * (F.col("h") % 11) / 10).cast("long").alias("top_run"), "h")


_COMPONENTS = f"""WITH {WORDS_SQL}, comps AS (SELECT doc_id, line_no, word_no // {REGION} AS part, line_no || '.' || word_no AS label, x, y, width, height, floor(width * height * (h % 90 + 5) / 100)::BIGINT AS area, floor(width * (h % 11) / 10)::BIGINT AS top_run, h FROM words)"""


def ink_metrics(spark, sf_dir):
    c = _components(page_words(spark, sf_dir)).withColumns({"x0": F.col("x"), "y0": F.col("y") - F.col("h") % 6, "x1": F.col("x") + F.col("width"), "y1": F.col("y") + F.col("height") - F.col("h") % 9})
    out = measures.ink_metrics(c, ["doc_id", "line_no"])
    return out.select("doc_id", F.col("line_no").cast("long").alias("line_no"), *[F.col(k).cast("long").alias(k) for k in ("x0", "x1", "top", "bottom", "baseline", "cap_top", "height", "width", "area")])


def component_classes(spark, sf_dir):
    w = page_words(spark, sf_dir)
    elements = w.where("h % 4 = 0").select("doc_id", "text", "confidence", (F.col("x") - 3).alias("x"), "y", "width", "height")
    out = handwriting.component_classes(_components(w).drop("line_no", "h"), elements, 2400)
    return out.groupBy("doc_id", "why").agg(F.count("*").alias("n"), F.sum("area").alias("area"))


def _shifted(spark, sf_dir):
    """Components of the doubtful words, out of place by their digest."""
    c = _components(page_words(spark, sf_dir)).where("h % 2 = 0")
    return c.withColumns({"x": F.col("x") + F.col("h") % 41 - 20, "y": F.col("y") + F.col("h") % 31 - 15, "height": F.when(F.col("h") % 10 == 0, 2).otherwise(F.col("height"))})


_SHIFTED = """shifted AS (SELECT doc_id, label, x + h % 41 - 20 AS x, y + h % 31 - 15 AS y, width, CASE WHEN h % 10 = 0 THEN 2 ELSE height END AS height, area FROM comps WHERE h % 2 = 0)"""


def text_ink(spark, sf_dir):
    boxes = page_words(spark, sf_dir).groupBy("doc_id", "line_no").agg(*union_box())
    found = measures.text_ink(boxes, _shifted(spark, sf_dir).select("doc_id", "label", "x", "y", "width", "height", "area"))
    return found.groupBy("doc_id", F.col("a.line_no").cast("long").alias("line_no")).agg(F.count("*").alias("n"), F.sum("b.area").alias("area"))


def word_ink(spark, sf_dir):
    words = page_words(spark, sf_dir).select("doc_id", "line_no", "word_no", "x", "y", "width", "height")
    found = measures.word_ink(words, _shifted(spark, sf_dir).select("doc_id", "label", "x", "y", "width", "height", "area"))
    return found.groupBy("doc_id", F.col("a.line_no").cast("long").alias("line_no"), F.col("a.word_no").cast("long").alias("word_no")).agg(F.count("*").alias("n"), F.sum("b.area").alias("area"))


def headline_band(spark, sf_dir):
    found = page_words(spark, sf_dir).where("width >= 1.6 * 22 and width <= 25 * 22 and height >= 0.6 * 22 and height <= 2.5 * 22 and h % 3 = 0").withColumns({"glyph": F.lit(22), "page": F.lit(4000)})
    out = measures.headline_band(found, "glyph", "page")
    return out.select("doc_id", "words", F.col("y").cast("long").alias("y"), F.col("band_height").cast("long").alias("band_height"))


def handwriting_lines(spark, sf_dir):
    """Lines of components of each text line, with the reason that they aren't read, their crops, and at most 40 read of a page."""
    c = _components(page_words(spark, sf_dir)).withColumns({"x0": F.col("x"), "y0": F.col("y") + F.col("h") % 17, "x1": F.col("x") + F.col("width"), "y1": F.col("y") + F.col("h") % 17 + F.col("height")})
    rules = page_words(spark, sf_dir).where("h % 19 = 0").select("doc_id", "line_no", F.floor(F.col("word_no") / REGION).alias("part"), (F.col("x") - 2).alias("x"), "y", (F.col("y") + 35).alias("y1")).withColumnRenamed("y", "y0")
    lines = handwriting.grouped_lines(c, ["doc_id", "line_no", "part"], rules)
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    reason = handwriting.line_reason(w, h, F.col("n") * 37 % 256, F.lit(230), F.col("area") * (F.col("n") % 3 + 1) / 3, F.col("area"), F.col("n") * 3 % 11 / 10.0 * w * h, F.lit(0.3) * w, F.lit(4.0))
    crop = handwriting.crop(F.col("x0"), F.col("y0"), w, h, F.lit(2400.0), F.lit(4000.0))
    kept = lines.withColumn("why", reason).withColumn("crop", crop).withColumns({"width": w, "height": h})
    read_ = handwriting.first_lines(kept.where("why = ''"), ["line_no", "part", "line"]).select("doc_id", "line_no", "part", "line", "turn")
    out = kept.join(read_, ["doc_id", "line_no", "part", "line"], "left")
    return out.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "part", F.col("line").cast("long").alias("line"), F.col("n").cast("long").alias("n"), "why", F.round("h", 6).alias("h"), F.col("turn").cast("long").alias("turn"), *[F.round(f"crop.{k}", 6).alias(f"crop_{k}") for k in ("x", "y", "width", "height")])


def blob_merge(spark, sf_dir):
    c = _components(page_words(spark, sf_dir)).withColumns({"x0": F.col("x") - F.col("h") % 37, "y0": F.col("y"), "x1": F.col("x") + F.when(F.col("h") % 4 == 0, 3).otherwise(F.col("width")), "y1": F.col("y") + F.when(F.col("h") % 8 == 0, 3).otherwise(F.col("height")), "glyph": F.lit(60)})
    out = measures.merged_blobs(c.withColumn("x0", F.least("x0", F.col("x1") - 1)), ["doc_id", "line_no", "part", "glyph"], "glyph")
    return out.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "part", F.col("blob").cast("long").alias("blob"), "x0", "y0", "x1", "y1", F.col("n").cast("long").alias("n"))


# ------------------------------------------------------------------ fits and glyphs


def ink_calibration(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    f = measures.ink_factor(F.col("l_quantity") * 4, F.col("l_partkey") % 200 * 1.0)
    rows = li.groupBy("l_suppkey").agg(f.alias("f"))
    return rows.select("l_suppkey", F.round("f", 9).alias("factor"), F.round(measures.calibrated(F.lit(230.0), (F.col("l_suppkey") % 120).cast("double"), F.col("f")), 6).alias("ink"))


def fit_ranking(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("ord"), (F.col("l_partkey") % 5).alias("font"), (F.col("l_suppkey") % 2 * 300 + 400).alias("weight"), F.col("l_quantity").alias("cost"), (F.col("l_quantity") * (F.col("l_partkey") % 4 + 6) / 10).alias("refined_cost"))
    return measures.fit_ranking(li).select("id", F.col("place").cast("long").alias("place"), "font", "weight", F.round("score", 9).alias("score"))


def self_check(spark, sf_dir):
    e = layout.reading_order(_runs(spark, sf_dir)).withColumn("k", F.col("x0") + F.col("line_no") * 7)
    rows = e.select("doc_id", "text", F.col("reading_order").cast("long").alias("reading_order"), F.least(F.lit(100), F.col("confidence") + 60).alias("confidence"), (F.col("k") % 13 == 0).alias("edited"), (F.col("k") % 100 / 4.0).alias("error"), (F.col("k") % 9 / 10.0).alias("score"))
    out = measures.self_check(rows)
    return out.select("doc_id", "n", F.round("mean_error", 6).alias("mean_error"), F.round("mean_score", 6).alias("mean_score"), F.array_join("worst", ",").alias("worst"))


def token_confidence(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    n = F.col("event_id")
    rows = e.select("user_id", F.struct("ts", "event_id").alias("step"), F.array(*[(n * m % 17 / 3.0).cast("double") for m in (3, 5, 7, 11)]).alias("logits"), F.array(*[(n + k) % 3 != 0 for k in range(4)]).alias("allowed"))
    return measures.token_confidence(rows, ["user_id"], "step", "logits", "allowed").select("user_id", "n", F.round("confidence", 9).alias("confidence"))


def _marks(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select((F.col("conv_id").cast("long") * 100 + F.col("turn")).alias("id"), F.posexplode(tx.chars(F.col("text"))).alias("at", "ch"))
    return c


_MARKS = "WITH marks AS (SELECT conv_id::BIGINT * 100 + turn AS id, generate_subscripts(string_split(text, ''), 1) - 1 AS pos, unnest(string_split(text, '')) AS ch FROM conversations WHERE text <> '')"


def word_islands(spark, sf_dir):
    out = measures.islands(_marks(spark, sf_dir))
    return out.select("id", F.col("word").cast("long").alias("word"), F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


def glyph_samples(spark, sf_dir):
    """Which of its first samples (four at most) each character of a text uses."""
    out = measures.sample_choice(_marks(spark, sf_dir).where("ch <> ' '"))
    return out.select("id", F.col("at").cast("long").alias("pos"), "ch", F.col("choice").cast("long").alias("choice"))


def glyph_positions(spark, sf_dir):
    out = measures.positions(_marks(spark, sf_dir).withColumn("advance", (F.ascii("ch") % 7 + 5).cast("double")), 12.0, 0.9, 0.25, 1.5)
    return out.groupBy("id").agg(F.count("*").alias("n"), F.round(F.max("x"), 6).alias("last"), F.round(F.sum("x"), 3).alias("total"))


# ------------------------------------------------------------------ styles and small projections


def style_resolution(spark, sf_dir):
    """Detected styles with overrides by the line's numbers; the height of capitals by the font's place in the list."""
    rows = dims.fonts(spark).select("ord", "id", "category")
    caps = rows.crossJoin(spark.createDataFrame([(400,), (700,)], "weight int")).select(F.col("id").alias("font"), "weight", (F.col("ord") * 3 % 11 + 65 + F.col("weight") / 100).alias("cap"))
    n = len(dims.FONTS)
    k = F.col("l_partkey")
    font = F.broadcast(rows.select(F.col("ord").alias("font_ord"), F.col("id").alias("font"), "category"))
    to = F.broadcast(rows.select(F.col("ord").alias("new_ord"), F.col("id").alias("new_font"), F.col("category").alias("new_category")))
    li = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (k % n).cast("int").alias("font_ord"), F.when(k % 3 == 0, F.col("l_suppkey") * 7 % n).cast("int").alias("new_ord"), F.lit(400).alias("weight"), F.when(k % 4 == 0, 700).alias("new_weight"),
        (F.col("l_quantity") + 8).alias("size"), F.when(k % 5 == 0, 20.0).alias("new_size"), F.lit(0.9).alias("scale_x"), F.when(k % 7 == 0, 1.1).alias("new_scale_x"), F.lit(0.3).alias("spacing"), F.lit(None).cast("double").alias("new_spacing"),
        F.when(k % 2 == 0, 0.5).alias("jitter"), F.when(k % 11 == 0, 0.8).alias("new_jitter"), F.lit("1:roboto").alias("glyphs"), F.lit(None).cast("string").alias("new_glyphs"), F.lit("own").alias("samples"), F.lit(None).cast("string").alias("new_samples"),
    )
    met = li.join(font, "font_ord").join(to, "new_ord", "left").withColumn("new_category", F.coalesce("new_category", "category")).withColumn("default_glyphs", F.when(F.coalesce("new_font", "font") == "arimo", "1:roboto"))
    out = doc.resolved_parameters(met, caps)
    return out.groupBy("to_font", "to_weight").agg(F.count("*").alias("n"), F.round(F.sum("size_out"), 4).alias("size"), F.round(F.sum("scale_out"), 4).alias("scale_x"), F.round(F.sum("spacing_out"), 4).alias("spacing"), F.round(F.sum("jitter_out"), 4).alias("jitter"), F.count("glyphs_out").alias("glyphs"), F.count("samples_out").alias("samples"))


def added_boxes(spark, sf_dir):
    e = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("text"), (F.col("p_partkey") * 3.0).alias("ax"), (F.col("p_partkey") % 90 * 5.0).alias("ay"), (F.col("p_size") / 100.0).alias("t"), (F.col("p_size") + 4.0).alias("ink"))
    frame = doc.added_frame(F.col("ax"), F.col("ay"), F.lit(200.0), F.lit(60.0), F.col("t"), F.col("ink"), F.lit(44.0))
    rows = e.withColumn("f", frame)
    box = doc.added_box(F.col("text"), F.col("f.cx"), F.col("f.cy"), F.lit(200.0), F.lit(60.0), F.col("t"), F.col("f.origin"), F.lit(44.0), F.col("ink"), F.lit(24.0), F.lit(0.95), F.lit(0.5))
    sub = doc.sub_frame(F.lit(10.0), F.lit(5.0), F.lit(30.0), F.lit(20.0), F.col("f.cx"), F.col("f.cy"), F.lit(200.0), F.lit(60.0), F.col("t"))
    tilted = tilted_box(F.col("ax"), F.col("ay"), F.col("ink") * 6, F.col("ink"), F.col("t"))
    return rows.select("p_partkey", *[F.round(box[c], 6).alias(c) for c in ("cx", "cy", "width", "height")], F.round(sub["cx"], 6).alias("sub_x"), F.round(sub["cy"], 6).alias("sub_y"), F.round(tilted["width"], 6).alias("tilted_width"), F.round(tilted["height"], 6).alias("tilted_height"))


def command_targets(spark, sf_dir):
    """The element that each command of the log touches, and what the user is told where one fails."""
    log = editlog.from_events(read(spark, sf_dir, "events"))
    kind, target = F.get_json_object("payload", "$.type"), F.get_json_object("payload", "$.element_id")
    error = F.element_at(F.array(*[F.lit(x) for x in (*doc.TOLD, "TypeError", "RangeError")]), (F.col("seq") % 5 + 1).cast("int"))
    return log.where(kind.isNotNull()).groupBy(doc.touched(kind, target).alias("element_id"), doc.user_message(error, F.concat(F.lit("said: "), error)).alias("message")).agg(F.count("*").alias("n"))


def dirty_elements(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    part = lambda t, n: e.where(F.col("event_type") == t).select(F.col("user_id").alias("doc_id"), (F.col("event_id") % n).alias("element")).distinct()
    return doc.still_dirty(part("click", 7), part("view", 7))


def picker_order(spark, sf_dir):
    """Fonts of each part's script as the list shows them: by category, then as catalogued."""
    category = F.expr("array_position(array('sans', 'serif', 'condensed', 'mono', 'handwriting'), category)")
    rows = dims.fonts(spark).select("id", "ord", category.alias("c"), doc.picker_group(F.get("scripts", 0)).alias("grp"))
    return rows.select("id", "grp", F.row_number().over(Window.partitionBy("grp").orderBy("c", "ord")).cast("long").alias("place"))


def base64_round(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("b"))
    coded = F.base64("b")
    return p.select("page_id", F.md5(F.regexp_replace(coded, r"\s", "")).alias("coded"), F.length(F.unbase64(coded)).cast("long").alias("n"), F.md5(F.unbase64(coded)).alias("back"))


def font_manifest(spark, sf_dir):
    rows = dims.font_slices(spark).withColumn("range", F.concat(F.lower(F.hex("lo")), F.lit("-"), F.lower(F.hex("hi"))))
    order = dims.fonts(spark).select(F.col("id").alias("font_id"), "ord")
    slices = rows.join(order, "font_id").groupBy("font_id", "slice_id", "ord").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("lo", "range"))), lambda r: r["range"]), ",").alias("ranges"))
    out = doc.manifest(slices.withColumn("ord", F.struct("ord", "slice_id")))
    return out.select("font_id", "slice_id", "ranges", F.col("idx").cast("long").alias("idx"))


QUERIES = {f.__name__: f for f in (
    ocr_flatten, run_visual_style, build_elements, build_document, planned_edits, find_element, ink_metrics, component_classes, text_ink, word_ink, headline_band, handwriting_lines, blob_merge, ink_calibration, fit_ranking, self_check,
    token_confidence, word_islands, glyph_samples, glyph_positions, style_resolution, added_boxes, command_targets, dirty_elements, picker_order, base64_round, font_manifest,
)}

_UP = "list_sort({0})[len({0}) // 2 + 1]"
_TILT = "CASE WHEN {c} * {c} - {s} * {s} > 0.3 AND {w} * {c} - {h} * {s} > 0 AND {h} * {c} - {w} * {s} > 0 THEN ({a} * {c} - {b} * {s}) / ({c} * {c} - {s} * {s}) ELSE {a} END"


def _tilt(a: str, b: str, w: str, h: str, angle: str) -> str:
    return _TILT.format(a=a, b=b, w=w, h=h, c=f"abs(cos({angle}))", s=f"abs(sin({angle}))")


_ELEMENTS = f"""{_RUNS}, els AS (SELECT doc_id, 'p0-e' || reading_order AS element_id, 'p0-l' || (dense_rank() OVER (PARTITION BY doc_id ORDER BY c.centre2, line_no) - 1) AS line_id, text, reading_order,
  x0 + (x1 - x0) / 2.0::DOUBLE AS cx, y0 + (y1 - y0) / 2.0::DOUBLE AS cy, {_tilt('(x1 - x0)', '(y1 - y0)', '(x1 - x0)', '(y1 - y0)', f'{SKEW}::DOUBLE')} AS width, {_tilt('(y1 - y0)', '(x1 - x0)', '(x1 - x0)', '(y1 - y0)', f'{SKEW}::DOUBLE')} AS height, confidence
  FROM ordered JOIN centres c USING (doc_id, line_no))"""

ORACLES = {
    "ocr_flatten": """WITH b AS (SELECT conv_id, turn, unnest([0, 1]) AS bi, text FROM conversations), p AS (SELECT conv_id, turn, bi, generate_subscripts(s, 1) - 1 AS pi, unnest(s) AS p FROM (SELECT *, string_split(text, chr(10)) AS s FROM b)),
      l AS (SELECT conv_id, turn, bi, pi, generate_subscripts(s, 1) - 1 AS li, unnest(s) AS l FROM (SELECT *, string_split(p, '.') AS s FROM p)), w AS (SELECT conv_id, turn, bi, pi, li, generate_subscripts(s, 1) - 1 AS k, unnest(s) AS w FROM (SELECT *, string_split(l, ' ') AS s FROM l)),
      t AS (SELECT *, regexp_replace(w, '^\\s+|\\s+$', '', 'g') AS bare, 1 / (turn + 1)::DOUBLE AS f FROM w)
      SELECT conv_id, turn, bi || '.' || pi || '.' || li AS line_key, bare AS text, round(k * 50 * f, 6) AS x, round(k * 7 % 30 * f, 6) AS y, round(length(w) * 9 * f, 6) AS width, round(20 * f, 6) AS height, (k * 13 % 101)::BIGINT AS confidence FROM t WHERE bare <> ''""",
    "run_visual_style": f"""{_RUNS}, s AS (SELECT doc_id, line_no, run_no, CASE WHEN h % 3 = 0 THEN 3.5::DOUBLE ELSE 2.0::DOUBLE END + h % 7 / 10.0::DOUBLE AS sw, height - 4 + h % 2 AS gh, h % 256 AS r, h * 3 % 256 AS g, h * 7 % 256 AS b FROM numbered WHERE h % 5 <> 0)
      SELECT doc_id, line_no, run_no, round({_UP.format('list(sw)')}, 6) AS stroke_width, {_UP.format('list(gh)')} AS glyph_height, {_UP.format('list(r)')} AS red, {_UP.format('list(g)')} AS green, {_UP.format('list(b)')} AS blue FROM s GROUP BY ALL""",
    "build_elements": f"{_ELEMENTS} SELECT doc_id, element_id, line_id, text, reading_order, round(cx, 6) AS cx, round(cy, 6) AS cy, round(width, 6) AS width, round(height, 6) AS height, confidence, 'original' AS state, 'left' AS alignment FROM els",
    "build_document": f"""{_ELEMENTS}, n AS (SELECT doc_id, count(*) AS n_elements, count(DISTINCT line_id) AS n_lines FROM els GROUP BY doc_id)
      SELECT d.doc_id, 'doc-' || substr(sha256(coalesce(text, '')), 1, 16) AS id, 'p0' AS page_id, CASE WHEN n_elements IS NULL THEN 'pending' ELSE 'ready' END AS status, coalesce(n_elements, 0) AS n_elements, coalesce(n_lines, 0) AS n_lines FROM documents d LEFT JOIN n USING (doc_id)""",
    "planned_edits": f"""{_RUNS}, e AS (SELECT doc_id, list(struct_pack(r := reading_order, t := text) ORDER BY reading_order) AS es FROM ordered GROUP BY doc_id),
      {", ".join(f"p{k} AS (SELECT *, list_filter(es, lambda e: regexp_matches(e.t, '{p}') AND NOT coalesce(list_contains([{', '.join(f'e{j}' for j in range(k)) or '-1'}], e.r), false))[1].r AS e{k} FROM {f'p{k - 1}' if k else 'e'})" for k, p in enumerate(PATTERNS))}
      {" UNION ALL ".join(f"SELECT doc_id, {k}::BIGINT AS edit, e{k} AS reading_order FROM p{len(PATTERNS) - 1} WHERE e{k} IS NOT NULL" for k in range(len(PATTERNS)))}""",
    "find_element": "SELECT user_id AS doc_id, CASE WHEN event_id % 9 < 4 THEN 'p0' WHEN event_id % 9 < 7 THEN 'p1' END AS page_id, count(*) AS n FROM events GROUP BY ALL",
    "ink_metrics": f"""{_COMPONENTS}, c AS (SELECT doc_id, line_no, x AS x0, y - h % 6 AS y0, x + width AS x1, y + height - h % 9 AS y1, area, max(area) OVER (PARTITION BY doc_id, line_no) AS most FROM comps),
      g AS (SELECT *, y1 - y0 AS ch FROM c WHERE area >= greatest(3.0::DOUBLE, most * 0.01::DOUBLE)), r AS (SELECT doc_id, line_no, list_sort(list(ch))[floor((count(*) - 1) * 0.9::DOUBLE + 0.5)::INT + 1] AS ref FROM g GROUP BY ALL),
      m AS (SELECT doc_id, line_no, min(x0) AS x0, max(x1) AS x1, min(y0) AS top, max(y1) AS bottom, sum(area)::BIGINT AS area, list_sort(list(y1) FILTER (ch >= ref * 0.4::DOUBLE)) AS bs, list_sort(list(y0) FILTER (ch >= ref * 0.85::DOUBLE)) AS cs FROM g JOIN r USING (doc_id, line_no) GROUP BY ALL)
      SELECT doc_id, line_no, x0, x1, top, bottom, bs[len(bs) // 2 + 1] AS baseline, cs[len(cs) // 2 + 1] AS cap_top, greatest(1, bs[len(bs) // 2 + 1] - cs[len(cs) // 2 + 1]) AS height, greatest(1, x1 - x0) AS width, area FROM m""",
    "component_classes": f"""{_COMPONENTS}, h0 AS (SELECT doc_id, coalesce({_UP.format('list(height) FILTER (area >= 30 AND area / (width * height) < 0.6::DOUBLE)')}, 20) AS h0 FROM comps GROUP BY doc_id),
      e AS (SELECT doc_id, x - 3 AS x, y, width, height FROM words WHERE h % 4 = 0 AND confidence >= 70 AND length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 2),
      cov AS (SELECT DISTINCT c.doc_id, c.label FROM comps c JOIN e ON c.doc_id = e.doc_id AND e.x < c.x + c.width AND c.x < e.x + e.width AND e.y < c.y + c.height AND c.y < e.y + e.height
        WHERE 2 * (least(c.x + c.width, e.x + e.width) - greatest(c.x, e.x)) * (least(c.y + c.height, e.y + e.height) - greatest(c.y, e.y)) >= c.width * c.height),
      r AS (SELECT c.*, h0, cov.label IS NOT NULL AS covered, area / greatest(1, width * height)::DOUBLE AS fill FROM comps c JOIN h0 USING (doc_id) LEFT JOIN cov ON cov.doc_id = c.doc_id AND cov.label = c.label),
      w AS (SELECT doc_id, area, CASE WHEN width <= height * 1.6::DOUBLE AND fill >= 0.62::DOUBLE AND height <= h0 * 0.6::DOUBLE THEN 'dot' WHEN (fill >= 0.72::DOUBLE AND width * height >= h0 * h0 * 2.25::DOUBLE) OR (fill >= 0.5::DOUBLE AND width * height >= h0 * h0 * 9) THEN 'blob'
        WHEN area < 20 OR height < h0 * 0.3::DOUBLE OR height > h0 * 5 OR width > 2400 * 0.4::DOUBLE OR fill < 0.08::DOUBLE THEN 'size' WHEN covered THEN 'confident' WHEN width >= height * 1.5::DOUBLE AND top_run >= width * 0.85::DOUBLE THEN 'headline' ELSE '' END AS why FROM r)
      SELECT doc_id, why, count(*) AS n, sum(area)::BIGINT AS area FROM w GROUP BY ALL""",
    "text_ink": f"""{_COMPONENTS}, {_SHIFTED}, boxes AS (SELECT doc_id, line_no, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height FROM words GROUP BY ALL),
      i AS (SELECT b.doc_id, b.line_no, b.height AS bh, c.x, c.y, c.width AS cw, c.height AS ch, c.area FROM boxes b JOIN shifted c ON b.doc_id = c.doc_id AND c.y < b.y + b.height * 1.3::DOUBLE AND c.y + c.height > b.y - b.height * 0.3::DOUBLE
        WHERE c.height <= b.height * 2.2::DOUBLE AND greatest(0, least(c.x + c.width, b.x + b.width + b.height * 0.35::DOUBLE) - greatest(c.x, b.x - b.height * 0.35::DOUBLE)) * greatest(0, least(c.y + c.height, b.y + b.height * 1.3::DOUBLE) - greatest(c.y, b.y - b.height * 0.3::DOUBLE)) >= c.width * c.height * 0.6::DOUBLE),
      m AS (SELECT doc_id, line_no, list_sort(list(y + ch) FILTER (ch >= bh * 0.35::DOUBLE)) AS bs, list_sort(list(y) FILTER (ch >= bh * 0.35::DOUBLE)) AS cs FROM i GROUP BY ALL),
      e AS (SELECT i.*, bs[len(bs) // 2 + 1] AS base, cs[len(cs) // 2 + 1] AS cap FROM i JOIN m USING (doc_id, line_no)), f AS (SELECT *, greatest(1, base - cap) AS band FROM e)
      SELECT doc_id, line_no, count(*) AS n, sum(area)::BIGINT AS area FROM f WHERE base IS NULL OR CASE WHEN ch < band * 0.3::DOUBLE AND cw > ch * 1.5::DOUBLE THEN y <= base + band * 0.1::DOUBLE AND y + ch >= cap - band * 0.05::DOUBLE ELSE y < base + band * 0.5::DOUBLE AND y + ch > cap - band * 0.5::DOUBLE END GROUP BY ALL""",
    "word_ink": f"""{_COMPONENTS}, {_SHIFTED} SELECT w.doc_id, w.line_no, w.word_no, count(*) AS n, sum(c.area)::BIGINT AS area FROM words w JOIN shifted c ON w.doc_id = c.doc_id AND c.y + c.height > w.y AND c.y < w.y + w.height
      WHERE 2 * (least(c.x + c.width, w.x + w.width) - greatest(c.x, w.x)) >= c.width AND c.height <= 3 * w.height GROUP BY ALL""",
    "headline_band": f"""WITH {WORDS_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y, x) AS k FROM words WHERE width >= 35.2::DOUBLE AND width <= 550 AND height >= 13.2::DOUBLE AND height <= 55 AND h % 3 = 0),
      b AS (SELECT doc_id, count(*) AS words, greatest(0, min(y) FILTER (k <= 12) - 11) AS y0, least(4000, max(y + height) FILTER (k <= 12) + 11) AS y1 FROM f GROUP BY doc_id) SELECT doc_id, words, y0 AS y, least(y1 - y0, 264) AS band_height FROM b""",
    "handwriting_lines": f"""{_COMPONENTS}, c AS (SELECT doc_id, line_no, part, struct_pack(x0 := x::DOUBLE, y0 := (y + h % 17)::DOUBLE, x1 := (x + width)::DOUBLE, y1 := (y + h % 17 + height)::DOUBLE, area := area::DOUBLE) AS c FROM comps),
      r AS (SELECT doc_id, line_no, word_no // {REGION} AS part, list(struct_pack(x := (x - 2)::DOUBLE, y0 := y::DOUBLE, y1 := (y + 35)::DOUBLE)) AS rs FROM words WHERE h % 19 = 0 GROUP BY ALL),
      a AS (SELECT doc_id, line_no, part, list(struct_pack(x0 := c.x0, y0 := c.y0, x1 := c.x1, y1 := c.y1, h := c.y1 - c.y0, n := 1::BIGINT, area := c.area) ORDER BY c.x0, c.y0, c.x1, c.y1, c.area) AS cs FROM c GROUP BY ALL),
      j AS (SELECT a.*, coalesce(rs, []) AS rs FROM a LEFT JOIN r USING (doc_id, line_no, part)),
      f AS (SELECT doc_id, line_no, part, list_reduce(list_transform(cs, lambda x: [x]), lambda d, y: list_transform([list_transform(d, lambda l:
            CASE WHEN least(l.y1, y[1].y1) - greatest(l.y0, y[1].y0) >= least(l.h, y[1].h) * 0.4::DOUBLE AND least(l.y1, y[1].y1) > greatest(l.y0, y[1].y0) AND y[1].x0 - l.x1 <= greatest(l.h, y[1].h) * 2.5::DOUBLE AND y[1].x0 - l.x1 >= -greatest(l.h, y[1].h)
              AND len(list_filter(rs, lambda q: q.x >= least(l.x1, y[1].x0) AND q.x < greatest(l.x1, y[1].x0) AND least(q.y1, l.y1, y[1].y1) - greatest(q.y0, l.y0, y[1].y0) >= greatest(3.0::DOUBLE, (least(l.y1, y[1].y1) - greatest(l.y0, y[1].y0)) * 0.6::DOUBLE))) = 0
            THEN least(l.y1, y[1].y1) - greatest(l.y0, y[1].y0) ELSE 0.0::DOUBLE END)], lambda o: CASE WHEN list_max(o) > 0
              THEN list_transform(d, lambda l, i: CASE WHEN i = list_position(o, list_max(o)) THEN struct_pack(x0 := least(l.x0, y[1].x0), y0 := least(l.y0, y[1].y0), x1 := greatest(l.x1, y[1].x1), y1 := greatest(l.y1, y[1].y1), h := greatest(l.h * 0.8::DOUBLE + y[1].h * 0.2::DOUBLE, least(l.h, y[1].h)), n := l.n + 1, area := l.area + y[1].area) ELSE l END)
              ELSE list_concat(d, y) END)[1]) AS ls FROM j),
      e AS (SELECT doc_id, line_no, part, i - 1 AS line, l.x0, l.y0, l.x1 - l.x0 AS w, l.y1 - l.y0 AS hh, l.h, l.n, l.area FROM (SELECT doc_id, line_no, part, generate_subscripts(ls, 1) AS i, unnest(ls) AS l FROM f)),
      y AS (SELECT *, CASE WHEN w < hh * 1.2::DOUBLE THEN 'short' WHEN n * 37 % 256 < 230 * 0.72::DOUBLE THEN 'background' WHEN area * (n % 3 + 1) / 3 < area * 0.6::DOUBLE THEN 'speckle' WHEN n * 3 % 11 / 10.0::DOUBLE * w * hh >= w * hh * 0.35::DOUBLE THEN 'print'
        WHEN 0.3::DOUBLE * w >= w * 0.45::DOUBLE THEN 'headline' WHEN 4.0 > hh * 0.2::DOUBLE THEN 'stroke' ELSE '' END AS why FROM e),
      t AS (SELECT doc_id, line_no, part, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, part, line) AS turn FROM y WHERE why = '' QUALIFY turn <= 40)
      SELECT y.doc_id, y.line_no, y.part, y.line, n, why, round(h, 6) AS h, turn, round(greatest(0.0::DOUBLE, x0 - hh * 0.3::DOUBLE), 6) AS crop_x, round(greatest(0.0::DOUBLE, y0 - hh * 0.15::DOUBLE), 6) AS crop_y,
        round(least(2400.0::DOUBLE, x0 + w + hh * 0.3::DOUBLE) - greatest(0.0::DOUBLE, x0 - hh * 0.3::DOUBLE), 6) AS crop_width, round(least(4000.0::DOUBLE, y0 + hh * 1.15::DOUBLE) - greatest(0.0::DOUBLE, y0 - hh * 0.15::DOUBLE), 6) AS crop_height
      FROM y LEFT JOIN t ON t.doc_id = y.doc_id AND t.line_no = y.line_no AND t.part = y.part AND t.line = y.line""",
    "blob_merge": f"""{_COMPONENTS}, c AS (SELECT doc_id, line_no, part, least(x - h % 37, x1 - 1) AS x0, y AS y0, x1, y + CASE WHEN h % 8 = 0 THEN 3 ELSE height END AS y1 FROM (SELECT *, x + CASE WHEN h % 4 = 0 THEN 3 ELSE width END AS x1 FROM comps) WHERE area >= 4),
      k AS (SELECT doc_id, line_no, part, struct_pack(x0 := x0, y0 := y0, x1 := x1, y1 := y1, n := 1::BIGINT) AS b, y1 - y0 >= 15 OR x1 - x0 >= 15 AS big FROM c),
      a AS (SELECT doc_id, line_no, part, coalesce(list(b ORDER BY b.x0, b.y0, b.x1, b.y1) FILTER (big), []) AS bigs, coalesce(list(b ORDER BY b.x0, b.y0, b.x1, b.y1) FILTER (NOT big), []) AS small FROM k GROUP BY ALL),
      m AS (SELECT doc_id, line_no, part, small, CASE WHEN len(bigs) = 0 THEN [] ELSE list_reduce(list_transform(bigs, lambda x: [x]), lambda d, y: CASE WHEN 2 * (least(d[-1].x1, y[1].x1) - greatest(d[-1].x0, y[1].x0)) > least(d[-1].x1 - d[-1].x0, y[1].x1 - y[1].x0)
        THEN list_append(d[:-2], struct_pack(x0 := least(d[-1].x0, y[1].x0), y0 := least(d[-1].y0, y[1].y0), x1 := greatest(d[-1].x1, y[1].x1), y1 := greatest(d[-1].y1, y[1].y1), n := d[-1].n + y[1].n)) ELSE list_concat(d, y) END) END AS blobs FROM a),
      s AS (SELECT doc_id, line_no, part, list_reduce(list_concat([blobs], list_transform(small, lambda x: [x])), lambda d, m: list_transform(d, lambda b, i: CASE WHEN i = list_position(list_transform(d, lambda z: (m[1].x0 + m[1].x1) / 2.0::DOUBLE >= z.x0 - 1 AND (m[1].x0 + m[1].x1) / 2.0::DOUBLE <= z.x1 + 1), true)
        THEN struct_pack(x0 := b.x0, y0 := least(b.y0, m[1].y0), x1 := b.x1, y1 := greatest(b.y1, m[1].y1), n := b.n + 1) ELSE b END)) AS blobs FROM m)
      SELECT doc_id, line_no, part, (i - 1)::BIGINT AS blob, b.x0, b.y0, b.x1, b.y1, b.n FROM (SELECT doc_id, line_no, part, generate_subscripts(blobs, 1) AS i, unnest(blobs) AS b FROM s)""",
    "ink_calibration": """WITH g AS (SELECT l_suppkey, list_reverse_sort(list(l_quantity * 4::DOUBLE)) AS o, list_reverse_sort(list((l_partkey % 200)::DOUBLE)) AS p FROM lineitem GROUP BY l_suppkey),
      t AS (SELECT l_suppkey, o[floor(len(o) * 0.03::DOUBLE)::INT + 1] AS target, p[floor(len(p) * 0.03::DOUBLE)::INT + 1] AS current FROM g), f AS (SELECT l_suppkey, CASE WHEN target > 1 AND current > 1 THEN least(1.8::DOUBLE, greatest(0.7::DOUBLE, target / current)) END AS f FROM t)
      SELECT l_suppkey, round(f, 9) AS factor, round(CASE WHEN f IS NULL THEN (l_suppkey % 120)::DOUBLE ELSE least(255.0::DOUBLE, greatest(0.0::DOUBLE, 230 - f * (230 - (l_suppkey % 120)))) END, 6) AS ink FROM f""",
    "fit_ranking": """WITH c AS (SELECT l_orderkey AS id, l_partkey % 5 AS font, l_suppkey % 2 * 300 + 400 AS weight, l_quantity::DOUBLE AS cost, l_quantity::DOUBLE * (l_partkey % 4 + 6) / 10 AS refined, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem),
      r AS (SELECT * FROM c WHERE k <= 3), s AS (SELECT id, font, weight, k, true AS top, refined AS final FROM r UNION ALL SELECT id, font, weight, k, false, cost FROM c WHERE k > 3 AND NOT EXISTS (SELECT 1 FROM r WHERE r.id = c.id AND r.font = c.font AND r.weight = c.weight))
      SELECT id, row_number() OVER (PARTITION BY id ORDER BY top DESC, final, k) AS place, font, weight, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, min(CASE WHEN top THEN final END) OVER (PARTITION BY id) / greatest(1e-6::DOUBLE, final))), 9) AS score FROM s""",
    "self_check": f"""{_RUNS}, e AS (SELECT doc_id, text, reading_order, least(100, confidence + 60) AS c, x0 + line_no * 7 AS k FROM ordered),
      f AS (SELECT *, k % 100 / 4.0::DOUBLE AS err, k % 9 / 10.0::DOUBLE AS score, row_number() OVER (PARTITION BY doc_id ORDER BY reading_order) AS n FROM e WHERE c >= 85 AND length(text) >= 2 AND k % 13 <> 0)
      SELECT doc_id, count(*) AS n, round(avg(err), 6) AS mean_error, round(avg(score), 6) AS mean_score, array_to_string(list(reading_order ORDER BY err DESC, reading_order)[1:3], ',') AS worst FROM f WHERE n <= 25 GROUP BY doc_id""",
    "token_confidence": """WITH e AS (SELECT user_id, ts, event_id, [event_id * 3 % 17 / 3.0::DOUBLE, event_id * 5 % 17 / 3.0::DOUBLE, event_id * 7 % 17 / 3.0::DOUBLE, event_id * 11 % 17 / 3.0::DOUBLE] AS z FROM events),
      o AS (SELECT *, list_transform(z, lambda x, i: CASE WHEN i = 1 OR (event_id + i - 1) % 3 <> 0 THEN x END) AS a FROM e),
      p AS (SELECT user_id, ts, event_id, list_position(a, list_max(a)) - 1 AS token, exp(list_max(a) - list_max(z)) / list_sum(list_transform(z, lambda x: exp(x - list_max(z)))) AS p FROM o),
      d AS (SELECT *, max(CASE WHEN token = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS ended FROM p)
      SELECT user_id, count_if(ended = 0)::BIGINT AS n, round(coalesce(avg(p) FILTER (ended = 0), 0.0::DOUBLE), 9) AS confidence FROM d GROUP BY user_id""",
    "word_islands": f"""{_MARKS}, w AS (SELECT *, regexp_matches(ch, '^\\s+$') AS blank, sum(CASE WHEN regexp_matches(ch, '^\\s+$') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS g FROM marks),
      i AS (SELECT id, g, min(pos) AS first, max(pos) AS last FROM w WHERE NOT blank GROUP BY id, g) SELECT id, row_number() OVER (PARTITION BY id ORDER BY g) - 1 AS word, first, last FROM i""",
    "glyph_samples": f"""{_MARKS}, n AS (SELECT id, ch, least(4, count(*)) AS n FROM marks WHERE ch <> ' ' GROUP BY id, ch),
      h AS (SELECT id, ch, n, pos, list_reduce(list_concat([2166136261::BIGINT], list_transform(string_split(pos || ':' || ch, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) % n AS k FROM marks JOIN n USING (id, ch)),
      g AS (SELECT id, ch, n, list(pos ORDER BY pos) AS ats, list(k ORDER BY pos) AS ks FROM h GROUP BY ALL),
      f AS (SELECT id, ch, ats, list_reduce(list_transform(ks, lambda k: [k]), lambda d, k: list_append(d, CASE WHEN n > 1 AND d[-1] = k[1] THEN (k[1] + 1) % n ELSE k[1] END)) AS choices FROM g)
      SELECT id, unnest(ats) AS pos, ch, unnest(choices) AS choice FROM f""",
    "glyph_positions": f"""{_MARKS}, a AS (SELECT id, pos, ch, unicode(ch) % 7 + 5 AS adv FROM marks), x AS (SELECT id, 12 + coalesce(sum(adv) OVER w, 0) * 0.9::DOUBLE + pos * 0.25::DOUBLE + coalesce(sum(CASE WHEN ch = ' ' THEN 1 ELSE 0 END) OVER w, 0) * 1.5::DOUBLE AS x FROM a WINDOW w AS (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      SELECT id, count(*) AS n, round(max(x), 6) AS last, round(sum(x), 3) AS total FROM x GROUP BY id""",
    "added_boxes": f"""WITH e AS (SELECT p_partkey, length(p_name) AS n, p_partkey * 3.0::DOUBLE AS ax, p_partkey % 90 * 5.0::DOUBLE AS ay, p_size / 100.0::DOUBLE AS t, p_size + 4.0::DOUBLE AS ink FROM part),
      o AS (SELECT *, greatest(4.0::DOUBLE, ink * 0.4::DOUBLE) AS org FROM e), f AS (SELECT *, ax - ((org - 100) * cos(t) - 14 * sin(t)) AS fx, ay - ((org - 100) * sin(t) + 14 * cos(t)) AS fy, greatest(ink, 24 * 0.72::DOUBLE) * 1.35::DOUBLE AS h FROM o),
      b AS (SELECT *, greatest(h * 1.5::DOUBLE, n * 24 * 0.55::DOUBLE * 0.95::DOUBLE + 0.5::DOUBLE * n) AS w FROM f), l AS (SELECT *, org + w / 2 - 100 AS lx, 44 - h * 0.4::DOUBLE - 30 AS ly FROM b)
      SELECT p_partkey, round(fx + lx * cos(t) - ly * sin(t), 6) AS cx, round(fy + lx * sin(t) + ly * cos(t), 6) AS cy, round(w, 6) AS width, round(h, 6) AS height, round(fx - 75 * cos(t) + 15 * sin(t), 6) AS sub_x, round(fy - 75 * sin(t) - 15 * cos(t), 6) AS sub_y,
        round({_tilt('ink * 6', 'ink', 'ink * 6', 'ink', 't')}, 6) AS tilted_width, round({_tilt('ink', 'ink * 6', 'ink * 6', 'ink', 't')}, 6) AS tilted_height FROM l""",
    "style_resolution": f"""WITH fonts(ord, id, category) AS (VALUES {', '.join(f"({k}, '{r[0]}', '{r[1]}')" for k, r in enumerate(dims.FONTS))}),
      caps AS (SELECT id AS font, w AS weight, ord * 3 % 11 + 65 + w / 100::DOUBLE AS cap FROM fonts, (SELECT unnest([400, 700]) AS w)),
      l AS (SELECT l_partkey AS k, l_partkey % {len(dims.FONTS)} AS fo, CASE WHEN l_partkey % 3 = 0 THEN l_suppkey * 7 % {len(dims.FONTS)} END AS no, CASE WHEN l_partkey % 4 = 0 THEN 700 ELSE 400 END AS to_weight, l_quantity::DOUBLE + 8 AS size FROM lineitem),
      m AS (SELECT l.*, a.id AS font, a.category AS ca, b.id AS new_font, coalesce(b.category, a.category) AS cn, coalesce(b.id, a.id) AS to_font FROM l JOIN fonts a ON a.ord = fo LEFT JOIN fonts b ON b.ord = no),
      r AS (SELECT m.*, x.cap AS cap_old, y.cap AS cap_new, new_font IS NOT NULL AND (new_font <> m.font OR to_weight <> 400) AS changed FROM m JOIN caps x ON x.font = m.font AND x.weight = 400 JOIN caps y ON y.font = to_font AND y.weight = to_weight),
      o AS (SELECT to_font, to_weight, CASE WHEN k % 5 = 0 THEN 20.0::DOUBLE WHEN changed THEN size * (cap_old / cap_new) ELSE size END AS size, CASE WHEN k % 7 = 0 THEN 1.1::DOUBLE WHEN changed AND k % 5 <> 0 THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS sx,
        CASE WHEN changed AND k % 5 <> 0 THEN 0.0::DOUBLE ELSE 0.3::DOUBLE END AS sp, CASE WHEN k % 11 = 0 THEN 0.8::DOUBLE WHEN to_font = font THEN CASE WHEN k % 2 = 0 THEN 0.5::DOUBLE END WHEN cn = 'handwriting' THEN CASE WHEN k % 2 = 0 THEN 0.5::DOUBLE ELSE 0.35::DOUBLE END END AS j,
        CASE WHEN to_font = font OR to_font = 'arimo' THEN 1 END AS g, CASE WHEN to_font = font OR cn = 'handwriting' THEN 1 END AS s FROM r)
      SELECT to_font, to_weight, count(*) AS n, round(sum(size), 4) AS size, round(sum(sx), 4) AS scale_x, round(sum(sp), 4) AS spacing, round(sum(j), 4) AS jitter, count(g) AS glyphs, count(s) AS samples FROM o GROUP BY ALL""",
    "command_targets": f"""{_LOG}, t AS (SELECT CASE WHEN type NOT IN ('updatePage', 'setTypography', 'readHandwriting') THEN target END AS element_id, ['UploadError', 'PdfInputError', 'OcrError', 'TypeError', 'RangeError'][seq % 5 + 1] AS e FROM log WHERE kind IN ('user', 'system'))
      SELECT element_id, CASE WHEN e IN ('UploadError', 'PdfInputError', 'OcrError') THEN 'said: ' || e ELSE 'Processing failed for this page.' END AS message, count(*) AS n FROM t GROUP BY ALL""",
    "dirty_elements": "SELECT DISTINCT user_id AS doc_id, event_id % 7 AS element FROM events WHERE event_type = 'click' EXCEPT SELECT user_id, event_id % 7 FROM events WHERE event_type = 'view'",
    "picker_order": f"""WITH f(ord, id, c, grp) AS (VALUES {', '.join(f"({k}, '{r[0]}', {['sans', 'serif', 'condensed', 'mono', 'handwriting'].index(r[1])}, '{doc.GROUPED_UNDER.get(r[2][0], r[2][0])}')" for k, r in enumerate(dims.FONTS))})
      SELECT id, grp, row_number() OVER (PARTITION BY grp ORDER BY c, ord) AS place FROM f""",
    "base64_round": "SELECT page_id, md5(to_base64(encode(coalesce(html, '')))) AS coded, strlen(coalesce(html, ''))::BIGINT AS n, md5(coalesce(html, '')) AS back FROM pages",
    "font_manifest": f"""WITH s(font_id, slice_id, ord, lo, hi) AS (VALUES {', '.join(f"('{f}', '{n}', {[r[0] for r in dims.FONTS].index(f)}, {a}, {b})" for f, n, a, b in dims.slice_rows())}),
      g AS (SELECT font_id, slice_id, ord, string_agg(lower(printf('%X', lo)) || '-' || lower(printf('%X', hi)), ',' ORDER BY lo, hi) AS ranges FROM s GROUP BY ALL),
      i AS (SELECT ranges, row_number() OVER (ORDER BY min(struct_pack(o := ord, s := slice_id))) - 1 AS idx FROM g GROUP BY ranges) SELECT font_id, slice_id, ranges, idx FROM g JOIN i USING (ranges)""",
}
