"""Queries over the derived words: plausibility, runs, order, scripts, spatial joins and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.functions import stats, text as tx
from quireflow.functions.geometry import union_box
from quireflow.operators import layout, readings, recovery, spatial
from quireflow.sources.words import WORDS_SQL, page_words, read

_RULE, _PUNCT = r"^[|\[\]{}()\\/!Il1—–_~=-]+$", r"^[^\p{L}\p{N}]+$"
_PLAUSIBLE = rf"""CASE WHEN width < 1 OR height < 1 THEN false WHEN height > 4 * med THEN false
  WHEN regexp_matches(text, '{_RULE}') AND height / greatest(1, width) > 2.5 THEN false
  WHEN regexp_matches(text, '{_PUNCT}') THEN confidence >= 60 OR regexp_matches(text, '^[:;.,]$')
  WHEN confidence < 25 THEN regexp_matches(text, '[\p{{L}}\p{{N}}]{{3,}}') AND confidence >= 12.5 ELSE true END"""
_MED = "list_sort(list({0}))[len(list({0})) // 2 + 1]"
_KEPT = f"""WITH {WORDS_SQL},
meds AS (SELECT doc_id, {_MED.format('height')} AS med FROM words GROUP BY doc_id),
kept AS (SELECT words.* FROM words JOIN meds USING (doc_id) WHERE {_PLAUSIBLE})"""
_RUNS = f"""{_KEPT},
heights AS (SELECT doc_id, line_no, {_MED.format('height')} AS line_height FROM kept GROUP BY doc_id, line_no),
gaps AS (SELECT kept.*, line_height, x - lag(x + width) OVER w AS gap, regexp_matches(text, '^[:;]$') OR coalesce(regexp_matches(lag(text) OVER w, '^[:;]$'), false) AS colon
  FROM kept JOIN heights USING (doc_id, line_no) WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY x, word_no)),
numbered AS (SELECT *, (sum(CASE WHEN gap > line_height OR (colon AND 10 * gap > 6 * line_height) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, line_no ORDER BY x, word_no ROWS UNBOUNDED PRECEDING))::BIGINT AS run_no FROM gaps),
runs AS (SELECT doc_id, line_no, run_no, min(x) AS x0, max(x + width) AS x1, min(y) AS y0, max(y + height) AS y1, count(*) AS n_words, min(confidence) AS confidence, min(line_height) AS line_height,
  string_agg(text, ' ' ORDER BY x, word_no) AS text, list(struct_pack(x := x, w := word_no, text := text, width := width) ORDER BY x, word_no) AS members FROM numbered GROUP BY doc_id, line_no, run_no),
centres AS (SELECT doc_id, line_no, min(y0) + max(y1) AS centre2 FROM runs GROUP BY doc_id, line_no),
ordered AS (SELECT runs.*, row_number() OVER (PARTITION BY doc_id ORDER BY centre2, line_no, run_no) - 1 AS reading_order FROM runs JOIN centres USING (doc_id, line_no))"""


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.plausible_words(page_words(spark, sf_dir))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.runs(_kept(spark, sf_dir))


def runs_topk_lowconf(spark, sf_dir):
    found = layout.least_confident(layout.reading_order(_runs(spark, sf_dir)))
    return found.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "run_no", "x0", "x1", "y0", "y1", "n_words", "confidence", "text", F.col("reading_order").cast("long").alias("reading_order"), F.col("rank").cast("long").alias("rank"))


def plausible_word_counts(spark, sf_dir):
    words = stats.with_upper_median(page_words(spark, sf_dir), ["doc_id"], "height", "med")
    keep = layout.plausible(F.col("text"), F.col("width"), F.col("height"), F.col("confidence"), F.col("med"))
    return words.groupBy("doc_id").agg(
        F.count("*").alias("n_words"), F.count_if(keep).alias("n_plausible"), F.count_if(F.col("text").rlike(layout.PUNCTUATION_ONLY)).alias("n_punctuation"), F.count_if(F.col("text").rlike(layout.RULE_LIKE)).alias("n_rule_like")
    )


def run_gap_islands(spark, sf_dir):
    return _runs(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "run_no", "x0", "x1", "y0", "y1", "n_words", "confidence", "text")


def reading_order(spark, sf_dir):
    return layout.reading_order(_runs(spark, sf_dir)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "run_no", F.col("reading_order").cast("long").alias("reading_order"))


def colon_attach(spark, sf_dir):
    return layout.colons_attached(_runs(spark, sf_dir)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "run_no", "n_words", "text", "took")


def page_bounds(spark, sf_dir):
    return page_words(spark, sf_dir).groupBy("doc_id").agg(*union_box(), F.min("confidence").alias("confidence"))


def _with_styles(words: DataFrame) -> DataFrame:
    """Words with a measured style: weight, size and colour change every few words of a line, and some measures can't be relied on."""
    n, h, line = F.col("word_no"), F.col("h"), F.col("line_no")
    stroke = F.when((line * 7 + F.floor(n / 3)) % 5 == 0, 3.4).otherwise(2.0) + h % 3 / 10.0
    glyph = F.when((line + F.floor(n / 5)) % 11 == 0, 30.0).otherwise(15.0) + h % 2
    colour = F.array(F.when(F.floor(n / 4) % 6 == 0, 200.0).otherwise(20.0), F.lit(20.0), (h % 20).cast("double"))
    style = F.struct(stroke.alias("strokeWidth"), glyph.alias("glyphHeight"), (glyph * (h % 4 + 0.8)).alias("inkMass"), colour.alias("inkColor"))
    return words.withColumn("style", F.when(h % 7 != 0, style))


def segment_exact(spark, sf_dir):
    return layout.segment_pages(page_words(spark, sf_dir))


def segment_styled(spark, sf_dir):
    return layout.segment_pages(_with_styles(page_words(spark, sf_dir)))


def script_char_counts(spark, sf_dir):
    return tx.char_counts(read(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "script", "n")


def script_shares(spark, sf_dir):
    counts = tx.char_counts(read(spark, sf_dir, "documents"), "doc_id", "text")
    return tx.script_shares(counts, "doc_id").select("doc_id", "script", F.round("share", 9).alias("share"))


def dominant_script(spark, sf_dir):
    return tx.dominant_script(tx.char_counts(read(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


_CHARS = f"""WITH blocks(lo, hi, script) AS (VALUES {tx.blocks_sql()}),
marks AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM documents),
folded AS (SELECT doc_id, ch, count(*) AS n, min(i) AS first_at FROM marks GROUP BY doc_id, ch),
counts AS (SELECT doc_id, script, sum(n)::BIGINT AS n, min(first_at) AS first_at FROM folded JOIN blocks ON unicode(ch) BETWEEN lo AND hi GROUP BY doc_id, script)"""


def credible_words(spark, sf_dir):
    return page_words(spark, sf_dir).where(recovery.credible(F.col("text"), F.col("confidence"), 2)).groupBy("doc_id").agg(F.count("*").alias("n_credible"), F.sum("confidence").alias("confidence_sum"))


_ALNUM_LEN = r"length(regexp_replace(text, '[^\p{L}\p{M}\p{N}]', '', 'g'))"
_CREDIBLE = f"({_ALNUM_LEN} > 0 AND 10 * {_ALNUM_LEN} >= 6 * length(text) AND ({_ALNUM_LEN} >= 3 OR ({_ALNUM_LEN} >= 2 AND confidence >= 85)))"


def _conversation_readings(spark, sf_dir):
    """Each turn as a reading of a line 12 px a character wide, with a confidence from its digest."""
    t = read(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", "text", (F.length("text") * 12).alias("width"), (F.conv(F.substring(F.md5(F.concat_ws(":", "conv_id", "turn")), 1, 2), 16, 10).cast("int") % 100).alias("c"), (F.col("turn") * 40 + 40).alias("height"))


_READINGS = """WITH readings AS (SELECT conv_id, turn, text, length(text) * 12 AS width, ('0x' || substr(md5(conv_id || ':' || turn), 1, 2))::INT % 100 AS c, turn * 40 + 40 AS height FROM conversations),
parts AS (SELECT *, regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g') AS an, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS toks, length(regexp_replace(text, '\\s', '', 'g')) AS dense FROM readings),
judged AS (SELECT *, NOT (len(list_filter(toks, lambda w: len(list_filter(toks, lambda v: v = w)) >= 3)) > 0)
  AND NOT (length(an) >= 2 AND length(replace(lower(an), lower(substr(an, 1, 1)), '')) = 0)
  AND dense <= greatest(3, width / greatest(1, height) * 2.5) AS plausible FROM parts)"""


def plausible_reading(spark, sf_dir):
    r = _conversation_readings(spark, sf_dir)
    return r.select("conv_id", "turn", readings.plausible(F.col("text"), F.col("width"), F.col("height")).alias("plausible"))


def accept_reading(spark, sf_dir):
    r = _conversation_readings(spark, sf_dir)
    return r.select("conv_id", "turn", readings.accepted(F.col("text"), F.col("c") / 100.0, F.col("width"), F.col("height")).alias("accepted"))


def _strata(spark, sf_dir):
    """Words as two layers of a page: confident print, and doubtful marks moved 45 px right and 9 px down."""
    w = page_words(spark, sf_dir)
    left = w.where("confidence >= 60").select("doc_id", "line_no", "word_no", "x", "y", "width", "height")
    right = w.where("confidence < 30").select("doc_id", "line_no", "word_no", (F.col("x") + 45).alias("x"), (F.col("y") + 9).alias("y"), "width", "height")
    return left, right


_STRATA = f"""WITH {WORDS_SQL},
print AS (SELECT doc_id, line_no, word_no, x, y, width, height FROM words WHERE confidence >= 60),
marks AS (SELECT doc_id, line_no, word_no, x + 45 AS x, y + 9 AS y, width, height FROM words WHERE confidence < 30)"""
_OVERLAPS = "p.x < m.x + m.width AND m.x < p.x + p.width AND p.y < m.y + m.height AND m.y < p.y + p.height"


def rect_overlap_antijoin(spark, sf_dir):
    left, right = _strata(spark, sf_dir)
    return spatial.uncovered(right, left).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("x").alias("x_sum"))


def rect_overlap_semijoin(spark, sf_dir):
    left, right = _strata(spark, sf_dir)
    return spatial.centred_in(right, left, 6).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("x").alias("x_sum"))


def overlap_coverage_sum(spark, sf_dir):
    left, right = _strata(spark, sf_dir)
    return spatial.covered_area(right, left).where("100 * covered >= 35 * width * height").select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("word_no").cast("long").alias("word_no"), "covered")


def suspect_ids_per_line(spark, sf_dir):
    left, right = _strata(spark, sf_dir)
    lines = right.groupBy("doc_id", "line_no").agg(*union_box())
    return spatial.mostly_inside(lines, left).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "ids")


def neighbour_limits(spark, sf_dir):
    r = _runs(spark, sf_dir).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "run_no", "x0", "x1")
    return spatial.neighbour_limits(r)


def nearest_element(spark, sf_dir):
    return spatial.nearest(_runs(spark, sf_dir), "confidence < 15", "confidence >= 50", nearer="n_words >= 5")


def nearest_interval(spark, sf_dir):
    w = page_words(spark, sf_dir).withColumn("x", F.when(F.col("confidence") < 30, F.col("x") + 45).otherwise(F.col("x")))
    return spatial.nearest_interval(w, "confidence < 30", "confidence >= 60").select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("word_no").cast("long").alias("word_no"), F.col("host").cast("long").alias("host"), "distance")


def _reread(spark, sf_dir):
    """A second reading of the doubtful words: shifted boxes and confidences of another digest."""
    w = page_words(spark, sf_dir)
    return w, w.where("confidence < 40").withColumn("confidence", (F.col("h").cast("long") * 7 + 13) % 101)


def merge_recovered(spark, sf_dir):
    words, second = _reread(spark, sf_dir)
    return recovery.merged(words, second, ["doc_id", "line_no", "word_no"]).groupBy("doc_id").agg(F.count("*").alias("n_words"), F.count_if("replaced").alias("n_replaced"), F.sum("confidence").alias("confidence_sum"))


def upper_median(spark, sf_dir):
    return stats.ranked_upper_median(read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", "upper_median")


def word_height_medians(spark, sf_dir):
    return page_words(spark, sf_dir).groupBy("doc_id").agg(stats.upper_median("height").alias("med"), stats.nearest_rank("width", 90).alias("p90_width"), stats.indexed("height", 0.6, 20).alias("text_height"), stats.indexed("height", 0.4).alias("headline_height"))


def nearest_rank_pct(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(stats.nearest_rank("l_quantity", 25).alias("p25"), stats.nearest_rank("l_quantity", 75).alias("p75"))


def weight_model_otsu(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_returnflag", F.when(F.col("l_linenumber") % 3 == 0, F.col("l_quantity") + 60).otherwise(F.col("l_quantity") / 4 + 25).alias("v"))
    model = stats.weight_model(rows, ["l_returnflag"], "v")
    return model.select("l_returnflag", "n", F.col("n_lo").cast("long").alias("n_lo"), *[F.round(c, 6).alias(c) for c in ("low", "high", "regular", "bold")])


def hist_otsu_threshold(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_returnflag", F.floor(F.col("l_extendedprice") / 500).alias("bin"))
    return stats.otsu(rows, ["l_returnflag"], "bin")


def mad_wobble(spark, sf_dir):
    w = stats.with_upper_median(page_words(spark, sf_dir).withColumn("base", F.col("y") + F.col("height")), ["doc_id", "line_no"], "base", "med")
    dev = w.groupBy("doc_id", "line_no").agg(F.count("*").alias("n"), stats.upper_median(F.abs(F.col("base") - F.col("med"))).alias("mad"), F.max("height").alias("h"))
    wobble = F.when(F.col("n") < 3, 0.0).otherwise(F.col("mad") / F.col("h"))
    return dev.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.round(wobble, 9).alias("wobble"), stats.jitter(wobble).alias("jitter"))


_LINES = f"""{_KEPT},
before AS (SELECT *, lag(x + width) OVER w AS prev_end, lag(height) OVER w AS prev_height FROM kept WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY x, word_no)),
parts AS (SELECT *, sum(CASE WHEN x - prev_end >= 12 * greatest(height, prev_height) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, line_no ORDER BY x, word_no ROWS UNBOUNDED PRECEDING) AS part FROM before),
tall AS (SELECT doc_id, line_no, part, {_MED.format('height')} AS line_height, min(y) + max(y + height) AS centre2, min(x) AS first_x FROM parts GROUP BY ALL),
ranked AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY centre2, first_x, line_no) - 1 AS line FROM tall),
spaced AS (SELECT p.*, l.line, l.line_height, x - lag(x + width) OVER w AS gap, regexp_matches(text, '^[:;]$') OR coalesce(regexp_matches(lag(text) OVER w, '^[:;]$'), false) AS colon
  FROM parts p JOIN ranked l USING (doc_id, line_no, part) WINDOW w AS (PARTITION BY doc_id, l.line ORDER BY x, word_no)),
split AS (SELECT *, sum(CASE WHEN gap > line_height OR (colon AND 10 * gap > 6 * line_height) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, line ORDER BY x, word_no ROWS UNBOUNDED PRECEDING) AS run FROM spaced)"""
_ATTACHED = f"""big AS (SELECT doc_id, line, run, min(line_height) AS lh, list(struct_pack(x := x, text := text, width := width, y := y, height := height, c := confidence) ORDER BY x, word_no) AS m FROM split GROUP BY ALL),
ends AS (SELECT *, lag(m[-1]) OVER w AS prev FROM big WINDOW w AS (PARTITION BY doc_id, line ORDER BY run)),
given AS (SELECT *, coalesce(len(m) >= 2 AND m[1].text IN (':', ';') AND prev IS NOT NULL AND NOT regexp_matches(prev.text, '{_PUNCT}') AND m[1].x - (prev.x + prev.width) <= 2 * lh, false) AS gives FROM ends),
taken AS (SELECT *, CASE WHEN lead(gives) OVER w THEN lead(m[1]) OVER w END AS takes FROM given WINDOW w AS (PARTITION BY doc_id, line ORDER BY run)),
whole AS (SELECT doc_id, line, run, list_concat(CASE WHEN gives THEN m[2:] ELSE m END, CASE WHEN takes IS NULL THEN [] ELSE [takes] END) AS m FROM taken)
SELECT doc_id, line::BIGINT AS line_no, row_number() OVER (PARTITION BY doc_id, line ORDER BY run) - 1 AS run_no, row_number() OVER (PARTITION BY doc_id ORDER BY line, run) - 1 AS reading_order, array_to_string(list_transform(m, lambda w: w.text), ' ') AS text,
  list_min(list_transform(m, lambda w: w.x))::DOUBLE AS x, list_min(list_transform(m, lambda w: w.y))::DOUBLE AS y, (list_max(list_transform(m, lambda w: w.x + w.width)) - list_min(list_transform(m, lambda w: w.x)))::DOUBLE AS width,
  (list_max(list_transform(m, lambda w: w.y + w.height)) - list_min(list_transform(m, lambda w: w.y)))::DOUBLE AS height, list_min(list_transform(m, lambda w: w.c))::DOUBLE AS confidence, len(m)::BIGINT AS n_words FROM whole"""

_UP = "list_sort({0})[len({0}) // 2 + 1]"
_STYLED = f"""{_LINES},
seen AS (SELECT *, h % 7 <> 0 AND h % 4 <> 0 AND NOT regexp_matches(text, '{_PUNCT}') AS reliable, CASE WHEN (line_no * 7 + word_no // 3) % 5 = 0 THEN 3.4::DOUBLE ELSE 2.0::DOUBLE END + h % 3 / 10.0::DOUBLE AS stroke,
  CASE WHEN (line_no + word_no // 5) % 11 = 0 THEN 30.0::DOUBLE ELSE 15.0::DOUBLE END + h % 2 AS glyph_height, CASE WHEN word_no // 4 % 6 = 0 THEN 200.0::DOUBLE ELSE 20.0::DOUBLE END AS red, (h % 20)::DOUBLE AS blue,
  length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS letters, regexp_matches(text, '[\\p{{Lu}}\\p{{N}}bdfhklt]') AS rises FROM split),
pages AS (SELECT doc_id, coalesce({_UP.format('list(glyph_height) FILTER (reliable AND rises AND letters >= 2)')}, max(greatest(med, 1))::DOUBLE) AS page_height FROM seen JOIN meds USING (doc_id) GROUP BY doc_id),
own AS (SELECT doc_id, line, {_UP.format('list(glyph_height) FILTER (reliable AND rises AND letters >= 2)')} AS mine FROM seen GROUP BY ALL),
glyphs AS (SELECT doc_id, line, page_height, CASE WHEN mine IS NOT NULL AND abs(mine - page_height) > 0.3::DOUBLE * page_height THEN mine ELSE page_height END AS glyph FROM own JOIN pages USING (doc_id)),
sized AS (SELECT s.*, glyph, stroke / greatest(1, glyph) AS ratio FROM seen s JOIN glyphs USING (doc_id, line)),
v AS (SELECT doc_id, ratio AS v FROM sized WHERE reliable),
vmed AS (SELECT doc_id, {_UP.format('list(v)')} AS mid FROM v GROUP BY doc_id HAVING count(*) >= 6),
near AS (SELECT v.* FROM v JOIN vmed USING (doc_id) WHERE v >= mid / 2.5::DOUBLE AND v <= mid * 2.5::DOUBLE),
cuts AS (SELECT doc_id, v, row_number() OVER o AS n_lo, sum(v) OVER (PARTITION BY doc_id ORDER BY v ROWS UNBOUNDED PRECEDING) AS s_lo, count(*) OVER p AS n, sum(v) OVER p AS s, sum(v * v) OVER p AS ss, lead(v) OVER o AS nxt FROM near WINDOW p AS (PARTITION BY doc_id), o AS (PARTITION BY doc_id ORDER BY v)),
means AS (SELECT *, s_lo / n_lo AS m_lo, (s - s_lo) / (n - n_lo) AS m_hi FROM cuts WHERE n >= 6 AND n_lo < n AND v < nxt),
best AS (SELECT * FROM means QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n_lo * (n - n_lo) * (m_hi - m_lo) * (m_hi - m_lo) DESC, n_lo) = 1),
model AS (SELECT doc_id, (v + nxt) / 2 - 0.12::DOUBLE * (m_hi - m_lo) AS low, (v + nxt) / 2 + 0.12::DOUBLE * (m_hi - m_lo) AS high FROM best
  WHERE least(n_lo, n - n_lo) >= greatest(3, floor(n * 0.04::DOUBLE + 0.5)) AND m_hi >= 1.2::DOUBLE * m_lo AND n_lo * (n - n_lo) * (m_hi - m_lo) * (m_hi - m_lo) / n >= 0.6::DOUBLE * (ss - s * s / n)),
marked AS (SELECT z.*, CASE WHEN ratio >= high THEN true WHEN ratio <= low THEN false END AS bold, CASE WHEN rises AND letters >= 2 THEN glyph_height END AS tall FROM sized z LEFT JOIN model USING (doc_id)),
states AS (SELECT doc_id, line, run, list(struct_pack(k := 0, out := []::INT[], bolds := []::BOOLEAN[], heights := []::DOUBLE[], strokes := []::DOUBLE[], reds := []::DOUBLE[], blues := []::DOUBLE[],
  w := struct_pack(ok := reliable, bold := bold, tall := tall, letters := letters, stroke := stroke, red := red, blue := blue, glyph := glyph)) ORDER BY x, word_no) AS ws FROM marked GROUP BY ALL),
folded AS (SELECT doc_id, line, run, list_reduce(list_concat([struct_pack(k := 0, out := []::INT[], bolds := []::BOOLEAN[], heights := []::DOUBLE[], strokes := []::DOUBLE[], reds := []::DOUBLE[], blues := []::DOUBLE[], w := ws[1].w)], ws), lambda a, e:
  list_transform([e.w.ok AND len(a.out) > 0 AND (
      coalesce(e.w.bold IS NOT NULL AND len(a.bolds) > 0 AND len(a.strokes) > 0 AND (2 * len(list_filter(a.bolds, lambda t: t)) >= len(a.bolds)) <> e.w.bold AND greatest(e.w.stroke, {_UP.format('a.strokes')}) / greatest(1e-6::DOUBLE, least(e.w.stroke, {_UP.format('a.strokes')})) >= 1.18::DOUBLE, false)
      OR coalesce(e.w.tall IS NOT NULL AND len(a.heights) > 0 AND e.w.letters >= 4 AND least(e.w.tall, {_UP.format('a.heights')}) >= 0.5::DOUBLE * e.w.glyph AND greatest(e.w.tall, {_UP.format('a.heights')}) / greatest(1e-6::DOUBLE, least(e.w.tall, {_UP.format('a.heights')})) >= 1.6::DOUBLE
        AND abs(e.w.tall - {_UP.format('a.heights')}) >= greatest(3.0::DOUBLE, 0.3::DOUBLE * {_UP.format('a.heights')}), false)
      OR coalesce(len(a.reds) > 0 AND sqrt(power(e.w.red - {_UP.format('a.reds')}, 2) + power(e.w.blue - {_UP.format('a.blues')}, 2)) >= 70, false))],
    lambda new: struct_pack(k := CASE WHEN new THEN a.k + 1 ELSE a.k END, out := list_append(a.out, CASE WHEN new THEN a.k + 1 ELSE a.k END),
      bolds := CASE WHEN NOT e.w.ok THEN a.bolds ELSE list_concat(CASE WHEN new THEN [] ELSE a.bolds END, CASE WHEN e.w.bold IS NULL THEN [] ELSE [e.w.bold] END) END,
      heights := CASE WHEN NOT e.w.ok THEN a.heights ELSE list_concat(CASE WHEN new THEN [] ELSE a.heights END, CASE WHEN e.w.tall IS NULL THEN [] ELSE [e.w.tall] END) END,
      strokes := CASE WHEN NOT e.w.ok THEN a.strokes ELSE list_append(CASE WHEN new THEN [] ELSE a.strokes END, e.w.stroke) END, reds := CASE WHEN NOT e.w.ok THEN a.reds ELSE list_append(CASE WHEN new THEN [] ELSE a.reds END, e.w.red) END,
      blues := CASE WHEN NOT e.w.ok THEN a.blues ELSE list_append(CASE WHEN new THEN [] ELSE a.blues END, e.w.blue) END, w := e.w))[1]).out AS ks FROM states),
kept_runs AS (SELECT doc_id, line, run, generate_subscripts(ks, 1) AS i, unnest(ks) AS k FROM folded),
resplit AS (SELECT m.* EXCLUDE (run), run * 100000 + k AS run FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line, run ORDER BY x, word_no) AS i FROM marked) m JOIN kept_runs USING (doc_id, line, run, i))"""

QUERIES = {f.__name__: f for f in (
    runs_topk_lowconf, plausible_word_counts, run_gap_islands, reading_order, colon_attach, page_bounds, segment_exact, segment_styled, script_char_counts, script_shares, dominant_script, credible_words, plausible_reading, accept_reading,
    rect_overlap_antijoin, rect_overlap_semijoin, overlap_coverage_sum, suspect_ids_per_line, neighbour_limits, nearest_element, nearest_interval, merge_recovered, upper_median, word_height_medians, nearest_rank_pct, weight_model_otsu, hist_otsu_threshold, mad_wobble,
)}

ORACLES = {
    "segment_exact": f"{_LINES}, {_ATTACHED}",
    "segment_styled": f"{_STYLED}, {_ATTACHED.replace('FROM split GROUP', 'FROM resplit GROUP')}",
    "runs_topk_lowconf": f"""{_RUNS} SELECT doc_id, line_no, run_no, x0, x1, y0, y1, n_words, confidence, text, reading_order, rank FROM
      (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence, reading_order) AS rank FROM ordered) WHERE rank <= 60""",
    "plausible_word_counts": f"""WITH {WORDS_SQL}, meds AS (SELECT doc_id, {_MED.format('height')} AS med FROM words GROUP BY doc_id)
      SELECT doc_id, count(*) AS n_words, count_if({_PLAUSIBLE})::BIGINT AS n_plausible, count_if(regexp_matches(text, '{_PUNCT}'))::BIGINT AS n_punctuation, count_if(regexp_matches(text, '{_RULE}'))::BIGINT AS n_rule_like
      FROM words JOIN meds USING (doc_id) GROUP BY doc_id""",
    "run_gap_islands": f"{_RUNS} SELECT doc_id, line_no, run_no, x0, x1, y0, y1, n_words, confidence, text FROM runs",
    "reading_order": f"{_RUNS} SELECT doc_id, line_no, run_no, reading_order FROM ordered",
    "colon_attach": f"""{_RUNS}, b AS (SELECT *, lag(members[-1]) OVER w AS prev FROM runs WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY run_no)),
      g AS (SELECT *, coalesce(n_words >= 2 AND regexp_matches(members[1].text, '^[:;]$') AND prev IS NOT NULL AND NOT regexp_matches(prev.text, '{_PUNCT}') AND members[1].x - (prev.x + prev.width) <= 2 * line_height, false) AS gives FROM b),
      t AS (SELECT *, CASE WHEN lead(gives) OVER w THEN lead(members[1].text) OVER w END AS takes FROM g WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY run_no)),
      f AS (SELECT *, list_concat(CASE WHEN gives THEN list_transform(members[2:], lambda m: m.text) ELSE list_transform(members, lambda m: m.text) END, CASE WHEN takes IS NULL THEN [] ELSE [takes] END) AS ws FROM t)
      SELECT doc_id, line_no, run_no, len(ws)::BIGINT AS n_words, array_to_string(ws, ' ') AS text, takes IS NOT NULL AS took FROM f""",
    "page_bounds": f"WITH {WORDS_SQL} SELECT doc_id, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height, min(confidence) AS confidence FROM words GROUP BY doc_id",
    "script_char_counts": f"{_CHARS} SELECT doc_id, script, n FROM counts",
    "script_shares": f"{_CHARS} SELECT doc_id, script, round(n / greatest(1, sum(n) OVER (PARTITION BY doc_id)), 9) AS share FROM counts",
    "dominant_script": f"{_CHARS} SELECT doc_id, script, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_at) AS k FROM counts) WHERE k = 1",
    "credible_words": f"WITH {WORDS_SQL} SELECT doc_id, count(*) AS n_credible, sum(confidence)::BIGINT AS confidence_sum FROM words WHERE {_CREDIBLE} GROUP BY doc_id",
    "plausible_reading": f"{_READINGS} SELECT conv_id, turn, plausible FROM judged",
    "accept_reading": f"""{_READINGS} SELECT conv_id, turn, CASE WHEN NOT plausible OR length(an) = 0 THEN false WHEN regexp_matches(text, '^[\\d\\s/\\-.,:]+$') THEN c >= 25 AND (length(an) >= 2 OR c >= 80)
      WHEN length(an) < 3 THEN false WHEN length(an) < 5 THEN c >= 60 ELSE c >= 45 END AS accepted FROM judged""",
    "rect_overlap_antijoin": f"{_STRATA} SELECT doc_id, count(*) AS n, sum(x)::BIGINT AS x_sum FROM marks m WHERE NOT EXISTS (SELECT 1 FROM print p WHERE p.doc_id = m.doc_id AND {_OVERLAPS}) GROUP BY doc_id",
    "rect_overlap_semijoin": f"""{_STRATA} SELECT doc_id, count(*) AS n, sum(x)::BIGINT AS x_sum FROM marks m WHERE EXISTS (SELECT 1 FROM print p WHERE p.doc_id = m.doc_id
      AND m.x + m.width / 2.0 BETWEEN p.x - 6 AND p.x + p.width + 6 AND m.y + m.height / 2.0 BETWEEN p.y - 6 AND p.y + p.height + 6) GROUP BY doc_id""",
    "overlap_coverage_sum": f"""{_STRATA} SELECT m.doc_id, m.line_no, m.word_no, sum((least(p.x + p.width, m.x + m.width) - greatest(p.x, m.x)) * (least(p.y + p.height, m.y + m.height) - greatest(p.y, m.y)))::BIGINT AS covered
      FROM marks m JOIN print p ON p.doc_id = m.doc_id AND {_OVERLAPS} GROUP BY m.doc_id, m.line_no, m.word_no, m.width, m.height HAVING 100 * covered >= 35 * m.width * m.height""",
    "suspect_ids_per_line": f"""{_STRATA}, m AS (SELECT doc_id, line_no, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height FROM marks GROUP BY doc_id, line_no)
      SELECT m.doc_id, m.line_no, string_agg(p.line_no || ':' || p.word_no, ',' ORDER BY p.line_no, p.word_no) AS ids FROM m JOIN print p ON p.doc_id = m.doc_id AND {_OVERLAPS}
      WHERE 2 * (least(p.x + p.width, m.x + m.width) - greatest(p.x, m.x)) * (least(p.y + p.height, m.y + m.height) - greatest(p.y, m.y)) >= p.width * p.height GROUP BY m.doc_id, m.line_no""",
    "neighbour_limits": f"""{_RUNS} SELECT a.doc_id, a.line_no, a.run_no, max(b.x1) FILTER (WHERE b.x1 <= a.x0) AS left_limit, min(b.x0) FILTER (WHERE b.x0 >= a.x1) AS right_limit
      FROM runs a JOIN runs b ON a.doc_id = b.doc_id AND a.line_no = b.line_no GROUP BY ALL""",
    "nearest_element": f"""{_RUNS}, a AS (SELECT * FROM runs WHERE confidence < 15), b AS (SELECT * FROM runs WHERE confidence >= 50),
      d AS (SELECT a.doc_id, a.line_no, a.run_no, b.line_no AS near_line, b.run_no AS near_run, ((a.x0 + a.x1 - b.x0 - b.x1) * (a.x0 + a.x1 - b.x0 - b.x1) + (a.y0 + a.y1 - b.y0 - b.y1) * (a.y0 + a.y1 - b.y0 - b.y1))::DOUBLE * CASE WHEN b.n_words >= 5 THEN 0.64::DOUBLE ELSE 1.0::DOUBLE END AS distance FROM a JOIN b USING (doc_id))
      SELECT doc_id, line_no, run_no, near_line, near_run, distance FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no, run_no ORDER BY distance, near_line, near_run) AS k FROM d) WHERE k = 1""",
    "nearest_interval": f"""{_STRATA}, d AS (SELECT m.doc_id, m.line_no, m.word_no, p.word_no AS host, greatest(0, p.x - (m.x + m.width), m.x - (p.x + p.width)) AS distance FROM marks m JOIN print p USING (doc_id, line_no))
      SELECT doc_id, line_no, word_no, host, distance FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no, word_no ORDER BY distance, host) AS k FROM d) WHERE k = 1""",
    "merge_recovered": f"""WITH {WORDS_SQL}, second AS (SELECT doc_id, line_no, word_no, text, (h * 7 + 13) % 101 AS new_confidence FROM words WHERE confidence < 40),
      m AS (SELECT w.doc_id, w.confidence, s.new_confidence, s.new_confidence IS NOT NULL AND s.new_confidence >= 50 AND s.new_confidence > w.confidence + 15
        AND {_CREDIBLE.replace('length(text)', 'length(w.text)').replace('regexp_replace(text', 'regexp_replace(w.text').replace('>= 2 AND confidence', '>= 1 AND s.new_confidence')} AS replaced FROM words w LEFT JOIN second s USING (doc_id, line_no, word_no))
      SELECT doc_id, count(*) AS n_words, count_if(replaced)::BIGINT AS n_replaced, sum(CASE WHEN replaced THEN new_confidence ELSE confidence END)::BIGINT AS confidence_sum FROM m GROUP BY doc_id""",
    "upper_median": f"SELECT l_returnflag, l_linestatus, {_MED.format('l_extendedprice')} AS upper_median FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "word_height_medians": f"""WITH {WORDS_SQL}, s AS (SELECT doc_id, list_sort(list(height)) AS hs, list_sort(list(width)) AS ws FROM words GROUP BY doc_id)
      SELECT doc_id, hs[len(hs) // 2 + 1] AS med, ws[floor(0.9 * (len(ws) - 1) + 0.5)::INT + 1] AS p90_width, CASE WHEN len(hs) >= 20 THEN hs[floor(0.6::DOUBLE * len(hs))::INT + 1] ELSE 0 END AS text_height, hs[floor(0.4::DOUBLE * len(hs))::INT + 1] AS headline_height FROM s""",
    "nearest_rank_pct": """WITH s AS (SELECT l_orderkey, list_sort(list(l_quantity)) AS q FROM lineitem GROUP BY l_orderkey)
      SELECT l_orderkey, q[floor(0.25 * (len(q) - 1) + 0.5)::INT + 1] AS p25, q[floor(0.75 * (len(q) - 1) + 0.5)::INT + 1] AS p75 FROM s""",
    "weight_model_otsu": """WITH r AS (SELECT l_returnflag, CASE WHEN l_linenumber % 3 = 0 THEN l_quantity + 60 ELSE l_quantity / 4 + 25 END AS v FROM lineitem),
      meds AS (SELECT l_returnflag, list_sort(list(v))[count(*) // 2 + 1] AS med FROM r WHERE v > 0 GROUP BY l_returnflag),
      near AS (SELECT r.* FROM r JOIN meds USING (l_returnflag) WHERE v > 0 AND v <= med * 2.5 AND v >= med / 2.5),
      run AS (SELECT l_returnflag, v, row_number() OVER o AS n_lo, sum(v) OVER (PARTITION BY l_returnflag ORDER BY v ROWS UNBOUNDED PRECEDING) AS s_lo, count(*) OVER p AS n, sum(v) OVER p AS s, sum(v * v) OVER p AS ss, lead(v) OVER o AS nxt FROM near WINDOW p AS (PARTITION BY l_returnflag), o AS (PARTITION BY l_returnflag ORDER BY v)),
      sp AS (SELECT *, s_lo / n_lo AS m_lo, (s - s_lo) / (n - n_lo) AS m_hi, n_lo * (n - n_lo) * power((s - s_lo) / (n - n_lo) - s_lo / n_lo, 2) AS b FROM run WHERE n >= 6 AND n_lo < n),
      best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY b DESC, n_lo) AS k FROM sp) WHERE k = 1),
      c AS (SELECT *, n_lo >= greatest(3, floor(0.04 * n + 0.5)) AND n - n_lo >= greatest(3, floor(0.04 * n + 0.5)) AND m_hi >= 1.2 * m_lo AND b / n >= 0.6 * (ss - s * s / n) AS ok FROM best)
      SELECT l_returnflag, n, n_lo, CASE WHEN ok THEN round((v + nxt) / 2 - 0.12 * (m_hi - m_lo), 6) END AS low, CASE WHEN ok THEN round((v + nxt) / 2 + 0.12 * (m_hi - m_lo), 6) END AS high, CASE WHEN ok THEN round(m_lo, 6) END AS regular, CASE WHEN ok THEN round(m_hi, 6) END AS bold FROM c""",
    "hist_otsu_threshold": """WITH h AS (SELECT l_returnflag, floor(l_extendedprice / 500)::BIGINT AS bin, count(*) AS c FROM lineitem GROUP BY ALL),
      r AS (SELECT l_returnflag, bin, sum(c) OVER o AS n_b, sum(c * bin) OVER o AS s_b, sum(c) OVER p AS n, sum(c * bin) OVER p AS s FROM h WINDOW p AS (PARTITION BY l_returnflag), o AS (PARTITION BY l_returnflag ORDER BY bin ROWS UNBOUNDED PRECEDING)),
      b AS (SELECT l_returnflag, bin, n_b::DOUBLE * (n - n_b)::DOUBLE * power(s_b::DOUBLE / n_b::DOUBLE - (s - s_b)::DOUBLE / (n - n_b)::DOUBLE, 2) AS v FROM r WHERE n_b < n)
      SELECT l_returnflag, bin AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY v DESC, bin) AS k FROM b) WHERE k = 1""",
    "mad_wobble": f"""WITH {WORDS_SQL}, b AS (SELECT *, y + height AS base FROM words), m AS (SELECT doc_id, line_no, {_MED.format('base')} AS med FROM b GROUP BY ALL),
      d AS (SELECT doc_id, line_no, abs(base - med) AS dev, height FROM b JOIN m USING (doc_id, line_no)),
      w AS (SELECT doc_id, line_no, CASE WHEN count(*) < 3 THEN 0.0::DOUBLE ELSE {_MED.format('dev')} / max(height)::DOUBLE END AS wobble FROM d GROUP BY doc_id, line_no)
      SELECT doc_id, line_no, round(wobble, 9) AS wobble, floor(greatest(0.15::DOUBLE, least(0.85::DOUBLE, wobble / 0.055::DOUBLE)) * 100 + 0.5) / 100 AS jitter FROM w""",
}
