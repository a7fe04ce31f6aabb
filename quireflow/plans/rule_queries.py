"""Queries of small rules: labels, alignments, weights, readings, doubtful words, missed ink, cached results and caps."""

from __future__ import annotations

from pyspark.sql import functions as F

from quireflow.operators import edits, fonts, languages, readings, recovery
from quireflow.sources import files
from quireflow.sources.words import WORDS_SQL, page_words, read

#: Weights that fonts ship.
WEIGHTS = (300, 400, 700)


def edit_rules(spark, sf_dir):
    """Label, alignment, nearest weight, choice between two readings, and confidence of each line."""
    li = read(spark, sf_dir, "lineitem")
    k, s, q = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity")
    label = edits.style_label(F.lit("Arimo"), (k % 2 * 300 + 400).cast("int"), q * 1.1)
    align = edits.inferred_alignment(k % 90 * 1.0, s % 70 * 1.0, q)
    weight = fonts.nearest_weight(F.array(*[F.lit(w) for w in WEIGHTS]), (k * 13 % 800).cast("int"))
    wins = readings.numeric_wins(k % 100 / 100.0, F.when(k % 3 == 0, "no digit").otherwise(F.concat(F.lit("n "), k)), s % 100 / 100.0)
    out = li.select(label.alias("label"), align.alias("alignment"), weight.alias("weight"), F.coalesce(wins, F.lit(False)).alias("numeric"), readings.capped_confidence(k % 1000 / 1000.0).cast("long").alias("confidence"))
    return out.groupBy("label", "alignment", "weight", "numeric").agg(F.count("*").alias("n"), F.sum("confidence").alias("confidence"))


def range_parse(spark, sf_dir):
    """Code point ranges as style sheets write them, by event."""
    n = F.col("event_id")
    text = F.when(n % 3 == 0, F.lower(F.hex(n * 7))).otherwise(F.concat(F.lower(F.hex(n * 7)), F.lit("-"), F.hex(n * 9 + 15)))
    r = fonts.parsed_range(text)
    return read(spark, sf_dir, "events").select("event_id", r["lo"].cast("long").alias("lo"), r["hi"].cast("long").alias("hi"))


def reread_candidates(spark, sf_dir):
    """Doubtful words of a page that are read again, with the place of their crop's corner on the page."""
    found = recovery.reread_candidates(page_words(spark, sf_dir), 22.0)
    x = recovery.to_page(F.col("x") * 3.0 + 12, F.col("x") * 0.5, F.lit(12.0), F.lit(3.0))
    return found.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("word_no").cast("long").alias("word_no"), F.col("rank").cast("long").alias("rank"), F.round(x, 6).alias("x"))


def missed_clusters(spark, sf_dir):
    """Ink that no word covers: components of a third of the words against the confident others."""
    w = page_words(spark, sf_dir)
    comps = w.where("h % 3 = 0").select("doc_id", (F.col("line_no") * 100000 + F.col("word_no")).alias("ord"), F.col("x"), (F.col("y") + F.col("h") % 13).alias("y"), F.least(F.col("width"), F.lit(60)).alias("width"), "height", (F.col("width") * 5).alias("area"))
    words = w.where("h % 3 <> 0 and confidence >= 60").select("doc_id", "x", "y", "width", "height")
    return recovery.missed_clusters(comps, words, 22.0).select("doc_id", "x", "y", "width", "height", F.col("n").cast("long").alias("n"))


def cached_results(spark, sf_dir):
    """Requests whose result is known, and the others, each once."""
    e = read(spark, sf_dir, "events")
    cache = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("event_id").alias("result"))
    known, rest = files.cached_results(e.where("event_type = 'click'").select("user_id", "event_id"), cache, ["user_id"])
    return known.groupBy("user_id", "result").agg(F.count("*").alias("n")).unionByName(rest.select("user_id", F.lit(None).cast("long").alias("result"), F.lit(0).cast("long").alias("n")))


def language_cap(spark, sf_dir):
    """The first three kinds of events of each user."""
    e = read(spark, sf_dir, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("first"))
    return languages.capped_languages(e, "user_id", "event_type", "first").select("user_id", "event_type", F.col("rank").cast("long").alias("rank"))


QUERIES = {f.__name__: f for f in (edit_rules, range_parse, reread_candidates, missed_clusters, cached_results, language_cap)}

_H = 22
ORACLES = {
    "edit_rules": """WITH l AS (SELECT l_partkey AS k, l_suppkey AS s, l_quantity::DOUBLE AS q, l_partkey % 90 AS a, l_suppkey % 70 AS b, l_quantity::DOUBLE * 0.6::DOUBLE AS near FROM lineitem),
      r AS (SELECT 'Arimo ' || CASE WHEN k % 2 = 1 THEN 'Bold' ELSE 'Regular' END || ' ' || floor(q * 1.1::DOUBLE + 0.5)::INT || 'px' AS label,
        CASE WHEN a > near AND abs(a - b) <= greatest(near, greatest(a, b) * 0.2::DOUBLE) THEN 'center' WHEN b < near AND a > near * 2 THEN 'right' ELSE 'left' END AS alignment,
        CASE WHEN abs(k * 13 % 800 - 300) <= abs(k * 13 % 800 - 400) THEN 300 WHEN abs(k * 13 % 800 - 400) <= abs(k * 13 % 800 - 700) THEN 400 ELSE 700 END AS weight,
        k % 3 <> 0 AND s % 100 / 100.0::DOUBLE >= greatest(0.2::DOUBLE, k % 100 / 100.0::DOUBLE / 2) AS "numeric", least(75, floor(k % 1000 / 1000.0::DOUBLE * 100 + 0.5))::BIGINT AS c FROM l)
      SELECT label, alignment, weight, "numeric", count(*) AS n, sum(c)::BIGINT AS confidence FROM r GROUP BY ALL""",
    "range_parse": "SELECT event_id, event_id * 7 AS lo, CASE WHEN event_id % 3 = 0 THEN event_id * 7 ELSE event_id * 9 + 15 END AS hi FROM events",
    "reread_candidates": rf"""WITH {WORDS_SQL}, r AS (SELECT doc_id, line_no, word_no, x, row_number() OVER (PARTITION BY doc_id ORDER BY confidence, line_no, word_no) AS rank FROM words
        WHERE confidence < 60 AND regexp_matches(text, '[\p{{L}}\p{{M}}\p{{N}}]') AND height >= 8.8::DOUBLE AND height <= 66)
      SELECT doc_id, line_no, word_no, rank, round(x * 0.5::DOUBLE + (x * 3.0::DOUBLE + 12 - 12) / 3, 6) AS x FROM r WHERE rank <= 60""",
    "missed_clusters": f"""WITH {WORDS_SQL}, c AS (SELECT doc_id, line_no * 100000 + word_no AS ord, x, y + h % 13 AS y, least(width, 60) AS width, height, width * 5 AS area FROM words WHERE h % 3 = 0),
      k AS (SELECT doc_id, x - {_H} * 0.3::DOUBLE AS x, y - {_H} * 0.2::DOUBLE AS y, width + {_H} * 0.6::DOUBLE AS width, height + {_H} * 0.4::DOUBLE AS height FROM words WHERE h % 3 <> 0 AND confidence >= 60),
      f AS (SELECT * FROM c WHERE height >= {_H} * 0.45::DOUBLE AND height <= {_H} * 2.2::DOUBLE AND width <= {3 * _H} AND area >= {_H} AND NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = c.doc_id AND c.x < k.x + k.width AND k.x < c.x + c.width AND c.y < k.y + k.height AND k.y < c.y + c.height)),
      g AS (SELECT doc_id, list(struct_pack(x0 := x::DOUBLE, y0 := y::DOUBLE, x1 := (x + width)::DOUBLE, y1 := (y + height)::DOUBLE, n := 1::BIGINT, lx := (x + width)::DOUBLE, ly := y::DOUBLE, lh := height::DOUBLE) ORDER BY x, ord) AS gs FROM f GROUP BY doc_id),
      m AS (SELECT doc_id, list_reduce(list_transform(gs, lambda e: [e]), lambda d, e: list_transform([coalesce(list_position(list_transform(d, lambda c: least(c.ly + c.lh, e[1].y1) - greatest(c.ly, e[1].y0) >= least(c.lh, e[1].lh) * 0.5::DOUBLE AND e[1].x0 - c.lx <= {_H} * 1.2::DOUBLE), true), 0)],
        lambda p: CASE WHEN p > 0 THEN list_transform(d, lambda c, i: CASE WHEN i = p THEN struct_pack(x0 := least(c.x0, e[1].x0), y0 := least(c.y0, e[1].y0), x1 := greatest(c.x1, e[1].x1), y1 := greatest(c.y1, e[1].y1), n := c.n + 1, lx := e[1].x1, ly := e[1].y0, lh := e[1].lh) ELSE c END) ELSE list_concat(d, e) END)[1]) AS cs FROM g)
      SELECT doc_id, c.x0 AS x, c.y0 AS y, c.x1 - c.x0 AS width, c.y1 - c.y0 AS height, c.n FROM (SELECT doc_id, unnest(cs) AS c FROM m) WHERE c.n >= 2 AND c.y1 - c.y0 <= {_H} * 2.5::DOUBLE""",
    "cached_results": """WITH c AS (SELECT user_id, max(event_id) AS result FROM events WHERE event_type = 'purchase' GROUP BY user_id), r AS (SELECT user_id FROM events WHERE event_type = 'click')
      SELECT user_id, result, count(*) AS n FROM r JOIN c USING (user_id) GROUP BY ALL UNION ALL SELECT DISTINCT user_id, NULL, 0 FROM r WHERE user_id NOT IN (SELECT user_id FROM c)""",
    "language_cap": """WITH f AS (SELECT user_id, event_type, min(struct_pack(t := ts, e := event_id)) AS f FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY f) AS rank FROM f)
      SELECT user_id, event_type, rank FROM r WHERE rank <= 3""",
}
