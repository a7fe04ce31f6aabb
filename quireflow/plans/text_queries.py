"""Queries over texts, languages and fonts. Texts in many scripts are the turns of conversations behind a phrase each; other inputs are derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quireflow.functions import text as tx
from quireflow.operators import fonts, languages
from quireflow.sources import dims
from quireflow.sources.words import read

#: Phrases in many scripts, put before the tables' own texts.
SAMPLES = (
    "नेपाल 2081", "२०८१", "17652.00", "Привет", "Łódź Tiếng Việt", "发票号码", "請求書のお知らせ", "세금 계산서", "فاتورة ١٧٦٥٢", "اردو", "চালান", "தமிழ்", "తెలుగు", "ગુજરાતી", "ਪੰਜਾਬੀ", "ಕನ್ನಡ", "മലയാളം", "ใบแจ้งหนี้", "עברית",
    "Ελληνικά", "Nepal 2081", "17652 Invoice", "فاتورة 17652", "Bill नेपाल", "", "2024年9月", "क्षत्रिय नमस्ते राष्ट्र", "Invoice №7", "Счёт 12", "漢字かな交じり",
)
LOCALES = (("ne-NP", "en"), ("en-US",), ("zh-TW",), ("zh-Hant-HK", "en"), ("ur-PK",), ("es-MX", "fr"), ("en-GB",), (), ("bn-BD",), ("tlh", "pa-IN"), ("mr",))
PROBES = ("नेपाल सरकार", "চালান নেপাল नेपाल", "ਪੰਜਾਬੀ বাংলা हिन्दी नेपाल", "Latin only", "")
OSD = ("Latin", "Devanagari", "Han", "HanT", "Japanese", "Korean", " Arabic ", "Klingon", "Fraktur", "Cyrillic", "Thai")


def _q(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def _list(items) -> str:
    return "([" + ", ".join(map(_q, items)) + "]::VARCHAR[])"


_SAMPLES_SQL = f"samples AS (SELECT conv_id::BIGINT * 100 + turn AS id, {_list(SAMPLES)}[((conv_id * 7 + turn) % {len(SAMPLES)})::INT + 1] || ' ' || coalesce(text, '') AS text FROM conversations)"
_BLOCKS = f"blocks(lo, hi, script) AS (VALUES {tx.blocks_sql()})"
_LANG = "langs(ord, code, scripts, locales, region) AS (VALUES " + ", ".join(f"({k}, {_q(c)}, {_list(s)}, {_list(loc)}, {_q(r)})" for k, (c, s, loc, r) in enumerate(dims.LANGUAGES)) + ")"
_CAND = "cand(key, ord, code) AS (VALUES " + ", ".join([f"({_q(k)}, {i}, {_q(c)})" for k, v in dims.SCRIPT_LANGUAGES.items() for i, c in enumerate(v)] + [f"('*', {i}, {_q(r[0])})" for i, r in enumerate(dims.LANGUAGES)]) + ")"
_DETECTED = "det(name, key) AS (VALUES " + ", ".join(f"({_q(a)}, {_q(b)})" for a, b in sorted(dims.DETECTED.items())) + ")"
_FONTS = "fonts(ord, id, category, scripts, region) AS (VALUES " + ", ".join(f"({o}, {_q(i)}, {_q(c)}, {_list(s)}, {_q(r)})" for o, i, c, s, r in dims.font_rows()) + ")"
_SLICES = "slices(font_id, slice_id, lo, hi) AS (VALUES " + ", ".join(f"({_q(f)}, {_q(s)}, {a}, {b})" for f, s, a, b in dims.slice_rows()) + ")"
_SCRIPTED = f"""WITH {_BLOCKS}, {_SAMPLES_SQL}, marks AS (SELECT id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM samples WHERE text <> ''),
scripted AS (SELECT id, i, script FROM marks JOIN blocks ON unicode(ch) BETWEEN lo AND hi)"""


def _samples(spark, sf_dir):
    phrase = F.element_at(F.array(*[F.lit(t) for t in SAMPLES]), ((F.col("conv_id") * 7 + F.col("turn")) % len(SAMPLES) + 1).cast("int"))
    c = read(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id").cast("long") * 100 + F.col("turn")).alias("id"), F.concat(phrase, F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))


def scripts_of_text(spark, sf_dir):
    s = _samples(spark, sf_dir)
    return s.select("id", F.array_join(F.sort_array(tx.scripts_of(F.col("text"))), ",").alias("scripts"), tx.has_connected(F.col("text")).alias("connected"), tx.has_rtl(F.col("text")).alias("rtl"))


def text_direction(spark, sf_dir):
    return _samples(spark, sf_dir).select("id", tx.direction(F.col("text")).alias("direction"))


def grapheme_clusters(spark, sf_dir):
    c = tx.clusters(F.col("text"))
    return _samples(spark, sf_dir).select("id", F.size(c).alias("n"), F.array_join(c, "|").alias("clusters"))


def normalize_languages(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", *[(F.col("event_id") * m % 47).cast("int").alias(f"k{m}") for m in (3, 5, 7, 11)])
    codes = F.array(*[F.lit(r[0]) for r in dims.LANGUAGES], *[F.lit(c) for c in ("xx", "auto", "yy", "eng", "hin", "zz", "nep")])
    picked = F.array(*[F.element_at(codes, F.col(f"k{m}") + 1) for m in (3, 5, 7, 11)])
    return rows.select("event_id", F.array_join(languages.normalised(picked), ",").alias("languages"))


def _evidence(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    locales = F.element_at(F.array(*[F.array(*[F.lit(x) for x in loc]).cast("array<string>") for loc in LOCALES]), (F.col("event_id") % len(LOCALES) + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("id"), pick(OSD, F.col("event_id") * 5).alias("osd_script"), ((F.col("event_id") * 7 % 30) / 10.0).alias("osd_confidence"), (F.col("event_id") % 9).alias("headline_words"),
        pick(PROBES, F.col("event_id") * 3).alias("probe_text"), locales.alias("locales"),
    )


def language_choice(spark, sf_dir):
    return languages.choose(_evidence(spark, sf_dir))


def locale_longest_prefix(spark, sf_dir):
    e = _evidence(spark, sf_dir).select("id", F.lit(1).alias("attempt"), F.element_at(F.array(*[F.lit(k) for k in ("han", "devanagari", "arabic", "latin", "*")]), (F.col("id") % 5 + 1).cast("int")).alias("key"), "locales")
    return languages.matched(e).select("id", "primary")


def languages_expanded(spark, sf_dir):
    codes = F.array(*[F.lit(r[0]) for r in dims.LANGUAGES], F.lit("xx"))
    n = F.col("event_id")
    picked = F.array(*[F.element_at(codes, (n * m % (len(dims.LANGUAGES) + 1) + 1).cast("int")) for m in (3, 5, 7)])
    rows = read(spark, sf_dir, "events").select(n.alias("id"), F.slice(picked, F.lit(1), (n % 4).cast("int")).alias("codes"))
    return languages.expanded(rows, "id", "codes").select("id", F.array_join("scripts", ",").alias("scripts"), F.array_join("regions", ",").alias("regions"))


#: Scripts and regions of a text's context, by turns.
CONTEXTS = (((), ()), ((), ("sc",)), (("han", "kana"), ("jp",)), (("devanagari", "latin"), ()), ((), ("tc",)))


def _font_texts(spark, sf_dir):
    k = (F.col("id") % len(CONTEXTS) + 1).cast("int")
    of = lambda i: F.element_at(F.array(*[F.array(*[F.lit(x) for x in c[i]]).cast("array<string>") for c in CONTEXTS]), k)
    return _samples(spark, sf_dir).withColumns({"scripts": of(0), "regions": of(1)})


_TEXTS_SQL = f"""{_SAMPLES_SQL}, texts AS (SELECT id, text, [{', '.join(_list(c[0]) for c in CONTEXTS)}][(id % {len(CONTEXTS)})::INT + 1] AS scripts, [{', '.join(_list(c[1]) for c in CONTEXTS)}][(id % {len(CONTEXTS)})::INT + 1] AS regions FROM samples)"""
_POINTS = """marks AS (SELECT DISTINCT id, unicode(unnest(string_split(text, ''))) AS cp FROM samples WHERE text <> ''),
need AS (SELECT id, cp FROM marks WHERE NOT (cp <= 32 OR cp = 160 OR cp BETWEEN 8203 AND 8207 OR cp = 65279 OR cp BETWEEN 65024 AND 65039)),
drawn AS (SELECT DISTINCT cp, font_id, slice_id FROM (SELECT DISTINCT cp FROM marks) JOIN slices ON cp BETWEEN lo AND hi)"""
_COVER = f"""WITH {_BLOCKS}, {_FONTS}, {_SLICES}, {_TEXTS_SQL}, {_POINTS},
wanted AS (SELECT id, count(*) AS n FROM need GROUP BY id),
cover AS (SELECT id, font_id FROM need JOIN (SELECT DISTINCT cp, font_id FROM drawn) USING (cp) JOIN wanted USING (id) GROUP BY id, font_id, n HAVING count(*) = n
  UNION ALL SELECT t.id, f.id FROM texts t, fonts f WHERE t.id NOT IN (SELECT id FROM wanted))"""


def font_cover_division(spark, sf_dir):
    return fonts.covering(_font_texts(spark, sf_dir))


def font_candidates_fallback(spark, sf_dir):
    return fonts.candidates(_font_texts(spark, sf_dir)).select("id", "font_id")


def slice_pruning(spark, sf_dir):
    wanted = _samples(spark, sf_dir).withColumn("font_id", F.element_at(F.array(*[F.lit(f) for f in ("arimo", "tinos", "caveat", "noto-sans-sc", "mukta")]), (F.col("id") % 5 + 1).cast("int")))
    return fonts.stacks(wanted)


def variant_donors_topk(spark, sf_dir):
    ids = [r[1] for r in dims.font_rows()]
    pick = lambda n: F.element_at(F.array(*[F.lit(i) for i in ids]), (n % len(ids) + 1).cast("int"))
    li = read(spark, sf_dir, "lineitem")
    ranked = li.select(F.col("l_orderkey").alias("id"), pick(F.col("l_orderkey") % 7).alias("fitted"), F.col("l_linenumber").alias("rank"), pick(F.col("l_partkey")).alias("font_id"))
    return fonts.variant_donors(ranked).select("id", "font_id", "place")


def fnv1a_hash(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", tx.fnv1a(F.col("p_name")).alias("h"))


VOCABULARY = ("<s>", "<pad>", "</s>", "▁Ri", "val", "▁Bag", "▁House", "▁9", "0001")
_PICKS = (3, 5, 7, 11, 13)


def detokenise(spark, sf_dir):
    """Token sequences of up to five ids from a small vocabulary, by event."""
    n = F.col("event_id")
    rows = read(spark, sf_dir, "events").select(n.alias("id"), F.slice(F.array(*[(n * m + F.floor(n / m)) % len(VOCABULARY) for m in _PICKS]), F.lit(1), (n % 6).cast("int")).alias("ids"))
    pieces = F.transform("ids", lambda i: F.element_at(F.array(*[F.lit(v) for v in VOCABULARY]), (i + 1).cast("int")))
    return rows.select("id", tx.detokenised(pieces).alias("text"), F.size(F.filter(pieces, tx.numeric_piece)).cast("long").alias("n_numeric"))


def squash_compare(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    return c.groupBy(tx.squashed(F.col("text")).alias("squashed")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    scripts_of_text, text_direction, grapheme_clusters, normalize_languages, language_choice, locale_longest_prefix, languages_expanded, font_cover_division, font_candidates_fallback, slice_pruning, variant_donors_topk, fnv1a_hash, detokenise, squash_compare,
)}

_EVIDENCE = f"""WITH {_LANG}, {_CAND}, {_DETECTED}, {_BLOCKS},
ev AS (SELECT event_id AS id, {_list(OSD)}[(event_id * 5) % {len(OSD)} + 1] AS osd_script, (event_id * 7 % 30) / 10.0::DOUBLE AS osd_confidence, event_id % 9 AS headline_words, {_list(PROBES)}[(event_id * 3) % {len(PROBES)} + 1] AS probe_text,
  [{', '.join(_list(loc) for loc in LOCALES)}][event_id % {len(LOCALES)} + 1] AS locales FROM events)"""
_MATCH = """tags AS (SELECT id, attempt, key, lower(unnest(locales)) AS tag, generate_subscripts(locales, 1) AS loc FROM tries),
hits AS (SELECT t.id, t.attempt, c.code, row_number() OVER (PARTITION BY t.id, t.attempt ORDER BY t.loc, length(l.tag) DESC, c.ord) AS k
  FROM tags t JOIN cand c ON c.key = t.key JOIN (SELECT code, unnest(locales) AS tag FROM langs) l ON l.code = c.code AND (t.tag = l.tag OR starts_with(t.tag, l.tag || '-'))),
matched AS (SELECT tries.id, tries.attempt, coalesce(h.code, CASE WHEN tries.key <> '*' THEN f.code END) AS "primary" FROM tries LEFT JOIN (SELECT * FROM hits WHERE k = 1) h USING (id, attempt) JOIN cand f ON f.key = tries.key AND f.ord = 0)"""

ORACLES = {
    "scripts_of_text": f"""{_SCRIPTED}, s AS (SELECT id, list_sort(list(DISTINCT script)) AS l FROM scripted GROUP BY id)
      SELECT id, coalesce(array_to_string(l, ','), '') AS scripts, coalesce(list_has_any(l, ['devanagari', 'bengali', 'gurmukhi', 'arabic']), false) AS connected, coalesce(list_has_any(l, ['arabic', 'hebrew']), false) AS rtl FROM samples LEFT JOIN s USING (id)""",
    "text_direction": f"{_SCRIPTED}, f AS (SELECT id, arg_min(script, i) AS s FROM scripted GROUP BY id) SELECT id, CASE WHEN s IN ('arabic', 'hebrew') THEN 'rtl' ELSE 'ltr' END AS direction FROM samples LEFT JOIN f USING (id)",
    "normalize_languages": f"""WITH p AS (SELECT event_id, {_list([*[r[0] for r in dims.LANGUAGES], 'xx', 'auto', 'yy', 'eng', 'hin', 'zz', 'nep'])} AS c FROM events),
      q AS (SELECT event_id, [c[event_id * 3 % 47 + 1], c[event_id * 5 % 47 + 1], c[event_id * 7 % 47 + 1], c[event_id * 11 % 47 + 1]] AS l FROM p),
      k AS (SELECT event_id, l, list_filter(l, lambda x, i: list_contains({_list(r[0] for r in dims.LANGUAGES)}, x) AND list_position(l, x) = i) AS kept FROM q)
      SELECT event_id, CASE WHEN list_contains(l, 'auto') OR len(kept) = 0 THEN 'auto' ELSE array_to_string(kept[1:3], ',') END AS languages FROM k""",
    "language_choice": f"""{_EVIDENCE}, probe AS (SELECT * FROM ev WHERE headline_words >= 5 AND probe_text <> ''),
      ch AS (SELECT id, unicode(unnest(string_split(probe_text, ''))) AS cp, generate_subscripts(string_split(probe_text, ''), 1) AS i FROM probe),
      cnt AS (SELECT id, script, count(*) AS n, min(i) AS first_at FROM ch JOIN blocks ON cp BETWEEN lo AND hi GROUP BY id, script),
      sh AS (SELECT *, n / sum(n) OVER (PARTITION BY id) AS share FROM cnt), hs AS (SELECT * FROM sh WHERE script IN ('devanagari', 'bengali', 'gurmukhi')),
      top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY share DESC, first_at) AS k FROM hs) WHERE k = 1),
      own AS (SELECT id, arg_min(s, loc) AS own FROM (SELECT id, loc, CASE WHEN p IN ('ne', 'hi', 'mr', 'sa') THEN 'devanagari' WHEN p IN ('bn', 'as') THEN 'bengali' WHEN p = 'pa' THEN 'gurmukhi' END AS s
        FROM (SELECT id, split_part(lower(unnest(locales)), '-', 1) AS p, generate_subscripts(locales, 1) AS loc FROM probe)) WHERE s IS NOT NULL GROUP BY id),
      head AS (SELECT top.id, CASE WHEN top.share < 0.6 AND coalesce(o.share, 0) >= 0.3 THEN own.own ELSE top.script END AS key FROM top LEFT JOIN own USING (id) LEFT JOIN hs o ON o.id = top.id AND o.script = own.own),
      tries AS (SELECT id, 1 AS attempt, key, locales FROM head JOIN ev USING (id) UNION ALL SELECT ev.id, 2, det.key, locales FROM ev JOIN det ON det.name = lower(trim(osd_script)) WHERE osd_confidence >= 1 UNION ALL SELECT id, 3, '*', locales FROM ev),
      {_MATCH} SELECT id, CASE WHEN "primary" IS NULL OR "primary" = 'eng' THEN 'eng' ELSE "primary" || ',eng' END AS languages, ['headline', 'script', 'locale'][attempt] AS source
      FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY attempt) AS k FROM matched) WHERE k = 1""",
    "locale_longest_prefix": f"""{_EVIDENCE}, tries AS (SELECT id, 1 AS attempt, ['han', 'devanagari', 'arabic', 'latin', '*'][id % 5 + 1] AS key, locales FROM ev), {_MATCH} SELECT id, "primary" FROM matched""",
    "languages_expanded": f"""WITH {_LANG}, e AS (SELECT event_id AS id, generate_subscripts(c, 1) AS i, unnest(c) AS code FROM
        (SELECT event_id, [{', '.join(f"{_list([*[r[0] for r in dims.LANGUAGES], 'xx'])}[(event_id * {m} % {len(dims.LANGUAGES) + 1})::INT + 1]" for m in (3, 5, 7))}][1:(event_id % 4)::INT] AS c FROM events)),
      s AS (SELECT id, flatten(list(scripts ORDER BY i)) AS s, list(region ORDER BY i) FILTER (region IS NOT NULL) AS r FROM e JOIN langs USING (code) GROUP BY id),
      d AS (SELECT id, list_filter(s, lambda x, k: list_position(s, x) = k) AS s, list_filter(r, lambda x, k: list_position(r, x) = k) AS r FROM s)
      SELECT event_id AS id, coalesce(array_to_string(s, ','), '') AS scripts, coalesce(array_to_string(r, ','), '') AS regions FROM events LEFT JOIN d ON d.id = event_id""",
    "font_cover_division": f"{_COVER} SELECT id, font_id FROM cover",
    "font_candidates_fallback": f"""{_COVER}, own AS (SELECT id, list(DISTINCT script) AS own FROM marks JOIN blocks ON cp BETWEEN lo AND hi GROUP BY id),
      ctx AS (SELECT t.id, t.regions, coalesce(own, []) AS own, list_concat(coalesce(own, []), t.scripts) AS c FROM texts t LEFT JOIN own USING (id)),
      r AS (SELECT cover.id, font_id, CASE WHEN NOT list_has_any(f.scripts, CASE WHEN len(c) = 0 THEN ['latin'] ELSE c END) THEN 2 WHEN NOT (list_has_any(own, ['han', 'kana', 'hangul']) AND len(regions) > 0) OR f.region IS NULL OR list_contains(regions, f.region) THEN 0 ELSE 1 END AS tier
        FROM cover JOIN fonts f ON f.id = font_id JOIN ctx ON ctx.id = cover.id),
      b AS (SELECT *, min(tier) OVER (PARTITION BY id) AS best FROM r)
      SELECT id, font_id FROM b WHERE tier = best UNION ALL SELECT id, 'noto-sans' FROM texts WHERE id NOT IN (SELECT id FROM cover)""",
    "variant_donors_topk": f"""WITH {_FONTS}, l AS (SELECT l_orderkey AS id, l_orderkey % 7 % {len(dims.font_rows())} AS fi, l_linenumber AS rank, l_partkey % {len(dims.font_rows())} AS gi FROM lineitem),
      r AS (SELECT l.id, a.id AS fitted, a.category AS ca, rank, b.id AS font_id, b.category AS cb FROM l JOIN fonts a ON a.ord = fi JOIN fonts b ON b.ord = gi),
      d AS (SELECT id, fitted, font_id, min(rank) AS rank FROM r WHERE font_id <> fitted AND ca = cb GROUP BY ALL),
      top AS (SELECT id, font_id, place FROM (SELECT id, font_id, (row_number() OVER (PARTITION BY id ORDER BY rank, font_id))::INT AS place FROM d) WHERE place <= 4)
      SELECT * FROM top UNION ALL SELECT DISTINCT id, 'roboto', 5 FROM r WHERE fitted = 'arimo' AND NOT EXISTS (SELECT 1 FROM top WHERE top.id = r.id AND top.font_id = 'roboto')""",
    "grapheme_clusters": f"""WITH {_SAMPLES_SQL}, g AS (SELECT id, list_transform(range(1, length_grapheme(text) + 1), lambda i: substring_grapheme(text, i, 1)) AS g FROM samples),
      j AS (SELECT id, list_reduce(list_concat([[]::VARCHAR[]], list_transform(g, lambda c: [c])), lambda a, b: CASE WHEN len(a) > 0 AND regexp_matches(a[-1], '[{tx.VIRAMAS}][{tx.JOINERS}]?$') AND regexp_matches(b[1], '^\\p{{L}}')
        THEN list_append(a[:-2], a[-1] || b[1]) ELSE list_concat(a, b) END) AS c FROM g)
      SELECT id, len(c)::INT AS n, array_to_string(c, '|') AS clusters FROM j""",
    "slice_pruning": f"""WITH {_BLOCKS}, {_FONTS}, {_SLICES}, {_SAMPLES_SQL}, {_POINTS},
      wish AS (SELECT id, text, ['arimo', 'tinos', 'caveat', 'noto-sans-sc', 'mukta'][(id % 5)::INT + 1] AS font_id FROM samples),
      tries(script, for_region, category, place, face_font) AS (VALUES {', '.join(f"({_q(a)}, {_q(b)}, {_q(c)}, {d}, {_q(e)})" for a, b, c, d, e in fonts.fallback_list())}),
      asked AS (SELECT id, font_id, cp FROM wish JOIN marks USING (id)),
      missing AS (SELECT a.id, a.font_id, a.cp, f.category, coalesce(b.script, 'neutral') AS script, CASE WHEN b.script = 'han' THEN f.region END AS for_region
        FROM asked a JOIN need USING (id, cp) JOIN fonts f ON f.id = a.font_id LEFT JOIN blocks b ON a.cp BETWEEN b.lo AND b.hi WHERE NOT EXISTS (SELECT 1 FROM drawn d WHERE d.cp = a.cp AND d.font_id = a.font_id)),
      ranked AS (SELECT m.id, m.font_id, m.cp, t.face_font, t.place FROM missing m JOIN tries t ON m.script = t.script AND m.category = t.category AND m.for_region IS NOT DISTINCT FROM t.for_region WHERE m.font_id <> t.face_font
        UNION ALL SELECT m.id, m.font_id, m.cp, f.id, f.ord + 10 FROM missing m JOIN fonts f ON f.id <> m.font_id),
      best AS (SELECT * FROM (SELECT r.id, r.font_id, r.face_font, d.slice_id, row_number() OVER (PARTITION BY r.id, r.font_id, r.cp ORDER BY place) AS k FROM ranked r JOIN drawn d ON d.cp = r.cp AND d.font_id = r.face_font) WHERE k = 1)
      SELECT a.id, a.font_id, a.font_id AS face_font, slice_id FROM asked a JOIN drawn USING (cp, font_id) UNION SELECT id, font_id, font_id, 'latin' FROM wish UNION SELECT id, font_id, face_font, slice_id FROM best""",
    "fnv1a_hash": """SELECT p_partkey, list_reduce(list_concat([2166136261::BIGINT], list_transform(string_split(p_name, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS h FROM part""",
    "detokenise": f"""WITH i AS (SELECT event_id AS id, list_transform([{', '.join(f'(event_id * {m} + event_id // {m}) % {len(VOCABULARY)}' for m in _PICKS)}][1:(event_id % 6)::INT], lambda k: {_list(VOCABULARY)}[k::INT + 1]) AS p FROM events)
      SELECT id, trim(regexp_replace(replace(array_to_string(list_filter(p, lambda x: NOT regexp_matches(x, '^<.*>$')), ''), '▁', ' '), '\\s+', ' ', 'g')) AS text,
        len(list_filter(p, lambda x: regexp_matches(replace(x, '▁', ''), '^[0-9/\\-.,:]+$')))::BIGINT AS n_numeric FROM i""",
    "squash_compare": "SELECT lower(regexp_replace(text, '\\s', '', 'g')) AS squashed, count(*) AS n FROM conversations GROUP BY 1",
}
