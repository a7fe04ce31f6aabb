"""Queries over pixel grids: kernels on synthetic pages, and grid operators that are relational."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from quireflow.operators import grids as g
from quireflow.sources.words import read


def _pages(spark, sf_dir):
    """All pages of all documents, whole texts."""
    return g.paged(read(spark, sf_dir, "documents"))


def sauvola_ink(spark, sf_dir):
    return g.per_page(_pages(spark, sf_dir), "page_id long, page_no int, n_ink long, otsu int, polarity string", lambda p, k, a: [(p, k, int(g.sauvola(a, 12).sum()), g.otsu_split(g.histogram(a)), g.polarity(a))])


def components(spark, sf_dir):
    def of(page, number, a):
        box = g.component_boxes(g.sauvola(a, 12))
        n = len(box)
        return np.column_stack([np.full(n, page), np.full(n, number), np.arange(1, n + 1), box])

    return g.per_page(_pages(spark, sf_dir), "page_id long, page_no int, label int, x0 int, y0 int, x1 int, y1 int, area int", of)


def rules(spark, sf_dir):
    return g.per_page(_pages(spark, sf_dir), "page_id long, page_no int, n_rule long", lambda p, k, a: [(p, k, int(g.rules(g.sauvola(a, 12), 40).sum()))])


def skew_kernel(spark, sf_dir):
    return g.per_page(_pages(spark, sf_dir), "page_id long, page_no int, angle double, confidence double", lambda p, k, a: [(p, k, *g.skew(g.sauvola(a, 12)))])


def text_erasure(spark, sf_dir):
    def of(page, number, a):
        ink = g.sauvola(a, 12)
        gone = g.dilated(ink, 2)
        clean = g.erased(a, ink, gone=gone)
        return [(page, number, round(g.mean_error(clean, 215 + 20 * np.arange(a.shape[1]) / a.shape[1]), 6), bool(((clean == a) | gone).all()))]

    return g.per_page(_pages(spark, sf_dir), "page_id long, page_no int, error double, untouched boolean", of)


def page_measures(spark, sf_dir):
    def of(page, number, a):
        ink, text, headline = g.inks(a, 12, ((0.3, 14), g.TEXT_INK, g.HEADLINE_INK))
        box, flat = g.component_boxes(text), g.flattened(a)
        headlines = g.headline_words(a, 8, headline, box if headline is text else g.component_boxes(headline))
        return [(page, number, g.text_height(a, box), len(headlines), round(float(flat.mean()), 4), round(g.thickest(ink), 6), round(g.iou(ink, g.sauvola(flat, 12)), 6), round(g.stroke_width(ink), 6))]

    return g.per_page(_pages(spark, sf_dir), "page_id long, page_no int, text_height int, headlines int, paper double, thickest double, iou double, stroke double", of)


def _pixels(spark, sf_dir):
    """64 x 48 pixels for each nation, by formula."""
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("page"))
    return n.select("page", F.explode(F.sequence(F.lit(0), F.lit(47))).alias("y")).select("page", "y", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("x")).select("page", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), ((F.col("x") * F.col("x") * 7 + F.col("y") * 13 * (F.col("page") + 1)) % 256).alias("v"))


_PIXELS = "WITH px AS (SELECT n_nationkey::BIGINT AS page, x, y, (x * x * 7 + y * 13 * (n_nationkey + 1)) % 256 AS v FROM nation, range(64) a(x), range(48) b(y))"


def grid_prefix_sums(spark, sf_dir):
    rows = _pixels(spark, sf_dir).withColumn("row_sum", F.sum("v").over(Window.partitionBy("page", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.select("page", "x", "y", F.sum("row_sum").over(Window.partitionBy("page", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("area"))


def grid_runs(spark, sf_dir):
    w = Window.partitionBy("page", "y").orderBy("x")
    ink = _pixels(spark, sf_dir).where("v < 150").withColumn("starts", (F.coalesce(F.col("x") - F.lag("x").over(w), F.lit(99)) > 3).cast("int"))
    islands = ink.withColumn("run", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return islands.groupBy("page", "y", "run").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.count("*").alias("n")).where("x1 - x0 + 1 >= 8").select("page", "y", "x0", "x1", "n")


def grid_sliding_max(spark, sf_dir):
    near = lambda part, order: Window.partitionBy("page", part).orderBy(order).rowsBetween(-6, 6)
    rows = _pixels(spark, sf_dir).withColumn("m", F.max("v").over(near("y", "x")))
    return rows.select("page", "x", "y", F.max("m").over(near("x", "y")).alias("m"))


def skew_projection(spark, sf_dir):
    """The angle of the sharpest projection profile, as an aggregate: pixels x angles, bins, sums of squares, the first greatest."""
    ink = _pixels(spark, sf_dir).where("v < 60")
    angles = F.explode(F.sequence(F.lit(-12), F.lit(12))).alias("step")
    a = F.radians(F.col("step") / 2.0)
    bins = ink.select("page", "x", "y", angles).withColumn("bin", F.floor(F.col("y") * F.cos(a) - F.col("x") * F.sin(a) + 0.5)).groupBy("page", "step", "bin").agg(F.count("*").alias("c"))
    scored = bins.groupBy("page", "step").agg(F.sum(F.col("c") * F.col("c")).alias("score"))
    return scored.groupBy("page").agg(F.max_by("step", F.struct("score", -F.col("step"))).cast("long").alias("step"), F.max("score").alias("score"))


# ------------------------------------------------------------------ kernels on the formula's pixels, which SQL can follow


def _formula_pages(spark, sf_dir, schema, of):
    """of(page, pixels) -> rows, for the 64 x 48 pixels of each nation."""
    rows = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("page"))
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        y, x = np.mgrid[0:48, 0:64]
        for b in batches:
            out = [r for page in b.column(0).to_pylist() for r in of(page, ((x * x * 7 + y * 13 * (page + 1)) % 256).astype(np.float32))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(kind)], kind.names)

    return rows.mapInArrow(run, schema)


def kernel_threshold(spark, sf_dir):
    """Ink by local mean and deviation, the histogram's split, the polarity and the variance of windows."""

    def of(page, a):
        _, var = g.window_stats(a, 6)
        return [(page, int(g.sauvola(a, 6, 0.2, 128, 20).sum()), g.otsu_split(g.histogram(a)), g.polarity(a), round(float(var.mean()), 4))]

    return _formula_pages(spark, sf_dir, "page long, n_ink long, otsu long, polarity string, variance double", of)


def kernel_morphology(spark, sf_dir):
    """Dilation and distances to the nearest pixel outside a mask."""

    def of(page, a):
        far = g.distance(a >= 10).astype(np.float64)
        return [(page, int(g.dilated(a < 10, 2).sum()), round(float((far**2).sum()), 2), round(float(far.max()), 4))]

    return _formula_pages(spark, sf_dir, "page long, dilated long, squares double, farthest double", of)


def kernel_components(spark, sf_dir):
    def of(page, a):
        _, box = g.components(a < 24)
        return [(page, k + 1, *map(int, b)) for k, b in enumerate(box)]

    return _formula_pages(spark, sf_dir, "page long, label long, x0 long, y0 long, x1 long, y1 long, area long", of)


def kernel_rules(spark, sf_dir):
    """Ruling lines of both directions, and the longest run of a row."""

    def of(page, a):
        mask = a < 120
        return [(page, int(g.rules(mask, 12, 2, 10).sum()), int(g.longest_runs(mask).max()))]

    return _formula_pages(spark, sf_dir, "page long, n_rule long, longest long", of)


def kernel_errors(spark, sf_dir):
    """Luminance, overlap of masks, mean error, weighted fit, structure difference and the deviation of the grain of two pages."""

    def of(page, a):
        b = np.roll(a, 3, axis=1)
        lum = g.luminance(np.stack([a, b, 255 - a], axis=-1)).astype(np.float64)
        p, q = a < 90, b < 90
        return [(page, round(float(lum.sum()), 0), round(g.iou(p, q), 6), round(g.mean_error(a, b) * a.size, 0), round(g.weighted_fit(a.astype(np.float64) / 256, b.astype(np.float64)), 6), round(g.far_share(a < 20, b < 20, 2.0), 6))]

    return _formula_pages(spark, sf_dir, "page long, luminance double, overlap double, error double, fit double, far double", of)


def kernel_filters(spark, sf_dir):
    """Blur, shrinking by blocks, and the deviation of what the blur leaves."""

    def of(page, a):
        blur = g.gaussian(a, 1.0).astype(np.float64)
        _, deviation = g.noise(a, a > 30, 1.0)
        small = g.downscaled(a, 4).astype(np.float64)
        return [(page, round(float(blur.sum()) / 100, 0), round(float((blur * blur).mean()), 0), round(float(small.max()), 4), round(float(small.sum()), 2), round(deviation, 2))]

    return _formula_pages(spark, sf_dir, "page long, blurred double, energy double, brightest double, total double, deviation double", of)


def kernel_draws(spark, sf_dir):
    def of(page, a):
        rng = g.Mulberry(page * 7919 + 1)
        return [(page, k, round(rng.draw(), 9)) for k in range(8)]

    return _formula_pages(spark, sf_dir, "page long, turn long, draw double", of)


QUERIES = {f.__name__: f for f in (sauvola_ink, components, rules, skew_kernel, text_erasure, page_measures, grid_prefix_sums, grid_runs, grid_sliding_max, skew_projection, kernel_threshold, kernel_morphology, kernel_components, kernel_rules, kernel_errors, kernel_filters, kernel_draws)}

_WINDOWED = f"""{_PIXELS}, r1 AS (SELECT page, x, y, v, sum(v) OVER w AS s, sum(v * v) OVER w AS q, count(*) OVER w AS n FROM px WINDOW w AS (PARTITION BY page, y ORDER BY x ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)),
  r2 AS (SELECT page, v, sum(s) OVER w / (sum(n) OVER w)::DOUBLE AS mean, sum(q) OVER w / (sum(n) OVER w)::DOUBLE AS sq FROM r1 WINDOW w AS (PARTITION BY page, x ORDER BY y ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)),
  st AS (SELECT page, v, mean, greatest(0.0::DOUBLE, sq - mean * mean) AS var FROM r2)"""
_TWO = f"""{_PIXELS}, two AS (SELECT a.page, a.x, a.y, a.v AS v, b.v AS u FROM px a JOIN px b ON a.page = b.page AND a.y = b.y AND b.x = (a.x + 61) % 64)"""

ORACLES = {
    "kernel_threshold": f"""{_WINDOWED}, h AS (SELECT page, v AS bin, count(*) AS c FROM px GROUP BY ALL),
      cum AS (SELECT page, bin, sum(c) OVER o AS nb, sum(c * bin) OVER o AS sb, sum(c) OVER p AS n, sum(c * bin) OVER p AS s FROM h WINDOW p AS (PARTITION BY page), o AS (PARTITION BY page ORDER BY bin ROWS UNBOUNDED PRECEDING)),
      cut AS (SELECT page, bin AS t, sb / nb::DOUBLE AS dark, (s - sb) / (n - nb)::DOUBLE AS light, nb, n - nb AS nf FROM cum WHERE nb < n QUALIFY row_number() OVER (PARTITION BY page ORDER BY nb::DOUBLE * (n - nb) * power(sb / nb::DOUBLE - (s - sb) / (n - nb)::DOUBLE, 2) DESC, bin) = 1),
      ink AS (SELECT page, count_if(v < mean * (1 + 0.2::DOUBLE * (sqrt(var) / 128 - 1)) AND mean - v > 20)::BIGINT AS n_ink, round(avg(var), 4) AS variance FROM st GROUP BY page)
      SELECT page, n_ink, t AS otsu, CASE WHEN light - dark >= 30 AND nf < nb THEN 'light' ELSE 'dark' END AS polarity, variance FROM ink JOIN cut USING (page)""",
    "kernel_morphology": f"""{_PIXELS}, off AS (SELECT page, x, y FROM px WHERE v < 10),
      near AS (SELECT a.page, a.x, a.y, min((a.x - o.x) * (a.x - o.x) + (a.y - o.y) * (a.y - o.y)) AS d FROM px a JOIN off o ON a.page = o.page GROUP BY ALL)
      SELECT page, count_if(d <= 4)::BIGINT AS dilated, round(sum(d)::DOUBLE, 2) AS squares, round(sqrt(max(d)), 4) AS farthest FROM near GROUP BY page""",
    "kernel_components": f"""WITH RECURSIVE px AS ({_PIXELS.split("px AS (", 1)[1][:-1]}), ink AS (SELECT page, x, y FROM px WHERE v < 24),
      reach AS (SELECT page, x, y, x AS tx, y AS ty FROM ink UNION SELECT r.page, r.x, r.y, i.x, i.y FROM reach r JOIN ink i ON i.page = r.page AND i.x BETWEEN r.tx - 1 AND r.tx + 1 AND i.y BETWEEN r.ty - 1 AND r.ty + 1),
      own AS (SELECT page, x, y, min(ty * 64 + tx) AS first_at FROM reach GROUP BY ALL), c AS (SELECT page, first_at, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, count(*) AS area FROM own GROUP BY ALL)
      SELECT page, row_number() OVER (PARTITION BY page ORDER BY first_at) AS label, x0, y0, x1, y1, area FROM c""",
    "kernel_rules": f"""{_PIXELS}, m AS (SELECT page, x, y FROM px WHERE v < 120),
      a AS (SELECT *, sum(fresh) OVER (PARTITION BY page, y ORDER BY x ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY page, y ORDER BY x) <= 3 THEN 0 ELSE 1 END AS fresh FROM m)),
      b AS (SELECT *, sum(fresh) OVER (PARTITION BY page, x ORDER BY y ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY page, x ORDER BY y) <= 3 THEN 0 ELSE 1 END AS fresh FROM m)),
      k AS (SELECT page, x, y FROM (SELECT *, max(x) OVER w - min(x) OVER w + 1 AS n FROM a WINDOW w AS (PARTITION BY page, y, g)) WHERE n >= 12 UNION SELECT page, x, y FROM (SELECT *, max(y) OVER w - min(y) OVER w + 1 AS n FROM b WINDOW w AS (PARTITION BY page, x, g)) WHERE n >= 10),
      l AS (SELECT page, max(n) AS longest FROM (SELECT page, y, x - k AS i, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY page, y ORDER BY x) AS k FROM m) GROUP BY ALL) GROUP BY page)
      SELECT l.page, (SELECT count(*) FROM k WHERE k.page = l.page) AS n_rule, longest FROM l""",
    "kernel_errors": f"""{_TWO}, far AS (SELECT a.page, a.side, a.x, a.y, min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM (SELECT page, x, y, 1 AS side FROM two WHERE v < 20 UNION ALL SELECT page, x, y, 2 FROM two WHERE u < 20) a
        JOIN (SELECT page, x, y, 2 AS side FROM two WHERE v < 20 UNION ALL SELECT page, x, y, 1 FROM two WHERE u < 20) b ON a.page = b.page AND a.side = b.side GROUP BY ALL),
      f AS (SELECT page, max(s) AS far FROM (SELECT page, side, avg(CASE WHEN d > 4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS s FROM far GROUP BY ALL) GROUP BY page)
      SELECT page, round(sum(v * 0.2126::DOUBLE + u * 0.7152::DOUBLE + (255 - v) * 0.0722::DOUBLE), 0) AS luminance, round(count_if(v < 90 AND u < 90)::DOUBLE / count_if(v < 90 OR u < 90), 6) AS overlap, sum(abs(v - u))::DOUBLE AS error,
        round(sum(v / 256.0::DOUBLE * u) / sum(v / 256.0::DOUBLE * v / 256.0::DOUBLE), 6) AS fit, round(any_value(far), 6) AS far FROM two JOIN f USING (page) GROUP BY page""",
    "kernel_filters": f"""{_PIXELS}, k AS (SELECT d, exp(-d * d / 2.0::DOUBLE) / (SELECT sum(exp(-e * e / 2.0::DOUBLE)) FROM range(-3, 4) r(e)) AS w FROM range(-3, 4) t(d)),
      a AS (SELECT p.page, p.x, p.y, sum(k.w * q.v) AS v FROM px p, k JOIN px q ON q.page = p.page AND q.y = p.y AND q.x = greatest(0, least(63, p.x + k.d)) GROUP BY ALL),
      b AS (SELECT p.page, p.x, p.y, sum(k.w * q.v) AS v FROM a p, k JOIN a q ON q.page = p.page AND q.x = p.x AND q.y = greatest(0, least(47, p.y + k.d)) GROUP BY ALL),
      s AS (SELECT page, max(v) AS brightest, sum(v) AS total FROM (SELECT page, x // 4 AS i, y // 4 AS j, avg(v) AS v FROM px GROUP BY ALL) GROUP BY page)
      SELECT b.page, round(sum(b.v) / 100, 0) AS blurred, round(avg(b.v * b.v), 0) AS energy, round(any_value(brightest), 4) AS brightest, round(any_value(total), 2) AS total, round(stddev_pop(p.v - b.v) FILTER (p.v > 30), 2) AS deviation
      FROM b JOIN px p USING (page, x, y) JOIN s ON s.page = b.page GROUP BY b.page""",
    "kernel_draws": """WITH s AS (SELECT n_nationkey::BIGINT AS page, k AS turn, ((n_nationkey * 7919 + 1 + (k + 1) * 1831565813::HUGEINT) & 4294967295)::HUGEINT AS t FROM nation, range(8) r(k)),
      a AS (SELECT page, turn, (xor(t, t >> 15) * (t | 1)) & 4294967295 AS t FROM s), b AS (SELECT page, turn, xor(t, (t + ((xor(t, t >> 7) * (t | 61)) & 4294967295)) & 4294967295) AS t FROM a)
      SELECT page, turn, round((xor(t, t >> 14) & 4294967295)::DOUBLE / 4294967296, 9) AS draw FROM b""",
    "grid_prefix_sums": f"{_PIXELS}, r AS (SELECT *, sum(v) OVER (PARTITION BY page, y ORDER BY x ROWS UNBOUNDED PRECEDING) AS rs FROM px) SELECT page, x, y, (sum(rs) OVER (PARTITION BY page, x ORDER BY y ROWS UNBOUNDED PRECEDING))::BIGINT AS area FROM r",
    "grid_runs": f"""{_PIXELS}, s AS (SELECT *, CASE WHEN coalesce(x - lag(x) OVER (PARTITION BY page, y ORDER BY x), 99) > 3 THEN 1 ELSE 0 END AS st FROM px WHERE v < 150),
      i AS (SELECT *, sum(st) OVER (PARTITION BY page, y ORDER BY x ROWS UNBOUNDED PRECEDING) AS run FROM s)
      SELECT page, y, min(x) AS x0, max(x) AS x1, count(*) AS n FROM i GROUP BY page, y, run HAVING max(x) - min(x) + 1 >= 8""",
    "grid_sliding_max": f"{_PIXELS}, r AS (SELECT *, max(v) OVER (PARTITION BY page, y ORDER BY x ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS m0 FROM px) SELECT page, x, y, max(m0) OVER (PARTITION BY page, x ORDER BY y ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS m FROM r",
    "skew_projection": f"""{_PIXELS}, b AS (SELECT page, k AS step, floor(y * cos(radians(k / 2.0::DOUBLE)) - x * sin(radians(k / 2.0::DOUBLE)) + 0.5) AS bin, count(*) AS c FROM px, range(-12, 13) t(k) WHERE v < 60 GROUP BY ALL),
      s AS (SELECT page, step, sum(c * c)::BIGINT AS score FROM b GROUP BY ALL)
      SELECT page, step, score FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, step) AS k FROM s) WHERE k = 1""",
}
