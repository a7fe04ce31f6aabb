"""Handwritten lines from a page's ink: classes of components, their grouping into lines, and what tells a line from print."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quireflow.functions import stats, text as tx
from quireflow.functions.geometry import overlap_area
from quireflow.operators import spatial

#: Confidence from which a run is print, and the lines of a page that are read at most (fixed values).
SUSPECT_BELOW, LINES_PER_PAGE = 70, 40


def confident(elements: DataFrame) -> DataFrame:
    """Print that was read with confidence; single letters don't count."""
    return elements.where((F.col("confidence") >= SUSPECT_BELOW) & (F.length(tx.alnum(F.col("text"))) >= 2))


def glyph_height(components: DataFrame) -> DataFrame:
    """(doc_id, h0): upper median height of glyph-like components (30 px or more, not solid), 20 without any."""
    box = F.greatest(F.lit(1), F.col("width") * F.col("height"))
    like = (F.col("area") >= 30) & (F.col("area") / box < 0.6)
    h = stats.upper_median(F.when(like, F.col("height")))
    return components.groupBy("doc_id").agg(F.when(h > 0, h).otherwise(20).alias("h0"))


def component_classes(components: DataFrame, elements: DataFrame, page_width: int) -> DataFrame:
    """components (doc_id, label, x, y, width, height, area, top_run) with why: the first reason that one is no pen stroke, '' if none.

    Dots of leader lines, blobs, wrong sizes, what confident print covers by half or more, and words under a headline.
    """
    cw, ch, h0 = F.col("width"), F.col("height"), F.col("h0")
    fill = F.col("area") / F.greatest(F.lit(1), cw * ch)
    rows = components.join(glyph_height(components), "doc_id")
    covered = spatial.pairs(components, confident(elements), lambda a, b: overlap_area(a, b) * 2 >= a.width * a.height).select("doc_id", F.col("a.label").alias("label")).distinct().withColumn("covered", F.lit(True))
    dot = (cw <= ch * 1.6) & (fill >= 0.62) & (ch <= h0 * 0.6)
    blob = ((fill >= 0.72) & (cw * ch >= h0 * h0 * 2.25)) | ((fill >= 0.5) & (cw * ch >= h0 * h0 * 9))
    size = (F.col("area") < 20) | (ch < h0 * 0.3) | (ch > h0 * 5) | (cw > page_width * 0.4) | (fill < 0.08)
    headline = (cw >= ch * 1.5) & (F.col("top_run") >= cw * 0.85)
    why = F.when(dot, "dot").when(blob, "blob").when(size, "size").when(F.coalesce("covered", F.lit(False)), "confident").when(headline, "headline").otherwise("")
    return rows.join(covered, ["doc_id", "label"], "left").withColumn("why", why).drop("covered")


def line_reason(width: Column, height: Column, background: Column, paper: Column, tall_ink: Column, ink: Column, covered: Column, top_run: Column, stroke: Column) -> Column:
    """Why a line isn't read as handwriting, '' if it is; the first reason counts."""
    return (
        F.when(width < height * 1.2, "short").when(background < paper * 0.72, "background").when(tall_ink < ink * 0.6, "speckle").when(covered >= width * height * 0.35, "print")
        .when(top_run >= width * 0.45, "headline").when(stroke > height * 0.2, "stroke").otherwise("")
    )


def crop(x: Column, y: Column, width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    """struct(x, y, width, height): a line with margins of .3 and .15 of its height, within the page."""
    x0, y0 = F.greatest(F.lit(0.0), x - height * 0.3), F.greatest(F.lit(0.0), y - height * 0.15)
    return F.struct(x0.alias("x"), y0.alias("y"), (F.least(page_width, x + width + height * 0.3) - x0).alias("width"), (F.least(page_height, y + height * 1.15) - y0).alias("height"))


def first_lines(lines: DataFrame, order: list[str], limit: int = LINES_PER_PAGE) -> DataFrame:
    """The lines of a page that are read: the first ones."""
    return lines.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).where(F.col("turn") <= limit)


_LINE = "array<struct<x0:double,y0:double,x1:double,y1:double,h:double,n:int,area:double>>"


def grouped_lines(components: DataFrame, keys: list[str], rules: DataFrame | None = None) -> DataFrame:
    """(keys, line, x0, y0, x1, y1, h, n, area): components from left to right, each joined to the line that it overlaps most.

    A line takes a component that shares .4 of the lesser height with it, lies at most 2.5 of the greater height behind
    its end and not a whole one before it, unless a rule stands between: rules (keys, x, y0, y1) are vertical strokes, and
    one parts what it crosses by .6 of the shared height, 3 px at least. A line's height follows its components slowly.
    What a component meets depends on those before it, so a group's components are one ordered fold.
    """
    c = F.struct(*[F.col(n).cast("double").alias(n) for n in ("x0", "y0", "x1", "y1", "area")])
    rows = components.groupBy(*keys).agg(F.sort_array(F.collect_list(c)).alias("cs"))
    if rules is None:
        rows = rows.withColumn("rs", F.array().cast("array<struct<x:double,y0:double,y1:double>>"))
    else:
        own = rules.groupBy(*keys).agg(F.collect_list(F.struct(*[F.col(n).cast("double").alias(n) for n in ("x", "y0", "y1")])).alias("rs"))
        rows = rows.join(own, keys, "left").withColumn("rs", F.coalesce("rs", F.array().cast("array<struct<x:double,y0:double,y1:double>>")))

    def step(lines: Column, b: Column) -> Column:
        ch = b["y1"] - b["y0"]

        def shared(line: Column) -> Column:
            top, bottom = F.greatest(line["y0"], b["y0"]), F.least(line["y1"], b["y1"])
            gap, most = b["x0"] - line["x1"], F.greatest(line["h"], ch)
            parted = F.exists("rs", lambda r: (r["x"] >= F.least(line["x1"], b["x0"])) & (r["x"] < F.greatest(line["x1"], b["x0"])) & (F.least(r["y1"], bottom) - F.greatest(r["y0"], top) >= F.greatest(F.lit(3.0), (bottom - top) * 0.6)))
            meets = (bottom - top >= F.least(line["h"], ch) * 0.4) & (gap <= most * 2.5) & (gap >= -most) & (bottom > top) & ~parted
            return F.when(meets, bottom - top).otherwise(0.0)

        def placed(overlaps: Column) -> Column:
            best = F.array_max(overlaps)
            at = F.when(best > 0, F.array_position(overlaps, best)).otherwise(0)
            new = F.struct(b["x0"].alias("x0"), b["y0"].alias("y0"), b["x1"].alias("x1"), b["y1"].alias("y1"), ch.alias("h"), F.lit(1).alias("n"), b["area"].alias("area"))

            def joined(line: Column) -> Column:
                return F.struct(
                    F.least(line["x0"], b["x0"]).alias("x0"), F.least(line["y0"], b["y0"]).alias("y0"), F.greatest(line["x1"], b["x1"]).alias("x1"), F.greatest(line["y1"], b["y1"]).alias("y1"),
                    F.greatest(line["h"] * 0.8 + ch * 0.2, F.least(line["h"], ch)).alias("h"), (line["n"] + 1).alias("n"), (line["area"] + b["area"]).alias("area"),
                )

            return F.when(at > 0, F.transform(lines, lambda line, k: F.when(k + 1 == at, joined(line)).otherwise(line))).otherwise(F.concat(lines, F.array(new)))

        return F.transform(F.array(F.transform(lines, shared)), placed)[0]

    found = F.aggregate("cs", F.array().cast(_LINE), step)
    return rows.select(*keys, F.posexplode(found).alias("line", "l")).select(*keys, "line", "l.*")
