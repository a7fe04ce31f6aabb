"""Candidate fonts of a text: coverage by relational division, script preference with fallbacks, slices to load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quireflow.functions import text as tx
from quireflow.sources import dims


def needs_glyph(cp: Column) -> Column:
    """Whether the absence of a code point would be seen: not controls, spaces, joiners and selectors."""
    return ~((cp <= 0x20) | (cp == 0xA0) | cp.between(0x200B, 0x200F) | (cp == 0xFEFF) | cp.between(0xFE00, 0xFE0F))


def code_points(texts: DataFrame) -> DataFrame:
    """(id, cp, at): distinct code points of each text with their first place."""
    ch = texts.select("id", F.posexplode(tx.chars(F.col("text"))).alias("at", "ch")).groupBy("id", "ch").agg(F.min("at").alias("at"))
    return ch.select("id", "at", "ch", F.ascii("ch").alias("cp"))


def drawn_by(points: DataFrame) -> DataFrame:
    """(cp, font_id, slice_id): which slices draw each code point.

    The range join runs on distinct code points (some thousands for any corpus) against a fixed table, not on texts.
    """
    slices = F.broadcast(dims.font_slices(points.sparkSession))
    return points.select("cp").distinct().join(slices, F.col("cp").between(F.col("lo"), F.col("hi"))).select("cp", "font_id", "slice_id").distinct()


def covering(texts: DataFrame) -> DataFrame:
    """(id, font_id): fonts that draw every visible code point of a text. Texts without one are covered by all fonts."""
    points = code_points(texts).where(needs_glyph(F.col("cp")))
    need = points.groupBy("id").agg(F.count("*").alias("need"))
    have = points.join(drawn_by(points).select("cp", "font_id").distinct(), "cp").groupBy("id", "font_id").agg(F.count("*").alias("have"))
    full = have.join(need, "id").where("have = need").select("id", "font_id")
    blank = texts.select("id").join(need, "id", "left_anti").crossJoin(F.broadcast(dims.fonts(texts.sparkSession).select(F.col("id").alias("font_id"))))
    return full.unionByName(blank)


def candidates(texts: DataFrame) -> DataFrame:
    """(id, font_id, ord) for texts (id, text, scripts, regions): covering fonts of the text's or context's scripts.

    For Han, kana and Hangul the regions' fonts come before others if there are any. Without a font of the scripts all
    covering ones stand, without a covering one a default.
    """
    spark = texts.sparkSession
    font = F.broadcast(dims.fonts(spark).withColumnRenamed("id", "font_id").withColumnRenamed("scripts", "font_scripts").withColumnRenamed("region", "font_region"))
    own = texts.withColumn("own", tx.scripts_of(F.col("text")))
    considered = F.array_distinct(F.concat("own", "scripts"))
    own = own.withColumn("consider", F.when(F.size(considered) == 0, F.array(F.lit("latin"))).otherwise(considered)).withColumn("regional", F.arrays_overlap("own", F.array(F.lit("han"), F.lit("kana"), F.lit("hangul"))) & (F.size("regions") > 0))
    rows = covering(texts).join(font, "font_id").join(own.select("id", "consider", "regional", "regions"), "id")
    liked = F.arrays_overlap("font_scripts", "consider")
    in_region = F.col("font_region").isNull() | F.array_contains("regions", F.col("font_region"))
    # 0: preferred and of the region (or no region asked), 1: preferred, 2: only covering
    tier = F.when(liked & (~F.col("regional") | in_region), 0).when(liked, 1).otherwise(2)
    ranked = rows.withColumn("tier", tier).withColumn("best", F.min("tier").over(Window.partitionBy("id")))
    found = ranked.where("tier = best").select("id", "font_id", "ord")
    none = texts.select("id").join(found.select("id").distinct(), "id", "left_anti").select("id", F.lit("noto-sans").alias("font_id"))
    return found.unionByName(none.join(font.select("font_id", "ord"), "font_id").select("id", "font_id", "ord"))


def fallback_list() -> list[tuple[str, str | None, str, int, str]]:
    """(script, region, category, place, font) of the fonts to try for a script that a family lacks, in order."""
    order = {"serif": (1, 0), "handwriting": (2, 0)}
    rows = []
    for category in ("sans", "serif", "mono", "condensed", "handwriting"):
        for script, ids in dims.FALLBACKS.items():
            rows += [(script, None, category, k, ids[i]) for k, i in enumerate(order.get(category, (0, 1)))]
        for region, ids in dims.REGION_FALLBACKS.items():
            rows += [("han", region, category, k, ids[i]) for k, i in enumerate(order.get(category, (0, 1)))]
    return rows


def fallback_rows(spark) -> DataFrame:
    return spark.createDataFrame(fallback_list(), "script string, for_region string, category string, place int, font_id string")


def stacks(wanted: DataFrame) -> DataFrame:
    """(id, font_id, face_font, slice_id) of the slices that draw a text in a font, own ones and fallbacks.

    wanted: (id, text, font_id). The slice with the space is always there.
    """
    spark = wanted.sparkSession
    font = F.broadcast(dims.fonts(spark).select(F.col("id").alias("font_id"), "category", F.col("region")))
    points = code_points(wanted.select("id", "text").distinct())
    drawn = drawn_by(points)
    asked = wanted.select("id", "font_id").join(points, "id")
    own = asked.join(drawn, ["cp", "font_id"]).select("id", "font_id", F.col("font_id").alias("face_font"), "slice_id")
    space = wanted.select("id", "font_id", F.col("font_id").alias("face_font"), F.lit("latin").alias("slice_id"))
    missing = asked.join(drawn.select("cp", "font_id").distinct(), ["cp", "font_id"], "left_anti").where(needs_glyph(F.col("cp"))).join(font, "font_id")
    missing = missing.withColumn("script", F.coalesce(tx.script_of(F.col("ch")), F.lit("neutral"))).withColumn("for_region", F.when(F.col("script") == "han", F.col("region")))
    tries = F.broadcast(fallback_rows(spark).withColumnRenamed("font_id", "face_font"))
    m, t = missing.alias("m"), tries.alias("t")
    listed = m.join(t, (F.col("m.script") == F.col("t.script")) & (F.col("m.category") == F.col("t.category")) & F.col("m.for_region").eqNullSafe(F.col("t.for_region"))).where("m.font_id <> t.face_font").select("m.id", "m.font_id", "m.cp", "t.face_font", "t.place")
    every = missing.select("id", "font_id", "cp").join(F.broadcast(dims.fonts(spark).select(F.col("id").alias("face_font"), (F.col("ord") + 10).alias("place"))), F.col("font_id") != F.col("face_font"))
    face = drawn.select("cp", F.col("font_id").alias("face_font"), "slice_id")
    best = listed.unionByName(every).join(face, ["cp", "face_font"]).groupBy("id", "font_id", "cp").agg(F.min_by(F.struct("face_font", "slice_id"), "place").alias("b"))
    return own.unionByName(space).unionByName(best.select("id", "font_id", "b.face_font", "b.slice_id")).distinct()


def variant_donors(ranked: DataFrame, limit: int = 4) -> DataFrame:
    """(id, font_id, place): the first ``limit`` distinct fonts of the fitted one's category, then its default donors.

    ranked: (id, fitted, rank, font_id), best first.
    """
    spark = ranked.sparkSession
    cat = F.broadcast(dims.fonts(spark).select(F.col("id").alias("font_id"), "category"))
    fit = F.broadcast(dims.fonts(spark).select(F.col("id").alias("fitted"), F.col("category").alias("fitted_category")))
    first = ranked.where("font_id <> fitted").groupBy("id", "fitted", "font_id").agg(F.min("rank").alias("rank")).join(cat, "font_id").join(fit, "fitted").where("category = fitted_category")
    top = first.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("rank", "font_id"))).where(F.col("place") <= limit).select("id", "font_id", "place")
    defaults = spark.createDataFrame([(f, d) for (f, _), d in dims.GLYPH_DEFAULTS.items()], "fitted string, font_id string")
    more = ranked.select("id", "fitted").distinct().join(F.broadcast(defaults), "fitted").select("id", "font_id").join(top.select("id", "font_id"), ["id", "font_id"], "left_anti")
    return top.unionByName(more.select("id", "font_id", F.lit(limit + 1).alias("place")))


def nearest_weight(weights: Column, wanted: Column) -> Column:
    """The shipped weight nearest to the wanted one, the first on ties."""
    return F.aggregate(F.slice(weights, F.lit(2), F.size(weights)), F.get(weights, F.lit(0)), lambda best, w: F.when(F.abs(w - wanted) < F.abs(best - wanted), w).otherwise(best))


def parsed_range(part: Column) -> Column:
    """struct(lo, hi) of a hexadecimal range ``a-b`` or ``a``."""
    ends = F.split(part, "-")
    return F.struct(F.conv(F.get(ends, F.lit(0)), 16, 10).cast("int").alias("lo"), F.conv(F.coalesce(F.get(ends, F.lit(1)), F.get(ends, F.lit(0))), 16, 10).cast("int").alias("hi"))
