"""Recovery of doubtful and missed words: credibility, regions to read again, and the merge of second readings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

REREAD_BELOW, MAX_REGIONS = 60, 60


def _letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}]", ""))


def credible(text: Column, confidence: Column, least: int) -> Column:
    """Mostly letters, digits and marks; short words need ``least`` of them and a confidence of 85."""
    n = _letters(text)
    return (n > 0) & (n * 10 >= F.length(text) * 6) & ((n >= 3) | ((n >= least) & (confidence >= 85)))


def reread_candidates(words: DataFrame, text_height: float) -> DataFrame:
    """Doubtful words of plausible size, least confident first, at most MAX_REGIONS a page."""
    h = max(6.0, text_height or 12.0)
    some = words.where((F.col("confidence") < REREAD_BELOW) & F.col("text").rlike(r"[\p{L}\p{M}\p{N}]") & (F.col("height") >= 0.4 * h) & (F.col("height") <= 3 * h))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("confidence", "line_no", "word_no"))
    return some.withColumn("rank", rank).where(F.col("rank") <= MAX_REGIONS)


def merged(words: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """words with the second reading of a word where it is credible, 50 at least and over 15 better."""
    new = second.select(*keys, F.col("text").alias("new_text"), F.col("confidence").alias("new_confidence"))
    better = F.col("new_confidence").isNotNull() & (F.col("new_confidence") >= 50) & (F.col("new_confidence") > F.col("confidence") + 15) & credible(F.col("new_text"), F.col("new_confidence"), 1)
    both = words.join(new, keys, "left").withColumn("replaced", F.coalesce(better, F.lit(False)))
    return both.withColumn("text", F.when(F.col("replaced"), F.col("new_text")).otherwise(F.col("text"))).withColumn("confidence", F.when(F.col("replaced"), F.col("new_confidence")).otherwise(F.col("confidence"))).drop("new_text", "new_confidence")


def to_page(v: Column, origin: Column, border: Column, scale: Column) -> Column:
    """A crop coordinate on the page."""
    return origin + (v - border) / scale


# ------------------------------------------------------------------ exact merge of a page's crops

MERGED = "doc_id long, ord int, text string, x double, y double, width double, height double, confidence double, added boolean"


def merge_page(words: list[dict], crops: list[dict], results: list[list[dict] | None]) -> list[dict]:
    """Words of a page after its crops have been merged in order; later crops see what earlier ones added.

    crops: kind, x, y, width, height, word_indices, origin_x, origin_y, scale, border. results: words in crop
    coordinates, None for a crop that failed.
    """
    import regex

    real = regex.compile(r"[\p{L}\p{M}\p{N}]")

    def is_credible(w: dict, least: int) -> bool:
        n = len(real.findall(w["text"]))
        return n > 0 and n / len(w["text"]) >= 0.6 and (n >= 3 or (n >= least and w["confidence"] >= 85))

    def touch(a: dict, b: dict) -> bool:
        return a["x"] < b["x"] + b["width"] and b["x"] < a["x"] + a["width"] and a["y"] < b["y"] + b["height"] and b["y"] < a["y"] + a["height"]

    gone: set[int] = set()
    extra: list[dict] = []
    for crop, found in zip(crops, results, strict=True):
        if found is None:
            continue
        on_page = []
        for w in found:
            if real.search(w["text"]):
                s = crop["scale"]
                on_page.append(w | {"x": crop["origin_x"] + (w["x"] - crop["border"]) / s, "y": crop["origin_y"] + (w["y"] - crop["border"]) / s, "width": w["width"] / s, "height": w["height"] / s})
        if crop["kind"] == "reread":
            grow = 0.3 * crop["height"]
            inside = [w for w in on_page if crop["x"] - grow <= w["x"] + w["width"] / 2 <= crop["x"] + crop["width"] + grow and crop["y"] - grow <= w["y"] + w["height"] / 2 <= crop["y"] + crop["height"] + grow and is_credible(w, 1)]
            if inside:
                new = sum(w["confidence"] for w in inside) / len(inside)
                old = sum(words[k]["confidence"] for k in crop["word_indices"]) / len(crop["word_indices"])
                if new >= 50 and new > old + 15:
                    gone.update(crop["word_indices"])
                    extra += inside
        else:
            for w in on_page:
                if w["confidence"] >= 65 and is_credible(w, 2) and not any(touch(o, w) for o in [*words, *extra]):
                    extra.append(w)
    return [w | {"added": False} for k, w in enumerate(words) if k not in gone] + [w | {"added": True} for w in extra]


def merge_crops(words: DataFrame, crops: DataFrame) -> DataFrame:
    """merge_page for every page: words (doc_id, ord, ...) and crops (doc_id, ord, ..., result array of words or null)."""

    def page(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        mine = left.sort_values("ord").to_dict("records")
        own = right.sort_values("ord").to_dict("records")
        results = [None if c["result"] is None else [dict(w) for w in c["result"]] for c in own]
        out = merge_page(mine, own, results)
        cols = [c.split()[0] for c in MERGED.split(", ")]
        return pd.DataFrame([{**w, "doc_id": key[0], "ord": k} for k, w in enumerate(out)], columns=cols)

    return words.groupBy("doc_id").cogroup(crops.groupBy("doc_id")).applyInPandas(page, MERGED)


def recovery_summary(before: DataFrame, after: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, regions, replaced, added) of each page."""
    n = before.groupBy("doc_id").agg(F.count("*").alias("n"))
    m = after.groupBy("doc_id").agg(F.count_if("added").alias("added"), F.count_if(~F.col("added")).alias("kept"))
    r = regions.groupBy("doc_id").agg(F.count("*").alias("regions"))
    return n.join(m, "doc_id", "left").join(r, "doc_id", "left").select("doc_id", F.coalesce("regions", F.lit(0)).alias("regions"), (F.col("n") - F.coalesce("kept", F.lit(0))).alias("replaced"), F.coalesce("added", F.lit(0)).alias("added"))


def missed_clusters(components: DataFrame, words: DataFrame, text_height: float) -> DataFrame:
    """Regions of text-like ink that no word covers: components joined from left to right, two at least.

    components: doc_id, ord, x, y, width, height, area. The anti join runs in y bands; clustering, in which the first
    cluster that fits wins, is a fold over one page's free components.
    """
    from quireflow.operators import spatial

    h = max(6.0, text_height or 12.0)
    glyphs = components.where((F.col("height") >= 0.45 * h) & (F.col("height") <= 2.2 * h) & (F.col("width") <= 3 * h) & (F.col("area") >= h))
    grown = words.select("doc_id", (F.col("x") - 0.3 * h).alias("x"), (F.col("y") - 0.2 * h).alias("y"), (F.col("width") + 0.6 * h).alias("width"), (F.col("height") + 0.4 * h).alias("height"))
    free = spatial.uncovered(glyphs, grown)

    # each glyph joins the first cluster whose last glyph it continues: an ordered fold over the page's glyphs
    glyph = F.struct("x", "ord", *[F.col(c).cast("double").alias(f"{c}_") for c in ("x", "y", "width", "height")])
    rows = free.groupBy("doc_id").agg(F.sort_array(F.collect_list(glyph)).alias("gs"))

    def step(groups: Column, g: Column) -> Column:
        right, bottom = g["x_"] + g["width_"], g["y_"] + g["height_"]
        last = lambda c: F.least(c["ly"] + c["lh"], bottom) - F.greatest(c["ly"], g["y_"])
        fits = F.transform(groups, lambda c: (last(c) >= F.least(c["lh"], g["height_"]) * 0.5) & (g["x_"] - c["lx"] <= 1.2 * h))

        def put(at: Column) -> Column:
            cluster = lambda x0, y0, x1, y1, n: F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), n.alias("n"), right.alias("lx"), g["y_"].alias("ly"), g["height_"].alias("lh"))
            joined = lambda c: cluster(F.least(c["x0"], g["x_"]), F.least(c["y0"], g["y_"]), F.greatest(c["x1"], right), F.greatest(c["y1"], bottom), c["n"] + 1)
            return F.when(at > 0, F.transform(groups, lambda c, k: F.when(k + 1 == at, joined(c)).otherwise(c))).otherwise(F.concat(groups, F.array(cluster(g["x_"], g["y_"], right, bottom, F.lit(1)))))

        return F.transform(F.array(F.coalesce(F.array_position(fits, True), F.lit(0))), put)[0]

    none = F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double,n:int,lx:double,ly:double,lh:double>>")
    found = rows.select("doc_id", F.explode(F.aggregate("gs", none, step)).alias("c")).where((F.col("c.n") >= 2) & (F.col("c.y1") - F.col("c.y0") <= 2.5 * h))
    return found.select("doc_id", F.col("c.x0").alias("x"), F.col("c.y0").alias("y"), (F.col("c.x1") - F.col("c.x0")).alias("width"), (F.col("c.y1") - F.col("c.y0")).alias("height"), F.col("c.n").alias("n"))
