"""Joins of rectangles on a page. Both sides are dealt to horizontal bands, so what can't meet is never compared.

A rectangle of the probing side goes to each band that it touches, one of the other side to each band that it touches;
a pair is taken in the first band that both share, so none comes twice. The equi join on (page, band) keeps Spark away
from nested loops, and rows stay on their page's partition key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quireflow.functions.geometry import Rect, centre_inside, expanded, overlap_area, overlaps

#: Height of a band, in pixels: about two lines of text.
BAND = 80
_SIDE = ("x", "y", "width", "height")


def _banded(df: DataFrame, name: str, grow: float = 0) -> DataFrame:
    first, last = F.floor((F.col("y") - grow) / BAND), F.floor((F.col("y") + F.col("height") + grow) / BAND)
    return df.select(F.col("doc_id"), F.struct(*[c for c in df.columns if c != "doc_id"]).alias(name), first.alias(f"{name}_first"), F.explode(F.sequence(first, last)).alias("band"))


def _rect(name: str) -> Rect:
    return Rect(*(F.col(f"{name}.{c}") for c in _SIDE))


def pairs(left: DataFrame, right: DataFrame, condition, grow: float = 0, how: str = "inner") -> DataFrame:
    """(doc_id, a, b): pairs of rectangles of a page for which condition(a, b) holds; right is grown by ``grow`` for banding."""
    a, b = _banded(left, "a"), _banded(right, "b", grow)
    met = a.join(b, ["doc_id", "band"]).where(F.col("band") == F.greatest("a_first", "b_first"))
    return met.where(condition(_rect("a"), _rect("b"))).select("doc_id", "a", "b")


def _matching(left: DataFrame, right: DataFrame, condition, grow: float) -> DataFrame:
    return pairs(left, right, condition, grow).select("doc_id", "a").distinct()


def uncovered(left: DataFrame, right: DataFrame) -> DataFrame:
    """Anti join: rows of left that strictly overlap no row of right on their page."""
    whole = F.struct(*[c for c in left.columns if c != "doc_id"])
    hit = _matching(left, right, overlaps, 0)
    return left.withColumn("a", whole).join(hit, ["doc_id", "a"], "left_anti").drop("a")


def centred_in(left: DataFrame, right: DataFrame, grow: float) -> DataFrame:
    """Semi join: rows of left whose centre lies in some row of right grown by ``grow``."""
    whole = F.struct(*[c for c in left.columns if c != "doc_id"])
    hit = _matching(left, right, lambda a, b: centre_inside(a, expanded(b, grow, grow)), grow)
    return left.withColumn("a", whole).join(hit, ["doc_id", "a"], "left_semi").drop("a")


def covered_area(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left that overlap some row of right, with the sum of the shared areas."""
    met = pairs(left, right, overlaps)
    return met.groupBy("doc_id", "a").agg(F.sum(overlap_area(_rect("a"), _rect("b"))).alias("covered")).select("doc_id", "a.*", "covered")


def mostly_inside(lines: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, line_no, ids): for each line the words of which it covers half or more, as ``line:word`` in order."""
    met = pairs(lines, words, overlaps).where(overlap_area(_rect("a"), _rect("b")) * 2 >= F.col("b.width") * F.col("b.height"))
    ids = F.sort_array(F.collect_list(F.struct(F.col("b.line_no").alias("l"), F.col("b.word_no").alias("w"))))
    return met.groupBy("doc_id", F.col("a.line_no").alias("line_no")).agg(F.array_join(F.transform(ids, lambda s: F.concat_ws(":", s["l"], s["w"])), ",").alias("ids"))


def neighbour_limits(runs: DataFrame) -> DataFrame:
    """Each run's nearest right edge to its left and left edge to its right on the same line, null without one.

    Runs of a line don't overlap, so the limits are those of the rows before and after: windows instead of a self join.
    """
    w = Window.partitionBy("doc_id", "line_no").orderBy("x0")
    left = F.max(F.col("x1")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    right = F.min(F.col("x0")).over(w.rowsBetween(1, Window.unboundedFollowing))
    return runs.select("doc_id", "line_no", "run_no", F.when(left <= F.col("x0"), left).alias("left_limit"), F.when(right >= F.col("x1"), right).alias("right_limit"))


#: Rows of an element's neighbourhood, in order of height on the page, that are looked at first.
NEAR = 64


def nearest(elements: DataFrame, asks: str, offers: str, nearer: str | None = None) -> DataFrame:
    """For each row that asks the row that offers on its page with the nearest centre, the first (line, run) on ties.

    asks, offers: conditions on elements; nearer: a condition on those that offer whose distance counts .8 (0.64 squared).
    Squares are of twice the distance. A page's rows are sorted by height once; from a row's place the search goes
    outwards until the height alone is farther than the best, so a page isn't compared pair by pair.
    """
    import numpy as np
    import pyarrow as pa

    rows = elements.select(
        "doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("run_no").cast("long").alias("run_no"), (F.col("x0") + F.col("x1")).cast("double").alias("cx"), (F.col("y0") + F.col("y1")).cast("double").alias("cy"),
        F.coalesce(F.expr(asks), F.lit(False)).alias("asks"), F.coalesce(F.expr(offers), F.lit(False)).alias("offers"), (F.when(F.expr(nearer), 0.64).otherwise(1.0) if nearer else F.lit(1.0)).alias("weight"),
    ).where("asks or offers")

    def page(t: pa.Table) -> pa.Table:
        doc, line, run, cx, cy, ask, offer, weight = (t.column(k).to_numpy() for k in range(8))
        at = np.flatnonzero(offer)
        at = at[np.lexsort((run[at], line[at], cy[at]))]
        y, out = cy[at], []
        for i in np.flatnonzero(ask) if len(at) else ():
            low = high = int(np.searchsorted(y, cy[i]))
            best, step = (np.inf, 0, 0), NEAR
            while True:
                first, last = max(0, low - step), min(len(at), high + step)
                for some in (at[first:low], at[high:last]):
                    if len(some):
                        d = ((cx[some] - cx[i]) ** 2 + (cy[some] - cy[i]) ** 2) * weight[some]
                        least = some[d == d.min()]
                        best = min(best, min((d.min(), line[k], run[k]) for k in least))
                low, high, step = first, last, 2 * step
                floor = min(cy[i] - y[low - 1] if low else np.inf, y[high] - cy[i] if high < len(at) else np.inf)
                if floor == np.inf or 0.64 * floor * floor > best[0]:
                    break
            out.append((doc[i], line[i], run[i], best[1], best[2], best[0]))
        names = ["doc_id", "line_no", "run_no", "near_line", "near_run", "distance"]
        kinds = [pa.int64()] * 5 + [pa.float64()]
        return pa.table({n: pa.array([r[k] for r in out], kind) for k, (n, kind) in enumerate(zip(names, kinds, strict=True))})

    return rows.groupBy("doc_id").applyInArrow(page, "doc_id long, line_no long, run_no long, near_line long, near_run long, distance double")


def nearest_interval(layers: DataFrame, asks: str, offers: str) -> DataFrame:
    """For each row that asks the row that offers on its line that is nearest in x (0 where they overlap), the first on ties.

    Rows that offer don't overlap each other, so only the last that begins at or before a row and the first that begins
    after it can be nearest: two windows over the line instead of a join of its rows.
    """
    host = F.when(F.expr(offers), F.struct("x", "width", F.col("word_no").alias("host")))
    line = Window.partitionBy("doc_id", "line_no").orderBy("x", F.expr(offers).desc())
    rows = layers.where(f"({asks}) or ({offers})")
    found = rows.withColumns({
        "before": F.last(host, True).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "after": F.first(host, True).over(line.rowsBetween(1, Window.unboundedFollowing)),
    }).where(asks)

    def near(h: str) -> Column:
        d = F.greatest(F.lit(0), F.col(f"{h}.x") - (F.col("x") + F.col("width")), F.col("x") - (F.col(f"{h}.x") + F.col(f"{h}.width")))
        return F.when(F.col(h).isNotNull(), F.struct(d.alias("distance"), F.col(f"{h}.host").alias("host")))

    best = F.when(F.col("before").isNull(), near("after")).when(F.col("after").isNull(), near("before")).otherwise(F.least(near("before"), near("after")))
    return found.withColumn("b", best).where("b is not null").select("doc_id", "line_no", "word_no", "b.host", "b.distance")
