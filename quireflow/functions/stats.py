"""Order statistics with the exact index rules of the data model, as aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _at(values: Column, index: Column) -> Column:
    return F.get(values, index.cast("int"))


def upper_median(col: str | Column) -> Column:
    """Aggregate: the element at floor(n / 2) of the sorted values; 0 for none."""
    s = F.sort_array(F.collect_list(col))
    return F.coalesce(_at(s, F.floor(F.size(s) / 2)), F.lit(0))


def nearest_rank(col: str | Column, percent: float) -> Column:
    """Aggregate: the element at round(percent / 100 * (n - 1)), halves upwards; null for none."""
    s = F.sort_array(F.collect_list(col))
    return F.when(F.size(s) > 0, _at(s, F.greatest(F.lit(0), F.least(F.size(s) - 1, F.floor(F.lit(percent / 100.0) * (F.size(s) - 1) + 0.5)))))


def js_round(col: Column) -> Column:
    """Halves towards plus infinity."""
    return F.floor(col + 0.5)


def indexed(col: str | Column, share: float, least: int = 0) -> Column:
    """Aggregate: the element at floor(share * n) of the sorted values; 0 under ``least`` values."""
    s = F.sort_array(F.collect_list(col))
    return F.when((F.size(s) >= max(least, 1)), _at(s, F.floor(F.lit(share) * F.size(s)))).otherwise(F.lit(0))


def with_upper_median(df: DataFrame, keys: list[str], col: str, out: str) -> DataFrame:
    """df with the upper median of its group on every row: two windows on the group's own partitioning, no join with an aggregate of df."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumns({"_rank": F.row_number().over(w.orderBy(col)), "_n": F.count("*").over(w)})
    return ranked.withColumn(out, F.max(F.when(F.expr("_rank = _n div 2 + 1"), F.col(col))).over(w)).drop("_rank", "_n")


def jitter(wobble: Column, connected: Column | None = None) -> Column:
    """Variation of replacement handwriting for a measured wobble (fixed values: slopes .055 and .1, bounds .15 and .85), to hundredths."""
    slope = F.lit(0.055) if connected is None else F.when(connected, 0.1).otherwise(0.055)
    return js_round(F.greatest(F.lit(0.15), F.least(F.lit(0.85), wobble / slope)) * 100) / 100


def ranked_upper_median(df: DataFrame, keys: list[str], col: str, out: str) -> DataFrame:
    """(keys, out): the upper median of groups of any size. Values are counted before the shuffle, and ranks run over the distinct ones."""
    w = Window.partitionBy(*keys)
    counts = df.where(F.col(col).isNotNull()).groupBy(*keys, F.col(col).alias(out)).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(w.orderBy(out).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = counts.withColumns({"_upto": upto, "_n": F.sum("_c").over(w)})
    return rows.where("_upto > _n div 2").groupBy(*keys).agg(F.min(out).alias(out))


def weight_model(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Two weight classes of each group by Otsu's split over sorted values, null columns where they aren't clear.

    Positive values within 2.5 times of the upper median, at least 6; of all splits the first that maximises
    nLo * nHi * (mean difference)^2; each class at least max(3, 4 %) values, means at least 1.2 apart as a ratio, and
    the split must explain 60 % of the squares. low and high leave a band of 12 % of the difference unclassified.
    """
    w = Window.partitionBy(*keys)
    good = df.where(F.col(col) > 0).groupBy(*keys, F.col(col).cast("double").alias("v")).agg(F.count("*").alias("c"))
    upto = w.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = w.orderBy("v").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = good.withColumns({"n_upto": F.sum("c").over(upto), "n_all": F.sum("c").over(w)})
    near = counted.withColumn("med", F.min(F.when(F.expr("n_upto > n_all div 2"), F.col("v"))).over(w)).where("v <= med * 2.5 and v >= med / 2.5")
    # the squared difference over nLo * nHi is convex along equal values, so the best split lies between different ones;
    # sums run in order of value, each value once, so they don't hang on the order of rows
    sums = near.select(*keys, "v", F.sum("c").over(upto).alias("n_lo"), F.sum(F.col("v") * F.col("c")).over(upto).alias("s_lo"), F.sum(F.col("v") * F.col("v") * F.col("c")).over(upto).alias("ss_lo"), F.lead("v").over(w.orderBy("v")).alias("after"))
    run = sums.select("*", *[F.last(a).over(whole).alias(b) for a, b in (("n_lo", "n"), ("s_lo", "s"), ("ss_lo", "ss"))])
    least = F.greatest(F.lit(3), F.floor(0.04 * F.col("n") + 0.5))
    m_lo, m_hi = F.col("s_lo") / F.col("n_lo"), (F.col("s") - F.col("s_lo")) / (F.col("n") - F.col("n_lo"))
    splits = run.where("n >= 6 and n_lo < n").withColumn("m_lo", m_lo).withColumn("m_hi", m_hi)
    splits = splits.withColumn("between", F.col("n_lo") * (F.col("n") - F.col("n_lo")) * (F.col("m_hi") - F.col("m_lo")) * (F.col("m_hi") - F.col("m_lo")))
    best = splits.groupBy(*keys).agg(F.max_by(F.struct("n_lo", "n", "m_lo", "m_hi", "between", "s", "ss", "v", "after"), F.struct("between", -F.col("n_lo"))).alias("b"))
    b = best.select(*keys, "b.*").withColumn("least", least)
    total = F.col("ss") - F.col("s") * F.col("s") / F.col("n")
    clear = (F.col("n_lo") >= F.col("least")) & (F.col("n") - F.col("n_lo") >= F.col("least")) & (F.col("m_hi") >= 1.2 * F.col("m_lo")) & (F.col("between") / F.col("n") >= 0.6 * total)
    middle, band = (F.col("v") + F.col("after")) / 2, 0.12 * (F.col("m_hi") - F.col("m_lo"))
    return b.select(*keys, "n", "n_lo", F.when(clear, middle - band).alias("low"), F.when(clear, middle + band).alias("high"), F.when(clear, F.col("m_lo")).alias("regular"), F.when(clear, F.col("m_hi")).alias("bold"))


def otsu(df: DataFrame, keys: list[str], bin_col: str) -> DataFrame:
    """(keys, threshold): the first bin that maximises the between-class variance of a histogram of integer bins."""
    hist = df.groupBy(*keys, F.col(bin_col).cast("long").alias("bin")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys)
    upto = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = hist.select(*keys, "bin", F.sum("c").over(upto).alias("n_b"), F.sum(F.col("c") * F.col("bin")).over(upto).alias("s_b"), F.sum("c").over(w).alias("n"), F.sum(F.col("c") * F.col("bin")).over(w).alias("s"))
    n_b, s_b = F.col("n_b").cast("double"), F.col("s_b").cast("double")
    gap = s_b / n_b - (F.col("s") - s_b) / (F.col("n") - n_b)
    return run.where("n_b < n").withColumn("between", n_b * (F.col("n") - n_b) * gap * gap).groupBy(*keys).agg(F.max_by("bin", F.struct("between", -F.col("bin"))).alias("threshold"))
