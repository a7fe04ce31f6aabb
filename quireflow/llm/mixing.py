"""Mixing sources to target weights by weighted fair queueing.

Every source's documents are shuffled by a hash; a document's virtual finish time is the running total of its source's
words divided by the source's target. All servings are range-sorted by finish time, which serves each source at its
weight, and the order is truncated where the total budget is used up. A source that has to give more than it holds is
read again, at most ``repeats`` times in all; what it can't give goes to the others by weight.

As a source is served in the order of its documents' hashes, the truncation comes down to one hash a source and
reading: the rows themselves meet only that table, and texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quireflow.llm.common import WORD_REGEX, columns, dropped, fresh, numbered, quoted, written

#: Sources up to which their table of targets is broadcast (about 150 bytes a source); beyond, the join is left to adaptive execution.
FEW_SOURCES = 100_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...], repeats: int) -> DataFrame:
    """(skey, source_size, rank, target) for each source: weights repeat over the sources by code point, null last.

    Water filling: sources whose cap lies below the common level give their cap, which raises the level for the others,
    until none is above. Each round is one aggregate over the sources, and sums are of whole numbers.
    """
    grouped = sizes.groupBy("skey").agg(F.sum("size").cast("long").alias("source_size"))
    ranked = numbered(grouped, ["skey"], "rank", "mix-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(repeats))).withColumn("full_at", F.col("cap") / F.col("weight"))
    total = grouped.agg(F.sum("source_size")).first()[0] or 0
    level, over = -1.0, None
    while True:
        below = F.col("full_at") < F.lit(level)
        r = capped.agg(F.sum(F.when(below, F.col("source_size") * repeats)).alias("given"), F.sum(F.when(~below, F.col("weight"))).alias("open"), F.count(F.when(below, 1)).alias("n")).first()
        if over == r["n"] or not r["open"]:
            break
        over, level = r["n"], (float(total) - float(r["given"] or 0)) / r["open"]
    target = F.when(F.col("full_at") < F.lit(level), F.col("cap")).otherwise(F.col("weight") * F.lit(level))
    out = written(capped.select("skey", "source_size", "rank", target.alias("target")), "mix-targets")
    dropped(ranked)
    return out


def _truncated(placed: DataFrame, budget: int, repeats: int) -> Column:
    """Of a serving (finish, rank, epoch, cum): whether it lies within the budget when all are range-sorted by finish time.

    Sums of the ranges tell in which one the budget ends; only that one is summed up in order.
    """
    epochs = F.explode(F.array(*[F.lit(e).cast("long") for e in range(repeats)]))
    order = ["finish", "rank", "epoch", "cum"]
    servings = placed.where("words > 0 and target > 0").select("words", "rank", "source_size", "cum", "target", epochs.alias("epoch")).withColumn("finish", _finish(F.col("epoch")))
    ranges = written(servings.select(*order, "words").repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "mix-servings")
    used, cut = 0, None
    for r in ranges.groupBy("part").agg(F.sum("words").alias("n")).orderBy("part").collect():
        if used + r["n"] > budget:
            upto = F.sum("words").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
            cut = ranges.where(F.col("part") == r["part"]).withColumn("upto", upto).where(F.col("upto") + used > budget).orderBy(*order).first()
            break
        used += r["n"]
    dropped(ranges)
    if cut is None:
        return F.lit(True)
    first_out = F.struct(F.lit(float(cut["finish"])).alias("f"), F.lit(cut["rank"]).cast("long").alias("r"), F.lit(cut["epoch"]).cast("long").alias("e"), F.lit(cut["cum"]).cast("long").alias("c"))
    return F.struct(F.col("finish").alias("f"), F.col("rank").cast("long").alias("r"), F.col("epoch").alias("e"), F.col("cum").cast("long").alias("c")) < first_out


def _finish(epoch: Column) -> Column:
    return (epoch * F.col("source_size") + F.col("cum")) / F.col("target")


def _parts(id_col: str, text_col: str, source_col: str, seed: str) -> tuple[Column, Column, Column]:
    """(size, source key, draw) of a row: the draw is MD5 of seed, id and the text's MD5."""
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    source = F.col(quoted(source_col))
    skey = F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))
    draw = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("null")), F.md5(text)))
    return F.regexp_count(text, F.lit(WORD_REGEX)).cast("long"), skey, draw


def thresholds(df: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], repeats: int, seed: str) -> tuple[DataFrame, bool]:
    """(skey, source_size, target, last): the draws up to which each reading of a source is served; and whether sources are few.

    Equal draws are copies of one record: counted before the shuffle, they are one entry of the queue. Running totals
    are made in (source, draw prefix) cells and moved by the cells' sums, so no task holds a source.
    """
    size, skey, draw = _parts(id_col, text_col, source_col, seed)
    found = df.select(skey.alias("skey"), size.alias("size"), draw.alias("draw")).groupBy("skey", "draw").agg(F.sum("size").alias("words"))
    sizes = written(found.withColumn("cell", F.substring("draw", 1, 3)), "mix-sizes")
    cells = written(sizes.groupBy("skey", "cell").agg(F.sum("words").alias("size")), "mix-cells")
    sources = source_targets(cells, weights, repeats)
    up_to_cell = Window.partitionBy("skey").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    begun = cells.withColumn("before", F.coalesce(F.sum("size").over(up_to_cell), F.lit(0))).drop("size").join(sources, "skey")
    in_cell = Window.partitionBy("skey", "cell").orderBy("draw").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = written(sizes.join(begun, ["skey", "cell"]).withColumn("cum", F.col("before") + F.sum("words").over(in_cell)).drop("before", "cell"), "mix-placed")
    totals = sources.agg(F.sum("source_size").alias("n"), F.count("*").alias("sources")).first()
    within = _truncated(placed, totals["n"] or 0, repeats)
    some = (F.col("words") > 0) & (F.col("target") > 0)
    served = [placed.withColumn("epoch", F.lit(e).cast("long")).withColumn("finish", _finish(F.lit(e).cast("long"))).where(some & within).groupBy("skey").agg(F.max("draw").alias(f"last_{e}")) for e in range(repeats)]
    out = sources.select("skey", "source_size", "target")
    for s in served:
        out = out.join(s, "skey", "left")
    out = written(out.select("skey", "source_size", "target", F.array(*[f"last_{e}" for e in range(repeats)]).alias("last")), "mix-thresholds")
    dropped(sizes, cells, sources, placed)
    return out, totals["sources"] <= FEW_SOURCES


def _served(df: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], repeats: int, seed: str, *names: str) -> DataFrame:
    """df with columns of the given names: size, source_size, target, and how often the row is served."""
    found, few = thresholds(df, id_col, text_col, source_col, weights, repeats, seed)
    size, skey, draw = _parts(id_col, text_col, source_col, seed)
    n, key, drawn, source_size, target, last = fresh(df, "size", "skey", "draw", "source_size", "target", "last")
    rows = df.select(*columns(df), size.alias(n), skey.alias(key), draw.alias(drawn))
    table = found.select(F.col("skey").alias(key), F.col("source_size").alias(source_size), F.col("target").alias(target), F.col("last").alias(last))
    met = rows.join(F.broadcast(table) if few else table, key)
    times = F.when(F.col(n) > 0, F.size(F.filter(last, lambda x: F.col(drawn) <= x))).otherwise(0)
    return met.select(*columns(df), F.col(n).alias(names[0]), F.col(source_size).alias(names[1]), F.col(target).alias(names[2]), times.alias(names[3]))


def mix(df: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...] = (5, 2, 1), repeats: int = 3, seed: str = "mix") -> DataFrame:
    """Every row with size, its source's size and target, and the words taken: doc_id, size, source_size, target, taken.

    The budget is all words. The order within a source is by MD5 of seed, id and text, so reruns agree. Rows that repeat
    id and text are one record written several times: they are served together. Null ids count by their text.

    Null texts have size 0; a null source is a source, the last; documents of size 0 take 0; other columns are not
    read; an empty table gives an empty result.
    """
    rows = df.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text"), F.col(quoted(source_col)).alias("source"))
    served = _served(rows, "doc_id", "text", "source", weights, repeats, seed, "size", "source_size", "target", "times")
    return served.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed_rows(df: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...] = (5, 2, 1), repeats: int = 3, seed: str = "mix") -> DataFrame:
    """df's rows, whole, each as often as the mix takes it (as ``mix`` has it); any column names; rows not taken go."""
    names = fresh(df, "size", "source_size", "target", "times", "turn")
    served = _served(df, id_col, text_col, source_col, weights, repeats, seed, *names[:4])
    turns = F.explode(F.array_repeat(F.lit(0), F.col(names[3]))).alias(names[4])
    return served.where(F.col(names[3]) > 0).select(*columns(df), turns).select(*columns(df))
