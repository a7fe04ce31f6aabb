"""Choice of recognition languages: normalisation, locale matching, and the evidence of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quireflow.functions import text as tx
from quireflow.sources import dims

DETECTION_MIN, HEADLINE_MIN = 1.0, 5
HEADLINE_SCRIPTS = ("devanagari", "bengali", "gurmukhi")


def normalised(codes: Column) -> Column:
    """Known codes in order without repeats, at most three, ``auto`` for none; ``auto`` among them stands alone."""
    known = F.array(*[F.lit(r[0]) for r in dims.LANGUAGES])
    kept = F.array_distinct(F.filter(codes, lambda c: F.array_contains(known, c)))
    auto = F.array(F.lit(dims.AUTO))
    return F.when(F.array_contains(codes, dims.AUTO) | (F.size(kept) == 0), auto).otherwise(F.slice(kept, 1, dims.MAX_LANGUAGES))


def expanded(df: DataFrame, key: str, codes: str) -> DataFrame:
    """(key, scripts, regions): ordered distinct scripts and Han regions of each row's languages; unknown codes give none."""
    lang = F.broadcast(dims.languages(df.sparkSession).select("code", "scripts", "region"))
    rows = df.select(key, F.posexplode(codes).alias("at", "code")).join(lang, "code").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", "scripts", "region"))).alias("l"))
    return df.select(key).join(rows, key, "left").select(
        key, F.coalesce(F.array_distinct(F.flatten(F.transform("l", lambda x: x["scripts"]))), F.array().cast("array<string>")).alias("scripts"),
        F.coalesce(F.array_distinct(F.filter(F.transform("l", lambda x: x["region"]), lambda r: r.isNotNull())), F.array().cast("array<string>")).alias("regions"),
    )


def matched(rows: DataFrame) -> DataFrame:
    """rows (id, attempt, key, locales) with ``primary``: the language that the locales point to among the key's, else the key's first.

    The first locale that matches anything decides; in it the longest tag prefix, then the earlier language. Prefixes of
    a tag are spelt out, so the match is an equi join with a broadcast table of fixed size. For ANY the fallback is null.
    """
    spark = rows.sparkSession
    own = F.broadcast(dims.candidates(spark).join(dims.languages(spark).select("code", F.explode("locales").alias("tag")), "code").select("key", "ord", "code", "tag"))
    first = F.broadcast(dims.candidates(spark).where("ord = 0").select("key", F.when(F.col("key") != dims.ANY, F.col("code")).alias("first_code")))
    tags = rows.select("id", "attempt", "key", F.posexplode("locales").alias("loc", "raw")).withColumn("parts", F.split(F.lower("raw"), "-"))
    prefixes = tags.select("id", "attempt", "key", "loc", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda n: F.array_join(F.slice("parts", F.lit(1), n), "-"))).alias("tag"))
    best = prefixes.join(own, ["key", "tag"]).groupBy("id", "attempt").agg(F.min_by("code", F.struct("loc", -F.length("tag"), "ord")).alias("matched"))
    return rows.join(best, ["id", "attempt"], "left").join(first, "key").withColumn("primary", F.coalesce("matched", "first_code")).drop("matched", "first_code")


def with_english(primary: Column) -> Column:
    """The languages to recognise with: English joins unless it is the primary one."""
    return F.when(primary.isNull() | (primary == "eng"), F.lit("eng")).otherwise(F.concat(primary, F.lit(",eng")))


def headline_script(evidence: DataFrame) -> DataFrame:
    """(id, script): which headline script the probe text of a page shows; a close call goes to the reader's own script."""
    probe = evidence.where((F.col("headline_words") >= HEADLINE_MIN) & (F.col("probe_text") != ""))
    shares = tx.script_shares(tx.char_counts(probe, "id", "probe_text"), "id").where(F.col("script").isin(*HEADLINE_SCRIPTS))
    by_tag = F.create_map(*[F.lit(v) for kv in dims.HEADLINE_LOCALES.items() for v in kv])
    own = F.get(F.filter(F.transform("locales", lambda t: F.try_element_at(by_tag, F.get(F.split(F.lower(t), "-"), F.lit(0)))), lambda s: s.isNotNull()), F.lit(0))
    top = shares.groupBy("id").agg(F.max_by(F.struct("script", "share"), F.struct("share", -F.col("first_at"))).alias("top"), F.map_from_entries(F.collect_list(F.struct("script", "share"))).alias("all"))
    both = top.join(probe.select("id", own.alias("own")), "id")
    local = (F.col("top.share") < 0.6) & (F.coalesce(F.try_element_at("all", F.col("own")), F.lit(0.0)) >= 0.3)
    return both.select("id", F.when(local, F.col("own")).otherwise(F.col("top.script")).alias("script"))


def choose(evidence: DataFrame) -> DataFrame:
    """(id, languages, source) for evidence (id, osd_script, osd_confidence, headline_words, probe_text, locales).

    Headlines come first, then a confident detection, then the reader's locales.
    """
    spark = evidence.sparkSession
    seen = headline_script(evidence).join(evidence.select("id", "locales"), "id").select("id", F.lit(1).alias("attempt"), F.col("script").alias("key"), "locales")
    named = F.broadcast(dims.detected(spark))
    osd = evidence.where(F.col("osd_confidence") >= DETECTION_MIN).withColumn("name", F.lower(F.trim("osd_script"))).join(named, "name").select("id", F.lit(2).alias("attempt"), "key", "locales")
    any_row = evidence.select("id", F.lit(3).alias("attempt"), F.lit(dims.ANY).alias("key"), "locales")
    found = matched(seen.unionByName(osd).unionByName(any_row))
    best = found.groupBy("id").agg(F.min_by(F.struct("primary", "attempt"), "attempt").alias("b"))
    source = F.element_at(F.array(F.lit("headline"), F.lit("script"), F.lit("locale")), F.col("b.attempt"))
    return best.select("id", with_english(F.col("b.primary")).alias("languages"), source.alias("source"))


def capped_languages(df: DataFrame, key: str, code: str, order: str, limit: int = dims.MAX_LANGUAGES) -> DataFrame:
    """The first ``limit`` distinct codes of each key."""
    first = df.groupBy(key, code).agg(F.min(order).alias(order))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("rank") <= limit)
