"""Writing systems, text direction, clusters and run text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Unicode blocks by script (fixed values): first and last code point. What lies in none is neutral.
SCRIPT_BLOCKS = (
    (0x0041, 0x005A, "latin"), (0x0061, 0x007A, "latin"), (0x00AA, 0x00AA, "latin"), (0x00BA, 0x00BA, "latin"), (0x00C0, 0x00D6, "latin"), (0x00D8, 0x00F6, "latin"),
    (0x00F8, 0x024F, "latin"), (0x0250, 0x02AF, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"), (0x0590, 0x05FF, "hebrew"), (0x0600, 0x06FF, "arabic"),
    (0x0750, 0x077F, "arabic"), (0x0870, 0x08FF, "arabic"), (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"), (0x0A00, 0x0A7F, "gurmukhi"), (0x0A80, 0x0AFF, "gujarati"),
    (0x0B80, 0x0BFF, "tamil"), (0x0C00, 0x0C7F, "telugu"), (0x0C80, 0x0CFF, "kannada"), (0x0D00, 0x0D7F, "malayalam"), (0x0E00, 0x0E7F, "thai"), (0x1100, 0x11FF, "hangul"),
    (0x1C80, 0x1C8F, "cyrillic"), (0x1CD0, 0x1CFF, "devanagari"), (0x1E00, 0x1EFF, "latin"), (0x1F00, 0x1FFF, "greek"), (0x2C60, 0x2C7F, "latin"), (0x2DE0, 0x2DFF, "cyrillic"),
    (0x2E80, 0x2FDF, "han"), (0x3000, 0x303F, "han"), (0x3040, 0x30FF, "kana"), (0x3130, 0x318F, "hangul"), (0x31F0, 0x31FF, "kana"), (0x3400, 0x4DBF, "han"), (0x4E00, 0x9FFF, "han"),
    (0xA640, 0xA69F, "cyrillic"), (0xA720, 0xA7FF, "latin"), (0xA8E0, 0xA8FF, "devanagari"), (0xA960, 0xA97F, "hangul"), (0xAB30, 0xAB6F, "latin"), (0xAC00, 0xD7AF, "hangul"),
    (0xD7B0, 0xD7FF, "hangul"), (0xF900, 0xFAFF, "han"), (0xFB1D, 0xFB4F, "hebrew"), (0xFB50, 0xFDFF, "arabic"), (0xFE70, 0xFEFF, "arabic"), (0xFF01, 0xFF60, "han"), (0xFF66, 0xFF9F, "kana"),
    (0x20000, 0x3134F, "han"),
)
RTL, CONNECTED, UNSPACED = ("arabic", "hebrew"), ("devanagari", "bengali", "gurmukhi", "arabic"), ("han", "kana", "thai")
#: Viramas of the Indic scripts, and the joiners that may follow one (fixed values).
VIRAMAS, JOINERS = "्্੍્்్್്", "‌‍"


def _ranges(scripts: tuple[str, ...]) -> str:
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b, s in SCRIPT_BLOCKS if s in scripts)


def script_of(ch: Column) -> Column:
    """Script of the first character of ch, null if neutral: a class test for each script, in generated code."""
    out = F.lit(None).cast("string")
    for script in dict.fromkeys(s for _, _, s in SCRIPT_BLOCKS):
        out = F.when(ch.rlike(f"^[{_ranges((script,))}]"), F.lit(script)).otherwise(out)
    return out


def script_of_code(cp: Column) -> Column:
    """Script of a code point, null if neutral: comparisons of whole numbers, which generated code does fast."""
    out = F.lit(None).cast("string")
    for script in dict.fromkeys(s for _, _, s in SCRIPT_BLOCKS):
        ranges = [cp.between(a, b) for a, b, s in SCRIPT_BLOCKS if s == script]
        hit = ranges[0]
        for r in ranges[1:]:
            hit = hit | r
        out = F.when(hit, F.lit(script)).otherwise(out)
    return out


def blocks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCRIPT_BLOCKS, "lo int, hi int, script string")


def blocks_sql() -> str:
    """The blocks as a DuckDB VALUES list."""
    return ", ".join(f"({a}, {b}, '{s}')" for a, b, s in SCRIPT_BLOCKS)


def scripts_of(text: Column) -> Column:
    """Distinct scripts of a text in order of first use."""
    return F.array_distinct(F.filter(F.transform(chars(text), script_of), lambda s: s.isNotNull()))


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def has_any(text: Column, scripts: tuple[str, ...]) -> Column:
    return text.rlike(f"[{_ranges(scripts)}]")


def has_rtl(text: Column) -> Column:
    return has_any(text, RTL)


def has_connected(text: Column) -> Column:
    return has_any(text, CONNECTED)


def direction(text: Column) -> Column:
    """rtl if the first character that has a script is of a right-to-left one."""
    every = _ranges(tuple({s for _, _, s in SCRIPT_BLOCKS}))
    return F.when(text.rlike(f"^[^{every}]*[{_ranges(RTL)}]"), F.lit("rtl")).otherwise(F.lit("ltr"))


def clusters(text: Column) -> Column:
    """Grapheme clusters, with whole Indic conjuncts: a cluster that ends in a virama (and joiner) takes the next letter."""
    return F.regexp_extract_all(text, F.lit(rf"(?:\X(?<=[{VIRAMAS}][{JOINERS}]?)(?=\p{{L}}))*\X"), F.lit(0))


def run_text(words: Column) -> Column:
    """Text of words from left to right: reversed for right-to-left, no space beside Han, kana or Thai."""
    ordered = F.when(direction(F.array_join(words, " ")) == "rtl", F.reverse(words)).otherwise(words)
    bare = _ranges(UNSPACED)

    def add(out: Column, w: Column) -> Column:
        joined = out.rlike(f"[{bare}]$") | w.rlike(f"^[{bare}]")
        return F.when(out == "", w).when(joined, F.concat(out, w)).otherwise(F.concat(out, F.lit(" "), w))

    return F.aggregate(ordered, F.lit(""), add)


def char_counts(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, script, n, first_at): characters of each script in a text; neutral ones don't count.

    Each text is folded to its distinct code points with counts before scripts are looked up, so the ranges are tested
    on a few dozen rows a text instead of on every character, and no range join is needed.
    """
    ch = df.select(key, F.posexplode(F.split(text_col, "")).alias("at", "ch")).where("ch <> ''").select(key, "at", F.ascii("ch").alias("cp"))
    # the code is taken from an aggregate: a filter on a grouping key would be pushed down to every character
    folded = ch.groupBy(key, "cp").agg(F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("cp").alias("code"))
    return folded.withColumn("script", script_of_code(F.col("code"))).where("script is not null").groupBy(key, "script").agg(F.sum("n").alias("n"), F.min("first_at").alias("first_at"))


def script_shares(counts: DataFrame, key: str) -> DataFrame:
    """Share of each script in all characters that have one."""
    return counts.withColumn("share", F.col("n") / F.greatest(F.lit(1), F.sum("n").over(Window.partitionBy(key))))


def dominant_script(counts: DataFrame, key: str) -> DataFrame:
    """The script of most characters, the first seen on ties."""
    return counts.groupBy(key).agg(F.max_by("script", F.struct("n", -F.col("first_at"))).alias("script"), F.max("n").alias("n"))


def fnv1a(text: Column) -> Column:
    """FNV-1a over the text's code units, 32 bits unsigned."""
    return F.aggregate(F.transform(chars(text), lambda c: F.ascii(c).cast("long")), F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(F.lit(4294967295)))


def squashed(text: Column) -> Column:
    """Lower case without white space, for comparing readings."""
    return F.lower(F.regexp_replace(text, r"(?U)\s", ""))


def alnum(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "")


def detokenised(pieces: Column) -> Column:
    """Text of sentence pieces: control pieces drop, the lower bar is a space, spaces collapse."""
    kept = F.filter(pieces, lambda p: ~p.rlike("^<.*>$"))
    return F.trim(F.regexp_replace(F.regexp_replace(F.array_join(kept, ""), "▁", " "), r"\s+", " "))


def numeric_piece(piece: Column) -> Column:
    return F.regexp_replace(piece, "▁", "").rlike(r"^[0-9/\-.,:]+$")
