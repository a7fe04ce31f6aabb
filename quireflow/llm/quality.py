"""Quality rules: base counts of each text, and the log-likelihood ratio of its hashed n-grams.

Two multinomials over hashed words and word pairs are counted, one on trusted documents (the target), one on all
documents (the raw corpus). A document's score is the sum of its n-grams' log ratios divided by their number; it stays
if the score reaches a fixed threshold. Ratios are integers (2^-20 nats), so sums don't hang on order and the verdict
is deterministic. Only the bucket counts leave the tasks: BUCKETS rows, whatever the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.llm.common import WS_CHARS, columns, fresh, let, quoted, words_of

#: Buckets of the hashed n-grams, the unit of a ratio, and the score below which a document goes (nats an n-gram).
BUCKETS, UNIT, THRESHOLD = 1 << 14, 1 << 20, -0.04
#: Trusted documents that the target is counted on, at most: those of the smallest hashes.
TRUSTED_DOCS = 20_000
#: Pseudo-counts that draw the target towards the raw corpus: without trusted documents all ratios are 0.
PRIOR = float(BUCKETS)
#: Standard errors by which a ratio is drawn to 0, so that what the trusted sample can't tell doesn't reject a text.
ERRORS = 2.0
SYMBOLS = "#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT = 50, 50


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def _pair(h: Column, x: Column, i: Column) -> Column:
    return F.xxhash64(x, F.get(h, i + 1))


def bucket_counts(df: DataFrame, id_col: str, text_col: str, trusted: DataFrame) -> dict[int, tuple[int, int]]:
    """bucket -> (count in all documents, count in trusted ones); trusted has at most TRUSTED_DOCS ids, one a row."""
    flag = F.broadcast(trusted.select(F.col(trusted.columns[0]).alias("trusted_id"), F.lit(1).alias("trusted")))
    rows = df.select(F.col(quoted(id_col)).alias("row_id"), F.col(quoted(text_col)).alias("row_text")).join(flag, F.col("row_id") == F.col("trusted_id"), "left")
    grams = let(_hashes(words_of(F.col("row_text"))), lambda h: F.concat(F.transform(h, _bucket), F.transform(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: _bucket(_pair(h, x, i)))))
    found = rows.select(F.explode(grams).alias("bucket"), F.coalesce("trusted", F.lit(0)).alias("trusted")).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("trusted").alias("t")).collect()
    return {r["bucket"]: (r["n"], r["t"]) for r in found}


def log_ratios(counts: dict[int, tuple[int, int]]) -> list[int]:
    """Integer log ratio of each bucket: target, smoothed towards the raw corpus, over raw; less its sampling error."""
    raw, target = sum(n for n, _ in counts.values()), sum(t for _, t in counts.values())
    out = [0] * BUCKETS
    for b, (n, t) in counts.items():
        share = n / raw
        ratio = math.log((t + PRIOR * share) / ((target + PRIOR) * share))
        certain = max(0.0, abs(ratio) - ERRORS / math.sqrt(t + PRIOR * share))
        out[b] = round(math.copysign(certain, ratio) * UNIT)
    return out


def repeated_words(hashes: Column) -> Column:
    """Words within 3-word windows that the text holds twice or more.

    The windows' hashes are sorted with their positions in the low bits; equal neighbours are compared by the whole
    hash. Sorting keeps this n log n for texts of any length.
    """

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(at, i + 1) - x, F.lit(3).cast("long"))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def of(windows: Column) -> Column:
        def with_mask(mask: Column) -> Column:
            packed = F.sort_array(F.transform(windows, lambda x, i: x.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))))

            def from_sorted(s: Column) -> Column:
                def window(x: Column) -> Column:
                    return F.get(windows, x.bitwiseAND(mask).cast("int"))

                same = lambda x, y: F.coalesce((x.bitwiseXOR(y) <= mask) & (x.bitwiseXOR(y) >= 0) & (window(x) == window(y)), F.lit(False))
                twice = F.filter(s, lambda x, i: same(x, F.get(s, i + 1)) | F.when(i > 0, same(x, F.get(s, i - 1))).otherwise(F.lit(False)))
                return let(F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(mask))), covered)

            return let(packed, from_sorted)

        bits = F.length(F.bin(F.size(windows).cast("long")))
        # most texts have no window twice: a set of the hashes tells
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1, with_mask))

    windows = F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(hashes, i + 1), F.get(hashes, i + 2)))
    return let(windows, of)


def score(hashes: Column, ratios: list[int]) -> Column:
    """Sum of the log ratios of a text's words and word pairs."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<bigint>")

    def values(x: Column, i: Column) -> Column:
        pair = F.when(i + 1 < F.size(hashes), F.get(table, _bucket(_pair(hashes, x, i)))).otherwise(F.lit(0).cast("long"))
        return F.get(table, _bucket(x)) + pair

    return F.aggregate(F.transform(hashes, values), F.lit(0).cast("long"), lambda a, x: a + x)


def trusted_ids(labels: DataFrame, limit: int = TRUSTED_DOCS) -> DataFrame:
    """Ids of documents labelled good, at most ``limit``: a bounded sample, the same in every run."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def _judged(df: DataFrame, trusted: DataFrame, id_col: str, text_col: str, threshold: float) -> tuple[DataFrame, dict[str, Column]]:
    """df with one more column of a name of its own, and the results' expressions over it."""
    ratios = log_ratios(bucket_counts(df, id_col, text_col, trusted))
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    bare = F.char_length(F.translate(text, WS_CHARS, ""))
    symbols = F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, WS_CHARS, "") != "")
    dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    of_words = let(_hashes(words_of(text)), lambda h: F.struct(F.size(h).cast("long").alias("n_words"), repeated_words(h).alias("n_repeat_words"), score(h, ratios).alias("score")))
    # a generator, unlike a projection, is never copied into the filters and columns that read it
    (own,) = fresh(df, "_quality")
    found = df.select(*columns(df), F.explode(F.array(of_words)).alias(own))
    n, repeat, total = (F.col(own)[c] for c in ("n_words", "n_repeat_words", "score"))
    grams = F.greatest(2 * n - 1, F.lit(1))
    failed = (n < MIN_WORDS) | (100 * repeat > REPEAT_PERCENT * n)
    good = total >= F.floor(F.lit(threshold * UNIT)).cast("long") * grams
    named = {
        "n_words": n, "word_chars": bare.cast("long"), "n_symbols": symbols.cast("long"), "n_dup_lines": dup.cast("long"), "n_repeat_words": repeat,
        "base_failed": failed, "llr": F.round(total / (grams * F.lit(float(UNIT))), 6), "kept": ~failed & good,
    }
    return found, named


def judge(df: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Every row with its base counts, base_failed, llr and kept.

    Null texts have no words and fail the base rules. Repeated rows and null ids are judged like any; other columns are
    not returned, whatever their names; an empty table gives an empty result. Texts are scored as a whole, and nothing
    but bucket counts is shuffled.
    """
    found, named = _judged(df, trusted, id_col, text_col, threshold)
    return found.select(F.col(quoted(id_col)).alias("doc_id"), *[v.alias(k) for k, v in named.items()])


def good_rows(df: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df's rows that ``judge`` keeps, whole, with any columns and column names; repeated rows and null ids are judged like any."""
    found, named = _judged(df, trusted, id_col, text_col, threshold)
    return found.where(named["kept"]).select(*columns(df))
