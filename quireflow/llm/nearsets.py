"""Near copies by the similarity of word shingles: texts whose sets of 5-word shingles have Jaccard >= 0.8.

Candidates are the classes of SimHash (op2's search) and texts that share a band of MinHashes; SimHash alone reaches few
of the pairs, as a similarity of 0.8 is about ten bits of 64. Each text that has a candidate moves once, to its group of
candidates, and there every link is verified on the shingle sets (64-bit hashes of the shingles): no link is made by a
sketch. A group is searched breadth first and a reached text is not compared again, so a large group of near copies
makes neither rows for its pairs nor all comparisons. A group beyond GROUP_BYTES is parted into blocks, and pairs of
blocks are separate tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.common import columns, dropped, fresh, over_arrow, quoted, written
from quireflow.llm.simhash import components, near_duplicates

WORDS = 5
#: Linked texts share this part of their shingles: 4/5.
SHARED, OF = 4, 5
#: A pair of similarity s shares a band with probability 1 - (1 - s^ROWS)^BANDS: 0.992 at 0.8, 0.9999 at 0.9.
BANDS, ROWS = 16, 6
_RNG = np.random.default_rng(42)
_FLIP, _ODD = _RNG.integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
#: MinHashes (their last bytes) that two texts must share to be compared on their sets. A pair of similarity 0.8 shares 77 of
#: 96 on average with a deviation of 4, so it has fewer with a probability of 1e-9.
AGREE = 52
#: Bytes of the texts that are searched together; larger groups are parted.
GROUP_BYTES = 8 << 20


def shingles(text: str | None) -> set[bytes]:
    """5-word shingles, A-Z lower-cased; a shorter text is one shingle, one without words has none."""
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k : k + WORDS]) for k in range(max(1, len(words) - WORDS + 1))} if words else set()


def similar(a: set[bytes], b: set[bytes]) -> bool:
    both = len(a & b)
    return OF * both >= SHARED * (len(a) + len(b) - both)


def hashed(text: str | None) -> np.ndarray:
    """The shingles' XXH64, sorted, each once; that of the empty string for a text without words."""
    import xxhash

    words = (text or "").encode().lower().split()
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= WORDS:
        return np.array([digest(line)], np.uint64)
    starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)))
    return np.unique(np.array([digest(line[a:b]) for a, b in zip(starts.tolist(), (starts[WORDS:] - 1).tolist(), strict=False)], np.uint64))


def minhashes(h: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(h), 4096):
        np.minimum(least, ((h[None, at : at + 4096] ^ _FLIP[:, None]) * _ODD[:, None]).min(axis=1), out=least)
    return least


def bands(text: str | None) -> list[int]:
    """A number for each band, of the band and its MinHashes."""
    import xxhash

    return [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(minhashes(hashed(text)).reshape(BANDS, ROWS))]


def group_links(sets: list[np.ndarray], sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Positions of links that span the classes of similar sets. With ``sides``, only sets of different sides are compared."""
    sizes = np.array([len(s) for s in sets])
    marks = np.array([(minhashes(s) >> np.uint64(7)).astype(np.uint8) for s in sets]).reshape(len(sets), BANDS * ROWS)
    left = np.arange(len(sets))
    out: list[tuple[int, int]] = []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            q = queue.pop()
            like = (OF * np.minimum(sizes[left], sizes[q]) >= SHARED * np.maximum(sizes[left], sizes[q])) & ((marks[left] == marks[q]).sum(axis=1) >= AGREE)
            if sides is not None:
                like &= sides[left] != sides[q]
            hit = []
            for k in np.flatnonzero(like).tolist():
                a, b = sets[q], sets[left[k]]
                both = len(np.intersect1d(a, b, assume_unique=True))
                if OF * both >= SHARED * (len(a) + len(b) - both):
                    hit.append(k)
            found = left[hit].tolist()
            out += [(q, x) for x in found]
            queue += found
            left = np.delete(left, hit)
    return out


def _group_search(rows: DataFrame) -> DataFrame:
    """Links of all groups; rows is (root, i, j, block, node, text), dealt by (root, i, j). A task holds one group of texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets, blocks = None, [], [], []

        def close() -> pa.RecordBatch:
            found = group_links(sets, np.array(blocks) if key[1] != key[2] else None) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([nodes[a] for a, _ in found], pa.int64()), pa.array([nodes[b] for _, b in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for *group, block, node, text in zip(*(batch.column(k) for k in range(6)), strict=True):
                group = tuple(x.as_py() for x in group)
                if group != key:
                    if key is not None:
                        yield close()
                    key, nodes, sets, blocks = group, [], [], []
                nodes.append(node.as_py()), sets.append(hashed(text.as_py())), blocks.append(block.as_py())
        if key is not None:
            yield close()

    return over_arrow(rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j"), run, "a long, b long")


def near_links(texts: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Links (a, b) that span the classes of similar texts; texts is (node, text), a node a different text, rows may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.array([len(t.as_py() or "") for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array([bands(t.as_py()) for t in batch.column(1)], pa.list_(pa.int64()))], ["node", "chars", "bands"])

    sketches = written(over_arrow(texts.select("node", "text"), run, "node long, chars long, bands array<long>"), "near-sketches")
    rows = sketches.select("node", F.explode("bands").alias("cell"))
    # the least text of a bucket stands for it, so near copies that share many buckets mostly meet under one
    hubs = rows.groupBy("cell").agg(F.min("node").alias("hub"), F.max("node").alias("high")).where("hub < high").select("cell", "hub")
    stars = rows.join(hubs.hint("merge"), "cell").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    bits = near_duplicates(texts, "node", "text")
    of_bits = bits.where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    groups = components(stars.unionByName(of_bits))
    dropped(*bits.reads)

    members = written(groups.join(sketches.groupBy("node").agg(F.first("chars").alias("chars")), "node"), "near-members")
    dropped(groups)
    parts = members.groupBy("root").agg(F.ceil(F.sum("chars") / F.lit(float(group_bytes))).alias("parts"))
    placed = members.join(parts, "root").select("node", "root", "parts", F.pmod(F.xxhash64("node", F.lit(7)), F.greatest("parts", F.lit(1))).alias("block"))
    # never broadcast: the candidates grow with the corpus; the copies of a text are folded on the way
    moved = texts.groupBy("node").agg(F.first("text").alias("text")).join(placed.hint("merge"), "node")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("parts", F.lit(1)) - 1)).alias("other")
    dealt = moved.select("root", "block", "node", "text", other).select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "text")
    links = written(_group_search(dealt), "near-links")
    dropped(sketches, members)
    return links


def first_of_each(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """df's rows that stay, whole: of each class of similar texts the one of smallest id.

    Rows of a null id stay, and link others; rows that repeat id and text stay or go together. Of different texts with
    one id and in one class, one stays. Texts without words (null, empty) are like each other. Any column names; an empty
    table gives an empty result.
    """
    node, low = fresh(df, "near_node", "near_low")
    text, row_id = F.coalesce(F.col(quoted(text_col)), F.lit("")), F.col(quoted(id_col))
    links = near_links(df.select(F.xxhash64(text).alias("node"), text.alias("text")))
    roots = components(links)
    dropped(links)
    ids = df.select(F.xxhash64(text).alias(node), row_id.alias(low)).groupBy(node).agg(F.min(low).alias(low), F.max(low).alias("high"))
    linked = ids.join(roots.select(F.col("node").alias(node), "root"), node, "left").where(F.col("root").isNotNull() | (F.col(low) < F.col("high")))
    order = F.struct(F.col(low).isNull(), F.col(low), F.col(node))
    stays = linked.where("root is not null").groupBy("root").agg(F.min(order)[node].alias("stays"))
    stay = F.col("root").isNull() | (F.col(node) == F.col("stays"))
    # for a text that is linked or has several ids: the id that stays, null where the text goes
    fate = written(linked.join(stays, "root", "left").select(node, F.when(stay, F.col(low)).alias(low)), "near-fates")
    dropped(roots)
    key, kept = fresh(df, "near_key", "near_kept")
    met = df.withColumn(key, F.xxhash64(text)).join(fate.select(F.col(node).alias(key), F.col(low).alias(kept), F.lit(True).alias(node)).hint("merge"), key, "left")
    return met.where(row_id.isNull() | F.col(node).isNull() | F.coalesce(F.col(kept) == row_id, F.lit(False))).select(*columns(df))
