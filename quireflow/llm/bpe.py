"""Byte-level BPE: encoding and decoding of whole texts by a table of ranked merges.

The merges are folded once per distinct word (a match of the split pattern) of a block of documents, never per
occurrence; a document's ids are then the concatenation of its words' ids, and decoding concatenates the binary
pieces of the ids. Nothing is shuffled: a task needs its own documents and the rank table, whose size is fixed by the
vocabulary. The words that a worker remembers are bounded by REMEMBERED; beyond it they are folded again.

``fold_words`` is the same fold as Spark higher-order functions over byte arrays with a literal rank map. It serves
distinct words in a DataFrame; README.md has the figures for which documents take the Arrow path.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.llm.common import over_arrow

#: Distinct words whose ids a Python worker keeps, about 150 bytes each, and the longest word that it keeps.
REMEMBERED, LONGEST = 150_000, 256
#: Rows of an Arrow batch that are encoded together.
BLOCK = 256


@functools.lru_cache(maxsize=4)
def ranks_from_tiktoken(path: str) -> dict[bytes, int]:
    """Piece -> rank of a rank file: lines of base64 piece and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}


def fold(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the adjacent pair of the lowest rank, leftmost first, merges until no pair has a rank."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > 64:
        return _fold_long(parts, ranks)
    none = len(ranks) + (1 << 30)
    pair = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while pair:
        low = min(pair)
        if low == none:
            break
        i = pair.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i < len(pair):
            pair[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            pair[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _fold_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same fold with a heap and linked neighbours: n log n, for words without bound such as runs of one letter."""
    import heapq

    n = len(parts)
    left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
    heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, joined = heapq.heappop(heap)
        j = right[i] if alive[i] else -1
        if j < 0 or parts[i] + parts[j] != joined:
            continue
        parts[i], alive[j] = joined, False
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        for a in (left[i], i):
            b = right[a] if a >= 0 else -1
            if b >= 0 and (r := ranks.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, parts[a] + parts[b]))
    return [ranks[p] for p, there in zip(parts, alive, strict=True) if there]


class Encoder:
    """Encodes texts with words remembered as the little-endian unsigned 32-bit ids that they fold to."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        import regex

        self.ranks, self.find, self.limit = ranks, regex.compile(pattern).findall, remembered
        self.known: dict[str, bytes] = {}
        size = max(ranks.values(), default=-1) + 1
        self.pieces: list[bytes] = [b""] * size
        for piece, rank in ranks.items():
            self.pieces[rank] = piece

    def encode(self, text: str) -> bytes:
        words = self.find(text)
        known = self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        if len(known) > self.limit:
            known.clear()
        long: dict[str, bytes] = {}
        for w in set(words).difference(known):
            (known if len(w) <= LONGEST else long)[w] = np.array(fold(w.encode(), self.ranks), "<u4").tobytes()
        return b"".join([known[w] if w in known else long[w] for w in words])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(ranks_from_tiktoken(path), pattern)


def encode_decode(df: DataFrame, id_col: str, text_col: str, rank_file: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, SHA-256 of the ids as little-endian u32, SHA-256 of the decoded bytes, ids if asked for.

    rank_file must be at the same place on every executor (it comes with the installed vocabulary package).
    A null text counts as empty: no ids, both digests those of no bytes. Repeated rows and null ids stay as they are;
    other columns are not read, so their names can't clash. Empty tables give empty results.
    """
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(rank_file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                counts, ids_sha, out_sha, kept = [], [], [], []
                for text in part.column(1).to_pylist():
                    ids = enc.encode(text or "")
                    counts.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    out_sha.append(hashlib.sha256(enc.decode(ids)).hexdigest())
                    if with_ids:
                        kept.append(np.frombuffer(ids, "<u4").astype(np.int32))
                cols = [part.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return over_arrow(df.select(id_col, text_col), run, schema)


def decode_ids(df: DataFrame, ids_col: str, out_col: str, rank_file: str, pattern: str) -> DataFrame:
    """df with the bytes that the ids stand for as binary out_col (null for null ids, no bytes for none).

    Repeated rows stay; an id that the table doesn't have fails the row's task; an empty table gives an empty result.
    """
    from pyspark.sql.types import BinaryType, StructField, StructType

    schema = StructType([*df.schema.fields, StructField(out_col, BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _encoder(rank_file, pattern).pieces
        for batch in batches:
            at = batch.schema.names.index(ids_col)
            out = [None if ids is None else b"".join(pieces[i] for i in ids) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, out_col])

    return over_arrow(df, run, schema)


class RankSlots:
    """A literal rank map of constant-time lookups: every piece (hex) lies in one of the two slots that its hashes name.

    Filled by displacement (cuckoo hashing); spark's xxhash64 of the piece and 0 or 1 names the slots.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.size = 1 << max(4, (3 * len(ranks)).bit_length())
        pieces = {p.hex().upper(): r for p, r in ranks.items()}
        self.keys: list[str] = [""] * self.size
        for piece in pieces:
            turn = 0
            for _ in range(500):
                at = self.places(piece)[turn]
                piece, self.keys[at] = self.keys[at], piece
                if not piece:
                    break
                turn = 1 - self.places(piece).index(at) if len(set(self.places(piece))) == 2 else 1 - turn
            else:
                raise ValueError("no room for a piece")
        self.ranks = [pieces.get(k, -1) for k in self.keys]

    def places(self, piece: str) -> tuple[int, int]:
        import xxhash

        first = xxhash.xxh64_intdigest(piece.encode(), 42)
        return tuple(xxhash.xxh64_intdigest(k.to_bytes(4, "little"), first) % self.size for k in (0, 1))

    def lookup(self) -> Callable[[Column], Column]:
        """piece -> rank, null for none."""
        keys, ranks = F.split(F.lit(",".join(self.keys)), ",", -1), F.split(F.lit(",".join(map(str, self.ranks))), ",").cast("array<int>")

        def of(piece: Column) -> Column:
            # the size is a power of two, so the low bits of the signed hash are those of the unsigned one
            slot = [F.xxhash64(piece, F.lit(k)).bitwiseAND(F.lit(self.size - 1)).cast("int") for k in (0, 1)]
            return F.when(F.get(keys, slot[0]) == piece, F.get(ranks, slot[0])).when(F.get(keys, slot[1]) == piece, F.get(ranks, slot[1]))

        return of


def fold_words(words: DataFrame, word_col: str, ranks: dict[bytes, int]) -> DataFrame:
    """words with ``ids``: array<int>, folded by higher-order functions over the word's byte array.

    Each step of the fold looks up the ranks of all adjacent pairs in a literal rank map, and merges the leftmost pair
    of the lowest rank; a word of n bytes takes at most n - 1 steps. Null words give null ids.
    """
    lookup = RankSlots(ranks).lookup()
    none = F.lit(2**31 - 1)
    code = F.hex(F.encode(F.col(word_col), "UTF-8"))
    parts = F.transform(F.sequence(F.lit(1), F.length(code), F.lit(2)), lambda i: F.substr(code, i, F.lit(2)))

    def rank_of(piece: Column) -> Column:
        return F.coalesce(lookup(piece), none)

    def step(state: Column, _: Column) -> Column:
        ranked = F.transform(
            F.sequence(F.lit(1), F.size(state) - 1),
            lambda i: F.struct(rank_of(F.concat(F.element_at(state, i), F.element_at(state, i + 1))).alias("r"), i.alias("i")),
        )

        def merged(best: Column) -> Column:
            i = best["i"]
            joined = F.array(F.concat(F.element_at(state, i), F.element_at(state, i + 1)))
            return F.when(best["r"] == none, state).otherwise(F.concat(F.slice(state, F.lit(1), i - 1), joined, F.slice(state, i + 2, F.size(state))))

        return F.when(F.size(state) < 2, state).otherwise(F.transform(F.array(F.array_min(ranked)), merged)[0])

    start = F.when(F.length(code) == 0, F.array().cast("array<string>")).otherwise(parts)
    done = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(code), F.lit(1))), start, step)
    return words.withColumn("ids", F.when(F.col(word_col).isNotNull(), F.transform(done, rank_of)))
