"""Exact dedup by a Grace hash join's partitioning: records go to buckets by hash, buckets that don't fit are parted
again into spill files, and an open-addressing table compares complete contents.

Before the shuffle each task folds its own copies of a text into one record, so a text that a third of all rows share
crosses the network once per task. What returns to the documents is keyed by the digest of the content.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.common import WS_CHARS, over_arrow, quoted, spill_folder

#: Bytes of contents that a table may hold before its bucket is parted.
TABLE_BYTES = 24 << 20
#: Rows that are taken out of an Arrow batch at a time.
SLICE = 256
#: Spill files a bucket is parted into, and how often: 16 x 4 bits are the whole hash.
FAN_OUT, MAX_DEPTH = 16, 16
_DROP = WS_CHARS.encode()

#: (hash, digest, content, rows, most code points, id that stays, whole row that stays or None)
Record = tuple[int, bytes, bytes, int, int, object, object]


def better(n: int, row_id: object, other_n: int, other_id: object) -> bool:
    """Whether a row stays rather than the other: more code points, then the smaller id, null last."""
    if n != other_n:
        return n > other_n
    return row_id is not None and (other_id is None or row_id < other_id)


class OpenTable:
    """Open addressing with linear probing; a slot matches only if the complete contents are equal.

    A record's first slot is the top bits of its hash times an odd number: all bits of the hash move them, so records that
    the recursion has sorted by their low bits still spread over the whole table.
    """

    def __init__(self, bits: int = 10):
        self.shift = 64 - bits
        self.slots: list[int] = [-1] * (1 << bits)
        self.rows: list[list] = []
        self.bytes = 0

    def add(self, rec: Record) -> None:
        h, digest, content, rows, n, row_id, whole = rec
        mask = len(self.slots) - 1
        at = self.first(h)
        while (k := self.slots[at]) >= 0:
            row = self.rows[k]
            if row[0] == h and row[2] == content:
                row[3] += rows
                if better(n, row_id, row[4], row[5]):
                    row[4], row[5], row[6] = n, row_id, whole
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.rows)
        self.rows.append([h, digest, content, rows, n, row_id, whole])
        self.bytes += len(content) * (1 if whole is None else 2) + 200
        if 2 * len(self.rows) > len(self.slots):
            self._grow()

    def first(self, h: int) -> int:
        return (h * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> self.shift

    def _grow(self) -> None:
        size = 2 * len(self.slots)
        self.shift -= 1
        self.slots, mask = [-1] * size, size - 1
        for k, row in enumerate(self.rows):
            at = self.first(row[0])
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k


def _read(path: str) -> Iterator[Record]:
    with open(path, "rb") as f:
        end = os.fstat(f.fileno()).st_size
        while f.tell() < end:
            yield pickle.load(f)


def grouped(records: Iterable[Record], folder: str, depth: int = 0, limit: int = TABLE_BYTES) -> Iterator[list]:
    """A row for each different content. What a table can't hold is parted by the next bits of the hash, recursively."""
    table, files = OpenTable(), None
    for rec in records:
        if files is None:
            table.add(rec)
            if table.bytes > limit and depth < MAX_DEPTH:
                files = [open(os.path.join(folder, f"{depth}-{k}"), "wb") for k in range(FAN_OUT)]  # noqa: SIM115
                for row in table.rows:
                    pickle.dump(tuple(row), files[row[0] >> 4 * depth & FAN_OUT - 1])
                table = OpenTable()
        else:
            pickle.dump(rec, files[rec[0] >> 4 * depth & FAN_OUT - 1])
    if files is None:
        yield from table.rows
        return
    for f in files:
        f.close()
    for f in files:
        yield from grouped(_read(f.name), folder, depth + 1, limit)
        os.remove(f.name)


def normalised(text: str | None) -> bytes:
    return (text or "").encode().translate(None, _DROP)


def _folded(id_col: str, limit: int):
    """Per task: one record for each text that it holds, flushed whenever the table is full."""

    def flush(table: OpenTable) -> pa.RecordBatch:
        return _batch(table.rows, id_col, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = OpenTable()
        for batch in batches:
            for row_id, text in zip(batch.column(0), batch.column(1), strict=True):
                row_id, text = row_id.as_py(), text.as_py() or ""
                content = normalised(text)
                digest = hashlib.sha256(content).digest()
                table.add((int.from_bytes(digest[:8], "little"), digest, content, 1, len(text), row_id, None))
                if table.bytes > limit:
                    yield flush(table)
                    table = OpenTable()
        if table.rows:
            yield flush(table)

    return run


def _batch(rows: list[list], id_col: str, whole: bool) -> pa.RecordBatch:
    cols = {"digest": pa.array([r[1] for r in rows], pa.binary())}
    if whole:
        cols["content"] = pa.array([r[2] for r in rows], pa.binary())
    cols |= {"rows": pa.array([r[3] for r in rows], pa.int64()), "most": pa.array([r[4] for r in rows], pa.int64()), "keep_id": pa.array([r[5] for r in rows])}
    return pa.RecordBatch.from_pydict(cols)


def classes(df: DataFrame, id_col: str, text_col: str, limit: int = TABLE_BYTES) -> DataFrame:
    """(digest, keep_id, most, group_size) for each different text, white space apart."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[id_col].dataType
    as_arrow = to_arrow_type(kind)
    fold = _folded(id_col, limit)

    def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.set_column(b.schema.names.index("keep_id"), "keep_id", b.column("keep_id").cast(as_arrow))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from typed(fold(batches))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[Record]:
            for b in batches:
                for digest, content, rows, most, keep in zip(*(b.column(c) for c in ("digest", "content", "rows", "most", "keep_id")), strict=True):
                    d = digest.as_py()
                    # the leading bytes chose the task; the spill files take other ones
                    yield int.from_bytes(d[8:16], "little"), d, content.as_py(), rows.as_py(), most.as_py(), keep.as_py(), None

        with tempfile.TemporaryDirectory(dir=spill_folder()) as folder:
            out: list[list] = []
            for row in grouped(records(), folder, 0, limit):
                out.append(row)
                if len(out) >= 4096:
                    yield from typed(iter([_batch(out, id_col, False)]))
                    out = []
            if out:
                yield from typed(iter([_batch(out, id_col, False)]))

    id_type = kind.simpleString()
    rows = df.select(F.col(quoted(id_col)).alias("row_id"), F.col(quoted(text_col)).alias("text"))
    records = over_arrow(rows, local, f"digest binary, content binary, rows long, most long, keep_id {id_type}")
    out = over_arrow(records.repartition("digest"), merged, f"digest binary, rows long, most long, keep_id {id_type}")
    return out.select("digest", "keep_id", "most", F.col("rows").alias("group_size"))


def exact_dedup(df: DataFrame, id_col: str, text_col: str, limit: int = TABLE_BYTES) -> DataFrame:
    """A row for each row of df: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row of most code points stays, then of the smallest id (a null id only if there is no other).
    Null texts are empty texts. Rows that repeat id and text together count in group_size each, and are kept or not
    together, as one record written twice. Other columns are not read. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    bare = F.translate(text, WS_CHARS, "")
    rows = df.select(F.col(quoted(id_col)).alias("doc_id"), F.unhex(F.sha2(F.encode(bare, "UTF-8"), 256)).alias("digest"), F.char_length(text).cast("long").alias("n"))
    found = classes(df, id_col, text_col, limit)
    return rows.join(found, "digest").select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("most"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def kept_rows(df: DataFrame, id_col: str, text_col: str, limit: int = TABLE_BYTES) -> DataFrame:
    """df's rows that stay, whole, one for each different text (white space apart): what a pipeline goes on with.

    The row of most code points stays, then of the smallest id, null last; of rows equal in these any one. Null texts are
    empty texts. Any columns and column names; an empty table gives an empty result. The rows themselves go through the
    partitioning, so texts cross the network once and nothing is joined back.
    """
    # names by position inside, as Spark's Arrow functions take no dots in names
    names, schema = [f"c{k}" for k in range(len(df.columns))], df.toDF(*[f"c{k}" for k in range(len(df.columns))]).schema
    at_id, at_text = df.columns.index(id_col), df.columns.index(text_col)

    def record(row: tuple) -> Record:
        text = row[at_text] or ""
        content = normalised(text)
        digest = hashlib.sha256(content).digest()
        return int.from_bytes(digest[8:16], "little"), digest, content, 1, len(text), row[at_id], row

    def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield from zip(*(part.column(k).to_pylist() for k in range(len(names))), strict=True)

    def batches_of(rows: Iterable[list], kind: pa.Schema, with_digest: bool) -> Iterator[pa.RecordBatch]:
        buffered: list[list] = []

        def made() -> pa.RecordBatch:
            cols = [pa.array([r[6][k] for r in buffered], kind.field(k).type) for k in range(len(names))]
            if with_digest:
                return pa.RecordBatch.from_arrays([*cols, pa.array([r[1] for r in buffered], pa.binary())], [*names, "digest"])
            return pa.RecordBatch.from_arrays(cols, names)

        size = 0
        for r in rows:
            buffered.append(r)
            size += len(r[2])
            if len(buffered) >= 4096 or size > limit // 2:
                yield made()
                buffered, size = [], 0
        if buffered:
            yield made()

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, kind = OpenTable(), None
        for batch in batches:
            kind = batch.schema
            for row in rows_of(batch):
                table.add(record(row))
                if table.bytes > limit:
                    yield from batches_of(table.rows, kind, True)
                    table = OpenTable()
        if table.rows:
            yield from batches_of(table.rows, kind, True)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.Schema] = []

        def records() -> Iterator[Record]:
            for b in batches:
                kinds.append(b.schema) if not kinds else None
                for row in rows_of(b):
                    yield record(row)

        with tempfile.TemporaryDirectory(dir=spill_folder()) as folder:
            found = grouped(records(), folder, 0, limit)
            first = next(found, None)
            if first is not None:
                import itertools

                yield from batches_of(itertools.chain([first], found), kinds[0], False)

    from pyspark.sql.types import BinaryType, StructField, StructType

    dealt = over_arrow(df.toDF(*names), local, StructType([*schema.fields, StructField("digest", BinaryType())])).repartition("digest")
    return over_arrow(dealt, merged, schema).toDF(*df.columns)
