"""Near duplicates by SimHash: fingerprints within a few bits, found by generalised pigeonhole search.

The 64 bits are parted into groups of correlated bits. If two fingerprints differ in at most t bits, then for any
thresholds that add up to t - m + 1 over the m parts (at least -1 each) some part differs in at most its threshold.
For each fingerprint a dynamic program picks the thresholds that keep the estimated number of candidates least, from
the counts of the parts' values; the fingerprint probes all values within the threshold of each part, and candidates
are verified on all 64 bits.

Copies of a fingerprint are folded before anything is joined. Buckets return spanning links, not pairs, and the
classes are the components of these links.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.common import dropped, over_arrow, quoted, written

BITS, SHINGLE, SEED = 64, 4, 42
#: Bits in which linked fingerprints may differ.
DISTANCE = 4
#: Widths of parts by the number of distinct fingerprints: four parts of 16 bits keep the tables of counts at 4 x 65,536 entries;
#: past MANY fingerprints three parts of 22, 21 and 21 bits, whose tables hold 8.4 million counts of 4 bytes.
MANY = 1 << 27
#: Rows from which a bucket is parted into blocks, each pair of which is a task's own group.
BUCKET_ROWS = 1 << 16
#: Shares that the fingerprints of a component are dealt to.
SALTS = 8
#: Fingerprints of a bucket that are compared at a time.
BLOCK = 4096
#: Rows of a bucket that is tested for links together with others.
SMALL = 32


def fingerprints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, fp): SimHash of XXH64 (seed 42) of the text's 4-word shingles, A-Z lower-cased, repeats included.

    A text of fewer words is one shingle; one without words (null, empty) has fingerprint 0. Null ids and repeated rows
    stay; other columns are not read; an empty table gives an empty result.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def of(text: str | None) -> int:
        import xxhash

        words = (text or "").encode().lower().split()
        if not words:
            return 0
        line = b" ".join(words)
        if len(words) <= SHINGLE:
            hashes = [xxhash.xxh64_intdigest(line, SEED)]
        else:
            lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
            starts = np.concatenate(([0], np.cumsum(lengths)))
            digest = xxhash.xxh64_intdigest
            hashes = [digest(line[a:b], SEED) for a, b in zip(starts.tolist(), (starts[SHINGLE:] - 1).tolist(), strict=False)]
        h = np.array(hashes, np.uint64)
        ones = np.zeros(BITS, np.int64)
        for at in range(0, len(h), 65536):
            ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [of(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return over_arrow(df.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text")), run, f"doc_id {id_type}, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how often two bits are both set: 64 x 64 sums from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            n, both = n + len(x), both + (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(BITS * BITS + 1), pa.int32()), pa.array([*both.ravel().tolist(), n], pa.int64())], ["at", "v"])

    sums = np.zeros(BITS * BITS + 1, np.int64)
    for r in fps.select("fp").mapInArrow(run, "at int, v long").groupBy("at").agg(F.sum("v").alias("v")).collect():
        sums[r["at"]] = r["v"]
    return int(sums[-1]), sums[:-1].reshape(BITS, BITS)


def grouped_bits(n: int, both: np.ndarray, widths: tuple[int, ...]) -> list[list[int]]:
    """Bits by part: each part starts from the free bit that is most correlated with others and takes those most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / spread
    np.fill_diagonal(corr, 0)
    free, parts = list(range(BITS)), []
    for width in widths:
        part = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        free.remove(part[0])
        while len(part) < width:
            part.append(max(free, key=lambda b: (corr[b, part].sum(), -b)))
            free.remove(part[-1])
        parts.append(sorted(part))
    return parts


def part_values(fps: np.ndarray, parts: list[list[int]]) -> np.ndarray:
    """Value of each part (row) for each fingerprint (column)."""
    x = fps.view(np.uint64)
    return np.array([sum(((x >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k for k, b in enumerate(part)) for part in parts])


def ball(width: int, radius: int) -> np.ndarray:
    """All masks of exactly ``radius`` bits."""
    return np.array([sum(1 << b for b in bits) for bits in itertools.combinations(range(width), radius)], np.int64)


def allocate(costs: np.ndarray, total: int) -> np.ndarray:
    """Thresholds (rows, parts) of least total cost with sum ``total``; costs is (rows, parts, 1 + thresholds from -1 up).

    Dynamic program over parts and the sum of thresholds so far, for all rows at once.
    """
    rows, m, options = costs.shape
    span = total + m  # a threshold counts from -1, so the sums do from 0
    best = np.full((rows, span + 1), np.inf)
    best[:, 0] = 0
    choice = np.zeros((rows, m, span + 1), np.int8)
    for i in range(m):
        new = np.full_like(best, np.inf)
        for o in range(min(options, span + 1)):
            cand = best[:, : span + 1 - o] + costs[:, i, o, None]
            better = cand < new[:, o:]
            new[:, o:][better] = cand[better]
            choice[:, i, o:][better] = o
        best = new
    out, left = np.zeros((rows, m), np.int64), np.full(rows, span)
    for i in reversed(range(m)):
        out[:, i] = choice[np.arange(rows), i, left]
        left = left - out[:, i]
    return out - 1


def _probes(distinct: DataFrame, parts: list[list[int]], counts: list[np.ndarray], distance: int) -> DataFrame:
    """(part, value, first, second, fp, probe): each fingerprint in its own bucket of each part and in each bucket that it probes.

    A bucket that is estimated (own fingerprints and those one bit away) at more than BUCKET_ROWS is parted into
    blocks by a hash of the fingerprint, and a row goes to the pairs (first, second) of blocks that hold its own.
    """
    widths, total = [len(p) for p in parts], distance - len(parts) + 1
    most = max(0, total + len(parts) - 1)
    masks = [[ball(w, r) for r in range(most + 1)] for w in widths]
    #: a probe costs this many verifications, as it is a row to shuffle
    per_probe = 20.0
    limit = [next((r for r in range(most + 1) if len(masks[i][r]) > 3000), most + 1) for i in range(len(parts))]
    shared = distinct.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                fps = whole.column(0).slice(at, 2048).to_numpy(zero_copy_only=False).astype(np.int64)
                values = part_values(fps, parts)
                costs = np.full((len(fps), len(parts), most + 2), np.inf)
                costs[:, :, 0] = 0
                for i in range(len(parts)):
                    sum_so_far = np.zeros(len(fps))
                    for r in range(min(most + 1, limit[i])):
                        # beyond single flips the mean count of a bucket stands for the count of the ball
                        near = shared.value[i][values[i][:, None] ^ masks[i][r][None, :]].sum(axis=1) if r <= 1 else len(masks[i][r]) * shared.value[i].mean()
                        sum_so_far = sum_so_far + near + per_probe * len(masks[i][r])
                        costs[:, i, r + 1] = sum_so_far
                thresholds = allocate(costs, total)
                part, value, fp, probe, blocks = [], [], [], [], []
                for i in range(len(parts)):
                    part.append(np.full(len(fps), i, np.int32)), value.append(values[i]), fp.append(fps), probe.append(np.zeros(len(fps), bool))
                    for r in range(min(most + 1, limit[i])):
                        who = np.flatnonzero(thresholds[:, i] >= r)
                        if r == 0 or not len(who):
                            continue  # its own bucket holds it already
                        v = (values[i][who][:, None] ^ masks[i][r][None, :]).ravel()
                        part.append(np.full(len(v), i, np.int32)), value.append(v), fp.append(np.repeat(fps[who], len(masks[i][r]))), probe.append(np.ones(len(v), bool))
                for p, v in zip(part, value, strict=True):
                    i = int(p[0]) if len(p) else 0
                    size = shared.value[i][v].astype(np.int64) + sum(shared.value[i][v ^ (1 << b)].astype(np.int64) for b in range(widths[i]))
                    blocks.append(np.maximum(1, -(-size // BUCKET_ROWS)))
                part, value, fp, probe, blocks = (np.concatenate(c) for c in (part, value, fp, probe, blocks))
                # a row of a bucket of n blocks is n rows, one for each block that its own meets
                again = np.repeat(np.arange(len(fp)), blocks)
                other = np.arange(len(again)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                mine = (((fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % blocks)[again]
                first, second = np.minimum(mine, other).astype(np.int32), np.maximum(mine, other).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[again]), pa.array(value[again]), pa.array(first), pa.array(second), pa.array(fp[again]), pa.array(probe[again])],
                    ["part", "value", "first", "second", "fp", "probe"],
                )

    return distinct.select("fp").mapInArrow(run, "part int, value long, first int, second int, fp long, probe boolean")


def bucket_links(own: np.ndarray, probing: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that span the components of one bucket: breadth first, a reached fingerprint is not compared again.

    own: fingerprints whose part has this value; probing: those that reach it by a threshold. Two probing ones are
    compared too, which costs little and loses nothing.
    """
    left = np.unique(np.concatenate([own, probing]))
    links = []
    while len(left) > 1:
        queue, left = left[:1], left[1:]
        while len(queue) and len(left):
            parent = np.full(len(left), -1, np.int64)
            for q in range(0, len(queue), 64):
                open_ones = np.flatnonzero(parent < 0)
                for at in range(0, len(open_ones), BLOCK):
                    some = open_ones[at : at + BLOCK]
                    near = np.bitwise_count(queue[q : q + 64, None].view(np.uint64) ^ left[some][None, :].view(np.uint64)) <= distance
                    hit = near.any(axis=0)
                    parent[some[hit]] = q + near[:, hit].argmax(axis=0)
            found = np.flatnonzero(parent >= 0)
            links += zip(queue[parent[found]].tolist(), left[found].tolist(), strict=True)
            queue, left = left[found], left[parent < 0]
    return links


def _linked_buckets(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, distance: int) -> np.ndarray:
    """Which buckets may hold a link: large ones, and small ones in which two neighbours up to SMALL apart are near.

    All small buckets are tested together, by comparing every row with the k-th after it while both lie in one bucket.
    """
    sizes = ends - starts
    out = sizes > SMALL
    bucket = np.repeat(np.arange(len(starts)), sizes)
    u = fps.view(np.uint64)
    rows = np.flatnonzero(~out[bucket] & (sizes[bucket] > 1))
    for k in range(1, SMALL):
        rows = rows[rows + k < ends[bucket[rows]]]
        if not len(rows):
            break
        near = np.bitwise_count(u[rows] ^ u[rows + k]) <= distance
        out[bucket[rows[near]]] = True
    return out


def _links(probes: DataFrame, distance: int) -> DataFrame:
    """Links of all buckets. Rows are sorted by bucket; a task holds a batch and the bucket that it ends in, 8 bytes a fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])
            out.clear()
            return made

        def close(key: np.ndarray, fp: np.ndarray, probe: np.ndarray) -> None:
            starts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1))
            ends = np.append(starts[1:], len(key))
            for k in np.flatnonzero(_linked_buckets(fp, starts, ends, distance)).tolist():
                mine, asks = fp[starts[k] : ends[k]], probe[starts[k] : ends[k]]
                if not asks.all():
                    out.extend(bucket_links(mine[~asks], mine[asks], distance))

        pending: list[tuple[np.ndarray, ...]] = []
        last = None
        for batch in batches:
            part, value, first, second, fp, probe = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
            if not len(part):
                continue
            # rows of a group are neighbours; a number for each group of this batch, going on from the group left open
            names, probe = np.stack([part.astype(np.int64), value, first.astype(np.int64), second.astype(np.int64)]), probe.astype(bool)
            step = np.concatenate(([not (pending and (names[:, 0] == last).all())], (np.diff(names, axis=1) != 0).any(axis=0)))
            key, last = (pending[-1][0][-1] if pending else 0) + np.cumsum(step), names[:, -1]
            pending.append((key, fp.astype(np.int64), probe))
            if key[-1] != pending[0][0][0]:
                key, fp, probe = (np.concatenate(c) for c in zip(*pending, strict=True))
                cut = int(np.searchsorted(key, key[-1]))
                close(key[:cut], fp[:cut], probe[:cut])
                pending = [(key[cut:], fp[cut:], probe[cut:])]
            if len(out) > 50_000:
                yield flush()
        if pending:
            close(*(np.concatenate(c) for c in zip(*pending, strict=True)))
        yield flush()

    group = ["part", "value", "first", "second"]
    return probes.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node with a link: root is the smallest node of its component.

    Alternates large-star and small-star steps until nothing moves. Every step's links are a written table, so lineage
    stays short and a lost executor costs one step; the step before is deleted. Rows are folded by distinct before they
    move on. The result is a written table.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct()
        old, edges = edges, written(small, "links")
        dropped(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            out = written(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "roots")
            dropped(edges)
            return out
        before = tuple(now)


def _links_of(distinct: DataFrame, distance: int) -> DataFrame:
    n, both = bit_statistics(distinct)
    widths = (16, 16, 16, 16) if n < MANY else (22, 21, 21)
    parts = grouped_bits(n, both, widths)
    counts = [np.zeros(1 << w, np.int32) for w in widths]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(1 << w, np.int64) for w in widths]
        for batch in batches:
            values = part_values(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), parts)
            for i, v in enumerate(values):
                sums[i] += np.bincount(v, minlength=len(sums[i]))
        for i, s in enumerate(sums):
            some = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), i, np.int32)), pa.array(some.astype(np.int64)), pa.array(s[some])], ["part", "value", "n"])

    # at most 4 x 65,536 (8.4 million) rows: bounded by the widths, not by the data
    found = distinct.select("fp").mapInArrow(run, "part int, value long, n long").groupBy("part", "value").agg(F.least(F.sum("n"), F.lit(2**31 - 1)).cast("int").alias("n"))
    table = found.select("part", F.col("value").cast("int").alias("value"), "n").toArrow()
    part, value, n = (table.column(k).to_numpy() for k in range(3))
    for i in range(len(widths)):
        counts[i][value[part == i]] = n[part == i]
    return _links(_probes(distinct, parts, counts, distance), distance)


def near_duplicates(df: DataFrame, id_col: str, text_col: str, distance: int = DISTANCE) -> DataFrame:
    """A row for each row of df: doc_id, fingerprint (16 lowercase hex digits), component_id (smallest id reachable).

    Texts without words (null, empty) have fingerprint 0 and are linked like any. Null ids take part as bridges, and
    are a component's id only if it has no other (then null). Repeated rows stay; other columns are not read; an empty
    table gives an empty result. ``reads`` names the written tables that the result still reads.
    """
    rows = written(fingerprints(df, id_col, text_col), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    roots = components(_links_of(distinct, distance))
    # only linked fingerprints meet by component; salts part a component that holds many of them
    salts = F.array(*[F.lit(k) for k in range(SALTS)])
    linked = roots.withColumnRenamed("node", "fp").join(distinct, "fp").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    lowest = linked.groupBy("root").agg(F.min("low").alias("component_id")).withColumn("salt", F.explode(salts))
    in_group = linked.join(lowest, ["root", "salt"]).select("fp", "component_id", F.lit(True).alias("grouped"))
    of_fp = distinct.join(in_group, "fp", "left").select("fp", F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("low")).alias("component_id"))
    # a table again, so both sides of the last join are dealt by it and a fingerprint of very many copies can be split
    of_fp = written(of_fp, "classes")
    dropped(distinct, roots)
    out = rows.join(of_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
    out.reads = (rows, of_fp)
    return out
