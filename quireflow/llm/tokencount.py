"""Token counts of whole texts without materialising ids.

A block of documents is split into pre-tokens; the pieces of each distinct pre-token are counted once, the counts are
joined to the documents' pre-token frequencies, and the products are summed. The join is local to the block, so there
is no shuffle, and the remembered counts are bounded (REMEMBERED): when the younger half is full, the older one goes,
and words that are met again have moved over by then.
"""

from __future__ import annotations

import functools
import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quireflow.llm.bpe import LONGEST, fold
from quireflow.llm.common import over_arrow

#: Pre-tokens whose counts a Python worker keeps, in two generations; about 150 bytes each, 90 MB in all.
REMEMBERED = 600_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest for 256 upwards."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Counts:
    """Counts by a byte-level BPE file in the JSON format of the tokenizers library."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        if model["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without prefix space and normalizer is counted here")
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: Single bytes rank below every merge; a piece's rank is the order of the merge that makes it.
        self.ranks = {bytes([b]): b for b in range(256)} | {as_bytes(a + b): 256 + k for k, (a, b) in enumerate(merges)}
        self.find = regex.compile(pattern).findall
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.added = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def count(self, text: str) -> int:
        total = 0
        if self.added is not None and self.added.search(text):
            parts = self.added.split(text)
            total, texts = len(parts) - 1, parts
        else:
            texts = [text]
        for part in texts:
            often, known = Counter(self.find(part)), self.known
            fresh = [w for w in often if w not in known]
            if fresh:
                if len(known) > REMEMBERED // 2:
                    self.older, self.known = known, {}
                    known, fresh = self.known, list(often)
                for w in fresh:
                    n = self.older.get(w)
                    n = len(fold(w.encode(), self.ranks)) if n is None else n
                    if len(w) <= LONGEST:
                        known[w] = n
                    else:  # not kept, as a word has no bound
                        total += n * often.pop(w)
            total += sum([known[w] * n for w, n in often.items()])
        return total


@functools.lru_cache(maxsize=2)
def _counts(path: str, pattern: str) -> Counts:
    return Counts(path, pattern)


def token_counts(df: DataFrame, id_col: str, text_col: str, vocabulary: str, pattern: str, limit: int = 1024) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    vocabulary is the path of a byte-level BPE in JSON; added tokens inside a text count as one token each, as the
    library's default. Null texts count as empty (0, 0, false); repeated rows and null ids stay; other columns are not
    read; an empty table gives an empty result.
    """
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counts(vocabulary, pattern)
        for batch in batches:
            sizes, tokens = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                sizes.append(len(text.encode()))
                tokens.append(counts.count(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens], pa.bool_())],
                [id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return over_arrow(df.select(id_col, text_col), run, schema)
