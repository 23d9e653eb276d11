"""Byte-pair encoding of whole texts and its inverse.

Each word's symbols form a doubly linked list; the mergeable neighbours wait in a priority queue ordered by merge rank and
place. The best pair is merged, its new neighbours are queued, and entries whose symbols have changed meanwhile are skipped as
stale. A word of n bytes takes O(n log n). Decoding joins the vocabulary's strings as the tokenizer's missing decoder
does, by one space.

Spark deals out the rows; each worker encodes them in Arrow batches and remembers pieces it has met.

Defined cases: a null text counts as empty and has no tokens; the strings of special tokens stand for their ids, as in the
library; symbols outside the vocabulary are dropped. Repeated rows are each encoded. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_of
from .words import Remembered, byte_symbols, default_tokenizer, plain_lower, splits_at_spaces, word_and_mark


def category_class(major: str) -> str:
    """A character class of all code points of a Unicode category."""
    ranges: list[list[int]] = []
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c))[0] == major:
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


class Bpe:
    """Encoder and decoder for a vocabulary file of a word-end BPE with byte symbols."""

    def __init__(self, path: str):
        import re

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in [*self.ids.items(), *self.special.items()]}
        self.symbols = byte_symbols()
        letters, numbers, spaces = category_class("L"), category_class("N"), "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
        self.word = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+")
        self.specials = re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")") if self.special else None
        self.plain, self.other = Remembered(self._plain_piece), Remembered(self._other_piece)

    def word_ids(self, word: str) -> list[int]:
        symbols = [self.symbols[b] for b in word.encode("utf-8", "surrogatepass")]
        symbols[-1] += self.end
        ranks, n = self.ranks, len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if j < 0 or symbols[i] != left or symbols[j] != right:
                continue  # stale: one of the two has been merged meanwhile
            symbols[i], symbols[j] = left + right, ""
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(queue, (r, i, symbols[i], symbols[k]))
            if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(queue, (r, h, symbols[h], symbols[i]))
        return [x for s in symbols if s and (x := self.ids.get(s)) is not None]

    def _piece(self, piece: str) -> list[int]:
        # Lower case is by code point: the last sigma of a word isn't special here.
        lowered = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
        return [i for w in self.word.findall(lowered) for i in self.word_ids(w)]

    def encode(self, text: str) -> list[int]:
        if self.specials is None:
            return self._piece(text)
        return [i for part in self.specials.split(text) if part for i in ([self.special[part]] if part in self.special else self._piece(part))]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.strings[i] for i in ids])

    def _coded(self, ids: list[int]) -> tuple[str, str, int]:
        return " ".join(map(str, ids)), self.decode(ids), len(ids)

    def _plain_piece(self, piece: str) -> tuple[str, str, int]:
        if piece.isalpha():
            return self._coded(self.word_ids(piece))
        if word_and_mark(piece):
            (a, b, n), (c, d, m) = self.plain[piece[:-1]], self.plain[piece[-1]]
            return f"{a} {c}", f"{b} {d}", n + m
        return self._other_piece(piece)

    def _other_piece(self, piece: str) -> tuple[str, str, int]:
        return self._coded(self._piece(piece))

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, digest of the ids, digest of the decoded text."""
        if not splits_at_spaces(text):
            parts = [self._coded(self.encode(text))]
        elif (low := plain_lower(text)) is not None:
            parts = list(map(self.plain.__getitem__, low.split()))
        else:
            parts = list(map(self.other.__getitem__, text.split()))
        ids, decoded, n = zip(*parts) if parts else ((), (), ())
        if 0 in n:
            ids, decoded = [x for x in ids if x], [x for x, k in zip(decoded, n) if k]
        return sum(n), hashlib.sha256(" ".join(ids).encode()).hexdigest(), hashlib.sha256(" ".join(decoded).encode("utf-8", "surrogatepass")).hexdigest()


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    return Bpe(path)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """One row per row: doc_id, ids array<int>."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        coder = bpe(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([coder.encode(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    small_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col)).mapInArrow(run, "doc_id long, ids array<int>")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """One row per row: doc_id, text. Null ids count as none."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        coder = bpe(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([coder.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    small_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Encodes and decodes whole texts and returns, per row, doc_id, n_tokens, ids_sha256 and decoded_sha256."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        coder = bpe(path)
        for b in batches:
            n, ids, decoded = zip(*map(coder.digest, b.column(1).to_pylist())) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col)).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
