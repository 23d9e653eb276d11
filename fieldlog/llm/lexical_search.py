"""Ranked lexical search: the best documents for each item, by integer term weights, with term-at-a-time and document-at-a-time evaluation joined.

Items are the query set, read in blocks of bounded size; each block is sent to the tasks and meets all documents. Documents are read once a block: a
document leaves its number of terms and, of the block's terms, how often it holds each; that is written, and gives N, L and df. Then tasks read their part of it and
index it in segments of bounded size. For one item and one segment:

* term at a time: the lists no longer than a share of the segment are summed into accumulators, one for each document that they name. Every contribution is at
  least 0, so the tenth-best accumulator is a threshold already;
* document at a time: the accumulators are one more list, whose bound in a window of documents is their maximum there. Windows are gone through in order of
  documents; where the bounds of all lists together stay below the threshold, the window is skipped in every list. In the others the documents are scored in
  full, and the threshold rises.

A task keeps the ten best of each item from segment to segment; Spark ranks those of all tasks. Nothing is approximate.

Defined cases: null texts are empty; empty documents count nowhere, and empty items find nothing. Rows that repeat an item's id and text are one item; texts that share an id
are items of their own, ranked apart. Rows that repeat a document's id are documents of their own. Null document ids come first among equal scores. Other columns of either table are
not read. Empty tables give an empty table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, small_batches, written
from .terms import DIGITS, LETTERS, byte_table, split_terms

TERM_BYTES = byte_table(LETTERS + DIGITS)
#: Results of each item.
BEST = 10
#: Bytes of item texts in a block at most (a longer item is a block of its own); what is sent to a task is of that order.
BLOCK_BYTES = 4 << 20
#: Postings and documents of a segment at most (a single longer document is a segment of its own): about 100 MB in a worker.
SEGMENT_POSTINGS, SEGMENT_DOCS = 2_000_000, 65_536
#: Documents of a window, and the share of a segment's documents up to which a list is short.
WINDOW, SHORT = 256, 1 / 32
FOUND = "item int, doc_id long, score long"


def terms_of(text: bytes) -> Counter:
    """How often each term stands in a text."""
    out: Counter = Counter()
    for part in split_terms(text, TERM_BYTES):
        out.update(part)
    return out


def weight(docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holding + 1)))


def occurrences(vocabulary: dict[bytes, int]):
    """Batches of (doc_id, text as bytes) to documents that have terms: doc_id, n, and of the vocabulary the numbers and counts of those in it."""
    known = vocabulary.keys()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, terms, times = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = terms_of(text.as_py() or b"")
                if not found:
                    continue
                here = sorted((vocabulary[t], found[t]) for t in known & found.keys())
                ids.append(doc_id)
                sizes.append(found.total())
                terms.append([t for t, _ in here])
                times.append([k for _, k in here])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "times"])

    return run


class Segment:
    """Some documents, in order of ids: for each term its documents (numbers in the segment), contributions, windows and their bounds."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, terms: np.ndarray, times: np.ndarray, weights: np.ndarray, docs: int, all_terms: int):
        self.ids, n = ids, len(ids)
        m = 25 + np.array([75 * int(x) * docs // all_terms for x in sizes], np.int64)
        doc = np.repeat(np.arange(n), lengths)
        parts = weights[terms] * (1_000_000_000 * times // (1000 * times + 8 * m[doc]))
        order = np.argsort(terms, kind="stable")
        self.doc, self.part = doc[order], parts[order]
        names, starts, counts = np.unique(terms[order], return_index=True, return_counts=True)
        self.span = {t: (s, s + c) for t, s, c in zip(names.tolist(), starts.tolist(), counts.tolist())}
        self.docs, self.windows = n, -(-n // WINDOW)
        self.edges: dict[int, np.ndarray] = {}
        self.bounds: dict[int, np.ndarray] = {}

    def windows_of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """Of a list: where each window begins in it (and its end), and its greatest contribution there."""
        if term not in self.edges:
            a, b = self.span[term]
            self.edges[term] = a + np.searchsorted(self.doc[a:b], np.arange(self.windows + 1) * WINDOW)
            self.bounds[term] = bound_of(self.doc[a:b], self.part[a:b], self.windows)
        return self.edges[term], self.bounds[term]

    def best(self, item: list[tuple[int, int]], held: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """(-score, number) of the segment's best documents for an item of (term, times); those that stay below ten that are held (score, id) are left out."""
        lists = [(t, k) for t, k in item if t in self.span]
        size = lambda t: self.span[t][1] - self.span[t][0]
        short = [(t, k) for t, k in lists if size(t) <= max(1, self.docs * SHORT)]
        long_ = [(t, k) for t, k in lists if size(t) > max(1, self.docs * SHORT)]
        docs, sums = self.accumulated(short)
        least = tenth([s for s, _ in held], sums)
        edges, bound = np.searchsorted(docs, np.arange(self.windows + 1) * WINDOW), bound_of(docs, sums, self.windows)
        for t, k in long_:
            bound = bound + k * self.windows_of(t)[1]
        found: list[tuple[int, int]] = []
        for w in np.flatnonzero(bound >= max(least, 1)).tolist():
            if bound[w] < least:
                continue
            score = np.zeros(WINDOW, np.int64)
            here = slice(edges[w], edges[w + 1])
            score[docs[here] - w * WINDOW] = sums[here]
            for t, k in long_:
                at = self.windows_of(t)[0]
                part = slice(at[w], at[w + 1])
                score[self.doc[part] - w * WINDOW] += k * self.part[part]
            good = np.flatnonzero(score >= max(least, 1))
            if len(good):
                found += zip((-score[good]).tolist(), (good + w * WINDOW).tolist())
                found = sorted(found)[:BEST]
                least = max(least, tenth([s for s, _ in held], np.array([-s for s, _ in found], np.int64)))
        return found

    def accumulated(self, lists: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Documents of some lists, in order, and the sums of their contributions."""
        if not lists:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        spans = [slice(*self.span[t]) for t, _ in lists]
        docs, at = np.unique(np.concatenate([self.doc[s] for s in spans]), return_inverse=True)
        sums = np.zeros(len(docs), np.int64)
        np.add.at(sums, at, np.concatenate([k * self.part[s] for (_, k), s in zip(lists, spans)]))
        return docs, sums


def bound_of(docs: np.ndarray, parts: np.ndarray, windows: int) -> np.ndarray:
    out = np.zeros(windows, np.int64)
    np.maximum.at(out, docs // WINDOW, parts)
    return out


def tenth(held: list[int], more: np.ndarray) -> int:
    """The tenth-best of scores held and found, of different documents; 0 where there are fewer."""
    if len(held) + len(more) < BEST:
        return 0
    top = more if len(more) <= BEST else np.partition(more, len(more) - BEST)[-BEST:]
    return sorted([*held, *top.tolist()])[-BEST]


def searcher(items: list[list[tuple[int, int]]], weights: list[int], docs: int, all_terms: int):
    """Batches of occurrences() to the best documents of each item in this task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int | None]]] = [[] for _ in items]
        w = np.array(weights, np.int64)
        rank = lambda x: (-x[0], x[1] is not None, x[1] or 0)

        def index(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held).combine_chunks().sort_by([("doc_id", "ascending")])
            ids, (lists, times) = table["doc_id"].to_pylist(), (table[c].combine_chunks() for c in ("terms", "times"))
            # Null ids are sorted last here, and first where scores are equal.
            first = sum(x is None for x in ids)
            order = np.r_[len(ids) - first : len(ids), 0 : len(ids) - first]
            table = table.take(order)
            ids, (lists, times) = table["doc_id"].to_pylist(), (table[c].combine_chunks() for c in ("terms", "times"))
            part = Segment(np.array(ids, object), table["n"].to_numpy(), np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(), times.flatten().to_numpy(), w, docs, all_terms)
            for i, item in enumerate(items):
                if found := part.best(item, best[i]):
                    best[i] = sorted([*best[i], *((-s, ids[d]) for s, d in found)], key=rank)[:BEST]

        held, rows, postings = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            postings += len(batch.column(2).flatten())
            if rows >= SEGMENT_DOCS or postings >= SEGMENT_POSTINGS:
                index(held)
                held, rows, postings = [], 0, 0
        if rows:
            index(held)
        out = [(i, d, s) for i, found in enumerate(best) for s, d in found]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["item", "doc_id", "score"])

    return run


def blocks(items: DataFrame) -> Iterator[list[tuple[int | None, bytes]]]:
    """Items (item_id, text as bytes) in lists of bounded size, fetched one partition at a time."""
    block, size = [], 0
    for row in items.toLocalIterator():
        if block and size + len(row["text"]) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row["item_id"], bytes(row["text"])))
        size += len(row["text"])
    if block:
        yield block


def search(documents: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: of each item (item_id, text) the best documents (doc_id, text)."""
    spark = documents.sparkSession
    small_batches(spark)
    as_bytes = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes)
    out = None
    for block in blocks(items.select(F.col("item_id").cast("long").alias("item_id"), as_bytes).distinct()):
        one = ranked(texts, block)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def ranked(texts: DataFrame, block: list[tuple[int | None, bytes]]) -> DataFrame:
    """The results of one block of items."""
    spark = texts.sparkSession
    counts = [terms_of(text) for _, text in block]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
    held = written(texts.mapInArrow(occurrences(vocabulary), "doc_id long, n long, terms array<int>, times array<long>"), "occurrences")
    total = held.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    # No more rows than the block has terms.
    holding = dict(held.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect())
    weights = [weight(total["docs"], holding.get(i, 0)) for i in range(len(vocabulary))]
    wanted = [sorted((vocabulary[t], k) for t, k in c.items() if weights[vocabulary[t]] > 0) for c in counts]
    found = held.select("doc_id", "n", "terms", "times").mapInArrow(searcher(wanted, weights, total["docs"], total["terms"]), FOUND)
    kept = written(found, "found")
    discard(held)
    names = F.broadcast(spark.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], "item int, item_id long"))
    w = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    best = kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= BEST)
    return best.join(names, "item").select("item_id", "rank", "doc_id", "score")
