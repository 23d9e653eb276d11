"""Source divergence audit: how far the term shares of each (lang, source) group lie from those of the language's other groups, and which terms set it apart.

Counting is one pass over the texts with a shuffle of counts. The kept terms of a language are dealt to chunks of about CHUNK terms by hash; within a chunk they are numbered from the
most frequent on, so that rare terms, whose counts are mostly equal, are neighbours. Over these ids each group has a segment tree of counts. Trees are hash-consed: a node is the pair of
its children, equal pairs are one node, so groups share every subtree whose counts are identical, as all that a group lacks is one empty subtree a level. Two trees are compared
by going down both at once; a pair of nodes is priced once, wherever and however often it stands, since what it adds to the sum depends on its counts and the groups' totals alone. The levels
above a chunk are sums that Spark makes.

A task holds the trees of a chunk for two blocks of at most about BLOCK groups (sizes vary with the hash), so neither the terms nor the sources of a language bound it.

Defined cases: null text, lang and source are ''. A group without terms has counts of 0. A language without kept terms gives pairs with value 0. Rows that repeat are documents of their
own. Other columns aren't read. An empty table gives an empty table. Shares are exact while a language has at most 9 * 10^13 occurrences of kept terms (plus five times the terms);
beyond that it is an error.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, sent, small_batches, written
from .terms import LETTERS, byte_table, split_terms

TERM_BYTES = byte_table(LETTERS)
#: Documents of a language that hold a kept term at least; what is added to each count; the scale of shares.
LEAST_DOCS, ADDED, SCALE = 30, 5, 1_000_000_000
#: Terms of a chunk and groups of a block, about.
CHUNK, BLOCK = 2048, 128
#: Ranks of terms that are listed.
LISTED = 50
#: Counts that a worker gathers before it passes them on.
GATHERED = 400_000
MOST = 90_000_000_000_000

COUNTED = "lang string, source string, term binary, n long, docs long"
PRICED = "lang string, source string, part string, item string, value long"


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (lang, source, text as bytes) to counts: occurrences of each term, and documents that hold it. Each group also has a row without a term."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows() -> pa.RecordBatch:
        flat = [(lang, source, None, 0, 0) for lang, source in held]
        flat += [(*group, t, n, docs[t]) for group, (times, docs) in held.items() for t, n in times.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in flat], t) for k, t in enumerate((pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()))], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            times, docs = held.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for part in split_terms(text.as_py(), TERM_BYTES):
                times.update(part)
                seen.update(part)
            docs.update(seen)
        if sum(len(times) for times, _ in held.values()) > GATHERED:
            yield rows()
    if held:
        yield rows()


def share(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 5) / (total + 5 * terms)), exactly: the division is made in two steps, neither of which leaves 64 bits."""
    count, whole = count + ADDED, total + ADDED * terms
    first, rest = np.divmod(count * 100_000, whole)
    return 1 + first * 10_000 + rest * 10_000 // whole


class Forest:
    """Hash-consed segment trees over the counts of some groups (rows) for some terms (columns). levels[0] holds the distinct counts; levels[k] the distinct (left, right) pairs of
    numbers in levels[k - 1]; roots the number of each group's tree."""

    def __init__(self, counts: np.ndarray):
        wide = 1 << max(0, int(counts.shape[1] - 1).bit_length())
        # Places without a term hold -1, whose price is 0.
        counts = np.pad(counts, ((0, 0), (0, wide - counts.shape[1])), constant_values=-1)
        leaves, ids = np.unique(counts, return_inverse=True)
        ids = ids.reshape(counts.shape)
        self.leaves, self.pairs = leaves, []
        while ids.shape[1] > 1:
            left, right, base = ids[:, ::2], ids[:, 1::2], int(ids.max()) + 1
            keys, inverse = np.unique(left * base + right, return_inverse=True)
            self.pairs.append((keys // base, keys % base))
            ids = inverse.reshape(left.shape)
        self.roots = ids[:, 0]

    def distances(self, one: np.ndarray, other: np.ndarray, totals: np.ndarray, terms: int) -> np.ndarray:
        """Of the groups one[i] and other[i] (rows): the sum over all terms of the difference of their shares.

        All traversals go down together, a level at a time. A visit is (which totals, node, node): equal visits are one, so each is priced once, and the prices come
        back up by the same numbers. Groups of equal totals share visits too."""
        if not len(one):
            return np.zeros(0, np.int64)
        kinds, kind_of = np.unique(totals, return_inverse=True)
        at = (kind_of[one], kind_of[other], self.roots[one], self.roots[other])
        trail = []
        for left, right in [*reversed(self.pairs), (None, None)]:
            at, back = distinct(at)
            trail.append((back, len(at[0])))
            if left is not None:
                k, j, a, b = at
                at = (np.r_[k, k], np.r_[j, j], np.r_[left[a], right[a]], np.r_[left[b], right[b]])
        k, j, a, b = at
        price = np.zeros(len(k), np.int64)
        count_a, count_b = self.leaves[a], self.leaves[b]
        real = count_a >= 0
        for total_a in np.unique(k[real]):
            for total_b in np.unique(j[real & (k == total_a)]):
                here = real & (k == total_a) & (j == total_b)
                price[here] = np.abs(share(count_a[here], int(kinds[total_a]), terms) - share(count_b[here], int(kinds[total_b]), terms))
        for back, _ in reversed(trail[1:]):
            price = price[back]
            price = price[: len(price) // 2] + price[len(price) // 2 :]
        return price[trail[0][0]]


def distinct(columns: tuple[np.ndarray, ...]) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """The distinct rows of some columns, and for each row which of them it is."""
    order = np.lexsort(columns)
    ordered = [c[order] for c in columns]
    new = np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in ordered])] if len(order) else np.zeros(0, bool)
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    return tuple(c[new] for c in ordered), back


def priced(key: tuple, table: pa.Table) -> pa.Table:
    """One chunk of a language and two of its blocks: the pairs between them, and of the groups of a block with itself the candidates for their terms.

    Rows: groups with their totals (term null), their counts, and the language's own (lead true)."""
    lang, _, low, high = (k.as_py() for k in key)
    data = table.to_pydict()
    groups: dict[tuple[bool, str], int] = {}
    totals, blocks = [], []
    terms = data["terms"][0]
    for lead, source, block, term, n in zip(data["lead"], data["source"], data["block"], data["term"], data["n"]):
        if term is None and (lead, source) not in groups:
            groups[lead, source] = len(totals)
            totals.append(n)
            blocks.append(block)
    own = {term: n for lead, term, n in zip(data["lead"], data["term"], data["n"]) if lead and term is not None}
    names = sorted(own, key=lambda t: (-own[t], t))
    place = {t: i for i, t in enumerate(names)}
    counts = np.zeros((len(totals), len(names)), np.int64)
    for lead, source, term, n in zip(data["lead"], data["source"], data["term"], data["n"]):
        if term is not None:
            counts[groups[lead, source], place[term]] = n
    totals, blocks = np.array(totals, np.int64), np.array(blocks, np.int64)
    if int(totals.max()) + ADDED * terms > MOST:
        raise OverflowError(f"language {lang!r} has more than {MOST} occurrences")
    sources = [s for _, s in groups]
    first = np.array([lead for lead, _ in groups], bool)
    out: list[tuple] = []
    rows = np.flatnonzero(~first)
    if low == high:
        one, other = (rows[x] for x in np.triu_indices(len(rows), 1))
    else:
        a, b = rows[blocks[rows] == low], rows[blocks[rows] == high]
        one, other = np.repeat(a, len(b)), np.tile(b, len(a))
    values = Forest(counts).distances(one, other, totals, terms) if len(names) else np.zeros(len(one), np.int64)
    out += [(lang, sources[i], "pair", sources[j], v) for i, j, v in zip(one.tolist(), other.tolist(), values.tolist())]
    if low == high and len(names):
        whole = np.flatnonzero(first)[0]
        base = share(counts[whole], int(totals[whole]), terms)
        for i in rows.tolist():
            above = np.where(counts[i] > 0, share(counts[i], int(totals[i]), terms) - base, 0)
            good = np.flatnonzero(above > 0)
            best = sorted((-v, names[t]) for v, t in zip(above[good].tolist(), good.tolist()))[:LISTED]
            out += [(lang, sources[i], "term", t.decode(), -v) for v, t in best]
    return pa.Table.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()))], names=["lang", "source", "part", "item", "value"])


def dealt(name: str | Column, into: Column) -> Column:
    """Which of so many chunks or blocks a name belongs to."""
    return F.pmod(F.xxhash64(name), into).cast("int")


def audit(documents: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: the divergence of each group of documents (lang, source, text) from the others of its language, and the terms it has more of than the language."""
    small_batches(documents.sparkSession)
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    texts = documents.select(text_of("lang").alias("lang"), text_of("source").alias("source"), text_of("text").cast("binary").alias("text"))
    # One shuffle: by language and term, which serves the sums of groups and those of the language.
    by_term = texts.mapInArrow(counted, COUNTED).repartition("lang", "term")
    sums = by_term.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = W.partitionBy("lang", "term")
    held = sums.withColumn("in_docs", F.sum("docs").over(of_term)).where(F.col("term").isNull() | (F.col("in_docs") >= LEAST_DOCS)).select("lang", "source", "term", "n")
    held = written(held, "counts")

    own = held.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("n"))
    whole = own.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("all_n"))
    groups = held.groupBy("lang", "source").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("group_n"))
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(whole, "lang", "left").select("lang", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("all_n", F.lit(0)).alias("all_n"), F.greatest(F.lit(1), F.ceil(F.col("terms") / CHUNK)).cast("int").alias("chunks"), F.ceil(F.col("sources") / BLOCK).cast("int").alias("blocks"))
    langs = sent(written(langs, "languages"))

    nothing = F.lit(None).cast("binary")
    block = dealt("source", F.col("blocks"))
    group_rows = groups.join(langs, "lang").select("lang", F.lit(False).alias("lead"), "source", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), nothing.alias("term"), F.col("group_n").alias("n"), "terms", "blocks")
    lead_rows = langs.select("lang", F.lit(True).alias("lead"), F.lit("").alias("source"), F.lit(-1).alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), nothing.alias("term"), F.col("all_n").alias("n"), "terms", "blocks")
    chunk = dealt("term", F.col("chunks"))
    count_rows = held.where("term IS NOT NULL").join(langs, "lang").select("lang", F.lit(False).alias("lead"), "source", block.alias("block"), chunk.alias("chunk"), "term", "n", "terms", "blocks")
    own_rows = own.join(langs, "lang").select("lang", F.lit(True).alias("lead"), F.lit("").alias("source"), F.lit(-1).alias("block"), chunk.alias("chunk"), "term", "n", "terms", "blocks")
    rows = group_rows.unionByName(lead_rows).unionByName(count_rows).unionByName(own_rows)
    # A block meets itself and each other; what is of the whole language goes everywhere.
    to = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least("block", b).alias("low"), F.greatest("block", b).alias("high")))
    every = F.flatten(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda a: F.transform(F.sequence(a, F.col("blocks") - 1), lambda b: F.struct(a.alias("low"), b.alias("high")))))
    spread = rows.withColumn("to", F.explode(F.when(F.col("block") < 0, every).otherwise(to))).select("lang", "chunk", "to.low", "to.high", "lead", "source", "block", "term", "n", "terms")
    found = written(spread.groupBy("lang", "chunk", "low", "high").applyInArrow(priced, PRICED), "priced")

    pairs = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = pairs.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    w = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= LISTED)
    out = both.withColumn("rank", F.row_number().over(w)).unionByName(terms.select("lang", "source", "part", "item", "value", "rank"))
    discard(held)
    return out
