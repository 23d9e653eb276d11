"""Near-duplicates by ProbMinHash, banding and exact verification.

A document is its five-word shingles, weighted by 1 + ln(times). Each shingle is a Poisson process whose rate is its weight: its arrivals fall
on random components of the signature, and each component keeps the shingle that arrives first. A shingle's process ends as soon
as its next arrival is later than every component's first. Two documents agree in a component with the probability
J = sum over shared d of 1 / sum_i max(a_i/a_d, b_i/b_d), their probability Jaccard (for equal weights, the Jaccard similarity).

Documents with equal shingles and weights are one node from the start, so copies never meet. Nodes that agree in all
components of a band share a bucket. A bucket's members are compared with its smallest member only; connected components of those
links follow. Where a large bucket still holds several components, its members are compared with a few drawn ones of other components, and again;
at last all members of different components of a bucket are compared, which is all that could still join components. So a large group costs
a few comparisons a member, and no pair that shares a bucket and would join components is left out.

A comparison looks at the signatures first: a byte of each component, that is 120 bytes. Equal components have equal bytes, so a pair of J = 0.8
agrees in 96 bytes on average, and in fewer than AGREED (72) with a chance of 1 in 10 million; such pairs are no candidates. Only nodes that agree so with a
node of another component in a bucket have their shingles compared, by the exact probability Jaccard, which must reach THRESHOLD.

BANDS bands of ROWS components bring a pair at 0.8 into a common bucket with a chance of 99.99 %, and more above.

Shingles are compared by 32 bits of their hashes. Two different ones of a pair with n shingles are taken for the same with a chance of about n * n / 2^32
(1 in 50,000 for 300), which moves J by 1 / n: a decision can change only for a J that is as close to the threshold as that.

Defined cases: words are runs of letters, digits and underscores in lower case. A text of one to four words is one shingle. Texts without words
(null, empty) are alone, each its own class. A class's id is its smallest doc_id; rows that repeat an id are one document. Rows with a null id
belong to their class, and stay only if the class has no id at all.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, partitions, sent, small_batches, text_of, written

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 5
#: Buckets with more members are first compared with LEADERS drawn members, TURNS times at most.
WIDE, LEADERS, TURNS = 16, 2, 3
#: Bytes of a signature that a candidate pair has in common at least.
AGREED = 72
#: Members of a bucket whose signatures a task compares with as many others, and bytes of shingles likewise.
BLOCK, BLOCK_BYTES = 2048, 4 << 20
#: What rounding may take from a bound.
SLACK = 1e-6
#: Word hashes, and digests of documents, that a worker remembers.
REMEMBERED = 500_000

WORD = re.compile(r"\w+")
GOLDEN = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose outcome looks random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h


WORDS = WordHashes()


def shingles(text: str, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order, and how often each occurs."""
    words = WORD.findall(text.lower())
    w = np.fromiter(map(WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(size, len(w))
    if not size:
        return w, np.zeros(0, dtype=np.int64)
    n = len(w) - size + 1
    h = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        h = h * np.uint64(0x100000001B3) + w[j : j + n]
        h ^= h >> np.uint64(29)
    return np.unique(mixed(h + np.uint64(size)), return_counts=True)


def signature(h: np.ndarray, weight: np.ndarray, components: int = BANDS * ROWS) -> np.ndarray:
    """The shingle that arrives first in each component."""
    first = np.full(components, np.inf)
    out = np.zeros(components, dtype=np.uint64)
    at, turn = np.zeros(len(h)), 0
    # So many arrivals fill all components, mostly.
    block = max(1, -(-6 * components // len(h)))
    while len(h):
        turns = (np.arange(turn, turn + block, dtype=np.uint64) + np.uint64(1)) * np.uint64(GOLDEN)
        draw = mixed(h[:, None] + turns[None, :])
        gap = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[:, None]
        times = at[:, None] + np.cumsum(gap, axis=1)
        which = (mixed(draw ^ np.uint64(GOLDEN)) % np.uint64(components)).astype(np.int64)
        np.minimum.at(first, which.ravel(), times.ravel())
        won = times == first[which]
        out[which[won]] = np.broadcast_to(h[:, None], won.shape)[won]
        at = times[:, -1]
        alive = at < first.max()
        h, weight, at, turn, block = h[alive], weight[alive], at[alive], turn + block, 2 if turn else block
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    keys = np.arange(BANDS, dtype=np.uint64) * np.uint64(GOLDEN)
    for column in sig.reshape(BANDS, ROWS).T:
        keys = mixed(keys * np.uint64(0x100000001B3) ^ column)
    return keys.view(np.int64)


def signature_bytes(sig: np.ndarray) -> bytes:
    return (sig >> np.uint64(8)).astype(np.uint8).tobytes()


def stored(h: np.ndarray, n: np.ndarray) -> bytes:
    """Shingles as the upper 32 bits of their hashes, then place and number of those that occur more than once."""
    more = np.flatnonzero(n > 1)
    return b"".join([np.uint32(len(h)).tobytes(), (h >> np.uint64(32)).astype("<u4").tobytes(), more.astype("<u4").tobytes(), n[more].astype("<u4").tobytes()])


def loaded(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(data, "<u4")
    k = int(x[0])
    n = np.ones(k)
    places, numbers = np.split(x[k + 1 :], 2)
    n[places] = numbers
    return x[1 : k + 1], 1 + np.log(n)


def shared(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in x and in y of the hashes that both have; both are in order. Equal upper halves within a document are rare; the first counts."""
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    found = x[at] == y
    found[1:] &= y[1:] != y[:-1]
    j = np.flatnonzero(found)
    return at[j], j


def probability_jaccard(a: bytes, b: bytes, least: float = 0.0) -> float:
    """Exact where it can reach `least`; else an upper bound below it."""
    (x, u), (y, v) = loaded(a), loaded(b)
    i, j = shared(x, y)
    all_a, all_b = u.sum(), v.sum()
    # sum_i max(a_i/a_d, b_i/b_d) is no less than the sum of either side alone.
    bound = float(np.minimum(u[i] / all_a, v[j] / all_b).sum())
    if not len(i) or bound < least - SLACK:
        return bound
    pairs, times = np.unique(u[i] + 1j * v[j], return_counts=True)
    p, q = pairs.real, pairs.imag
    only_a, only_b = all_a - u[i].sum(), all_b - v[j].sum()
    s = [only_a / m + only_b / n + (times * np.maximum(p / m, q / n)).sum() for m, n in zip(p, q)]
    return float((times / np.array(s)).sum())


def sketched(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, body_hash, fp (digest of shingles and weights; null without words), and, where its task hasn't given them for this
    fp, bands, sig (a byte of each component) and shingles."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: set[bytes] = set()
        for b in batches:
            fps, bands, sigs, sets = [], [], [], []
            for text in b.column(2).to_pylist():
                h, n = shingles(text)
                fp = hashlib.blake2b(h.tobytes() + n.tobytes(), digest_size=16).digest() if len(h) else None
                fps.append(fp)
                if fp is None or fp in seen:
                    bands.append(None), sigs.append(None), sets.append(None)
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(fp)
                sig = signature(h, 1 + np.log(n))
                bands.append(band_keys(sig).tolist()), sigs.append(signature_bytes(sig)), sets.append(stored(h, n))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary()), pa.array(sets, pa.binary())], names=["doc_id", "body_hash", "fp", "bands", "sig", "shingles"])

    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col)).alias("body_hash"), text_of(text_col))
    return rows.mapInArrow(run, "doc_id long, body_hash long, fp binary, bands array<long>, sig binary, shingles binary")


def with_both(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """a, b and the column of each, as x and y."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col(column).alias("x")), "a")
    return left.join(sets.select(F.col("node").alias("b"), F.col(column).alias("y")), "b").select("a", "b", "x", "y")


def as_rows(column) -> np.ndarray:
    """A binary column of equal lengths as a table of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (a, b) those whose probability Jaccard reaches the threshold. sets: node, sig, shingles."""

    def agree(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            ok = (as_rows(b.column(2)) == as_rows(b.column(3))).sum(axis=1) >= AGREED if b.num_rows else []
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in b.columns[:2]], names=["a", "b"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            ok = [probability_jaccard(x, y, threshold) >= threshold for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in b.columns[:2]], names=["a", "b"])

    close = with_both(pairs, sets, "sig").mapInArrow(agree, "a long, b long")
    return with_both(close, sets, "shingles").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node), for all nodes of edges (a, b): alternating large and small stars until nothing changes."""
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = lambda x: tuple(x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        last, e = e, written(small, "stars")
        now = mark(e)
        discard(last)
        if now == before:
            break
        before = now
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")


def split_buckets(members: DataFrame, joined: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """The members of buckets that hold several components: band, node, component, members (their number), leaders (drawn ones); and the table they are read from."""
    placed = written(members.select("band", "node").join(joined, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component")), "placed")
    drawn = [F.min(F.struct(F.xxhash64("node", "band", F.lit(turn * LEADERS + k)), F.col("node").alias("leader"), F.col("component").alias("leader_in"))) for k in range(LEADERS)]
    leaders = F.array(*[F.struct(F.col(f"d{k}.leader").alias("leader"), F.col(f"d{k}.leader_in").alias("leader_in")) for k in range(LEADERS)])
    split = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("members"), *[d.alias(f"d{k}") for k, d in enumerate(drawn)]).where("low < high")
    return placed.join(split.select("band", "members", leaders.alias("leaders")), "band"), placed


def upper_bounds(held: list[bytes], columns: np.ndarray) -> Callable[[int], np.ndarray]:
    """For a document, what its probability Jaccard with each of the columns can't exceed: the sum over shared shingles of the
    lesser share of the weight. The shingles of all documents are numbered, so a document costs one look-up for all columns together."""
    docs = [loaded(x) for x in held]
    number = np.unique(np.concatenate([x for x, _ in docs]), return_inverse=True)[1].astype(np.int32)
    share = np.concatenate([(w / w.sum()).astype(np.float32) for _, w in docs])
    ends = np.cumsum([len(x) for x, _ in docs]).tolist()
    parts = [slice(end - len(x), end) for end, (x, _) in zip(ends, docs)]
    numbers, shares = (np.concatenate([of[parts[j]] for j in columns]) for of in (number, share))
    starts = np.cumsum([0, *[len(docs[j][0]) for j in columns[:-1]]])
    own = np.zeros(int(number.max()) + 1, dtype=np.float32)

    def bounds(i: int) -> np.ndarray:
        # Backwards, so that of equal hashes the first counts.
        mine = number[parts[i]][::-1]
        own[mine] = share[parts[i]][::-1]
        out = np.add.reduceat(np.minimum(own[numbers], shares), starts, dtype=np.float64)
        own[mine] = 0
        return out

    return bounds


def blocks_of(batches: Iterator) -> Iterator:
    """The groups of equal (band, low, high), each as a table, from batches in that order."""
    import pyarrow as pa

    kept = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([kept, t]).combine_chunks() if kept else t
        keys = np.stack([t.column(c).to_numpy() for c in ("band", "low", "high")])
        starts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()] if t.num_rows else [0]
        for start, end in zip(starts, starts[1:]):
            yield t.slice(start, end - start)
        kept = t.slice(starts[-1])
    if kept is not None and kept.num_rows:
        yield kept


def in_blocks(held: DataFrame, blocks: Column) -> DataFrame:
    """Rows (band, node, component, ...) of buckets that are cut into so many blocks, a copy for each pair of blocks; a pair's rows are in one task, side by side."""
    rows = held.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    rows = rows.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other")
    return rows.repartition(partitions(held.sparkSession), "band", "low", "high").sortWithinPartitions("band", "low", "high")


def agreeing(held: DataFrame, sets: DataFrame) -> DataFrame:
    """Of members of buckets (band, node, component, members) those that agree in AGREED bytes with a member of another component, with which
    they share no bucket of a band before this one: band, node."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for t in blocks_of(batches):
            part, home = t.column("component").to_numpy(), t.column("block").to_numpy()
            sigs, found = as_rows(t.column("sig").combine_chunks()), np.zeros(t.num_rows, bool)
            keys = np.array(t.column("bands").combine_chunks().flatten()).reshape(t.num_rows, -1)
            here = int(np.flatnonzero(keys[0] == t.column("band")[0].as_py())[0])
            rows, columns = np.flatnonzero(home == t.column("low")[0].as_py()), np.flatnonzero(home == t.column("high")[0].as_py())
            for k in range(0, len(rows) if len(columns) else 0, 32):
                some = rows[k : k + 32]
                close = (sigs[some, None] == sigs[None, columns]).sum(axis=2, dtype=np.uint8) >= AGREED
                close &= part[some, None] != part[None, columns]
                i, j = np.nonzero(close)
                for a, b in zip(np.array_split(i, len(i) // 50_000 + 1), np.array_split(j, len(j) // 50_000 + 1)):
                    met_before = (keys[some[a], :here] == keys[columns[b], :here]).any(axis=1)
                    close[a[met_before], b[met_before]] = False
                found[some] |= close.any(axis=1)
                found[columns] |= close.any(axis=0)
            if found.any():
                yield pa.RecordBatch.from_arrays([c.combine_chunks().filter(pa.array(found)) for c in (t.column("band"), t.column("node"))], names=["band", "node"])

    rows = held.select("band", "node", "component", F.ceil(F.col("members") / BLOCK).alias("blocks")).join(sets.select("node", "sig", "bands"), "node")
    return in_blocks(rows, F.col("blocks")).select("band", "low", "high", "block", "node", "component", "sig", "bands").mapInArrow(run, "band long, node long").distinct()


def compared_in_full(held: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links between members of different components of a bucket (band, node, component). Buckets are cut into blocks; a task
    compares two blocks, and a pair is compared in the first bucket that it shares, so no pair is a row unless it is a link. sets: node, sig, bands, shingles."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for t in blocks_of(batches):
            node, part, home = t.column("node").to_numpy(), t.column("component").to_numpy(), t.column("block").to_numpy()
            low, high, own = (t.column(c)[0].as_py() for c in ("low", "high", "band"))
            keys = np.array(t.column("bands").combine_chunks().flatten()).reshape(len(node), -1)
            sigs, held, out = as_rows(t.column("sig").combine_chunks()), t.column("shingles").to_pylist(), ([], [])
            here = int(np.flatnonzero(keys[0] == own)[0])
            rows, columns = np.flatnonzero(home == low), np.flatnonzero(home == high)
            bounds = None
            for i in rows.tolist() if len(columns) else []:
                same = keys[columns] == keys[i]
                ok = same[:, here] & (same.argmax(axis=1) == here) & (part[columns] != part[i]) & ((sigs[columns] == sigs[i]).sum(axis=1) >= AGREED)
                if low == high:
                    ok &= node[columns] > node[i]
                if not ok.any():
                    continue
                bounds = bounds or upper_bounds(held, columns)
                for j in columns[ok & (bounds(i) >= threshold - SLACK)].tolist():
                    if probability_jaccard(held[i], held[j], threshold) >= threshold:
                        out[0].append(min(node[i], node[j])), out[1].append(max(node[i], node[j]))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["a", "b"])

    # As many blocks as the bucket's shingles need.
    whole = held.join(sets.select("node", "bytes"), "node").groupBy("band").agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).alias("blocks"))
    rows = held.select("band", "node", "component").join(whole, "band").join(sets.select("node", "sig", "bands", "shingles"), "node")
    return in_blocks(rows, F.col("blocks")).select("band", "low", "high", "block", "node", "component", "sig", "bands", "shingles").mapInArrow(run, "a long, b long").distinct()


def joined_further(joined: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) after more links (a, b) between nodes; only the components that links touch are gone through."""
    at = joined.select("node", "component")
    ends = links.join(at.select(F.col("node").alias("a"), F.col("component").alias("u")), "a", "left").join(at.select(F.col("node").alias("b"), F.col("component").alias("v")), "b", "left")
    ends = written(ends.select("a", "b", F.coalesce("u", "a").alias("u"), F.coalesce("v", "b").alias("v")), "ends")
    merged = written(components(ends.select(F.col("u").alias("a"), F.col("v").alias("b"))), "merged")
    # Nodes that had no component are their own; they may be new.
    nodes = at.unionByName(ends.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("u").alias("component")), F.struct(F.col("b").alias("node"), F.col("v").alias("component")))).alias("x")).select("x.*")).distinct()
    out = written(nodes.join(merged.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component")), "joined")
    discard(ends, merged)
    return out


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row: doc_id, class_id, class_size, kept, body_hash."""
    rows = written(sketched(df, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "sketches")
    # A node's number is its first row, which holds its bands and shingles.
    nodes = written(rows.where(F.col("fp").isNotNull()).groupBy("fp").agg(F.min("row").alias("node"), F.min("doc_id").alias("least_doc"), F.count(F.lit(1)).alias("size")), "nodes")
    firsts = nodes.select(F.col("node").alias("row"))

    buckets = rows.where(F.col("bands").isNotNull()).select("row", "bands").join(firsts, "row", "left_semi").select(F.col("row").alias("node"), F.explode("bands").alias("band"))
    shared = buckets.groupBy("band").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last").select("band", "leader")
    members = written(buckets.join(shared, "band"), "members")
    met = written(members.select(F.col("node").alias("row")).distinct(), "met")
    sets = rows.where(F.col("shingles").isNotNull()).select("row", "shingles", "sig", "bands").join(sent(met), "row", "left_semi")
    sets = written(sets.select(F.col("row").alias("node"), "shingles", "sig", "bands", F.length("shingles").cast("long").alias("bytes")), "sets")

    tried = written(members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "tried")
    links = written(verified(tried, sets, threshold), "links")
    joined = written(components(links), "joined")
    over = [members, met, sets, tried, links]

    for turn in range(TURNS):
        held, placed = split_buckets(members, joined, turn)
        drawn = held.where(F.col("members") > WIDE).select("node", "component", F.explode("leaders").alias("x")).select("node", "component", "x.*").where("component <> leader_in")
        drawn = drawn.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
        drawn = written(drawn.join(tried, ["a", "b"], "left_anti"), "drawn")
        more = written(verified(drawn, sets, threshold), "more-links")
        over += [drawn, more]
        discard(placed)
        if more.isEmpty():
            break
        tried, before, joined = tried.unionByName(drawn), joined, joined_further(joined, more)
        discard(before)
    held, placed = split_buckets(members, joined, 0)
    close = written(agreeing(held, sets).join(held.select("band", "node", "component"), ["band", "node"]), "close")
    more = written(compared_in_full(close, sets, threshold), "more-links")
    over += [placed, close, more]
    if not more.isEmpty():
        before, joined = joined, joined_further(joined, more)
        discard(before)
    discard(*over)

    in_class = nodes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    classes = in_class.groupBy("component").agg(F.min("least_doc").alias("class_id"), F.sum("size").alias("class_size"))
    by_fp = in_class.select("fp", "component").join(classes, "component").select("fp", "class_id", "class_size")
    # Rows without words need no partner, so they don't meet in the task of the null.
    with_words = rows.where(F.col("fp").isNotNull()).select("doc_id", "body_hash", "fp").join(by_fp, "fp").select("doc_id", "class_id", "class_size", "body_hash")
    alone = rows.where(F.col("fp").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), "body_hash")
    return with_words.unionByName(alone).select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), "body_hash")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df whose document stays, with its columns: one document of each class."""
    # Names of our own, so that no column of df can clash with them.
    own, digest = (f"{x} {uuid.uuid4().hex}" for x in ("id", "hash"))
    gone = written(near_groups(df, id_col, text_col).where(~F.col("kept")).select(F.col("doc_id").alias(own), F.col("body_hash").alias(digest)).distinct(), "gone")
    return df.join(sent(gone), F.col(id_col).cast("long").eqNullSafe(F.col(own)) & (F.xxhash64(text_of(text_col)) == F.col(digest)), "left_anti")
