"""Language-model scores of whole texts: a smoothed unigram base and a log-bilinear neural model.

Counts of all tokens of all training rows are gathered by Spark. Every token has a class: the TOP most frequent tokens one each, the end of
a text one, and the others share clusters, whose number grows with the vocabulary. A token's cluster follows from its contexts: the learned representations
of what stands before and after it, over all its occurrences, summed by Spark, and the nearest of the centroids. A token's probability is that of its class, times its smoothed
share of the class. The model is one log-bilinear model: each class has a representation as context and one as prediction; those of the two tokens before, each through the
matrix of its position, are added, and the sum against the representation of a class, plus its bias, is its score. It is trained in numpy: by noise-contrastive estimation
over the counts of pairs of classes, one and two places apart, in all training rows (the noise is drawn by the classes' shares, anew for each round), which finds the representations by
position; then the sum of both is fitted by the gradient of the likelihood, for which these counts are all that is needed. As the exponential of a sum is a product, one product of
matrices gives the normaliser of every pair of contexts, so probabilities are normalised exactly; texts then look them up.

An unseen token is one more in each cluster: its probability is the sum over the clusters. As context it has the average representation of the clusters.

Texts are read twice: to count, and to be written as numbers. Counts of `frequent` tokens at most, those above a level of counts, go to every task, so
they are numbered at once; what a text holds of the others meets its counts and classes in a join. No token is left out.

Defined cases: null texts count as empty; each text has one end token. Ids may be null or repeated: rows are told apart by a
number of their own. The search for centroids begins with the `frequent` tokens, and its last turns go over all. If no row may be learned from, N and V are 0, every class is equally likely, and base_score follows the formula.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, discard, small_batches, text_of, written

#: Tokens with a class of their own.
TOP = 800
#: There are so many clusters times the cube root of the number of distinct tokens. The driver holds about nine square tables of all classes, which bounds both.
CLUSTERS = 4
#: Numbers that describe what stands before a token, and after it, in steps of 1 / FINE; turns of the search for centroids.
SIDE, FINE, TURNS, WHOLE_TURNS = 6, 64, 8, 2
#: Counts sent to every task at most: about 100 bytes each in a worker. LEVELS levels of counts lie between a number and its double.
FREQUENT, LEVELS = 150_000, 8
#: NOISE noise classes weigh against one that occurs; DRAWN are drawn in a round.
DIMENSIONS, ROUNDS, RATE, NOISE, DRAWN = 24, 120, 0.05, 10.0, 20_000
#: Rounds in which the sum of both positions is fitted, and their rate.
JOINT, JOINT_RATE = 60, 0.03
#: Tokens a task counts before it passes them on, and occurrences.
HELD, OCCURRENCES = 500_000, 1_500_000
END = b"\n"  # no token holds white space


def tokens(text: str) -> list[bytes]:
    """Words between white space, A to Z in lower case; the end isn't among them."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(crc_of_id(id_col), F.lit(10)) == 0


def counted(training: DataFrame) -> DataFrame:
    """token (binary), c: over all texts of the column body."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def passed(counts: Counter):
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["token", "c"])

        counts: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                counts.update(tokens(text))
            counts[END] += b.num_rows
            if len(counts) > HELD:
                yield passed(counts)
                counts = Counter()
        yield passed(counts)

    return training.select("body").mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def frequent_counts(counts: DataFrame, frequent: int) -> tuple[list[bytes], np.ndarray, Column]:
    """The tokens above a level of counts, most frequent first, at most so many; their counts; and whether a count c is above that level."""
    level = F.floor(F.log2(F.col("c")) * LEVELS)
    # LEVELS * 64 rows at most.
    sizes = sorted((tuple(r) for r in counts.groupBy(level).agg(F.count(F.lit(1))).collect()), reverse=True)
    cut, total = 64 * LEVELS, 0
    for at, size in sizes:
        total += size
        if total > frequent:
            break
        cut = at
    above = level >= cut
    found = counts.where(above).toArrow()
    pairs = sorted(zip(found.column("c").to_pylist(), found.column("token").to_pylist()), key=lambda x: (-x[0], x[1]))
    return [t for _, t in pairs], np.array([c for c, _ in pairs], dtype=np.int64), above


def numbered(rows: DataFrame, tokens_: list[bytes]) -> DataFrame:
    """doc_id, held_out, stream (each token's place in the list, else its length; the end isn't in it), rare (the tokens that aren't in the list, in order), row."""
    sent = rows.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(tokens_)})

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        of = sent.value.get
        other = len(sent.value)
        for b in batches:
            streams, lengths, rare, rares = [], [0], [], [0]
            for text in b.column(2).to_pylist():
                words = tokens(text)
                places = [of(t, other) for t in words]
                streams.extend(places)
                if other in places:
                    rare.extend([t for t, k in zip(words, places) if k == other])
                lengths.append(len(streams)), rares.append(len(rare))
            lists = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(streams, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists, pa.ListArray.from_arrays(pa.array(rares, pa.int32()), pa.array(rare, pa.binary()))], names=["doc_id", "held_out", "stream", "rare"])

    found = rows.select("doc_id", "held_out", "body").mapInArrow(run, "doc_id long, held_out boolean, stream array<int>, rare array<binary>")
    return found.withColumn("row", F.monotonically_increasing_id())


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """What lists hold, one after the other, and the lists' lengths."""
    return column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def with_ends(column, end: int, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Streams, mapped by `of`, each followed by its end, one after the other; where they start."""
    x, lengths = flat(column)
    x = x.astype(np.int64) if of is None else of[x]
    ends = np.cumsum(lengths)
    return np.insert(x, ends, end), ends - lengths + np.arange(len(lengths))


def befores(x: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place what stands before it and before that; before a stream's start stands its end."""
    padded = np.concatenate([[end, end], x])
    second = padded[: len(x)].copy()
    second[starts] = end
    return padded[1 : len(x) + 1], second


def pairs_of_classes(streams: DataFrame, size: int, distances: tuple[int, ...], of: np.ndarray | None = None) -> list[np.ndarray]:
    """How often class b stands so many places after class a, [a, b], over streams of classes, or of what `of` maps to classes. The last class is the end."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tables = [np.zeros(size * size, dtype=np.int64) for _ in distances]
        held: list[tuple] = []

        def add():
            if held:
                for k, table in enumerate(tables):
                    np.add(table, np.bincount(np.concatenate([x[k] for x in held]), minlength=size * size), out=table)
                held.clear()

        for b in batches:
            x, starts = with_ends(b.column(0), size - 1, of)
            before = befores(x, starts, size - 1)
            held.append(tuple(before[d - 1] * size + x for d in distances))
            if sum(len(h[0]) for h in held) > OCCURRENCES:
                add()
        add()
        for k, table in enumerate(tables):
            cells = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(cells + k * size * size), pa.array(table[cells])], names=["cell", "n"])

    found = written(streams.select("stream").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")), "pairs")
    out = []
    for k in range(len(distances)):
        # At most size * size rows, which grows as the vocabulary to the power 2/3.
        cells = found.where(F.col("cell").between(k * size * size, (k + 1) * size * size - 1)).toArrow()
        table = np.zeros(size * size, dtype=np.float32)
        table[cells.column("cell").to_numpy() - k * size * size] = cells.column("n").to_numpy()
        out.append(table.reshape(size, size))
    discard(found)
    return out


def profiles(streams: DataFrame, held: list[bytes], top: int, sides: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Per token that isn't one of the first `top`: token, c, and p0, p1, ...: over all its occurrences the sum of what describes the token before, then the one after."""
    names = [f"p{k}" for k in range(2 * SIDE)]
    sent = streams.sparkSession.sparkContext.broadcast(held)
    first = np.minimum(np.arange(len(held) + 1), top)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, (before, after) = sent.value, sides
        other = len(held)
        places: list[np.ndarray] = []
        rare: list = []

        def passed():
            which, a, b = np.concatenate([np.zeros((3, 0), dtype=np.int64), *places], axis=1)
            strange = pa.concat_arrays([pa.array([], pa.binary()), *rare]).dictionary_encode()
            which[which == other] += strange.indices.to_numpy()
            c = np.bincount(which, minlength=other)
            some = np.flatnonzero(c)
            sums = [np.bincount(which, weights=side[x, k], minlength=other)[some] for side, x in ((before, a), (after, b)) for k in range(SIDE)]
            own = pa.concat_arrays([pa.array([held[i] for i in some[some < other].tolist()], pa.binary()), strange.dictionary])
            columns = [own, pa.array(c[some].astype(np.int64)), *[pa.array(np.rint(x).astype(np.int64)) for x in sums]]
            return pa.RecordBatch.from_arrays(columns, names=["token", "c", *names])

        for batch in batches:
            x, _ = with_ends(batch.column(0), other + 1)
            classes = np.concatenate([[top + 1], np.append(first, top + 1)[x]])
            at = np.flatnonzero(classes == top)
            places.append(np.array([x[at - 1], classes[at - 1], classes[np.minimum(at + 1, len(classes) - 1)]], dtype=np.int64).reshape(3, -1))
            rare.append(batch.column(1).flatten())
            if sum(p.shape[1] for p in places) > OCCURRENCES or sum(map(len, rare)) > HELD:
                yield passed()
                places, rare = [], []
        yield passed()

    found = streams.select("stream", "rare").mapInArrow(run, ", ".join(["token binary", "c long", *[f"{x} long" for x in names]]))
    return found.groupBy("token").agg(*[F.sum(x).alias(x) for x in ["c", *names]])


def described(model: LogBilinear, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What describes each class that stands before, or after: the SIDE main directions of its representation, whole numbers."""
    out = []
    for x in (model.before @ model.contexts[0], model.after):
        x = (x - shares @ x).astype(np.float64)
        _, directions = np.linalg.eigh((x * shares[:, None]).T @ x)
        y = x @ directions[:, ::-1][:, :SIDE]
        out.append(np.rint(FINE * y / max(1e-9, math.sqrt(float(shares @ (y * y).sum(axis=1))))))
    return out[0], out[1]


def nearest(columns: np.ndarray, c: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The cluster of each token from its sums (a row each) and count."""
    x = columns / (FINE * (c[:, None] + 1.0))
    lengths = (centroids**2).sum(axis=1)
    parts = [(lengths - 2 * (x[k : k + 5000] @ centroids.T)).argmin(axis=1) for k in range(0, len(x), 5000)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def clustered(columns: np.ndarray, c: np.ndarray, clusters: int) -> np.ndarray:
    """Centroids (k-means) of the tokens' mean contexts."""
    x = columns / (FINE * (c[:, None] + 1.0))
    clusters = max(1, min(clusters, len(x)))
    if not len(x):
        return np.zeros((1, 2 * SIDE))
    centroids = x[np.sort(np.random.default_rng(5).choice(len(x), clusters, replace=False))]
    for _ in range(TURNS):
        of = nearest(columns, c, centroids)
        number = np.bincount(of, minlength=clusters)
        sums = np.stack([np.bincount(of, weights=x[:, k], minlength=clusters) for k in range(x.shape[1])], axis=1)
        centroids = np.where(number[:, None] > 0, sums / np.maximum(1, number)[:, None], centroids)
    return centroids


def moved(found: DataFrame, names: list[str], centroids: np.ndarray) -> np.ndarray:
    """The centroids after one turn over all tokens: a task gives a sum for each cluster and column."""
    size = centroids.shape

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums, seen = np.zeros(size), np.zeros(size[0])
        for b in batches:
            columns, c = np.stack([b.column(k).to_numpy() for k in range(1, b.num_columns)], axis=1), b.column(0).to_numpy()
            of = nearest(columns, c, centroids)
            x = columns / (FINE * (c[:, None] + 1.0))
            sums += np.stack([np.bincount(of, weights=x[:, k], minlength=size[0]) for k in range(size[1])], axis=1)
            seen += np.bincount(of, minlength=size[0])
        some = np.flatnonzero(seen)
        # In fixed steps, so that the order of tasks doesn't count.
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some].astype(np.int64)), *[pa.array(np.rint(sums[some, k] * 2**20).astype(np.int64)) for k in range(size[1])]], names=["cluster", "n", *names])

    total = found.select("c", *names).mapInArrow(run, ", ".join(["cluster long", "n long", *[f"{x} long" for x in names]])).groupBy("cluster").agg(*[F.sum(x).alias(x) for x in ("n", *names)]).toArrow()
    out = centroids.copy()
    at, n = total.column("cluster").to_numpy(), total.column("n").to_numpy()
    out[at] = np.stack([total.column(x).to_numpy() for x in names], axis=1) / 2**20 / n[:, None]
    return out


@dataclass
class LogBilinear:
    before: np.ndarray  # representations as context
    contexts: list[np.ndarray]  # a matrix for each position, the nearest first
    after: np.ndarray  # representations as prediction
    bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.before, *self.contexts, self.after, self.bias]

    def scores(self, position: int) -> np.ndarray:
        """What a class at that position adds to the score of each class."""
        return (self.before @ self.contexts[position]) @ self.after.T


class Adam:
    def __init__(self, parts: list[np.ndarray]):
        self.parts, self.moments, self.step = parts, [(np.zeros_like(p), np.zeros_like(p)) for p in parts], 0

    def move(self, grads: list[np.ndarray], rate: float) -> None:
        self.step += 1
        for p, g, (m, v) in zip(self.parts, grads, self.moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.99**self.step)) + 1e-10)


class Gradients:
    """Of the representations, matrices and biases, added up position by position, so that the slopes of one need not wait for those of the other."""

    def __init__(self, model: LogBilinear):
        self.model, (self.before, self.after) = model, (np.zeros_like(model.before), np.zeros_like(model.after))
        self.contexts, self.bias = [np.zeros_like(k) for k in model.contexts], np.zeros_like(model.bias)

    def add(self, position: int, slope: np.ndarray, to_bias: bool = True) -> None:
        """slope: that of each score of the position."""
        m, k = self.model, self.model.contexts[position]
        inner = slope @ m.after
        self.before += inner @ k.T
        self.contexts[position] += m.before.T @ inner
        self.after += slope.T @ (m.before @ k)
        if to_bias:
            self.bias += slope.sum(axis=0)

    def parts(self) -> list[np.ndarray]:
        return [self.before, *self.contexts, self.after, self.bias]


def shares(tables: list[np.ndarray]) -> list[np.ndarray]:
    """Counts as shares of all; those that are shares already stay."""
    total = float(tables[0].sum(dtype=np.float64))
    return tables if abs(total - 1) < 1e-3 else [(x / np.float32(total)).astype(np.float32) for x in tables]


def trained(tables: list[np.ndarray], dimensions: int = DIMENSIONS, rounds: int = ROUNDS) -> LogBilinear:
    """Noise-contrastive estimation over the counts of pairs, a table for each position: tell a pair that occurs from the same first class with noise classes, which weigh NOISE times as much.

    All pairs that occur take part in each round (Adam), against DRAWN classes drawn by their shares for that round."""
    size = len(tables[0])
    rng = np.random.default_rng(3)
    total = float(tables[0].sum(dtype=np.float64))
    noise = ((tables[0].sum(axis=0, dtype=np.float64) + 0.5) / (total + 0.5 * size)).astype(np.float32)
    drawn = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    model = LogBilinear(drawn(size, dimensions), [drawn(dimensions, dimensions) for _ in tables], drawn(size, dimensions), np.log(noise))
    if not total:
        model.bias = np.zeros(size, np.float32)
        model.before[:] = 0
        return model
    seen = shares(tables)
    first = [x.sum(axis=1, keepdims=True) for x in seen]
    drawn_by = np.asarray(noise, np.float64) / np.asarray(noise, np.float64).sum()
    shift = np.log(NOISE * noise)
    adam = Adam(model.parts())
    for step in range(1, rounds + 1):
        against = NOISE * (rng.multinomial(DRAWN, drawn_by) / DRAWN).astype(np.float32)
        grads = Gradients(model)
        for k, (x, n) in enumerate(zip(seen, first)):
            # In place: 1 / (1 + exp(shift - score)), then the slope.
            chance = model.scores(k)
            chance += model.bias - shift
            np.clip(chance, -30, 30, out=chance)
            np.exp(np.negative(chance, out=chance), out=chance)
            chance += 1
            slope = n * against
            slope += x
            slope /= chance
            slope -= x
            grads.add(k, slope)
        adam.move(grads.parts(), RATE * (1 - step / (rounds + 1)))
    return model


def exponentials(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of both, each row from its greatest on. Changes them."""
    for x in (one, two):
        x -= x.max(axis=1, keepdims=True)
        np.exp(x, out=x)
    return one, two


def fitted(model: LogBilinear, tables: list[np.ndarray], rounds: int = JOINT) -> LogBilinear:
    """The model of both positions together, moved by the likelihood's gradient. What stands one place before and two places before a token are neighbours themselves, so the table of neighbours tells how
    often each pair of contexts occurs; only texts' first tokens have the end before them twice."""
    total = float(tables[0].sum(dtype=np.float64))
    if not total:
        return model
    seen = shares(tables)
    pairs = seen[0].T.copy()
    pairs[-1] = 0
    pairs[-1, -1] = seen[0][:, -1].sum()
    # Each part was trained to predict alone.
    for k in model.contexts:
        k *= np.float32(0.7)
    adam = Adam(model.parts())
    for step in range(1, rounds + 1):
        one, two = exponentials(model.scores(0) + model.bias, model.scores(1))
        ratio = one @ two.T
        np.divide(pairs, np.maximum(ratio, np.float32(1e-30), out=ratio), out=ratio)
        grads = Gradients(model)
        slope = ratio @ two
        slope *= one
        slope -= seen[0]
        grads.add(0, slope)
        slope = np.matmul(ratio.T, one, out=slope)
        slope *= two
        slope -= seen[1]
        grads.add(1, slope, to_bias=False)
        adam.move(grads.parts(), JOINT_RATE * (1 - step / (rounds + 1)))
    return model


def normalised(model: LogBilinear, clusters: slice, unseen: np.ndarray, average: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """log10 of what each context adds for each class (one place before, with the bias; two places before), of the normaliser of each pair of contexts, and of an unseen token's probability after
    each. The last context is an unseen token."""
    log = np.float32(math.log(10))
    with_average = lambda x: np.vstack([x, (average @ x[clusters]).astype(np.float32)])
    one, two = with_average(model.scores(0) + model.bias), with_average(model.scores(1))
    # Each row from its greatest on, so that numbers of 32 bits are small ones.
    for x in (one, two):
        x -= x.max(axis=1, keepdims=True)
    a, b = np.exp(one), np.exp(two)
    whole = a @ b.T
    strange = (a[:, clusters] * unseen.astype(np.float32)) @ b[:, clusters].T
    del a, b
    strange /= whole
    for x in (one, two):
        x /= log
    return one, two, np.log10(whole, out=whole), np.log10(strange, out=strange)


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None, frequent: int = FREQUENT) -> DataFrame:
    """One row per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = df.sparkSession
    small_batches(spark)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), (held_out(id_col) if held is None else held).alias("held_out"), text_of(text_col).alias("body"))
    counts = written(counted(rows.where(~F.col("held_out"))), "counts")
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.coalesce(F.sum(F.when(F.col("token") == F.lit(END), F.col("c"))), F.lit(0)).alias("ends")).first()
    n, v, ends = whole.n, whole.v, whole.ends
    known, known_counts, above = frequent_counts(counts.where(F.col("token") != F.lit(END)), frequent)
    top, other = min(TOP, len(known)), len(known)
    numbers = written(numbered(rows, known), "numbered")
    learned = numbers.where(~F.col("held_out"))

    # Clusters of the other tokens: centroids are sought among the frequent ones, then moved by all; then every token's nearest.
    (pairs,) = pairs_of_classes(learned, top + 2, (1,), np.minimum(np.arange(other + 1), top))
    shares = (pairs.sum(axis=0, dtype=np.float64) + 0.5) / (pairs.sum(dtype=np.float64) + 0.5 * len(pairs))
    found = written(profiles(learned, known, top, described(trained([pairs]), shares)), "profiles")
    names = [f"p{k}" for k in range(2 * SIDE)]
    some = found.where(above).toArrow()
    sums, number = np.stack([some.column(x).to_numpy() for x in names], axis=1), some.column("c").to_numpy()
    order = np.lexsort(([*sums.T, number]))
    wanted = math.ceil(CLUSTERS * v ** (1 / 3))
    if len(order) < wanted:
        # Few tokens are frequent: the most frequent ones of all, as many as there are clusters.
        first = found.orderBy(F.desc("c"), "token").limit(wanted).toArrow()
        centroids = clustered(np.stack([first.column(x).to_numpy() for x in names], axis=1), first.column("c").to_numpy(), wanted)
    else:
        centroids = clustered(sums[order], number[order], wanted)
    for _ in range(WHOLE_TURNS):
        centroids = moved(found, names, centroids)

    def placed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            of = nearest(np.stack([b.column(k).to_numpy() for k in range(2, b.num_columns)], axis=1), b.column(1).to_numpy(), centroids)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((of + top).astype(np.int32))], names=["token", "c", "class"])

    classes = written(found.mapInArrow(placed, "token binary, c long, class int"), "classes")
    end = top + len(centroids)
    size, unseen = end + 1, end + 1
    of_class, kinds = np.zeros(size), np.zeros(size)
    for r in classes.groupBy("class").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
        of_class[r["class"]], kinds[r["class"]] = r.c, r.v
    clusters = slice(top, end)
    # A cluster is shared out by smoothed counts; an unseen token is one more in it.
    scales = np.log10(of_class + 0.1 * (kinds + 1))
    unseen_share = 0.1 / (of_class[clusters] + 0.1 * (kinds[clusters] + 1))
    average = (kinds[clusters] + 0.1) / (kinds[clusters] + 0.1).sum()

    scale = n + 0.1 * (v + 1)
    less = math.log10(scale) if scale else 0.0
    base = lambda c: math.log10(c + 0.1) - less if scale else 0.0
    # The frequent tokens by place: class, logarithm of the smoothed count, and of the share of the class. The last place is for the others, filled in below.
    cluster_of = dict(zip(some.column("token").to_pylist(), (nearest(sums, number, centroids) + top).tolist()))
    known_classes = np.array([*range(top), *[cluster_of[t] for t in known[top:]], unseen], dtype=np.int32)
    logs = np.append(np.log10(known_counts + 0.1) - less, 0.0)
    own = np.concatenate([np.zeros(top), np.log10(known_counts[top:] + 0.1) - scales[known_classes[top:-1]], [0.0]])
    sent = spark.sparkContext.broadcast((known_classes, logs, own))

    # The rare tokens with their counts and classes. A token that is in no training row joins with nothing: it is unseen.
    rare = numbers.where(F.size("rare") > 0).select("row", F.posexplode("rare").alias("k", "token")).join(classes.where(~above), "token", "left")
    rare = rare.groupBy("row").agg(F.collect_list(F.struct("k", F.coalesce("class", F.lit(unseen)).alias("class"), F.coalesce("c", F.lit(0)).alias("c"))).alias("found"))

    def completed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known_classes, logs, own = sent.value
        for b in batches:
            (x, lengths), rows_, at = flat(b.column(2)), b.num_rows, b.column(3)
            number = at.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            k, of, c = (y.to_numpy(zero_copy_only=False) for y in at.flatten().flatten())
            row, row_of = np.repeat(np.arange(rows_), number), np.repeat(np.arange(rows_), lengths)
            strange = x == other
            classes = known_classes[x]
            classes[np.flatnonzero(strange)[(np.cumsum(number) - number)[row] + k]] = of
            added = lambda i, y: np.bincount(i, weights=y, minlength=rows_).astype(np.float64)
            rare_logs = np.log10(c + 0.1)
            hits = lengths - number + (ends > 0) + added(row, c > 0)
            bases = base(ends) + added(row_of, logs[x]) + added(row, rare_logs - less) if scale else np.zeros(rows_)
            owns = added(row_of, own[x]) + added(row, np.where(c > 0, rare_logs - scales[np.minimum(of, size - 1)], 0))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.array(classes.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists, pa.array(hits.astype(np.int64)), pa.array(bases), pa.array(owns)], names=["doc_id", "held_out", "stream", "hits", "base_part", "own_part"])

    parts = "doc_id long, held_out boolean, stream array<int>, hits long, base_part double, own_part double"
    streams = written(numbers.join(rare, "row", "left").select("doc_id", "held_out", "stream", "found").mapInArrow(completed, parts), "streams")
    discard(counts, numbers, found, classes)

    learned = streams.where(~F.col("held_out"))
    del some, sums, number, cluster_of, known
    pairs = pairs_of_classes(learned, size, (1, 2))
    counted_pairs = pairs[0].sum(dtype=np.float64)
    for x in pairs:
        x /= np.float32(max(1.0, counted_pairs))
    tables = spark.sparkContext.broadcast(normalised(fitted(trained(pairs), pairs), clusters, unseen_share, average))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        one, two, less, strange = tables.value
        for b in batches:
            t, starts = with_ends(b.column(2), end)
            a, second = befores(t, starts, end)
            known_ = np.minimum(t, end)
            each = np.where(t == unseen, strange[a, second], one[a, known_] + two[second, known_] - less[a, second]).astype(np.float64)
            sums = np.add.reduceat(each, starts) if len(t) else np.zeros(0)
            lengths = pa.array(np.diff(np.append(starts, len(t))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lengths, b.column(3), b.column(4), pa.array(sums + b.column(5).to_numpy())], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    scored = streams.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
