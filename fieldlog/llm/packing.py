"""Best-fit packing of documents into sequences of a fixed number of tokens.

The lengths of all pieces make a histogram. Neighbouring lengths share a class, which counts as its longest. The configuration linear program over the classes (how
often to use each way of filling one sequence, so that every class is served) is solved by multiplicative weights: the price of a class falls while it is
served, and a knapsack dynamic program finds the filling of greatest price, until the total is within GAP of the dual bound (or ROUNDS are over: where most pieces take
over a third of the room the gap closes slowly). The fractional counts are
rounded to whole ones that add up to the same; short pieces, and what is left over, go to the open sequence with the least sufficient room, longest first. The program's size depends on the
number of distinct lengths, at most the capacity, never on the number of documents. Its outcome, the plan, says which
ranks of a length go to which sequences. Pieces are ranked within their length by a range sort, so that a length that very many
pieces share is spread over tasks.

Defined cases: a null text counts as empty and is a piece of one end token. Texts above the capacity are cut into pieces
of the capacity, the last shorter. Repeated ids and null ids are packed row by row. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, small_batches, text_of, written
from .words import END_ID, default_tokenizer, library_coder

CAPACITY = 4096
#: Pieces of at most a SHORT-th of the capacity aren't in the program. The others are in CLASSES of neighbouring lengths, and fillings are priced in UNITS of room.
#: Few lengths are priced in tokens.
SHORT, CLASSES, UNITS, FEW = 16, 128, 1024, 16
#: The program ends within GAP of its lower bound, or after so many rounds; how much a round changes the prices.
GAP, ROUNDS, RATE = 1.02, 800, 0.02


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Per piece of each whole text: doc_id, piece, start, length, ids_crc32."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator) -> Iterator:
        from zlib import crc32

        import pyarrow as pa

        coder, end, wide = library_coder(path), END_ID.to_bytes(4, "little"), 4 * capacity
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = coder.ids(text) + end
                for k in range(0, len(ids), wide):
                    part = ids[k : k + wide]
                    for column, x in zip(out, (doc, k // wide, k // 4, len(part) // 4, crc32(part))):
                        column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col)).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def classes_of(counts: dict[int, int], classes: int) -> list[list[int]]:
    """Neighbouring lengths, longest first, in so many classes of about as many pieces each."""
    each, out, held = sum(counts.values()) / classes, [[]], 0
    for length in sorted(counts, reverse=True):
        if held >= each:
            out.append([])
            held = 0
        out[-1].append(length)
        held += counts[length]
    return out


def best_filling(price: np.ndarray, size: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The dearest way to fill a room with classes of these sizes (smallest first), by dynamic programming: its price, and the number of each class."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    upto = np.searchsorted(size, np.arange(room + 1), side="right")
    for r in range(1, room + 1):
        best[r] = best[r - 1]
        if k := upto[r]:
            worth = best[r - size[:k]] + price[:k]
            j = int(worth.argmax())
            if worth[j] > best[r]:
                best[r], last[r] = worth[j], j
    number, r = np.zeros(len(size)), room
    while r > 0:
        if last[r] >= 0:
            number[last[r]] += 1
            r -= size[last[r]]
        else:
            r -= 1
    return float(best[room]), number


def configurations(size: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP, rounds: int = ROUNDS, rate: float = RATE) -> tuple[list[tuple[np.ndarray, float]], float]:
    """The covering program by multiplicative weights: fillings with how often to use each, so that every class is served, and a lower bound of any such total.

    A round prices a piece of each class by the class's weight, takes the dearest filling as often as its scarcest class asks for, and lowers the
    weights of what it serves. The weights make a dual solution, whose value bounds the total from below; the rounds end when the total is
    within `gap` of the bound. Weights start at the classes' sizes, which is a dual solution already."""
    weight, cover = size * demand / room, np.zeros(len(size))
    used: dict[tuple, float] = {}
    total = bound = 0.0
    for k in range(rounds):
        value, number = best_filling(weight / demand, size, room)
        bound = max(bound, weight.sum() / value)
        some = number > 0
        times = float((demand[some] / number[some]).min())
        key = tuple(number.astype(int).tolist())
        used[key] = used.get(key, 0.0) + times
        total += times
        cover += times * number / demand
        weight = weight * np.exp(-rate * times * number / demand)
        if k % 10 == 9 and cover.min() > 0 and total <= gap * bound * cover.min():
            break
    least = cover.min()
    if least <= 0:
        # Rounds that end early leave classes out; each then has fillings of its own.
        for t in np.flatnonzero(cover <= 0):
            number = np.zeros(len(size))
            number[t] = room // size[t]
            used[tuple(number.astype(int).tolist())] = float(demand[t] / number[t])
        least = min(1.0, cover[cover > 0].min()) if (cover > 0).any() else 1.0
    return [(np.array(f), x / least) for f, x in used.items()], bound


def programmed(counts: dict[int, int], left: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """What the program places, as (how many sequences, filling); takes it from `left`. Short pieces aren't in it: they go to the room that is left."""
    large = {length: n for length, n in counts.items() if length > capacity // SHORT}
    if not large:
        return []
    classes = classes_of(large, CLASSES)[::-1]
    grid = 1 if len(large) <= FEW else max(1, capacity // UNITS)
    size = np.array([-(-max(c) // grid) for c in classes])
    fillings, _ = configurations(size, np.array([float(sum(large[x] for x in c)) for c in classes]), capacity // grid)
    # The pieces of a class in order, longest first: how many of each length are taken already.
    queues = [[(length, large[length]) for length in sorted(c, reverse=True)] for c in classes]
    ends = [np.cumsum([n for _, n in q]) for q in queues]
    taken = np.zeros(len(classes), dtype=np.int64)
    bins, part = [], 0.0
    for number, times in sorted(fillings, key=lambda x: (-x[1], tuple(x[0]))):
        # Fractions add up: a filling is used once more whenever they reach a whole.
        part += times
        # The last place of a filling stays open, for the piece that fits it best.
        if number.sum() > 1:
            number = number.copy()
            number[np.flatnonzero(number)[0]] -= 1
        some = np.flatnonzero(number)
        whole = min([int(part + 1e-9), *((ends[t][-1] - taken[t]) // number[t] for t in some)])
        part -= int(part + 1e-9)
        if whole <= 0:
            continue
        slots = [(t, taken[t] + j * whole) for t in some for j in range(int(number[t]))]
        taken[some] += whole * number[some].astype(np.int64)
        # Where a slot's pieces pass on to the next length the filling changes.
        cuts = {0, whole}
        for t, first in slots:
            cuts.update(int(e - first) for e in ends[t][np.searchsorted(ends[t], first, side="right") :] if e < first + whole)
        cuts = sorted(cuts)
        for a, b in zip(cuts, cuts[1:]):
            filling: dict[int, int] = {}
            for t, first in slots:
                length = queues[t][int(np.searchsorted(ends[t], first + a, side="right"))][0]
                filling[length] = filling.get(length, 0) + 1
            bins.append((b - a, filling))
            for length, n in filling.items():
                left[length] -= (b - a) * n
    return bins


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int, int]]:
    """Rows (length, first_rank, ranks, a_sequence, first_sequence, offset, step): rank r of the length, counted from first_rank, goes to
    sequence first_sequence + r // a_sequence at offset + step * (r % a_sequence)."""
    left = dict(counts)
    bins = programmed(counts, left, capacity)
    # Best fit, longest first: by room a list of groups of equal sequences that have that much room.
    room_of: dict[int, list[int]] = {}
    for k, (_, filling) in enumerate(bins):
        room_of.setdefault(capacity - sum(length * n for length, n in filling.items()), []).append(k)
    rooms = np.zeros(capacity + 1, dtype=bool)
    for r in room_of:
        rooms[r] = True
    for length in sorted((x for x, n in left.items() if n), reverse=True):
        n = left[length]
        while n:
            fit = np.flatnonzero(rooms[length:])
            if not len(fit):
                each = capacity // length
                for times, number in ((n // each, each), (1, n % each)):
                    if times and number:
                        bins.append((times, {length: number}))
                        room = capacity - number * length
                        room_of.setdefault(room, []).append(len(bins) - 1)
                        rooms[room] = True
                break
            room = int(fit[0]) + length
            k = room_of[room].pop()
            rooms[room] = bool(room_of[room])
            times, filling = bins[k]
            each = min(room // length, n)
            use = min(times, n // each)
            if use < times:  # the rest stay as they are
                bins.append((times - use, dict(filling)))
                room_of.setdefault(room, []).append(len(bins) - 1)
                rooms[room] = True
            bins[k] = (use, filling | {length: filling.get(length, 0) + each})
            n -= use * each
            room_of.setdefault(room - each * length, []).append(k)
            rooms[room - each * length] = True
    rows, rank, sequence = [], dict.fromkeys(counts, 0), 0
    for times, filling in bins:
        offset = 0
        for length, number in sorted(filling.items(), reverse=True):
            rows.append((length, rank[length], times * number, number, sequence, offset, length))
            rank[length] += times * number
            offset += number * length
        sequence += times
    assert rank == counts, "every piece has a place"
    return rows


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = df.sparkSession
    cut = written(pieces(df, id_col, text_col, capacity, tokenizer), "pieces")
    # One row a length: at most `capacity` rows.
    counts = {r.length: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = plan(counts, capacity) if counts else []
    placed = spark.sparkContext.broadcast(np.array(sorted(rows), dtype=np.int64).reshape(-1, 7))

    # Ranks within a length: a sort by range keeps a length's rows in neighbouring partitions, whose counts give each its first rank.
    spread = written(
        cut.repartitionByRange(partitions(spark), "length", "doc_id", "piece", "start").sortWithinPartitions("length", "doc_id", "piece", "start").withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()),
        "spread",
    )
    first: dict[int, dict[int, tuple[int, int]]] = {}
    seen: dict[int, int] = {}
    # A partition holds a range of lengths, so there are at most `capacity` + partitions rows.
    for r in spread.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("at")).orderBy("part").collect():
        first.setdefault(r.part, {})[r.length] = (seen.get(r.length, 0), r["at"])
        seen[r.length] = seen.get(r.length, 0) + r["n"]
    starts = spark.sparkContext.broadcast(first)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = placed.value
        for b in batches:
            length, part, place = (b.column(i).to_numpy() for i in (3, 5, 6))
            base = np.array([starts.value[p][n] for p, n in zip(part.tolist(), length.tolist())], dtype=np.int64).reshape(-1, 2)
            rank = base[:, 0] + place - base[:, 1]
            # Rows of the plan are sorted by length and first rank.
            wide = int(table[:, 1].max()) + int(table[:, 2].max()) + int(rank.max()) + 2 if len(rank) else 1
            row = table[np.searchsorted(table[:, 0] * wide + table[:, 1], length * wide + rank, side="right") - 1]
            within = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(row[:, 4] + within // row[:, 3]), pa.array(row[:, 5] + row[:, 6] * (within % row[:, 3]))], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return spread.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
