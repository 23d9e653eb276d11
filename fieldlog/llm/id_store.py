"""Content-addressed store of token ids.

A rolling hash over the last ids cuts each document's id stream where its low bits are zero, so that equal passages give equal
chunks wherever they stand. A chunk's name is the digest of its ids; each is stored once. A document's recipe lists its chunks.
Manifests hold Merkle roots: over a document's chunk names, and over the documents of each part of the recipes.

Files, all Parquet, below one folder: `chunks` (chunk, n, ids as little-endian 16-bit or 32-bit integers, wide), `recipes`
(doc_id, n_tokens, root, chunks, part, rank, within: its number and first id in its part) in ascending order of doc_id over the parts in turn, each whole in one file,
`manifest` (part, documents, ids, root, first: the ids of all parts before it).

Reading takes every chunk from its file once, recomputes its name and its checksum from the ids and joins those few bytes to the
recipes; the checksum of a document is composed from those of its chunks, which is exact (a checksum of a concatenation follows from
the parts' checksums and lengths). The manifest is compared with the recipes read back: documents of a part that differs from its row, or has
none, aren't verified, and a part of the manifest that has lost all its recipes stops the reading. `documents()` rebuilds the ids themselves.

Defined cases: a null text counts as empty: its stream is the end id alone. Null ids come first, rows with the same id in any order.
An empty table gives empty files.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, partitions, shared_dir, small_batches, text_of, written
from .words import END_ID, default_tokenizer, library_coder

#: Ids that the rolling hash sees.
WINDOW = 16
#: A cut once in so many ids on average, the least and the greatest number between cuts.
AVERAGE, LEAST, MOST = 512, 128, 4096
#: Names that a task remembers so as not to send a chunk's ids again; a repeated chunk beyond that is dropped after the shuffle.
SENT = 500_000
#: Leaves of a node of a part's Merkle tree.
LEAVES = 1024


def mixed(ids: np.ndarray) -> np.ndarray:
    """A random-looking 32-bit number for each id."""
    x = (ids.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    return x ^ (x >> np.uint32(13))


def marks(ids: np.ndarray) -> np.ndarray:
    """Where a stream may be cut: numbers of ids before each place. Streams may stand one after another: what is before a stream reaches its first WINDOW - 1 places only, and none of them is LEAST ids from its start."""
    rolled = mixed(ids)
    width = 1
    # The sum over the last WINDOW numbers, each shifted by its distance; by doubling.
    while width < WINDOW:
        before = rolled[:-width] << np.uint32(width)
        rolled[width:] += before
        width *= 2
    return np.flatnonzero((rolled >> np.uint32(20)) % np.uint32(AVERAGE) == 0) + 1


def ends(places: list[int], n: int) -> list[int]:
    """Ends of the chunks of a stream of n ids that may be cut at places."""
    out, at = [], 0
    for k in places:
        while k - at > MOST:
            at += MOST
            out.append(at)
        if k - at >= LEAST:
            out.append(k)
            at = k
    while n - at > MOST:
        at += MOST
        out.append(at)
    if at < n:
        out.append(n)
    return out


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one id stream; they depend on the ids alone."""
    return ends(marks(ids).tolist(), len(ids))


def merkle(names: list[bytes]) -> bytes:
    """Root of the binary hash tree over the names; an odd one is carried up."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in names] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def name_of(ids: bytes) -> bytes:
    return hashlib.sha256(ids).digest()[:20]


def _byte(crc: int) -> int:
    """What a zero byte makes of a crc32 register."""
    for _ in range(8):
        crc = (crc >> 1) ^ (0xEDB88320 if crc & 1 else 0)
    return crc


def _applied(matrix: tuple[int, ...], crc: int) -> int:
    out, b = 0, 0
    while crc:
        if crc & 1:
            out ^= matrix[b]
        crc >>= 1
        b += 1
    return out


@lru_cache(maxsize=65536)
def zeros_after(n: int) -> tuple[int, ...]:
    """What n zero bytes make of each single bit of a crc32 register."""
    if n == 0:
        return tuple(1 << b for b in range(32))
    half = zeros_after(n // 2)
    twice = tuple(_applied(half, x) for x in half)
    return tuple(_byte(x) for x in twice) if n % 2 else twice


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """crc32 of a concatenation from the parts' (crc32, bytes)."""
    crc = 0
    for own, n in parts:
        crc = _applied(zeros_after(n), crc) ^ own
    return crc


def wide_ids(stored: bytes, wide: bool) -> bytes:
    return stored if wide else np.frombuffer(stored, "<u2").astype("<u4").tobytes()


def write(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> None:
    """Encodes whole texts, each with an end id, and writes the store."""
    spark = df.sparkSession
    path = tokenizer or default_tokenizer()

    def chop(batches: Iterator) -> Iterator:
        import pyarrow as pa

        coder, end, sent = library_coder(path), END_ID.to_bytes(4, "little"), set()
        for b in batches:
            streams = [coder.ids(text) + end for text in b.column(1).to_pylist()]
            stops = np.cumsum([len(x) // 4 for x in streams], dtype=np.int64)
            ids = np.frombuffer(b"".join(streams), "<u4")
            # One rolling hash over the whole batch.
            places = marks(ids)
            firsts = np.searchsorted(places, stops, side="right").tolist()
            narrow = None if len(ids) and ids.max() > 65535 else ids.astype("<u2").tobytes()
            counts, roots, lists, offsets = [], [], [], [0]
            new_names, new_n, new_wide, new_ids = [], [], [], []
            start = low = 0
            for stream, stop, high in zip(streams, stops.tolist(), firsts):
                names, at = [], 0
                for k in ends((places[low:high] - start).tolist(), stop - start):
                    part = stream[4 * at : 4 * k]
                    names.append(name := name_of(part))
                    if name not in sent:
                        if len(sent) >= SENT:
                            sent.clear()
                        sent.add(name)
                        wide = narrow is None and bool((ids[start + at : start + k] > 65535).any())
                        new_names.append(name), new_n.append(k - at), new_wide.append(wide)
                        new_ids.append(part if wide else narrow[2 * (start + at) : 2 * (start + k)] if narrow is not None else ids[start + at : start + k].astype("<u2").tobytes())
                    at = k
                counts.append(stop - start), roots.append(merkle(names)), lists.append(names), offsets.append(len(new_names))
                start, low = stop, high
            fields = {"chunk": pa.array(new_names, pa.binary()), "n": pa.array(new_n, pa.int64()), "wide": pa.array(new_wide, pa.bool_()), "ids": pa.array(new_ids, pa.binary())}
            news = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(list(fields.values()), names=list(fields)))
            columns = [b.column(0), pa.array(counts, pa.int64()), pa.array(roots, pa.binary()), pa.array(lists, pa.list_(pa.binary())), news]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "root", "chunks", "new"])

    small_batches(spark)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col))
    chopped = written(rows.mapInArrow(chop, "doc_id long, n_tokens long, root binary, chunks array<binary>, new array<struct<chunk:binary,n:long,wide:boolean,ids:binary>>"), "chopped")
    # A chunk comes once from each task at most, however many documents hold it.
    sent = chopped.select(F.explode("new").alias("x")).select("x.*")
    sent.groupBy("chunk").agg(F.first("n").alias("n"), F.first("wide").alias("wide"), F.first("ids").alias("ids")).write.option("compression", "zstd").parquet(f"{folder}/chunks")

    # Documents in order of their ids, cut into parts; each partition is a part and a file. Within its part a document has a rank and a place; the parts'
    # first ids are in the manifest.
    ranged = chopped.select("doc_id", "n_tokens", "root", "chunks", F.xxhash64("chunks").alias("tie")).repartitionByRange(partitions(spark), "doc_id", "tie")
    ranged = ranged.sortWithinPartitions("doc_id", "tie").select("doc_id", "n_tokens", "root", "chunks", F.spark_partition_id().alias("part"))

    def placed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        rank = within = 0
        for b in batches:
            n = b.column(1).to_numpy()
            ends = within + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(rank, rank + len(n))), pa.array(ends - n)], names=["doc_id", "n_tokens", "root", "chunks", "part", "rank", "within"])
            rank, within = rank + len(n), int(ends[-1]) if len(n) else within

    ranged.mapInArrow(placed, "doc_id long, n_tokens long, root binary, chunks array<binary>, part int, rank long, within long").write.parquet(f"{folder}/recipes")
    discard(chopped)
    noted = manifest(spark.read.parquet(f"{folder}/recipes"))
    # One row a part: as many as there are shuffle partitions.
    noted.withColumn("first", F.coalesce(F.sum("ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).write.parquet(f"{folder}/manifest")


def rooted(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Per keys: documents, ids, and the root over the roots in order."""
    found = df.groupBy(*keys).agg(F.sum("documents").alias("documents"), F.sum("ids").alias("ids"), F.array_sort(F.collect_list(F.struct(order, "root"))).alias("roots"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            roots = [merkle([x["root"] for x in xs]) for xs in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(roots, pa.binary())], names=[*keys, "documents", "ids", "root"])

    return found.mapInArrow(run, ", ".join([*(f"{k} {found.schema[k].dataType.simpleString()}" for k in keys), "documents long, ids long, root binary"]))


def manifest(recipes: DataFrame) -> DataFrame:
    """Per part of the recipes: part, documents, ids, root. The tree goes by levels: LEAVES documents, then so many of those, then the part."""
    level = recipes.select("part", F.floor(F.col("rank") / LEAVES).alias("block"), "rank", F.lit(1).cast("long").alias("documents"), F.col("n_tokens").alias("ids"), "root")
    level = rooted(level, ["part", "block"], "rank")
    level = rooted(level.withColumn("high", F.floor(F.col("block") / LEAVES)), ["part", "high"], "block")
    return rooted(level, ["part"], "high")


def sound_parts(spark: SparkSession, folder: str) -> list[int]:
    """The parts whose recipes, as read back, are those of the manifest. A part that is in the manifest only has lost its recipes: an error."""
    columns = ["documents", "ids", "root"]
    found = manifest(spark.read.parquet(f"{folder}/recipes")).select("part", F.struct(*columns).alias("found"))
    noted = spark.read.parquet(f"{folder}/manifest").select("part", F.struct(*columns).alias("noted"))
    # One row a part, as many as there are recipe files.
    both = found.join(noted, "part", "full").select("part", F.col("found").isNull().alias("lost"), F.col("found").eqNullSafe(F.col("noted")).alias("same")).collect()
    if lost := sorted(r.part for r in both if r.lost):
        raise ValueError(f"{folder}: the recipes of parts {lost} are missing")
    return [r.part for r in both if r.same]


def recipes_of(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, root, part, chunks: from the recipes and the parts' first ids."""
    first = spark.read.parquet(f"{folder}/manifest").select("part", "first")
    # One row a part.
    recipes = spark.read.parquet(f"{folder}/recipes").join(F.broadcast(first), "part", "left")
    return recipes.select("doc_id", (F.col("first") + F.col("within")).alias("start"), "root", "part", "chunks")


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32, verified (every chunk has its name's content, the recipe its root,
    and the part of the recipes what the manifest says)."""

    def checked(batches: Iterator) -> Iterator:
        from zlib import crc32

        import pyarrow as pa

        for b in batches:
            ids = [wide_ids(x, w) for x, w in zip(b.column(3).to_pylist(), b.column(2).to_pylist())]
            sound = [name_of(x) == name for x, name in zip(ids, b.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([crc32(x) for x in ids], pa.int64()), pa.array(sound, pa.bool_())], names=["chunk", "n", "crc", "sound"])

    def joined(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            crcs, sound, counts = [], [], []
            for root, parts, part in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                crcs.append(joined_crc([(x["crc"] or 0, 4 * (x["n"] or 0)) for x in parts]))
                counts.append(sum(x["n"] or 0 for x in parts))
                sound.append(part in kept and all(x["sound"] for x in parts) and merkle([x["chunk"] for x in parts]) == root)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64()), pa.array(sound, pa.bool_())], names=["doc_id", "start", "n_tokens", "ids_crc32", "verified"])

    small_batches(spark)
    kept = set(sound_parts(spark, folder))
    chunks = spark.read.parquet(f"{folder}/chunks").select("chunk", "n", "wide", "ids").mapInArrow(checked, "chunk binary, n long, crc long, sound boolean")
    parts = recipes_of(spark, folder).select("doc_id", "start", "root", "part", F.posexplode("chunks").alias("at", "chunk")).join(chunks, "chunk", "left")
    whole = parts.groupBy("doc_id", "start", "root", "part").agg(F.array_sort(F.collect_list(F.struct("at", "n", "crc", F.coalesce("sound", F.lit(False)).alias("sound"), "chunk"))).alias("parts"))
    return whole.select("doc_id", "start", "root", "parts", "part").mapInArrow(joined, "doc_id long, start long, n_tokens long, ids_crc32 long, verified boolean")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The stored documents: doc_id, start, ids array<long>."""

    def joined(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            ids = [np.frombuffer(b"".join(wide_ids(x["ids"], x["wide"]) for x in parts), "<u4").astype(np.int64) for parts in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    chunks = spark.read.parquet(f"{folder}/chunks")
    parts = recipes_of(spark, folder).select("doc_id", "start", F.posexplode("chunks").alias("at", "chunk")).join(chunks, "chunk")
    return parts.groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("at", "ids", "wide"))).alias("parts")).mapInArrow(joined, "doc_id long, start long, ids array<long>")


def stored_digests(df: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Writes the store below folder (by default in the shared folder) and reads it back."""
    spark = df.sparkSession
    folder = folder or f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    write(df, folder, **columns)
    return read_digests(spark, folder)
