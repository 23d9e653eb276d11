"""Exact deduplication by content sort, in DataFrame operations alone.

Sampled splitters cut the order (first bytes, digest, id) into ranges; each range is sorted by Spark's external sort,
which puts equal texts side by side; each row is compared in full with the row before it. The id is part of the order, so
that a text with very many copies is spread over as many ranges as its rows need; runs of equal rows that meet at the ends of
ranges are joined afterwards through two rows a range.

Defined cases: a null text counts as empty, so null and empty texts are one group. Null ids sort last, and a group keeps
a null id only if it has no other. Of rows with the same text and id one stays, any of them, since they don't differ
in what is compared; of a null and an empty text with the same id, either. An empty table gives an empty table. Other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import partitions, text_of, written

#: Ranges for each shuffle partition: with several, hashing the range number deals them out evenly.
RANGES_A_PARTITION = 4
#: Sampled rows for each splitter.
SAMPLED = 20
LAST = "~"


def id_key(column: str, keep: str) -> Column:
    """16 hex digits in the order of the ids, smallest first, or largest first where the largest stays; nulls last."""
    shifted = F.col(column).cast("long").bitwiseXOR(F.lit(-(2**63)).cast("long"))
    ordered = F.bitwise_not(shifted) if keep == "max" else shifted
    return F.coalesce(F.lpad(F.hex(ordered), 16, "0"), F.lit(LAST))


def splitters(keys: DataFrame, ranges: int) -> list[str]:
    """At most ranges - 1 keys of 114 characters, which cut the sampled keys evenly."""
    rows = keys.count()
    wanted = ranges * max(4, min(SAMPLED, 200_000 // ranges))
    sampled = keys if rows <= wanted else keys.sample(fraction=min(1.0, wanted / rows), seed=17)
    found = sorted(r[0] for r in sampled.collect())
    return sorted({found[i * len(found) // ranges] for i in range(1, ranges)}) if found else []


def range_of(key: Column, cuts: list[str]) -> Column:
    """How many cuts are not above the key, by binary search."""
    if not cuts:
        return F.lit(0)
    steps = len(cuts).bit_length()
    padded = F.split(F.lit(",".join(cuts + [LAST * 2] * (2**steps - 1 - len(cuts)))), ",")
    return F.aggregate(
        F.array(*[F.lit(2**b) for b in reversed(range(steps))]),
        F.struct(key.alias("key"), F.lit(0).alias("at")),
        lambda acc, step: F.struct(acc["key"].alias("key"), F.when(F.element_at(padded, acc["at"] + step) <= acc["key"], acc["at"] + step).otherwise(acc["at"]).alias("at")),
        lambda acc: acc["at"],
    )


def sorted_runs(df: DataFrame, id_col: str, text_col: str, keep: str, carried: Column, ranges: int | None) -> DataFrame:
    """Per row: id, body, digest, carried, range, run (its number in the range), first (of its run), rows (of the run), head (the id that stays, with its
    place in the order), at_end (whether the first or last run of a range begins here)."""
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    ranges = ranges or RANGES_A_PARTITION * partitions(df.sparkSession)
    # The row travels as one struct under names of our own, so that no column of df can clash with them.
    text = text_of(text_col)
    digest = F.sha2(text, 256)
    content = F.concat(F.hex(F.substring(F.encode(text, "utf-8"), 1, 16)), F.lit("!"), digest)
    rows = df.select(F.col(id_col).cast("long").alias("id"), text.alias("body"), content.alias("content"), id_key(id_col, keep).alias("turn"), carried.alias("carried"))
    cuts = splitters(rows.select(F.concat("content", F.lit("!"), "turn")), ranges)
    dealt = rows.withColumn("range", range_of(F.concat("content", F.lit("!"), "turn"), cuts)).repartition(partitions(df.sparkSession), "range")

    order = W.partitionBy("range").orderBy("content", "body", "turn")
    equal = F.coalesce(F.lag("body").over(order) == F.col("body"), F.lit(False))
    runs = dealt.withColumn("first", ~equal).withColumn("run", F.sum(F.col("first").cast("int")).over(order))
    run, whole = W.partitionBy("range", "run"), W.partitionBy("range")
    runs = runs.withColumn("rows", F.count(F.lit(1)).over(run)).withColumn("head", F.min(F.struct("turn", "id")).over(run)).withColumn("runs", F.max("run").over(whole))
    at_end = F.col("first") & ((F.col("run") == 1) | (F.col("run") == F.col("runs")))
    return runs.select("id", "body", F.substring("content", -64, 64).alias("digest"), "carried", "range", "run", "first", "rows", "head", at_end.alias("at_end"))


def met_at_ends(ends: DataFrame) -> DataFrame:
    """Of runs at the ends of ranges (range, run, rows, head, end_body) those that other ranges go on with: range, run, all_rows, best_id, best_range."""
    met = ends.groupBy("end_body").agg(F.sum("rows").alias("all_rows"), F.min(F.struct("head", "range")).alias("best"), F.collect_list(F.struct("range", "run")).alias("at")).where(F.size("at") > 1)
    # Two rows a range at most, of about 100 bytes each: 1 MB for 5,000 ranges, whatever the rows of df.
    return F.broadcast(met.select(F.explode("at").alias("at"), "all_rows", "best").select("at.range", "at.run", "all_rows", F.col("best.head.id").alias("best_id"), F.col("best.range").alias("best_range"), F.lit(True).alias("joined")))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", ranges: int | None = None) -> DataFrame:
    """One row per row of df: id, keep_id, group_size, kept, text_sha256.

    keep: whether the row with the smallest ("min") or largest ("max") id of equal texts stays.
    """
    runs = sorted_runs(df, id_col, text_col, keep, F.lit(0), ranges)
    found = written(runs.select("id", "range", "run", "first", "rows", "head", "digest", F.when(F.col("at_end"), F.col("body")).alias("end_body")), "exact")
    met = met_at_ends(found.where(F.col("end_body").isNotNull()).select("range", "run", "rows", "head", "end_body"))
    return found.join(met, ["range", "run"], "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("joined"), F.col("best_id")).otherwise(F.col("head.id")).alias("keep_id"),
        F.coalesce("all_rows", "rows").cast("long").alias("group_size"),
        (F.col("first") & (F.col("joined").isNull() | (F.col("range") == F.col("best_range")))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", ranges: int | None = None) -> DataFrame:
    """The rows of df that stay, with its columns. Only the first row of each run is written; its text travels once."""
    rebuilt = {text_col} if df.schema[text_col].dataType == StringType() else set()
    carried = F.struct(F.col(text_col).isNull().alias("no text"), F.struct(*[F.col(c) for c in df.columns if c not in rebuilt]).alias("columns"))
    runs = sorted_runs(df, id_col, text_col, keep, carried, ranges)
    found = written(runs.where("first").select("carried", "body", "range", "run", "rows", "head", "at_end"), "firsts")
    met = met_at_ends(found.where("at_end").select("range", "run", "rows", "head", F.col("body").alias("end_body")))
    stay = found.join(met, ["range", "run"], "left").where(F.col("joined").isNull() | (F.col("range") == F.col("best_range")))
    text = F.when(~F.col("carried")["no text"], F.col("body"))
    return stay.select(*[(text if c in rebuilt else F.col("carried")["columns"][c]).alias(c) for c in df.columns])
