"""Integrity of the archive: each check gives the rows that are wrong, so none if all is well.

Every check is one ordered pass or one aggregation; spans are compared with the lines that really stand between their ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import event_files as E


def in_spans(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """Lines (path, line_no, raw_line) that aren't blank, with first_record and last_record of the span that began last in their file before them or with them; null before the first."""
    begin = spans.select("path", F.col("first_record").alias("line_no"), F.lit(0).alias("kind"), F.struct("first_record", "last_record").alias("span"))
    own = lines.where("raw_line <> ''").select("path", "line_no", F.lit(1).alias("kind"), F.lit(None).cast(begin.schema["span"].dataType).alias("span"))
    w = W.partitionBy("path").orderBy("line_no", "kind").rowsBetween(W.unboundedPreceding, 0)
    return begin.unionByName(own).withColumn("of", F.last("span", ignorenulls=True).over(w)).where("kind = 1").select("path", "line_no", "of.*")


def tiled(spans: DataFrame) -> DataFrame:
    """spans with reached: the furthest end of those before it in its file. One that begins at or before it overlaps."""
    so_far = W.partitionBy("path").orderBy("first_record", "last_record").rowsBetween(W.unboundedPreceding, -1)
    return spans.withColumn("reached", F.max("last_record").over(so_far))


def checks(lines: DataFrame, spans: DataFrame, manifest: DataFrame, stored: DataFrame | None = None) -> dict[str, DataFrame]:
    """By name the rows that are wrong. lines: of the archive's files (path, digest, line_no, raw_line, line_end); spans: of games (path, game_id, first_record, last_record, records, occurrence);
    manifest: path, digest, records; stored: all lines there are, if more than the files' own."""
    placed = in_spans(lines, spans)
    held = placed.where("first_record IS NOT NULL AND line_no <= last_record").groupBy("path", "first_record").agg(F.count(F.lit(1)).alias("n"))
    counted = lines.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    again = E.rebuilt(lines).select("path", F.col("digest").alias("again"))
    return {
        "V01_line_outside_spans": placed.where("first_record IS NULL OR line_no > last_record").select("path", "line_no"),
        "V02_spans_overlap": tiled(spans).where("first_record <= reached").select("path", "first_record"),
        "V03_records_of_span": spans.join(held, ["path", "first_record"], "left").where("records <> coalesce(n, 0)").select("path", "first_record"),
        "V05_records_of_file": manifest.select("path", "records").join(counted, "path", "full_outer").where("NOT (records <=> n)").select("path"),
        "V06_same_bytes_twice": manifest.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path")).where("n > 1").select("path", "n"),
        "V08_lines_without_file": (lines if stored is None else stored).select("path", "digest").distinct().join(manifest.select("path", "digest"), ["path", "digest"], "left_anti"),
        "V09_bytes_differ": manifest.select("path", "digest").join(again, "path", "left").where("NOT (digest <=> again)").select("path"),
    }


def violations(found: dict[str, DataFrame]) -> DataFrame:
    """check, n."""
    out = None
    for name, df in found.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def repeated_ids(spans: DataFrame) -> DataFrame:
    """game_id, n (V04, which is no fault): games that share an id, told apart by occurrence."""
    return spans.groupBy("game_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
