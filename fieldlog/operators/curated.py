"""Notes of people about plays: tags that no rule can find, from JSON files, beside the derived ones.

A file holds one document, {"entries": [{"game_id", "play_seq", "tags": [...], "note", "citation"}, ...]}. A note names a play by its game's id and its number there, which outlive a rebuild; the notes are
merged into the tags whenever these are written, and a person's word stands before the rule's.

Defined cases: every fault of all files is gathered before any is reported: text that is no JSON, entries without a game, a number or tags, names that no tag has, several entries for a play. Notes on plays
that aren't there or aren't parsed are no fault of the file; `unmatched` lists them. A file without entries is none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlog.functions.tags import NAMES

SCHEMA = "entries array<struct<game_id:string,play_seq:long,tags:array<string>,note:string,citation:string>>, broken string"
#: Faults that the error lists.
LISTED = 50


class CuratedError(ValueError):
    """Notes with faults: problems, (file, game, play, what) each."""

    def __init__(self, n: int, problems: list[tuple]):
        super().__init__(f"{n} faults in curated notes: " + "; ".join(f"{f.rsplit('/', 1)[-1]} {g} {s}: {what}" for f, g, s, what in problems))
        self.problems = problems


def entries(spark: SparkSession, path: str) -> DataFrame:
    """file, game_id, play_seq, tags, note, citation of all files below path; broken where a file is no such JSON."""
    docs = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path).withColumn("file", F.input_file_name())
    return docs.select("file", "broken", F.explode_outer("entries").alias("e")).select("file", "broken", "e.*").where("broken IS NOT NULL OR game_id IS NOT NULL OR play_seq IS NOT NULL OR tags IS NOT NULL")


def problems(found: DataFrame) -> DataFrame:
    """file, game_id, play_seq, problem: all that is wrong with entries."""
    unknown = F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: t.isNull() | ~t.isin(*sorted(NAMES)))
    whole = F.col("broken").isNull()
    what = F.array_compact(F.array(
        F.when(~whole, "no JSON of this kind"), F.when(whole & (F.coalesce(F.trim("game_id"), F.lit("")) == ""), "no game"), F.when(whole & F.col("play_seq").isNull(), "no number of a play"),
        F.when(whole & (F.coalesce(F.size("tags"), F.lit(0)) < 1), "no tags"), F.when(F.size(unknown) > 0, F.concat(F.lit("unknown tags "), F.array_join(unknown, ", ", "null"))),
    ))
    own = found.select("file", "game_id", "play_seq", F.explode(what).alias("problem"))
    twice = found.where("game_id IS NOT NULL AND play_seq IS NOT NULL").groupBy("game_id", "play_seq").agg(F.min("file").alias("file"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return own.unionByName(twice.select("file", "game_id", "play_seq", F.concat("n", F.lit(" entries")).alias("problem")))


def load(spark: SparkSession, path: str) -> DataFrame:
    """game_id, seq, tag, note, citation of all notes below path, or an error that tells of all faults."""
    found = entries(spark, path)
    wrong = problems(found)
    n = wrong.count()
    if n:
        raise CuratedError(n, [tuple(r) for r in wrong.orderBy("file", "game_id", "play_seq", "problem").limit(LISTED).collect()])
    return found.select("game_id", F.col("play_seq").alias("seq"), F.explode(F.array_distinct("tags")).alias("tag"), "note", "citation")


def of_plays(notes: DataFrame, plays: DataFrame, games: DataFrame) -> DataFrame:
    """Notes as rows of play_tags (season, game_key, seq, play_id, tag, confidence, source), for every game of that id."""
    keyed = notes.select("game_id", "seq", "tag").join(games.select("game_id", "game_key"), "game_id").select("game_key", "seq", "tag")
    parsed = plays.where("parse_status <> 'unparsed'").select("season", "game_key", "seq", "play_id")
    return parsed.join(keyed, ["game_key", "seq"]).select("season", "game_key", "seq", "play_id", "tag", F.lit("certain").alias("confidence"), F.lit("curated").alias("source"))


def unmatched(notes: DataFrame, plays: DataFrame, games: DataFrame) -> DataFrame:
    """Notes that no parsed play has the game and number of."""
    there = plays.where("parse_status <> 'unparsed'").select("game_key", "seq").join(games.select("game_key", "game_id"), "game_key").select("game_id", "seq").distinct()
    return notes.join(there, ["game_id", "seq"], "left_anti")


def merged(tags: DataFrame, more: DataFrame) -> DataFrame:
    """play_tags with curated rows: of two rows for one play and tag the curated one stays."""
    key = [c for c in ("season", "game_key", "seq", "play_id", "tag") if c in tags.columns]
    rank = F.when(F.col("source") == "curated", 0).otherwise(1).alias("rank")
    both = tags.unionByName(more).groupBy(*key).agg(F.min(F.struct(rank, "confidence", "source")).alias("x"))
    return both.select(*key, "x.confidence", "x.source")
