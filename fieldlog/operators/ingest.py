"""Event files in, all derived tables out.

    build(spark, files, root)     archives the files below `files` and derives
    refresh(spark, files, root)   archives new and changed files, and derives the seasons in which a game's own lines are new, changed or gone
    derive(spark, root, seasons)  derives again from the archive, for all seasons or for some, whose folders alone are read and rewritten

Below root: archive/ (see `archive`) and tables/: games, game_spans, game_info, plays, advances, credits, sequences, play_tags, tags, lineup_entries, comments, earned. All but tags are laid
out by season. The records of a game are shuffled by game once for its log; what the tables need of the folded log is written once, and each table is a projection of that.

Defined cases: a root that holds an archive already gets the files that it lacks; changed files are refused by build. A season all of whose games are gone loses its rows in every table. No file at all is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlog.functions.moves import STEP, texts, told
from fieldlog.operators import curated as K
from fieldlog.operators import earned as N
from fieldlog.operators import star
from fieldlog.operators.fold import replayed, short_halves
from fieldlog.operators.search import Tables
from fieldlog.sources import archive as A
from fieldlog.sources import event_files as E
from fieldlog.sources import game_log as L
from fieldlog.sources import sinks

TABLES = ("games", "game_spans", "game_info", "plays", "advances", "credits", "sequences", "play_tags", "lineup_entries", "comments", "earned")
#: What the tables need of the folded log beside `star.NEEDED`: the facts of earned runs, and what records around the plays told.
MORE = tuple(dict.fromkeys([*N.READ, "resolved", "pitcher", "responsible", "scheduled_innings", "after_ladj", "replay_reversed", "has_placed_runner", "count", "pitches", "line_no", "island", "placed_before"]))


def folded(recs: DataFrame, said: DataFrame | None = None) -> DataFrame:
    """Archived records to the replayed, scored and tagged frame, with what lies between the plays: placed runners, marks of batting out of order, reversed calls, pitchers. said: what the plays' texts say, where that has
    been set down."""
    log = L.game_log(recs)
    said = texts(log) if said is None else said
    log = L.out_of_order(told(log, said.select("text", *STEP)))
    # A verdict belongs to a game's play; play_id alone would let two games' plays meet only if their hashes did.
    called = L.comments(recs).where("reversed IS NOT NULL AND play_id IS NOT NULL").groupBy("game_key", "play_id").agg(F.bool_or("reversed").alias("replay_reversed"))
    log = log.join(called, ["game_key", "play_id"], "left").withColumn("replay_reversed", F.coalesce("replay_reversed", F.lit(False)))
    return N.facts(star.finished(replayed(log, order="line_no", said=said)))


def frees(step: Callable) -> Callable:
    """step(spark, ...) with its shuffles deleted as they are done with."""

    @wraps(step)
    def run(spark: SparkSession, *args, **kwargs):
        with sinks.freed(spark):
            return step(spark, *args, **kwargs)

    return run


@frees
def derive(spark: SparkSession, root: str, seasons: Sequence[int] | None = None, curated: str | None = None) -> None:
    """Writes the tables of the archived games. curated: where notes of people are (see `curated`); faults in them are an error before anything is written."""
    recs, at = L.archived(spark, f"{root}/archive", seasons), f"{root}/tables"
    notes = None if curated is None else K.load(spark, curated)
    ids = recs.select("game_key", "game_id").distinct()
    add = None if notes is None else lambda frame: K.of_plays(notes, frame, ids)
    # Tables can always be derived again, so what is rewritten goes first: a season may have no rows any more in some of them.
    for name in (*TABLES, "derived"):
        sinks.drop_partitions(spark, f"{at}/{name}", seasons)
    # Set down, the texts are read once and their size is known before the fold starts: where they are few, its rows aren't shuffled by text and by game again.
    said = sinks.set_down(texts(L.game_log(recs)), f"{at}/.texts")
    frame = star.write(folded(recs, said), at, MORE, add)
    sinks.drop_partitions(spark, f"{at}/.texts", None)
    if seasons is not None:
        frame = frame.where(F.col("season").isin(*seasons))
    plays = spark.read.parquet(f"{at}/plays")
    plays = plays if seasons is None else plays.where(F.col("season").isin(*seasons))
    verdicts = N.adjudicated(frame).join(plays.select("season", "game_key", "seq", "play_id", "inning", "half", "batting_team"), ["game_key", "seq"])
    made = {"games": L.games(recs, plays, short_halves(frame)), "game_spans": L.game_spans(recs), "game_info": L.game_info(recs), "lineup_entries": L.lineup_entries(recs), "comments": L.comments(recs), "earned": verdicts}
    for name, df in made.items():
        sinks.replace_partitions(df.repartition("season", "game_key"), f"{at}/{name}")


@frees
def build(spark: SparkSession, files: str, root: str, seasons: Sequence[int] | None = None, curated: str | None = None) -> None:
    """Event files below a folder to the archive and the tables below root."""
    A.publish(spark, E.event_files(spark, files), f"{root}/archive")
    derive(spark, root, seasons, curated)


def vintages(spark: SparkSession, root: str) -> DataFrame:
    """season, game_key, digest (of its file now), state: of each game of the archive or of the tables. missing: not derived yet; gone: no longer archived; stale: its lines differ; reissued: its file differs, its own lines
    don't; current."""
    now = L.contents(L.archived(spark, f"{root}/archive"))
    was = spark.read.parquet(f"{root}/tables/games").select("game_key", F.col("season").alias("was_season"), F.col("digest").alias("was_digest"), F.col("content").alias("was_content"))
    both = now.join(was, "game_key", "full_outer")
    state = F.when(F.col("was_content").isNull(), "missing").when(F.col("content").isNull(), "gone").when(F.col("content") != F.col("was_content"), "stale").when(F.col("digest") != F.col("was_digest"), "reissued").otherwise("current")
    return both.select(F.coalesce("season", "was_season").alias("season"), "game_key", "digest", state.alias("state"))


def adopt(spark: SparkSession, root: str, reissued: DataFrame) -> None:
    """Games of reissued files whose own lines are the same take the new digest; nothing is derived."""
    at = f"{root}/tables/games"
    seasons = [r[0] for r in reissued.select("season").distinct().collect()]
    if seasons:
        held = spark.read.parquet(at).where(F.col("season").isin(*seasons))
        new = held.join(reissued.select("game_key", F.col("digest").alias("new")), "game_key", "left").withColumn("digest", F.coalesce("new", "digest")).drop("new")
        # Spark can't overwrite what it reads, so the rows are set down first.
        sinks.replace_partitions(sinks.set_down(new.select(*held.columns), f"{root}/tables/.games"), at)


@frees
def refresh(spark: SparkSession, files: str, root: str, curated: str | None = None) -> DataFrame:
    """Archives new and changed files and brings the tables into line with them: seasons (few numbers) with a missing, stale or gone game are derived anew, in others reissued games adopt their digests.
    Gives the vintages as they were before."""
    A.publish(spark, E.event_files(spark, files), f"{root}/archive", refresh=True)
    found = sinks.set_down(vintages(spark, root), f"{root}/tables/.vintages")
    seasons = sorted(r[0] for r in found.where("state IN ('missing', 'stale', 'gone')").select("season").distinct().collect())
    there = {r[0] for r in found.where("state <> 'gone'").select("season").distinct().collect()}
    if again := [s for s in seasons if s in there]:
        derive(spark, root, again, curated)
    for name in TABLES + ("derived",):
        sinks.drop_partitions(spark, f"{root}/tables/{name}", [s for s in seasons if s not in there])
    adopt(spark, root, found.where((F.col("state") == "reissued") & ~F.col("season").isin(*seasons) if seasons else F.col("state") == "reissued"))
    return found


def stored(spark: SparkSession, root: str, **more: DataFrame) -> Tables:
    """The tables of a build, for searches. A table that isn't there yet is left out."""
    read = lambda n: spark.read.parquet(f"{root}/tables/{n}")
    entries = read("lineup_entries").where("problem IS NULL").select("season", "game_key", "team", "position", "seq", "player")
    return Tables(plays=read("plays"), games=read("games"), play_tags=read("play_tags"), advances=read("advances"), sequences=read("sequences"), credits=read("credits"), tags=read("tags"), entries=entries, **more)


__all__ = ["TABLES", "adopt", "build", "derive", "folded", "refresh", "stored", "vintages"]
