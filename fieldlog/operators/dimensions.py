"""People, rosters, parks and the measured side of appearances, from files and from what the tables themselves name.

An id may be told of by several sources. The first in rank gives the row, and nothing that another says otherwise is lost: `disagreements` keeps each value that differs.

Defined cases: rows of one source that repeat an id are one, the smallest by its fields. Null ids are none. A source may lack fields. Names of nothing give empty tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Source = tuple[str, DataFrame]


def told(sources: Sequence[Source], key: str, fields: Sequence[str]) -> DataFrame:
    """All that the sources tell: key, fields, source and its rank."""
    out = None
    for rank, (name, df) in enumerate(sources):
        have = [F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields]
        one = df.where(F.col(key).isNotNull()).select(key, *have, F.lit(name).alias("source"), F.lit(rank).alias("rank"))
        out = one if out is None else out.unionByName(one)
    return out


def resolved(sources: Sequence[Source], key: str, fields: Sequence[str]) -> DataFrame:
    """One row an id, from its first source: key, fields, source. One aggregate; no row is compared with another."""
    best = told(sources, key, fields).groupBy(key).agg(F.min(F.struct("rank", *fields, "source")).alias("x"))
    return best.select(key, *[f"x.{f}" for f in fields], "x.source")


def disagreements(sources: Sequence[Source], key: str, fields: Sequence[str]) -> DataFrame:
    """key, field, source, value, kept: values of other sources (or other rows of the first) that differ from the row that stays. What a source doesn't say is no disagreement."""
    everything = told(sources, key, fields)
    first = F.min(F.struct("rank", *fields, "source")).over(W.partitionBy(key))
    each = everything.withColumn("x", first).select(key, "source", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), F.col(f"x.{f}").cast("string").alias("kept")) for f in fields])).alias("y"))
    return each.select(key, "y.field", "source", "y.value", "y.kept").where("value IS NOT NULL AND NOT (value <=> kept)").distinct()


def observed_people(entries: DataFrame, plays: DataFrame) -> DataFrame:
    """person_id of everyone who took part or batted."""
    return entries.select(F.col("player").alias("person_id")).unionByName(plays.select(F.col("batter_id").alias("person_id"))).where("person_id IS NOT NULL").distinct()


def observed_parks(games: DataFrame) -> DataFrame:
    return games.select(F.col("park").alias("park_id")).where("park_id <> ''").distinct()


def rosters(rows: DataFrame) -> DataFrame:
    """Roster rows (person_id, season, file_team, team, ...): the file's name wins over the stated team, which stated_team keeps where it is another."""
    stated = F.when(F.col("team") != F.col("file_team"), F.col("team"))
    return rows.withColumns({"stated_team": stated, "team_id": F.coalesce("file_team", "team")}).drop("team", "file_team")


def measured(stated: DataFrame, entries: DataFrame, games: DataFrame) -> DataFrame:
    """stated appearances (person_id, season, team_id, ...) with games_in_corpus: distinct games of the person for that club in that season, 0 where there is none."""
    clubs = games.select("game_key", "season", F.explode(F.array(F.struct(F.lit(0).alias("team"), F.col("away").alias("team_id")), F.struct(F.lit(1).alias("team"), F.col("home").alias("team_id")))).alias("x")).select("game_key", "season", "x.*")
    own = entries.select("game_key", "team", F.col("player").alias("person_id")).join(clubs, ["game_key", "team"])
    counts = own.groupBy("person_id", "season", "team_id").agg(F.countDistinct("game_key").alias("games_in_corpus"))
    return stated.join(counts, ["person_id", "season", "team_id"], "left").withColumn("games_in_corpus", F.coalesce("games_in_corpus", F.lit(0)))


def spelled(name: Column) -> Column:
    """A name as it is looked for: small letters, single spaces."""
    return F.lower(F.regexp_replace(F.trim(name), r"\s+", " "))


def name_index(kinds: dict[str, tuple[DataFrame, str, Sequence[str]]]) -> DataFrame:
    """kind, name, id, label of every name of dimensions (frame, key, name columns; several make one name): to be written by `write_index`, so that a prefix reads few row groups."""
    out = None
    for kind, (df, key, names) in kinds.items():
        label = F.concat_ws(" ", *names)
        one = df.select(F.lit(kind).alias("kind"), spelled(label).alias("name"), F.col(key).cast("string").alias("id"), label.alias("label")).where("name <> ''").distinct()
        out = one if out is None else out.unionByName(one)
    return out


def write_index(index: DataFrame, path: str) -> None:
    """Sorted by name over all files, a folder a kind: ranges of names don't overlap, so their statistics leave out all but a few."""
    index.repartitionByRange("kind", "name").sortWithinPartitions("kind", "name", "id").write.mode("overwrite").partitionBy("kind").parquet(path)


def starting_with(index: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """kind, id, label, rank: of each kind the first `limit` names that begin so, in order. The prefix is a range of names, which the scan gets."""
    p = " ".join(prefix.lower().split())
    found = index.where(F.col("name") >= p)
    # The first text after all that begin with the prefix.
    found = found.where(F.col("name") < p[:-1] + chr(ord(p[-1]) + 1)) if p else found
    w = W.partitionBy("kind").orderBy("name", "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("kind", "id", "label", "rank")


#: Integrity of the dimensions: each must give no row.
CHECKS = {
    "V31_lineup_player": "SELECT DISTINCT player AS k FROM {entries} e LEFT ANTI JOIN {people} p ON e.player = p.person_id",
    "V32_batter": "SELECT DISTINCT batter_id AS k FROM {plays} b LEFT ANTI JOIN {people} p ON b.batter_id = p.person_id WHERE b.batter_id IS NOT NULL",
    "V33_roster_person": "SELECT DISTINCT person_id AS k FROM {rosters} r LEFT ANTI JOIN {people} p ON r.person_id = p.person_id",
    "V34_site": "SELECT DISTINCT park AS k FROM {games} g LEFT ANTI JOIN {parks} p ON g.park = p.park_id WHERE g.park <> ''",
    "V36_park_date": "SELECT park_id AS k FROM {parks} WHERE (start IS NOT NULL AND start_date IS NULL) OR (end IS NOT NULL AND end_date IS NULL)",
}
