"""Pages: what is known of a play, a game, a player, a park and a season, for all keys at once or for wanted ones.

Every function gives frames over the built tables (by name, as `ingest` writes them). With `wanted`, each table is cut down by a semi-join on the wanted keys before anything else is done with it.
A play's children are bounded by its event, so they become arrays; what a game, a player or a park has is given as rows, part by part, and never gathered.

Defined cases: a play without children of a kind has an empty array. A play whose side in the field was never told has no lineup row for it. Keys that name nobody have no rows. A table that isn't given leaves its part out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import reports as B

#: Fixed values of the format: positions that count as the side in the field (10 is who bats for the pitcher), places in the batting order (0: a pitcher who doesn't bat).
DEFENSE, BATTING = range(1, 11), range(10)
PITCHES, COUNT = "pitches", "count"
UNKNOWN_LEAGUE = "?"
#: Of each table below plays, what a page shows of a row; the order is that of the struct.
CHILDREN = {
    "tags": ("play_tags", ("tag", "confidence", "source")),
    "advances": ("advances", ("at", "origin", "dest", "is_out", "scored", "is_force", "certainty", "runner_id")),
    "sequences": ("sequences", ("at", "scope", "seq_text", "records_out", "has_error")),
    "credits": ("credits", ("throw", "at", "scope", "fielder", "credit")),
    "comments": ("comments", ("comment", "kind", "text")),
}


def cut(df: DataFrame, wanted: DataFrame | None, key: str) -> DataFrame:
    return df if wanted is None else df.join(wanted.select(key).distinct(), key, "left_semi")


def lineup_at(plays: DataFrame, entries: DataFrame) -> DataFrame:
    """game_key, play_id, lineup (array of team, kind, place, player): who holds each position (defense) and each place in the order (batting) of both sides at each play.

    Whoever starts holds from the first play, a substitute from the play after the one it follows. Plays and entries of a game in one order, and the last entry of each place so far: one shuffle."""
    places = [(team, kind, k) for team in (0, 1) for kind, numbers in (("defense", DEFENSE), ("batting", BATTING)) for k in numbers]
    p = plays.select("game_key", F.col("seq").alias("at"), "play_id")
    e = entries.select("game_key", F.coalesce("seq", F.lit(0)).cast("long").alias("at"), F.col("entry").cast("long").alias("entry"), "team", "position", "batting_order", "player")
    both = p.unionByName(e, allowMissingColumns=True)
    # A play comes before the entries that follow it.
    w = W.partitionBy("game_key").orderBy("at", F.asc_nulls_first("entry")).rowsBetween(W.unboundedPreceding, 0)
    number = {"defense": F.col("position"), "batting": F.col("batting_order")}
    last = {f"{kind}_{team}_{k}": F.last(F.when((F.col("team") == team) & (number[kind] == k), F.col("player")), ignorenulls=True).over(w) for team, kind, k in places}
    each = F.array(*[F.struct(F.lit(team).alias("team"), F.lit(kind).alias("kind"), F.lit(k).alias("place"), F.col(f"{kind}_{team}_{k}").alias("player")) for team, kind, k in places])
    return both.withColumns(last).where("play_id IS NOT NULL").select("game_key", "play_id", F.filter(each, lambda x: x["player"].isNotNull()).alias("lineup"))


def named(df: DataFrame, people: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """df with NAME_name for each column of ids; an id that nobody has stands for itself."""
    for c in columns:
        own = people.select(F.col("person_id").alias(c), F.concat_ws(" ", "first", "last").alias(f"{c}_name"))
        df = df.join(own, c, "left").withColumn(f"{c}_name", F.coalesce(F.nullif(f"{c}_name", F.lit("")), c))
    return df


def play_pages(t: dict[str, DataFrame], wanted: DataFrame | None = None, records: DataFrame | None = None) -> DataFrame:
    """One row a play (of wanted play_id): its columns; previous and following, the plays before and after it in its game; arrays of its tags, advances, sequences, credits and comments, in order; the lineups of both
    sides; with records of the archive (see `game_log.archived`) the line it comes from; with people the names of the batter and the runners."""
    plays, keys = t["plays"], ["game_key", "play_id"]
    if wanted is not None:
        wanted = cut(plays.select(*keys), wanted, "play_id").distinct()
        plays = cut(plays, wanted, "game_key")
    w = W.partitionBy("game_key").orderBy("seq")
    df = cut(plays.withColumns({"previous": F.lag("play_id").over(w), "following": F.lead("play_id").over(w)}), wanted, "play_id")
    for name, (table, columns) in CHILDREN.items():
        if table in t:
            own = cut(t[table].where("play_id IS NOT NULL"), wanted, "play_id").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
            df = df.join(own, keys, "left").withColumn(name, F.coalesce(name, F.array().cast(own.schema[name].dataType)))
    if "lineup_entries" in t:
        entries = cut(t["lineup_entries"].where("problem IS NULL"), wanted, "game_key")
        df = df.join(cut(lineup_at(plays, entries), wanted, "play_id"), keys, "left")
    if records is not None:
        places = cut(t["derived"].select(*keys, "line_no"), wanted, "play_id")
        lines = cut(records, wanted, "game_key").where("record_type = 'play'").select("game_key", "line_no", "path", "raw_line")
        df = df.join(places.join(lines, ["game_key", "line_no"]), keys, "left")
    return named(df, t["people"], ("batter_id", "runner_1", "runner_2", "runner_3")) if "people" in t else df


def game_pages(t: dict[str, DataFrame], wanted: DataFrame | None = None) -> dict[str, DataFrame]:
    """By part the rows of games (of wanted game_key), each with game_key: game, info, plays with tag arrays, line_score, lineup, comments, earned (runs by who answers for them), game_log (what published logs say of a game
    of that id and day, each thing once; tables need logs for it)."""
    own = {n: cut(df, wanted, "game_key") for n, df in t.items() if "game_key" in df.columns}
    tags = own["play_tags"].groupBy("game_key", "play_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    plays = own["plays"].join(tags, ["game_key", "play_id"], "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    out = {"game": own["games"].drop("digest", "content"), "plays": plays, "line_score": B.line_score(own["plays"], own["games"])}
    out |= {part: own[name] for part, name in (("info", "game_info"), ("lineup", "lineup_entries"), ("comments", "comments")) if name in own}
    if "earned" in own:
        out["earned"] = earned_split(own["earned"])
    if "logs" in t:
        said = ("game_id", "date", "series", "away_score", "home_score", "forfeit", "completion")
        out["game_log"] = own["games"].select("game_key", "game_id", "date").join(t["logs"].select(*said).distinct(), ["game_id", "date"])
    return out


def earned_split(earned: DataFrame) -> DataFrame:
    """game_key, batting_team, pitcher_id: runs; how many are earned, unearned, or the scorer's judgement; and how sure each is."""
    sure = lambda c: F.count_if(F.col("certainty") == c).alias(c)
    of = F.col("earned_pitcher")
    return earned.groupBy("game_key", "batting_team", "pitcher_id").agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(of).alias("earned"), F.count_if(~of).alias("unearned"), F.count_if(of.isNull()).alias("judgement"), *map(sure, ("derived", "likely", "ambiguous", "untrusted"))
    )


def player_pages(t: dict[str, DataFrame], wanted: DataFrame | None = None) -> dict[str, DataFrame]:
    """By part the rows of players (of wanted person_id), each with person_id: person, roster, appearances, batting_seasons (plays), lineup_seasons (games with an entry), tag_counts."""
    as_person = lambda df, c: cut(df.withColumnRenamed(c, "person_id"), wanted, "person_id")
    out = {part: cut(t[name], wanted, "person_id") for part, name in (("person", "people"), ("roster", "rosters"), ("appearances", "appearances")) if name in t}
    batted = as_person(t["plays"].where("batter_id IS NOT NULL"), "batter_id")
    out["batting_seasons"] = batted.groupBy("person_id", "season").agg(F.count(F.lit(1)).alias("plays"))
    if "lineup_entries" in t:
        out["lineup_seasons"] = as_person(t["lineup_entries"].where("player IS NOT NULL"), "player").groupBy("person_id", "season").agg(F.countDistinct("game_key").alias("games"))
    counted = t["plays"] if wanted is None else batted.withColumnRenamed("person_id", "batter_id")
    out["tag_counts"] = B.tag_counts(counted, t["play_tags"], t["games"]).withColumnRenamed("player", "person_id")
    return out


def park_seasons(games: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """park, season, games, first, last (days)."""
    return cut(games.where("park IS NOT NULL"), wanted, "park").groupBy("park", "season").agg(F.count(F.lit(1)).alias("games"), F.min("date").alias("first"), F.max("date").alias("last"))


def park_games(games: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """The games of parks, with their place in the park's season (in order of day, number and key)."""
    order = W.partitionBy("park", "season").orderBy("date", "game_number", "game_key")
    return cut(games.where("park IS NOT NULL"), wanted, "park").withColumn("place", F.row_number().over(order)).select("park", "season", "place", "game_key", "game_id", "date", "away", "home", "final_away", "final_home")


def coverage(games: DataFrame, plays: DataFrame, missing: DataFrame | None = None) -> DataFrame:
    """season, league, games, teams, plays; games by what is known of their pitches; plays that aren't parsed or whose state isn't sure; first and last day; games_missing: null where no list of games is known.

    plays are counted by game before they meet games. missing: see `reconcile.missing_games`."""
    status = plays.groupBy("game_key").agg(F.count_if(F.col("parse_status") == "unparsed").alias("unparsed"), F.count_if(F.col("parse_status").isin("state_inconsistent", "state_ambiguous", "state_untrusted")).alias("inconsistent"))
    detail = F.col("pitch_detail")
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    own = games.where("season IS NOT NULL").withColumn("league", F.coalesce("league", F.lit(UNKNOWN_LEAGUE))).join(status, "game_key", "left")
    df = own.groupBy("season", "league").agg(
        F.count(F.lit(1)).alias("games"), F.countDistinct("home").alias("teams"), total("plays", "plays"), F.count_if(detail == PITCHES).alias("with_pitches"), F.count_if(detail == COUNT).alias("with_count"),
        F.count_if(~F.coalesce(detail.isin(PITCHES, COUNT), F.lit(False))).alias("without_pitches"), total("unparsed", "plays_unparsed"), total("inconsistent", "plays_inconsistent"), F.min("date").alias("first_day"), F.max("date").alias("last_day"),
    )
    if missing is None:
        return df.withColumn("games_missing", F.lit(None).cast("long"))
    return df.join(missing.select("season", F.coalesce("league", F.lit(UNKNOWN_LEAGUE)).alias("league"), F.col("missing").alias("games_missing")), ["season", "league"], "left")


def coverage_totals(covered: DataFrame) -> DataFrame:
    """One row of a coverage table: games, plays, missing, share (held of the known games, over pairs of season and league that were measured; null if none was), pairs that weren't, and their leagues."""
    known = F.col("games_missing").isNotNull()
    held = F.coalesce(F.sum(F.when(known, F.col("games"))), F.lit(0))
    missing = F.coalesce(F.sum("games_missing"), F.lit(0))
    share: Column = F.when(held > 0, held / (held + missing))
    # Leagues are a handful of names.
    return covered.agg(F.coalesce(F.sum("games"), F.lit(0)).alias("games"), F.coalesce(F.sum("plays"), F.lit(0)).alias("plays"), missing.alias("missing"), share.alias("share"), F.count_if(~known).alias("unmeasured"), F.array_sort(F.collect_set(F.when(~known, F.col("league")))).alias("leagues"))


#: Reviews and places, over tables built from files: each must give no row.
CHECKS = {
    "V43_reversed_not_tagged": """SELECT DISTINCT c.play_id FROM {comments} c JOIN {plays} p ON p.game_key = c.game_key AND p.play_id = c.play_id
        LEFT ANTI JOIN {overturned} t ON c.game_key = t.game_key AND c.play_id = t.play_id WHERE c.reversed AND (p.event LIKE '%MREV%' OR p.event LIKE '%UREV%')""",
    "V44_tagged_not_reversed": "SELECT t.play_id FROM {overturned} t LEFT ANTI JOIN {reversed} c ON t.game_key = c.game_key AND t.play_id = c.play_id",
    "V45_place_in_no_modifier": """SELECT play_id FROM {plays} WHERE hit_location IS NOT NULL
        AND NOT exists(slice(split(regexp_replace(regexp_extract(event, '^[^.]*', 0), '[!#?+-]', ''), '/'), 2, 100000), m -> endswith(m, hit_location))""",
}


def violations(plays: DataFrame, comments: DataFrame, play_tags: DataFrame) -> DataFrame:
    """check, n: rows of CHECKS."""
    frames = {"plays": plays, "comments": comments, "overturned": play_tags.where("tag = 'ReplayOverturned'"), "reversed": comments.where("reversed AND play_id IS NOT NULL")}
    out = None
    for name, sql in CHECKS.items():
        used = {n: f for n, f in frames.items() if f"{{{n}}}" in sql}
        one = plays.sparkSession.sql(sql, **used).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")
        out = one if out is None else out.unionByName(one)
    return out
