"""From the archive's records to one folded log a game: plays, with what the records around them say, and control rows.

A game's records (info, start, sub, play, com and adjustments) are one stream in the order of the file. Windows over that stream, all by game, give each play what earlier records
told: who pitches, which pitchers answer for which runners, how many innings are scheduled, which side bats first. Nothing is collected, and one shuffle by game serves all.

Defined cases: a play record that is too short, or without a number for inning or side, is no play; its game counts it. A responsibility record before a game's first play, or for
no base, says nothing. Of info keys that repeat the last counts. A file without a year in its name takes its games' seasons from their ids.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import archive as A
from . import event_files as E
from . import game_records as G

#: Leagues by the last letter of a file's name; what is known of pitches; innings where nothing is said.
LEAGUES = {"EVA": "AL", "EVN": "NL", "EVF": "FL", "EVR": "NGL"}
PITCH_DETAIL = ("pitches", "count", "none")
INNINGS = 9
BASES = ("1", "2", "3")
RESPONSIBLE = "array<struct<base:string,pitcher:string>>"


def of_file(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def archived(spark: SparkSession, root: str, seasons: Sequence[int] | None = None, games: DataFrame | None = None) -> DataFrame:
    """Records of the archive below root: of all games, of those of some seasons (other folders aren't read), or of those named in games (game_key).

    Adds game_key, which follows from the file's name, the game's id and which of several of that id in the file it is, so it outlives a rebuild; and the season."""
    recs = E.records(A.lines(spark, root, seasons)).where("span > 0")
    nth = F.sum((F.col("record_type") == "id").cast("int")).over(W.partitionBy("path", "game_id").orderBy("line_no"))
    recs = recs.withColumn("nth", nth).withColumn("game_key", F.xxhash64(of_file(F.col("path")), "game_id", "nth"))
    recs = recs.withColumn("season", F.coalesce(F.col("season"), F.substring("game_id", 4, 4).try_cast("int")))
    return recs if games is None else recs.join(games.select("game_key"), "game_key", "left_semi")


def at(i: int) -> Column:
    return F.get("fields", F.lit(i))


def typed(recs: DataFrame) -> DataFrame:
    """Records with the columns of plays, of lineup entries and of adjustments, each null where the record is another."""
    kind, player = F.col("record_type"), F.split("raw_line", ",")
    play = (kind == "play") & (F.size("fields") >= 7) & at(1).try_cast("int").isNotNull() & at(2).isin("0", "1")
    entry = kind.isin("start", "sub")
    last = lambda k: F.trim(F.try_element_at(player, F.lit(-k))).try_cast("int")
    return recs.withColumns({
        "is_play": F.coalesce(play, F.lit(False)), "inning": F.when(play, at(1).try_cast("int")), "team": F.when(play, at(2).try_cast("int")), "batter": F.when(play, at(3)), "count": F.when(play, at(4)), "pitches": F.when(play, at(5)),
        "event": F.when(play, F.nullif(F.array_join(F.expr("slice(fields, 7, greatest(size(fields) - 6, 0))"), ","), F.lit(""))),
        "entry_team": F.when(entry & (F.size(player) >= 6), last(3)), "entry_position": F.when(entry & (F.size(player) >= 6), last(1)), "entry_player": F.when(entry, F.trim(at(1))),
        "answers": F.when((kind == "presadj") & F.trim(at(2)).isin(*BASES), F.struct(F.trim(at(2)).alias("base"), F.trim(at(1)).alias("pitcher"))),
        "place_base": F.when(kind.isin("radj", "ladj"), F.when(kind == "radj", F.coalesce(at(2), F.lit(""))).otherwise("")), "place_runner": F.when(kind == "radj", at(1)),
    })


def told(records: DataFrame) -> DataFrame:
    """typed records with what those before them in their game tell: seq (plays so far), pitcher_of (by side), responsible, scheduled_innings, home_bats_first."""
    w = W.partitionBy("game_key").orderBy("line_no")
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    info = lambda key: F.when((F.col("record_type") == "info") & (at(1) == key), at(2))
    pitcher = lambda side: F.last(F.when((F.col("entry_position") == 1) & (F.col("entry_team") == side), F.col("entry_player")), ignorenulls=True).over(before)
    df = records.withColumns({
        "seq": F.sum(F.col("is_play").cast("long")).over(upto), "pitcher_0": pitcher(0), "pitcher_1": pitcher(1),
        "scheduled_innings": F.coalesce(F.last(F.when(info("innings").rlike("^[0-9]+$"), info("innings").try_cast("int")), ignorenulls=True).over(before), F.lit(INNINGS)),
        "home_bats_first": F.coalesce(F.max(F.lower(info("htbf")) == "true").over(before), F.lit(False)),
    })
    # Records between two plays stand with the later one.
    turn = F.when(F.col("is_play"), F.col("seq")).otherwise(F.col("seq") + 1)
    own = W.partitionBy("game_key", "turn").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("turn", turn).withColumn("responsible", F.when(F.col("turn") > 1, F.collect_list("answers").over(own)).otherwise(F.array().cast(RESPONSIBLE)))


def half_of(team: Column, home_bats_first: Column) -> Column:
    """Side 1 bats at the bottom, unless the home side bats first."""
    return F.when(team == F.when(home_bats_first, 1).otherwise(0), "top").otherwise("bottom")


LOG = (
    "season", "game_key", "game_id", "line_no", "is_play", "seq", "play_id", "inning", "team", "half", "batter", "event", "count", "pitches", "pitcher", "responsible", "scheduled_innings",
    "place_base", "place_runner", "is_ladj",
)


def game_log(recs: DataFrame) -> DataFrame:
    """The plays of archived records in order, and among them the control rows (see the fold): runners placed, and marks that a side batted out of order (is_ladj)."""
    df = told(typed(recs)).where(F.col("is_play") | F.col("place_base").isNotNull())
    return df.withColumns({
        "play_id": F.when(F.col("is_play"), F.xxhash64("game_key", "seq")), "half": F.when(F.col("is_play"), half_of(F.col("team"), F.col("home_bats_first"))),
        "pitcher": F.when(F.col("team") == 0, F.col("pitcher_1")).when(F.col("team") == 1, F.col("pitcher_0")), "is_ladj": F.col("record_type") == "ladj",
    }).select(*LOG)


def out_of_order(parsed_log: DataFrame) -> DataFrame:
    """A parsed log with after_ladj: whether a mark of batting out of order stands between this parsed play and the parsed one before it. The marks go."""
    before = W.partitionBy("game_key").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    mark = F.max(F.when(F.col("is_ladj"), F.col("line_no"))).over(before)
    play = F.max(F.when(F.col("is_play") & F.col("parse_ok"), F.col("line_no"))).over(before)
    df = parsed_log.withColumn("after_ladj", F.coalesce(F.col("parse_ok") & (mark > F.coalesce(play, F.lit(0))), F.lit(False)))
    return df.where(~F.col("is_ladj")).drop("is_ladj")


def comments(recs: DataFrame) -> DataFrame:
    """Comments of games by their order in the game (comment, from 0): the play each belongs to, its kind and payload."""
    df = told(typed(recs)).where("is_play OR record_type = 'com'")
    df = G.classified(df.withColumn("play_id", F.when(F.col("is_play"), F.xxhash64("game_key", "seq"))).select("season", "game_key", F.col("line_no").alias("place"), "is_play", "play_id", "batter", "event", "raw_line"))
    df = df.withColumns({"event": F.coalesce("event", F.lit("")), "reversed": F.when(~F.col("is_play"), F.col("reversed"))})
    out = G.attached(df).drop("is_play", "play_id", "batter", "event", "raw_line").withColumnsRenamed({"place": "line_no", "of_play": "play_id"})
    return out.withColumn("comment", F.row_number().over(W.partitionBy("game_key").orderBy("line_no")) - 1)


def lineup_entries(recs: DataFrame) -> DataFrame:
    """Who took part from when: entry (from 0), is_sub, seq and play_id of the play before a substitution (null for those who start), player, name, team, batting_order, position. Records that
    can't be read have `problem`."""
    df = told(typed(recs)).where(F.col("record_type").isin("start", "sub")).withColumns({"is_sub": F.col("record_type") == "sub", "after": F.col("seq")}).drop("seq", "team")
    df = G.lineup(df.select("season", "game_key", "line_no", "is_sub", "after", "raw_line"))
    sub = F.col("is_sub") & (F.col("after") > 0)
    out = df.withColumns({"seq": F.when(sub, F.col("after")), "play_id": F.when(sub, F.xxhash64("game_key", "after")), "entry": F.row_number().over(W.partitionBy("game_key").orderBy("line_no")) - 1})
    return out.select("season", "game_key", "entry", "is_sub", "seq", "play_id", F.col("person").alias("player"), "name", "team", "batting_order", "position", "problem", "line_no")


def game_info(recs: DataFrame) -> DataFrame:
    """Every key and value, in order (seq from 0), none lost."""
    info = recs.where("record_type = 'info'").select("season", "game_key", "line_no", at(1).alias("key"), at(2).alias("value"))
    return info.withColumn("seq", F.row_number().over(W.partitionBy("game_key").orderBy("line_no")) - 1).drop("line_no")


def game_spans(recs: DataFrame) -> DataFrame:
    """Where each game's records stand in its file, how many there are, and which of several games of its id it is."""
    spans = recs.groupBy("season", "game_key", "path", "digest", "game_id").agg(F.min("line_no").alias("first_record"), F.max("line_no").alias("last_record"), F.count(F.lit(1)).alias("records"))
    return spans.withColumn("occurrence", F.row_number().over(W.partitionBy("game_id").orderBy("path", "first_record")))


def iso(x: Column) -> Column:
    """y/m/d or y-m-d as yyyy-mm-dd, parts padded; anything else as it is; empty is null."""
    parts = F.split(F.replace(x, F.lit("-"), F.lit("/")), "/")
    padded = F.concat_ws("-", F.lpad(F.get(parts, F.lit(0)), 4, "0"), F.lpad(F.get(parts, F.lit(1)), 2, "0"), F.lpad(F.get(parts, F.lit(2)), 2, "0"))
    return F.nullif(F.when(x.rlike(r"^[0-9]{1,4}[/-][0-9]{1,2}[/-][0-9]{1,2}$"), padded).otherwise(x), F.lit(""))


def from_first(recs: DataFrame) -> DataFrame:
    return recs.withColumn("from_first", F.col("line_no") - F.min("line_no").over(W.partitionBy("game_key")))


def content() -> Column:
    """What a game's own lines are, wherever in its file they stand."""
    return F.bit_xor(F.xxhash64("from_first", "raw_line"))


def contents(recs: DataFrame) -> DataFrame:
    """season, game_key, digest of its file, content of its own lines."""
    return from_first(recs).groupBy("season", "game_key", "digest").agg(content().alias("content"))


def games(recs: DataFrame, plays: DataFrame, short: DataFrame) -> DataFrame:
    """One row a game, of its records, its plays and its short halves (game_key): what info says, the final score of the replay, and status: suspect where a half ends without three outs, a
    play can't be read or parsed, or its state is inconsistent."""
    value = lambda key: F.max_by(at(2), F.when((F.col("record_type") == "info") & (at(1) == key), F.col("line_no")))
    number = lambda x: F.when(x.rlike("^-*[0-9]+$"), x.try_cast("int"))
    unread = (F.col("record_type") == "play") & ~((F.size("fields") >= 7) & at(1).try_cast("int").isNotNull() & at(2).isin("0", "1"))
    keys = ("date", "number", "hometeam", "visteam", "site", "gametype", "innings", "usedh", "htbf", "pitches", "tiebreaker")
    about = from_first(recs).groupBy("season", "game_key", "game_id", "path", "digest").agg(F.min("line_no").alias("first_line"), content().alias("content"), F.count_if(F.coalesce(unread, F.lit(True)) & (F.col("record_type") == "play")).alias("unread"), *[value(k).alias(k) for k in keys])
    about = about.withColumn("occurrence", F.row_number().over(W.partitionBy("game_id").orderBy("path", "first_line")))
    side = lambda k: F.coalesce(F.sum(F.when(F.col("batting_team") == k, F.col("runs"))), F.lit(0))
    scored = plays.groupBy("game_key").agg(F.count(F.lit(1)).alias("plays"), side(0).alias("final_away"), side(1).alias("final_home"), F.bool_or(F.col("parse_status").isin("unparsed", "state_inconsistent")).alias("wrong"))
    cut = short.select("game_key").distinct().withColumn("cut", F.lit(True))
    df = about.join(scored, "game_key", "left").join(cut, "game_key", "left")
    suffix = F.upper(F.regexp_extract("path", r"\.([^./]*)$", 1))
    detail = F.lower("pitches")
    true = lambda c: F.coalesce(F.lower(c) == "true", F.lit(False))
    suspect = F.coalesce(F.col("cut"), F.lit(False)) | (F.col("unread") > 0) | F.coalesce(F.col("wrong"), F.lit(False))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return df.select(
        "season", "game_key", "game_id", "occurrence", iso(F.col("date")).alias("date"), number(F.substring("game_id", 12, 1)).alias("game_number"), F.col("hometeam").alias("home"), F.col("visteam").alias("away"),
        F.try_element_at(F.create_map(*[F.lit(x) for pair in LEAGUES.items() for x in pair]), suffix).alias("league"), F.col("site").alias("park"), F.col("gametype").alias("game_type"), number(F.col("innings")).alias("scheduled_innings"),
        true("usedh").alias("use_dh"), true("htbf").alias("home_bats_first"), F.when(detail.isin(*PITCH_DETAIL), detail).alias("pitch_detail"), number(F.col("tiebreaker")).alias("tiebreaker_base"),
        zero("final_home"), zero("final_away"), zero("plays"), F.when(suspect, "suspect").otherwise("ok").alias("status"), "digest", "content",
    )
