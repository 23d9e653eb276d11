"""The derived tables: plays and, below each, its movements, credits, throws and tags; games above them. Built once from a log of plays and stored, so
that searches are scans with pushed filters and semi-joins, not folds.

Tables are partitioned by season and sorted by (game_key, seq) within files. A rebuild overwrites the seasons that it has rows of.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlog.functions import events as E
from fieldlog.functions import tags as T
from fieldlog.operators.curated import merged
from fieldlog.operators.fold import contaminated, replayed_log, scored
from fieldlog.operators.search import Tables

KEYS = ("season", "game_key", "seq", "play_id")
PLAYS = (
    "inning", "half", "batting_team", "batter_id", "event", "event_basic", "hit_location", "batter_ran", "outs_before", "outs", "outs_after", "bases_before", "bases_after", "runs", "own_before", "other_before",
    "score_diff", "inning_ending", "go_ahead", "walk_off", "final_play", "parse_status", "runner_1", "runner_2", "runner_3",
)


def derived(log: DataFrame) -> DataFrame:
    """From a log (season, game_key, seq, play_id, inning, half, batter, event): the folded, scored and tagged frame that all tables come from."""
    return finished(replayed_log(log))


def finished(folded: DataFrame) -> DataFrame:
    """A replayed log scored and tagged."""
    df = T.facts(contaminated(scored(folded))).withColumn("tags", F.when(F.col("parse_ok"), T.tag_rows(T.ALL)))
    team = F.col("team") if "team" in df.columns else F.when(F.col("half") == "top", 0).otherwise(1)
    return df.withColumns({
        "batting_team": team, "batter_id": F.col("batter"), "hit_location": E.first_hit("location"), "score_diff": F.col("own_before") - F.col("other_before"),
        "event_basic": F.regexp_extract("clean", "^([^/.]*)", 1), "inning_ending": F.col("outs_after") >= 3, "runner_1": F.col("b1"), "runner_2": F.col("b2"), "runner_3": F.col("b3"),
    })


def children(df: DataFrame) -> dict[str, DataFrame]:
    """plays, advances, credits, sequences, play_tags of a derived frame."""
    of = lambda column, place=True: df.where(F.size(column) > 0).select(*KEYS, *([F.posexplode(column).alias("at", "x")] if place else [F.explode(column).alias("x")]))
    seqs = of("seqs")
    return {
        "plays": df.select(*KEYS, *PLAYS),
        "advances": of("resolved").select(*KEYS, "at", "x.origin", "x.dest", "x.marked_out", "x.is_out", "x.explicit", "x.scored", "x.is_force", "x.certainty", F.col("x.runner").alias("runner_id"), "x.raw", "x.was_placed"),
        "sequences": seqs.select(*KEYS, "at", "x.scope", "x.seq_text", "x.records_out", "x.has_error"),
        "credits": seqs.select(*KEYS, F.col("at").alias("throw"), "x.scope", F.posexplode("x.credits").alias("at", "c")).select(*KEYS, "throw", "scope", "at", F.col("c.fielder").cast("string").alias("fielder"), "c.credit"),
        "play_tags": of("tags", False).select(*KEYS, "x.tag", "x.confidence", F.lit("derived").alias("source")),
    }


def games(plays: DataFrame) -> DataFrame:
    """One row a game: plays, runs by side, status: suspect where a play isn't parsed or is inconsistent."""
    wrong = F.col("parse_status").isin("unparsed", "state_inconsistent")
    side = lambda k: F.coalesce(F.sum(F.when(F.col("batting_team") == k, F.col("runs"))), F.lit(0)).alias(("away_runs", "home_runs")[k])
    return plays.groupBy("season", "game_key").agg(F.count(F.lit(1)).alias("plays"), side(0), side(1), F.max("inning").alias("innings"), F.when(F.bool_or(wrong), "suspect").otherwise("ok").alias("status"))


#: What the tables need of a derived frame: the columns of plays, and the arrays of what stands below them.
NEEDED = (*KEYS, *PLAYS, "resolved", "seqs", "tags")


def build(log: DataFrame, root: str) -> None:
    """Writes all tables below root, of a log of plays."""
    spark = log.sparkSession
    mode = {"mode": "overwrite", "partitionBy": "season"}
    write(derived(log), root)
    games(spark.read.parquet(f"{root}/plays")).write.option("partitionOverwriteMode", "dynamic").parquet(f"{root}/games", **mode)


def write(frame: DataFrame, root: str, more: tuple[str, ...] = (), curated: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Writes plays, what stands below them, and tags. What the tables need of the derived frame (and the columns of more) is written once, by (game_key, seq), and each table is a projection
    of it; gives that. curated makes of it the rows that people add to play_tags."""
    spark = frame.sparkSession
    whole = f"{root}/derived"
    mode = {"mode": "overwrite", "partitionBy": "season"}
    slim = frame.select(*NEEDED, *[c for c in more if c not in NEEDED])
    # Scoring has brought each game's plays together, so the wide rows aren't shuffled again to be written.
    slim.sortWithinPartitions("season", "game_key", "seq").write.option("partitionOverwriteMode", "dynamic").parquet(whole, **mode)
    frame = spark.read.parquet(whole)
    for name, df in children(frame).items():
        if name == "play_tags" and curated is not None:
            df = merged(df, curated(frame)).sortWithinPartitions("season", "game_key", "seq")
        # A projection keeps the order of the files it is read from.
        df.write.option("partitionOverwriteMode", "dynamic").parquet(f"{root}/{name}", **mode)
    T.tag_table(spark, T.ALL).write.mode("overwrite").parquet(f"{root}/tags")
    return frame


def stored(spark: SparkSession, root: str, **more: DataFrame) -> Tables:
    """The tables of a build, for searches."""
    read = lambda n: spark.read.parquet(f"{root}/{n}")
    return Tables(plays=read("plays"), games=read("games"), play_tags=read("play_tags"), advances=read("advances"), sequences=read("sequences"), credits=read("credits"), tags=read("tags"), **more)


def statistics(plays: DataFrame) -> DataFrame:
    return plays.groupBy("parse_status").agg(F.count(F.lit(1)).alias("n"))


def forget(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table that has games without those of gone (game_key)."""
    return {n: df.join(gone.select("game_key"), "game_key", "left_anti") if "game_key" in df.columns else df for n, df in tables.items()}


#: Integrity: SQL over the tables, each of which must give no row. Those in TRUSTED look at plays of status ok alone.
CHECKS = {
    "V10_play_without_game": "SELECT play_id FROM {plays} p LEFT ANTI JOIN {games} g ON p.game_key = g.game_key",
    "V11_advance_without_play": "SELECT a.play_id FROM {advances} a LEFT ANTI JOIN {plays} p ON a.play_id = p.play_id",
    "V12_credit_without_play": "SELECT a.play_id FROM {credits} a LEFT ANTI JOIN {plays} p ON a.play_id = p.play_id",
    "V13_sequence_without_play": "SELECT a.play_id FROM {sequences} a LEFT ANTI JOIN {plays} p ON a.play_id = p.play_id",
    "V14_tag_without_play": "SELECT a.play_id FROM {play_tags} a LEFT ANTI JOIN {plays} p ON a.play_id = p.play_id",
    "V15_tag_without_name": "SELECT a.play_id FROM {play_tags} a LEFT ANTI JOIN {tags} t ON a.tag = t.name",
    "V16_plays_of_game": "SELECT g.game_key FROM {games} g LEFT JOIN (SELECT game_key, count(*) AS n FROM {plays} GROUP BY game_key) p ON g.game_key = p.game_key WHERE g.plays <> coalesce(n, 0)",
    "V17_outs_add_up": "SELECT play_id FROM {plays} WHERE outs_before + outs <> outs_after",
    "V18_more_than_three_outs": "SELECT play_id FROM {plays} WHERE outs_after > 3",
    "V19_outs_go_on": "SELECT play_id FROM (SELECT play_id, outs_before, lag(outs_after) OVER (PARTITION BY game_key, inning, half ORDER BY seq) AS prev FROM {plays}) x WHERE outs_before <> prev",
    "V20_runs_are_advances": "SELECT p.play_id FROM {plays} p LEFT JOIN (SELECT play_id, count_if(scored) AS n FROM {advances} GROUP BY play_id) a ON a.play_id = p.play_id WHERE p.runs <> coalesce(n, 0)",
    "V21_runs_have_runners": "SELECT play_id FROM {trusted} WHERE runs > 1 + length(replace(bases_before, '0', ''))",
    "V22_advance_from_nowhere": "SELECT a.play_id FROM {advances} a JOIN {trusted} p ON a.play_id = p.play_id WHERE a.origin <> 'B' AND substr(p.bases_before, cast(a.origin AS INT), 1) <> '1'",
    "V23_batter_without_advance": "SELECT play_id FROM {plays} p LEFT ANTI JOIN (SELECT play_id FROM {advances} WHERE origin = 'B') a USING (play_id) WHERE batter_ran = 'yes'",
    "V24_runner_without_id": "SELECT a.play_id FROM {advances} a JOIN {trusted} p ON a.play_id = p.play_id WHERE a.origin <> 'B' AND a.runner_id IS NULL",
    "V25_batter_without_id": "SELECT a.play_id FROM {advances} a JOIN {trusted} p ON a.play_id = p.play_id WHERE a.origin = 'B' AND a.runner_id IS NULL",
    "V26_bases": "SELECT play_id FROM {plays} WHERE length(bases_before) <> 3 OR length(bases_after) <> 3 OR NOT bases_before RLIKE '^[01]*$'",
    "V27_state_of_unparsed": "SELECT play_id FROM {plays} WHERE parse_status = 'unparsed' AND (outs_before IS NOT NULL OR bases_before IS NOT NULL)",
    "V28_force_without_certainty": "SELECT play_id FROM {advances} WHERE is_force AND certainty = 'n/a'",
    "V29_out_and_scored": "SELECT play_id FROM {advances} WHERE is_out AND scored",
    "V30_tag_of_unparsed": "SELECT t.play_id FROM {play_tags} t JOIN {plays} p ON p.play_id = t.play_id WHERE p.parse_status = 'unparsed'",
    "V46_place_is_a_zone": "SELECT play_id FROM {plays} WHERE hit_location IS NOT NULL AND NOT hit_location RLIKE '^[0-9]'",
}


def violations(tables: dict[str, DataFrame], only: str | None = None) -> DataFrame:
    """check, n, first (the smallest key): all checks, or one, over plays, advances, credits, sequences, play_tags, games and tags."""
    # Few bytes a row in the files make plays look small enough to be sent to every task through the driver, and every check would do so at once: what grows with the log is merged instead.
    frames = {n: df if n == "tags" else df.hint("merge") for n, df in tables.items()}
    frames |= {"trusted": frames["plays"].where("parse_status = 'ok'")}
    spark, out = tables["plays"].sparkSession, None
    for name, sql in CHECKS.items() if only is None else [(only, CHECKS[only])]:
        used = {n: df for n, df in frames.items() if f"{{{n}}}" in sql}
        rows = spark.sql(sql, **used).toDF("k")
        one = rows.agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first")).select(F.lit(name).alias("check"), "n", "first")
        out = one if out is None else out.unionByName(one)
    return out
