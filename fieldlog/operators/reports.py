"""Reports for all keys at once; filter afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def line_score(plays: DataFrame, games: DataFrame, innings: int = 9) -> DataFrame:
    """game_key, side (0 away, 1 home), inning_1 and so on (null where the side didn't bat; later innings together in extra), total, and whether it is the stored final score."""
    of = lambda test: F.sum(F.when(test, F.coalesce("runs", F.lit(0))))
    scored = plays.groupBy("game_key", F.col("batting_team").alias("side")).agg(*[of(F.col("inning") == k).alias(f"inning_{k}") for k in range(1, innings + 1)], of(F.col("inning") > innings).alias("extra"), F.coalesce(F.sum("runs"), F.lit(0)).alias("total"))
    final = games.select("game_key", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("final_away").alias("final")), F.struct(F.lit(1).alias("side"), F.col("final_home").alias("final")))).alias("x")).select("game_key", "x.*")
    return scored.join(final, ["game_key", "side"]).withColumn("agrees", F.col("total") == F.col("final")).drop("final")


def tag_counts(plays: DataFrame, play_tags: DataFrame, games: DataFrame, game_types: tuple[str, ...] = ("regular",)) -> DataFrame:
    """player, season, tag, n: certain tags of plays of status ok in games that count (a game without a type does)."""
    counting = games.where(F.coalesce("game_type", F.lit("regular")).isin(*game_types)).select("game_key")
    own = plays.where("parse_status = 'ok'").join(counting, "game_key", "left_semi").select("game_key", "seq", F.col("batter_id").alias("player"))
    return own.join(play_tags.where("confidence = 'certain'").select("season", "game_key", "seq", "tag"), ["game_key", "seq"]).groupBy("player", "season", "tag").agg(F.count(F.lit(1)).alias("n"))


def team_seasons(games: DataFrame) -> DataFrame:
    """team, season, games, won, lost, tied, home_games, by the final scores."""
    side = lambda team, own, other, home: F.struct(F.col(team).alias("team"), F.col(own).alias("own"), F.col(other).alias("other"), F.lit(home).alias("home_side"))
    both = games.select("season", F.explode(F.array(side("home", "final_home", "final_away", True), side("away", "final_away", "final_home", False))).alias("x")).select("season", "x.*")
    count = lambda test: F.count_if(test)
    return both.groupBy("team", "season").agg(F.count(F.lit(1)).alias("games"), count(F.col("own") > F.col("other")).alias("won"), count(F.col("own") < F.col("other")).alias("lost"), count(F.col("own") == F.col("other")).alias("tied"), count("home_side").alias("home_games"))
