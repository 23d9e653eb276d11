"""The tables against what was published: scores of game logs, missing games, earned-run totals of data records.

Logs are frames of `reference_files.game_logs` with series: game_id, date, home_league, series, away_score, home_score, forfeit, completion, and earned runs by side
(away_er, home_er: individual; away_er_team, home_er_team).

Defined cases: a game listed by several series with one score is one game, of the special series. Several games of one id are matched in order, the held ones by occurrence, the logged ones by date and
score; with in_order false, by id alone: each logged one meets each held one. Blank marks of forfeit and completion count as none; null leagues are one of their own. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldlog.operators import earned as N
from fieldlog.sources.game_log import at

#: Earned runs that logs may tell.
TOTALS = ("away_er", "home_er", "away_er_team", "home_er_team")


def set_(c: str) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def year() -> Column:
    return F.substring("date", 1, 4).try_cast("int")


def logged(logs: DataFrame) -> DataFrame:
    """One row a game that logs list: its special series if it is listed there as well, and nth, which of several games of its id it is."""
    # Rows of one series that differ in marks or league alone have an order too, so that every run keeps the same one: first those without marks.
    own = W.partitionBy("game_id", "date", "away_score", "home_score").orderBy(F.col("series") == "regular", "series", set_("forfeit"), set_("completion"), "home_league", *[c for c in TOTALS if c in logs.columns])
    one = logs.withColumn("k", F.row_number().over(own)).where("k = 1").drop("k")
    order = W.partitionBy("game_id").orderBy("date", F.asc_nulls_first("away_score"), F.asc_nulls_first("home_score"))
    return one.withColumns({"nth": F.row_number().over(order), "year": year()})


def occurring(games: DataFrame, *columns: str | Column) -> DataFrame:
    """The columns and game_id of held games, with nth, which of several games of its id each is."""
    return games.select(*columns, "game_id", F.row_number().over(W.partitionBy("game_id").orderBy("occurrence")).alias("nth"))


def reconciled(games: DataFrame, logs: DataFrame, in_order: bool = True) -> DataFrame:
    """season, game_id, nth, series, the four scores and verdict of each game that is held or logged: agree, differ, forfeit or incomplete (held, but no score to compare), held_only; and of those that are
    only logged: before (the first held season), special (another series), gap."""
    held = occurring(games, F.col("season").alias("held_season"), "final_away", "final_home")
    first = games.agg(F.coalesce(F.min("season"), F.lit(0)).alias("first_season"))
    listed = logged(logs)
    found = held.join(listed, ["game_id", "nth"], "full_outer") if in_order else held.join(listed.drop("nth"), "game_id", "full_outer")
    both = found.join(F.broadcast(first), F.lit(True))
    only_logged, only_held = F.col("held_season").isNull(), F.col("year").isNull()
    same = F.col("final_away").eqNullSafe(F.col("away_score")) & F.col("final_home").eqNullSafe(F.col("home_score"))
    verdict = (
        F.when(only_logged & (F.col("year") < F.col("first_season")), "before").when(only_logged & (F.col("series") != "regular"), "special").when(only_logged, "gap")
        .when(only_held, "held_only").when(set_("forfeit"), "forfeit").when(set_("completion"), "incomplete").when(same, "agree").otherwise("differ")
    )
    return both.select(F.coalesce("held_season", "year").alias("season"), "game_id", "nth", "series", "final_away", "final_home", "away_score", "home_score", verdict.alias("verdict"))


def by_verdict(found: DataFrame) -> DataFrame:
    """season, verdict, series (of what is only logged), games."""
    of = F.when(F.col("verdict").isin("before", "special", "gap"), F.col("series"))
    return found.groupBy("season", "verdict", of.alias("series")).agg(F.count(F.lit(1)).alias("games"))


def missing_games(games: DataFrame, logs: DataFrame, in_order: bool = True) -> DataFrame:
    """season, league, published, missing: by the regular series of logs, within the held seasons. Pairs that no log tells of have no row: joined to the coverage table, they stay null, which isn't none missing.
    Not in_order, an id that a league lists on a day counts once for each held game of that id, or once if none is held."""
    span = games.agg(F.min("season").alias("first"), F.max("season").alias("last"))
    regular = logs.where("series = 'regular'")
    listed = logged(regular) if in_order else regular.select("game_id", "date", "home_league", year().alias("year")).distinct()
    within = listed.join(F.broadcast(span), (F.col("year") >= F.col("first")) & (F.col("year") <= F.col("last")))
    both = within.join(occurring(games, F.lit(True).alias("held")), ["game_id", "nth"] if in_order else "game_id", "left")
    return both.groupBy(F.col("year").alias("season"), F.col("home_league").alias("league")).agg(F.count(F.lit(1)).alias("published"), F.count_if(F.col("held").isNull()).alias("missing"))


def covered(coverage: DataFrame, missing: DataFrame) -> DataFrame:
    """coverage (season, league, ...) with games_missing: null where no list of games is known."""
    counts = missing.select(F.col("season").alias("s"), F.col("league").alias("l"), F.col("missing").alias("games_missing"))
    return coverage.drop("games_missing").join(counts, (F.col("season") == F.col("s")) & F.col("league").eqNullSafe(F.col("l")), "left").drop("s", "l")


def data_rows(recs: DataFrame) -> DataFrame:
    """game_key, pitcher, n (null where the figure is no number) of the earned-run records of games."""
    own = recs.where("record_type = 'data'").where((F.size("fields") >= 4) & (F.trim(at(1)) == "er"))
    value = F.trim(at(3))
    return own.select("game_key", F.trim(at(2)).alias("pitcher"), F.when(value.rlike("^[0-9]+$"), value.try_cast("long")).alias("n"))


def pitcher_totals(recs: DataFrame) -> DataFrame:
    """game_key, pitcher, published, usable: one figure that is no number makes a game's totals unusable, not smaller. One shuffle by game serves sums and exclusion."""
    rows = data_rows(recs).repartition("game_key")
    sums = rows.groupBy("game_key", "pitcher").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("published"), F.bool_or(F.col("n").isNull()).alias("bad"))
    return sums.withColumn("usable", ~F.bool_or("bad").over(W.partitionBy("game_key"))).drop("bad")


def against_totals(verdicts: DataFrame, totals: DataFrame) -> DataFrame:
    """Published totals of games with verdicts against their bounds: game_key, pitcher, published, low, high, verdict (unusable, exact, differs: bounds that leave no room; within; outside) and distance (0 within). A pitcher whom the
    records name and no run is charged to has bounds of 0."""
    bounds = N.by_pitcher(verdicts).select("game_key", F.col("pitcher_id").alias("pitcher"), "low", "high")
    known = verdicts.select("game_key").distinct()
    df = totals.join(known, "game_key", "left_semi").join(bounds, ["game_key", "pitcher"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("low", "high")})
    n = F.col("published")
    distance = F.when(n > F.col("high"), n - F.col("high")).when(n < F.col("low"), n - F.col("low")).otherwise(F.lit(0).cast("long"))
    tight = F.col("low") == F.col("high")
    verdict = F.when(~F.col("usable"), "unusable").when(tight & (n == F.col("low")), "exact").when(tight, "differs").when(distance == 0, "within").otherwise("outside")
    return df.select("game_key", "pitcher", "published", "low", "high", verdict.alias("verdict"), F.when(F.col("usable"), distance).alias("distance"))


def which_total(games: DataFrame, recs: DataFrame, logs: DataFrame, in_order: bool = True) -> DataFrame:
    """One row: which published figure a side's total is, the individual or the team's, by the games' own data records: candidates, checked, individual, team, indistinguishable, neither, answer (null: a tie).

    Candidates are all held games that logs give both figures for; not in_order, each row of the logs with each held game of its id. Games without a figure in the records aren't checked."""
    given = logs.where("home_er_team IS NOT NULL AND away_er_team IS NOT NULL")
    both = logged(given).join(occurring(games, "game_key"), ["game_id", "nth"]) if in_order else given.join(games.select("game_key", "game_id"), "game_id")
    told = data_rows(recs).where("n IS NOT NULL").groupBy("game_key").agg(F.sum("n").alias("total"))
    sides = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    df = both.join(told, "game_key", "left").select("total", (sides("away_er", "home_er") == F.col("total")).alias("one"), (sides("away_er_team", "home_er_team") == F.col("total")).alias("team_"))
    count = lambda c: F.count_if(F.col("total").isNotNull() & c)
    counts = {"individual": count(F.col("one") & ~F.col("team_")), "team": count(F.col("team_") & ~F.col("one")), "indistinguishable": count(F.col("one") & F.col("team_")), "neither": count(~F.col("one") & ~F.col("team_"))}
    out = df.agg(F.count(F.lit(1)).alias("candidates"), F.count("total").alias("checked"), *[c.alias(n) for n, c in counts.items()])
    return out.withColumn("answer", F.when(F.col("team") > F.col("individual"), "team").when(F.col("individual") > F.col("team"), "individual"))
