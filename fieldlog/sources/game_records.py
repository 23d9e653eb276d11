"""Comments and lineups: what stands between the plays of a game."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .reference_files import iso_date, or_null


def body(raw: Column) -> Column:
    """Of a comment record: what follows the first comma, without the quotes around it."""
    text = F.trim(F.when(raw.contains(","), F.regexp_extract(raw, "(?s)^[^,]*,(.*)$", 1)).otherwise(raw))
    return F.regexp_replace(text, "(?s)^([\"'])(.*)\\1$", "$2")


def classified(df: DataFrame, raw: str = "raw_line") -> DataFrame:
    """df with marker (whether the body begins with $), kind (ejection, replay, umpchange, suspended or text), text, and the payload's fields: person, role, umpire,
    inning, position, team, site, call, reversed, date, reason. Prose that begins like a record has neither its number of fields nor their shape."""
    df = df.withColumn("__body", body(F.col(raw))).withColumn("marker", F.col("__body").startswith("$"))
    df = df.withColumn("text", F.when(F.col("marker"), F.substring("__body", F.lit(2), F.length("__body"))).otherwise(F.col("__body"))).withColumn("__f", F.split("text", ","))
    f = lambda i: F.get("__f", F.lit(i))
    of = lambda i: or_null(F.trim(f(i)))
    rest = lambda i: or_null(F.trim(F.array_join(F.slice("__f", i + 1, F.greatest(F.size("__f") - i, F.lit(0))), ",")))
    size, digits = F.size("__f"), lambda i: f(i).rlike("^[0-9]+$")
    kind = (
        F.when((f(0) == "ej") & (size >= 4) & (f(1) != "") & ~f(1).contains(" "), "ejection")
        .when((f(0) == "replay") & (size >= 8) & f(7).isin("Y", "N") & digits(1), "replay")
        .when((f(0) == "umpchange") & (size >= 4) & digits(1), "umpchange")
        .when((f(0) == "suspended") & (size >= 3) & f(1).rlike("^[0-9]{8}$"), "suspended")
        .otherwise("text")
    )
    df = df.withColumn("kind", kind)
    on = lambda k, x: F.when(F.col("kind") == k, x)
    umpire = F.when(F.lower(F.trim(f(3))).isin("(none)", "", "none"), None).otherwise(F.trim(f(3)))
    return df.withColumns({
        "person": F.coalesce(on("ejection", f(1)), on("replay", of(2))), "role": on("ejection", or_null(f(2))), "umpire": F.coalesce(on("ejection", or_null(f(3))), on("replay", of(4)), on("umpchange", umpire)),
        "inning_of": F.when(F.col("kind").isin("replay", "umpchange"), f(1).try_cast("int")), "position": on("umpchange", or_null(f(2))), "team": on("replay", of(3)), "site": F.coalesce(on("replay", of(5)), on("suspended", or_null(f(2)))),
        "call": on("replay", of(6)), "reversed": on("replay", f(7) == "Y"), "date": on("suspended", iso_date(f(1))), "reason": F.when(F.col("kind") == "ejection", rest(4)).when(F.col("kind") == "suspended", rest(3)),
    }).drop("__body", "__f")


def attached(records: DataFrame) -> DataFrame:
    """Records of games in order (game_key, place, is_play, play_id, batter, event; and of comments kind, person, reversed): of each comment the play it belongs to.

    That is the play before it. A replay belongs to the play after it if the person it names bats then and not before; plays that are none
    (NP) are no neighbours of a replay, though they are of other comments. One pass of windows over all records, whatever lies between."""
    real = F.col("is_play") & (F.col("event") != "NP")
    own = F.struct("play_id", "batter")
    before = W.partitionBy("game_key").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy("game_key").orderBy("place").rowsBetween(1, W.unboundedFollowing)
    df = records.withColumns({
        "last_play": F.last(F.when(F.col("is_play"), F.col("play_id")), ignorenulls=True).over(before),
        "before": F.last(F.when(real, own), ignorenulls=True).over(before), "after": F.first(F.when(real, own), ignorenulls=True).over(after),
    })
    next_ = (F.col("after.batter") == F.col("person")) & ~F.coalesce(F.col("before.batter") == F.col("person"), F.lit(False))
    replay = F.when(F.coalesce(next_, F.lit(False)), F.col("after.play_id")).otherwise(F.coalesce(F.col("before.play_id"), F.col("last_play")))
    return df.where(~F.col("is_play")).withColumn("of_play", F.when(F.col("reversed").isNotNull(), replay).otherwise(F.col("last_play"))).drop("last_play", "before", "after")


def verdicts(comments: DataFrame) -> DataFrame:
    """play_id, replay_reversed: of attached comments; one reversal is enough, whatever else is said of the play."""
    return comments.where("reversed IS NOT NULL AND of_play IS NOT NULL").groupBy(F.col("of_play").alias("play_id")).agg(F.bool_or("reversed").alias("replay_reversed"))


def lineup(df: DataFrame, raw: str = "raw_line") -> DataFrame:
    """df with person, name, team, batting_order, position and problem of start and sub records, read from both ends, since names hold commas."""
    df = df.withColumn("__f", F.split(raw, ","))
    last = lambda k: F.trim(F.try_element_at("__f", F.lit(-k)))
    name = F.regexp_replace(F.trim(F.array_join(F.slice("__f", 3, F.greatest(F.size("__f") - 5, F.lit(0))), ",")), "^[\"']+|[\"']+$", "")
    wrong = (F.size("__f") < 6) | ~(last(3).rlike("^[0-9]+$") & last(2).rlike("^-*[0-9]+$") & last(1).rlike("^-*[0-9]+$"))
    good = lambda x: F.when(~wrong, x)
    return df.withColumns({"problem": F.when(wrong, "unreadable"), "person": good(F.trim(F.get("__f", F.lit(1)))), "name": good(name), "team": good(last(3).try_cast("int")), "batting_order": good(last(2).try_cast("int")), "position": good(last(1).try_cast("int"))}).drop("__f")
