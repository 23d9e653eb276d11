"""The derived tables as queries, and their integrity checks: over the tables as they are built, and over copies with known damage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlog.operators import star
from fieldlog.operators.search import Search
from fieldlog.sources.sinks import work_folder

from .plays import DEALT, FLAGS_SQL, FOLD_SQL, FOLDED, FORCE_OUTS, STATUS_SQL
from .registry import add, literal, values
from .roles import view

#: Of each event of the list: movements, throws, credits, and whether its batter runs.
ROWS = dict(zip([r[0] for r in FOLDED], [
    (1, 0, 0, 1), (2, 0, 0, 1), (3, 0, 0, 1), (3, 0, 0, 1), (0, 0, 0, 0), (0, 0, 0, 0), (1, 1, 2, 0), (1, 0, 0, 1), (2, 0, 0, 1), (1, 0, 0, 1), (1, 0, 0, 1), (1, 1, 2, 1), (1, 1, 1, 0), (2, 2, 3, 1), (0, 1, 1, 0), (2, 1, 2, 1),
    (1, 1, 1, 1), (2, 1, 2, 1), (1, 0, 0, 0), (2, 0, 0, 0), (1, 1, 2, 0), (1, 1, 2, 0), (1, 1, 2, 0), (1, 1, 4, 0), (1, 0, 0, 0), (1, 0, 0, 0), (3, 1, 2, 1), (2, 1, 1, 1), (0, 1, 1, 0), (0, 0, 0, 0), (0, 0, 0, 0),
]))
BASE = f"""{FOLD_SQL}, told AS (SELECT *, 2000 + game_key % 5 AS season, {STATUS_SQL} AS status, {FORCE_OUTS} AS force_outs,
  coalesce(max(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY game_key, island ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS lost FROM folded),
f AS (SELECT told.*, CASE WHEN status = 'ok' AND lost THEN 'state_untrusted' ELSE status END AS parse_status, n_adv + CAST(alive AS INT) AS advs, n_seq, n_credit, n_b + CAST(alive AS INT) AS ran
  FROM told JOIN {values([(e, *n) for e, n in ROWS.items()], "e, n_adv, n_seq, n_credit, n_b")} ON c.e = told.event)"""


def log(spark: SparkSession, d: str) -> DataFrame:
    events = F.array(*[F.lit(row[0]) for row in FOLDED])
    dealt = view(spark, d, DEALT).withColumn("event", F.element_at(events, F.col("pick") + 1)).drop("pick")
    return dealt.withColumn("season", (2000 + F.col("game_key") % 5).cast("int"))


#: Where a session has built the tables of a folder.
ROOTS: dict[tuple[str, str], str] = {}


def root_of(spark: SparkSession, d: str) -> str:
    """The tables are built once a session, below a folder of their own, and read from there by every query that needs them."""
    key = (spark.sparkContext.applicationId, d)
    if key not in ROOTS:
        star.build(log(spark, d), root := work_folder(spark, "star"))
        ROOTS[key] = root
    return ROOTS[key]


def built(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    root = root_of(spark, d)
    return {n: spark.read.parquet(f"{root}/{n}") for n in ("plays", "advances", "credits", "sequences", "play_tags", "games", "tags")}


add("K1_tables", lambda s, d: sizes(built(s, d)), f"{BASE} SELECT 'plays' AS name, count(*) AS n FROM f UNION ALL SELECT 'advances', CAST(sum(advs) AS BIGINT) FROM f UNION ALL SELECT 'sequences', CAST(sum(n_seq) AS BIGINT) FROM f UNION ALL SELECT 'credits', CAST(sum(n_credit) AS BIGINT) FROM f UNION ALL SELECT 'games', count(DISTINCT game_key) FROM f UNION ALL SELECT 'tags', 84")


def sizes(t: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name in ("plays", "advances", "sequences", "credits", "games", "tags"):
        one = t[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


add("K3_games", lambda s, d: built(s, d)["games"].select("game_key", "plays", "away_runs", "home_runs", "status"), f"{BASE} SELECT game_key, count(*) AS plays, CAST(sum(CASE WHEN ok AND half = 'top' THEN runs ELSE 0 END) AS BIGINT) AS away_runs, CAST(sum(CASE WHEN ok AND half <> 'top' THEN runs ELSE 0 END) AS BIGINT) AS home_runs, CASE WHEN bool_or(parse_status IN ('unparsed', 'state_inconsistent')) THEN 'suspect' ELSE 'ok' END AS status FROM f GROUP BY game_key")
add("K14_statuses", lambda s, d: star.statistics(built(s, d)["plays"]), f"{BASE} SELECT parse_status, count(*) AS n FROM f GROUP BY parse_status")
add("K7_forget", lambda s, d: forgotten(built(s, d)), f"{BASE} SELECT CAST(sum(advs) AS BIGINT) AS n, count(*) AS plays FROM f WHERE game_key % 3 <> 0")


def forgotten(t: dict[str, DataFrame]) -> DataFrame:
    left = star.forget(t, t["games"].where("game_key % 3 = 0"))
    return left["advances"].agg(F.count(F.lit(1)).alias("n")).withColumn("plays", F.lit(left["plays"].count()))


def searched(spark: SparkSession, d: str) -> DataFrame:
    """A search on the stored tables: certain force outs at second, by season."""
    found = Search().tag("ForceOutAtSecond").outs(0).matches(star.stored(spark, root_of(spark, d)))
    return found.groupBy("season").agg(F.count(F.lit(1)).alias("n"))


add("K2_search_on_tables", searched, f"{BASE} SELECT season, count(*) AS n FROM f WHERE parse_status = 'ok' AND outs_before = 0 AND event IN ('64(1)3/GDP/G6') GROUP BY season")

# Damage, and how many rows the check then gives.
Damage = Callable[[dict[str, DataFrame]], dict[str, DataFrame]]


def changed(table: str, column: str, rows: str, value: str) -> Damage:
    return lambda t: t | {table: t[table].withColumn(column, F.expr(f"CASE WHEN {rows} THEN {value} ELSE {column} END"))}


def without(table: str, rows: str, also: Damage | None = None) -> Damage:
    return lambda t: (also(t) if also else t) | {table: t[table].where(f"NOT ({rows})")}


def strikeouts(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return t | {"play_tags": t["play_tags"].where("tag = 'Strikeout'")}


EMPTY = "(CASE WHEN substr(moves, 2, 1) <> '.' AND b1 IS NULL THEN 1 ELSE 0 END + CASE WHEN substr(moves, 3, 1) <> '.' AND b2 IS NULL THEN 1 ELSE 0 END + CASE WHEN substr(moves, 4, 1) <> '.' AND b3 IS NULL THEN 1 ELSE 0 END)"
COUNT = lambda what, where: f"SELECT CAST(coalesce(sum({what}), 0) AS BIGINT) FROM f WHERE {where}"
TRUSTED = "parse_status = 'ok'"
DAMAGED: dict[str, tuple[Damage, str]] = {
    "V10_play_without_game": (without("games", "game_key % 5 = 1"), COUNT("1", "game_key % 5 = 1")),
    "V11_advance_without_play": (without("plays", "play_id % 13 = 0"), COUNT("advs", "play_id % 13 = 0")),
    "V12_credit_without_play": (without("plays", "play_id % 13 = 0"), COUNT("n_credit", "play_id % 13 = 0")),
    "V13_sequence_without_play": (without("plays", "play_id % 13 = 0"), COUNT("n_seq", "play_id % 13 = 0")),
    "V14_tag_without_play": (without("plays", "play_id % 13 = 0", strikeouts), COUNT("1", "play_id % 13 = 0 AND event LIKE 'K%'")),
    "V15_tag_without_name": (without("tags", "name = 'HomeRun'"), COUNT("1", "event LIKE 'HR%'")),
    "V16_plays_of_game": (changed("games", "plays", "game_key % 4 = 0", "plays + 1"), "SELECT count(DISTINCT game_key) FROM f WHERE game_key % 4 = 0"),
    "V17_outs_add_up": (changed("plays", "outs", "play_id % 17 = 3", "outs + 1"), COUNT("1", "ok AND play_id % 17 = 3")),
    "V18_more_than_three_outs": (lambda t: t, COUNT("1", f"ok AND {FLAGS_SQL['more_than_three_outs']}")),
    "V19_outs_go_on": (changed("plays", "outs_before", "play_id % 17 = 3", "outs_before + 1"), "SELECT count(*) FROM (SELECT CASE WHEN ok THEN outs_before + CASE WHEN play_id % 17 = 3 THEN 1 ELSE 0 END END AS ob, lag(CASE WHEN ok THEN outs_after END) OVER (PARTITION BY game_key, inning, half ORDER BY seq) AS prev FROM f) WHERE ob <> prev"),
    "V20_runs_are_advances": (changed("plays", "runs", "play_id % 19 = 5", "runs + 1"), COUNT("1", "ok AND play_id % 19 = 5")),
    "V21_runs_have_runners": (changed("plays", "runs", "play_id % 19 = 5", "runs + 4"), COUNT("1", f"{TRUSTED} AND play_id % 19 = 5 AND runs + 4 > 1 + runners")),
    "V22_advance_from_nowhere": (lambda t: t, COUNT(EMPTY, TRUSTED)),
    "V23_batter_without_advance": (without("advances", "origin = 'B' AND play_id % 23 = 6"), COUNT("1", "ok AND ran = 1 AND play_id % 23 = 6")),
    "V24_runner_without_id": (lambda t: t, COUNT(EMPTY, TRUSTED)),
    "V25_batter_without_id": (changed("advances", "runner_id", "origin = 'B' AND play_id % 23 = 6", "NULL"), COUNT("ran", f"{TRUSTED} AND play_id % 23 = 6")),
    "V26_bases": (changed("plays", "bases_before", "play_id % 29 = 7", "concat(bases_before, '0')"), COUNT("1", "ok AND play_id % 29 = 7")),
    "V27_state_of_unparsed": (changed("plays", "outs_before", "true", "coalesce(outs_before, 0)"), COUNT("1", "NOT ok")),
    "V28_force_without_certainty": (changed("advances", "certainty", "true", "'n/a'"), COUNT("length(force_outs)", "ok")),
    "V29_out_and_scored": (changed("advances", "is_out", "true", "true"), COUNT("runs", "ok")),
    "V30_tag_of_unparsed": (lambda t: changed("plays", "parse_status", "play_id % 13 = 0", "'unparsed'")(strikeouts(t)), COUNT("1", "play_id % 13 = 0 AND event LIKE 'K%'")),
    "V46_place_is_a_zone": (changed("plays", "hit_location", "play_id % 31 = 2 AND parse_status <> 'unparsed'", "'X'"), COUNT("1", "ok AND play_id % 31 = 2")),
}
NATURAL = ("V18_more_than_three_outs", "V22_advance_from_nowhere", "V24_runner_without_id")


def damaged(spark: SparkSession, d: str) -> DataFrame:
    t, out = built(spark, d), None
    for name, (damage, _) in DAMAGED.items():
        one = star.violations(damage(t), only=name).drop("first")
        out = one if out is None else out.unionByName(one)
    return out


add("V_checks_clean", lambda s, d: star.violations(built(s, d)).drop("first"), f"{BASE} " + " UNION ALL ".join(f"SELECT {literal(n)} AS \"check\", ({DAMAGED[n][1] if n in NATURAL else 'SELECT 0'}) AS n" for n in star.CHECKS))
add("V_checks_damaged", damaged, f"{BASE} " + " UNION ALL ".join(f"SELECT {literal(n)} AS \"check\", ({sql}) AS n" for n, (_, sql) in DAMAGED.items()))
