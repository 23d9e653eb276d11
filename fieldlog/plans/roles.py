"""The given tables in the roles of a game log: the same SQL text gives the view in Spark and in the comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldlog.operators.search import Tables

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations", "labels")

_NUMBERED = """
SELECT user_id AS game_key, event_id AS play_id, ts, CAST(day(ts) AS BIGINT) AS inning, CASE WHEN hour(ts) < 12 THEN 'top' ELSE 'bottom' END AS half,
       event_type AS tag, CAST(floor(value) AS BIGINT) % 4 AS runs, CAST(floor(value) AS BIGINT) % 8 AS occupied,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq
FROM events
"""

PLAYS = f"""
SELECT game_key, play_id, seq, inning, half, tag, runs, seq % 7 - 3 AS score_diff,
       CAST((row_number() OVER (PARTITION BY game_key, inning, half ORDER BY seq) - 1) % 3 AS BIGINT) AS outs_before,
       concat(CAST(occupied % 2 AS STRING), CAST(CAST(floor(occupied / 2) AS BIGINT) % 2 AS STRING), CAST(CAST(floor(occupied / 4) AS BIGINT) % 2 AS STRING)) AS bases_before,
       CASE WHEN play_id % 11 = 0 THEN NULL ELSE play_id % 5 END AS location,
       concat('P', CAST(play_id % 40 AS STRING)) AS batter_id, CASE WHEN half = 'top' THEN 0 ELSE 1 END AS batting_team,
       CASE play_id % 7 WHEN 0 THEN 'SB2' WHEN 1 THEN 'SB3;SB2' WHEN 2 THEN 'CS3(25)' WHEN 3 THEN 'S7' WHEN 4 THEN '63' ELSE 'K' END AS event_basic,
       CASE play_id % 7 WHEN 3 THEN 'S7/L7D.1-2' WHEN 4 THEN '63/G6' ELSE 'K+WP.1-2' END AS event, CASE play_id % 7 WHEN 3 THEN '7D' WHEN 4 THEN '6' WHEN 5 THEN '78' END AS hit_location,
       CASE play_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unknown' END AS batter_ran, CAST(play_id % 4 AS BIGINT) AS outs_after, play_id % 4 = 3 AS inning_ending, play_id % 19 = 0 AS walk_off,
       CASE WHEN play_id % 17 = 0 THEN 'unparsed' WHEN play_id % 13 = 0 THEN 'state_untrusted' ELSE 'ok' END AS parse_status
FROM ({_NUMBERED}) numbered
"""

GAMES = f"""
SELECT game_key, concat('G', CAST(game_key AS STRING)) AS game_id, 20000000 - game_key % 9 AS date, concat('K', CAST(game_key % 6 AS STRING)) AS park,
       CASE game_key % 10 WHEN 0 THEN 'exhibition' WHEN 1 THEN 'worldseries' WHEN 2 THEN NULL WHEN 3 THEN 'allstar' ELSE 'regular' END AS game_type, 2000 + game_key % 5 AS season, concat('L', CAST(game_key % 2 AS STRING)) AS league, concat('T', CAST(game_key % 7 AS STRING)) AS home,
       concat('T', CAST((game_key + 3) % 7 AS STRING)) AS away, count(*) AS plays, min(inning) AS first_day, max(inning) AS last_day, sum(runs) AS runs
FROM ({PLAYS}) p GROUP BY game_key
"""

PLAY_TAGS = f"""
SELECT play_id, tag, CASE WHEN play_id % 9 = 0 THEN 'uncertain' ELSE 'certain' END AS confidence,
       CASE WHEN play_id % 23 = 0 THEN 'curated' ELSE 'derived' END AS source FROM ({PLAYS}) p
"""

def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """sql over the given tables, without registering anything in the session."""
    used = {n: df for n in NAMES if f"FROM {n}" in sql or f"JOIN {n}" in sql for df in [spark.read.parquet(f"{sf_dir}/{n}.parquet")]}
    for n in used:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
    return spark.sql(sql, **used)


CHILD_ADVANCES = "SELECT l_orderkey AS play_id, l_returnflag = 'R' AS is_out, l_linestatus = 'F' AS is_force, CAST(l_linenumber % 4 AS STRING) AS dest, CASE l_partkey % 3 WHEN 0 THEN 'derived' WHEN 1 THEN 'likely' ELSE 'ambiguous' END AS certainty FROM lineitem"
CHILD_SEQUENCES = "SELECT l_orderkey AS play_id, concat(CAST(l_partkey % 9 + 1 AS STRING), CAST(l_suppkey % 9 + 1 AS STRING)) AS seq_text, CASE l_linenumber % 2 WHEN 0 THEN 'basic' ELSE 'advance' END AS scope FROM lineitem"
CHILD_CREDITS = "SELECT l_orderkey AS play_id, CASE l_returnflag WHEN 'R' THEN 'putout' WHEN 'A' THEN 'assist' ELSE 'error' END AS credit, CAST(l_linenumber AS STRING) AS fielder FROM lineitem"
ENTRIES = f"SELECT game_key, CAST(play_id % 2 AS INT) AS team, CAST(play_id % 3 + 1 AS INT) AS position, CASE WHEN seq < 3 THEN NULL ELSE seq END AS seq, concat('P', CAST(play_id % 5 AS STRING)) AS player FROM ({PLAYS}) p WHERE tag = 'signup'"
PEOPLE = "SELECT concat('P', CAST(c_custkey AS STRING)) AS person_id, c_mktsegment AS first, c_name AS last, concat('Nick', CAST(c_custkey % 7 AS STRING)) AS nickname FROM customer"
ROSTERS = "SELECT concat('P', CAST(c_custkey % 40 AS STRING)) AS person_id, 2000 + c_custkey % 5 AS season, concat('T', CAST(c_nationkey % 7 AS STRING)) AS team_id, 'Babe' AS first, concat('Roster', CAST(c_custkey % 40 AS STRING)) AS last, CASE c_custkey % 4 WHEN 0 THEN 'SS' WHEN 1 THEN 'OF' WHEN 2 THEN 'P' END AS position FROM customer"
TEAMS = "SELECT concat('T', CAST(n_nationkey % 7 AS STRING)) AS team_id, 2000 + n_nationkey % 5 AS season, CASE WHEN n_nationkey % 3 = 0 THEN 'NN2' ELSE 'A' END AS league, concat('City', CAST(n_nationkey % 7 AS STRING)) AS city, concat('Nine', CAST(n_nationkey % 3 AS STRING)) AS nickname FROM nation"
PARKS = "SELECT concat('K', CAST(s_suppkey AS STRING)) AS park_id, CASE WHEN s_suppkey <= 2 THEN 'Wrigley  Field' ELSE s_name END AS name, concat('The ', s_name) AS aka FROM supplier"
COVERAGE = f"SELECT season, league, count(*) AS games_held, CASE WHEN season % 2 = 0 THEN season % 3 END AS games_missing FROM ({GAMES}) g GROUP BY season, league"


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """plays and games from events; child rows from lineitem, joined to plays by number; dimensions from the other tables."""
    rows = lambda sql: view(spark, sf_dir, sql)
    tags = rows(f"SELECT DISTINCT tag AS name FROM ({PLAY_TAGS}) t")
    return Tables(
        plays=rows(PLAYS), games=rows(GAMES), play_tags=rows(PLAY_TAGS), advances=rows(CHILD_ADVANCES), sequences=rows(CHILD_SEQUENCES), credits=rows(CHILD_CREDITS), entries=rows(ENTRIES),
        people=rows(PEOPLE), rosters=rows(ROSTERS), teams=rows(TEAMS), parks=rows(PARKS), tags=tags, coverage=rows(COVERAGE),
    )
