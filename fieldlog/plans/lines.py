"""Queries on lines of files, comments and lineups, and reports. Lines are put together from the given tables and read back by the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldlog.sources import auxiliary as X
from fieldlog.sources import game_records as G
from fieldlog.sources import reference_files as R
from fieldlog.sources.archive import manifest
from fieldlog.sources.event_files import OUTSIDE_QUOTES
from fieldlog.sources.sinks import work_folder, write_named_files

from .plays import counted, dealt_once, expected
from .registry import WITH, add
from .roles import COVERAGE, GAMES, PARKS, PEOPLE, PLAY_TAGS, PLAYS, ROSTERS, TEAMS, view


def lines_of(spark: SparkSession, d: str, sql: str) -> DataFrame:
    """k, path, line_no, raw_line."""
    return view(spark, d, sql)


ID = "concat('pers', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'))"
ROSTER_LINES = f"""SELECT c_custkey AS line_no, 'ANA1990.ROS' AS path, CASE c_custkey % 11 WHEN 0 THEN concat({ID}, ',Last,First,R,R,ANA') WHEN 1 THEN concat('x', {ID}, ',Last,First,R,R,ANA,P')
  WHEN 2 THEN concat({ID}, ',Last,First,Q,R,ANA,P') WHEN 3 THEN concat({ID}, ',Last,First,,L,ANA, ') WHEN 4 THEN concat({ID}, ',Last,First,L,L,ANA,QB') ELSE concat({ID}, ',', c_mktsegment, ', First ,B,?,ANA,SS') END AS raw_line FROM customer"""
add("S17_rosters", lambda s, d: R.rosters(lines_of(s, d, ROSTER_LINES)).drop("path"), f"""SELECT c_custkey AS line_no, CASE c_custkey % 11 WHEN 1 THEN concat('x', {ID}) ELSE {ID} END AS person_id, CASE WHEN c_custkey % 11 < 5 THEN 'Last' ELSE c_mktsegment END AS last, 'First' AS first,
  CASE WHEN c_custkey % 11 < 2 THEN 'R' WHEN c_custkey % 11 = 2 THEN 'Q' WHEN c_custkey % 11 = 3 THEN NULL WHEN c_custkey % 11 = 4 THEN 'L' ELSE 'B' END AS bats, CASE WHEN c_custkey % 11 < 3 THEN 'R' WHEN c_custkey % 11 < 5 THEN 'L' ELSE '?' END AS throws, 'ANA' AS team,
  CASE c_custkey % 11 WHEN 0 THEN NULL WHEN 1 THEN 'P' WHEN 2 THEN 'P' WHEN 3 THEN NULL WHEN 4 THEN 'QB' ELSE 'SS' END AS position, CASE c_custkey % 11 WHEN 0 THEN 'number of fields' WHEN 1 THEN 'length of id' WHEN 2 THEN 'bats' WHEN 4 THEN 'position' END AS problem FROM customer""")
TEAM_LINES = "SELECT n_nationkey AS line_no, 'TEAM1990' AS path, CASE WHEN n_nationkey % 7 = 0 THEN concat('T', CAST(n_nationkey AS STRING), ',A,', n_name) WHEN n_nationkey % 4 = 1 THEN concat('T', CAST(n_nationkey AS STRING), ', ,', n_name, ',Nine') ELSE concat('T', CAST(n_nationkey AS STRING), ',A,', n_name, ',Nine') END AS raw_line FROM nation"
add("S18_teams", lambda s, d: R.teams(lines_of(s, d, TEAM_LINES)).drop("path"), "SELECT n_nationkey AS line_no, concat('T', CAST(n_nationkey AS STRING)) AS team_id, CASE WHEN n_nationkey % 7 <> 0 AND n_nationkey % 4 = 1 THEN NULL ELSE 'A' END AS league, n_name AS city, CASE WHEN n_nationkey % 7 <> 0 THEN 'Nine' END AS nickname, CASE WHEN n_nationkey % 7 = 0 THEN 'number of fields' END AS problem FROM nation")

# A headed file for each brand: one brand's header has its columns in another order, and one line in nine is too wide.
PARK_HEADER = ("PARKID", "NAME", "CITY")
PARK_LINES = "SELECT path, line_no, raw_line FROM (SELECT p_brand AS path, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) + 1 AS INT) AS line_no, CASE WHEN p_partkey % 9 = 0 THEN concat('P', CAST(p_partkey AS STRING), ',a,b,c') ELSE concat('P', CAST(p_partkey AS STRING), ',\"', p_name, ', the\", ', p_type) END AS raw_line FROM part) rows UNION ALL SELECT p_brand, 1, CASE p_brand WHEN 'Brand#11' THEN 'NAME,PARKID,CITY' ELSE 'PARKID,NAME,CITY' END FROM part GROUP BY p_brand"
add("S19_headed", lambda s, d: R.headed(lines_of(s, d, PARK_LINES), PARK_HEADER).select("path", F.get("fields", F.lit(0)).alias("id"), F.get("fields", F.lit(1)).alias("name"), "problem"), "SELECT p_brand AS path, concat('P', CAST(p_partkey AS STRING)) AS id, CASE WHEN p_partkey % 9 = 0 THEN 'a' ELSE concat(p_name, ', the') END AS name, CASE WHEN p_brand = 'Brand#11' THEN 'header' WHEN p_partkey % 9 = 0 THEN 'number of fields' END AS problem FROM part")

NUMBERS = ", ".join(f"CAST((c_custkey + {k}) % 20 AS STRING)" for k in range(4, 16))
APPEARANCE_LINES = f"""SELECT 'all.csv' AS path, CAST(1 AS BIGINT) AS line_no, '{",".join(R.APPEARANCES)}' AS raw_line UNION ALL SELECT 'all.csv', c_custkey + 2, concat_ws(',', {ID}, 'Last', 'First', 'R', '', 'ANA', CAST(c_custkey % 150 AS STRING), CAST(c_custkey % 7 + c_custkey % 5 + CASE WHEN c_custkey % 13 = 0 THEN 1 ELSE 0 END AS STRING), CAST(c_custkey % 7 AS STRING), CAST(c_custkey % 5 AS STRING), {NUMBERS},
  CASE WHEN c_custkey % 4 = 0 THEN '0' ELSE concat('199005', lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0')) END, '19900930', '1990') FROM customer"""
add("S20_appearances", lambda s, d: R.appearances(lines_of(s, d, APPEARANCE_LINES)).select("line_no", "person_id", "throws", "g", "g_p", "g_sp", "g_c", "g_pr", "first_g", "last_g", "season", "problem"), f"SELECT c_custkey + 2 AS line_no, {ID} AS person_id, NULL AS throws, c_custkey % 150 AS g, c_custkey % 7 + c_custkey % 5 + CASE WHEN c_custkey % 13 = 0 THEN 1 ELSE 0 END AS g_p, c_custkey % 7 AS g_sp, (c_custkey + 4) % 20 AS g_c, (c_custkey + 15) % 20 AS g_pr, CASE WHEN c_custkey % 4 <> 0 THEN concat('1990-05-', lpad(CAST(c_custkey % 28 + 1 AS STRING), 2, '0')) END AS first_g, '1990-09-30' AS last_g, 1990 AS season, CASE WHEN c_custkey % 13 = 0 THEN 'pitched games' END AS problem FROM customer")

HOME, AWAY = "concat('H', lpad(CAST(o_custkey % 30 AS STRING), 2, '0'))", "concat('A', lpad(CAST(o_custkey % 20 AS STRING), 2, '0'))"
DAY = "concat(CAST(year(o_orderdate) AS STRING), lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), lpad(CAST(day(o_orderdate) AS STRING), 2, '0'))"
NUMBER = "CASE o_orderkey % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN '1' WHEN 3 THEN '2' WHEN 4 THEN '' ELSE '0' END"
EMPTY = lambda n: "'" + "," * n + "'"
LOG_LINES = f"""SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'GLWS.TXT' WHEN '2-HIGH' THEN 'GLAS.TXT' ELSE concat('GL', CAST(year(o_orderdate) AS STRING), '.TXT') END AS path, o_orderkey AS line_no,
  CASE WHEN o_orderkey % 50 = 7 THEN 'a,short,line' ELSE concat('"', {DAY}, '","', {NUMBER}, '","Sun","', {AWAY}, '","AL",', '1,"', {HOME}, '","', CASE WHEN o_orderkey % 40 = 3 THEN 'LONG' ELSE 'NL' END, '",', '2,', CASE WHEN o_orderkey % 60 = 11 THEN '' ELSE CAST(o_orderkey % 9 AS STRING) END, ',', CAST(o_orderkey % 7 AS STRING), ',', CAST(51 + 3 * (o_orderkey % 3) AS STRING), ',"D","","",,"PAR',
    CAST(o_orderkey % 3 AS STRING), '",', {EMPTY(22)}, CAST(o_orderkey % 4 AS STRING), ',', CAST(o_orderkey % 5 AS STRING), {EMPTY(27)}, CAST(o_orderkey % 6 AS STRING), ',', CAST(o_orderkey % 8 AS STRING), ',"Wright, Harry, Jr."', {EMPTY(91)}) END AS raw_line FROM orders"""
GOOD = "o_orderkey % 50 <> 7"
add("S21_game_logs", lambda s, d: R.game_logs(lines_of(s, d, LOG_LINES)).select("line_no", "date", "number", "away", "home", "home_league", "away_score", "home_score", "outs", "park", "away_er", "away_er_team", "home_er", "home_er_team", "game_id", "problem"), f"""SELECT o_orderkey AS line_no, CASE WHEN {GOOD} THEN strftime(o_orderdate, '%Y-%m-%d') END AS date, CASE WHEN NOT {GOOD} THEN 'short' WHEN {NUMBER} = '' THEN '0' ELSE {NUMBER} END AS number, CASE WHEN {GOOD} THEN {AWAY} END AS away, CASE WHEN {GOOD} THEN {HOME} END AS home, CASE WHEN {GOOD} THEN CASE WHEN o_orderkey % 40 = 3 THEN 'LONG' ELSE 'NL' END END AS home_league,
  CASE WHEN {GOOD} AND o_orderkey % 60 <> 11 THEN o_orderkey % 9 END AS away_score, CASE WHEN {GOOD} THEN o_orderkey % 7 END AS home_score, CASE WHEN {GOOD} THEN 51 + 3 * (o_orderkey % 3) END AS outs, CASE WHEN {GOOD} THEN concat('PAR', CAST(o_orderkey % 3 AS STRING)) END AS park, CASE WHEN {GOOD} THEN o_orderkey % 4 END AS away_er, CASE WHEN {GOOD} THEN o_orderkey % 5 END AS away_er_team, CASE WHEN {GOOD} THEN o_orderkey % 6 END AS home_er, CASE WHEN {GOOD} THEN o_orderkey % 8 END AS home_er_team,
  CASE WHEN {GOOD} THEN concat({HOME}, {DAY}, CASE o_orderkey % 6 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '1' WHEN 3 THEN '2' ELSE '0' END) END AS game_id, CASE WHEN NOT {GOOD} THEN 'number of fields' WHEN o_orderkey % 60 = 11 THEN 'score' END AS problem FROM orders""")
add("S23_series", lambda s, d: counted(lines_of(s, d, LOG_LINES).withColumn("series", R.series(F.col("path"))), "series"), "SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'ws' WHEN '2-HIGH' THEN 'as' ELSE 'regular' END AS series, count(*) AS n FROM orders GROUP BY 1")
READ = f"{GOOD} AND o_orderkey % 60 <> 11"
add("S26_log_layout", lambda s, d: R.layout(R.game_logs(lines_of(s, d, LOG_LINES))), f"""WITH c AS (SELECT count(*) AS checked, count(*) FILTER (WHERE o_orderkey % 40 = 3) AS leagues, count(*) FILTER (WHERE o_orderkey % 8 > o_orderkey % 9 OR o_orderkey % 5 > o_orderkey % 7) AS earned FROM orders WHERE {READ})
  SELECT shape, failures, checked, failures <= checked * tolerated AS holds FROM c, LATERAL (VALUES ('scores', 0, 0.001), ('team ids', 0, 0.001), ('league ids', leagues, 0.01), ('outs by three', 0, 0.005), ('length of game', 0, 0.02), ('park ids', 0, 0.01), ('earned runs', earned, 0.02)) t(shape, failures, tolerated)""")
COPY = f"SELECT path, line_no, raw_line FROM ({LOG_LINES}) a UNION ALL SELECT 'COPY.TXT', line_no, raw_line FROM ({LOG_LINES}) b WHERE line_no % 3 = 0"


def copies(spark: SparkSession, d: str) -> DataFrame:
    logs = R.game_logs(lines_of(spark, d, COPY)).where("problem IS NULL")
    return R.held_elsewhere(logs.where("path = 'COPY.TXT'"), logs.where("path <> 'COPY.TXT'"))


add("S24_held_elsewhere", copies, f"WITH g AS (SELECT l.path, l.line_no, l.raw_line FROM ({LOG_LINES}) l JOIN orders ON o_orderkey = l.line_no WHERE {READ}) SELECT 'COPY.TXT' AS path, h.path AS other, count(*) AS lines FROM g n JOIN (SELECT DISTINCT path, raw_line FROM g) h ON h.raw_line = n.raw_line WHERE n.line_no % 3 = 0 GROUP BY h.path")

# Comments: the raw line; then kind, whether marked, person, umpire, inning, reversed, date, reason.
COMMENTS = [
    ('com,"ej,smitj101,P,umpir901,Arguing, loudly"', "ejection", False, "smitj101", "umpir901", None, None, None, "Arguing, loudly"),
    ('com,"$ej,managx01,M,,Call"', "ejection", True, "managx01", None, None, None, None, "Call"),
    ('com,"ej,not an id,P,umpir901,x"', "text", False, None, None, None, None, None, None),
    ('com,"ej,two"', "text", False, None, None, None, None, None, None),
    ('com,"replay,8,troum001 ,ANA,umpir902,,Safe,Y,X,1"', "replay", False, "troum001", "umpir902", 8, True, None, None),
    ('com,"replay,3,bettm001,BOS,umpir903,NYC,Tag,N"', "replay", False, "bettm001", "umpir903", 3, False, None, None),
    ('com,"replay, the crowd, saw, it, all, over, again"', "text", False, None, None, None, None, None, None),
    ("com,'umpchange,5,umphome,(none)'", "umpchange", False, None, None, 5, None, None, None),
    ("com,umpchange,6,ump1b,umpir904", "umpchange", False, None, "umpir904", 6, None, None, None),
    ('com,"suspended,19900512,CHI12,Rain"', "suspended", False, None, None, None, None, "1990-05-12", "Rain"),
    ('com,"suspended,next day,CHI12,Rain"', "text", False, None, None, None, None, None, None),
    ('com,"$Plain words, with a comma"', "text", True, None, None, None, None, None, None),
    ("com", "text", False, None, None, None, None, None, None),
]
TOLD = ("kind", "marker", "person", "umpire", "inning_of", "reversed", "date", "reason")
add("C1_classify", lambda s, d: counted(G.classified(dealt_once(s, d, [r[:1] for r in COMMENTS], "raw_line string")), "raw_line", *TOLD), expected(COMMENTS, f"raw_line, {', '.join(TOLD)}"))
LINEUPS = [
    ('start,griff001,"Griffey, Ken Jr.",0,3,8', "griff001", "Griffey, Ken Jr.", 0, 3, 8, None),
    ('sub,hemsr101,"Rollie Hemsley",0,9,11 ', "hemsr101", "Rollie Hemsley", 0, 9, 11, None),
    ("start,ruthb101,Babe Ruth,1,-1,7", "ruthb101", "Babe Ruth", 1, -1, 7, None),
    ('sub,nobody01,"No One",x,1,2', None, None, None, None, None, "unreadable"),
    ("start,short", None, None, None, None, None, "unreadable"),
]
PLACES = ("person", "name", "team", "batting_order", "position", "problem")
add("C4_lineup", lambda s, d: counted(G.lineup(dealt_once(s, d, [r[:1] for r in LINEUPS], "raw_line string")), "raw_line", *PLACES), expected(LINEUPS, f"raw_line, {', '.join(PLACES)}"))

# Records of games: the plays of the log view, some without a play (NP), and comments after every fourth: replays that name a batter, and prose.
RECORDS = f"""SELECT game_key, 2 * seq AS place, true AS is_play, play_id, concat('P', CAST(play_id % 5 AS STRING)) AS batter, CASE WHEN play_id % 6 = 0 THEN 'NP' ELSE 'S7' END AS event, CAST(NULL AS STRING) AS person, CAST(NULL AS BOOLEAN) AS reversed FROM ({PLAYS}) p
  UNION ALL SELECT game_key, 2 * seq + 1, false, play_id, NULL, NULL, CASE WHEN play_id % 3 = 0 THEN NULL ELSE concat('P', CAST(play_id % 7 AS STRING)) END, CASE WHEN play_id % 3 = 0 THEN NULL ELSE play_id % 2 = 0 END FROM ({PLAYS}) q WHERE seq % 4 = 1"""
NEIGHBOURS = f"""{WITH}, r AS ({RECORDS}), w AS (SELECT *, (SELECT arg_max(play_id, place) FROM r b WHERE b.game_key = r.game_key AND b.is_play AND b.place < r.place) AS last_play, (SELECT arg_max(play_id, place) FROM r b WHERE b.game_key = r.game_key AND b.is_play AND event <> 'NP' AND b.place < r.place) AS before_id,
  (SELECT arg_max(batter, place) FROM r b WHERE b.game_key = r.game_key AND b.is_play AND event <> 'NP' AND b.place < r.place) AS before_batter, (SELECT arg_min(play_id, place) FROM r b WHERE b.game_key = r.game_key AND b.is_play AND event <> 'NP' AND b.place > r.place) AS after_id, (SELECT arg_min(batter, place) FROM r b WHERE b.game_key = r.game_key AND b.is_play AND event <> 'NP' AND b.place > r.place) AS after_batter FROM r WHERE NOT is_play),
  t AS (SELECT game_key, place, reversed, CASE WHEN reversed IS NULL THEN last_play WHEN after_batter = person AND before_batter IS DISTINCT FROM person THEN after_id ELSE coalesce(before_id, last_play) END AS of_play FROM w)"""
add("C2_attached", lambda s, d: G.attached(view(s, d, RECORDS)).select("game_key", "place", "of_play"), f"{NEIGHBOURS} SELECT game_key, place, of_play FROM t")
add("R14_verdicts", lambda s, d: G.verdicts(G.attached(view(s, d, RECORDS))), f"{NEIGHBOURS} SELECT of_play AS play_id, bool_or(reversed) AS replay_reversed FROM t WHERE reversed IS NOT NULL AND of_play IS NOT NULL GROUP BY of_play")

# Scalars: dates in two spellings, whole numbers, signs in a string, one-line descriptions, JSON.
DATES = [("1990/5/3", "1990-05-03"), ("12/31/1999", "1999-12-31"), ("1990-05-03", "1990-05-03"), ("", ""), ("5/1990", "5/1990"), (None, None)]
add("F6_dates", lambda s, d: counted(dealt_once(s, d, [r[:1] for r in DATES], "raw string").withColumn("date", R.loose_date(F.col("raw"))), "raw", "date"), expected(DATES, "raw, date"))
add("F4_json", lambda s, d: counted(s.read.parquet(f"{d}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("long")), "k"), "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
add("F8_signs", lambda s, d: counted(view(s, d, PLAYS).withColumn("runners", (F.length("bases_before") - F.length(F.replace("bases_before", F.lit("1"), F.lit("")))).cast("long")), "runners"), f"{WITH} SELECT CAST(length(bases_before) - length(replace(bases_before, '1', '')) AS BIGINT) AS runners, count(*) AS n FROM plays GROUP BY 1")
add("F11_described", lambda s, d: view(s, d, COVERAGE).select(F.concat_ws(" ", "season", "league", F.format_string("%d games", "games_held"), F.when(F.col("games_missing").isNull(), "unmeasured").otherwise(F.format_string("%d missing", "games_missing"))).alias("line")), f"{WITH} SELECT concat(season, ' ', league, ' ', games_held, ' games ', CASE WHEN games_missing IS NULL THEN 'unmeasured' ELSE concat(games_missing, ' missing') END) AS line FROM coverage")
add("F3_quotes", lambda s, d: counted(dealt_once(s, d, [('a,"b,c",d',), ("a,b",), ('"x, y"',)], "raw string").withColumn("parts", F.size(F.split("raw", OUTSIDE_QUOTES)).cast("long")), "raw", "parts"), expected([('a,"b,c",d', 3), ("a,b", 2), ('"x, y"', 1)], "raw, parts"))


# Reports.
def play_details(spark: SparkSession, d: str) -> DataFrame:
    """Each play with its tags, its neighbours, and how many children it has."""
    plays, tags = view(spark, d, PLAYS), view(spark, d, PLAY_TAGS)
    w = W.partitionBy("game_key").orderBy("seq")
    names = tags.groupBy("play_id").agg(F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("tags"))
    return plays.select("play_id", F.lag("play_id").over(w).alias("previous"), F.lead("play_id").over(w).alias("following")).join(names, "play_id", "left")


add("B1_play_details", play_details, f"{WITH} SELECT p.play_id, lag(p.play_id) OVER w AS previous, lead(p.play_id) OVER w AS following, tags FROM plays p LEFT JOIN (SELECT play_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM play_tags GROUP BY play_id) t ON t.play_id = p.play_id WINDOW w AS (PARTITION BY game_key ORDER BY seq)")
add("B2_games", lambda s, d: view(s, d, GAMES).select("game_key", "home", "away").join(view(s, d, PLAYS).groupBy("game_key").agg(F.count(F.lit(1)).alias("plays"), F.count_if(F.col("parse_status") == "ok").alias("sound"), F.countDistinct("batter_id").alias("batters")), "game_key"), f"{WITH} SELECT g.game_key, home, away, count(*) AS plays, count(*) FILTER (WHERE parse_status = 'ok') AS sound, count(DISTINCT batter_id) AS batters FROM games g JOIN plays p ON p.game_key = g.game_key GROUP BY ALL")


def players(spark: SparkSession, d: str) -> DataFrame:
    """Per batter and season: plays and games, with the roster's positions."""
    plays = view(spark, d, PLAYS).join(view(spark, d, GAMES).select("game_key", "season"), "game_key")
    of = plays.groupBy("batter_id", "season").agg(F.count(F.lit(1)).alias("plays"), F.countDistinct("game_key").alias("games"))
    listed = view(spark, d, ROSTERS).groupBy(F.col("person_id").alias("batter_id"), "season").agg(F.array_join(F.array_sort(F.collect_set("position")), "/").alias("positions"))
    return of.join(listed, ["batter_id", "season"], "left")


add("B5_players", players, f"{WITH} SELECT p.batter_id, g.season, count(*) AS plays, count(DISTINCT p.game_key) AS games, any_value(positions) AS positions FROM plays p JOIN games g ON g.game_key = p.game_key LEFT JOIN (SELECT person_id, season, coalesce(string_agg(DISTINCT position, '/' ORDER BY position), '') AS positions FROM rosters GROUP BY ALL) r ON r.person_id = p.batter_id AND r.season = g.season GROUP BY p.batter_id, g.season")
add("B8_team_seasons", lambda s, d: view(s, d, TEAMS).groupBy("team_id").agg(F.min("season").alias("first"), F.max("season").alias("last"), F.countDistinct("season").alias("seasons")), f"{WITH} SELECT team_id, min(season) AS first, max(season) AS last, count(DISTINCT season) AS seasons FROM teams GROUP BY team_id")


def on_a_date(spark: SparkSession, d: str) -> DataFrame:
    """Games of a day, with the clubs' names, or their ids where no file names them."""
    games, names = view(spark, d, GAMES).where("date = 19999996"), view(spark, d, TEAMS).groupBy("team_id", "season").agg(F.min(F.concat_ws(" ", "city", "nickname")).alias("name"))
    side = lambda c: names.select(F.col("team_id").alias(c), "season", F.col("name").alias(f"{c}_name"))
    both = games.join(side("home"), ["home", "season"], "left").join(side("away"), ["away", "season"], "left")
    return both.select("game_id", F.coalesce("home_name", "home").alias("home"), F.coalesce("away_name", "away").alias("away"))


NAMED = "(SELECT team_id, season, min(city || ' ' || nickname) AS name FROM teams GROUP BY ALL)"
add("B10_games_on_a_date", on_a_date, f"{WITH} SELECT game_id, coalesce(h.name, home) AS home, coalesce(a.name, away) AS away FROM games g LEFT JOIN {NAMED} h ON h.team_id = home AND h.season = g.season LEFT JOIN {NAMED} a ON a.team_id = away AND a.season = g.season WHERE date = 19999996")


def season_teams(spark: SparkSession, d: str) -> DataFrame:
    """Clubs of each season with their games, those that no file lists among them, and listed ones without a game."""
    sides = view(spark, d, GAMES).select("season", F.explode(F.array("home", "away")).alias("team_id")).groupBy("season", "team_id").agg(F.count(F.lit(1)).alias("games"))
    listed = view(spark, d, TEAMS).select("season", "team_id").distinct().withColumn("listed", F.lit(True))
    return sides.join(listed, ["season", "team_id"], "full_outer").select("season", "team_id", F.coalesce("games", F.lit(0)).alias("games"), F.coalesce("listed", F.lit(False)).alias("listed"))


add("B11_season_teams", season_teams, f"{WITH}, s AS (SELECT season, team_id, count(*) AS games FROM (SELECT season, home AS team_id FROM games UNION ALL SELECT season, away FROM games) GROUP BY ALL) SELECT coalesce(s.season, t.season) AS season, coalesce(s.team_id, t.team_id) AS team_id, coalesce(games, 0) AS games, t.team_id IS NOT NULL AS listed FROM s FULL JOIN (SELECT DISTINCT season, team_id FROM teams) t ON t.season = s.season AND t.team_id = s.team_id")
add("B13_coverage", lambda s, d: view(s, d, COVERAGE).groupBy("season").agg(F.sum("games_held").cast("long").alias("held"), F.sum("games_missing").cast("long").alias("missing"), F.count_if(F.col("games_missing").isNull()).alias("unmeasured")), f"{WITH} SELECT season, CAST(sum(games_held) AS BIGINT) AS held, CAST(sum(games_missing) AS BIGINT) AS missing, count(*) FILTER (WHERE games_missing IS NULL) AS unmeasured FROM coverage GROUP BY season")


def first_half(spark: SparkSession, d: str) -> DataFrame:
    """A sample of seasons that includes both ends, evenly spaced."""
    seasons = view(spark, d, GAMES).select("season").distinct()
    w = W.orderBy("season")  # one row a season
    placed = seasons.withColumns({"k": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(W.partitionBy())})
    wanted = 3
    return placed.where(F.expr(f"exists(sequence(0, {wanted - 1}), i -> cast(round(i * (n - 1) / {wanted - 1}.0) AS INT) = k)")).select("season")


add("G8_spread", first_half, f"{WITH}, s AS (SELECT season, row_number() OVER (ORDER BY season) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT season FROM games)) SELECT season FROM s WHERE k IN (0, CAST(round((n - 1) / 2.0) AS INT), n - 1)")


def spans_of_parks(spark: SparkSession, d: str) -> DataFrame:
    """Games outside the years in which their park was in use: a join on the park, the range after it."""
    valid = view(spark, d, PARKS).select(F.col("park_id").alias("park"), (2000 + F.length("name") % 3).alias("opened"), F.lit(2003).alias("closed"))
    games = view(spark, d, GAMES).join(valid, "park", "left")
    inside = F.col("season").between(F.col("opened"), F.col("closed"))
    return games.agg(F.count(F.lit(1)).alias("games"), F.count_if(F.col("opened").isNull()).alias("unknown_park"), F.count_if(~inside).alias("outside"))


add("A14_park_years", spans_of_parks, f"{WITH} SELECT count(*) AS games, count(*) FILTER (WHERE park_id IS NULL) AS unknown_park, count(*) FILTER (WHERE park_id IS NOT NULL AND season NOT BETWEEN 2000 + length(name) % 3 AND 2003) AS outside FROM games LEFT JOIN parks ON park_id = park")


def held_and_stated(spark: SparkSession, d: str) -> DataFrame:
    """Stated appearances against games in the log: more in the log, fewer, none, and ids that no one states."""
    entries = view(spark, d, f"SELECT batter_id, game_key FROM ({PLAYS}) p")
    held = entries.groupBy("batter_id").agg(F.countDistinct("game_key").alias("held"))
    stated = view(spark, d, PEOPLE).select(F.col("person_id").alias("batter_id"), (F.length("last") % 12).alias("stated"))
    both = stated.join(held, "batter_id", "full_outer")
    verdict = F.when(F.col("stated").isNull(), "not stated").when(F.col("held").isNull(), "not held").when(F.col("held") > F.col("stated"), "more held").when(F.col("held") < F.col("stated"), "fewer held").otherwise("equal")
    return both.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("people"))


add("A13_appearances", held_and_stated, f"{WITH} SELECT CASE WHEN person_id IS NULL THEN 'not stated' WHEN held IS NULL THEN 'not held' WHEN held > length(last) % 12 THEN 'more held' WHEN held < length(last) % 12 THEN 'fewer held' ELSE 'equal' END AS verdict, count(*) AS people FROM people FULL JOIN (SELECT batter_id, count(DISTINCT game_key) AS held FROM plays GROUP BY batter_id) h ON batter_id = person_id GROUP BY 1")
add("V31_unknown_batters", lambda s, d: view(s, d, PLAYS).join(view(s, d, PEOPLE), F.col("batter_id") == F.col("person_id"), "left_anti").groupBy("batter_id").agg(F.count(F.lit(1)).alias("plays")), f"{WITH} SELECT batter_id, count(*) AS plays FROM plays WHERE batter_id NOT IN (SELECT person_id FROM people) GROUP BY batter_id")
add("V34_unknown_sites", lambda s, d: view(s, d, GAMES).join(view(s, d, PARKS), F.col("park") == F.col("park_id"), "left_anti").select("game_key", "park"), f"{WITH} SELECT game_key, park FROM games WHERE park NOT IN (SELECT park_id FROM parks)")
add("V35_unknown_team_seasons", lambda s, d: view(s, d, GAMES).select("season", F.explode(F.array("home", "away")).alias("team_id")).distinct().join(view(s, d, TEAMS), ["season", "team_id"], "left_anti"), f"{WITH} SELECT DISTINCT season, team_id FROM (SELECT season, home AS team_id FROM games UNION SELECT season, away FROM games) x WHERE NOT EXISTS (SELECT 1 FROM teams t WHERE t.season = x.season AND t.team_id = x.team_id)")
add("A17_union", lambda s, d: view(s, d, GAMES).select("season", F.col("home").alias("team_id")).union(view(s, d, GAMES).select("season", "away")).distinct().subtract(view(s, d, TEAMS).select(F.col("season"), "team_id")), f"{WITH} SELECT season, home AS team_id FROM games UNION SELECT season, away FROM games EXCEPT SELECT season, team_id FROM teams")


# Auxiliary files and published logs, written out from the given tables, archived and loaded.
AUX_LINES = f"""SELECT concat('T', lpad(CAST(c_nationkey AS STRING), 2, '0'), CAST(2000 + c_nationkey % 5 AS STRING), '.ROS') AS name, c_custkey AS place, concat_ws(',', {ID}, 'Last', 'First', 'R', 'L', 'T00', 'SS') AS line FROM customer
  UNION ALL SELECT concat('TEAM', CAST(2000 + n_nationkey % 5 AS STRING)), n_nationkey, concat_ws(',', concat('T', lpad(CAST(n_nationkey AS STRING), 2, '0')), 'A', n_name, 'Nine') FROM nation
  UNION ALL SELECT 'ballparks.csv', s_suppkey, concat_ws(',', s_suppkey, s_name) FROM supplier UNION ALL SELECT 'other.csv', s_suppkey, s_name FROM supplier"""


def auxiliary(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of the archived files; and what checks find, as they are and with the first line of each roster gone."""
    root = work_folder(spark, "auxiliary")
    write_named_files(view(spark, d, AUX_LINES), f"{root}/in")
    X.publish(spark, f"{root}/in", f"{root}/aux")
    held, all_ = manifest(spark, f"{root}/aux"), X.lines(spark, f"{root}/aux")
    kinds = X.by_kind(held).select(F.concat(F.lit("kind "), "kind").alias("what"), "files", "records")
    for copy, lines_ in (("whole", all_), ("damaged", all_.where("kind <> 'roster' OR line_no > 1"))):
        for name, df in X.checks(lines_, held).items():
            kinds = kinds.unionByName(df.agg(F.count(F.lit(1)).alias("files")).select(F.lit(f"{copy} {name}").alias("what"), "files", F.lit(0).cast("long").alias("records")))
    return kinds


ROSTERS_SQL = "(SELECT count(DISTINCT c_nationkey) FROM customer)"
add("S13_S16_auxiliary", auxiliary, f"""SELECT 'kind roster' AS what, count(DISTINCT c_nationkey) AS files, count(*) AS records FROM customer UNION ALL SELECT 'kind team', count(DISTINCT n_nationkey % 5), count(*) FROM nation UNION ALL SELECT 'kind park', 1, count(*) FROM supplier
  UNION ALL SELECT concat(copy, ' ', name), CASE WHEN copy = 'damaged' AND name <> 'V08_lines_without_file' THEN {ROSTERS_SQL} ELSE 0 END, 0 FROM (VALUES ('whole'), ('damaged')) a(copy), (VALUES ('V07_records_of_file'), ('V08_lines_without_file'), ('V09_bytes_differ')) b(name)""")


def loaded(spark: SparkSession, d: str) -> DataFrame:
    """The table of logs after two loads: the files as they are, then with one of them changed, and with a copy of some lines, which is refused."""
    root = work_folder(spark, "logs")
    # No two orders make the same line.
    line = F.replace("raw_line", F.lit("Harry"), F.concat(F.lit("H"), F.col("line_no").cast("string")))
    rows = view(spark, d, LOG_LINES).select(F.col("path").alias("name"), F.col("line_no").alias("place"), line.alias("line"))
    write_named_files(rows, f"{root}/in")
    X.load_logs(spark, f"{root}/in", root)
    again = rows.where("name <> 'GLAS.TXT' OR place % 2 = 0")
    write_named_files(again.unionByName(rows.where("name = 'GLWS.TXT' AND place % 3 = 0").withColumn("name", F.lit("COPY.TXT"))), f"{root}/in")
    report = X.load_logs(spark, f"{root}/in", root).select(F.element_at(F.split("path", "/"), -1).alias("name"), "state", "records", "malformed")
    stored = X.log_rows(spark, root).groupBy(F.element_at(F.split("path", "/"), -1).alias("name")).agg(F.count(F.lit(1)).alias("stored"))
    return report.join(stored, "name", "left")


add("S25_loaded_logs", loaded, f"""WITH l AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'GLWS.TXT' WHEN '2-HIGH' THEN 'GLAS.TXT' ELSE concat('GL', CAST(year(o_orderdate) AS STRING), '.TXT') END AS name, o_orderkey AS place, {READ} AS good FROM orders),
  a AS (SELECT * FROM l WHERE name <> 'GLAS.TXT' OR place % 2 = 0 UNION ALL SELECT 'COPY.TXT', place, good FROM l WHERE name = 'GLWS.TXT' AND place % 3 = 0)
  SELECT name, CASE name WHEN 'GLAS.TXT' THEN 'replaced' WHEN 'COPY.TXT' THEN 'refused' ELSE 'current' END AS state, count(*) FILTER (WHERE good) AS records, count(*) FILTER (WHERE NOT good) AS malformed, CASE WHEN name <> 'COPY.TXT' THEN nullif(count(*) FILTER (WHERE good), 0) END AS stored FROM a GROUP BY name""")
