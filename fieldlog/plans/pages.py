"""Pages of the tables built from event files, and checks of reviews and places, each with SQL on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlog.operators import pages as O
from fieldlog.operators import reconcile as C

from .checks import ROWS
from .files import HELD, NOTED, TOLD, figures, logs, root_of, table
from .plays import FOLDED
from .registry import add, literal, values

NAMES = ("plays", "play_tags", "advances", "sequences", "credits", "comments", "lineup_entries", "derived", "games", "game_info", "earned")


def built(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{root_of(spark, d)}/tables/{n}") for n in NAMES}


def users(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "games").select("game_key", "user")


def shown(spark: SparkSession, d: str, wanted: DataFrame | None = None) -> DataFrame:
    """Pages of plays, with what SQL can tell: neighbours by their numbers, sizes of the arrays, who pitches for either side, the line of the file."""
    t = built(spark, d)
    df = O.play_pages(t, wanted, figures(spark, d)).join(users(spark, d), "game_key")
    for c in ("previous", "following"):
        df = df.join(t["plays"].select("game_key", F.col("play_id").alias(c), F.col("seq").alias(f"{c}_seq")), ["game_key", c], "left")
    who = lambda side, kind, place: F.get(F.filter("lineup", lambda x: (x["team"] == side) & (x["kind"] == kind) & (x["place"] == place)), F.lit(0))["player"]
    size = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return df.select(
        "user", "seq", "previous_seq", "following_seq", size("advances"), size("sequences"), size("credits"), size("comments"), F.coalesce(F.get("comments", F.lit(0))["kind"], F.lit("none")).alias("comment"),
        F.exists("tags", lambda x: x["tag"] == "Strikeout").alias("strikeout"), who(0, "defense", 1).alias("pitcher_0"), who(1, "defense", 1).alias("pitcher_1"), who(1, "batting", 0).alias("order_1"), F.size("lineup").cast("long").alias("places"), "raw_line",
    )


NP = [r[0] for r in FOLDED].index("NP")
STRIKEOUTS = ", ".join(str(i) for i, r in enumerate(FOLDED) if r[0].startswith("K"))
PITCHER = lambda side: f"coalesce(last_value(CASE WHEN t.play_id % 11 = 3 AND team = {1 - side} THEN 'X' || t.play_id END IGNORE NULLS) OVER (PARTITION BY t.game_key ORDER BY t.seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'SP{side}_' || t.game_key)"
PAGES = f"""{TOLD}, pages AS (SELECT t.game_key AS "user", t.seq, lag(t.seq) OVER w AS previous_seq, lead(t.seq) OVER w AS following_seq, CAST(n_adv + CAST(alive AS INT) AS BIGINT) AS n_advances, CAST(n_seq AS BIGINT) AS n_sequences, CAST(n_credit AS BIGINT) AS n_credits,
  CAST(CASE WHEN t.play_id % 19 = 4 AND pick <> {NP} THEN 1 ELSE 0 END AS BIGINT) AS n_comments, CASE WHEN t.play_id % 19 = 4 AND pick <> {NP} THEN 'replay' ELSE 'none' END AS comment, ok AND ({NOTED.replace("game_key", "t.game_key")} OR pick IN ({STRIKEOUTS})) AS strikeout,
  {PITCHER(0)} AS pitcher_0, {PITCHER(1)} AS pitcher_1, {PITCHER(1)} AS order_1, CAST(4 AS BIGINT) AS places, concat('play,', inning, ',', team, ',', t.batter, ',12,CX,', e.event) AS raw_line, t.play_id
  FROM t JOIN {values([(r[0], *ROWS[r[0]]) for r in FOLDED], "event, n_adv, n_seq, n_credit, n_b").replace(") c(", ") e(")} ON e.i = pick WINDOW w AS (PARTITION BY t.game_key ORDER BY t.seq))"""
add("B1_play_pages", shown, f"{PAGES} SELECT * EXCLUDE (play_id) FROM pages")


def wanted_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of the reviewed plays alone."""
    wanted = table(spark, d, "comments").where("reversed AND play_id IS NOT NULL").select("play_id")
    return shown(spark, d, wanted)


add("B1_wanted_play_pages", wanted_pages, f"{PAGES} SELECT * EXCLUDE (play_id) FROM pages WHERE n_comments = 1 AND play_id % 2 = 0")


def games(spark: SparkSession, d: str) -> DataFrame:
    """Of each part of the games' pages how many rows a game has, and a sum that tells which they are."""
    parts = O.game_pages(built(spark, d) | {"logs": logs(spark, d)})
    told = {"game": "plays", "plays": "seq * size(filter(tags, x -> x = 'Strikeout'))", "line_score": "total", "info": "seq", "lineup": "coalesce(seq, 0)", "comments": "comment", "game_log": "away_score"}
    out = None
    for part, value in told.items():
        one = parts[part].groupBy("game_key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr(value)).cast("long").alias("told")).withColumn("part", F.lit(part))
        out = one if out is None else out.unionByName(one)
    return out.join(users(spark, d), "game_key").select("user", "part", "n", "told")


INFO = '(10 + CASE WHEN "user" % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN "user" % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN "user" % 4 = 1 THEN 1 ELSE 0 END - 4)'
add("B2_game_pages", games, HELD + f""", q AS (SELECT t.*, game_key AS "user" FROM t), r AS (SELECT game_id, date, "user" FROM held), each AS (
  SELECT "user", 'game' AS part, 1 AS n, count(*) AS told FROM q GROUP BY ALL
  UNION ALL SELECT "user", 'plays', count(*), sum(CASE WHEN ok AND ({NOTED} OR pick IN ({STRIKEOUTS})) THEN seq ELSE 0 END) FROM q GROUP BY ALL
  UNION ALL SELECT "user", 'line_score', count(DISTINCT team), sum(CASE WHEN ok THEN runs ELSE 0 END) FROM q GROUP BY ALL
  UNION ALL SELECT "user", 'info', {INFO}, {INFO} * ({INFO} - 1) // 2 FROM held
  UNION ALL SELECT "user", 'lineup', 2 + count(*) FILTER (WHERE play_id % 11 = 3), coalesce(sum(seq - 1) FILTER (WHERE play_id % 11 = 3), 0) FROM q GROUP BY ALL
  UNION ALL SELECT "user", 'comments', count(*), count(*) * (count(*) - 1) // 2 FROM q WHERE play_id % 19 = 4 AND pick <> {NP} GROUP BY ALL
  UNION ALL SELECT "user", 'game_log', count(*), sum(away_score) FROM (SELECT DISTINCT "user", l.* FROM r JOIN (SELECT DISTINCT game_id, date, series, away_score, home_score, forfeit, completion FROM listed) l ON l.game_id = r.game_id AND l.date = r.date) x GROUP BY ALL)
  SELECT "user", part, CAST(n AS BIGINT) AS n, CAST(told AS BIGINT) AS told FROM each""")


def players(spark: SparkSession, d: str) -> DataFrame:
    parts = O.player_pages(built(spark, d))
    return parts["batting_seasons"].join(parts["lineup_seasons"], ["person_id", "season"], "full_outer")


add("B5_player_pages", players, f"""{TOLD}, own AS (SELECT *, CAST(2000 + game_key % 5 AS INT) AS season FROM t), b AS (SELECT batter AS person_id, season, count(*) AS plays FROM own GROUP BY ALL),
  led_up AS (SELECT person_id, season, count(DISTINCT game_key) AS games FROM (SELECT 'X' || play_id AS person_id, season, game_key FROM own WHERE play_id % 11 = 3 UNION ALL SELECT unnest(['SP0_' || game_key, 'SP1_' || game_key]), season, game_key FROM own) x GROUP BY ALL)
  SELECT coalesce(b.person_id, x.person_id) AS person_id, coalesce(b.season, x.season) AS season, plays, games FROM b FULL JOIN led_up x ON x.person_id = b.person_id AND x.season = b.season""")


def parks(spark: SparkSession, d: str) -> DataFrame:
    """Parks, of many games each, by season; and the places of their games in the season."""
    held = table(spark, d, "games").withColumn("park", F.concat(F.lit("K"), F.col("user") % 10))
    last = O.park_games(held).groupBy("park", "season").agg(F.max("place").alias("places"), F.max_by("date", "place").alias("last_place"))
    return O.park_seasons(held).join(last, ["park", "season"])


add("B9_park_pages", parks, f"""{HELD} SELECT concat('K', "user" % 10) AS park, season, count(*) AS games, min(date) AS first, max(date) AS last, CAST(count(*) AS INT) AS places, max(date) AS last_place FROM held GROUP BY ALL""")


def covered(spark: SparkSession, d: str) -> DataFrame:
    """Games of one half of the seasons' leagues have no list."""
    held = table(spark, d, "games")
    leagues = held.withColumn("league", F.when(F.col("user") % 3 == 0, "NL").when(F.col("user") % 3 == 1, F.col("league")))
    return O.coverage(leagues, table(spark, d, "plays"), C.missing_games(held, logs(spark, d)))


UNSURE = "NOT ok OR outs_after > 3 OR runs > 1 + runners"
COVERED = f"""{HELD}, lost AS (SELECT t.*, coalesce(max(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY game_key, island ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS after_gap FROM t),
  pl AS (SELECT game_key, count(*) AS plays, count(*) FILTER (WHERE NOT ok) AS unparsed, count(*) FILTER (WHERE ok AND (outs_after > 3 OR runs > 1 + runners OR (after_gap AND NOT ((pick = {[r[0] for r in FOLDED].index("K+WP.B-1")} OR alive) AND b1 IS NOT NULL AND outs_before <> 2)))) AS inconsistent FROM lost GROUP BY game_key),
  miss AS (SELECT CAST(left(l.date, 4) AS INT) AS season, home_league AS league, count(*) FILTER (WHERE h.game_id IS NULL) AS games_missing FROM (SELECT game_id, date, home_league, row_number() OVER (PARTITION BY game_id ORDER BY date, away_score NULLS FIRST, home_score NULLS FIRST) AS nth FROM (SELECT DISTINCT ON (game_id, date, away_score, home_score) * FROM listed WHERE series = 'regular')) l
    LEFT JOIN (SELECT game_id, row_number() OVER (PARTITION BY game_id ORDER BY "user") AS nth FROM held) h ON h.game_id = l.game_id AND h.nth = l.nth WHERE CAST(left(l.date, 4) AS INT) BETWEEN (SELECT min(season) FROM held) AND (SELECT max(season) FROM held) GROUP BY ALL),
  cov AS (SELECT h.season, CASE "user" % 3 WHEN 0 THEN 'NL' WHEN 1 THEN 'AL' ELSE '?' END AS league, count(*) AS games, count(DISTINCT left(game_id, 3)) AS teams, CAST(sum(pl.plays) AS BIGINT) AS plays, count(*) AS with_pitches, 0 AS with_count, 0 AS without_pitches,
    CAST(sum(unparsed) AS BIGINT) AS plays_unparsed, CAST(sum(inconsistent) AS BIGINT) AS plays_inconsistent, min(date) AS first_day, max(date) AS last_day FROM held h JOIN pl ON pl.game_key = "user" GROUP BY ALL),
  c AS (SELECT cov.*, games_missing FROM cov LEFT JOIN miss USING (season, league))"""
add("B13_coverage_table", covered, f"{COVERED} SELECT * FROM c")
add("B13_coverage_totals", lambda s, d: O.coverage_totals(covered(s, d)).withColumns({"leagues": F.array_join("leagues", ","), "share": F.round("share", 9)}), f"{COVERED} SELECT CAST(sum(games) AS BIGINT) AS games, CAST(sum(plays) AS BIGINT) AS plays, CAST(coalesce(sum(games_missing), 0) AS BIGINT) AS missing, round(sum(games) FILTER (WHERE games_missing IS NOT NULL) / (sum(games) FILTER (WHERE games_missing IS NOT NULL) + sum(games_missing)), 9) AS share, count(*) FILTER (WHERE games_missing IS NULL) AS unmeasured, coalesce(string_agg(DISTINCT league, ',' ORDER BY league) FILTER (WHERE games_missing IS NULL), '') AS leagues FROM c")


def reviews(spark: SparkSession, d: str) -> DataFrame:
    """Checks of reviews and places: on the tables as built; and with a review in each event, some plays tagged as overturned, and some places moved."""
    t = built(spark, d)
    own = t["plays"].join(users(spark, d), "game_key")
    plays = own.withColumns({"event": F.concat("event", F.lit("/MREV")), "hit_location": F.when(F.col("hit_location").isNotNull() & (F.col("seq") % 3 == 0), "99").otherwise(F.col("hit_location"))})
    tags = own.where("seq % 5 = 0").select(*[F.lit("ReplayOverturned").alias(c) if c == "tag" else F.col(c) if c in own.columns else F.lit("").alias(c) for c in t["play_tags"].columns])
    whole = O.violations(t["plays"], t["comments"], t["play_tags"]).withColumn("tables", F.lit("whole"))
    return whole.unionByName(O.violations(plays, t["comments"], tags).withColumn("tables", F.lit("damaged")))


LOCATED = [i for i, r in enumerate(FOLDED) if r[0] in ("D8/L8D.1-H", "DGR/F9.2-H;1-3", "HR/F78.2-H;1-H", "63/G6", "8/F8/SF.3-H", "64(1)3/GDP/G6", "4/P4/IF", "23/BG2/SH.1-2", "E6/G6", "FC5/G5.3XH(52)", "S8/L8.2XH(8E2);1-3", "S9/G34.1XH(9/TH)", "FLE5/P5F")]
add("V43_V45_reviews", reviews, f"""{TOLD} SELECT * FROM (VALUES ('whole', 'V43_reversed_not_tagged', 0), ('whole', 'V44_tagged_not_reversed', 0), ('whole', 'V45_place_in_no_modifier', 0)) v(tables, "check", n)
  UNION ALL SELECT 'damaged', 'V43_reversed_not_tagged', count(*) FROM t WHERE reversed AND seq % 5 <> 0 UNION ALL SELECT 'damaged', 'V44_tagged_not_reversed', count(*) FROM t WHERE NOT reversed AND seq % 5 = 0
  UNION ALL SELECT 'damaged', 'V45_place_in_no_modifier', count(*) FROM t WHERE ok AND seq % 3 = 0 AND pick IN ({', '.join(map(literal, LOCATED))})""")
