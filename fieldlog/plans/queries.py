"""Queries over the given tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldlog.operators.curated import merged
from fieldlog.operators.search import holders

from . import checks, earned, files, lines, pages, plays, roles, searches
from .registry import QUERIES, SQL, WITH, Query, add, on_table, on_view
from .roles import GAMES, PLAY_TAGS, PLAYS, tables, view

on_view("A5_coverage_table", GAMES, lambda g: g.groupBy("season", "league").agg(F.count(F.lit(1)).alias("games"), F.sum("plays").cast("long").alias("plays"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"), F.countDistinct("home").alias("homes")), "SELECT season, league, count(*) AS games, CAST(sum(plays) AS BIGINT) AS plays, min(first_day) AS first_day, max(last_day) AS last_day, count(DISTINCT home) AS homes FROM games GROUP BY season, league")


def missing(spark: SparkSession, d: str) -> DataFrame:
    orders, lines = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("orders", "lineitem"))
    gone = orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left_anti").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("missing"))
    held = orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("published"))
    # A group in which nothing is missing stays NULL, apart from a measured zero.
    return held.join(gone, "o_orderpriority", "left")


add("A6_missing", missing, "SELECT o_orderpriority, count(*) AS published, nullif(count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)), 0) AS missing FROM orders GROUP BY o_orderpriority")


def reconciled(spark: SparkSession, d: str) -> DataFrame:
    orders, lines = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("orders", "lineitem"))
    sums = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"))
    both = orders.select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("published")).join(sums, "o_orderkey", "full_outer")
    verdict = F.when(F.col("cents").isNull(), "published_only").when(F.col("published").isNull(), "held_only").when(F.col("cents") == F.col("published"), "exact").when(F.col("cents") < F.col("published"), "below").otherwise("above")
    return both.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


add("A7_reconcile", reconciled, "SELECT CASE WHEN cents IS NULL THEN 'published_only' WHEN published IS NULL THEN 'held_only' WHEN cents = published THEN 'exact' WHEN cents < published THEN 'below' ELSE 'above' END AS verdict, count(*) AS n FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS published FROM orders) o FULL JOIN (SELECT l_orderkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents FROM lineitem GROUP BY l_orderkey) l ON o_orderkey = l_orderkey GROUP BY 1")


def bounds(spark: SparkSession, d: str) -> DataFrame:
    """Whether a published number lies between what is certain and what is possible."""
    lines, orders = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("lineitem", "orders"))
    b = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_returnflag") == "R").alias("low"), F.count_if(F.col("l_returnflag") != "N").alias("high"))
    published = orders.select("o_orderkey", (F.col("o_custkey") % 5).alias("n"))
    distance = F.when(F.col("n") < F.col("low"), F.col("n") - F.col("low")).when(F.col("n") > F.col("high"), F.col("n") - F.col("high")).otherwise(F.lit(0).cast("long"))
    return published.join(b, "o_orderkey").groupBy(distance.alias("distance")).agg(F.count(F.lit(1)).alias("games"), F.count_if(F.col("low") == F.col("high")).alias("exact_bounds"))


add("A10_bounds", bounds, "SELECT CASE WHEN n < low THEN n - low WHEN n > high THEN n - high ELSE 0 END AS distance, count(*) AS games, count(*) FILTER (WHERE low = high) AS exact_bounds FROM (SELECT o_orderkey, o_custkey % 5 AS n FROM orders) JOIN (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS low, count(*) FILTER (WHERE l_returnflag <> 'N') AS high FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1")

on_view("B3_line_score", PLAYS, lambda p: p.groupBy("game_key", "half").pivot("outs_before", [0, 1, 2]).agg(F.sum("runs")).select("game_key", "half", *[F.coalesce(F.col(str(k)), F.lit(0)).alias(f"runs_{k}") for k in range(3)]), "SELECT game_key, half, " + ", ".join(f"CAST(coalesce(sum(runs) FILTER (WHERE outs_before = {k}), 0) AS BIGINT) AS runs_{k}" for k in range(3)) + " FROM plays GROUP BY game_key, half")
on_view("B6_tag_counts", PLAYS, lambda p: p.groupBy("game_key", "tag").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("inning").alias("days")), "SELECT game_key, tag, count(*) AS n, count(DISTINCT inning) AS days FROM plays GROUP BY game_key, tag")


def team_records(g: DataFrame) -> DataFrame:
    sides = g.select("season", F.explode(F.array(F.struct(F.col("home").alias("team"), F.lit(True).alias("at_home")), F.struct(F.col("away").alias("team"), F.lit(False).alias("at_home")))).alias("x"), "runs").select("season", "x.*", "runs")
    return sides.groupBy("season", "team").agg(F.count(F.lit(1)).alias("games"), F.count_if("at_home").alias("home_games"), F.count_if(F.col("runs") % 2 == 0).alias("even"))


on_view("B7_team_record", GAMES, team_records, "SELECT season, team, count(*) AS games, count(*) FILTER (WHERE at_home) AS home_games, count(*) FILTER (WHERE runs % 2 = 0) AS even FROM (SELECT season, home AS team, true AS at_home, runs FROM games UNION ALL SELECT season, away, false, runs FROM games) GROUP BY season, team")
on_view("B12_seasons", GAMES, lambda g: g.groupBy("season").agg(F.array_join(F.array_sort(F.collect_set("league")), ",").alias("leagues"), F.count(F.lit(1)).alias("games")), "SELECT season, string_agg(DISTINCT league, ',' ORDER BY league) AS leagues, count(*) AS games FROM games GROUP BY season")
on_view("A19_most_common", PLAYS, lambda p: p.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(3), "SELECT tag, count(*) AS n FROM plays GROUP BY tag ORDER BY n DESC, tag LIMIT 3")

# Windows.
def game():
    return W.partitionBy("game_key").orderBy("seq")


def before():
    return game().rowsBetween(W.unboundedPreceding, -1)


def half():
    return W.partitionBy("game_key", "inning", "half").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)


on_view("W2_continuity", PLAYS, lambda p: p.withColumn("prev", F.lag("outs_before").over(W.partitionBy("game_key", "inning", "half").orderBy("seq"))).where("prev IS NOT NULL AND outs_before <> (prev + 1) % 3").select("play_id"), "SELECT play_id FROM (SELECT play_id, outs_before, lag(outs_before) OVER (PARTITION BY game_key, inning, half ORDER BY seq) AS prev FROM plays) WHERE prev IS NOT NULL AND outs_before <> (prev + 1) % 3")
on_view("W3_running_score", PLAYS, lambda p: p.select("play_id", F.coalesce(F.sum("runs").over(before()), F.lit(0)).alias("score_before")), "SELECT play_id, CAST(coalesce(sum(runs) OVER (PARTITION BY game_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS score_before FROM plays")
on_view("W4_holder", PLAYS, lambda p: p.select("play_id", F.last(F.when(F.col("tag") == "signup", F.col("play_id")), ignorenulls=True).over(before()).alias("entry")), "SELECT play_id, last_value(CASE WHEN tag = 'signup' THEN play_id END IGNORE NULLS) OVER (PARTITION BY game_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS entry FROM plays")
on_view("W5_neighbours", PLAYS, lambda p: p.select("play_id", F.lag("play_id").over(game()).alias("prev"), F.lead("play_id").over(game()).alias("next")), 'SELECT play_id, lag(play_id) OVER w AS prev, lead(play_id) OVER w AS "next" FROM plays WINDOW w AS (PARTITION BY game_key ORDER BY seq)')
on_view("R11_final_play", PLAYS, lambda p: p.where("parse_status <> 'unparsed'").withColumn("k", F.row_number().over(W.partitionBy("game_key").orderBy(F.desc("seq")))).where("k = 1").select("game_key", "play_id"), "SELECT game_key, arg_max(play_id, seq) AS play_id FROM plays WHERE parse_status <> 'unparsed' GROUP BY game_key")
on_view("R13_contamination", PLAYS, lambda p: p.select("play_id", F.when((F.col("parse_status") == "ok") & F.coalesce(F.max((F.col("parse_status") == "unparsed").cast("int")).over(half()) == 1, F.lit(False)), "state_untrusted").otherwise(F.col("parse_status")).alias("status")), "SELECT play_id, CASE WHEN parse_status = 'ok' AND coalesce(max(CAST(parse_status = 'unparsed' AS INT)) OVER (PARTITION BY game_key, inning, half ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'state_untrusted' ELSE parse_status END AS status FROM plays")
# Lines of files, provenance, incremental maintenance.
on_table("S2_lines", "documents", lambda df: df.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw_line")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.max(F.length("raw_line")).cast("long").alias("longest")), r"SELECT doc_id, count(*) AS lines, CAST(max(length(raw_line)) AS BIGINT) AS longest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw_line FROM documents) GROUP BY doc_id")
on_table("S7_provenance", "documents", lambda df: df.select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("bytes")), "SELECT doc_id, sha256(text) AS digest, CAST(strlen(text) AS BIGINT) AS bytes FROM documents")
on_table("S8_sessionise", "conversations", lambda df: df.withColumn("span", F.sum((F.col("role") == "user").cast("long")).over(W.partitionBy("conv_id").orderBy("turn"))).groupBy("conv_id", "span").agg(F.min("turn").alias("first"), F.max("turn").alias("last"), F.count(F.lit(1)).alias("records")), """SELECT conv_id, span, min(turn) AS "first", max(turn) AS "last", count(*) AS records FROM (SELECT conv_id, turn, CAST(sum(CAST(role = 'user' AS BIGINT)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS span FROM conversations) GROUP BY conv_id, span""")
on_table("S9_occurrence", "documents", lambda df: df.select("doc_id", F.row_number().over(W.partitionBy(F.sha2("text", 256)).orderBy("doc_id")).cast("long").alias("occurrence")), "SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS occurrence FROM documents")


def rebuilt(df: DataFrame) -> DataFrame:
    lines = df.select("doc_id", F.sha2("text", 256).alias("held"), F.posexplode(F.split("text", "\n")).alias("line_no", "raw_line"))
    return lines.groupBy("doc_id", "held").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "raw_line"))), lambda x: x["raw_line"]), "\n"), 256).alias("digest")).select("doc_id", "digest", (F.col("held") == F.col("digest")).alias("same"))


on_table("S15_roundtrip", "documents", rebuilt, "SELECT doc_id, sha256(text) AS digest, true AS same FROM documents")
on_table("V06_same_digest", "documents", lambda df: df.groupBy(F.sha2("text", 256).alias("digest")).agg(F.count(F.lit(1)).alias("files"), F.min("doc_id").alias("first_id")).where("files > 1"), "SELECT sha256(text) AS digest, count(*) AS files, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")


def vintages(df: DataFrame) -> DataFrame:
    """Which documents of a new vintage are stale, missing or gone, by digest."""
    held = df.where("doc_id % 10 <> 3").select("doc_id", F.sha2("text", 256).alias("held"))
    now = df.where("doc_id % 10 <> 4").select("doc_id", F.sha2(F.when(F.col("doc_id") % 10 == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("now"))
    state = F.when(F.col("held").isNull(), "missing").when(F.col("now").isNull(), "gone").when(~F.col("held").eqNullSafe(F.col("now")), "stale").otherwise("current")
    return held.join(now, "doc_id", "full_outer").select("doc_id", state.alias("state"))


on_table("K6_stale_missing", "documents", vintages, "SELECT doc_id, CASE doc_id % 10 WHEN 3 THEN 'missing' WHEN 4 THEN 'gone' WHEN 5 THEN 'stale' ELSE 'current' END AS state FROM documents")

# Dimensions.
SOURCES = "SELECT c_custkey AS id, c_name AS name, 1 AS rank FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT s_suppkey, s_name, 2 FROM supplier UNION ALL SELECT o_custkey, concat('order ', CAST(o_custkey AS STRING)), 3 FROM orders"


def prioritised(spark: SparkSession, d: str) -> DataFrame:
    """One row an id: from the first source that has it."""
    return view(spark, d, SOURCES).groupBy("id").agg(F.min(F.struct("rank", "name")).alias("x")).select("id", "x.name", F.col("x.rank").cast("long").alias("source"))


add("Q1_people_priority", prioritised, f"SELECT id, name, CAST(rank AS BIGINT) AS source FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank, name) AS k FROM ({SOURCES})) WHERE k = 1")
on_table("Q3_names", "customer", lambda df: df.where(F.lower(F.regexp_replace(F.trim("c_name"), r"\s+", " ")).startswith("customer#00000001")).select("c_custkey", "c_name"), r"SELECT c_custkey, c_name FROM customer WHERE lower(regexp_replace(trim(c_name), '\s+', ' ', 'g')) LIKE 'customer#00000001%'")

on_view("G7_tag_census", PLAY_TAGS, lambda t: t.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") == "uncertain").alias("uncertain"), F.min("play_id").alias("first_seen")), "SELECT tag, count(*) AS n, count(*) FILTER (WHERE confidence = 'uncertain') AS uncertain, min(play_id) AS first_seen FROM play_tags GROUP BY tag")

# Curated tags, spans, appearances, parks, layout of a file.
MERGED = f"SELECT play_id, tag, 'certain' AS confidence, 'curated' AS source, 0 AS rank FROM ({PLAYS}) p WHERE play_id % 29 = 0 UNION ALL SELECT play_id, 'HiddenBallTrick', 'certain', 'curated', 0 FROM ({PLAYS}) q WHERE play_id % 31 = 0 UNION ALL SELECT play_id, tag, confidence, 'derived', 1 FROM ({PLAY_TAGS}) t"
on_view("G5_curated_wins", MERGED, lambda t: merged(t.where("source = 'derived'").drop("rank"), t.where("source = 'curated'").drop("rank")), f"SELECT play_id, tag, confidence, source FROM (SELECT *, row_number() OVER (PARTITION BY play_id, tag ORDER BY rank, confidence) AS k FROM ({MERGED}) m) WHERE k = 1")


def tiling(df: DataFrame) -> DataFrame:
    """Overlaps and gaps of ordered spans, from the furthest end so far."""
    spans = df.select("l_orderkey", F.col("l_linenumber").cast("long").alias("lo"), (F.col("l_linenumber") + F.col("l_suppkey") % 3).alias("hi"))
    so_far = F.max("hi").over(W.partitionBy("l_orderkey").orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, -1))
    return spans.withColumn("reached", so_far).groupBy("l_orderkey").agg(F.count_if(F.col("lo") <= F.col("reached")).alias("overlaps"), F.count_if(F.col("lo") > F.col("reached") + 1).alias("gaps"))


on_table("W7_tiling", "lineitem", tiling, "SELECT l_orderkey, count(*) FILTER (WHERE lo <= reached) AS overlaps, count(*) FILTER (WHERE lo > reached + 1) AS gaps FROM (SELECT l_orderkey, lo, max(hi) OVER (PARTITION BY l_orderkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM (SELECT l_orderkey, l_linenumber AS lo, l_linenumber + l_suppkey % 3 AS hi FROM lineitem)) GROUP BY l_orderkey")
add("A12_games_of_players", lambda s, d: tables(s, d).entries.join(tables(s, d).games, "game_key").groupBy("player", "season", "home").agg(F.countDistinct("game_key").alias("games")), f"{WITH} SELECT player, season, home, count(DISTINCT e.game_key) AS games FROM entries e JOIN games g ON g.game_key = e.game_key GROUP BY player, season, home")
on_view("B9_park_seasons", GAMES, lambda g: g.groupBy("home").agg(F.count(F.lit(1)).alias("games"), F.min("season").alias("first_season"), F.max("season").alias("last_season")), "SELECT home, count(*) AS games, min(season) AS first_season, max(season) AS last_season FROM games GROUP BY home")

#: Shapes of a layout; each may fail for TOLERATED of the rows.
LAYOUT, TOLERATED = {"flag": "l_returnflag IN ('A', 'N', 'R')", "discount": "l_discount <= 0.05", "line_number": "l_linenumber <= 6"}, 0.2


def layout(df: DataFrame) -> DataFrame:
    """Each shape's failures, all counted in one pass."""
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(~F.coalesce(F.expr(rule), F.lit(False))).alias(name) for name, rule in LAYOUT.items()])
    each = one.select("rows", F.expr(f"stack({len(LAYOUT)}, {', '.join(f'{chr(39)}{n}{chr(39)}, {n}' for n in LAYOUT)}) AS (shape, failures)"))
    return each.select("shape", "failures", (F.col("failures") <= F.col("rows") * TOLERATED).alias("holds"))


on_table("S26_layout", "lineitem", layout, " UNION ALL ".join(f"SELECT '{n}' AS shape, count(*) FILTER (WHERE NOT coalesce({r}, false)) AS failures, count(*) FILTER (WHERE NOT coalesce({r}, false)) <= count(*) * {TOLERATED} AS holds FROM lineitem" for n, r in LAYOUT.items()))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searches.S.outs(2).tag("purchase").run(tables(spark, sf_dir)).select(*searches.KEYS, "inning", "half", "bases_before")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


__all__ = ["checks", "earned", "files", "flagship", "lines", "oracle_sql", "plays", "queries", "roles", "searches"]
