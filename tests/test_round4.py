"""Findings of the fourth round: nothing sampled, games that share ids, work and disk that larger tables need."""

import time

import duckdb
import pytest
from pyspark.sql import functions as F

from fieldlog.operators import ingest
from fieldlog.operators import reconcile as C
from fieldlog.plans.queries import oracle_sql, queries
from fieldlog.sources import reference_files as R
from fieldlog.sources import sinks


@pytest.fixture(scope="module")
def shared_ids(spark, tmp_path_factory):
    """Events of users of whom three at a time have keys 2,800 apart, so that their games share an id."""
    d = str(tmp_path_factory.mktemp("shared_ids"))
    users = [k + 2800 * n for k in range(1, 21) for n in range(3)]
    rows = [(61 * u + k, u, f"2024-01-0{1 + k // 8} {k % 8 * 3:02d}:00:00") for u in users for k in range(24)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, at string")
    df.select("event_id", F.to_timestamp("at").alias("ts"), "user_id", F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props")).coalesce(1).write.parquet(f"{d}/events.parquet")
    return d


def as_sql(spark, d, name):
    """Rows of a query over events alone, and of its SQL."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet/*.parquet'")
    theirs = con.execute(oracle_sql()[name])
    names = [x[0] for x in theirs.description]
    return sorted(map(str, map(tuple, queries()[name](spark, d).select(names).collect()))), sorted(map(str, theirs.fetchall()))


def test_totals_of_all_games(spark):
    """Every held game with both figures is a candidate, however many there are."""
    n = 4100
    ids = spark.range(n).select(F.col("id").alias("game_key"), F.format_string("G%05d", "id").alias("game_id"))
    games = ids.withColumn("occurrence", F.lit(1))
    logs = ids.select("game_id", F.lit("2000-04-01").alias("date"), F.lit("A").alias("home_league"), F.lit("regular").alias("series"), F.lit(1).alias("away_score"), F.lit(2).alias("home_score"), F.lit(1).alias("away_er"), F.lit(0).alias("home_er"), F.lit(2).alias("away_er_team"), F.lit(0).alias("home_er_team"))
    recs = ids.select("game_key", F.lit("data").alias("record_type"), F.array(F.lit("data"), F.lit("er"), F.lit("p"), F.when(F.col("game_key") % 2 == 0, "1").otherwise("2")).alias("fields"))
    found = C.which_total(games, recs, logs).first()
    assert (found.candidates, found.checked, found.individual, found.team, found.answer) == (n, n, n // 2, n // 2, None)


def test_totals_of_games_with_one_id(spark, shared_ids):
    ours, theirs = as_sql(spark, shared_ids, "A8_which_total")
    assert ours == theirs


def test_missing_games_of_one_id(spark, shared_ids):
    ours, theirs = as_sql(spark, shared_ids, "A6_missing_by_league")
    assert ours == theirs


def test_scores_of_games_with_one_id(spark, shared_ids):
    ours, theirs = as_sql(spark, shared_ids, "A7_scores")
    assert ours == theirs


@pytest.mark.parametrize("turn", [1, -1])
def test_games_listed_alike(spark, turn):
    """Of rows with one score that differ in marks alone the same one counts, in whatever order they come."""
    schema = "game_id string, date string, home_league string, series string, away_score int, home_score int, forfeit string, completion string"
    rows = [("A", "2000-01-01", "X", "regular", 1, 2, f, c) for f, c in (("V", ""), (" ", ""), ("", "later"))]
    games = spark.createDataFrame([(2000, "A", 1, 1, 2), (2000, "A", 2, 1, 3)], "season int, game_id string, occurrence int, final_away long, final_home long")
    found = C.reconciled(games, spark.createDataFrame(rows[::turn], schema).coalesce(1), in_order=False)
    assert sorted((r.nth, r.verdict) for r in found.collect()) == [(1, "agree"), (2, "differ")]


def test_lines_of_logs_are_split_once(spark):
    """Whatever is asked of the fields of a line, also which rows have no problem, it is split once; rows without text stay."""
    plan = queries()["S26_log_layout"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert all("split(" not in x for x in plan.splitlines() if "Filter" in x)
    # Strings in quotes are split at quotes, then at the sign, or by the pattern; others at commas.
    assert plan.count("split(") <= 6
    lines = spark.createDataFrame([("GL2000.TXT", 1, None), ("GL2000.TXT", 2, "a,b")], "path string, line_no int, raw_line string")
    assert [(r.line_no, r.problem) for r in R.game_logs(lines).orderBy("line_no").collect()] == [(1, "score"), (2, "number of fields")]


def test_steps_leave_no_shuffles(spark, tmp_path, monkeypatch):
    """What a step of a build has shuffled is deleted with it; the session's setting is as before."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {str(x) for x in blocks.getAllFiles().mkString(" ").split() if "/shuffle_" in x}
    before, was = held(), spark.conf.get(sinks.CLEANUP, None)
    with sinks.freed(spark):
        spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().write.parquet(f"{tmp_path}/counts")
    for _ in range(50):
        if not held() - before:
            break
        time.sleep(0.1)
    assert not held() - before and spark.conf.get(sinks.CLEANUP, None) == was

    def seen(frame, *more):
        raise RuntimeError(spark.conf.get(sinks.CLEANUP))

    monkeypatch.setattr(ingest.A, "publish", seen)
    monkeypatch.setattr(ingest.L, "archived", seen)
    for step in (lambda: ingest.build(spark, str(tmp_path), str(tmp_path)), lambda: ingest.derive(spark, str(tmp_path))):
        with pytest.raises(RuntimeError, match="true"):
            step()
    assert spark.conf.get(sinks.CLEANUP, None) == was
