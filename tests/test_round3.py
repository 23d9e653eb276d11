"""Findings of the third round: ties, repeated ids, work that is linear in its input, log files of any size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlog.functions.events import parsed
from fieldlog.functions.moves import moved, read
from fieldlog.llm import id_store as I
from fieldlog.operators import curated as K
from fieldlog.operators import ingest
from fieldlog.operators import star
from fieldlog.operators.fold import replayed, replayed_log
from fieldlog.operators.search import held_spans, holders
from fieldlog.plans import earned, files, plays
from fieldlog.sources import archive as A
from fieldlog.sources import auxiliary as X
from fieldlog.sources import event_files as E
from fieldlog.sources import reference_files as R


@pytest.mark.parametrize("turn", [1, -1])
def test_entries_at_one_place(spark, turn):
    entries = spark.createDataFrame([(1, 0, 2, None, "b"), (1, 0, 2, None, "a"), (1, 0, 2, 4, "d"), (1, 0, 2, 4, "c")][::turn], "game_key long, team int, position int, seq long, player string")
    log = spark.createDataFrame([(1, 1, s, 10 + s) for s in range(1, 7)][::turn], "game_key long, batting_team int, seq long, play_id long")
    assert [r.player for r in holders(log, entries).orderBy("play_id").collect()] == ["b"] * 4 + ["d"] * 2
    assert sorted((r.player, r.from_seq, r.to_seq) for r in held_spans(entries).collect() if r.from_seq != r.to_seq) == [("b", 0, 4), ("d", 4, None)]


def test_shared_lines_count_once(spark):
    schema = "path string, game_id string, raw_line string"
    new = spark.createDataFrame([("new", "g", "x"), ("new", "g", "x"), ("new", "h", "y")], schema)
    held = spark.createDataFrame([("a", "g", "x"), ("a", "g", "x"), ("b", "g", "x"), ("new", "h", "y")], schema)
    assert sorted(tuple(r) for r in R.held_elsewhere(new, held).collect()) == [("new", "a", 2), ("new", "b", 2)]


def test_notes_of_games_with_one_id(spark, tmp_path):
    """Games whose keys are 2800 apart have one id; its notes are written once."""
    rows = [(100 * g + k, g, "view", 1.0, "{}", f"2024-01-0{1 + k // 5} 0{k % 5}:00:00") for g in (3, 2803) for k in range(9)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string, at string").withColumn("ts", F.to_timestamp("at")).drop("at").write.parquet(f"{tmp_path}/events.parquet")
    files.noted(spark, str(tmp_path)).write.partitionBy("k").text(f"{tmp_path}/notes")
    found = K.load(spark, f"{tmp_path}/notes")
    assert sorted((r.seq, r.tag) for r in found.collect()) == [(s, t) for s in (5, 7) for t in ("HiddenBallTrick", "Strikeout")] and found.select("game_id").distinct().count() == 1


def test_fields_as_by_the_pattern(spark):
    lines = ['a,"b,c",d', 'a,"b', '"a,b', ',"",', '"x, y"', 'a,b"c,d"e,f', '"a ""q"", z",1', '",",",', "plain,line,", "", f'a{E.SIGN},"b,c",d']
    df = spark.createDataFrame([(x,) for x in lines], "raw string")
    by_pattern = F.transform(F.split("raw", E.OUTSIDE_QUOTES), lambda x: F.regexp_replace(x, '^"(.*)"$', "$1"))
    for r in df.select("raw", E.fields(F.col("raw")).alias("ours"), F.when(F.col("raw").contains('"'), by_pattern).otherwise(F.split("raw", ",")).alias("theirs")).collect():
        assert r.ours == r.theirs, r.raw


def test_texts_are_read_once(spark):
    df = spark.createDataFrame([(i, e) for i, e in enumerate(["S7", "K", None, "S7", "XX", None, "64(1)3/GDP/G6", "K"])], "k long, event string")
    assert sorted(map(str, read(df).select("k", "event", "parse_ok", "entries", "outs", "move_b").collect())) == sorted(map(str, moved(parsed(df)).select("k", "event", "parse_ok", "entries", "outs", "move_b").collect()))
    assert read(df).count() == 8
    dealt = plays.dealt_once(spark, "/root/testdata/sf0.001", [("S7",), ("K",), ("S7",)], "event string")
    assert dealt.count() == 2 and plays.counted(dealt, "event").agg(F.sum("n")).first()[0] == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()


def test_archived_texts_are_read_once(spark):
    """The archive's check and the tables' log parse different texts, not plays; the counts are those of the plays."""
    events = {"a": ["S7", "S7", "XX", "K", "XX", "XX", ""], "b": ["K"], "c": []}
    rows = [(p, i + 2, f"play,1,0,x,00,,{e}", "\n", 2000, "d") for p, texts in events.items() for i, e in enumerate(texts)] + [(p, 1, "id,AAA200001010", "\n", 2000, "d") for p in events]
    lines = spark.createDataFrame(rows, "path string, line_no int, raw_line string, line_end string, season int, digest string")
    checks = A.event_checks(lines)
    assert sorted(map(tuple, checks.select("path", "plays", "unparsed", "altered").collect())) == [("a", 6, 3, 0), ("b", 1, 0, 0)]
    recs = E.records(lines).withColumns({"game_key": F.xxhash64("path", "game_id"), "nth": F.lit(1)})
    for df in (checks, ingest.folded(recs)):
        # The parts of an event are made above an aggregate of its text.
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert any("Aggregate [event" in x or "Aggregate [text" in x or "Aggregate [array_join" in x or "Aggregate [_groupingexpression" in x for x in plan.splitlines())


def test_halves_are_folded_once(spark, tmp_path):
    """Halves that many orders pick are folded and judged once, and every order has their verdicts; numbers that repeat are orders of their own."""
    n = len(earned.HALVES)
    spark.createDataFrame([(k,) for k in [*range(3 * n), 0, n - 1]], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    told, verdicts = earned.kept(spark, str(tmp_path))
    assert told.count() == sum(len(h[0].split()) for h in earned.HALVES)
    whole = {i: h[4] for i, h in enumerate(earned.HALVES) if h[4]}
    assert {(r.half, r.verdicts): r.n for r in earned.verdict_lines(spark, str(tmp_path)).collect()} == {(i, v): 4 if i in (0, n - 1) else 3 for i, v in whole.items()}
    assert earned.each(spark, str(tmp_path), verdicts).count() == 3 * verdicts.count() + sum(v.count("|") + 1 for i, v in whole.items() if i in (0, n - 1))


def test_parts_of_events_stay_out_of_the_fold(spark):
    """What the fold collects are moves, not parts of events; flags and statuses resolve no movement; the rows are those of a fold of whole plays."""
    events = ["S7", "W.1-2", "CS3(25)", "K/DP.1X2(26)", "XX", "K", "D8.3-H", "64(1)3/GDP", "K"]
    rows = [(g, i, i // 6, "top", f"p{i}", events[(i * 5 + g) % len(events)]) for g in range(3) for i in range(18)]
    df = spark.createDataFrame(rows, "game_key long, seq long, inning int, half string, batter string, event string")
    ours, whole = replayed_log(df), replayed(read(df))
    columns = ["game_key", "seq", "event", "b1", "b2", "b3", "outs_before", "outs", "runs", "flags", "parse_status", "resolved", "bases_after", "forced"]
    assert sorted(map(str, ours.select(columns).collect())) == sorted(map(str, whole.select(columns).collect()))
    assert any("advance_from_empty_base" in r.flags for r in ours.collect())
    plan = ours.select("flags", "resolved")._jdf.queryExecution().optimizedPlan().toString()
    assert all("basics" not in x for x in plan.splitlines() if "collect_list" in x)
    assert "was_placed" not in ours.select("flags", "parse_status")._jdf.queryExecution().optimizedPlan().toString()


def test_checks_send_no_log_through_the_driver(spark):
    """Every join of the checks but that with the list of tags is made without a broadcast."""
    types = {n: "play_id long, game_key long, inning int, half string, seq long, tag string, origin string, is_out boolean, scored boolean, is_force boolean, certainty string, runner_id string, outs_before int, outs int, outs_after int, bases_before string, bases_after string, runs int, batter_ran string, parse_status string, hit_location string" for n in ("plays", "advances", "credits", "sequences", "play_tags")}
    types |= {"games": "game_key long, plays long", "tags": "name string"}
    frames = {n: spark.createDataFrame([], t) for n, t in types.items()}
    for name in star.CHECKS:
        if name != "V15_tag_without_name":
            plan = star.violations(frames, only=name)._jdf.queryExecution().sparkPlan().toString()
            assert "Broadcast" not in plan, name


def test_log_files_are_read_in_parts(spark, tmp_path):
    """Lines keep their numbers and files their digests, however they are cut."""
    (tmp_path / "in/a b+c%").mkdir(parents=True)
    data = "".join(f"line {i},\xe9{'x' * (i % 7)}{chr(13) if i % 3 == 0 else ''}\n" if i % 5 else "\n" for i in range(3000)).encode("latin-1") + b"last"
    (tmp_path / "in/a b+c%/GL2000.TXT").write_bytes(data)
    (tmp_path / "in/two.txt").write_bytes(b"\n\nx")
    want = {r.path: r for r in E.event_files(spark, f"file://{tmp_path}/in", X.LOG_NAMES).collect()}
    seen = []
    for size in ("128m", "2000b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            text = X.log_text(spark, f"file://{tmp_path}/in", X.LOG_NAMES)
            assert (text.select("path", "block").distinct().count() > 2) == (size != "128m")
            text.write.parquet(f"{tmp_path}/{size}")
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        lines = X.numbered(spark.read.parquet(f"{tmp_path}/{size}"))
        for path, f in want.items():
            assert [(r.line_no, r.raw_line) for r in lines.where(F.col("path") == path).orderBy("line_no").collect()] == [(i + 1, x.removesuffix("\r")) for i, x in enumerate(bytes(f.content).decode("latin-1").split("\n"))]
        seen.append({r.path: r.digest for r in X.digests(lines).collect()})
    assert seen[0] == seen[1] and set(seen[0]) == set(want) and len(set(seen[0].values())) == 2


def test_streams_cut_together_as_alone():
    """The marks of streams that stand one after another cut each where it is cut alone."""
    r = np.random.default_rng(3)
    streams = [r.integers(0, 49000, n).astype("<u4") for n in (1, 15, 16, 127, 128, 129, 700, 1, 9000, 3000)]
    together, start = I.marks(np.concatenate(streams)), 0
    for x in streams:
        own = together[(together > start) & (together <= start + len(x))] - start
        assert I.ends(own.tolist(), len(x)) == I.cuts(x)
        g = I.mixed(x).astype(object)
        slow = [k + 1 for k in range(len(x)) if ((sum(int(g[k - j]) << j for j in range(min(I.WINDOW, k + 1))) & 0xFFFFFFFF) >> 20) % I.AVERAGE == 0]
        assert I.marks(x).tolist() == slow
        start += len(x)
