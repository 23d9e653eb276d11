"""Files to records, the archive, streams."""

import hashlib

import pytest
from pyspark.sql import functions as F

from fieldlog.functions.events import parsed
from fieldlog.functions.moves import moved
from fieldlog.operators.fold import replayed
from fieldlog.sources import archive as A
from fieldlog.sources import event_files as E
from fieldlog.sources import sinks
from fieldlog.streaming.live import ingest, live_bases

FIRST = (
    b'id,AAA200004010\r\ninfo,visteam,BBB\r\ninfo,hometeam,AAA\r\nstart,x001,"Jos\xe9 ""Q"", Jr.",0,1,4\r\n'
    b"play,1,0,x001,12,CSX,S7\r\nplay,1,0,x002,??,,SB2\r\nplay,1,0,x002,01,,64(1)3/GDP\r\nplay,1,0,x003,00,X,8/F8,odd\r\nplay,1\r\nplay,1,1,y001,00,X,HR/F7\r\n"
)
SECOND = b"id,AAA200004010\nplay,1,0,x001,00,,K\n\nid,AAA200004020\nplay,1,0,x009,00,,W"


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/2000AAA.EVA").write_bytes(FIRST)
    (tmp_path / "in/deep/2001AAA.EVN").write_bytes(SECOND)
    (tmp_path / "in/2000EMP.EVA").write_bytes(b"")
    (tmp_path / "in/notes.txt").write_bytes(b"id,no")
    return tmp_path


def test_files_to_plays(spark, folder):
    files = E.event_files(spark, f"file://{folder}/in")
    about = {r.path.rsplit("/", 1)[1]: r for r in E.provenance(files).collect()}
    assert set(about) == {"2000AAA.EVA", "2001AAA.EVN"}
    a, b = about["2000AAA.EVA"], about["2001AAA.EVN"]
    assert (a.digest, a.line_ending, a.season, a.records, a.open_end) == (hashlib.sha256(FIRST).hexdigest(), "crlf", 2000, 10, False)
    assert (b.line_ending, b.records, b.open_end) == ("lf", 5, True)
    again = {r.path.rsplit("/", 1)[1]: r.digest for r in E.rebuilt(E.lines(files)).collect()}
    assert again == {n: about[n].digest for n in again} and len(again) == 2

    recs = E.records(E.lines(files))
    start = recs.where("record_type = 'start'").first()
    assert start.fields[2] == 'José ""Q"", Jr.' and len(start.fields) == 6
    spans = [(r.game_id, r.occurrence, r.records) for r in E.game_spans(recs).orderBy("game_id", "occurrence").collect()]
    assert spans == [("AAA200004010", 1, 10), ("AAA200004010", 2, 2), ("AAA200004020", 1, 2)]
    assert [(r.seq, r.key, r.value) for r in E.game_info(recs).orderBy("seq").collect()] == [(0, "visteam", "BBB"), (1, "hometeam", "AAA")]
    plays = E.plays(recs).where("path LIKE '%2000AAA.EVA'").orderBy("seq").collect()
    assert [(p.balls, p.strikes, p.event, p.problem) for p in plays] == [(1, 2, "S7", None), (None, None, "SB2", None), (0, 1, "64(1)3/GDP", None), (0, 0, "8/F8,odd", None), (None, None, None, "short record"), (0, 0, "HR/F7", None)]
    assert E.statistics(files).first().asDict() == {"files": 2, "records": 14, "games": 3, "plays": 8, "problems": 1, "repeated_ids": 1}


def test_new_and_changed(spark):
    found = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, digest string")
    held = spark.createDataFrame([("a", "1"), ("b", "9")], "path string, digest string")
    new, changed = E.new_and_changed(found, held)
    assert [r.path for r in new.collect()] == ["c"] and [r.path for r in changed.collect()] == ["b"]


def test_archive_grows_by_new_files(spark, folder):
    run = lambda: ingest(spark, f"file://{folder}/in", f"file://{folder}/out", f"file://{folder}/at").awaitTermination()
    run()
    (folder / "in/2002AAA.EVA").write_bytes(SECOND)
    run()
    held = A.manifest(spark, f"file://{folder}/out")
    assert A.versions(spark, f"file://{folder}/out") == [1, 2]
    assert held.count() == 3 and held.select("path").distinct().count() == 3
    assert spark.read.parquet(f"file://{folder}/out/raw_records").count() == 20


def test_sinks(spark, folder):
    df = spark.createDataFrame([(1, ["x", "y"], 2000), (2, [], 2001)], "k long, tags array<string>, season int")
    at = f"file://{folder}/t"
    sinks.replace_partitions(df, at)
    sinks.replace_partitions(df.where("season = 2001").withColumn("k", F.lit(7).cast("long")), at)
    assert sorted((r.k, r.season) for r in spark.read.parquet(at).collect()) == [(1, 2000), (7, 2001)]
    sinks.write_csv(sinks.stamped(df, "v1"), f"{at}-csv")
    assert sorted(tuple(r) for r in spark.read.option("header", True).csv(f"{at}-csv").collect()) == [("1", "x;y", "2000", "v1"), ("2", None, "2001", "v1")]
    sinks.write_json(df, f"{at}-json")
    assert spark.read.json(f"{at}-json").count() == 2
    assert [r.k for r in sinks.without(df, df.where("k = 1"), "k").collect()] == [2]


def test_live_bases_are_those_of_the_fold(spark, folder):
    events = ["S7", "W.1-2", "SB3", "64(1)3/GDP", "K", "D8.1-H", "CS3(25)", "PO1(13)", "NP", "K.1X2(26)"]
    rows = [(g, i, i // 5, "top" if i % 10 < 5 else "bottom", f"p{i}", events[(i * 7 + g) % len(events)]) for g in range(3) for i in range(30)]
    df = spark.createDataFrame(rows, "game_key long, seq long, inning int, half string, batter string, event string")
    whole = moved(parsed(df))
    df = whole.select("game_key", "seq", "inning", "half", "batter", "outs", "may_retry", "move_b", "move_1", "move_2", "move_3")
    df.repartition(2).write.parquet(f"file://{folder}/plays")
    stream = live_bases(spark.readStream.schema(df.schema).parquet(f"file://{folder}/plays"))
    stream.writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", f"file://{folder}/c").trigger(availableNow=True).start().awaitTermination()
    key = lambda x: sorted(tuple(r) for r in x.select("game_key", "seq", "bases_before", "outs_before").collect())
    assert key(spark.table("live")) == key(replayed(whole)) and len(rows) == 90
