"""Event files to tables, versions of the archive, and refreshes."""

import pytest
from pyspark.sql import functions as F

from fieldlog.operators import curated as K
from fieldlog.operators import ingest as I
from fieldlog.operators import reconcile as C
from fieldlog.operators.search import Search
from fieldlog.sources import archive as A
from fieldlog.sources import event_files as E

FIRST = """id,AAA202008010
version,2
info,visteam,BBB
info,hometeam,AAA
info,site,AAA01
info,date,2020/8/1
info,number,0
info,usedh,true
info,innings,7
info,htbf,false
info,gametype,regular
info,pitches,pitches
info,tiebreaker,2
start,bp1,"B Pitcher",0,0,1
start,bb1,"B One",0,1,4
start,ap1,"A Pitcher",1,0,1
start,aa1,"A One, Jr.",1,1,4
play,1,0,bb1,12,CX,S7
play,1,0,bb2,00,X,HR/F7.1-H
play,1,0,bb3,00,X,K
play,1,0,bb4,00,X,8/F8
play,1,0,bb5,00,X,63/G6
play,1,1,aa1,00,X,K
com,"replay,1,aa2,AAA,u01,AAA01,X,Y,N"
play,1,1,aa2,00,X,S8/MREV
sub,bp2,"B Relief",0,0,1
presadj,bp1,1
ladj,1,3
play,1,1,aa3,00,X,W.1-2
play,1,1,aa4,00,X,garbage?!x
play,1,1,aa5,00,X,64(1)3/GDP
play,8,0,bb1,00,,NP
sub,ap2,"A Relief",1,0,1
radj,bb6,2
play,8,0,bb1,00,X,S8.2-H
play,8,0,bb2,00,X,K
play,8,0
data,er,bp1,0
"""
# The home side bats first; a walk-off ends the game early.
SECOND = """id,CCC201905010
info,visteam,BBB
info,hometeam,CCC
info,date,2019/05/01
info,htbf,TRUE
start,cp1,"C",1,0,1
start,bp9,"B",0,0,1
play,1,1,c1,00,X,HR/F7
play,1,1,c2,00,X,K
play,1,1,c3,00,X,K
play,1,1,c4,00,X,K
play,1,0,b1,00,X,W
play,1,0,b2,00,X,HR/F8.1-H
id,CCC201905020
info,visteam,BBB
info,hometeam,CCC
play,1,0,b1,00,X,K
"""


@pytest.fixture()
def place(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/2020AAA.EVA").write_text(FIRST)
    (tmp_path / "in/2019CCC.EVN").write_bytes(SECOND.replace("\n", "\r\n").encode("latin-1"))
    return tmp_path


def read(spark, place, name):
    return spark.read.parquet(f"file://{place}/out/tables/{name}")


def test_files_to_tables_and_refreshes(spark, place, monkeypatch):
    files, out = f"file://{place}/in", f"file://{place}/out"
    I.build(spark, files, out)
    games = {r.game_id: r for r in read(spark, place, "games").collect()}
    g = games["AAA202008010"]
    assert (g.season, g.date, g.game_number, g.home, g.away, g.league, g.park, g.game_type, g.scheduled_innings, g.use_dh, g.home_bats_first, g.pitch_detail, g.tiebreaker_base) == (2020, "2020-08-01", 0, "AAA", "BBB", "AL", "AAA01", "regular", 7, True, False, "pitches", 2)
    # One play can't be read, one can't be parsed.
    assert (g.final_home, g.final_away, g.plays, g.status, g.occurrence) == (0, 3, 13, "suspect", 1)
    c = games["CCC201905010"]
    assert (c.home_bats_first, c.final_home, c.final_away, c.plays, c.status, c.league, c.scheduled_innings, c.pitch_detail, c.game_type) == (True, 1, 2, 6, "ok", "NL", None, None, None)
    assert len(read(spark, place, "games").columns) == 22 and games["CCC201905020"].status == "ok"

    plays = {(r.game_key, r.seq): r for r in read(spark, place, "plays").collect()}
    assert [plays[c.game_key, k].half for k in (1, 6)] == ["top", "bottom"] and plays[c.game_key, 6].walk_off and plays[c.game_key, 6].final_play
    frame = {(r.game_key, r.seq): r for r in read(spark, place, "derived").collect()}
    of = lambda k: frame[g.game_key, k]
    assert [of(k).pitcher for k in (1, 7, 8, 11, 12)] == ["ap1", "bp1", "bp2", "ap1", "ap2"]
    assert [tuple(r) for r in of(8).responsible] == [("1", "bp1")] and of(9).responsible == []
    assert [(k, of(k).after_ladj) for k in (7, 8, 9, 10)] == [(7, False), (8, True), (9, False), (10, False)]
    assert [(of(k).bases_before, of(k).has_placed_runner) for k in (11, 12, 13)] == [("000", False), ("010", True), ("100", False)]
    tags = {(r.seq, r.tag) for r in read(spark, place, "play_tags").where(F.col("game_key") == g.game_key).collect()}
    assert {(8, "BattingOutOfTurn"), (12, "PlacedRunner"), (12, "ExtraInnings"), (7, "ReplayReviewed"), (7, "ReplayOverturned")} <= tags
    assert [(r.seq, r.runner_id, r.was_placed) for r in read(spark, place, "advances").where("was_placed").collect()] == [(12, "bb6", True)]
    earned = sorted((r.game_key == g.game_key, r.seq, r.runner_id, r.pitcher_id, r.earned_team) for r in read(spark, place, "earned").collect())
    assert earned == sorted([(True, 2, "bb1", "ap1", True), (True, 2, "bb2", "ap1", True), (True, 12, "bb6", "ap2", False), (False, 1, "c1", "bp9", True), (False, 6, "b1", "cp1", True), (False, 6, "b2", "cp1", True)])
    entries = [(r.player, r.seq, r.name) for r in read(spark, place, "lineup_entries").where(F.col("game_key") == g.game_key).orderBy("entry").collect()]
    assert entries == [("bp1", None, "B Pitcher"), ("bb1", None, "B One"), ("ap1", None, "A Pitcher"), ("aa1", None, "A One, Jr."), ("bp2", 7, "B Relief"), ("ap2", 11, "A Relief")]
    assert [(r.kind, r.reversed, r.comment) for r in read(spark, place, "comments").collect()] == [("replay", True, 0)]
    assert read(spark, place, "game_info").where(F.col("game_key") == g.game_key).count() == 11
    found = Search().tag("PlacedRunner").run(I.stored(spark, out)).collect()
    assert [(r.season, r.seq) for r in found] == [(2020, 12)]

    # Nothing is new: no version.
    archive = f"{out}/archive"
    assert A.publish(spark, E.event_files(spark, files), archive) is None and A.versions(spark, archive) == [1]
    assert A.statistics(spark, archive, 1).first().asDict() == {"files": 2, "skipped": 0, "records": 55, "plays": 20, "unparsed": 1, "altered": 0, "refreshed": 0}

    # A play corrected in one game, a line before another (its own lines are the same), and a file of a new season.
    (place / "in/2020AAA.EVA").write_text(FIRST.replace("play,1,0,bb3,00,X,K", "play,1,0,bb3,00,X,K23"))
    (place / "in/2019CCC.EVN").write_text("com,\"note\"\n" + SECOND)
    (place / "in/2021AAA.EVA").write_text(FIRST.replace("2020", "2021"))
    with pytest.raises(A.CorpusChanged) as refused:
        A.publish(spark, E.event_files(spark, files), archive)
    assert len(refused.value.paths) == 2 and A.versions(spark, archive) == [1]

    # A run that is killed after staging leaves the version as it was, and the next one succeeds.
    def killed(*_):
        raise KeyboardInterrupt

    before = sorted(tuple(r) for r in A.lines(spark, archive).select("line_no", "raw_line").collect())
    with monkeypatch.context() as m:
        m.setattr(A, "event_checks", killed)
        with pytest.raises(KeyboardInterrupt):
            A.publish(spark, E.event_files(spark, files), archive, refresh=True)
    assert A.versions(spark, archive) == [1] and sorted(tuple(r) for r in A.lines(spark, archive).select("line_no", "raw_line").collect()) == before
    assert A.unreferenced(spark, archive).count() == 3

    states = {r.state: r for r in I.refresh(spark, files, out).collect()}
    assert set(states) == {"stale", "reissued", "missing"} and A.versions(spark, archive) == [1, 2] and A.unreferenced(spark, archive).count() == 0
    revised = {r.path.rsplit("/", 1)[1]: r for r in A.revisions(spark, archive).collect()}
    assert {n: (r.old_records, r.records, r.games_replaced, r.version) for n, r in revised.items()} == {"2020AAA.EVA": (38, 38, 1, 2), "2019CCC.EVN": (17, 18, 2, 2)}
    assert A.statistics(spark, archive, 2).first().asDict() == {"files": 3, "skipped": 0, "records": 94, "plays": 33, "unparsed": 2, "altered": 0, "refreshed": 2}
    now = {r.game_id: r for r in read(spark, place, "games").collect()}
    assert set(now) == set(games) | {"AAA202108010"} and now["CCC201905010"].digest != games["CCC201905010"].digest and now["CCC201905010"].content == games["CCC201905010"].content
    assert read(spark, place, "plays").where(F.col("event") == "K23").count() == 1
    assert {r.state for r in I.vintages(spark, out).collect()} == {"current"}
    # Two vintages stay readable.
    assert A.lines(spark, archive, version=1).where(F.col("raw_line").contains("K23")).count() == 0 and A.lines(spark, archive, seasons=[2020]).where(F.col("raw_line").contains("K23")).count() == 1


def test_curated_notes(spark, place):
    """All faults at once; good notes reach the tables of the plays they name."""
    notes = place / "notes"
    notes.mkdir()
    (notes / "a.json").write_text('{"entries": [{"game_id": "AAA202008010", "play_seq": 3, "tags": ["HiddenBallTrick", "Strikeout"], "note": "x"},\n {"game_id": "AAA202008010", "play_seq": 9, "tags": ["Balk"]}, {"game_id": "QQQ202008010", "play_seq": 1, "tags": ["Balk"]}]}')
    good = K.load(spark, f"file://{notes}")
    assert sorted((r.game_id, r.seq, r.tag, r.note) for r in good.collect()) == [("AAA202008010", 3, "HiddenBallTrick", "x"), ("AAA202008010", 3, "Strikeout", "x"), ("AAA202008010", 9, "Balk", None), ("QQQ202008010", 1, "Balk", None)]
    I.build(spark, f"file://{place}/in", f"file://{place}/out", curated=f"file://{notes}")
    tags = read(spark, place, "play_tags").where("source = 'curated'").collect()
    assert sorted((r.seq, r.tag, r.confidence) for r in tags) == [(3, "HiddenBallTrick", "certain"), (3, "Strikeout", "certain")]
    assert read(spark, place, "play_tags").where("seq = 3 AND tag = 'Strikeout' AND season = 2020").count() == 1
    # One play isn't parsed, one game isn't held.
    lost = K.unmatched(good, read(spark, place, "plays"), read(spark, place, "games")).collect()
    assert sorted((r.game_id, r.seq) for r in lost) == [("AAA202008010", 9), ("QQQ202008010", 1)]

    (notes / "b.json").write_text('{"entries": [{"game_id": "", "play_seq": 1, "tags": ["Balk"]}, {"game_id": "G", "tags": ["Balk"]}, {"game_id": "G", "play_seq": 2, "tags": []}, {"game_id": "AAA202008010", "play_seq": 3, "tags": ["Blak", "Balk"]}]}')
    (notes / "c.json").write_text("no notes")
    with pytest.raises(K.CuratedError) as refused:
        K.load(spark, f"file://{notes}")
    told = sorted(what for *_, what in refused.value.problems)
    assert told == ["2 entries", "no JSON of this kind", "no game", "no number of a play", "no tags", "unknown tags Blak"]


def test_repeated_ids_and_bad_figures_in_reconciliation(spark):
    games = spark.createDataFrame([(2000, "A", 1, 1, 2), (2000, "A", 2, 5, 6), (2000, "B", 1, 0, 0)], "season int, game_id string, occurrence int, final_away long, final_home long")
    schema = "game_id string, date string, home_league string, series string, away_score int, home_score int, forfeit string, completion string"
    logs = spark.createDataFrame([("A", "2000-01-01", "X", "regular", 1, 2, "", ""), ("A", "2000-01-01", "X", "ws", 1, 2, "", ""), ("A", "2000-01-02", "X", "regular", 5, 7, "", ""), ("C", "1999-01-01", "X", "regular", 1, 1, "", ""), ("D", "2000-05-05", None, "regular", 1, 1, "V", "")], schema)
    got = sorted((r.game_id, r.nth, r.verdict) for r in C.reconciled(games, logs).collect())
    assert got == [("A", 1, "agree"), ("A", 2, "differ"), ("B", 1, "held_only"), ("C", 1, "before"), ("D", 1, "gap")]
    missing = C.missing_games(games, logs)
    assert sorted((str(r.league), r.published, r.missing) for r in missing.collect()) == [("None", 1, 1), ("X", 2, 0)]
    coverage = spark.createDataFrame([(2000, "X"), (2000, "Y"), (2000, None)], "season int, league string")
    assert sorted((str(r.league), r.games_missing) for r in C.covered(coverage, missing).collect()) == [("None", 1), ("X", 0), ("Y", None)]
    rows = [(1, ["data", "er", "p", "2"]), (1, ["data", "er", "p", "1"]), (1, ["data", "er", "q", "0"]), (2, ["data", "er", "p", "3"]), (2, ["data", "er", "q", "(unknown)"]), (3, ["data", "xx", "p", "3"])]
    recs = spark.createDataFrame([(g, "data", f) for g, f in rows], "game_key long, record_type string, fields array<string>")
    assert sorted(tuple(r) for r in C.pitcher_totals(recs).collect()) == [(1, "p", 3, True), (1, "q", 0, True), (2, "p", 3, False), (2, "q", 0, False)]
    verdicts = spark.createDataFrame([(1, "p", True, "derived"), (1, "p", None, "ambiguous"), (1, "p", None, "ambiguous"), (2, "p", True, "derived"), (9, "z", True, "derived")], "game_key long, pitcher_id string, earned_pitcher boolean, certainty string")
    checked = sorted((r.game_key, r.pitcher, r.low, r.high, r.verdict, r.distance) for r in C.against_totals(verdicts, C.pitcher_totals(recs)).collect())
    assert checked == [(1, "p", 1, 3, "within", 0), (1, "q", 0, 0, "exact", 0), (2, "p", 1, 1, "unusable", None), (2, "q", 0, 0, "unusable", None)]
