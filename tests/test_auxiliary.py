"""Auxiliary files and published logs: names, versions, refusals, replacement by file."""

import pytest

from fieldlog.sources import archive as A
from fieldlog.sources import auxiliary as X
from fieldlog.sources import reference_files as R


def log_line(day, away="BBB", home="AAA", scores=("3", "2")):
    fields = [""] * R.LOG_FIELDS
    for name, value in (("date", day), ("number", "0"), ("away", away), ("home", home), ("away_score", scores[0]), ("home_score", scores[1])):
        fields[R.LOG[name]] = value
    return ",".join(fields) + "\n"


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "in/2000").mkdir(parents=True)
    for name, data in {
        "2000/AAA2000.ROS": b"ashal001,Ash,Al,R,R,AAA,SS\r\nbakbo001,Baker,Bo,L,L,AAA,P\n", "2000/bbb2000.ros": b"", "2000/TEAM2000": b"AAA,A,City,Nine\nBBB,N,Town,Men",
        "ballparks.csv": b"PARKID,NAME\nX01,Field\n", "notes.csv": b"no\n", "TEAMS2000": b"no\n", "TOOLONG2000.ROS": b"no\n", "2000AAA.EVA": b"id,AAA200004010\n",
    }.items():
        (tmp_path / "in" / name).write_bytes(data)
    return tmp_path


def test_kinds_versions_and_checks(spark, folder):
    root, files = f"file://{folder}/aux", f"file://{folder}/in"
    assert X.publish(spark, files, root) == 1 and X.publish(spark, files, root) is None
    held = A.manifest(spark, root)
    got = {r.kind: (r.files, r.records, r.seasons, r.mixed) for r in X.by_kind(held).collect()}
    assert got == {"roster": (1, 2, 1, 1), "team": (1, 2, 1, 0), "park": (1, 2, 0, 0)}
    assert [r.team_id for r in R.teams(X.lines(spark, root, "team")).orderBy("line_no").collect()] == ["AAA", "BBB"]
    lines = X.lines(spark, root)
    assert {n: df.count() for n, df in X.checks(lines, held).items()} == {"V07_records_of_file": 0, "V08_lines_without_file": 0, "V09_bytes_differ": 0}
    hurt = X.checks(lines.where("NOT (kind = 'team' AND line_no = 2)"), held.where("path NOT LIKE '%ballparks.csv'"))
    assert {n: df.count() for n, df in hurt.items()} == {"V07_records_of_file": 1, "V08_lines_without_file": 1, "V09_bytes_differ": 1}
    (folder / "in/ballparks.csv").write_bytes(b"PARKID,NAME\n")
    with pytest.raises(A.CorpusChanged):
        X.publish(spark, files, root)
    assert X.publish(spark, files, root, refresh=True) == 2 and X.lines(spark, root, "park").count() == 1


def test_no_auxiliary_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/notes.csv").write_bytes(b"no\n")
    assert X.publish(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/aux") is None


def test_logs_by_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put = lambda name, *lines: (tmp_path / "in" / name).write_text("".join(lines))
    load = lambda: {r.path.rsplit("/", 1)[1]: tuple(r)[1:4] + (r.other and r.other.rsplit("/", 1)[1], r.shared) for r in X.load_logs(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/root").collect()}
    rows = lambda: sorted((r.path.rsplit("/", 1)[1], r.game_id, r.series) for r in X.log_rows(spark, f"file://{tmp_path}/root").collect())
    assert X.log_rows(spark, f"file://{tmp_path}/root") is None
    put("GL2000.TXT", log_line("20000401"), "\n", "broken,line\n", log_line("20000402"))
    put("GLWS.TXT", log_line("20001001"))
    put("ZCOPY.TXT", log_line("20000402"), log_line("20000501"))
    assert load() == {"GL2000.TXT": ("loaded", 2, 1, None, 0), "GLWS.TXT": ("loaded", 1, 0, None, 0), "ZCOPY.TXT": ("refused", 2, 0, "GL2000.TXT", 1)}
    first = [("GL2000.TXT", "AAA200004010", "regular"), ("GL2000.TXT", "AAA200004020", "regular"), ("GLWS.TXT", "AAA200010010", "ws")]
    assert rows() == first
    # Again: nothing is new but the copy, which is refused by what is held now. A changed file replaces its own rows alone; one without a readable line has none any more.
    assert {n: r[0] for n, r in load().items()} == {"GL2000.TXT": "current", "GLWS.TXT": "current", "ZCOPY.TXT": "refused"} and rows() == first
    put("GL2000.TXT", log_line("20000403"))
    put("GLWS.TXT", "broken\n")
    put("ZCOPY.TXT", log_line("20000501"))
    assert {n: r[:3] for n, r in load().items()} == {"GL2000.TXT": ("replaced", 1, 0), "GLWS.TXT": ("replaced", 0, 1), "ZCOPY.TXT": ("loaded", 1, 0)}
    assert rows() == [("GL2000.TXT", "AAA200004030", "regular"), ("ZCOPY.TXT", "AAA200005010", "regular")]
