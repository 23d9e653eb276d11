"""Pages of small tables by hand: what is lacking, what is wanted alone, lineups by the rule of the format."""

import pytest

from fieldlog.operators import pages as O

PLAYS = "season int, game_key long, seq long, play_id long, batter_id string, event string, parse_status string, hit_location string, runs int, inning int, batting_team int"
TAGS = "season int, game_key long, seq long, play_id long, tag string, confidence string, source string"
ADVANCES = "game_key long, play_id long, at int, origin string, dest string, is_out boolean, scored boolean, is_force boolean, certainty string, runner_id string"
SEQUENCES = "game_key long, play_id long, at int, scope string, seq_text string, records_out boolean, has_error boolean"
CREDITS = "game_key long, play_id long, throw int, at int, scope string, fielder string, credit string"
COMMENTS = "game_key long, play_id long, comment int, kind string, text string, reversed boolean"
ENTRIES = "season int, game_key long, seq long, entry int, team int, position int, batting_order int, player string, problem string"
GAMES = "season int, game_key long, game_id string, occurrence int, date string, game_number int, home string, away string, league string, park string, game_type string, pitch_detail string, final_away int, final_home int, plays long, digest string, content long"
SCHEMAS = {"plays": PLAYS, "play_tags": TAGS, "advances": ADVANCES, "sequences": SEQUENCES, "credits": CREDITS, "comments": COMMENTS, "lineup_entries": ENTRIES, "games": GAMES}


@pytest.fixture(scope="module")
def t(spark):
    rows = {
        "plays": [(2000, 1, 1, 11, "a", "S7", "ok", "7", 0, 1, 0), (2000, 1, 2, 12, "b", "K", "ok", None, 0, 1, 0), (2000, 1, 3, 13, None, "S??", "unparsed", None, None, 1, 0), (2000, 2, 1, 21, "a", "HR", "state_untrusted", None, 1, 1, 0)],
        "play_tags": [(2000, 1, 1, 11, "Single", "certain", "derived"), (2000, 1, 2, 12, "Strikeout", "certain", "derived"), (2000, 1, 2, 12, "Hit", "uncertain", "derived")],
        "advances": [(1, 11, 0, "B", "1", False, False, False, "n/a", "a")],
        "sequences": [], "credits": [],
        "comments": [(1, 12, 1, "text", "second", None), (1, 12, 0, "text", "first", None), (1, None, 2, "text", "before any play", None)],
        "lineup_entries": [
            (2000, 1, None, 0, 0, 1, 0, "p0", None), (2000, 1, None, 1, 1, 1, 9, "p1", None), (2000, 1, None, 2, 1, 11, 3, "pinch", None),
            (2000, 1, 1, 3, 1, 1, 9, "q1", None), (2000, 1, 1, 4, 1, 1, 9, "r1", None), (2000, 1, 2, 5, 0, 5, 4, "late", None), (2000, 1, 1, 6, None, None, None, None, "unreadable"),
        ],
        "games": [(2000, 1, "AAA200004010", 1, "2000-04-01", 0, "AAA", "BBB", "AL", "X01", "regular", "pitches", 0, 0, 3, "d", 1), (2000, 2, "AAA200004020", 1, "2000-04-02", 0, "AAA", "CCC", None, None, None, None, 1, 0, 1, "d", 2)],
    }
    return {n: spark.createDataFrame(rows[n], s) for n, s in SCHEMAS.items()}


def test_play_pages(spark, t):
    got = {r.play_id: r for r in O.play_pages(t).collect()}
    assert sorted(got) == [11, 12, 13, 21]
    assert (got[11].previous, got[11].following, got[13].following, got[21].previous) == (None, 12, None, None)
    assert [x.tag for x in got[12].tags] == ["Hit", "Strikeout"] and [x.text for x in got[12].comments] == ["first", "second"]
    assert got[13].tags == got[13].advances == got[11].credits == got[21].sequences == [] and got[11].advances[0].runner_id == "a"
    who = lambda p: {(x.team, x.kind, x.place): x.player for x in got[p].lineup}
    # Who starts holds at once; of two who come after one play the later one, from the next play on. A pinch hitter takes a place in the order, not in the field.
    assert who(11) == {(0, "defense", 1): "p0", (0, "batting", 0): "p0", (1, "defense", 1): "p1", (1, "batting", 9): "p1", (1, "batting", 3): "pinch"}
    assert who(12)[1, "defense", 1] == who(12)[1, "batting", 9] == "r1" and (0, "defense", 5) not in who(12) and who(13)[0, "defense", 5] == "late"
    assert got[21].lineup == []


def test_wanted_pages_are_those_of_all(spark, t):
    whole = {r.play_id: r for r in O.play_pages(t).collect()}
    wanted = spark.createDataFrame([(12,), (12,), (99,)], "play_id long")
    assert [r for r in O.play_pages(t, wanted).collect()] == [whole[12]]
    people = spark.createDataFrame([("a", "Al", "Ash"), ("b", None, None)], "person_id string, first string, last string")
    named = O.named(t["plays"].select("play_id", "batter_id"), people, ("batter_id",))
    assert {r.play_id: r.batter_id_name for r in named.collect()} == {11: "Al Ash", 12: "b", 13: None, 21: "Al Ash"}


def test_game_and_player_pages(spark, t):
    logs = spark.createDataFrame([("AAA200004010", "2000-04-01", "regular", 0, 0, "", "", 1)] * 2 + [("AAA200004010", "2000-05-01", "regular", 3, 0, "", "", 1)], "game_id string, date string, series string, away_score int, home_score int, forfeit string, completion string, more int")
    parts = O.game_pages(t | {"logs": logs}, spark.createDataFrame([(1,), (5,)], "game_key long"))
    assert {n: parts[n].count() for n in ("game", "plays", "lineup", "comments", "game_log")} == {"game": 1, "plays": 3, "lineup": 7, "comments": 3, "game_log": 1}
    assert sorted((r.seq, r.tags) for r in parts["plays"].collect()) == [(1, ["Single"]), (2, ["Hit", "Strikeout"]), (3, [])] and "digest" not in parts["game"].columns
    earned = spark.createDataFrame([(1, 0, "p", x, c) for x, c in ((True, "derived"), (False, "likely"), (None, "ambiguous"), (True, "derived"))], "game_key long, batting_team int, pitcher_id string, earned_pitcher boolean, certainty string")
    assert [tuple(r)[3:] for r in O.earned_split(earned).collect()] == [(4, 2, 1, 1, 2, 1, 1, 0)]
    own = O.player_pages(t, spark.createDataFrame([("a",), ("q1",)], "person_id string"))
    assert {(r.person_id, r.season, r.plays) for r in own["batting_seasons"].collect()} == {("a", 2000, 2)}
    assert {(r.person_id, r.tag, r.n) for r in own["tag_counts"].collect()} == {("a", "Single", 1)}


def test_coverage(spark, t):
    missing = spark.createDataFrame([(2000, "AL", 4, 3)], "season int, league string, published long, missing long")
    got = {r.league: r for r in O.coverage(t["games"], t["plays"], missing).collect()}
    assert (got["AL"].games, got["AL"].plays, got["AL"].with_pitches, got["AL"].plays_unparsed, got["AL"].plays_inconsistent, got["AL"].games_missing) == (1, 3, 1, 1, 0, 3)
    assert (got["?"].games, got["?"].without_pitches, got["?"].plays_inconsistent, got["?"].games_missing) == (1, 1, 1, None)
    total = O.coverage_totals(O.coverage(t["games"], t["plays"], missing)).first()
    assert (total.games, total.plays, total.missing, total.share, total.unmeasured, total.leagues) == (2, 4, 3, 0.25, 1, ["?"])
    # Nothing measured is no share, not a whole one.
    assert O.coverage_totals(O.coverage(t["games"], t["plays"])).first().share is None
    assert [r.park for r in O.park_seasons(t["games"]).collect()] == ["X01"] and O.park_games(t["games"]).count() == 1


def test_empty_tables(spark, t):
    empty = {n: df.limit(0) for n, df in t.items()}
    assert O.play_pages(empty).count() == O.coverage(empty["games"], empty["plays"]).count() == 0
    assert all(df.count() == 0 for df in (*O.game_pages(empty).values(), *O.player_pages(empty).values()))
    total = O.coverage_totals(O.coverage(empty["games"], empty["plays"])).first()
    assert (total.games, total.missing, total.share) == (0, 0, None)
    assert {r.n for r in O.violations(empty["plays"], empty["comments"], empty["play_tags"]).collect()} == {0}
