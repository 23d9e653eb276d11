"""Searches and their reports over the log view, each against a condition in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlog.operators.search import DEFAULT_GAME_TYPES, POSTSEASON, Search, candidates, holders, search_from_params

from .registry import WITH, add, literal
from .roles import tables

KEYS = ("game_key", "seq", "play_id", "tag")
PICK = "SELECT game_key, seq, play_id, tag FROM plays p"
OK = "parse_status = 'ok'"


def of_types(types: tuple[str, ...]) -> str:
    return f"game_key IN (SELECT game_key FROM games WHERE coalesce(game_type, 'regular') IN ({', '.join(map(literal, types))}))"


REGULAR = of_types(DEFAULT_GAME_TYPES)


def search(name: str, s: Callable[[], Search], where: str, status: str = OK, types: str = REGULAR) -> None:
    """A search's keys against the plays that a condition picks. Columns need a session, so the search is made when it is asked for."""
    add(name, lambda spark, d: s().matches(tables(spark, d)).select(*KEYS), f"{WITH} {PICK} WHERE ({where}) AND {status} AND {types}")


def tagged(name: str, sure: bool = True) -> str:
    return f"play_id IN (SELECT play_id FROM play_tags WHERE tag = '{name}'{' AND confidence = ' + literal('certain') if sure else ''})"


def games(where: str) -> str:
    return f"game_key IN (SELECT game_key FROM games WHERE {where})"


def child(table: str, where: str) -> str:
    return f"play_id IN (SELECT play_id FROM {table} WHERE {where})"


HELD = "(SELECT *, coalesce(seq, 0) AS from_seq, lead(coalesce(seq, 0)) OVER (PARTITION BY game_key, team, position ORDER BY coalesce(seq, 0), player) AS to_seq FROM entries)"


def held(position: int, player: str) -> str:
    return f"EXISTS (SELECT 1 FROM {HELD} e WHERE e.game_key = p.game_key AND e.team = 1 - p.batting_team AND e.position = {position} AND e.player = '{player}' AND p.seq > e.from_seq AND (e.to_seq IS NULL OR p.seq <= e.to_seq))"


S = Search()
search("P01_outs", lambda: S.outs(2), "outs_before = 2")
search("P02_outs_after", lambda: S.outs_after(3), "outs_after = 3")
search("P03_bases", lambda: S.bases("101"), "bases_before = '101'")
search("P04_bases_loaded", lambda: S.bases_loaded(), "bases_before = '111'")
search("P04_bases_empty", lambda: S.bases_empty(), "bases_before = '000'")
search("P05_runner_on", lambda: S.runner_on(3), "substr(bases_before, 3, 1) = '1'")
search("P06_scoring_position", lambda: S.scoring_position(), "substr(bases_before, 2, 1) = '1' OR substr(bases_before, 3, 1) = '1'")
search("P07_inning", lambda: S.inning_at_least(20), "inning >= 20")
search("P08_half", lambda: S.half("top"), "half = 'top'")
search("P09_inning_ending", lambda: S.inning_ending(), "inning_ending")
search("P09_walkoff", lambda: S.walkoff(), "walk_off")
search("P10_score_diff", lambda: S.score_diff(-1, 1), "score_diff BETWEEN -1 AND 1")
search("P11_seasons", lambda: S.seasons(2001, 2003), games("season BETWEEN 2001 AND 2003"))
search("P12_league", lambda: S.league("L1"), games("league = 'L1'"))
search("P12_league_of_club", lambda: S.league("NN2"), games("(home, season) IN (SELECT team_id, season FROM teams WHERE league = 'NN2')"))
search("P13_team", lambda: S.team("T2"), games("home = 'T2' OR away = 'T2'"))
search("P14_batting_team", lambda: S.batting_team("T2"), f"(batting_team = 1 AND {games('home = ' + literal('T2'))}) OR (batting_team = 0 AND {games('away = ' + literal('T2'))})")
search("P14_fielding_team", lambda: S.fielding_team("T2"), f"(batting_team = 0 AND {games('home = ' + literal('T2'))}) OR (batting_team = 1 AND {games('away = ' + literal('T2'))})")
search("P15_batter", lambda: S.batter("P7"), "batter_id = 'P7'")
search("P16_batter_named", lambda: S.batter_named(" babe  ROSTER7 "), "batter_id = 'P7'")
search("P16_batter_nickname", lambda: S.batter_named("nick5 customer#000000012"), "batter_id = 'P12'")
search("P17_park", lambda: S.park("K3"), games("park = 'K3'"))
search("P17_park_named", lambda: S.park_named("wrigley field"), games("park IN ('K0', 'K1', 'K2')"))
search("P18_team_named", lambda: S.team_named("nine1"), games("home IN (SELECT team_id FROM teams WHERE nickname = 'Nine1') OR away IN (SELECT team_id FROM teams WHERE nickname = 'Nine1')"))
search("P19_pitcher", lambda: S.pitcher("P1"), held(1, "P1"))
search("P20_fielder_interval", lambda: S.fielder(2, "P3"), held(2, "P3"))
search("P21_position_played", lambda: S.position_played("ss"), "EXISTS (SELECT 1 FROM games g JOIN rosters r ON r.season = g.season WHERE g.game_key = p.game_key AND r.person_id = p.batter_id AND r.position = 'SS')")
search("P22_tag", lambda: S.tag("purchase"), tagged("purchase"))
search("P22_tag_then_uncertain", lambda: S.tag("click").include_uncertain(), tagged("click", False))
search("P22_uncertain_then_tag", lambda: S.include_uncertain().tag("click"), tagged("click", False))
search("P23_shorthand", lambda: S.strikeout(), tagged("Strikeout"))
search("P24_stolen_base", lambda: S.any_of(S.stolen_base("3"), S.tag("view").where(F.col("event_basic").contains("SB3"))), f"{tagged('view')} AND event_basic LIKE '%SB3%'")
search("P25_batter_ran", lambda: S.batter_ran("unknown"), "batter_ran = 'unknown'")
search("P26_force_play", lambda: S.force_play("2"), child("advances", "is_out AND is_force AND dest = '2'"))
search("P26_force_certainty", lambda: S.force_play("1", certainty="likely"), child("advances", "is_out AND is_force AND dest = '1' AND certainty = 'likely'"))
search("P26_with_tag_outs", lambda: S.force_play("3", include_tag_outs=True), child("advances", "is_out AND dest = '3'"))
search("P27_out_at", lambda: S.out_at("3"), child("advances", "is_out AND dest = '3'"))
search("P28_tag_out", lambda: S.tag_out(), child("advances", "is_out AND NOT is_force"))
search("P29_error", lambda: S.error("4"), child("credits", "credit = 'error' AND fielder = '4'"))
search("P30_hit_location", lambda: S.hit_location("7*"), "hit_location LIKE '7%'")
search("P31_hit_located", lambda: S.hit_located(), "hit_location IS NOT NULL")
search("P32_event_matches", lambda: S.event_matches("^S[0-9]/L"), "regexp_matches(event, '^S[0-9]/L')")
search("P33_putout_sequence", lambda: S.putout_sequence("64"), child("sequences", "seq_text = '64'"))
search("P33_scope", lambda: S.putout_sequence(["6", "4"], scope="basic"), child("sequences", "seq_text = '64' AND scope = 'basic'"))
search("P34_contains_sequence", lambda: S.contains_sequence("6"), child("sequences", "seq_text LIKE '%6%'"))
search("P35_putout_by", lambda: S.putout_by("3", "2"), "EXISTS (SELECT 1 FROM credits c WHERE c.play_id = p.play_id AND credit = 'putout' AND fielder = '3') AND EXISTS (SELECT 1 FROM credits c WHERE c.play_id = p.play_id AND credit = 'assist' AND fielder = '2')")
search("P36_any_of", lambda: S.any_of(S.tag("click").outs(0), S.out_at("1")), f"(outs_before = 0 AND {tagged('click')}) OR {child('advances', 'is_out AND dest = ' + literal('1'))}")
search("P36_nested", lambda: S.any_of(S.outs(0).none_of(S.tag("view"), S.half("top")), S.any_of(S.outs(2).tag("click"), S.inning(3))), f"(outs_before = 0 AND NOT ({tagged('view')} OR half = 'top')) OR (outs_before = 2 AND {tagged('click')}) OR inning = 3")
search("P36_late_certainty", lambda: S.any_of(S.tag("click")).include_uncertain(), tagged("click", False))
search("P37_none_of", lambda: S.none_of(S.where(F.col("location") == 2), S.outs(1)), "NOT (location = 2 OR outs_before = 1)")
search("P38_untrusted", lambda: S.include_untrusted().outs(1), "outs_before = 1", "parse_status IN ('ok', 'state_untrusted')")
search("P38_unparsed", lambda: S.outs(1).include_unparsed(), "outs_before = 1", "true")
search("P39_exclude_curated", lambda: S.exclude_curated().outs(0), "outs_before = 0 AND play_id NOT IN (SELECT play_id FROM play_tags WHERE source = 'curated')")
search("P39_curated_only", lambda: S.outs(0).curated_only(), "outs_before = 0 AND play_id IN (SELECT play_id FROM play_tags WHERE source = 'curated')")
search("P40_exhibition", lambda: S.outs(1).include_exhibition(), "outs_before = 1", types=of_types(DEFAULT_GAME_TYPES + ("exhibition",)))
search("P40_allstar", lambda: S.outs(1).include_allstar(), "outs_before = 1", types=of_types(DEFAULT_GAME_TYPES + ("allstar",)))
search("P40_postseason", lambda: S.only_postseason().outs(1), "outs_before = 1", types=of_types(POSTSEASON))
search("P40_all", lambda: S.outs(1).all_game_types(), "outs_before = 1", types="true")
search("P48_params", lambda: search_from_params({"outs": "1", "half": "bottom", "tag": "view", "league": ""}), f"outs_before = 1 AND half = 'bottom' AND {tagged('view')}")
search("P48_composites", lambda: search_from_params({"seasons": "2001,2004", "force_play_at": "2", "include_tag_outs": "yes", "putout_by": 3, "assist_by": "2", "include_untrusted": "on", "order": "reverse", "limit": "1000000"}), f"{games('season BETWEEN 2001 AND 2004')} AND {child('advances', 'is_out AND dest = ' + literal('2'))} AND {child('credits', 'credit = ' + literal('putout') + ' AND fielder = ' + literal('3'))} AND {child('credits', 'credit = ' + literal('assist') + ' AND fielder = ' + literal('2'))}", "parse_status IN ('ok', 'state_untrusted')")
ALL = f"{OK} AND {REGULAR}"
add("P41_total_order_limit", lambda s, d: S.outs(2).limit(25).offset(10).run(tables(s, d)).select(*KEYS), f"{WITH} {PICK} WHERE outs_before = 2 AND {ALL} ORDER BY game_key, seq LIMIT 25 OFFSET 10")
add("P41_reverse", lambda s, d: S.outs(2).ordered("reverse").limit(20).run(tables(s, d)).select(*KEYS), f"{WITH} SELECT game_key, seq, play_id, tag FROM plays p JOIN games g USING (game_key) WHERE outs_before = 2 AND {OK} AND coalesce(game_type, 'regular') IN ({', '.join(map(literal, DEFAULT_GAME_TYPES))}) ORDER BY date DESC, game_id DESC, game_key DESC, seq DESC LIMIT 20")
add("P43_count", lambda s, d: S.outs(2).tag("purchase").count(tables(s, d)), f"{WITH} SELECT count(*) AS total FROM plays WHERE outs_before = 2 AND {tagged('purchase')} AND {ALL}")
add("P45_candidates", lambda s, d: candidates(tables(s, d), "park", "Wrigley Field"), f"{WITH} SELECT park_id AS id, name AS label FROM parks WHERE park_id IN ('K0', 'K1', 'K2')")
add("P47_scope", lambda s, d: S.team("T2").outs(1).tag("click").scope(tables(s, d)).select("game_key"), f"{WITH} SELECT game_key FROM games WHERE (home = 'T2' OR away = 'T2') AND coalesce(game_type, 'regular') IN ({', '.join(map(literal, DEFAULT_GAME_TYPES))})")


def rows_with_tags(spark: SparkSession, d: str) -> DataFrame:
    found = S.outs(2).run_rows(tables(spark, d))
    return found.select(*KEYS, F.array_join("tags", ",").alias("tags"), "batter_name")


add("P44_run_rows", rows_with_tags, f"{WITH} SELECT game_key, seq, p.play_id, p.tag, coalesce(t.tags, '') AS tags, coalesce(first || ' ' || last, batter_id) AS batter_name FROM plays p LEFT JOIN (SELECT play_id, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM play_tags WHERE confidence = 'certain' GROUP BY play_id) t ON t.play_id = p.play_id LEFT JOIN people ON person_id = batter_id WHERE outs_before = 2 AND {ALL}")
add("J7_interval_counts", lambda s, d: holders(tables(s, d).plays, tables(s, d).entries).groupBy("position", "player").agg(F.count(F.lit(1)).alias("plays")), f"{WITH} SELECT e.position, player, count(*) AS plays FROM plays p JOIN {HELD} e ON e.game_key = p.game_key AND e.team = 1 - p.batting_team AND p.seq > from_seq AND (to_seq IS NULL OR p.seq <= to_seq) GROUP BY e.position, player")

# Reports.
SCOPE = f"FROM games WHERE league = 'L1' AND coalesce(game_type, 'regular') IN ({', '.join(map(literal, DEFAULT_GAME_TYPES))})"
add("A1_coverage", lambda s, d: S.league("L1").outs(1).coverage(tables(s, d)).withColumns({"plays": F.col("plays").cast("long"), "completeness": F.round("completeness", 9)}), f"{WITH}, c AS (SELECT * FROM coverage WHERE (season, league) IN (SELECT (season, league) {SCOPE})) SELECT count(*) AS games, CAST(sum(plays) AS BIGINT) AS plays, min(first_day) AS first_day, max(last_day) AS last_day, count(DISTINCT season) AS seasons, count(DISTINCT league) AS leagues, (SELECT CAST(sum(games_missing) AS BIGINT) FROM c) AS missing, (SELECT count(*) FROM c WHERE games_missing IS NULL) AS unmeasured, (SELECT round(sum(games_held) / (sum(games_held) + sum(games_missing)), 9) FROM c WHERE games_missing IS NOT NULL) AS completeness {SCOPE}")
add("A2_completeness", lambda s, d: tables(s, d).coverage.select("season", "league", F.when(F.col("games_missing").isNotNull(), F.round(F.col("games_held") / (F.col("games_held") + F.col("games_missing")), 9)).alias("completeness")), f"{WITH} SELECT season, league, round(games_held / (games_held + games_missing), 9) AS completeness FROM coverage")
add("A3_excluded", lambda s, d: S.outs(1).tag("click").excluded(tables(s, d)), f"{WITH} SELECT parse_status AS reason, count(*) AS n FROM plays WHERE outs_before = 1 AND {tagged('click')} AND parse_status <> 'ok' AND {REGULAR} GROUP BY parse_status UNION ALL SELECT 'uncertain', count(*) FROM plays WHERE outs_before = 1 AND {tagged('click', False)} AND NOT {tagged('click')} AND {ALL}")
EITHER = f"({tagged('click')} OR outs_before = 0)", f"({tagged('click', False)} OR outs_before = 0)"
NEITHER = f"NOT {tagged('view')}", f"NOT {tagged('view', False)}"
add("A3_excluded_of_groups", lambda s, d: S.any_of(S.tag("click"), S.outs(0)).none_of(S.tag("view")).half("top").excluded(tables(s, d)), f"{WITH} SELECT parse_status AS reason, count(*) AS n FROM plays WHERE half = 'top' AND {EITHER[0]} AND {NEITHER[0]} AND parse_status <> 'ok' AND {REGULAR} GROUP BY parse_status UNION ALL SELECT 'uncertain', count(*) FROM plays WHERE half = 'top' AND {EITHER[1]} AND {NEITHER[1]} AND NOT ({EITHER[0]} AND {NEITHER[0]}) AND {ALL}")
add("A3_excluded_untrusted", lambda s, d: S.tag("click").include_uncertain().include_untrusted().excluded(tables(s, d)), f"{WITH} SELECT parse_status AS reason, count(*) AS n FROM plays WHERE {tagged('click', False)} AND parse_status NOT IN ('ok', 'state_untrusted') AND {REGULAR} GROUP BY parse_status")
FORCED = f"outs_before = 1 AND {child('advances', 'is_out AND is_force AND dest = ' + literal('2'))} AND {REGULAR}"
add("A4_force_split", lambda s, d: S.outs(1).force_play("2").force_report(tables(s, d)), f"{WITH} SELECT certainty AS what, count(*) AS n FROM advances WHERE is_out AND is_force AND dest = '2' AND play_id IN (SELECT play_id FROM plays WHERE {FORCED} AND {OK}) GROUP BY certainty UNION ALL SELECT 'batter unknown', count(*) FROM plays WHERE {FORCED} AND {OK} AND batter_ran = 'unknown' UNION ALL SELECT 'state untrusted', count(*) FROM plays WHERE {FORCED} AND parse_status = 'state_untrusted'")
