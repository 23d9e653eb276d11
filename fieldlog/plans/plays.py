"""Queries on event strings: parsing, the fold of bases and outs, tags. Catalogues of strings, with answers written out by hand, are dealt to the rows
of the given tables, so that the work grows with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlog.functions import events as E
from fieldlog.functions import tags as T
from fieldlog.functions.moves import moved, read
from fieldlog.operators.fold import replayed_log, resolved, scored, short_halves

from .registry import WITH, add, literal, on_view, values
from .roles import PLAY_TAGS, PLAYS, view

# Event strings and what they hold: stripped text, kinds of basic events, kinds of modifiers, advances (origin, - or X where it is an out or * where an error
# negates it, destination), codes, place, throws (b: basic event, a: advance), credits (a assist, p putout, e error, n none), flags. Malformed strings hold nothing.
PARTS = [
    ("S7", "S7", "S", "", "", "", "", "", "", ""),
    ("D8/L8D.1-H", "D8/L8D.1-H", "D", "hit", "1-H", "", "8D", "", "", ""),
    ("DGR/F9.2-H;1-3", "DGR/F9.2-H;1-3", "DGR", "hit", "2-H,1-3", "", "9", "", "", ""),
    ("HR/F78.2-H;1-H", "HR/F78.2-H;1-H", "HR", "hit", "2-H,1-H", "", "78", "", "", ""),
    ("H7/IPHR", "H7/IPHR", "HR", "named", "", "IPHR", "", "", "", ""),
    ("K", "K", "K", "", "", "", "", "", "", ""),
    ("K/C", "K/C", "K", "named", "", "C", "", "", "", ""),
    ("K23", "K23", "K", "", "", "", "", "b23", "2a3p", ""),
    ("K/DP.1X2(26)", "K/DP.1X2(26)", "K", "named", "1X2", "DP", "", "a26", "2a6p", ""),
    ("K+WP.B-1", "K+WP.B-1", "K,WP", "", "B-1", "", "", "", "", ""),
    ("K+E2.1-2", "K+E2.1-2", "K,E", "", "1-2", "", "", "bE2", "2e", ""),
    ("W.1-2", "W.1-2", "W", "", "1-2", "", "", "", "", ""),
    ("IW", "IW", "W", "", "", "", "", "", "", ""),
    ("I", "I", "W", "", "", "", "", "", "", ""),
    ("HP", "HP", "HP", "", "", "", "", "", "", ""),
    ("63/G6", "63/G6", "OUT", "hit", "", "", "6", "b63", "6a3p", ""),
    ("63/G", "63/G", "OUT", "hit", "", "", "", "b63", "6a3p", ""),
    ("8/F8/SF.3-H", "8/F8/SF.3-H", "OUT", "hit,named", "3-H", "SF", "8", "b8", "8p", ""),
    ("64(1)3/GDP/G6", "64(1)3/GDP/G6", "OUT", "named,hit", "", "GDP", "6", "b64,b3", "6a4p3p", ""),
    ("8(B)84(2)/LDP/L8", "8(B)84(2)/LDP/L8", "OUT", "named,hit", "", "LDP", "8", "b8,b84", "8p8a4p", ""),
    ("4/P4/IF", "4/P4/IF", "OUT", "hit,named", "", "IF", "4", "b4", "4p", ""),
    ("23/BG2/SH.1-2", "23/BG2/SH.1-2", "OUT", "hit,named", "1-2", "SH", "2", "b23", "2a3p", ""),
    ("E6/G6", "E6/G6", "E", "hit", "", "", "6", "bE6", "6e", ""),
    ("63E3/G6", "63E3/G6", "E", "hit", "", "", "6", "b63E3", "6a3a3e", ""),
    ("FC5/G5.3XH(52)", "FC5/G5.3XH(52)", "FC", "hit", "3XH", "", "5", "a52", "5a2p", ""),
    ("SB2", "SB2", "SB", "", "", "", "", "", "", ""),
    ("SB3;SB2", "SB3;SB2", "SB,SB", "", "", "", "", "", "", ""),
    ("CS2(26)", "CS2(26)", "CS", "", "", "", "", "b26", "2a6p", ""),
    ("CS2(2E6/TH)", "CS2(2E6/TH)", "CS", "", "", "", "", "b2E6", "2a6e", ""),
    ("PO1(13)", "PO1(13)", "PO", "", "", "", "", "b13", "1a3p", ""),
    ("PO1(E3/TH).1-3", "PO1(E3/TH).1-3", "PO", "", "1-3", "", "", "bE3", "3e", ""),
    ("POCS2(1361)", "POCS2(1361)", "POCS", "", "", "", "", "b1361", "1a3a6a1p", ""),
    ("WP.2-3", "WP.2-3", "WP", "", "2-3", "", "", "", "", ""),
    ("BK.3-H(NR);2-3(SB3)", "BK.3-H(NR);2-3(SB3)", "BK", "", "3-H,2-3", "", "", "", "", "NR,SB3"),
    ("PB.1-2", "PB.1-2", "PB", "", "1-2", "", "", "", "", ""),
    ("DI.1-2", "DI.1-2", "DI", "", "1-2", "", "", "", "", ""),
    ("OA.2X3(25)", "OA.2X3(25)", "OA", "", "2X3", "", "", "a25", "2a5p", ""),
    ("S8/L8.2XH(8E2);1-3", "S8/L8.2XH(8E2);1-3", "S", "hit", "2*H,1-3", "", "8", "a8E2", "8a2e", ""),
    ("S9/G34.1XH(9/TH)", "S9/G34.1XH(9/TH)", "S", "hit", "1XH", "", "34", "a9", "9p", ""),
    ("FLE5/P5F", "FLE5/P5F", "FLE", "hit", "", "", "5F", "bE5", "5e", ""),
    ("NP", "NP", "NP", "", "", "", "", "", "", ""),
    ("C/E2", "C/E2", "C", "error", "", "", "", "", "", ""),
    ("D7/R6U4.1-H", "D7/R6U4.1-H", "D", "coverage", "1-H", "", "", "", "", ""),
    ("S7!/L7+.1-2#", "S7/L7.1-2", "S", "hit", "1-2", "", "7", "", "", ""),
    ("K+#WP.2-3", "K+WP.2-3", "K,WP", "", "2-3", "", "", "", "", ""),
    ("D8/L78+#.2-H", "D8/L78.2-H", "D", "hit", "2-H", "", "78", "", "", ""),
    ("64-3/G6?", "643/G6", "OUT", "hit", "", "", "6", "b643", "6a4a3p", ""),
    ("S8.1--2", "S8.1-2", "S", "", "1-2", "", "", "", "", ""),
    ("99", "99", "OUT", "", "", "", "", "b99", "?n", ""),
    ("1U3/G1", "1U3/G1", "OUT", "hit", "", "", "1", "b1U3", "1a?n3p", ""),
    ("S7.1-2(UR)(RBI)", "S7.1-2(UR)(RBI)", "S", "", "1-2", "", "", "", "", "UR,RBI"),
    ("W+SB2", "W+SB2", "W,SB", "", "", "", "", "", "", ""),
    ("K+PO1(23).2-3", "K+PO1(23).2-3", "K,PO", "", "2-3", "", "", "b23", "2a3p", ""),
    ("S9.BXH(TH)(E2/TH)(8E2)", "S9.BXH(TH)(E2/TH)(8E2)", "S", "", "B*H", "", "", "aE2,a8E2", "2e8a2e", ""),
    ("S7.1X3(E1)(35)", "S7.1X3(E1)(35)", "S", "", "1X3", "", "", "aE1,a35", "1e3a5p", ""),
    ("HR9/F9LDW", "HR9/F9LDW", "HR", "hit", "", "", "9LDW", "", "", ""),
    ("54(2)/FO/G5.1-2", "54(2)/FO/G5.1-2", "OUT", "named,hit", "1-2", "FO", "5", "b54", "5a4p", ""),
    ("1(B)16(2)63(1)/LTP/L1", "1(B)16(2)63(1)/LTP/L1", "OUT", "named,hit", "", "LTP", "1", "b1,b16,b63", "1p1a6p6a3p", ""),
    ("CS2(2626)", "CS2(2626)", "CS", "", "", "", "", "b2626", "2a6a2a6p", ""),
    ("K.3XH(21)", "K.3XH(21)", "K", "", "3XH", "", "", "a21", "2a1p", ""),
    ("S7/TH2.BX2(74)", "S7/TH2.BX2(74)", "S", "throw", "BX2", "", "", "a74", "7a4p", ""),
    ("K+", "K", "K", "", "", "", "", "", "", ""),
    ("K.1-5", "K.15", "", "", "", "", "", "", "", ""),
    *[(bad, bad, "", "", "", "", "", "", "", "") for bad in ("XX", "", "S7.garbage", "S7/QQ", "63)", "E", "S7.1-2;", "SB2(", "7(4)", "S7 ", "/G6")],
]


#: How many rows of a table a row of `dealt_once` stands for.
ROWS = "__rows"


def dealt_to(spark: SparkSession, d: str, rows: list[tuple], schema: str) -> DataFrame:
    """Each row of lineitem with the row that its part number picks."""
    names = [x.split()[0] for x in schema.split(", ")]
    each = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows])
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", F.element_at(each, (F.col("l_partkey") % len(rows) + 1).cast("int")).alias("x")).select("l_orderkey", "x.*")


def dealt_once(spark: SparkSession, d: str, rows: list[tuple], schema: str) -> DataFrame:
    """Likewise, each different row once with the number of its rows, which `counted` adds up: what follows from a row alone is worked out once for all that are like it."""
    df = dealt_to(spark, d, rows, schema).drop("l_orderkey")
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(ROWS))


def counted(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg((F.sum(ROWS) if ROWS in df.columns else F.count(F.lit(1))).alias("n"))


def expected(rows: list[tuple], columns: str) -> str:
    return f"SELECT {columns}, count(*) AS n FROM lineitem JOIN {values(rows, columns)} ON l_partkey % {len(rows)} = i GROUP BY {columns}"


def parts_of(column: Column, name: str) -> tuple:
    """A query on the parts: what the column says against the answers of that place."""
    place = ("clean", "kinds", "mods", "advs", "codes", "location", "seqs", "credits", "flags").index(name) + 1

    def query(spark: SparkSession, d: str) -> DataFrame:
        events = dealt_once(spark, d, [row[:1] for row in PARTS], "event string")
        return counted(E.parsed(events).withColumn(name, F.coalesce(column(), F.lit(""))), "event", name)

    return query, expected([(row[0], row[place]) for row in PARTS], f"event, {name}")


def joined(x: Column) -> Column:
    return F.array_join(x, ",")


def advance_marks() -> Column:
    return joined(F.transform("advs", lambda a: F.concat(a["origin"], F.when(a["is_out"], "X").when(a["marked_out"], "*").otherwise("-"), a["dest"])))


def credit_marks() -> Column:
    each = F.flatten(F.transform(E.sequences(), E.credits))
    return F.array_join(F.transform(each, lambda c: F.concat(F.coalesce(c["fielder"].cast("string"), F.lit("?")), F.substring(c["credit"], 1, 1))), "")


add("E1_stripped", *parts_of(lambda: F.col("clean"), "clean"))
add("E3_basic_events", *parts_of(lambda: joined(F.transform("basics", lambda b: b["kind"])), "kinds"))
add("E6_modifiers", *parts_of(lambda: joined(F.transform("mods", lambda m: m["kind"])), "mods"))
add("E8_advances", *parts_of(advance_marks, "advs"))
add("E9_flags", *parts_of(lambda: joined(E.adv_flags()), "flags"))
add("E11_location", *parts_of(lambda: E.first_hit("location"), "location"))
add("E12_codes", *parts_of(lambda: joined(E.codes()), "codes"))
add("E13_sequences", *parts_of(lambda: joined(F.transform(E.sequences(), lambda s: F.concat(F.substring(s["scope"], 1, 1), s["seq_text"]))), "seqs"))
add("E15_credits", *parts_of(credit_marks, "credits"))


def round_trips(spark: SparkSession, d: str) -> DataFrame:
    """Texts from their parts, and annotations back in place."""
    df = E.parsed(dealt_once(spark, d, [row[:1] for row in PARTS], "event string"))
    emitted = F.when(F.col("parse_ok"), E.emitted())
    return counted(df.withColumns({"emitted": emitted, "again": E.reinserted(F.coalesce(emitted, F.col("clean")), F.col("trivia"))}), "event", "parse_ok", "emitted", "again")


ACCEPTED = [(row[0], bool(row[2]), row[1] if row[2] else None, row[0]) for row in PARTS]
add("E14_emit", round_trips, expected(ACCEPTED, "event, parse_ok, emitted, again"))

# The text of a throw: whether it holds an error, its putout, its assists, whether someone handles the ball twice.
THROWS = [("CS2(26)", False, "6", "2", False), ("CS2(2626)", False, "6", "262", True), ("CS2(2E6)", True, None, "2", False), ("643/G6", False, "3", "64", False), ("1U3/G1", False, "3", "1", False), ("99", False, None, "", False), ("E6/G6", True, None, "", False), ("8/F8", False, "8", "", False)]


def throws(spark: SparkSession, d: str) -> DataFrame:
    one = E.parsed(dealt_once(spark, d, [row[:1] for row in THROWS], "event string")).withColumn("s", F.get(E.sequences(), F.lit(0)))
    s = F.col("s")
    told = {"has_error": F.exists(s["atoms"], lambda a: a["error"]), "putout": E.putout(s), "assists": F.array_join(E.assists(s), ""), "repeats": E.repeats_a_fielder(s)}
    return counted(one.withColumns(told), "event", *told)


add("E17_throws", throws, expected(THROWS, "event, has_error, putout, assists, repeats"))
COVERED = [("D7/R6U4.1-H", "6", "4"), ("S8/R46U3", "46", "3"), ("S7/L7", "", ""), ("T9/U9R34", "34", "9")]
add("E18_coverage", lambda s, d: counted(E.parsed(dealt_once(s, d, [r[:1] for r in COVERED], "event string")).withColumns({"relay": F.array_join(F.transform("mods", lambda m: E.of_groups(m, "R")), ""), "unnamed": F.array_join(F.transform("mods", lambda m: E.of_groups(m, "U")), "")}), "event", "relay", "unnamed"), expected(COVERED, "event, relay, unnamed"))

PLACED = [("13/BG1", "BG", "1"), ("13/B1", "B", "1"), ("63/G", "G", None), ("8/78", None, "78"), ("3/P3F", "P", "3F"), ("9/FL/F9LS", "F", "9LS"), ("7/L", "L", None), ("8/SF", None, None), ("5/BP5", "BP", "5")]
add("E7_trajectory", lambda s, d: counted(E.parsed(dealt_once(s, d, [r[:1] for r in PLACED], "event string")).withColumns({"trajectory": E.first_hit("trajectory"), "location": E.first_hit("location")}), "event", "trajectory", "location"), expected(PLACED, "event, trajectory, location"))

#: Known defects aren't counted among the failures.
KNOWN = ("7(4)", "63)")


def failures(spark: SparkSession, d: str) -> DataFrame:
    """Shapes of strings that aren't parsed: how many, up to three examples, the seasons; known defects apart."""
    df = E.parsed(dealt_to(spark, d, [row[:1] for row in PARTS], "event string").withColumn("season", F.col("l_orderkey") % 5)).where(~F.col("parse_ok"))
    known = spark.createDataFrame([(k,) for k in KNOWN], "event string")
    found = df.join(F.broadcast(known), "event", "left_anti").groupBy(E.shape(F.col("event")).alias("shape"))
    return found.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("season").alias("seasons"), F.array_join(F.slice(F.array_sort(F.collect_set("event")), 1, 3), " ").alias("examples"))


PARSES = values([(r[0], bool(r[2])) for r in PARTS], "event, ok")
add("E16_failures", failures, f"SELECT regexp_replace(event, '[0-9]', '#', 'g') AS shape, count(*) AS n, count(DISTINCT l_orderkey % 5) AS seasons, string_agg(DISTINCT event, ' ' ORDER BY event) AS examples FROM lineitem JOIN {PARSES} ON l_partkey % {len(PARTS)} = i WHERE NOT ok AND event NOT IN ({', '.join(map(literal, KNOWN))}) GROUP BY 1")

# The batter: whether he ran, and how that is known.
RAN = [("3", "unknown", "unresolved"), ("63", "yes", "likely"), ("6", "no", "derived"), ("8/F8", "no", "derived"), ("43/G", "yes", "derived"), ("64(1)3", "yes", "likely"), ("K", "no", "derived"), ("99", "unknown", "unresolved"), ("S7", "yes", "derived"), ("13/SH.1-2", "yes", "derived"), ("8/SF.3-H", "no", "derived"), ("NP", "no", "derived"), ("FLE5", "no", "derived"), ("54(1)/FO/G5", "yes", "derived"), ("8(B)84(2)/LDP/L8", "no", "derived"), ("K.B-1", "yes", "derived"), ("1/BP", "no", "derived"), ("SB2", "no", "derived"), ("36(1)3", "yes", "likely"), ("W.1-2", "yes", "derived")]


def stated(df: DataFrame) -> DataFrame:
    """Events with a stated state before them (bases, outs_then) through the parser and the fold's last step."""
    on = {f"b{p}": F.when(F.substring("bases", p, 1) == "1", F.concat(F.lit("runner"), F.lit(str(p)))) for p in (1, 2, 3)}
    return resolved(moved(E.parsed(df)).withColumns({**on, "outs_before": F.col("outs_then"), "batter": F.lit("batter")}))


def batters(spark: SparkSession, d: str) -> DataFrame:
    df = dealt_once(spark, d, [row[:1] for row in RAN], "event string").withColumns({"bases": F.lit("000"), "outs_then": F.lit(0)})
    return counted(stated(df), "event", "batter_ran", "batter_certainty")


add("R4_batter_ran", batters, expected(RAN, "event, batter_ran, batter_certainty"))

# A play from a stated state: movements (origin, - or X or F where it is a force, destination, certainty's first letter), bases and outs after, runs, status.
APPLIED = [
    ("K.B-1;3XH(21)", "111", 2, "B-1n 3FHd", "110", 3, 0, "ok"),
    ("K.3XH(21)", "111", 2, "3FHd B-1n", "110", 3, 0, "ok"),
    ("K.3XH(21);2-3;1-2;B-1", "111", 2, "3FHd 2-3n 1-2n B-1n", "111", 3, 0, "ok"),
    ("K23", "000", 0, "", "000", 1, 0, "ok"),
    ("K.2XH(21);B-1", "010", 1, "2XHd B-1n", "100", 2, 0, "ok"),
    ("K/NDP.3XH(21)", "101", 1, "3XHd", "100", 3, 0, "ok"),
    ("K/DP.1X2(26)", "100", 0, "1X2d", "000", 2, 0, "ok"),
    ("K.B-1", "100", 0, "B-1n", "100", 0, 0, "data_contradicts_rules"),
    ("64(1)3/GDP/G6", "100", 0, "1F2d BF1d", "000", 2, 0, "ok"),
    ("8(B)84(2)/LDP/L8", "010", 0, "2X2d", "000", 2, 0, "ok"),
    ("54(2)/FO/G5.1-2", "110", 0, "1-2n 2F3d B-1n", "110", 1, 0, "ok"),
    ("63", "000", 0, "BF1l", "000", 1, 0, "ok"),
    ("3.1X2(36)", "100", 0, "1X2a", "000", 2, 0, "ok"),
    ("HR.2-H;1-H", "110", 1, "2-Hn 1-Hn B-Hn", "000", 1, 3, "ok"),
    ("HR.B-H", "000", 1, "B-Hn", "000", 1, 1, "ok"),
    ("CS2(25).1-2", "100", 0, "1-2n 1X2d", "000", 1, 0, "state_ambiguous"),
    ("SB3;SB2", "110", 0, "2-3n 1-2n", "011", 0, 0, "ok"),
    ("PO1(13)", "100", 2, "1X1d", "000", 3, 0, "ok"),
    ("S8.2-H;1-H", "001", 0, "2-Hn 1-Hn B-1n", "101", 0, 2, "ok"),
    ("HR.3-H;2-H", "000", 0, "3-Hn 2-Hn B-Hn", "000", 0, 3, "state_inconsistent"),
    ("64(1)3/GDP", "100", 2, "1F2d BF1d", "000", 4, 0, "state_inconsistent"),
    ("NP", "101", 1, "", "101", 1, 0, "ok"),
    ("??", "101", 1, None, None, None, None, "unparsed"),
]


def applied(spark: SparkSession, d: str) -> DataFrame:
    df = stated(dealt_once(spark, d, [row[:3] for row in APPLIED], "event string, bases string, outs_then int"))
    marks = F.transform("resolved", lambda a: F.concat(a["origin"], F.when(a["is_force"], "F").when(a["is_out"], "X").otherwise("-"), a["dest"], F.substring(a["certainty"], 1, 1)))
    return counted(df.withColumn("movements", F.array_join(marks, " ")), "event", "bases", "outs_then", "movements", "bases_after", "outs_after", "runs", "parse_status")


add("R7_one_play", applied, expected(APPLIED, "event, bases, outs_then, movements, bases_after, outs_after, runs, parse_status"))

# The ordered fold: each play of the log view gets an event of this list, with its moves (batter, then the runners from first, second, third: a base, H, X, or . for
# who stays), whether it leaves room for a batter who was alive after all, and whether the batter ran. SQL has recursion for the order.
FOLDED = [
    ("S7", "1...", False), ("D8/L8D.1-H", "2H..", False), ("DGR/F9.2-H;1-3", "23H.", False), ("HR/F78.2-H;1-H", "HHH.", False), ("K", "X...", True), ("K/C", "X...", True),
    ("K/DP.1X2(26)", "XX..", True), ("K+WP.B-1", "1...", False), ("W.1-2", "12..", False), ("IW", "1...", False), ("HP", "1...", False), ("63/G6", "X...", False),
    ("8/F8/SF.3-H", "X..H", False), ("64(1)3/GDP/G6", "XX..", False), ("4/P4/IF", "X...", False), ("23/BG2/SH.1-2", "X2..", False), ("E6/G6", "1...", False),
    ("FC5/G5.3XH(52)", "1..X", False), ("SB2", ".2..", False), ("SB3;SB2", ".23.", False), ("CS2(26)", ".X..", False), ("CS2(2E6)", ".2..", False), ("PO1(13)", ".X..", False),
    ("POCS2(1361)", ".X..", False), ("WP.2-3", "..3.", False), ("BK.1-2", ".2..", False), ("S8/L8.2XH(8E2);1-3", "13H.", False), ("S9/G34.1XH(9/TH)", "1X..", False),
    ("FLE5/P5F", "....", False), ("NP", "....", False), ("S7??.garbage", None, False),
]
DEALT = f"SELECT p.game_key, p.seq, p.play_id, p.inning, p.half, concat('P', CAST(p.play_id % 40 AS STRING)) AS batter, CAST(p.play_id % {len(FOLDED)} AS INT) AS pick FROM ({PLAYS}) p"


def dealt(spark: SparkSession, d: str) -> DataFrame:
    events = F.array(*[F.lit(row[0]) for row in FOLDED])
    return view(spark, d, DEALT).withColumn("event", F.element_at(events, F.col("pick") + 1)).drop("pick")


def fold(spark: SparkSession, d: str) -> DataFrame:
    return replayed_log(dealt(spark, d))


BATTER_TO = lambda base: f"CASE WHEN m.may_retry AND s.outs_before + m.outs = 4 THEN '1' ELSE substr(m.moves, 1, 1) END = '{base}'"
STAYS = lambda place, base: f"s.b{place} IS NOT NULL AND substr(m.moves, {place + 1}, 1) IN ('{base}'{', ' + repr('.') if str(place) == base else ''})"
ON = lambda base: f"CASE WHEN {BATTER_TO(base)} THEN m.batter {' '.join(f'WHEN {STAYS(p, base)} THEN s.b{p}' for p in (1, 2, 3))} END"
TIMES = lambda dest: f"CAST(length(moves) - length(replace(moves, '{dest}', '')) AS INT)"
FOLD_SQL = f"""
WITH RECURSIVE dealt AS (SELECT p.*, event, coalesce(c.moves, '....') AS moves, c.moves IS NOT NULL AS ok, may_retry FROM ({DEALT}) p JOIN {values(FOLDED, "event, moves, may_retry")} ON i = pick),
counted AS (SELECT *, {TIMES("X")} AS outs, {TIMES("H")} AS runs FROM dealt),
changes AS (SELECT *, CASE WHEN lag(inning) OVER w IS NULL OR lag(inning) OVER w <> inning OR lag(half) OVER w <> half THEN 1 ELSE 0 END AS changed FROM counted WINDOW w AS (PARTITION BY game_key ORDER BY seq)),
islands AS (SELECT *, sum(changed) OVER (PARTITION BY game_key ORDER BY seq) AS island FROM changes),
m AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY game_key, island ORDER BY seq) AS k FROM islands),
states(game_key, island, k, b1, b2, b3, outs_before) AS (
  SELECT game_key, island, k, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 0 FROM m WHERE k = 1
  UNION ALL SELECT s.game_key, s.island, s.k + 1, {ON("1")}, {ON("2")}, {ON("3")}, s.outs_before + m.outs - CASE WHEN m.may_retry AND s.outs_before + m.outs = 4 THEN 1 ELSE 0 END
  FROM states s JOIN m ON m.game_key = s.game_key AND m.island = s.island AND m.k = s.k),
joined AS (SELECT m.*, s.b1, s.b2, s.b3, s.outs_before, m.may_retry AND s.outs_before + m.outs = 4 AS alive FROM states s JOIN m ON m.game_key = s.game_key AND m.island = s.island AND m.k = s.k),
folded AS (SELECT * REPLACE (CASE WHEN alive THEN concat('1', substr(moves, 2)) ELSE moves END AS moves, outs - CAST(alive AS INT) AS outs), outs_before + outs - CAST(alive AS INT) AS outs_after, length(concat(coalesce(left(b1, 1), ''), coalesce(left(b2, 1), ''), coalesce(left(b3, 1), ''))) AS runners FROM joined)
"""


def with_placed(spark: SparkSession, d: str) -> DataFrame:
    """The log view with control rows: before every fifth play one that puts a runner on a base."""
    plays = view(spark, d, DEALT)
    events = F.array(*[F.lit(row[0]) for row in FOLDED])
    own = plays.withColumns({"event": F.element_at(events, F.col("pick") + 1), "line_no": 2 * F.col("seq")})
    nothing = F.lit(None)
    control = plays.where("play_id % 5 = 2").select("game_key", (2 * F.col("seq") - 1).alias("line_no"), F.concat(F.lit("Z"), "play_id").alias("place_runner"), (F.col("play_id") % 3 + 1).cast("string").alias("place_base"))
    rows = own.drop("pick").withColumns({"place_runner": nothing.cast("string"), "place_base": nothing.cast("string")}).unionByName(control, allowMissingColumns=True)
    return replayed_log(rows, order="line_no")


PLACED_SQL = f"""
WITH RECURSIVE dealt AS (SELECT p.*, event, coalesce(c.moves, '....') AS moves, c.moves IS NOT NULL AS ok, may_retry FROM ({DEALT}) p JOIN {values(FOLDED, "event, moves, may_retry")} ON i = pick),
counted AS (SELECT *, {TIMES("X")} AS outs, {TIMES("H")} AS runs FROM dealt),
changes AS (SELECT *, CASE WHEN lag(inning) OVER w IS NULL OR lag(inning) OVER w <> inning OR lag(half) OVER w <> half THEN 1 ELSE 0 END AS changed FROM counted WINDOW w AS (PARTITION BY game_key ORDER BY seq)),
numbered AS (SELECT *, sum(changed) OVER (PARTITION BY game_key ORDER BY seq) AS own_island FROM changes),
mixed AS (SELECT game_key, 2 * seq AS pos, seq, play_id, batter, moves, outs, runs, may_retry, ok, CASE WHEN ok AND event <> 'NP' THEN own_island END AS counts, own_island, CAST(NULL AS VARCHAR) AS base, CAST(NULL AS VARCHAR) AS runner FROM numbered
  UNION ALL SELECT game_key, 2 * seq - 1, NULL, NULL, NULL, '....', 0, 0, false, false, NULL, NULL, CAST(play_id % 3 + 1 AS VARCHAR), concat('Z', CAST(play_id AS VARCHAR)) FROM numbered WHERE play_id % 5 = 2),
led AS (SELECT *, coalesce(max(own_island) OVER w, 0) AS last_island, max(counts) OVER w AS begun FROM mixed WINDOW w AS (PARTITION BY game_key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
islands AS (SELECT *, CASE WHEN base IS NULL THEN own_island WHEN last_island = 0 OR begun = last_island THEN last_island + 1 ELSE last_island END AS island FROM led),
m AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY game_key, island ORDER BY pos) AS k FROM islands),
states(game_key, island, k, b1, b2, b3, outs_before) AS (
  SELECT game_key, island, k, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 0 FROM m WHERE k = 1
  UNION ALL SELECT s.game_key, s.island, s.k + 1, {', '.join(f"CASE WHEN m.base = '{p}' THEN m.runner WHEN m.base IS NOT NULL THEN s.b{p} ELSE {ON(p)} END" for p in "123")}, s.outs_before + m.outs - CASE WHEN m.may_retry AND s.outs_before + m.outs = 4 THEN 1 ELSE 0 END
  FROM states s JOIN m ON m.game_key = s.game_key AND m.island = s.island AND m.k = s.k),
placed AS (SELECT m.*, b1, b2, b3, outs_before, m.may_retry AND s.outs_before + m.outs = 4 AS alive, coalesce(left(b1, 1) = 'Z', false) OR coalesce(left(b2, 1) = 'Z', false) OR coalesce(left(b3, 1) = 'Z', false) AS has_placed_runner
  FROM states s JOIN m ON m.game_key = s.game_key AND m.island = s.island AND m.k = s.k WHERE base IS NULL)
"""
add("R9_placed_runners", lambda s, d: with_placed(s, d).where("parse_ok").select("game_key", "seq", "play_id", "b1", "b2", "b3", "outs_before", "has_placed_runner"), f"{PLACED_SQL} SELECT game_key, seq, play_id, b1, b2, b3, outs_before, has_placed_runner FROM placed WHERE ok")
BASES_SQL = "concat(CASE WHEN b1 IS NULL THEN '0' ELSE '1' END, CASE WHEN b2 IS NULL THEN '0' ELSE '1' END, CASE WHEN b3 IS NULL THEN '0' ELSE '1' END)"


def moves_text() -> Column:
    return F.concat(*[F.coalesce(F.col(f"move_{p}"), F.lit(".")) for p in ("b", "1", "2", "3")])


add("R1_moves", lambda s, d: counted(read(dealt(s, d)).withColumn("moves", F.when(F.col("parse_ok"), moves_text())), "event", "moves", "outs", "runs"), f"SELECT event, c.moves, coalesce({TIMES('X')}, 0) AS outs, coalesce({TIMES('H')}, 0) AS runs, count(*) AS n FROM ({DEALT}) p JOIN {values([r[:2] for r in FOLDED], 'event, moves')} ON i = pick GROUP BY ALL")
add("R7_fold_bases", lambda s, d: fold(s, d).select("game_key", "seq", "play_id", "b1", "b2", "b3", "bases_before", "outs_before", "outs", "runs", "outs_after", "retried"), f"{FOLD_SQL} SELECT game_key, seq, play_id, CASE WHEN ok THEN b1 END AS b1, CASE WHEN ok THEN b2 END AS b2, CASE WHEN ok THEN b3 END AS b3, CASE WHEN ok THEN {BASES_SQL} END AS bases_before, CASE WHEN ok THEN outs_before END AS outs_before, CASE WHEN ok THEN outs END AS outs, CASE WHEN ok THEN runs END AS runs, CASE WHEN ok THEN outs_after END AS outs_after, alive AS retried FROM folded")
FORCE_OUTS = "CASE event WHEN '63/G6' THEN 'B' WHEN '23/BG2/SH.1-2' THEN 'B' WHEN '64(1)3/GDP/G6' THEN '1B' WHEN 'S9/G34.1XH(9/TH)' THEN '1' WHEN 'K/DP.1X2(26)' THEN CASE WHEN alive THEN '1' ELSE '' END WHEN 'FC5/G5.3XH(52)' THEN CASE WHEN b1 IS NOT NULL AND b2 IS NOT NULL THEN '3' ELSE '' END ELSE '' END"
add("R3_forced", lambda s, d: counted(fold(s, d), "forced", "force_outs"), f"{FOLD_SQL} SELECT CASE WHEN NOT ok THEN NULL WHEN b1 IS NULL THEN '' WHEN b2 IS NULL THEN '1' WHEN b3 IS NULL THEN '12' ELSE '123' END AS forced, CASE WHEN ok THEN {FORCE_OUTS} END AS force_outs, count(*) AS n FROM folded GROUP BY ALL")
FLAGS_SQL = {
    "advance_from_empty_base": "(substr(moves, 2, 1) <> '.' AND b1 IS NULL) OR (substr(moves, 3, 1) <> '.' AND b2 IS NULL) OR (substr(moves, 4, 1) <> '.' AND b3 IS NULL)",
    "reached_against_rules": "(event = 'K+WP.B-1' OR alive) AND b1 IS NOT NULL AND outs_before <> 2",
    "runs_without_runners": "runs > 1 + runners",
    "more_than_three_outs": "outs_after > 3",
}
add("R8_flags", lambda s, d: counted(fold(s, d).select(F.explode("flags").alias("flag")), "flag"), f"{FOLD_SQL} SELECT flag, count(*) AS n FROM ({' UNION ALL '.join(f'SELECT {literal(n)} AS flag FROM folded WHERE ok AND ({c})' for n, c in FLAGS_SQL.items())}) GROUP BY flag")
STATUS_SQL = f"CASE WHEN NOT ok THEN 'unparsed' WHEN {FLAGS_SQL['runs_without_runners']} OR {FLAGS_SQL['more_than_three_outs']} THEN 'state_inconsistent' WHEN {FLAGS_SQL['reached_against_rules']} THEN 'data_contradicts_rules' ELSE 'ok' END"
add("R8_status", lambda s, d: counted(fold(s, d), "parse_status"), f"{FOLD_SQL} SELECT {STATUS_SQL} AS parse_status, count(*) AS n FROM folded GROUP BY 1")
SCORED_SQL = f"{FOLD_SQL}, s AS (SELECT *, CAST(coalesce(sum(runs) OVER (PARTITION BY game_key, half ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS own_before, CAST(coalesce(sum(runs) OVER (PARTITION BY game_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS all_before FROM folded), t AS (SELECT *, all_before - own_before AS other_before, own_before <= all_before - own_before AND own_before + runs > all_before - own_before AS go_ahead, ok AND seq = max(CASE WHEN ok THEN seq END) OVER (PARTITION BY game_key) AS final_play FROM s)"
add("R9_score", lambda s, d: scored(fold(s, d)).select("play_id", "own_before", "other_before", "go_ahead"), f"{SCORED_SQL} SELECT play_id, own_before, other_before, go_ahead FROM t")
add("R11_walk_off", lambda s, d: scored(fold(s, d)).where("final_play").select("play_id", "walk_off"), f"{SCORED_SQL} SELECT play_id, go_ahead AS walk_off FROM t WHERE final_play")
add("R12_short_halves", lambda s, d: counted(short_halves(fold(s, d)), "outs_at_close"), f"{FOLD_SQL}, e AS (SELECT game_key, island, arg_max(outs_after, seq) FILTER (WHERE ok) AS outs_at_close FROM folded GROUP BY game_key, island) SELECT outs_at_close, count(*) AS n FROM (SELECT *, max(island) OVER (PARTITION BY game_key) AS last FROM e) WHERE island < last AND outs_at_close <> 3 GROUP BY outs_at_close")
add("R15_index", lambda s, d: counted(scored(fold(s, d)).where("parse_ok"), "half", "outs_before", "bases_before"), f"{FOLD_SQL} SELECT half, outs_before, {BASES_SQL} AS bases_before, count(*) AS n FROM folded WHERE ok GROUP BY ALL")


def quality(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a replay: plays by status, and the commonest shapes of those that aren't right."""
    wrong = fold(spark, d).where("parse_status <> 'ok'").groupBy("parse_status", E.shape(F.col("event")).alias("shape")).agg(F.count(F.lit(1)).alias("n"))
    return wrong.orderBy(F.desc("n"), "parse_status", "shape").limit(10)


add("R16_culprits", quality, f"{FOLD_SQL} SELECT parse_status, shape, count(*) AS n FROM (SELECT {STATUS_SQL} AS parse_status, regexp_replace(event, '[0-9]', '#', 'g') AS shape FROM folded) WHERE parse_status <> 'ok' GROUP BY ALL ORDER BY n DESC, parse_status, shape LIMIT 10")

# Tags: for each rule plays that it holds for, and near misses. Event, bases, outs, and what else the rule reads.
HOLDS: dict[str, tuple[list[tuple], list[tuple]]] = {
    "Single": ([("S7",)], [("D7",)]), "Double": ([("D9",), ("DGR",)], [("S9",)]), "Triple": ([("T8",)], [("D8",)]), "GroundRuleDouble": ([("DGR7",)], [("D7",)]),
    "HomeRun": ([("HR/F7",), ("H8",)], [("T7",)]), "InsideTheParkHomeRun": ([("HR8/F8",), ("HR/IPHR",)], [("HR/F8",)]), "Walk": ([("W",), ("IW",)], [("HP",)]),
    "IntentionalWalk": ([("I",), ("IW",)], [("W",)]), "HitByPitch": ([("HP.1-2", "100")], [("W.1-2", "100")]), "Strikeout": ([("K+PB",)], [("W",)]),
    "ReachedOnError": ([("E5",), ("64E3",)], [("53",)]), "FieldersChoice": ([("FC4.1-2", "100")], [("43",)]), "SacrificeFly": ([("9/SF.3-H", "001")], [("9/F9",)]),
    "SacrificeHit": ([("34/SH.1-2", "100")], [("34/G3", "100")]), "GroundOut": ([("43/G",), ("53/BG5",)], [("7/F7",)]), "FlyOut": ([("7/F",)], [("43/G4",)]),
    "LineOut": ([("4/L",), ("5/BL",)], [("7/F7",)]), "PopOut": ([("4/P4",), ("2/BP2",)], [("7/F7",)]), "Bunt": ([("53/B5",), ("2/BP",)], [("53/G5",)]), "InfieldFly": ([("6/IF/P6",)], [("6/P6",)]),
    "UncaughtThirdStrike": ([("K23",), ("K+WP",), ("K+E2",), ("K.B-1",), ("K.2-3(PB)", "010")], [("K",), ("K.2X3(25)", "010"), ("K+SB2", "100")]),
    "BatterReachedOnK": ([("K+PB.B-1",), ("K.3XH(21)", "111", 2)], [("K23",), ("K+WP",)]), "DroppedThirdStrike": ([("K13",)], [("K/C",)]),
    "StrikeoutDoublePlay": ([("K.1X2(26)", "100"), ("K/DP",)], [("K/NDP.1X2(26)", "100"), ("K",)]), "CalledThirdStrike": ([("K/C",)], [("K/S",)]),
    "StrikeoutThrowOut": ([("K.2X3(25)", "010")], [("K+CS3(25)", "010")]), "StolenBase": ([("SBH", "001")], [("CSH(2)", "001")]), "DoubleSteal": ([("SBH;SB2", "101")], [("SBH", "101")]),
    "CaughtStealing": ([("CS3(25)", "010"), ("K+CS2(24)", "100")], [("CS3(2E5)", "010")]), "CaughtStealingSafeOnError": ([("CS3(2E5)", "010")], [("CS3(25)", "010")]),
    "Pickoff": ([("PO2(14)", "010")], [("PO2(E4)", "010"), ("POCS3(145)", "010")]), "PickoffError": ([("PO2(E4).2-3", "010")], [("PO2(14)", "010")]), "PickoffCaughtStealing": ([("POCS3(145)", "010")], [("PO2(14)", "010")]),
    "DefensiveIndifference": ([("DI.2-3", "010")], [("SB3", "010")]), "WildPitch": ([("K+WP",), ("W.2-3(WP)", "010")], [("K+PB",)]), "PassedBall": ([("PB.3-H", "001"), ("W.2-3(PB)", "010")], [("WP.3-H", "001")]),
    "Balk": ([("BK.3-H", "001")], [("WP.3-H", "001")]), "OtherAdvance": ([("OA.2-3", "010")], [("DI.2-3", "010")]), "RunnerPassedRunner": ([("D7/PASS.1-3", "100")], [("D7.1-3", "100")]),
    "RunnerHitByBattedBall": ([("6/BR", "010")], [("6/G6", "010")]), "ForceOut": ([("36(1)/FO/G3", "100"), ("K.3XH(21)", "111", 2)], [("7/F7", "100"), ("K/NDP.3XH(21)", "101", 1), ("4(B)46(2)/LDP/L4", "010")]),
    "ForceOutAtHome": ([("12(3)/FO/G1.2-3;1-2", "111")], [("FC1.3XH(12)", "001"), ("K.2XH(21);B-1", "010", 1)]), "ForceOutAtThird": ([("15(2)/FO/G1.1-2", "110")], [("16(1)/FO/G1", "110")]),
    "ForceOutAtSecond": ([("16(1)/FO/G1", "100")], [("15(2)/FO/G1.1-2", "110")]), "ForceOutAtFirst": ([("53/G5",), ("3/G3",)], [("3/P3",), ("8/F8",)]), "TagOut": ([("S8.2XH(82)", "010"), ("CS2(26)", "100")], [("43/G4",), ("K",)]) ,
    "AppealOut": ([("8/F8/AP.1X1(83)", "100")], [("8/F8.1X1(83)", "100")]), "DoublePlay": ([("46(1)3/GDP/G4", "100"), ("8/F8.1X1(83)", "100"), ("4/LDP",)], [("43/G4", "100"), ("K/NDP.1X2(26)", "100")]),
    "TriplePlay": ([("5(2)54(1)43/GTP/G5", "110"), ("4/LTP",)], [("46(1)3/GDP/G4", "100")]), "UnassistedOut": ([("9/F9",), ("3/G3",)], [("43/G4",), ("E3",)]),
    "Rundown": ([("POCS2(13431)", "100"), ("S7.1X3(7565)", "100")], [("POCS2(134)", "100"), ("CS2(22)", "100")]), "RelayThrow": ([("T9/R4",)], [("T9/U4",), ("T9",)]),
    "CatcherInterference": ([("C/E2",)], [("C/E3",), ("S7/E2",)]), "PitcherInterference": ([("C/E1",)], [("C/E2",)]), "FirstBaseInterference": ([("C/E3",)], [("C/E1",)]),
    "BatterInterference": ([("2/BINT",)], [("2/RINT",)]), "RunnerInterference": ([("6(1)/RINT", "100")], [("64(1)", "100")]), "UmpireInterference": ([("S6/UINT",)], [("S6",)]),
    "FanInterference": ([("7/FINT",)], [("7/F7",)]), "Obstruction": ([("D8/OBS",)], [("D8",)]), "BattingOutOfTurn": ([("8/BOOT",), ("S7", "000", 0, {"after_ladj": True})], [("8/F8",)]),
    "CourtesyRunner": ([("S7/COUR",)], [("S7/COUB",)]), "CourtesyBatter": ([("S7/COUB",)], [("S7/COUF",)]), "CourtesyFielder": ([("S7/COUF",)], [("S7/COUR",)]),
    "FoulFlyError": ([("FLE3",)], [("E3",)]), "ErrorOnThrow": ([("S8.2XH(E8/TH)", "010"), ("E6/TH",)], [("S8.2XH(E8)", "010"), ("S8.2XH(82/TH)", "010")]), "UnknownPlay": ([("99",), ("99/SF.3-H", "001")], [("9",)]),
    "ReplayReviewed": ([("8/F8/UREV",), ("S8/MREV",)], [("8/F8",)]), "ReplayOverturned": ([("S8/MREV", "000", 0, {"replay_reversed": True})], [("S8/MREV",), ("S8", "000", 0, {"replay_reversed": True})]),
    "PlacedRunner": ([("S8", "010", 0, {"has_placed_runner": True})], [("S8", "010")]), "HiddenBallTrick": ([], [("PO1(3)", "100")]),
    "BasesLoaded": ([("K", "111")], [("K", "011")]), "BasesEmpty": ([("K", "000")], [("K", "001")]), "RunnerOnThird": ([("K", "001")], [("K", "110")]), "ScoringPosition": ([("K", "010")], [("K", "100")]),
    "NoOuts": ([("K", "000", 0)], [("K", "000", 1)]), "OneOut": ([("K", "000", 1)], [("K", "000", 2)]), "TwoOuts": ([("K", "000", 2)], [("K", "000", 1)]), "InningEnding": ([("K", "000", 2), ("46(1)3/GDP", "100", 1)], [("K", "000", 1)]),
    "GoAheadRun": ([("HR", "000", 0, {"go_ahead": True})], [("HR",)]), "WalkOff": ([("HR", "000", 0, {"walk_off": True})], [("HR",)]), "FinalPlay": ([("K", "000", 2, {"final_play": True})], [("K", "000", 2)]),
    "ExtraInnings": ([("K", "000", 0, {"inning": 10}), ("K", "000", 0, {"inning": 8, "scheduled_innings": 7})], [("K", "000", 0, {"inning": 9})]),
    "LateAndClose": ([("K", "000", 0, {"inning": 7}), ("K", "110", 0, {"inning": 9, "other_before": 3}), ("K", "000", 0, {"inning": 8, "own_before": 1})], [("K", "000", 0, {"inning": 6}), ("K", "100", 0, {"inning": 9, "other_before": 3}), ("K", "000", 0, {"inning": 8, "own_before": 2})]),
}
CASES = [(tag, holds, *(case + ("000", 0, {})[len(case) - 1 :])) for tag, both in HOLDS.items() for holds, some in zip((True, False), both) for case in some]
CASE_ROWS = [(tag, holds, event, bases, outs, *[extra.get(k, v) for k, v in T.DEFAULTS.items()]) for tag, holds, event, bases, outs, extra in CASES]
CASE_SCHEMA = "tag string, expected boolean, event string, bases string, outs_then int, " + ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'int'}" for k, v in T.DEFAULTS.items())


def tagged(df: DataFrame) -> DataFrame:
    return T.facts(df).withColumn("tags", T.tag_rows(T.ALL))


def all_tags(spark: SparkSession, d: str) -> DataFrame:
    df = tagged(stated(dealt_once(spark, d, CASE_ROWS, CASE_SCHEMA)))
    return counted(df.withColumn("holds", F.array_contains(F.transform("tags", lambda t: t["tag"]), F.col("tag"))), "tag", "event", "bases", "outs_then", "holds")


add("T_all_tags", all_tags, expected([(tag, event, bases, outs, holds) for tag, holds, event, bases, outs, _ in CASES], "tag, event, bases, outs_then, holds"))

# Whole tag sets of some plays.
WHOLE = [
    ("K.B-1;3XH(21)", "111", 2, "BasesLoaded,BatterReachedOnK,DroppedThirdStrike,ForceOut,ForceOutAtHome,InningEnding,RunnerOnThird,ScoringPosition,Strikeout,StrikeoutThrowOut,TwoOuts,UncaughtThirdStrike"),
    ("K.3XH(21)", "111", 2, "BasesLoaded,BatterReachedOnK,DroppedThirdStrike,ForceOut,ForceOutAtHome,InningEnding,RunnerOnThird,ScoringPosition,Strikeout,StrikeoutThrowOut,TwoOuts,UncaughtThirdStrike"),
    ("K23", "000", 0, "BasesEmpty,DroppedThirdStrike,NoOuts,Strikeout,UncaughtThirdStrike"),
    ("K.2XH(21);B-1", "010", 1, "BatterReachedOnK,DroppedThirdStrike,OneOut,ScoringPosition,Strikeout,StrikeoutThrowOut,TagOut,UncaughtThirdStrike"),
    ("K/NDP.3XH(21)", "101", 1, "InningEnding,OneOut,RunnerOnThird,ScoringPosition,Strikeout,StrikeoutThrowOut,TagOut"),
    ("K/DP.1X2(26)", "100", 0, "DoublePlay,NoOuts,Strikeout,StrikeoutDoublePlay,StrikeoutThrowOut,TagOut"),
    ("64(1)3/GDP/G6", "100", 0, "DoublePlay,ForceOut,ForceOutAtFirst,ForceOutAtSecond,GroundOut,NoOuts,UnassistedOut"),
    ("8/F8/SF.3-H", "101", 1, "FlyOut,OneOut,RunnerOnThird,SacrificeFly,ScoringPosition,UnassistedOut"),
    ("DGR/F9.2-H;1-3", "110", 0, "Double,GroundRuleDouble,NoOuts,ScoringPosition"),
    ("SB3;SB2", "110", 2, "DoubleSteal,ScoringPosition,StolenBase,TwoOuts"),
]


def whole_sets(spark: SparkSession, d: str) -> DataFrame:
    df = tagged(stated(dealt_once(spark, d, [r[:3] for r in WHOLE], "event string, bases string, outs_then int")))
    return counted(df.withColumn("names", joined(F.transform("tags", lambda t: t["tag"]))), "event", "bases", "outs_then", "names")


add("G2_tag_sets", whole_sets, expected(WHOLE, "event, bases, outs_then, names"))

SURE = [("K#", "000", "Strikeout", "uncertain"), ("K#", "000", "BasesEmpty", "certain"), ("99", "000", "UnknownPlay", "uncertain"), ("3.1X2(36)", "100", "TagOut", "uncertain"), ("8/F8.1X1(83)", "100", "TagOut", "certain"), ("63", "000", "ForceOutAtFirst", "certain"), ("S7!", "000", "Single", "certain"), ("99/SF.3-H", "001", "SacrificeFly", "uncertain"), ("99/SF.3-H", "001", "RunnerOnThird", "certain")]


def sureness(spark: SparkSession, d: str) -> DataFrame:
    df = tagged(stated(dealt_once(spark, d, [r[:3] for r in SURE], "event string, bases string, tag string").withColumn("outs_then", F.lit(0))))
    found = F.get(F.filter("tags", lambda t: t["tag"] == F.col("tag")), F.lit(0))["confidence"]
    return counted(df.withColumn("confidence", found), "event", "tag", "confidence")


add("G4_confidence", sureness, expected([(e, t, c) for e, _, t, c in SURE], "event, tag, confidence"))
on_view("T_context_tags", PLAYS, lambda p: counted(p.select(F.explode(T.tag_array(T.STATE)).alias("name")), "name"), " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM plays WHERE {c}" for n, c in (("BasesLoaded", "bases_before = '111'"), ("BasesEmpty", "bases_before = '000'"), ("RunnerOnThird", "bases_before LIKE '__1'"), ("ScoringPosition", "bases_before LIKE '_1_' OR bases_before LIKE '__1'"), ("NoOuts", "outs_before = 0"), ("OneOut", "outs_before = 1"), ("TwoOuts", "outs_before = 2"))))


def categories(spark: SparkSession, d: str) -> DataFrame:
    """How many plays of the log view carry a tag of each category of the tags' table; tags that the table lacks are unknown."""
    known = F.broadcast(T.tag_table(spark, T.ALL).select(F.col("name"), "category"))
    spelled = F.when(F.col("tag") == "purchase", "HomeRun").when(F.col("tag") == "click", "Single").when(F.col("tag") == "view", "Walk").when(F.col("tag") == "error", "Pickoff").otherwise("NoSuchTag")
    return counted(view(spark, d, PLAY_TAGS).withColumn("name", spelled).join(known, "name", "left").withColumn("category", F.coalesce("category", F.lit("unknown"))), "category")


add("G9_categories", categories, f"{WITH} SELECT CASE WHEN tag IN ('purchase', 'click', 'view') THEN 'batting' WHEN tag = 'error' THEN 'baserunning' ELSE 'unknown' END AS category, count(*) AS n FROM play_tags GROUP BY 1")
