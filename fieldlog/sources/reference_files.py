"""Lines of reference files and of published game logs to typed rows, as columns. A line that isn't as it should be keeps its row, with `problem` set.

Frames of lines have path, line_no and raw_line, as `event_files.lines` gives them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .event_files import fields

#: Fixed values of the formats.
BATS = THROWS = ("L", "R", "B", "?", "")
POSITIONS = ("P", "C", "1B", "2B", "3B", "SS", "LF", "CF", "RF", "OF", "DH", "PH", "PR", "?", "")
APPEARANCES = ("id", "last", "first", "bat", "throw", "team", "g", "g_p", "g_sp", "g_rp", "g_c", "g_1b", "g_2b", "g_3b", "g_ss", "g_lf", "g_cf", "g_rf", "g_of", "g_dh", "g_ph", "g_pr", "first_g", "last_g", "season")
COUNTS = APPEARANCES[6:22]
LOG_FIELDS = 161
#: Places of the fields of a game log that are read.
LOG = {"date": 0, "number": 1, "away": 3, "away_league": 4, "home": 6, "home_league": 7, "away_score": 9, "home_score": 10, "outs": 11, "completion": 13, "forfeit": 14, "park": 16, "away_er": 39, "away_er_team": 40, "home_er": 67, "home_er_team": 68}
SERIES = {"GLWS": "ws", "GLLC": "lc", "GLDV": "dv", "GLWC": "wc", "GLAS": "as", "GLCT": "ct"}
LONGEST_ID = 8


def at(i: int) -> Column:
    return F.trim(F.get("fields", F.lit(i)))


def or_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def first_problem(**tests: Column) -> Column:
    """The name of the first test that holds, spaces for underscores."""
    out = F.lit(None).cast("string")
    for name, test in reversed(tests.items()):
        out = F.when(test, name.replace("_", " ")).otherwise(out)
    return out


def whole_number(x: Column) -> Column:
    return F.when(x.rlike("^-*[0-9]+$"), x.try_cast("int"))


def iso_date(x: Column) -> Column:
    """yyyymmdd as yyyy-mm-dd; 0 is no date."""
    return F.when(x.rlike("^[0-9]{8}$"), F.concat_ws("-", F.substring(x, 1, 4), F.substring(x, 5, 2), F.substring(x, 7, 2)))


def park_date(x: Column) -> Column:
    """m/d/yyyy as yyyy-mm-dd, parts padded; what is no date is null."""
    mdy = r"^([0-9]+)/([0-9]+)/([0-9]+)$"
    part = lambda i, n: F.lpad(F.regexp_extract(x, mdy, i), n, "0")
    return F.when(x.rlike(mdy), F.concat_ws("-", part(3, 4), part(1, 2), part(2, 2)))


def loose_date(x: Column) -> Column:
    """y/m/d and m/d/yyyy as yyyy-mm-dd, parts of one digit padded; anything else as it is."""
    ymd, mdy = r"^([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})$", r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$"
    two = lambda pattern, i: F.lpad(F.regexp_extract(x, pattern, i), 2, "0")
    return F.when(x.rlike(ymd), F.concat_ws("-", F.regexp_extract(x, ymd, 1), two(ymd, 2), two(ymd, 3))).when(x.rlike(mdy), F.concat_ws("-", F.regexp_extract(x, mdy, 3), two(mdy, 1), two(mdy, 2))).otherwise(x)


def rosters(lines: DataFrame) -> DataFrame:
    """person_id, last, first, bats, throws, team, position, problem."""
    df = lines.withColumn("fields", F.split("raw_line", ","))
    problem = first_problem(number_of_fields=F.size("fields") != 7, length_of_id=F.length(at(0)) != LONGEST_ID, bats=~at(3).isin(*BATS), throws=~at(4).isin(*THROWS), position=~at(6).isin(*POSITIONS))
    return df.select("path", "line_no", at(0).alias("person_id"), at(1).alias("last"), at(2).alias("first"), or_null(at(3)).alias("bats"), or_null(at(4)).alias("throws"), at(5).alias("team"), or_null(at(6)).alias("position"), problem.alias("problem"))


def teams(lines: DataFrame) -> DataFrame:
    """team_id, league (null for a club without one), city, nickname, problem."""
    df = lines.withColumn("fields", F.split("raw_line", ","))
    return df.select("path", "line_no", at(0).alias("team_id"), or_null(at(1)).alias("league"), at(2).alias("city"), at(3).alias("nickname"), first_problem(number_of_fields=F.size("fields") != 4, no_id=at(0) == "").alias("problem"))


def headed(lines: DataFrame, header: Sequence[str]) -> DataFrame:
    """path, line_no, fields (quotes gone, trimmed), problem: rows below a first line that must be the header, and as wide as it."""
    df = lines.withColumn("fields", F.transform(fields(F.col("raw_line")), lambda x: F.trim(x)))
    heads = df.where("line_no = 1").select("path", (F.col("fields") == F.array(*map(F.lit, header))).alias("as_expected"))
    # One row a file.
    rows = df.where("line_no > 1").join(heads, "path", "left")
    return rows.withColumn("problem", first_problem(header=~F.coalesce("as_expected", F.lit(False)), number_of_fields=F.size("fields") != len(header))).drop("as_expected", "raw_line")


def appearances(lines: DataFrame) -> DataFrame:
    """The headed file of players' seasons: ids, sixteen counts, first and last game, season, problem (also where pitched games aren't starts and reliefs)."""
    df = headed(lines, APPEARANCES)
    n = {c: whole_number(at(APPEARANCES.index(c))) for c in COUNTS}
    problem = F.coalesce("problem", first_problem(no_number=F.array_contains(F.array(*[x.isNull() for x in n.values()]), F.lit(True)), pitched_games=n["g_p"] != n["g_sp"] + n["g_rp"]))
    place = APPEARANCES.index
    return df.select("path", "line_no", at(0).alias("person_id"), at(1).alias("last"), at(2).alias("first"), or_null(at(3)).alias("bats"), or_null(at(4)).alias("throws"), at(place("team")).alias("team"), *[x.alias(c) for c, x in n.items()], iso_date(at(place("first_g"))).alias("first_g"), iso_date(at(place("last_g"))).alias("last_g"), whole_number(at(place("season"))).alias("season"), problem.alias("problem"))


def game_logs(lines: DataFrame, keys: Sequence[str] = ("path", "line_no")) -> DataFrame:
    """The fields of LOG, typed, with the keys of a line, game_id and the raw line; quoted fields may hold commas."""
    # Generated, as Spark puts a filter on what comes from a plain column in its place below: each test of a problem would split the line again.
    df = lines.select("*", F.explode(F.array(fields(F.col("raw_line")))).alias("fields"))
    x = {name: at(i) for name, i in LOG.items()}
    numbers = ("away_score", "home_score", "outs", "away_er", "away_er_team", "home_er", "home_er_team")
    typed = {n: whole_number(c) if n in numbers else or_null(c) if n in ("park",) else c for n, c in x.items()} | {"date": iso_date(x["date"]), "number": F.coalesce(or_null(x["number"]), F.lit("0"))}
    digit = F.when(x["number"] == "A", "1").when(x["number"] == "B", "2").when(x["number"].rlike("^[0-9]+$"), x["number"]).otherwise("0")
    problem = first_problem(number_of_fields=F.size("fields") != LOG_FIELDS, date=~x["date"].rlike("^[0-9]{8}$"), score=whole_number(x["away_score"]).isNull() | whole_number(x["home_score"]).isNull())
    return df.select(*keys, *[c.alias(n) for n, c in typed.items()], F.concat(x["home"], x["date"], digit).alias("game_id"), "raw_line", problem.alias("problem"))


def series(path: Column) -> Column:
    """From a log's file name: regular, unless its name says another series."""
    name = F.upper(F.regexp_extract(path, r"([^/]+)$", 1))
    out = F.lit("regular")
    for prefix, code in SERIES.items():
        out = F.when(name.startswith(prefix), code).otherwise(out)
    return out


#: Shapes that the rows of a log have if its fields are where they should be, with the share of rows that may differ.
LAYOUT = {
    "scores": ("away_score BETWEEN 0 AND 60 AND home_score BETWEEN 0 AND 60", 0.001),
    "team ids": ("length(home) = 3 AND length(away) = 3", 0.001),
    "league ids": ("length(home_league) IN (0, 2) AND length(away_league) IN (0, 2)", 0.01),
    "outs by three": ("outs IS NULL OR outs % 3 = 0 OR home_score > away_score", 0.005),
    "length of game": ("outs IS NULL OR outs BETWEEN 6 AND 200", 0.02),
    "park ids": ("park IS NULL OR park RLIKE '^[A-Za-z]{3}'", 0.01),
    "earned runs": ("(home_er_team IS NULL OR home_er_team <= away_score) AND (away_er_team IS NULL OR away_er_team <= home_score)", 0.02),
}


def layout(logs: DataFrame) -> DataFrame:
    """Per shape: failures, checked, holds; all from one pass over the rows without a problem."""
    one = logs.where("problem IS NULL").agg(F.count(F.lit(1)).alias("checked"), *[F.count_if(~F.coalesce(F.expr(rule), F.lit(False))).alias(name) for name, (rule, _) in LAYOUT.items()])
    each = F.array(*[F.struct(F.lit(n).alias("shape"), F.col(n).alias("failures"), F.lit(t).alias("tolerated")) for n, (_, t) in LAYOUT.items()])
    found = one.select("checked", F.explode(each).alias("x")).select("x.*", "checked")
    return found.select("shape", "failures", "checked", (F.col("failures") <= F.col("checked") * F.col("tolerated")).alias("holds"))


def held_elsewhere(new: DataFrame, held: DataFrame) -> DataFrame:
    """Files of new logs (path, game_id, raw_line) with lines that are held from another path: path, other, lines (of the new file; a line that other holds several times counts once)."""
    other = held.select("game_id", "raw_line", F.col("path").alias("other")).distinct()
    return new.join(other, ["game_id", "raw_line"]).where("path <> other").groupBy("path", "other").agg(F.count(F.lit(1)).alias("lines"))
