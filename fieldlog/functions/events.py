"""Event strings as columns: annotations, basic events, modifiers, advances, credits, and the text put together again. No Python per row.

The notation is regular, so one pattern decides whether a string belongs to it and cuts it into its three sections; what a section
holds is then read by smaller patterns. `parsed` does this for a frame, column after column, so that each is computed once.

Defined cases: null and malformed strings keep their row, with parse_ok false and null in place of the parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the notation: codes that stand alone, trajectories (longest first), flags of advances. A trajectory without a place, like /G, isn't a code.
NAMED = ("AP", "BF", "BGDP", "BINT", "BOOT", "BPDP", "BR", "C", "COUB", "COUF", "COUR", "DP", "FDP", "FINT", "FL", "FO", "GDP", "GTP", "IF", "INT", "IPHR", "LDP", "LTP", "MREV", "NDP", "OBS", "PASS", "RINT", "S", "SF", "SH", "TP", "UINT", "UREV")
TRAJECTORIES = ("BG", "BP", "BL", "B", "G", "L", "P", "F")
FLAGS = ("UR", "TUR", "RBI", "NR", "NORBI", "WP", "PB", "SB1", "SB2", "SB3", "SBH")

# Patterns.
PLACE = "[0-9]{1,2}[LMRSDXFW]*"
HIT = f"(?:{'|'.join(TRAJECTORIES)})?(?:{PLACE})?"
COVERAGE = "(?:[RU][1-9]*)+"
MODIFIER = f"(?:{'|'.join(NAMED)}|E[1-9U]|TH[B123H]?|{COVERAGE}|{HIT})"
ATOMS = "(?:E?[1-9U])*"
PARAMETER = rf"\((?:{'|'.join(FLAGS)}|{ATOMS}(?:/{MODIFIER})*|{MODIFIER}(?:/{MODIFIER})*)\)"
GROUPS = r"(?:[1-9U]*\([B123H]\))*[1-9U]*"
#: What each kind of basic event looks like, in the order of the tests.
KINDS = (
    ("NP", "NP"), *[(k, rf"{k}[B123H]?(?:{PARAMETER})*") for k in ("POCS", "PO", "CS", "SB")], *[(k, k) for k in ("DI", "OA", "WP", "PB", "BK")],
    *[(k, f"{k}[1-9U]*") for k in ("DGR", "FLE", "FC")], ("HP", "HP"), ("HR", "HR?[1-9U]*"), ("W", "IW|I|W"), ("K", f"K{GROUPS}"),
    ("S", "S[1-9U]*"), ("D", "D[1-9U]*"), ("T", "T[1-9U]*"), ("C", "C"), ("E", "[1-9U]*E[1-9U]"), ("OUT", rf"(?=[1-9U(]){GROUPS}"),
)
BASIC = f"(?:{'|'.join(p for _, p in KINDS)})"
ADVANCE = rf"[B123H][-X][123H](?:{PARAMETER})*"
EVENT = rf"^({BASIC}(?:[+;]{BASIC})*)((?:/{MODIFIER})*)(?:\.({ADVANCE}(?:;{ADVANCE})*))?\z"
RUNNING = ("POCS", "PO", "CS", "SB", "DI", "OA", "WP", "PB", "BK")
MARK, OPERATOR = "\u0001", "\u0002"


def none_of(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def marked(event: Column) -> Column:
    """The event with each annotation after a mark: # ! ? anywhere; + before an end or one of / . ; ) ; - unless it is an advance's operator."""
    out = F.regexp_replace(event, "[#!?]", f"{MARK}$0")
    out = F.regexp_replace(out, rf"\+(?=(?:{MARK}.)*(?:[/.;)]|\z))", f"{MARK}$0")
    head = F.regexp_replace(F.regexp_extract(out, r"(?s)^([^.]*)", 1), "-", f"{MARK}$0")
    tail = F.regexp_extract(out, r"(?s)^[^.]*(\..*)\z", 1)
    # Of hyphens in a row the last alone can be an operator.
    tail = F.regexp_replace(tail, rf"-(?=(?:{MARK}.)*-)", f"{MARK}$0")
    # Those that are operators hide behind a sign of their own while the others are marked.
    tail = F.regexp_replace(tail, rf"([B123H](?:{MARK}.)*)(?<!{MARK})-(?=(?:{MARK}[#!?])*[123H])", f"$1{OPERATOR}")
    tail = F.replace(F.regexp_replace(tail, rf"(?<!{MARK})-", f"{MARK}$0"), F.lit(OPERATOR), F.lit("-"))
    return F.concat(head, tail)


def stripped(event: Column) -> Column:
    """Without annotations."""
    return F.regexp_replace(marked(event), f"{MARK}.", "")


def annotations(event: Column) -> Column:
    """Array of (at, mark): each annotation and its place in the stripped event."""
    parts = F.split(marked(event), MARK)
    start = F.struct(F.length(F.get(parts, F.lit(0))).alias("at"), none_of("struct<at:int,mark:string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct((acc["at"] + F.length(x) - 1).alias("at"), F.array_append(acc["out"], F.struct(acc["at"].alias("at"), F.substring(x, 1, 1).alias("mark"))).alias("out"))

    return F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), start, step, lambda acc: acc["out"])


def reinserted(clean: Column, trivia: Column) -> Column:
    """The inverse: annotations back in their places."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct(x["at"].alias("at"), F.concat(acc["out"], F.substring(clean, acc["at"] + 1, x["at"] - acc["at"]), x["mark"]).alias("out"))

    return F.aggregate(trivia, start, step, lambda acc: F.concat(acc["out"], F.substring(clean, acc["at"] + 1, F.length(clean))))


def modifier(m: Column) -> Column:
    """(kind, code, fielders, base, trajectory, location, covered): kind is named, error, throw, coverage or hit."""
    kind = F.when(m.isin(*NAMED), "named").when(m.rlike("^E[1-9U]$"), "error").when(m.rlike("^TH[B123H]?$"), "throw").when(m.rlike(f"^{COVERAGE}$"), "coverage").otherwise("hit")
    part = lambda when, x: F.when(kind == when, F.nullif(x, F.lit("")))
    return F.struct(
        kind.alias("kind"), part("named", m).alias("code"), part("error", F.substring(m, 2, 1)).alias("fielders"), part("throw", F.substring(m, 3, 1)).alias("base"),
        part("hit", F.regexp_extract(m, f"^({'|'.join(TRAJECTORIES)})", 1)).alias("trajectory"), part("hit", F.regexp_extract(m, f"({PLACE})$", 1)).alias("location"),
        F.when(kind == "coverage", F.regexp_extract_all(m, F.lit("([RU][1-9]*)"), F.lit(1))).alias("covered"),
    )


def modifier_text(m: Column) -> Column:
    or_empty = lambda x: F.coalesce(x, F.lit(""))
    return (
        F.when(m["kind"] == "named", m["code"]).when(m["kind"] == "error", F.concat(F.lit("E"), m["fielders"])).when(m["kind"] == "throw", F.concat(F.lit("TH"), or_empty(m["base"])))
        .when(m["kind"] == "coverage", F.array_join(m["covered"], "")).otherwise(F.concat(or_empty(m["trajectory"]), or_empty(m["location"])))
    )


def of_groups(m: Column, letter: str) -> Column:
    """Fielders of a coverage modifier's groups: R is a relay, U isn't explained by the notation."""
    return F.array_join(F.transform(F.filter(F.coalesce(m["covered"], none_of("string")), lambda g: g.startswith(letter)), lambda g: F.substring(g, F.lit(2), F.length(g))), "")


def atoms(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("(E?[1-9U])"), F.lit(1)), lambda a: F.struct(F.right(a, F.lit(1)).alias("fielder"), a.startswith("E").alias("error")))


def parameter(p: Column) -> Column:
    """(flag, atoms, mods, error) of a parameter without its brackets. A flag has neither atoms nor modifiers."""
    flag, parts = p.isin(*FLAGS), F.split(p, "/")
    thrown = F.get(parts, F.lit(0)).rlike(f"^{ATOMS}$")
    mods = F.when(flag, none_of("string")).when(thrown, F.slice(parts, 2, F.size(parts))).otherwise(parts)
    credited = F.when(~flag & thrown, F.get(parts, F.lit(0))).otherwise("")
    return F.struct(F.when(flag, p).alias("flag"), atoms(credited).alias("atoms"), F.transform(mods, modifier).alias("mods"), credited.contains("E").alias("error"))


def parameters(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\(([^)]*)\)"), F.lit(1)), parameter)


def parameter_text(p: Column) -> Column:
    head = F.array_join(F.transform(p["atoms"], lambda a: F.concat(F.when(a["error"], "E").otherwise(""), a["fielder"])), "")
    mods = F.transform(p["mods"], modifier_text)
    whole = F.array_join(F.when(head != "", F.concat(F.array(head), mods)).otherwise(mods), "/")
    return F.concat(F.lit("("), F.coalesce(p["flag"], whole), F.lit(")"))


def basic(b: Column) -> Column:
    """(joiner, kind, code, base, fielders, groups, params, error) of a basic event with the sign that joins it to the one before."""
    x = F.regexp_replace(b, "^[+;]", "")
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(KINDS):
        kind = F.when(x.rlike(f"^(?:{pattern})$"), name).otherwise(kind)
    runs = kind.isin("POCS", "PO", "CS", "SB")
    groups = F.transform(
        F.regexp_extract_all(F.regexp_replace(x, "^K", ""), F.lit(r"([1-9U]*\([B123H]\)|[1-9U]+)"), F.lit(1)),
        lambda g: F.struct(F.regexp_extract(g, "^([1-9U]*)", 1).alias("fielders"), F.nullif(F.regexp_extract(g, r"\((.)\)", 1), F.lit("")).alias("runner")),
    )
    params = F.when(runs, parameters(x)).otherwise(parameters(F.lit("")))
    return F.struct(
        F.regexp_extract(b, "^([+;])", 1).alias("joiner"), kind.alias("kind"), F.when(kind.isin("W", "HR"), F.regexp_extract(x, "^([A-Z]+)", 1)).otherwise(kind).alias("code"),
        F.when(runs, F.nullif(F.regexp_extract(x, "^(?:POCS|PO|CS|SB)([B123H])", 1), F.lit(""))).alias("base"),
        F.when(kind.isin("DGR", "FLE", "FC", "HR", "S", "D", "T", "E"), F.regexp_replace(x, "[^1-9U]", "")).otherwise("").alias("fielders"),
        F.when(kind.isin("K", "OUT"), groups).otherwise(F.slice(groups, 1, 0)).alias("groups"), params.alias("params"), F.exists(params, lambda p: p["error"]).alias("error"),
    )


def basic_text(b: Column) -> Column:
    groups = F.array_join(F.transform(b["groups"], lambda g: F.concat(g["fielders"], F.coalesce(F.concat(F.lit("("), g["runner"], F.lit(")")), F.lit("")))), "")
    error = F.concat(F.left(b["fielders"], F.length(b["fielders"]) - 1), F.lit("E"), F.right(b["fielders"], F.lit(1)))
    body = (
        F.when(b["kind"] == "OUT", groups).when(b["kind"] == "K", F.concat(F.lit("K"), groups)).when(b["kind"] == "E", error)
        .otherwise(F.concat(b["code"], F.coalesce(b["base"], F.lit("")), b["fielders"], F.array_join(F.transform(b["params"], parameter_text), "")))
    )
    return F.concat(b["joiner"], body)


def advance(a: Column) -> Column:
    """(origin, dest, marked_out, params, is_out): an error negates a marked out unless another parameter names fielders and no error."""
    params = parameters(a)
    fielding = F.filter(params, lambda p: p["flag"].isNull())
    clean = F.exists(fielding, lambda p: (F.size(p["atoms"]) > 0) & ~p["error"])
    out = F.substring(a, 2, 1) == "X"
    return F.struct(F.substring(a, 1, 1).alias("origin"), F.substring(a, 3, 1).alias("dest"), out.alias("marked_out"), params.alias("params"), (out & ((F.size(fielding) == 0) | clean)).alias("is_out"))


def advance_text(a: Column) -> Column:
    return F.concat(a["origin"], F.when(a["marked_out"], "X").otherwise("-"), a["dest"], F.array_join(F.transform(a["params"], parameter_text), ""))


def parsed(df: DataFrame, event: str = "event") -> DataFrame:
    """df with clean, trivia, parse_ok, basics, mods and advs, from its column of events."""
    section = lambda i: F.regexp_extract("clean", EVENT, i)
    whole = df.withColumn("clean", stripped(F.col(event))).withColumn("parse_ok", F.coalesce(F.col("clean").rlike(EVENT), F.lit(False)))
    whole = whole.withColumns({"trivia": F.when(F.col(event) != F.col("clean"), annotations(F.col(event))).otherwise(none_of("struct<at:int,mark:string>"))})
    whole = whole.withColumns({"__basics": F.when(F.col("parse_ok"), section(1)), "__mods": F.when(F.col("parse_ok"), section(2)), "__advs": F.when(F.col("parse_ok"), section(3))})
    parts = whole.withColumns({
        "basics": F.transform(F.regexp_extract_all("__basics", F.lit("((?:^|[+;])[^+;]+)"), F.lit(1)), basic),
        "mods": F.transform(F.when(F.col("__mods") == "", none_of("string")).otherwise(F.filter(F.split("__mods", "/"), lambda _, i: i > 0)), modifier),
        "advs": F.transform(F.when(F.col("__advs") == "", none_of("string")).otherwise(F.split("__advs", ";")), advance),
    })
    return parts.drop("__basics", "__mods", "__advs")


def emitted() -> Column:
    """The clean event put together again from the parts of a parsed frame."""
    mods = F.array_join(F.transform("mods", lambda m: F.concat(F.lit("/"), modifier_text(m))), "")
    moves = F.when(F.size("advs") > 0, F.concat(F.lit("."), F.array_join(F.transform("advs", advance_text), ";"))).otherwise("")
    return F.concat(F.array_join(F.transform("basics", basic_text), ""), mods, moves)


def kind() -> Column:
    """Of the first basic event: it alone tells of the batter."""
    return F.get("basics", F.lit(0))["kind"]


def codes() -> Column:
    return F.transform(F.filter("mods", lambda m: m["kind"] == "named"), lambda m: m["code"])


def first_hit(field: str) -> Column:
    """trajectory: of the first hit modifier; location: the first that is named."""
    some = F.filter("mods", lambda m: (m["kind"] == "hit") & (m["location"].isNotNull() if field == "location" else F.lit(True)))
    return F.get(some, F.lit(0))[field]


def adv_flags() -> Column:
    return F.flatten(F.transform("advs", lambda a: F.transform(F.filter(a["params"], lambda p: p["flag"].isNotNull()), lambda p: p["flag"])))


def thrown() -> Column:
    """Whether a throw is noted, on the play or inside an advance's parameter."""
    throw = lambda mods: F.exists(mods, lambda m: m["kind"] == "throw")
    return throw("mods") | F.exists("advs", lambda a: F.exists(a["params"], lambda p: throw(p["mods"])))


SEQUENCE = "struct<scope:string,origin_seq:int,atoms:array<struct<fielder:string,error:boolean>>,seq_text:string,records_out:boolean>"


def fielder_atoms(fielders: Column) -> Column:
    """One atom a fielder; 99 alone is one atom, 9?, that earns nothing."""
    names = F.when(fielders == "99", F.array(F.lit("9?"))).otherwise(F.filter(F.split(fielders, ""), lambda x: x != ""))
    return F.transform(names, lambda x: F.struct(x.alias("fielder"), F.lit(False).alias("error")))


def atoms_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda a: F.concat(F.when(a["error"], "E").otherwise(""), a["fielder"])), "")


def sequence(scope: str, origin: Column, found: Column, text: Column, out: Column) -> Column:
    return F.struct(F.lit(scope).alias("scope"), origin.cast("int").alias("origin_seq"), found.alias("atoms"), text.alias("seq_text"), out.alias("records_out"))


def sequences() -> Column:
    """Every throw of a play, as it is written: (scope, origin_seq, atoms, seq_text, records_out); the basic events' first, then the advances'."""
    def of_basic(b: Column, i: Column) -> Column:
        groups = F.transform(b["groups"], lambda g: sequence("basic", i, fielder_atoms(g["fielders"]), g["fielders"], F.lit(True)))
        charged = F.struct(F.right(b["fielders"], F.lit(1)).alias("fielder"), F.lit(True).alias("error"))
        assists = F.when(b["kind"] == "E", F.left(b["fielders"], F.length(b["fielders"]) - 1)).otherwise("")
        error = F.array(sequence("basic", i, F.concat(fielder_atoms(assists), F.array(charged)), F.concat(assists, F.lit("E"), F.right(b["fielders"], F.lit(1))), F.lit(False)))
        params = F.transform(b["params"], lambda p: sequence("basic", i, p["atoms"], atoms_text(p["atoms"]), ~p["error"]))
        return F.when(b["kind"].isin("K", "OUT"), groups).when(b["kind"].isin("E", "FLE") & (b["fielders"] != ""), error).otherwise(params)

    def of_advance(a: Column, i: Column) -> Column:
        return F.transform(a["params"], lambda p: sequence("advance", i, p["atoms"], atoms_text(p["atoms"]), a["is_out"]))

    return F.filter(F.concat(F.flatten(F.transform("basics", of_basic)), F.flatten(F.transform("advs", of_advance))), lambda s: F.size(s["atoms"]) > 0)


def credited(s: Column) -> Column:
    """Atoms that earn a credit."""
    return F.filter(s["atoms"], lambda a: ~a["fielder"].isin("U", "9?"))


def clean_fielders(s: Column) -> Column:
    return F.transform(F.filter(credited(s), lambda a: ~a["error"]), lambda a: a["fielder"])


def putout(s: Column) -> Column:
    """The last fielder without an error; none where the sequence ends in an error."""
    return F.when(~F.element_at(s["atoms"], -1)["error"], F.try_element_at(clean_fielders(s), F.lit(-1)))


def assists(s: Column) -> Column:
    clean = clean_fielders(s)
    return F.when(putout(s).isNotNull(), F.slice(clean, 1, F.greatest(F.size(clean) - 1, F.lit(0)))).otherwise(clean)


def repeats_a_fielder(s: Column) -> Column:
    names = F.transform(credited(s), lambda a: a["fielder"])
    return F.size(F.array_distinct(names)) < F.size(names)


def credits(s: Column) -> Column:
    """Per atom (fielder, credit): error, none, putout or assist."""
    last = F.size(s["atoms"]) - 1

    def of(a: Column, i: Column) -> Column:
        credit = F.when(a["error"], "error").when(a["fielder"].isin("U", "9?"), "none").when((i == last) & putout(s).isNotNull(), "putout").otherwise("assist")
        return F.struct(F.when(a["fielder"].rlike("^[0-9]$"), a["fielder"].cast("int")).alias("fielder"), credit.alias("credit"))

    return F.transform(s["atoms"], of)


def shape(event: Column) -> Column:
    return F.regexp_replace(event, "[0-9]", "#")
