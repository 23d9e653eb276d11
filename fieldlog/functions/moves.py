"""Where an event sends the batter and the runners, as columns of a parsed frame. Outs and runs of a play follow from its event alone.

An entry is a movement: (origin, dest, is_out, explicit, marked_out, scored, placed, raw). `placed` says that it puts its runner on a base. dest is null
for a runner whom the basic event retires by a designator: where he is out follows from the bases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .events import RUNNING, advance_text, codes, kind, parsed

PLACES = ("b", "1", "2", "3")
#: The base ahead; where each kind of first basic event leaves the batter (X: out); what tells that the ball was on the ground, or caught.
AHEAD = {"1": "2", "2": "3", "3": "H"}
BATTER = {"S": "1", "W": "1", "HP": "1", "E": "1", "FC": "1", "C": "1", "D": "2", "DGR": "2", "T": "3", "HR": "H", "K": "X"}
RAN_ON, CAUGHT_ON = ("G", "BG"), ("F", "P", "L", "BP", "BL")
RAN_BY, CAUGHT_BY = ("FO", "GDP", "GTP", "BGDP", "SH"), ("SF", "FDP", "LDP", "LTP", "BPDP", "IF")
ENTRY = "struct<origin:string,dest:string,is_out:boolean,explicit:boolean,marked_out:boolean,scored:boolean,placed:boolean,raw:string>"


def entry(origin: Column, dest: Column, is_out: Column, explicit: bool, marked_out: Column, scored: Column, placed: Column, raw: Column) -> Column:
    return F.struct(origin.alias("origin"), dest.alias("dest"), is_out.alias("is_out"), F.lit(explicit).alias("explicit"), marked_out.alias("marked_out"), scored.alias("scored"), placed.alias("placed"), raw.alias("raw"))


def group_of_batter() -> Column:
    """The first group of an out that retires the batter: by the designator B, or as the last without one."""
    def of(b: Column) -> Column:
        named = F.get(F.filter(b["groups"], lambda g: g["runner"].eqNullSafe(F.lit("B"))), F.lit(0))
        last = F.try_element_at(b["groups"], F.lit(-1))
        return F.coalesce(named, F.when(last["runner"].isNull(), last))

    return F.get(F.filter(F.transform(F.filter("basics", lambda b: b["kind"] == "OUT"), of), lambda g: g.isNotNull()), F.lit(0))


def implied_dest() -> Column:
    """Of the batter, by the first basic event: a base, X, or null where the play leaves him at the plate."""
    first = F.get("basics", F.lit(0))
    last = F.try_element_at(first["groups"], F.lit(-1))
    retired = F.exists(first["groups"], lambda g: g["runner"].eqNullSafe(F.lit("B"))) | last["runner"].isNull()
    out = F.when(kind() == "OUT", F.when(retired, "X").otherwise("1"))
    for name, dest in BATTER.items():
        out = out.when(kind() == name, dest)
    return out


def ran() -> Column:
    """(became, certainty): whether the batter left the plate, and how that is known: derived, likely or unresolved.

    Reaching, striking out, the ball's way and some codes settle it. Else the fielding does: only the pitcher, the catcher and the first baseman can
    retire a batter at first without a throw, so anyone else's lone putout was a catch; a throw tells that he ran."""
    def told(became: bool, certainty: str = "derived") -> Column:
        return F.struct(F.lit(became).alias("became"), F.lit(certainty).alias("certainty"))

    some = lambda names: F.arrays_overlap("codes", F.array(*map(F.lit, names)))
    group = F.col("batter_group")["fielders"]
    thrown_else = F.exists("basics", lambda b: (b["kind"] == "OUT") & (F.size(F.filter(b["groups"], lambda g: (F.length(g["fielders"]) > 1) & ~g.eqNullSafe(F.col("batter_group")))) > 0))
    return (
        F.when(F.col("batter_dest").isNull(), told(False)).when(F.col("batter_dest") != "X", told(True)).when(F.exists("basics", lambda b: b["kind"] == "K"), told(False))
        .when(F.col("traj_any").isin(*CAUGHT_ON), told(False)).when(F.col("traj_any").isin(*RAN_ON), told(True)).when(some(RAN_BY), told(True)).when(some(CAUGHT_BY), told(False))
        .when(group.isNull(), told(False)).when(group.contains("99"), told(False, "unresolved")).when(F.length(group) > 1, told(True, "likely"))
        .when(~group.isin("1", "2", "3"), told(False)).when(thrown_else, told(True, "likely")).otherwise(told(False, "unresolved"))
    )


def running_entries() -> Column:
    """What steals, caught steals and pickoffs among the basic events imply."""
    def of(b: Column) -> Column:
        origin = F.when(b["kind"] == "PO", F.when(b["base"].isin("1", "2", "3"), b["base"])).when(b["base"] == "2", "1").when(b["base"] == "3", "2").when(b["base"] == "H", "3")
        out = (b["kind"] != "SB") & ~b["error"]
        home = ~out & (b["base"] == "H")
        return entry(origin, b["base"], out, False, out, home, ~out & ~home, F.concat(origin, F.when(out, "X").otherwise("-"), b["base"]))

    found = F.transform(F.filter("basics", lambda b: b["kind"].isin("SB", "CS", "POCS", "PO")), of)
    return F.filter(found, lambda e: e["origin"].isNotNull())


def first_of_origin(entries: Column) -> Column:
    """Entries whose origin none before them has."""
    return F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, 1, i), lambda x: x["origin"] == e["origin"]))


def moved(df: DataFrame) -> DataFrame:
    """A parsed frame with codes, batter_dest, became_runner, batter_certainty, entries, outs, runs, may_retry and move_b, move_1, move_2, move_3
    (where each place's runner goes: a base, H, X, or null)."""
    first_b = F.get(F.filter("advs", lambda a: a["origin"] == "B"), F.lit(0))
    df = df.withColumns({
        "codes": codes(), "batter_group": group_of_batter(), "traj_any": F.get(F.filter(F.transform("mods", lambda m: m["trajectory"]), lambda t: t.isNotNull()), F.lit(0)),
        "b_advance": first_b, "no_play": F.coalesce((F.size("basics") == 1) & (kind() == "NP"), F.lit(False)), "running": running_entries(),
    })
    df = df.withColumn("batter_dest", F.when(F.col("b_advance").isNotNull(), F.when(F.col("b_advance")["is_out"], "X").otherwise(F.col("b_advance")["dest"])).otherwise(implied_dest()))
    df = df.withColumn("ran", ran())

    retired = F.transform(F.filter("running", lambda e: e["is_out"]), lambda e: e["origin"])

    def explicit(a: Column) -> Column:
        conflict = F.array_contains(retired, a["origin"]) & ~a["is_out"]
        home = ~a["is_out"] & (a["dest"] == "H") & ~conflict
        return entry(a["origin"], a["dest"], a["is_out"], True, a["marked_out"], home, ~a["is_out"] & (a["dest"] != "H") & ~conflict, advance_text(a))

    origins = F.transform("advs", lambda a: a["origin"])
    out_origins = F.transform(F.filter("advs", lambda a: a["is_out"]), lambda a: a["origin"])
    # An advance has counted a runner already, or places him; an event's out stands against an advance that says safe.
    implied = F.filter(first_of_origin(F.col("running")), lambda e: ~F.array_contains(origins, e["origin"]) | (e["is_out"] & ~F.array_contains(out_origins, e["origin"])))
    df = df.withColumns({"told": F.transform("advs", explicit), "implied": implied})
    named = F.filter(F.flatten(F.transform("basics", lambda b: F.transform(b["groups"], lambda g: g["runner"]))), lambda r: r.isin("1", "2", "3"))
    before = F.transform(F.concat("told", "implied"), lambda e: e["origin"])
    nothing = F.lit(None).cast("string")
    designated = F.transform(F.array_except(F.array_distinct(named), before), lambda r: entry(r, nothing, F.lit(True), False, F.lit(True), F.lit(False), F.lit(False), F.concat(F.lit("("), r, F.lit(")"))))
    dest = F.col("batter_dest")
    out_at_first = F.array(entry(F.lit("B"), F.lit("1"), F.lit(True), False, F.lit(True), F.lit(False), F.lit(False), F.lit("(B)")))
    reached = F.array(entry(F.lit("B"), dest, F.lit(False), False, F.lit(False), dest == "H", dest != "H", F.concat(F.lit("B-"), dest)))
    batter = F.when(F.col("b_advance").isNotNull() | dest.isNull(), F.array().cast(f"array<{ENTRY}>")).when(dest != "X", reached).when(F.col("ran")["became"], out_at_first).otherwise(F.array().cast(f"array<{ENTRY}>"))
    df = df.withColumn("entries", F.when(F.col("no_play"), F.array().cast(f"array<{ENTRY}>")).otherwise(F.concat("told", "implied", designated, batter).cast(f"array<{ENTRY}>")))

    at_plate = (dest == "X") & F.col("b_advance").isNull() & ~F.col("ran")["became"]
    df = df.withColumns({
        "became_runner": F.coalesce(F.col("ran")["became"], F.lit(False)), "batter_certainty": F.col("ran")["certainty"],
        "outs": F.coalesce(F.size(F.filter("entries", lambda e: e["is_out"])) + F.coalesce(at_plate, F.lit(False)).cast("int"), F.lit(0)),
        "runs": F.coalesce(F.size(F.filter("entries", lambda e: e["scored"])), F.lit(0)),
        # A bare strikeout says nothing about the batter; if the outs don't add up, he was alive.
        "may_retry": F.coalesce((kind() == "K") & (F.size(F.get("basics", F.lit(0))["groups"]) == 0) & F.col("b_advance").isNull() & (dest == "X"), F.lit(False)),
    })

    def goes(origin: str) -> Column:
        own = F.filter("entries", lambda e: e["origin"] == origin)
        safe = F.try_element_at(F.filter(own, lambda e: e["placed"] | e["scored"]), F.lit(-1))["dest"]
        return F.when(F.exists(own, lambda e: e["is_out"]), "X").otherwise(safe)

    df = df.withColumns({f"move_{p}": goes(p.upper()) for p in PLACES})
    df = df.withColumn("move_b", F.when(F.coalesce(at_plate, F.lit(False)) & ~F.col("no_play"), "X").otherwise(F.col("move_b")))
    return df.drop("batter_group", "traj_any", "b_advance", "ran", "running", "told", "implied")


#: What the ordered fold reads of what a text says.
STEP = ("parse_ok", "no_play", "outs", "may_retry", *[f"move_{p}" for p in PLACES])


def texts(df: DataFrame) -> DataFrame:
    """`moved` over `parsed` of the different events of df, as text: both follow from a text alone. Texts repeat: a log has far fewer than plays."""
    return moved(parsed(df.select(F.col("event").alias("text")).distinct(), "text"))


def told(df: DataFrame, texts: DataFrame) -> DataFrame:
    """df (event, ...) with what texts say of its events. The right side's size shows at run time, so Spark decides then whether to send it to all tasks."""
    new = [c for c in texts.columns if c != "text"]
    return df.drop(*new).join(texts, F.col("event").eqNullSafe(F.col("text")), "left").drop("text")


def read(df: DataFrame) -> DataFrame:
    """df (event, ...) with `moved` over `parsed` of its events, each different text read once."""
    return told(df, texts(df))


__all__ = ["AHEAD", "PLACES", "RUNNING", "STEP", "moved", "read", "texts", "told"]
