"""The ordered fold of a game's plays: who stands where before each play.

A play's moves, outs and runs are columns already; only the bases depend on what came before, and they empty whenever the half changes.
So the ordered part is one native aggregate per half, over the few plays of that half and four fields of state; everything else is
columns on its outcome. In a log that keeps the rules three outs end a half, so collecting it is no unbounded group; a game is never collected.

A log may also hold control rows, which change the state and are no plays: place_base and place_runner put a runner on a base, as records do where an inning begins with
one. They stand in the order of the log. Before the first play of a half that counts (one that is parsed and isn't the mark of no play) such a row is of that half; later ones
wait for the next half, and are lost if none comes. A runner who was placed remains known as such wherever he goes.

Defined cases: plays without an event have null moves and leave the state as it is. A move from an empty base moves nobody, but counts
in the play's outs and runs, and is flagged. A control row whose base is none of the three changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldlog.functions.moves import AHEAD, ENTRY, STEP, texts, told

RUNNER = "struct<id:string,placed:boolean>"
STATE = f"struct<b1:{RUNNER},b2:{RUNNER},b3:{RUNNER},outs:int>"
ENTRIES = f"array<{ENTRY}>"


def is_play(df: DataFrame) -> Column:
    return F.col("place_base").isNull() if "place_base" in df.columns else F.lit(True)


def islands(plays: DataFrame, game: Sequence[str], half: Sequence[str], order: str) -> DataFrame:
    """plays with island: the number of changes of half so far in its game. Control rows get that of the half they are for."""
    w = W.partitionBy(*game).orderBy(order)
    before, here, play = w.rowsBetween(W.unboundedPreceding, -1), F.struct(*half), is_play(plays)
    if "place_base" not in plays.columns:
        changed = F.lag(here).over(w).isNull() | ~F.lag(here).over(w).eqNullSafe(here)
        return plays.withColumn("changed", changed.cast("int")).withColumn("island", F.sum("changed").over(w)).drop("changed")
    last = F.last(F.when(play, here), ignorenulls=True).over(before)
    changed = (play & (last.isNull() | ~last.eqNullSafe(here))).cast("int")
    df = plays.withColumn("changed", changed).withColumn("island", F.sum("changed").over(w))
    counts = play & F.col("parse_ok") & ~F.col("no_play")
    begun = F.max(F.when(counts, F.col("island"))).over(before).eqNullSafe(F.col("island")) | (F.col("island") == 0)
    return df.withColumn("island", F.when(~play & begun, F.col("island") + 1).otherwise(F.col("island"))).drop("changed")


def retried(outs_before: Column, play: dict[str, Column] | Column) -> Column:
    """Whether a bare strikeout left the batter alive: with him out there would be more than three outs, and without him there aren't."""
    total = outs_before + play["outs"]
    return play["may_retry"] & (total > 3) & (total - 1 <= 3)


def bases_after(runner: dict[str, Column], move: dict[str, Column]) -> dict[str, Column]:
    """Who is on each base after a play: who was sent there, else who stayed."""
    def on(base: str) -> Column:
        out = F.when(move["b"] == base, runner["b"])
        for p in "123":
            sent = move[p].isNull() | (move[p] == base) if p == base else move[p] == base
            out = out.when(sent & runner[p].isNotNull(), runner[p])
        return out

    return {p: on(p) for p in "123"}


def after(state: Column, play: Column) -> Column:
    alive = retried(state["outs"], play)
    move = {p: play[f"move_{p}"] for p in "b123"} | {"b": F.when(alive, F.lit("1")).otherwise(play["move_b"])}
    batter = F.when(play["batter"].isNotNull(), F.struct(play["batter"].alias("id"), F.lit(False).alias("placed")))
    on = bases_after({"b": batter, "1": state["b1"], "2": state["b2"], "3": state["b3"]}, move)
    return F.struct(on["1"].alias("b1"), on["2"].alias("b2"), on["3"].alias("b3"), (state["outs"] + play["outs"] - alive.cast("int")).alias("outs"))


def placed(state: Column, row: Column) -> Column:
    """The state with the runner of a control row on his base."""
    runner = F.struct(row["place_runner"].alias("id"), F.lit(True).alias("placed"))
    return F.struct(*[F.when(row["place_base"] == p, runner).otherwise(state[f"b{p}"]).alias(f"b{p}") for p in "123"], state["outs"].alias("outs"))


def step(acc: Column, play: Column, control: bool) -> Column:
    now = after(acc["now"], play)
    if control:
        now = F.when(play["place_base"].isNotNull(), placed(acc["now"], play)).otherwise(now)
    return F.struct(now.alias("now"), F.array_append(acc["before"], acc["now"]).alias("before"))


def replayed(plays: DataFrame, game: Sequence[str] = ("game_key",), half: Sequence[str] = ("inning", "half"), order: str = "seq", said: DataFrame | None = None) -> DataFrame:
    """moved plays (with batter) and, for each, the state before it (b1, b2, b3: runners; outs_before; placed_before: which bases hold a placed runner, like bases_before) and all
    that `resolved` adds. Control rows (see above) act and are left out. said: what the plays' texts say (see `moves.texts`), joined after the fold; then plays need only what the fold reads (`moves.STEP`)."""
    known = islands(plays, game, half, order)
    keys, control = [*game, "island"], [c for c in ("place_base", "place_runner") if c in plays.columns]
    row = F.struct(F.col(order).alias("at"), "batter", *control, *[f"move_{p}" for p in "b123"], "outs", "may_retry", F.struct(*[c for c in known.columns if c not in keys]).alias("play"))
    in_order = lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)
    ordered = known.groupBy(*keys).agg(F.array_sort(F.collect_list(row), in_order).alias("rows"))
    start = F.struct(F.from_json(F.lit('{"outs": 0}'), STATE).alias("now"), F.array().cast(f"array<{STATE}>").alias("before"))
    states = F.aggregate("rows", start, lambda acc, play: step(acc, play, bool(control)), lambda acc: acc["before"])
    both = ordered.select(*keys, F.explode(F.arrays_zip(F.col("rows.play").alias("play"), states.alias("state"))).alias("x"))
    if control:
        both = both.where("x.play.place_base IS NULL")
    on = [F.col(f"x.state.b{p}.id").alias(f"b{p}") for p in "123"]
    marks = F.concat(*[F.coalesce(F.col(f"x.state.b{p}.placed"), F.lit(False)).cast("int").cast("string") for p in "123"])
    found = both.select(*keys, "x.play.*", *on, F.col("x.state.outs").alias("outs_before"), marks.alias("placed_before")).drop(*control)
    return resolved(found if said is None else told(found, said))


def replayed_log(log: DataFrame, game: Sequence[str] = ("game_key",), half: Sequence[str] = ("inning", "half"), order: str = "seq") -> DataFrame:
    """`replayed` of plays with their events. Parts of events are many times as large as a play, so they are joined to the folded plays and don't travel through the fold."""
    said = texts(log)
    return replayed(told(log, said.select("text", *STEP)), game, half, order, said)


#: Findings about a play, weakest first; the strongest is its status.
FINDINGS = {"reached_against_rules": "data_contradicts_rules", "runner_retired_and_placed": "state_ambiguous", "batter_undetermined": "state_ambiguous", "runs_without_runners": "state_inconsistent", "more_than_three_outs": "state_inconsistent"}


def resolved(df: DataFrame) -> DataFrame:
    """What follows from the state before a moved play: bases_before, bases_after, outs (recorded), outs_after, retried, batter_live, batter_ran, forced (bases whose
    runner must leave for a batter who runs), force_outs (origins), resolved (movements, with is_force, certainty, runner and was_placed), has_placed_runner, flags and parse_status.

    certainty is n/a for who is safe; derived where the runner couldn't be forced at all; else as sure as it is that the batter ran, and
    ambiguous where that isn't known. Plays that aren't parsed have no state."""
    held = {p: F.col(f"b{p}").isNotNull() for p in "123"}
    if "placed_before" not in df.columns:
        df = df.withColumn("placed_before", F.lit("000"))
    df = df.withColumn("retried", retried(F.col("outs_before"), {"outs": F.col("outs"), "may_retry": F.col("may_retry")}))
    df = df.withColumns({
        "outs": F.col("outs") - F.col("retried").cast("int"), "outs_after": F.col("outs_before") + F.col("outs") - F.col("retried").cast("int"),
        "move_b": F.when(F.col("retried"), "1").otherwise(F.col("move_b")), "became_runner": F.col("became_runner") | F.col("retried"),
        "batter_certainty": F.when(F.col("retried"), "derived").otherwise(F.col("batter_certainty")), "batter_live": F.col("retried") | F.coalesce(F.col("batter_dest") != "X", F.lit(False)),
        "bases_before": F.concat(*[held[p].cast("int").cast("string") for p in "123"]),
        "could_be_forced": F.array_compact(F.array(F.lit("1"), F.when(held["1"], "2"), F.when(held["1"] & held["2"], "3"))),
    })
    on = bases_after({"b": F.col("batter"), "1": F.col("b1"), "2": F.col("b2"), "3": F.col("b3")}, {p: F.col(f"move_{p}") for p in "b123"})

    def of(e: Column) -> Column:
        at_first = (e["origin"] == "B") & ~e["explicit"]
        force = e["is_out"] & (at_first | (F.col("became_runner") & F.array_contains("could_be_forced", e["origin"])))
        ahead = F.when(e["origin"] == "1", AHEAD["1"]).when(e["origin"] == "2", AHEAD["2"]).otherwise(AHEAD["3"])
        doubt = F.when(F.col("batter_certainty") == "unresolved", "ambiguous").otherwise(F.col("batter_certainty"))
        certainty = F.when(~e["is_out"], "n/a").when(at_first, F.col("batter_certainty")).when(F.array_contains("could_be_forced", e["origin"]), doubt).otherwise("derived")
        runner = F.when(e["origin"] == "B", F.col("batter")).when(e["origin"] == "1", F.col("b1")).when(e["origin"] == "2", F.col("b2")).when(e["origin"] == "3", F.col("b3"))
        # Casting a B to a number would raise, and catch, an error for each batter.
        was_placed = F.coalesce(F.when(e["origin"] == "1", F.substring("placed_before", 1, 1)).when(e["origin"] == "2", F.substring("placed_before", 2, 1)).when(e["origin"] == "3", F.substring("placed_before", 3, 1)) == "1", F.lit(False))
        dest = F.coalesce(e["dest"], F.when(force, ahead).otherwise(e["origin"]))
        return F.struct(e["origin"].alias("origin"), dest.alias("dest"), e["is_out"].alias("is_out"), e["explicit"].alias("explicit"), e["marked_out"].alias("marked_out"), e["scored"].alias("scored"), force.alias("is_force"), certainty.alias("certainty"), runner.alias("runner"), e["raw"].alias("raw"), was_placed.alias("was_placed"))

    alive = F.array(F.struct(F.lit("B").alias("origin"), F.lit("1").alias("dest"), F.lit(False).alias("is_out"), F.lit(False).alias("explicit"), F.lit(False).alias("marked_out"), F.lit(False).alias("scored"), F.lit(True).alias("placed"), F.lit("B-1").alias("raw")))
    whole = F.when(F.col("retried"), F.concat("entries", alive.cast(ENTRIES))).otherwise(F.col("entries"))
    df = df.withColumns({"resolved": F.transform(whole, of), "bases_after": F.concat(*[on[p].isNotNull().cast("int").cast("string") for p in "123"])})
    df = df.withColumns({
        "batter_ran": F.when(F.col("parse_ok"), F.when(F.col("no_play"), "no").when(F.col("batter_certainty") == "unresolved", "unknown").when(F.col("became_runner"), "yes").otherwise("no")),
        "forced": F.array_join(F.filter("could_be_forced", lambda p: F.when(p == "1", held["1"]).when(p == "2", held["2"]).otherwise(held["3"])), ""),
        "force_outs": F.array_join(F.transform(F.filter("resolved", lambda a: a["is_force"]), lambda a: a["origin"]), ""),
    })
    strikeout = F.exists("basics", lambda b: b["kind"] == "K")
    tests = {
        "reached_against_rules": strikeout & F.col("batter_live") & held["1"] & (F.col("outs_before") != 2),
        "runner_retired_and_placed": F.exists("entries", lambda e: e["explicit"] & ~e["is_out"] & ~e["scored"] & ~e["placed"]),
        "batter_undetermined": F.col("batter_dest").isNull() & F.exists("basics", lambda b: b["kind"].isin("S", "D", "T", "K", "OUT", "W")),
        "runs_without_runners": F.col("runs") > 1 + F.length(F.regexp_replace("bases_before", "0", "")),
        "more_than_three_outs": F.col("outs_after") > 3,
    }
    # By what is held, not by the resolved runners: queries of flags and statuses alone don't resolve movements.
    empty = F.exists("entries", lambda e: (e["origin"] != "B") & ~(((e["origin"] == "1") & held["1"]) | ((e["origin"] == "2") & held["2"]) | ((e["origin"] == "3") & held["3"])))
    flags = F.array_compact(F.array(F.when(empty, "advance_from_empty_base"), *[F.when(test, name) for name, test in tests.items()]))
    df = df.withColumn("flags", F.when(F.col("parse_ok"), flags).otherwise(F.array().cast("array<string>")))
    status = F.when(~F.col("parse_ok"), "unparsed")
    for name in reversed(FINDINGS):
        status = status.when(F.array_contains("flags", name), FINDINGS[name])
    unknown = [c for c in ("b1", "b2", "b3", "outs_before", "outs_after", "bases_before", "bases_after", "outs", "runs", "forced", "force_outs", "placed_before")]
    df = df.withColumn("parse_status", status.otherwise("ok"))
    if "has_placed_runner" not in df.columns:
        df = df.withColumn("has_placed_runner", F.col("placed_before").contains("1"))
    return df.withColumns({c: F.when(F.col("parse_ok"), F.col(c)) for c in unknown}).drop("could_be_forced", "entries")


def contaminated(df: DataFrame, game: Sequence[str] = ("game_key",)) -> DataFrame:
    """Plays of a half after one that isn't parsed have an uncertain state: their status says so, unless it says something worse."""
    before = W.partitionBy(*game, "island").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    lost = F.coalesce(F.max((~F.col("parse_ok")).cast("int")).over(before) == 1, F.lit(False))
    return df.withColumn("parse_status", F.when((F.col("parse_status") == "ok") & lost, "state_untrusted").otherwise(F.col("parse_status")))


def short_halves(folded: DataFrame, game: Sequence[str] = ("game_key",)) -> DataFrame:
    """Halves that end without three outs, apart from a game's last: game, island, outs at the close."""
    ends = folded.groupBy(*game, "island").agg(F.max_by("outs_after", F.when(F.col("outs_after").isNotNull(), F.col("seq"))).alias("outs_at_close"))
    last = W.partitionBy(*game).orderBy("island")
    return ends.withColumn("next", F.lead("island").over(last)).where("next IS NOT NULL AND outs_at_close <> 3").drop("next")


def scored(folded: DataFrame, game: Sequence[str] = ("game_key",), side: str = "half", order: str = "seq") -> DataFrame:
    """folded with own_before and other_before (runs of the side at bat, and of the other, before the play), go_ahead, final_play (the last parsed play of the
    game) and walk_off (a go-ahead run on it)."""
    w = W.partitionBy(*game).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    total = F.coalesce(F.sum("runs").over(w), F.lit(0)).cast("long")
    own = F.coalesce(F.sum("runs").over(W.partitionBy(*game, side).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    out = folded.withColumn("own_before", own).withColumn("other_before", total - F.col("own_before"))
    runs = F.coalesce(F.col("runs"), F.lit(0))
    out = out.withColumn("go_ahead", (F.col("own_before") <= F.col("other_before")) & (F.col("own_before") + runs > F.col("other_before")))
    last = F.max(F.when(F.col("parse_ok"), F.col(order))).over(W.partitionBy(*game))
    out = out.withColumn("final_play", F.col("parse_ok") & (F.col(order) == last))
    return out.withColumn("walk_off", F.col("final_play") & F.col("go_ahead"))
