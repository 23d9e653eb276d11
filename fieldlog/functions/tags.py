"""Tag rules over the facts of a play: one projection evaluates all, the closure over implications is made once on the driver."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import events as E


@dataclass(frozen=True)
class Tag:
    name: str
    category: str
    rule: str
    implies: tuple[str, ...] = ()
    prior_state: bool = False
    uncertain: bool = False
    force: bool = False
    alias: str | None = None
    curated_only: bool = False


def has(*codes: str) -> str:
    return f"arrays_overlap(codes, array({', '.join(repr(c) for c in codes)}))"


def ran(kind: str, error: bool | None = None) -> str:
    return f"exists(basics, b -> b.kind = '{kind}'{'' if error is None else ' AND b.error' if error else ' AND NOT b.error'})"


def out(force: bool, at: str | None = None) -> str:
    return f"exists(resolved, a -> a.is_out AND {'' if force else 'NOT '}a.is_force{f' AND a.dest = {at!r}' if at else ''})"


MISCUE = "size(basics[0].groups) > 0 OR exists(trailing, b -> b.kind IN ('E', 'WP', 'PB')) OR batter_live OR arrays_overlap(adv_flags, array('WP', 'PB'))"
BATTING = [
    Tag("Single", "batting", "kind = 'S'"),
    Tag("Double", "batting", "kind = 'D'"),
    Tag("Triple", "batting", "kind = 'T'"),
    Tag("GroundRuleDouble", "batting", "kind = 'DGR'", ("Double",)),
    Tag("HomeRun", "batting", "kind = 'HR'"),
    Tag("InsideTheParkHomeRun", "batting", f"(kind = 'HR' AND basics[0].fielders <> '') OR {has('IPHR')}", ("HomeRun",)),
    Tag("Walk", "batting", "kind = 'W'"),
    Tag("IntentionalWalk", "batting", "kind = 'W' AND basics[0].code IN ('I', 'IW')", ("Walk",)),
    Tag("HitByPitch", "batting", "kind = 'HP'"),
    Tag("Strikeout", "batting", "kind = 'K'"),
    Tag("ReachedOnError", "batting", "kind = 'E'"),
    Tag("FieldersChoice", "batting", "kind = 'FC'"),
    Tag("SacrificeFly", "batting", has("SF")),
    Tag("SacrificeHit", "batting", has("SH")),
    Tag("GroundOut", "batting", "kind = 'OUT' AND traj IN ('G', 'BG')"),
    Tag("FlyOut", "batting", "kind = 'OUT' AND traj = 'F'"),
    Tag("LineOut", "batting", "kind = 'OUT' AND traj IN ('L', 'BL')"),
    Tag("PopOut", "batting", "kind = 'OUT' AND traj IN ('P', 'BP')"),
    Tag("Bunt", "batting", "traj IN ('BG', 'BP', 'BL', 'B')"),
    Tag("InfieldFly", "batting", has("IF")),
]
STRIKEOUT = [
    Tag("UncaughtThirdStrike", "strikeout", f"kind = 'K' AND ({MISCUE})"),
    Tag("BatterReachedOnK", "strikeout", "kind = 'K' AND batter_live", ("UncaughtThirdStrike",)),
    Tag("DroppedThirdStrike", "strikeout", f"kind = 'K' AND ({MISCUE})", alias="UncaughtThirdStrike"),
    Tag("StrikeoutDoublePlay", "strikeout", f"kind = 'K' AND NOT {has('NDP')} AND ({has('DP')} OR outs >= 2)"),
    Tag("CalledThirdStrike", "strikeout", has("C")),
    Tag("StrikeoutThrowOut", "strikeout", "kind = 'K' AND exists(resolved, a -> a.is_out AND a.explicit AND a.origin <> 'B')"),
]
RUNNING = [
    Tag("StolenBase", "baserunning", ran("SB")),
    Tag("DoubleSteal", "baserunning", "size(filter(basics, b -> b.kind = 'SB')) >= 2", ("StolenBase",)),
    Tag("CaughtStealing", "baserunning", ran("CS", False)),
    Tag("CaughtStealingSafeOnError", "baserunning", ran("CS", True)),
    Tag("Pickoff", "baserunning", ran("PO", False)),
    Tag("PickoffError", "baserunning", ran("PO", True)),
    Tag("PickoffCaughtStealing", "baserunning", ran("POCS")),
    Tag("DefensiveIndifference", "baserunning", ran("DI")),
    Tag("WildPitch", "baserunning", f"{ran('WP')} OR array_contains(adv_flags, 'WP')"),
    Tag("PassedBall", "baserunning", f"{ran('PB')} OR array_contains(adv_flags, 'PB')"),
    Tag("Balk", "baserunning", ran("BK")),
    Tag("OtherAdvance", "baserunning", ran("OA")),
    Tag("RunnerPassedRunner", "baserunning", has("PASS")),
    Tag("RunnerHitByBattedBall", "baserunning", has("BR")),
]
OUTS = [
    Tag("ForceOut", "outs", out(True), force=True),
    *[Tag(f"ForceOutAt{name}", "outs", out(True, at), ("ForceOut",), force=True) for name, at in (("Home", "H"), ("Third", "3"), ("Second", "2"), ("First", "1"))],
    Tag("TagOut", "outs", out(False), force=True),
    Tag("AppealOut", "outs", has("AP")),
    Tag("DoublePlay", "outs", f"NOT {has('NDP')} AND (outs >= 2 OR {has('DP', 'GDP', 'LDP', 'FDP', 'BGDP', 'BPDP')})"),
    Tag("TriplePlay", "outs", f"outs >= 3 OR {has('TP', 'GTP', 'LTP')}", ("DoublePlay",)),
    Tag("UnassistedOut", "outs", "exists(seqs, s -> s.records_out AND s.putout IS NOT NULL AND s.assists = 0)"),
    Tag("Rundown", "outs", "exists(seqs, s -> s.credited >= 3 AND s.repeats)"),
    Tag("RelayThrow", "outs", "exists(relays, r -> r <> '')"),
]
SPECIAL = [
    *[Tag(f"{who}Interference", "special", f"kind = 'C' AND exists(mods, m -> m.kind = 'error' AND m.fielders = '{n}')") for who, n in (("Catcher", 2), ("Pitcher", 1), ("FirstBase", 3))],
    *[Tag(n, "special", has(c)) for n, c in (("BatterInterference", "BINT"), ("RunnerInterference", "RINT"), ("UmpireInterference", "UINT"), ("FanInterference", "FINT"), ("Obstruction", "OBS"))],
    Tag("BattingOutOfTurn", "special", f"{has('BOOT')} OR after_ladj"),
    *[Tag(n, "special", has(c)) for n, c in (("CourtesyRunner", "COUR"), ("CourtesyBatter", "COUB"), ("CourtesyFielder", "COUF"))],
    Tag("FoulFlyError", "special", "kind = 'FLE'"),
    Tag("ErrorOnThrow", "special", "exists(seqs, s -> s.has_error) AND throw"),
    Tag("UnknownPlay", "special", "exists(basics, b -> b.kind = 'OUT' AND exists(b.groups, g -> contains(g.fielders, '99')))", uncertain=True),
    Tag("ReplayReviewed", "special", has("UREV", "MREV")),
    Tag("ReplayOverturned", "special", f"{has('UREV', 'MREV')} AND replay_reversed", ("ReplayReviewed",)),
    Tag("PlacedRunner", "special", "has_placed_runner"),
    Tag("HiddenBallTrick", "special", "false", curated_only=True),
]
#: Of the state before a play alone.
STATE = [
    Tag("BasesLoaded", "context", "bases_before = '111'", prior_state=True),
    Tag("BasesEmpty", "context", "bases_before = '000'", prior_state=True),
    Tag("RunnerOnThird", "context", "substr(bases_before, 3, 1) = '1'", prior_state=True),
    Tag("ScoringPosition", "context", "substr(bases_before, 2, 1) = '1' OR substr(bases_before, 3, 1) = '1'", prior_state=True),
    *[Tag(n, "context", f"outs_before = {k}", prior_state=True) for k, n in enumerate(("NoOuts", "OneOut", "TwoOuts"))],
]
CONTEXT = STATE + [
    Tag("InningEnding", "context", "outs_after >= 3"),
    Tag("GoAheadRun", "context", "go_ahead"),
    Tag("WalkOff", "context", "walk_off"),
    Tag("FinalPlay", "context", "final_play", prior_state=True),
    Tag("ExtraInnings", "context", "inning > scheduled_innings", prior_state=True),
    Tag("LateAndClose", "context", "inning >= 7 AND own_before - other_before <= 1 AND (own_before >= other_before OR other_before - own_before <= 1 + length(replace(bases_before, '0', '')))", prior_state=True),
]
ALL = BATTING + STRIKEOUT + RUNNING + OUTS + SPECIAL + CONTEXT
#: What the context rules read, where a frame doesn't have it: a first play of a scoreless game.
DEFAULTS = {"inning": 1, "scheduled_innings": 9, "own_before": 0, "other_before": 0, "go_ahead": False, "walk_off": False, "final_play": False, "has_placed_runner": False, "after_ladj": False, "replay_reversed": False}


def facts(df: DataFrame) -> DataFrame:
    """A resolved frame with what the rules read: kind, trailing, traj, adv_flags, seqs, throw, relays, doubtful, and the context."""
    def seq(s: Column) -> Column:
        of_scope = F.struct(s["scope"].alias("scope"), s["origin_seq"].alias("origin_seq"), s["seq_text"].alias("seq_text"), s["records_out"].alias("records_out"), E.credits(s).alias("credits"))
        told = {"putout": E.putout(s), "assists": F.size(E.assists(s)), "credited": F.size(E.credited(s)), "repeats": E.repeats_a_fielder(s), "has_error": F.exists(s["atoms"], lambda a: a["error"])}
        return F.struct(*[of_scope[f].alias(f) for f in ("scope", "origin_seq", "seq_text", "records_out", "credits")], *[c.alias(n) for n, c in told.items()])

    df = df.withColumns({c: F.lit(v) for c, v in DEFAULTS.items() if c not in df.columns})
    df = df.withColumns({"kind": E.kind(), "trailing": F.filter("basics", lambda _, i: i > 0), "traj": F.get(F.filter("mods", lambda m: m["kind"] == "hit"), F.lit(0))["trajectory"], "adv_flags": E.adv_flags(), "seqs": E.sequences(), "throw": E.thrown(), "relays": F.transform("mods", lambda m: E.of_groups(m, "R"))})
    df = df.withColumn("seqs", F.transform("seqs", seq))
    unknown = next(t for t in ALL if t.name == "UnknownPlay").rule
    return df.withColumn("doubtful", F.exists("trivia", lambda t: t["mark"] == "#") | F.expr(unknown))


def confidence(t: Tag) -> Column:
    """uncertain: always; where the play is marked as doubtful, unless the tag is about what came before; or where no out that supports the tag is sure."""
    if t.uncertain:
        return F.lit("uncertain")
    sure = F.lit("certain")
    if t.force:
        supporting = f"filter(resolved, {t.rule[t.rule.index('a -> '):-1]})"
        sure = F.when(F.expr(f"size({supporting}) > 0 AND forall({supporting}, a -> a.certainty = 'ambiguous')"), "uncertain").otherwise("certain")
    return sure if t.prior_state else F.when(F.col("doubtful"), "uncertain").otherwise(sure)


def closed(tags: list[Tag]) -> dict[str, str]:
    """Each tag's rule, or any rule of a tag that implies it."""
    rules = {t.name: [f"({t.rule})"] for t in tags}
    above = {t.name: set(t.implies) for t in tags}
    for _ in tags:
        for name in above:
            above[name] |= {y for x in above[name] for y in above.get(x, ())}
    for t in tags:
        for name in above[t.name]:
            rules[name].append(f"({t.rule})")
    return {name: " OR ".join(r) for name, r in rules.items()}


def tag_array(tags: list[Tag]) -> Column:
    """The names of the tags that hold, in order, from one projection."""
    return F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in sorted(closed(tags).items())]))


def tag_rows(tags: list[Tag]) -> Column:
    """Likewise (tag, confidence)."""
    by_name, rules = {t.name: t for t in tags}, closed(tags)
    return F.array_compact(F.array(*[F.when(F.expr(rules[n]), F.struct(F.lit(n).alias("tag"), confidence(by_name[n]).alias("confidence"))) for n in sorted(rules)]))


def tag_table(spark, tags: list[Tag]) -> DataFrame:
    """The dimension: name, category, flags, and a digest of each rule and of all."""
    rows = [(t.name, t.category, t.prior_state, t.uncertain, t.curated_only, t.alias, t.rule) for t in tags]
    one = spark.createDataFrame(rows, "name string, category string, prior_state boolean, always_uncertain boolean, curated_only boolean, alias_of string, rule string").withColumn("rule_hash", F.sha2("rule", 256))
    everything = hashlib.sha256("".join(f"{t.name}:{t.rule};" for t in sorted(tags, key=lambda t: t.name)).encode()).hexdigest()
    return one.withColumn("rules_hash", F.lit(everything))


#: Names that stand for another tag.
ALIASES = {t.name: t.alias for t in ALL if t.alias}
NAMES = frozenset(t.name for t in ALL)
