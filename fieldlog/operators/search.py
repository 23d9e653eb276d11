"""Composable searches over plays: immutable values that become lazy DataFrames.

Each predicate is a boolean column or a semi-join, so a search never widens its rows. Searches inside any_of and none_of become
existence flags on the play's key, which keeps SQL's three-valued logic: NOT of an unknown stays unknown and matches nothing.

Settings (certainty, statuses, game types) hold for the whole search, whatever the order of the calls: a predicate that depends on them is made
when the search is run. By default plays whose status is ok, in games that count, match by certain tags.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, fields, replace
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldlog.functions.tags import ALIASES

#: Games that count unless a search says otherwise, and those after the season. A game without a type is a regular one.
DEFAULT_GAME_TYPES = ("regular", "playoff", "worldseries", "lcs", "divisionseries", "wildcard", "championship")
POSTSEASON = ("worldseries", "lcs", "divisionseries", "wildcard", "championship")
POSITIONS = ("P", "C", "1B", "2B", "3B", "SS", "LF", "CF", "RF", "OF", "DH", "PH", "PR", "?")
BASES = ("1", "2", "3", "H")
ORDERS = {"chronological": ("date", "game_id", "game_key", "seq"), "reverse": ("-date", "-game_id", "-game_key", "-seq")}


class QueryError(ValueError):
    """A search that can't be answered. candidates: of an ambiguous name, (id, label) each."""

    def __init__(self, message: str, candidates: Sequence[tuple[str, str]] = ()):
        super().__init__(message)
        self.candidates = tuple(candidates)


@dataclass(frozen=True)
class Tables:
    """plays (game_key, seq, play_id, ...), and by name the tables that semi-joins need."""

    plays: DataFrame
    games: DataFrame | None = None
    play_tags: DataFrame | None = None
    advances: DataFrame | None = None
    sequences: DataFrame | None = None
    credits: DataFrame | None = None
    entries: DataFrame | None = None
    people: DataFrame | None = None
    rosters: DataFrame | None = None
    teams: DataFrame | None = None
    parks: DataFrame | None = None
    tags: DataFrame | None = None
    coverage: DataFrame | None = None


@dataclass(frozen=True)
class Predicate:
    """Either a test of a play's own columns, or keys that the play must be among. keys gets the tables and the whole search's settings."""

    test: Column | None = None
    keys: Callable[[Tables, Search], DataFrame] | None = None
    on: tuple[str, ...] = ("play_id",)
    game_only: bool = False
    #: What it reads, as table or table.column.
    needs: tuple[str, ...] = ()
    #: A name that must mean one thing: (kind, name).
    name: tuple[str, str] | None = None
    tag: str | None = None
    force_at: tuple[str | None] | None = None


def spelled(*parts: str) -> Column:
    """Names compare without regard to case and inner spaces."""
    text = F.concat_ws(" ", *[F.coalesce(F.col(p), F.lit("")) for p in parts])
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def wanted(name: str) -> str:
    return " ".join(name.split()).lower()


def candidates(t: Tables, kind: str, name: str) -> DataFrame:
    """id, label of what a name may mean: a person by nickname, first or roster name with the last, or the last alone; a park by a name; a club by city, nickname or both."""
    key = wanted(name)
    if kind == "person":
        roster = t.rosters.where(spelled("first", "last") == key).select("person_id").distinct().withColumn("on_roster", F.lit(True))
        own = (spelled("nickname", "last") == key) | (spelled("first", "last") == key) | (spelled("last") == key)
        return t.people.join(roster, "person_id", "left").where(own | F.col("on_roster")).select(F.col("person_id").alias("id"), F.concat_ws(" ", "first", "last").alias("label"))
    if kind == "park":
        return t.parks.where((spelled("name") == key) | (spelled("aka") == key)).select(F.col("park_id").alias("id"), F.col("name").alias("label"))
    found = t.teams.where((spelled("city", "nickname") == key) | (spelled("nickname") == key) | (spelled("city") == key))
    return found.groupBy(F.col("team_id").alias("id")).agg(F.concat(F.min("season"), F.lit("-"), F.max("season")).alias("label"))


@dataclass(frozen=True)
class Search:
    predicates: tuple[Predicate, ...] = ()
    groups: tuple[tuple[str, tuple[Search, ...]], ...] = ()
    uncertain: bool = False
    #: None: any.
    statuses: tuple[str, ...] | None = ("ok",)
    #: Empty: any.
    game_types: tuple[str, ...] = DEFAULT_GAME_TYPES
    order: tuple[str, ...] = ("game_key", "seq")
    rows: int | None = None
    skip: int = 0
    curated: str | None = None

    def _with(self, *p: Predicate) -> Search:
        return replace(self, predicates=self.predicates + p)

    def where(self, test: Column, *needs: str) -> Search:
        return self._with(Predicate(test=test, needs=needs))

    def among(self, keys: Callable[[Tables, Search], DataFrame], *on: str, **more) -> Search:
        return self._with(Predicate(keys=keys, on=on or ("play_id",), **more))

    # State before and after the play.
    def outs(self, n: int) -> Search:
        return self.where(F.col("outs_before") == n)

    def outs_after(self, n: int) -> Search:
        return self.where(F.col("outs_after") == n, "plays.outs_after")

    def bases(self, state: str) -> Search:
        if len(state) != 3 or set(state) - {"0", "1"}:
            raise QueryError("three of 0 and 1, first base first")
        return self.where(F.col("bases_before") == state)

    def bases_loaded(self) -> Search:
        return self.bases("111")

    def bases_empty(self) -> Search:
        return self.bases("000")

    def runner_on(self, base: int) -> Search:
        if base not in (1, 2, 3):
            raise QueryError("base is 1, 2 or 3")
        return self.where(F.substring("bases_before", base, 1) == "1")

    def scoring_position(self) -> Search:
        return self.where((F.substring("bases_before", 2, 1) == "1") | (F.substring("bases_before", 3, 1) == "1"))

    def inning(self, n: int) -> Search:
        return self.where(F.col("inning") == n)

    def inning_at_least(self, n: int) -> Search:
        return self.where(F.col("inning") >= n)

    def inning_ending(self) -> Search:
        return self.where(F.col("inning_ending"), "plays.inning_ending")

    def walkoff(self) -> Search:
        return self.where(F.col("walk_off"), "plays.walk_off")

    def half(self, which: str) -> Search:
        if which not in ("top", "bottom"):
            raise QueryError("top or bottom")
        return self.where(F.col("half") == which)

    def score_diff(self, low: int, high: int) -> Search:
        return self.where(F.col("score_diff").between(low, high))

    def batter(self, batter_id: str) -> Search:
        return self.where(F.col("batter_id") == batter_id, "plays.batter_id")

    def batter_ran(self, value: str) -> Search:
        if value not in ("yes", "no", "unknown"):
            raise QueryError("yes, no or unknown")
        return self.where(F.col("batter_ran") == value, "plays.batter_ran")

    def event_matches(self, pattern: str) -> Search:
        return self.where(F.col("event").rlike(pattern), "plays.event")

    def hit_location(self, zone: str) -> Search:
        return self.where(F.col("hit_location").startswith(zone[:-1]) if zone.endswith("*") else F.col("hit_location") == zone, "plays.hit_location")

    def hit_located(self) -> Search:
        return self.where(F.col("hit_location").isNotNull(), "plays.hit_location")

    # The game.
    def games_where(self, test: Column, *needs: str, **more) -> Search:
        return self.among(lambda t, _: t.games.where(test).select("game_key"), "game_key", game_only=True, needs=("games", *needs), **more)

    def season(self, year: int) -> Search:
        return self.seasons(year, year)

    def seasons(self, low: int, high: int) -> Search:
        return self.games_where(F.col("season").between(low, high))

    def league(self, code: str) -> Search:
        """The league of the file, or of the home club in that season."""
        def keys(t: Tables, _: Search) -> DataFrame:
            if t.teams is None:
                return t.games.where(F.col("league") == code).select("game_key")
            clubs = t.teams.where(F.col("league") == code).select(F.col("team_id").alias("home"), "season").distinct().withColumn("in_league", F.lit(True))
            return t.games.join(clubs, ["home", "season"], "left").where((F.col("league") == code) | F.col("in_league")).select("game_key")

        return self.among(keys, "game_key", game_only=True, needs=("games",))

    def team(self, code: str) -> Search:
        return self.games_where((F.col("home") == code) | (F.col("away") == code))

    def _side(self, code: str, batting: bool) -> Search:
        # The visitors are side 0, whoever bats first.
        def keys(t: Tables, _: Search) -> DataFrame:
            home, away = (F.col("home") == code).cast("int"), (F.col("away") == code).cast("int")
            sides = F.array_compact(F.array(F.when(home == 1, F.lit(1 if batting else 0)), F.when(away == 1, F.lit(0 if batting else 1))))
            return t.games.select("game_key", F.explode(sides).alias("batting_team"))

        return self.among(keys, "game_key", "batting_team", needs=("games", "plays.batting_team"))

    def batting_team(self, code: str) -> Search:
        return self._side(code, True)

    def fielding_team(self, code: str) -> Search:
        return self._side(code, False)

    def park(self, park_id: str) -> Search:
        return self.games_where(F.col("park") == park_id, "games.park")

    # Names, which must mean one person, park or club.
    def batter_named(self, name: str) -> Search:
        return self.among(lambda t, _: candidates(t, "person", name).select(F.col("id").alias("batter_id")), "batter_id", needs=("people", "rosters", "plays.batter_id"), name=("person", name))

    def park_named(self, name: str) -> Search:
        return self.among(lambda t, _: t.games.join(candidates(t, "park", name).select(F.col("id").alias("park")), "park", "left_semi").select("game_key"), "game_key", game_only=True, needs=("games.park", "parks"), name=("park", name))

    def team_named(self, name: str) -> Search:
        def keys(t: Tables, _: Search) -> DataFrame:
            clubs = candidates(t, "team", name).select("id")
            sides = t.games.select("game_key", F.explode(F.array("home", "away")).alias("id"))
            return sides.join(clubs, "id", "left_semi").select("game_key")

        return self.among(keys, "game_key", game_only=True, needs=("games", "teams"), name=("team", name))

    def position_played(self, position: str) -> Search:
        """Plays batted by who was listed at the position that season: a fact of the season, not of the play."""
        position = position.upper()
        if position not in POSITIONS:
            raise QueryError(f"a position is one of {', '.join(POSITIONS)}")

        def keys(t: Tables, _: Search) -> DataFrame:
            listed = t.rosters.where(F.col("position") == position).select(F.col("person_id").alias("batter_id"), "season").distinct()
            return t.games.select("game_key", "season").join(listed, "season").select("game_key", "batter_id")

        return self.among(keys, "game_key", "batter_id", needs=("rosters", "games", "plays.batter_id"))

    # Child rows.
    def tag(self, name: str) -> Search:
        name = ALIASES.get(name, name)

        def keys(t: Tables, settings: Search) -> DataFrame:
            sure = F.lit(True) if settings.uncertain else F.col("confidence") == "certain"
            return t.play_tags.where((F.col("tag") == name) & sure).select("play_id")

        return self.among(keys, needs=("play_tags",), tag=name)

    def strikeout(self) -> Search:
        return self.tag("Strikeout")

    def uncaught_third_strike(self) -> Search:
        return self.tag("UncaughtThirdStrike")

    def dropped_third(self) -> Search:
        return self.tag("UncaughtThirdStrike")

    def batter_reached_on_k(self) -> Search:
        return self.tag("BatterReachedOnK")

    def double_play(self) -> Search:
        return self.tag("DoublePlay")

    def triple_play(self) -> Search:
        return self.tag("TriplePlay")

    def stolen_base(self, base: str | None = None) -> Search:
        found = self.tag("StolenBase")
        return found if base is None else found.where(F.col("event_basic").contains(f"SB{base}"), "plays.event_basic")

    def caught_stealing(self, base: str | None = None) -> Search:
        found = self.tag("CaughtStealing")
        return found if base is None else found.where(F.col("event_basic").contains(f"CS{base}"), "plays.event_basic")

    def _out(self, at: str | None, test: Column, force: bool = False, needs: tuple[str, ...] = ()) -> Search:
        here = F.lit(True) if at is None else F.col("dest") == at
        return self.among(lambda t, _: t.advances.where(F.col("is_out") & test & here).select("play_id"), needs=("advances", *needs), force_at=(at,) if force else None)

    def force_play(self, at: str | None = None, include_tag_outs: bool = False, certainty: str | None = None) -> Search:
        if certainty not in (None, "derived", "likely", "ambiguous"):
            raise QueryError("certainty is derived, likely or ambiguous")
        test = F.lit(True) if include_tag_outs else F.col("is_force")
        if certainty:
            test = test & (F.col("certainty") == certainty)
        return self._out(at, test, True, ("advances.certainty",) if certainty else ())

    def tag_out(self, at: str | None = None) -> Search:
        return self._out(at, ~F.col("is_force"))

    def out_at(self, base: str) -> Search:
        return self._out(base, F.lit(True))

    def _sequence(self, test: Column, scope: str | None) -> Search:
        there = F.lit(True) if scope is None else F.col("scope") == scope
        return self.among(lambda t, _: t.sequences.where(test & there).select("play_id"), needs=("sequences",) if scope is None else ("sequences.scope",))

    def putout_sequence(self, seq: str | Sequence[str], scope: str | None = None) -> Search:
        return self._sequence(F.col("seq_text") == "".join(seq), scope)

    def contains_sequence(self, seq: str | Sequence[str], scope: str | None = None) -> Search:
        return self._sequence(F.col("seq_text").contains("".join(seq)), scope)

    def putout_by(self, fielder: str, *assists: str) -> Search:
        def keys(t: Tables, _: Search) -> DataFrame:
            have = [F.bool_or((F.col("credit") == "putout") & (F.col("fielder") == fielder))]
            have += [F.bool_or((F.col("credit") == "assist") & (F.col("fielder") == a)) for a in assists]
            flags = t.credits.groupBy("play_id").agg(*[h.alias(f"h{i}") for i, h in enumerate(have)])
            return flags.where(" AND ".join(f"h{i}" for i in range(len(have)))).select("play_id")

        return self.among(keys, needs=("credits",))

    def error(self, fielder: str | None = None) -> Search:
        by = F.lit(True) if fielder is None else F.col("fielder") == fielder
        return self.among(lambda t, _: t.credits.where((F.col("credit") == "error") & by).select("play_id"), needs=("credits",))

    def fielder(self, position: int, player: str) -> Search:
        """Plays on which the player holds the position for the side in the field: from the play after an entry up to the next entry for it."""
        def keys(t: Tables, _: Search) -> DataFrame:
            spans = held_spans(t.entries).where((F.col("position") == position) & (F.col("player") == player))
            p = t.plays.select("play_id", "game_key", "seq", (1 - F.col("batting_team")).alias("team"))
            return p.join(spans, ["game_key", "team"]).where((F.col("seq") > F.col("from_seq")) & (F.col("to_seq").isNull() | (F.col("seq") <= F.col("to_seq")))).select("play_id")

        return self.among(keys, needs=("entries", "plays.batting_team"))

    def pitcher(self, player: str) -> Search:
        return self.fielder(1, player)

    # Composition.
    def any_of(self, *searches: Search) -> Search:
        return self._group("any", searches)

    def none_of(self, *searches: Search) -> Search:
        return self._group("none", searches)

    def _group(self, kind: str, searches: tuple[Search, ...]) -> Search:
        plain = Search()
        for s in searches:
            if not (s.predicates or s.groups):
                raise QueryError("a search in any_of or none_of has one predicate at least")
            if changed := [f.name for f in fields(Search) if f.name not in ("predicates", "groups") and getattr(s, f.name) != getattr(plain, f.name)]:
                raise QueryError(f"settings hold for the whole search, not inside any_of or none_of: {', '.join(changed)}")
        if not searches:
            raise QueryError("any_of and none_of need a search")
        return replace(self, groups=self.groups + ((kind, searches),))

    def include_uncertain(self) -> Search:
        return replace(self, uncertain=True)

    def include(self, *statuses: str) -> Search:
        return replace(self, statuses=None if self.statuses is None else self.statuses + statuses)

    def include_untrusted(self) -> Search:
        return self.include("state_untrusted")

    def include_unparsed(self) -> Search:
        return replace(self, statuses=None)

    def exclude_curated(self) -> Search:
        return replace(self, curated="anti")

    def curated_only(self) -> Search:
        return replace(self, curated="semi")

    def include_exhibition(self) -> Search:
        return replace(self, game_types=self.game_types + ("exhibition",))

    def include_allstar(self) -> Search:
        return replace(self, game_types=self.game_types + ("allstar",))

    def only_postseason(self) -> Search:
        return replace(self, game_types=POSTSEASON)

    def all_game_types(self) -> Search:
        return replace(self, game_types=())

    def order_by(self, *columns: str) -> Search:
        return replace(self, order=columns)

    def ordered(self, name: str) -> Search:
        if name not in ORDERS:
            raise QueryError(f"an order is one of {', '.join(ORDERS)}")
        return replace(self, order=ORDERS[name])

    def limit(self, n: int) -> Search:
        if n < 1:
            raise QueryError("a limit is 1 at least")
        return replace(self, rows=n)

    def offset(self, n: int) -> Search:
        if n < 0:
            raise QueryError("an offset isn't negative")
        return replace(self, skip=n)

    # Refusals: never an empty answer in silence.
    def _all(self) -> Iterator[Predicate]:
        yield from self.predicates
        for _, searches in self.groups:
            for s in searches:
                yield from s._all()

    def check_tables(self, t: Tables) -> None:
        for p in self._all():
            for need in p.needs:
                table, _, column = need.partition(".")
                found = getattr(t, table)
                if found is None or column and column not in found.columns:
                    raise QueryError(f"these tables have no {need}")

    def check_names(self, t: Tables) -> None:
        for p in self._all():
            if p.name:
                # The error names the first of them, in order, and says how many there are.
                all_ = candidates(t, *p.name)
                found = [tuple(r) for r in all_.orderBy(*all_.columns).limit(20).collect()]
                if len(found) != 1:
                    total = all_.count() if len(found) == 20 else len(found)
                    raise QueryError(f"{p.name[1]!r} is {'several' if found else 'no'} {p.name[0]}{f's ({total})' if found else ''}", found)

    def unknown_tags(self, t: Tables) -> list[str]:
        asked = sorted({p.tag for p in self._all() if p.tag})
        return sorted(set(asked) - {r[0] for r in t.tags.where(F.col("name").isin(*asked)).select("name").collect()}) if asked else []

    # To DataFrames.
    def matches(self, t: Tables) -> DataFrame:
        """The plays that match, in no order."""
        self.check_tables(t)
        df = t.plays
        if self.statuses is not None:
            df = df.where(F.col("parse_status").isin(*self.statuses))
        if self.game_types and t.games is not None and "game_type" in t.games.columns:
            df = df.join(t.games.where(self._of_type()).select("game_key"), "game_key", "left_semi")
        for p in self.predicates:
            df = df.where(p.test) if p.test is not None else df.join(p.keys(t, self), list(p.on), "left_semi")
        marks = count()
        for kind, searches in self.groups:
            df, either = self._either(df, t, searches, marks)
            df = df.where(either if kind == "any" else ~either)
        if self.curated:
            df = df.join(t.play_tags.where("source = 'curated'").select("play_id"), "play_id", f"left_{self.curated}")
        return df.select(*t.plays.columns)

    def _of_type(self) -> Column:
        return F.coalesce("game_type", F.lit("regular")).isin(*self.game_types)

    def _either(self, df: DataFrame, t: Tables, searches: tuple[Search, ...], marks: Iterator[int]) -> tuple[DataFrame, Column]:
        """df with what is needed, and whether a play meets one of the searches. Their own groups are met likewise; settings are those of self."""
        either = None
        for s in searches:
            parts = []
            for p in s.predicates:
                if p.test is not None:
                    parts.append(p.test)
                    continue
                mark = f"__met_{next(marks)}"
                df = df.join(p.keys(t, self).distinct().withColumn(mark, F.lit(True)), list(p.on), "left")
                parts.append(F.coalesce(F.col(mark), F.lit(False)))
            for kind, inner in s.groups:
                df, found = self._either(df, t, inner, marks)
                parts.append(found if kind == "any" else ~found)
            all_ = parts[0]
            for p in parts[1:]:
                all_ = all_ & p
            either = all_ if either is None else either | all_
        return df, either

    def run(self, t: Tables) -> DataFrame:
        """The matches in order; the columns of games that the order names come along."""
        if self.skip and not self.rows:
            raise QueryError("an offset needs a limit")
        self.check_names(t)
        df, names = self.matches(t), [c.lstrip("-") for c in self.order]
        if lacking := [c for c in names if c not in df.columns]:
            df = df.join(t.games.select("game_key", *lacking), "game_key")
        df = df.orderBy(*[F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in self.order])
        return df.offset(self.skip).limit(self.rows) if self.rows else df

    def run_rows(self, t: Tables) -> DataFrame:
        """run, with each play's tags in order and the batter's name."""
        df = self.run(t)
        sure = F.lit(True) if self.uncertain else F.col("confidence") == "certain"
        tags = t.play_tags.where(sure).join(df.select("play_id"), "play_id", "left_semi").groupBy("play_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
        df = df.join(tags, "play_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
        if t.people is not None and "batter_id" in df.columns:
            names = t.people.select(F.col("person_id").alias("batter_id"), F.concat_ws(" ", "first", "last").alias("batter_name"))
            df = df.join(names, "batter_id", "left").withColumn("batter_name", F.coalesce("batter_name", "batter_id"))
        return df

    def count(self, t: Tables) -> DataFrame:
        return self.matches(t).agg(F.count(F.lit(1)).alias("total"))

    def scope(self, t: Tables) -> DataFrame:
        """The games that the search looks at: only its game-level predicates and game types count, never its matches."""
        df = t.games
        if self.game_types and "game_type" in df.columns:
            df = df.where(self._of_type())
        for p in self.predicates:
            if p.game_only:
                df = df.join(p.keys(t, self), list(p.on), "left_semi")
        return df

    def coverage(self, t: Tables) -> DataFrame:
        """What was looked at: games, plays, days, seasons, leagues, and of (season, league) pairs whose missing games are known how complete they are."""
        g = self.scope(t)
        found = g.agg(F.count(F.lit(1)).alias("games"), F.coalesce(F.sum("plays"), F.lit(0)).alias("plays"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"), F.countDistinct("season").alias("seasons"), F.countDistinct("league").alias("leagues"))
        if t.coverage is None:
            return found
        pairs = t.coverage.join(g.select("season", "league").distinct(), ["season", "league"], "left_semi")
        known = F.when(F.col("games_missing").isNotNull(), F.col("games_held"))
        whole = pairs.agg(F.sum("games_missing").alias("missing"), F.count_if(F.col("games_missing").isNull()).alias("unmeasured"), (F.sum(known) / (F.sum(known) + F.sum("games_missing"))).alias("completeness"))
        # Both sides are one row.
        return found.withColumn("one", F.lit(1)).join(whole.withColumn("one", F.lit(1)), "one").drop("one")

    def _both_ways(self, t: Tables, statuses: tuple[str, ...] | None) -> DataFrame:
        """The plays of some statuses (None: all) that match with the tags that count, or would with uncertain ones as well, in one pass: __sure and __loose say which. A tag's plays are joined once, with whether
        the tag is among those that count."""
        self.check_tables(t)
        loose, marks = replace(self, uncertain=True), count()
        df = t.plays if statuses is None else t.plays.where(F.col("parse_status").isin(*statuses))
        if self.game_types and t.games is not None and "game_type" in t.games.columns:
            df = df.join(t.games.where(self._of_type()).select("game_key"), "game_key", "left_semi")
        sure, also = F.lit(True), F.lit(True)
        for p in self.predicates:
            if p.test is not None:
                df = df.where(p.test)
            elif p.tag is None or self.uncertain:
                df = df.join(p.keys(t, self), list(p.on), "left_semi")
            else:
                mark = f"__sure_{next(marks)}"
                keys = p.keys(t, loose).withColumn(mark, F.lit(False)).unionByName(p.keys(t, self).withColumn(mark, F.lit(True)))
                df = df.join(keys.groupBy(*p.on).agg(F.bool_or(mark).alias(mark)), list(p.on))
                sure = sure & F.col(mark)
        for kind, searches in self.groups:
            df, either = self._either(df, t, searches, marks)
            sure = sure & (either if kind == "any" else ~either)
            if not self.uncertain and any(p.tag for s in searches for p in s._all()):
                df, either = loose._either(df, t, searches, marks)
            also = also & (either if kind == "any" else ~either)
        if self.curated:
            df = df.join(t.play_tags.where("source = 'curated'").select("play_id"), "play_id", f"left_{self.curated}")
        return df.select(*t.plays.columns, sure.alias("__sure"), also.alias("__loose"))

    def _counts(self) -> Column:
        """Whether a play's status is one that the search asks for."""
        return F.lit(True) if self.statuses is None else F.coalesce(F.col("parse_status").isin(*self.statuses), F.lit(False))

    def excluded(self, t: Tables) -> DataFrame:
        """reason, n: plays that match but for their status, by status; and those (uncertain) that would match with uncertain tags only. A search that takes uncertain tags has no such row; one that takes any status
        excludes none by it."""
        why = F.array_compact(F.array(F.when(F.col("__sure") & ~self._counts(), F.coalesce("parse_status", F.lit("none"))), F.when(F.col("__loose") & ~F.col("__sure") & self._counts(), F.lit("uncertain"))))
        return tallied(self._both_ways(t, None).select(F.explode(why).alias("reason")), "reason", () if self.uncertain else ("uncertain",))

    def force_report(self, t: Tables) -> DataFrame:
        """what, n: how sure the forces are on which a force search rests: outs by certainty, at the base that all force predicates name, and plays of an unknown batter or an untrusted state. One pass over the plays, and one
        over the outs of theirs."""
        bases = {p.force_at[0] for p in self.predicates if p.force_at}
        at = bases.pop() if len(bases) == 1 else None
        wide = replace(self, statuses=None if self.statuses is None else tuple(dict.fromkeys((*self.statuses, "state_untrusted"))))
        outs = t.advances.where(F.col("is_out") & F.col("is_force") & (F.lit(True) if at is None else F.col("dest") == at))
        # A play has a few outs.
        of_play = outs.groupBy("play_id").agg(F.collect_list(F.coalesce("certainty", F.lit("none"))).alias("__outs"))
        own, none = self._counts(), F.array().cast("array<string>")
        told = F.concat(
            F.when(own, F.coalesce("__outs", none)).otherwise(none), F.when(own & (F.col("batter_ran") == "unknown"), F.array(F.lit("batter unknown"))).otherwise(none),
            F.when(F.col("parse_status") == "state_untrusted", F.array(F.lit("state untrusted"))).otherwise(none),
        )
        return tallied(wide.matches(t).join(of_play, "play_id", "left").select(F.explode(told).alias("what")), "what", ("batter unknown", "state untrusted"))


def tallied(df: DataFrame, column: str, always: tuple[str, ...]) -> DataFrame:
    """column, n: how often each value occurs; those of always have a row even if they don't."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    if not always:
        return counts
    zeros = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, always))).alias(column), F.lit(0).cast("long").alias("n"))
    return counts.unionByName(zeros).groupBy(column).agg(F.sum("n").alias("n"))


def held_spans(entries: DataFrame) -> DataFrame:
    """game_key, team, position, player, from_seq, to_seq of entries (game_key, team, position, player, seq; a starter's seq is null). Of entries at one place the largest player's stands."""
    at = F.coalesce("seq", F.lit(0))
    w = W.partitionBy("game_key", "team", "position").orderBy(at, "player")
    return entries.select("game_key", "team", "position", "player", at.alias("from_seq"), F.lead(at).over(w).alias("to_seq"))


def holders(plays: DataFrame, entries: DataFrame) -> DataFrame:
    """play_id, position, player: who holds each position of the side in the field. Plays and entries in one order, and the last entry
    of each position so far, so that a long game costs no more than its rows."""
    numbers = range(1, 10)
    p = plays.select("game_key", (1 - F.col("batting_team")).alias("team"), F.col("seq").alias("at"), F.lit(0).alias("is_entry"), "play_id", F.lit(None).cast("int").alias("position"), F.lit(None).cast("string").alias("player"))
    e = entries.select("game_key", "team", F.coalesce("seq", F.lit(0)).alias("at"), F.lit(1).alias("is_entry"), F.lit(None).cast("long").alias("play_id"), F.col("position").cast("int").alias("position"), "player")
    # A play comes before the entries that follow it; of entries at one place the largest player's stands, as in `held_spans`.
    w = W.partitionBy("game_key", "team").orderBy("at", "is_entry", "player").rowsBetween(W.unboundedPreceding, -1)
    both = p.unionByName(e).withColumns({f"at_{k}": F.last(F.when(F.col("position") == k, F.col("player")), ignorenulls=True).over(w) for k in numbers})
    each = F.array(*[F.struct(F.lit(k).alias("position"), F.col(f"at_{k}").alias("player")) for k in numbers])
    return both.where("is_entry = 0").select("play_id", F.explode(F.filter(each, lambda x: x["player"].isNotNull())).alias("x")).select("play_id", "x.*")


#: Parameters by kind: what each adds comes from the method of its name.
WORDS = ("bases", "league", "team", "batting_team", "fielding_team", "batter", "park", "batter_named", "park_named", "team_named", "batter_ran", "hit_location", "position_played", "event_matches", "half")
NUMBERS = ("outs", "outs_after", "inning", "inning_at_least", "season", "runner_on")
SWITCHES = (
    "bases_loaded", "bases_empty", "scoring_position", "hit_located", "inning_ending", "walkoff", "strikeout", "dropped_third", "batter_reached_on_k", "double_play", "triple_play",
    "include_uncertain", "include_untrusted", "include_unparsed", "curated_only", "exclude_curated", "include_exhibition", "include_allstar", "only_postseason",
)
OTHERS = ("out_at", "error", "seasons", "tag", "force_play", "force_play_at", "force_certainty", "include_tag_outs", "tag_out_at", "putout_sequence", "contains_sequence", "putout_by", "assist_by")
PAGES = ("order", "limit", "offset")
PARAMETERS = WORDS + NUMBERS + SWITCHES + OTHERS + PAGES
#: Parameters that change another, which must be there.
ANCHORS = {"force_certainty": ("force_play", "force_play_at"), "include_tag_outs": ("force_play", "force_play_at"), "assist_by": ("putout_by",), "offset": ("limit",)}


def search_from_params(params: dict) -> Search:
    """The search that named parameters tell of. Blank is unset; an unknown name, a value outside its kind, or a parameter without its anchor is an error."""
    if unknown := sorted(set(params) - set(PARAMETERS)):
        raise KeyError(f"unknown parameters: {', '.join(unknown)}")
    given = {k: v for k, v in params.items() if v not in (None, "", [], False)}
    for name, needs in ANCHORS.items():
        if name in given and not any(n in given for n in needs):
            raise QueryError(f"{name} goes with {' or '.join(needs)}")

    def on(name: str) -> bool:
        return str(given.get(name, "")).strip().lower() in ("1", "true", "yes", "on")

    def number(name: str) -> int:
        try:
            return int(given[name])
        except (TypeError, ValueError):
            raise QueryError(f"{name} is a whole number") from None

    def items(name: str) -> list[str]:
        value = given[name]
        return [str(x).strip() for x in (value if isinstance(value, (list, tuple)) else str(value).split(",")) if str(x).strip()]

    def base(name: str) -> str:
        if str(given[name]) not in BASES:
            raise QueryError(f"{name} is one of {', '.join(BASES)}")
        return str(given[name])

    s = Search()
    for name in PARAMETERS:
        if name not in given:
            continue
        if name in WORDS:
            s = getattr(s, name)(str(given[name]).strip())
        elif name in NUMBERS:
            s = getattr(s, name)(number(name))
        elif name in SWITCHES:
            s = getattr(s, name)() if on(name) else s
    if "out_at" in given:
        s = s.out_at(base("out_at"))
    if "error" in given:
        s = s.error(str(number("error")))
    if "seasons" in given:
        if len(items("seasons")) != 2:
            raise QueryError("seasons is a first and a last year")
        s = s.seasons(*map(int, items("seasons")))
    for name in items("tag") if "tag" in given else []:
        s = s.tag(name)
    if on("force_play") or "force_play_at" in given:
        s = s.force_play(base("force_play_at") if "force_play_at" in given else None, on("include_tag_outs"), given.get("force_certainty"))
    if "tag_out_at" in given:
        s = s.tag_out(base("tag_out_at"))
    for name in ("putout_sequence", "contains_sequence"):
        if name in given:
            s = getattr(s, name)(items(name))
    if "putout_by" in given:
        s = s.putout_by(str(number("putout_by")), *(items("assist_by") if "assist_by" in given else ()))
    if "order" in given:
        s = s.ordered(str(given["order"]))
    if "limit" in given:
        s = s.limit(number("limit"))
    return s.offset(number("offset")) if "offset" in given else s
