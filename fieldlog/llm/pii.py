"""Personal data by weak supervision, in DataFrame functions alone.

Candidate spans come from strict patterns (email, ip, card, phone) and from looser ones (written-out emails, addresses of version 6,
national phone numbers). Four labelers vote on each candidate: the strict pattern with its check (regex), lists of
endings, prefixes and codes (gazetteer), words before it that speak for or against its kind (context), and its neighbours (edges). Expectation maximisation
over the counts of vote patterns estimates how reliable each labeler is, by kind; a logistic classifier is then trained on the resulting
probabilities with the votes and the span's shape as features, and decides which of the looser candidates are spans. Spans that the strict patterns
find and check stay in any case, and what fails its check (a card number by Luhn, an address by its parts) is no span, whatever the others
say: the classifier adds looser ones only.

Counts of vote patterns are at most 4 x 3 x 2 x 3 x 2 x 2 = 288 rows, whatever the input; fitting them is plain arithmetic on the driver,
and all work over texts is Spark's own functions.

Defined cases: a null text counts as empty and has no spans. Offsets are code points, the end exclusive. Repeated rows each get
their spans. Without candidates nothing is added. Work grows with the length of a text and the number of its matches, not with their product, so texts may be very long and
hold very many.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, text_of, written

KINDS = ("email", "ip", "card", "phone")

# Fixed patterns of the base. Repeats are possessive, which changes no match here (what follows a repeat is never in its class) and keeps
# long runs from recursing; a match starts where a run does, or where the last match ended, which is where the leftmost start is.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Looser patterns, for candidates.
WRITTEN_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]++)++"
IP6 = r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
NATIONAL_PHONE = r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"

OCTETS = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"

# Gazetteers: endings of addresses, first octets in public use, issuers' prefixes, country and area codes.
LISTED = (
    r"(?i)\.\s?(?:com|org|net|edu|gov|mil|int|info|io|eu|uk|us|ca|au|de|fr|es|it|nl|at|ch|be|pl|pt|br|mx|jp|cn|in|ru)$",
    r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.|^(?:20|fe80|fd)",
    r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    r"^\+?(?:1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])|^\(?[2-9][0-9]{2}",
)
TRIGGERS = (
    r"(?i)\b(?:e-?mail|mail|contact|write|correo|courriel)\b",
    r"(?i)\b(?:ip|host|server|address|addr|login)\b",
    r"(?i)\b(?:card|visa|mastercard|amex|credit|payment|tarjeta|carte|karte)\b",
    r"(?i)\b(?:phone|tel|telephone|call|mobile|fax|telefon|teléfono|téléphone)\b",
)
#: Words that speak against: the number is some other thing's; and a sign of assignment just before.
OTHERWISE = (
    r"(?i)\b(?:example|version|import|decorator)\b",
    r"(?i)\b(?:version|release|build|section|chapter|ver|kapitel|version)\b|\bv\.?\s*$",
    r"(?i)\b(?:order|invoice|isbn|serial|tracking|token|article|item|reference|ref|pedido|commande|bestellung|artikel)\b|[=#$]\s*[\"']?$",
    r"(?i)\b(?:order|invoice|isbn|issn|serial|tracking|token|article|item|part|reference|ref|pedido|commande|bestellung|artikel)\b|[=#$]\s*[\"']?$",
)
CONTEXT = 40
#: Items of a block of `scanned`; characters of a piece that a long text is cut into for redaction.
BLOCK, PIECE = 128, 1024
#: Labelers' assumed reliabilities before the first round of estimation: regex, gazetteer, context, edges. Words about the kind tell more than shapes do.
PRIOR = (0.95, 0.7, 0.95, 0.6)
ROUNDS, TRUST = 60, 3.0


def scanned(items: Column, zero: Column, step, emit) -> Column:
    """For each item emit(state, item), the state being step's over the items before it. An array grows by copying, so items are taken in blocks: the state before each
    block first, then each block by itself. Work is that of BLOCK copies an item, not of all items before it."""
    nothing = lambda kind: F.slice(F.array(kind), 1, 0)
    parts = lambda whole, n: F.transform(F.sequence(F.lit(0), F.greatest((F.size(whole) - 1).cast("int"), F.lit(0)), F.lit(n)), lambda at: F.slice(whole, at + 1, F.lit(n)))
    # A slice goes through all of its array, so blocks are cut from larger ones.
    blocks = F.flatten(F.transform(parts(items, BLOCK * BLOCK), lambda large: parts(large, BLOCK)))
    before = F.aggregate(
        blocks, F.struct(zero.alias("now"), nothing(zero).alias("out")),
        lambda acc, block: F.struct(F.aggregate(block, acc["now"], step).alias("now"), F.array_append(acc["out"], acc["now"]).alias("out")), lambda acc: acc["out"],
    )

    def one(block: Column, state: Column) -> Column:
        first = nothing(emit(state, F.get(block, F.lit(0))))
        return F.aggregate(block, F.struct(state.alias("now"), first.alias("out")), lambda acc, x: F.struct(step(acc["now"], x).alias("now"), F.array_append(acc["out"], emit(acc["now"], x)).alias("out")), lambda acc: acc["out"])

    return F.flatten(F.zip_with(blocks, before, one))


def last(text: Column, n: int = CONTEXT) -> Column:
    return F.right(text, F.lit(n))


FOUND = "array<struct<s:int,e:int,m:string,before:string,after:string>>"


def found(df: DataFrame, text: str, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """df with a column for each name of patterns (a sign without which there is no match, and the pattern): the leftmost non-overlapping matches in order, as
    array of (s, e, m, before: up to CONTEXT characters before it, after: the next one). Matches and what lies between them hold all of the text, so nothing is looked up by
    its place. Each stage is columns of its own, so that none is evaluated twice."""
    own = uuid.uuid4().hex
    m, g, x_ = ({n: f"{kind} {n} {own}" for n in patterns} for kind in "mgx")
    none = F.array().cast("array<string>")
    some = {n: F.col(text).rlike(sign) for n, (sign, _) in patterns.items()}
    df = df.withColumns({m[n]: F.when(some[n], F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) for n, (_, p) in patterns.items()})
    df = df.withColumns({g[n]: F.when(F.size(m[n]) > 0, F.split(text, p, -1)).otherwise(none) for n, (_, p) in patterns.items()})

    def items(n: str) -> Column:
        size = F.size(m[n])
        zipped = F.arrays_zip(F.col(m[n]).alias("m"), F.slice(g[n], 1, size).alias("gap"), F.slice(g[n], 2, size).alias("then"), F.slice(m[n], 2, size).alias("next"))
        return F.transform(zipped, lambda x: F.struct(x["m"].alias("m"), x["gap"].alias("gap"), F.left(F.concat(x["then"], F.coalesce(x["next"], F.lit(""))), F.lit(1)).alias("after")))

    def step(now: Column, x: Column) -> Column:
        return F.struct((now["at"] + F.length(x["gap"]) + F.length(x["m"])).alias("at"), last(F.concat(now["tail"], x["gap"], x["m"])).alias("tail"))

    def emit(now: Column, x: Column) -> Column:
        s = now["at"] + F.length(x["gap"])
        return F.struct(s.alias("s"), (s + F.length(x["m"])).alias("e"), x["m"].alias("m"), last(F.concat(now["tail"], x["gap"])).alias("before"), x["after"].alias("after"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"))
    df = df.withColumns({x_[n]: items(n) for n in patterns}).drop(*g.values())
    df = df.withColumns({n: F.when(F.size(m[n]) > 0, scanned(F.col(x_[n]), zero, step, emit)).otherwise(F.array().cast(FOUND)) for n in patterns})
    return df.drop(*m.values(), *x_.values())


def digits(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9]", "")


def passes(kind: str, m: Column) -> Column:
    """The base's check of a strict match."""
    if kind == "ip":
        return m.rlike(OCTETS)
    n = F.length(digits(m))
    if kind == "card":
        return n.between(12, 19) & F.call_function("luhn_check", digits(m))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


#: Each strict pattern and each looser one: its kind, what a text without a match lacks, the pattern.
STRICT = ((0, "@", EMAIL), (1, r"[0-9]\.[0-9]", IP), (2, "[0-9]", CARD), (3, r"\+[0-9]", PHONE))
LOOSE = ((0, r"[\[(]at[\])]", WRITTEN_EMAIL), (1, ":[0-9A-Fa-f]{1,4}:", IP6), (3, "[0-9]{3}[ .-][0-9]{4}", NATIONAL_PHONE))


def votes(k: int, strict: bool):
    def of(x: Column) -> Column:
        m, before, left, right = x["m"], x["before"], last(x["before"], 1), x["after"]
        return F.struct(
            x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"),
            (passes(KINDS[k], m).cast("int") if strict else F.lit(-1)).alias("regex"),
            m.rlike(LISTED[k]).cast("int").alias("listed"),
            F.when(before.rlike(TRIGGERS[k]), 1).when(before.rlike(OTHERWISE[k]), 0).otherwise(-1).alias("context"),
            (~(left.rlike(r"[\p{L}\p{N}]") | right.rlike(r"[\p{L}\p{N}]"))).cast("int").alias("edges"),
            m.rlike(r"[ @().:-]").cast("int").alias("parted"),
        )

    return of


def with_candidates(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with out: array of (s, k, e, regex, listed, context, edges, parted) of its column text. Votes are 0 or 1, or -1 where a labeler abstains: the strict pattern on the
    looser candidates, the context where no word tells."""
    own = uuid.uuid4().hex
    named = {f"{'strict' if strict else 'loose'} {k} {own}": (k, strict, sign, p) for strict, some in ((True, STRICT), (False, LOOSE)) for k, sign, p in some}
    df = found(df, text, {n: (sign, p) for n, (_, _, sign, p) in named.items()})

    def plausible(n: str, k: int, strict: bool) -> Column:
        """Strict matches that fail their check are candidates only where their length is possible."""
        if strict and KINDS[k] in ("card", "phone"):
            return F.filter(n, lambda x: F.length(digits(x["m"])).between(*((12, 19) if KINDS[k] == "card" else (9, 15))))
        return F.col(n)

    return df.withColumn(out, F.array_sort(F.concat(*[F.transform(plausible(n, k, strict), votes(k, strict)) for n, (k, strict, _, _) in named.items()]))).drop(*named)


@dataclass(frozen=True)
class SpanModel:
    """Weights of the logistic classifier by kind: bias, regex, listed, context, edges, parted; and the labelers' reliabilities."""

    weights: tuple[tuple[float, ...], ...]
    reliability: tuple[tuple[float, ...], ...]

    def score(self, c: Column) -> Column:
        def of(w: tuple[float, ...]) -> Column:
            vote = lambda x: F.when(x < 0, F.lit(0)).otherwise(2 * x - 1)
            return F.lit(w[0]) + w[1] * vote(c["regex"]) + w[2] * vote(c["listed"]) + w[3] * vote(c["context"]) + w[4] * vote(c["edges"]) + w[5] * vote(c["parted"])

        out = F.lit(0.0)
        for k, w in enumerate(self.weights):
            out = F.when(c["k"] == k, of(w)).otherwise(out)
        return 1 / (1 + F.exp(-out))


def fitted(patterns: list[tuple[int, tuple[int, int, int, int], int, int]]) -> SpanModel:
    """From rows (kind, votes, parted, number of candidates): reliabilities by expectation maximisation, then the classifier."""
    weights, reliabilities = [], []
    for k in range(len(KINDS)):
        rows = [(v, parted, n) for kind, v, parted, n in patterns if kind == k]
        share, right = 0.5, [[p, p] for p in PRIOR]  # right[j][c]: how often labeler j is right on class c
        posterior = [0.5] * len(rows)
        for _ in range(ROUNDS):
            for i, (v, _, _) in enumerate(rows):
                yes, no = math.log(share), math.log(1 - share)
                for j, x in enumerate(v):
                    if x >= 0:
                        yes += math.log(right[j][1] if x else 1 - right[j][1])
                        no += math.log(1 - right[j][0] if x else right[j][0])
                posterior[i] = 1 / (1 + math.exp(min(50.0, no - yes)))
            total = sum(n for _, _, n in rows)
            # Each estimate keeps imagined votes at the prior, 20 at least and as many as TRUST says: without them labelers that happen to agree
            # would outvote one that tells more. The checked pattern stays a good labeler.
            share = (sum(p * n for p, (_, _, n) in zip(posterior, rows)) + 10) / (total + 20)
            for j, prior in enumerate(PRIOR):
                for c in (0, 1):
                    own = [(p if c else 1 - p, v[j], n) for p, (v, _, n) in zip(posterior, rows) if v[j] >= 0]
                    seen, good = sum(p * n for p, _, n in own), sum(p * n for p, x, n in own if x == c)
                    imagined = max(20.0, TRUST * seen)
                    right[j][c] = min(0.995, max(0.5 if j else 0.9, (good + imagined * prior) / (seen + imagined)))
        w = [0.0, 1.0, 0.5, 0.5, 0.5, 0.0]
        total = sum(n for _, _, n in rows) or 1
        for _ in range(400):
            step = [0.01 * x for x in w]
            for p, (v, parted, n) in zip(posterior, rows):
                x = (1.0, *(0.0 if y < 0 else 2.0 * y - 1 for y in v), 2.0 * parted - 1)
                z = sum(a * b for a, b in zip(w, x))
                error = 1 / (1 + math.exp(max(-50.0, min(50.0, -z)))) - p
                for i in range(6):
                    step[i] += n / total * error * x[i]
            w = [a - b for a, b in zip(w, step)]
        weights.append(tuple(w))
        reliabilities.append(tuple(r[1] for r in right))
    return SpanModel(tuple(weights), tuple(reliabilities))


def train(found_in: DataFrame) -> SpanModel:
    """From a frame with the column `candidates`, over all its rows."""
    votes = found_in.select(F.explode("candidates").alias("c")).groupBy("c.k", "c.regex", "c.listed", "c.context", "c.edges", "c.parted").agg(F.count(F.lit(1)).alias("n"))
    rows = sorted(tuple(r) for r in votes.collect())
    return fitted([(k, (a, b, c, d), parted, n) for k, a, b, c, d, parted, n in rows])


SPAN = "array<struct<s:int,k:int,e:int,base:boolean>>"


def with_spans(df: DataFrame, candidates: str, model: SpanModel, out: str) -> DataFrame:
    """df with out: of its column of candidates the checked strict matches, and the looser ones that the classifier adds: array of (s, k, e, base) by start, then kind. An added span
    that overlaps a base one would tell nothing new."""
    every, ahead, back = (f"{x} {uuid.uuid4().hex}" for x in ("every", "ahead", "back"))
    good = F.filter(candidates, lambda c: (c["regex"] == 1) | ((c["regex"] < 0) & (model.score(c) >= 0.5)))
    df = df.withColumn(every, F.array_sort(F.transform(good, lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"), (c["regex"] == 1).alias("base")))).cast(SPAN))
    some = F.exists(every, lambda x: ~x["base"])
    # Of the base spans that begin no later the furthest end, and of those that follow the first start, tell of an overlap.
    df = df.withColumn(ahead, F.when(some, scanned(F.col(every), F.lit(-1), lambda now, x: F.when(x["base"], F.greatest(now, x["e"])).otherwise(now), lambda now, x: F.struct(x.alias("x"), now.alias("reached")))))
    df = df.withColumn(ahead, F.reverse(ahead))
    df = df.withColumn(back, F.when(some, scanned(F.col(ahead), F.lit(2**31 - 1), lambda now, y: F.when(y["x"]["base"], y["x"]["s"]).otherwise(now), lambda now, y: F.struct(y["x"].alias("x"), (y["x"]["base"] | ((y["reached"] <= y["x"]["s"]) & (now >= y["x"]["e"]))).alias("stays")))))
    return df.withColumn(out, F.when(some, F.transform(F.filter(F.reverse(back), lambda y: y["stays"]), lambda y: y["x"])).otherwise(F.col(every))).drop(every, ahead, back)


def joined(spans_: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, found: array of (s, k, e, base), k being the place in KINDS."""
    own = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("body"))
    held = written(with_candidates(own, "body", "candidates").select("doc_id", "candidates"), "candidates")
    return with_spans(held, "candidates", train(held), "found").select("doc_id", "found")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the number of base spans by kind, base_sha256, spans (base and added), n_added."""
    base = F.filter("found", lambda x: x["base"])
    def of_kind(k: int):
        return lambda x: x["k"] == k

    counts = [F.size(F.filter(base, of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return detect(df, id_col, text_col).select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), F.size(F.filter("found", lambda x: ~x["base"])).cast("long").alias("n_added"))


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """df with each span replaced by its kind in brackets; a length column follows. Null texts stay null."""
    # Names of our own, so that no column of df can clash with them.
    body, held, seen, text, cut = (f"{x} {uuid.uuid4().hex}" for x in ("body", "spans", "candidates", "text", "pieces"))
    # One job writes votes, which are few bytes a match, the next decides: texts are read twice rather than joined to their spans.
    seen_votes = written(with_candidates(df.select(text_of(text_col).alias(body)), body, "candidates").select("candidates"), "votes")
    model = train(seen_votes)
    discard(seen_votes)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    # In pieces, so that a place in a long text is found without going through all before it.
    pieces, pieces_ = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), F.col(cut)

    def between(a: Column, b: Column) -> Column:
        first, last_ = F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int")
        head = F.substring(F.get(pieces_, first), a % PIECE + 1, F.least(b - a, F.lit(PIECE)))
        rest = F.concat(F.array_join(F.slice(pieces_, first + 2, F.greatest(last_ - first - 1, F.lit(0))), ""), F.substring(F.get(pieces_, last_), F.lit(1), b - last_ * PIECE))
        return F.when(b <= a, "").when(first == last_, head).otherwise(F.concat(head, rest))

    def emit(at: Column, x: Column) -> Column:
        # Spans of different kinds can overlap: what is left of a later one is taken out too.
        return F.concat(between(at, x["s"]), F.when(x["e"] > at, F.element_at(names, x["k"] + 1)).otherwise(""))

    end = F.array_max(F.transform(F.col(held), lambda x: x["e"]))
    parts = scanned(F.col(held), F.lit(0), lambda at, x: F.greatest(at, x["e"]), emit)
    cleared = F.concat(F.array_join(parts, ""), between(end, F.length(body)))
    out = with_spans(with_candidates(df.withColumn(body, text_of(text_col)), body, seen), seen, model, held)
    some = F.size(held) > 0
    out = out.withColumn(cut, F.when(some, pieces))
    out = out.withColumn(text, F.when(some, cleared).otherwise(F.col(text_col)))
    columns = [F.col(text).alias(c) if c == text_col else F.when(some, F.length(text)).otherwise(F.col(c)).cast(df.schema[c].dataType).alias(c) if c == length_col else F.col(c) for c in df.columns]
    return out.select(*columns)
