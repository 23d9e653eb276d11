"""Chat formatting: records of many layouts to canonical turns, to one formatted text a conversation with a loss mask, and back.

A record's nested field paths that any mapping knows (`messages[].content`; those that hold nothing are absent) are hashed; the hash picks the declarative mapping whose
turns it has. A mapping names what it needs and what may lack; the registry has a hash for each such set. Other fields of a record have no say. Records that no mapping fits keep
their row, with layout null, unless the caller names a layout for them (a table of turns whose role is null still holds turns).

The template writes a turn as its head `### role: `, the text and the line `</turn>`. In texts a backslash stands before each backslash and each control string, so no text can end a turn
or begin one; in roles `\\b`, `\\c`, `\\n` stand for backslash, colon and line end. The loss mask gives the code points of each assistant text in the formatted text.

All of it is columns. A conversation becomes one text, so it must fit into one value; positions are running sums of a window, so the work is linear in its size.

Defined cases: null texts and roles are empty. Turns go by number; turns of equal number by role, then text; null numbers come first; rows that repeat stay. A null conversation id is one
conversation. Other columns of the tables may have any names. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEAD, MID, END = "### ", ": ", "\n</turn>\n"
CLOSE = "</turn>"
#: Whose texts are learned from.
LEARNED = "assistant"
#: What other layouts call the roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}
TURN = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns. Either `each` (an array's path, with the paths of role and text in its elements), or `flat`: for each turn its role and the paths
    whose texts it joins by an empty line, or for one turn a record the paths of `role_from` and `flat`."""

    name: str
    needed: tuple[str, ...]
    optional: tuple[str, ...] = ()
    each: tuple[str, str, str] | None = None
    flat: tuple[tuple[str, tuple[str, ...]], ...] = ()
    role_from: str | None = None

    def fingerprints(self) -> Iterator[str]:
        for k in range(len(self.optional) + 1):
            for more in combinations(self.optional, k):
                yield fingerprint_of([*self.needed, *more])


def fingerprint_of(paths: Sequence[str]) -> str:
    return hashlib.md5("\n".join(sorted(paths)).encode()).hexdigest()


MAPPINGS = (
    Mapping("turn rows", ("role",), ("conv_id", "turn", "text"), flat=(("", ("text",)),), role_from="role"),
    Mapping("messages", ("messages[].role",), ("messages[].content", "conv_id"), each=("messages", "role", "content")),
    Mapping("from and value", ("conversations[].from",), ("conversations[].value", "conv_id"), each=("conversations", "from", "value")),
    Mapping("authored messages", ("chat.messages[].author.role", "chat.messages[].body.text"), ("conv_id",), each=("chat.messages", "author.role", "body.text")),
    Mapping("prompt and completion", ("prompt", "completion"), ("system", "conv_id"), flat=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt and response", ("prompt", "response"), ("system", "conv_id"), flat=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("instruction", ("instruction", "output"), ("input", "system", "conv_id"), flat=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("question and answer", ("data.question", "data.answer"), ("data.context", "conv_id"), flat=(("user", ("data.context", "data.question")), ("assistant", ("data.answer",)))),
)


def known_paths(mappings: Sequence[Mapping] = MAPPINGS) -> set[str]:
    return {p for m in mappings for p in (*m.needed, *m.optional)}


def json_schema(mappings: Sequence[Mapping] = MAPPINGS) -> T.StructType:
    """The type of records with all fields that the mappings know, for reading JSON: `F.from_json(line, json_schema())`. All values are texts."""
    tree: dict = {}
    for path in sorted(known_paths(mappings)):
        at = tree
        for step in path.split("."):
            at = at.setdefault(step, {})

    def of(node: dict) -> T.StructType:
        fields = [(name, of(below) if below else T.StringType()) for name, below in node.items()]
        return T.StructType([T.StructField(n.removesuffix("[]"), T.ArrayType(t) if n.endswith("[]") else t) for n, t in fields])

    return of(tree)


def leaves(schema: T.StructType, prefix: str = "") -> Iterator[str]:
    """The paths of a type's fields that hold values, arrays of structs gone into."""
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            yield from leaves(f.dataType, f"{prefix}{f.name}.")
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            yield from leaves(f.dataType.elementType, f"{prefix}{f.name}[].")
        else:
            yield prefix + f.name


def field(at: Column | None, path: str) -> Column:
    for step in path.split("."):
        at = F.col(f"`{step}`") if at is None else at[step]
    return at


def holds(path: str, at: Column | None = None) -> Column:
    """Whether a record has a value there, in some element where the path goes through an array."""
    if "[]." not in path:
        return field(at, path).isNotNull()
    array, rest = path.split("[].", 1)
    return F.coalesce(F.exists(field(at, array), lambda x: holds(rest, x)), F.lit(False))


def fingerprint(schema: T.StructType, mappings: Sequence[Mapping] = MAPPINGS) -> Column:
    """The hash of the known paths that a record of that type holds."""
    here = sorted(known_paths(mappings) & set(leaves(schema)))
    return F.md5(F.array_join(F.array_compact(F.array(*[F.when(holds(p), F.lit(p)) for p in here])) if here else F.array().cast("array<string>"), "\n").cast("binary"))


def layout(schema: T.StructType, mappings: Sequence[Mapping] = MAPPINGS) -> Column:
    """The number of the mapping that a record's fingerprint selects; null where none does."""
    table = {p: i for i, m in enumerate(mappings) for p in m.fingerprints()}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), fingerprint(schema, mappings))


def renamed(role: Column) -> Column:
    out = F.lower(F.trim(role))
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair]), out)
    return F.coalesce(known, out, F.lit(""))


def turns_by(m: Mapping, schema: T.StructType) -> Column:
    """A record's turns by one mapping; null if the type lacks a field that the mapping needs. Turns of `flat` without any of their texts are left out, unless the role is the record's."""
    have = set(leaves(schema))
    if not m.role_from and not set(m.needed) <= have:
        return F.lit(None).cast(TURN)
    if m.each:
        array, role, text = m.each
        value = lambda x, p: F.coalesce(field(x, p).cast("string"), F.lit("")) if f"{array}[].{p}" in have else F.lit("")
        return F.transform(field(None, array), lambda x: F.struct(renamed(field(x, role)).alias("role"), value(x, text).alias("text"))).cast(TURN)
    get = lambda p: field(None, p).cast("string") if p in have else F.lit(None).cast("string")
    if m.role_from:
        return F.array(F.struct(F.coalesce(get(m.role_from), F.lit("")).alias("role"), F.coalesce(get(m.flat[0][1][0]), F.lit("")).alias("text"))).cast(TURN)
    parts = [F.when(F.coalesce(*map(get, paths)).isNotNull(), F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *map(get, paths)).alias("text"))) for role, paths in m.flat]
    return F.array_compact(F.array(*parts)).cast(TURN)


def canonical(records: DataFrame, mappings: Sequence[Mapping] = MAPPINGS, default: str | None = None) -> DataFrame:
    """records with layout (the mapping's name) and turns (array of role and text), names that must be free. A record whose fingerprint none has goes by the mapping named default, if any;
    else both are null."""
    number = layout(records.schema, mappings)
    if default is not None:
        number = F.coalesce(number, F.lit([m.name for m in mappings].index(default)))
    turns, name = F.lit(None).cast(TURN), F.lit(None).cast("string")
    for i, m in enumerate(mappings):
        turns = F.when(F.col("layout") == i, turns_by(m, records.schema)).otherwise(turns)
        name = F.when(F.col("layout") == i, m.name).otherwise(name)
    return records.withColumn("layout", number).withColumn("turns", turns).withColumn("layout", name)


def turn_rows(records: DataFrame, mappings: Sequence[Mapping] = MAPPINGS, default: str | None = None) -> DataFrame:
    """conv_id, turn, at, role, text: one row a turn of records that have a layout (see canonical). Records that are turns themselves keep their number; those that hold several count them (at).
    Without a conv_id, each record but turn rows must get one first."""
    have = set(records.columns)
    of = lambda c: (F.col(c) if c in have else F.lit(None)).cast("long").alias(c)
    known = {p.split(".")[0].removesuffix("[]") for p in known_paths(mappings)} - {"conv_id", "turn"}
    found = canonical(records.select(of("conv_id"), of("turn"), *[c for c in records.columns if c in known]), mappings, default)
    return found.where("layout IS NOT NULL").select("conv_id", "turn", F.posexplode("turns").alias("at", "x")).select("conv_id", "turn", "at", "x.role", "x.text")


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in (HEAD, CLOSE):
        text = F.replace(text, F.lit(control), F.lit("\\" + control))
    return text


def unescaped(text: Column) -> Column:
    return F.when(text.contains("\\"), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def escaped_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit(":"), F.lit("\\c")), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\c"), F.lit(":")), F.lit("\\b"), F.lit("\\"))


def formatted(turns: DataFrame, key: Sequence[str] = ("conv_id",)) -> DataFrame:
    """Rows of turns (turn, at, role, text) to one row a conversation: formatted, and loss: for each turn its (start, stop) in code points, or null where nothing is learned from."""
    head = F.concat(F.lit(HEAD), escaped_role(F.col("role")), F.lit(MID))
    own = turns.select(*key, "turn", "at", "role", "text", head.alias("head"), escaped(F.col("text")).alias("body"))
    own = own.withColumn("size", F.length("head") + F.length("body") + len(END)).withColumn("head_size", F.length("head"))
    order = ("turn", "at", "role", "text")
    w = W.partitionBy(*key).orderBy(*order)
    start = F.sum(F.col("size").cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("size") + F.col("head_size")
    placed = own.withColumn("start", start).withColumn("no", F.row_number().over(w))
    loss = F.when(F.col("role") == LEARNED, F.struct(F.col("start").alias("start"), (F.col("start") + F.length("body")).alias("stop")))
    row = F.struct("no", F.concat("head", "body", F.lit(END)).alias("piece"), loss.alias("loss"))
    whole = placed.groupBy(*key).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return whole.select(*key, F.array_join("rows.piece", "").alias("formatted"), F.col("rows.loss").alias("loss"))


def read_back(texts: DataFrame, key: Sequence[str] = ("conv_id",)) -> DataFrame:
    """Of formatted conversations each turn: no, role, text, and learned, the text under its part of the mask, unescaped (null where it has none)."""
    blocks = F.split("formatted", "\\Q" + END + "\\E")
    each = texts.select(*key, F.posexplode(F.arrays_zip(F.slice(blocks, 1, F.size(blocks) - 1).alias("block"), F.col("loss").alias("loss"))).alias("no", "x")).select(*key, "no", "x.block", "x.loss")
    size = (F.length("block") + len(END)).cast("long")
    w = W.partitionBy(*key).orderBy("no").rowsBetween(W.unboundedPreceding, 0)
    each = each.withColumn("from", F.sum(size).over(w) - size)
    # A role holds no colon, so the first one ends it.
    middle = F.instr("block", MID)
    role = unescaped_role(F.substring(F.col("block"), F.lit(len(HEAD) + 1), middle - len(HEAD) - 1))
    text = unescaped(F.substring(F.col("block"), middle + len(MID), F.length("block")))
    first = (F.col("loss.start") - F.col("from") + 1).cast("int")
    learned = unescaped(F.substring(F.col("block"), first, (F.col("loss.stop") - F.col("loss.start")).cast("int")))
    return each.select(*key, "no", role.alias("role"), text.alias("text"), F.when(F.col("loss").isNotNull(), learned).alias("learned"))


def digests(texts: DataFrame, key: Sequence[str] = ("conv_id",)) -> DataFrame:
    """Of formatted conversations, read back from them: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    turn = F.concat("role", F.lit("\n"), "text", F.lit("\n"))
    rows = F.array_sort(F.collect_list(F.struct("no", turn.alias("turn"), "learned")))
    whole = read_back(texts.withColumn("chars", F.length("formatted").cast("long")), [*key, "chars"]).groupBy(*key, "chars").agg(rows.alias("rows"))
    loss = F.array_join(F.array_compact("rows.learned"), "")
    return whole.select(*key, F.size("rows").cast("long").alias("n_turns"), F.sha2(F.array_join("rows.turn", "").cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.col("chars").alias("formatted_chars"))
