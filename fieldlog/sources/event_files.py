"""Event files: whole files to lines, records, games and plays, with provenance. Every step is a DataFrame.

Files are read whole and as bytes, because lines need their numbers, and Latin-1 maps each byte to one character and back. A file is one
season of one team, a few MB at most; the files are what Spark spreads.

Defined cases: an empty file isn't listed, since Spark's scan leaves it out; a last line without an end counts; bytes outside ASCII survive. A short play record keeps its
row, with `problem` set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values of the format.
EVENT_FILES = "*.EV[ANFR]"
LATIN = "ISO-8859-1"
#: Stands for a comma outside quotes; no character of Latin-1.
SIGN = "\uffff"
OUTSIDE_QUOTES = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def event_files(spark: SparkSession, root: str, pattern: str = EVENT_FILES) -> DataFrame:
    """path, modificationTime, length, content of all files under root whose name fits."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)


def text_of(content: Column) -> Column:
    return F.decode(content, LATIN)


def provenance(files: DataFrame) -> DataFrame:
    """One row a file: digest, size, kind of line ends over the whole file, season from its name, number of records."""
    text = text_of(F.col("content"))
    crlf, lf = F.regexp_count(text, F.lit("\r\n")), F.regexp_count(text, F.lit("\n"))
    ends = F.when(crlf == 0, "lf").when(crlf == lf, "crlf").otherwise("mixed")
    tail = (F.length(text) > 0) & ~text.endswith("\n")
    season = F.nullif(F.regexp_extract("path", r"([0-9]{4})[A-Za-z0-9]*\.[A-Za-z]+$", 1), F.lit("")).cast("int")
    return files.select("path", F.sha2("content", 256).alias("digest"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), ends.alias("line_ending"), tail.alias("open_end"), season.alias("season"), (lf + tail.cast("int")).cast("long").alias("records"))


def lines(files: DataFrame) -> DataFrame:
    """path, line_no (from 1), raw_line without its end, line_end as it stands in the file."""
    text = text_of(F.col("content"))
    parts = F.filter(F.regexp_extract_all(text, F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0)), lambda x: x != "")
    each = files.select("path", F.posexplode(parts).alias("at", "held"))
    end = F.regexp_extract("held", r"(\r?\n)$", 1)
    return each.select("path", (F.col("at") + 1).alias("line_no"), F.regexp_replace("held", r"\r?\n$", "").alias("raw_line"), end.alias("line_end"))


def rebuilt(all_lines: DataFrame) -> DataFrame:
    """path, digest of the bytes put together again from the lines."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "raw_line", "line_end")))
    text = F.array_join(F.transform(ordered, lambda x: F.concat(x["raw_line"], x["line_end"])), "")
    return all_lines.groupBy("path").agg(F.sha2(F.encode(text, LATIN), 256).alias("digest"))


def fields(raw: Column) -> Column:
    """Split at commas outside quotes (an even number of quotes follows them); quotes around a field go. The work is linear in the line: a pattern that looks ahead from each comma reads the rest of it every time."""
    marked = lambda parts: F.array_join(F.transform(parts, lambda x, i: F.when((F.size(parts) - i) % 2 == 1, F.replace(x, F.lit(","), F.lit(SIGN))).otherwise(x)), '"')
    # The parts are an element that a function is given: named in the function of each part as they are made, they would be made once a part.
    outside = F.get(F.transform(F.array(F.split(raw, '"')), marked), F.lit(0))
    split = F.when(raw.contains(SIGN), F.split(raw, OUTSIDE_QUOTES)).otherwise(F.split(outside, SIGN))
    quoted = F.transform(split, lambda x: F.when(x.startswith('"'), F.regexp_replace(x, '^"(.*)"$', "$1")).otherwise(x))
    return F.when(raw.contains('"'), quoted).otherwise(F.split(raw, ","))


def records(all_lines: DataFrame) -> DataFrame:
    """Lines with record_type, fields, span (the game in its file, from 1; 0 before the first) and game_id."""
    w = W.partitionBy("path").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    split = all_lines.where("raw_line <> ''").withColumn("fields", fields(F.col("raw_line"))).withColumn("record_type", F.get("fields", F.lit(0)))
    opens = F.col("record_type") == "id"
    return split.withColumn("span", F.sum(opens.cast("int")).over(w)).withColumn("game_id", F.last(F.when(opens, F.get("fields", F.lit(1))), ignorenulls=True).over(w))


def game_spans(recs: DataFrame) -> DataFrame:
    """One row a game: its records in the file, and which of several games of that id it is."""
    spans = recs.where("span > 0").groupBy("path", "span", "game_id").agg(F.min("line_no").alias("first_record"), F.max("line_no").alias("last_record"), F.count(F.lit(1)).alias("records"))
    return spans.withColumn("occurrence", F.row_number().over(W.partitionBy("game_id").orderBy("path", "first_record")))


def game_info(recs: DataFrame) -> DataFrame:
    """Keys and values of info records, in order, none lost."""
    info = recs.where("record_type = 'info'").select("path", "span", "game_id", "line_no", F.get("fields", F.lit(1)).alias("key"), F.get("fields", F.lit(2)).alias("value"))
    return info.withColumn("seq", F.row_number().over(W.partitionBy("path", "span").orderBy("line_no")) - 1).drop("line_no")


def plays(recs: DataFrame) -> DataFrame:
    """Typed play records in order. An event's own commas belong to it."""
    field = lambda i: F.get("fields", F.lit(i))
    count = field(4)
    two_digits = count.rlike("^[0-9]{2}$")
    event = F.array_join(F.expr("slice(fields, 7, greatest(size(fields) - 6, 0))"), ",")
    problem = F.when(F.size("fields") < 7, "short record").when(field(1).try_cast("int").isNull(), "no inning").when(field(2).try_cast("int").isNull(), "no team")
    typed = recs.where("record_type = 'play'").select(
        "path", "span", "game_id", "line_no", field(1).try_cast("int").alias("inning"), field(2).try_cast("int").alias("team"), field(3).alias("batter"),
        F.when(two_digits, F.substring(count, 1, 1).try_cast("int")).alias("balls"), F.when(two_digits, F.substring(count, 2, 1).try_cast("int")).alias("strikes"),
        field(5).alias("pitches"), F.nullif(event, F.lit("")).alias("event"), problem.alias("problem"),
    )
    return typed.withColumn("seq", F.row_number().over(W.partitionBy("path", "span").orderBy("line_no")))


def new_and_changed(found: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of files found (path, digest), those not held yet, and those held with another digest."""
    new = found.join(held, "path", "left_anti")
    changed = found.join(held.select("path", F.col("digest").alias("held_digest")), "path").where("digest <> held_digest")
    return new, changed


def statistics(files: DataFrame) -> DataFrame:
    """One row: files, records, games, plays, plays with a problem, games whose id repeats."""
    recs = records(lines(files))
    counted = recs.agg(F.countDistinct("path").alias("files"), F.count(F.lit(1)).alias("records"), F.count_if(F.col("record_type") == "id").alias("games"), F.count_if(F.col("record_type") == "play").alias("plays"), F.count_if((F.col("record_type") == "play") & (F.size("fields") < 7)).alias("problems"))
    repeated = game_spans(recs).agg(F.count_if(F.col("occurrence") > 1).alias("repeated_ids"))
    # Both sides are one row: a join on a constant, not a product of tables.
    return counted.withColumn("one", F.lit(1)).join(repeated.withColumn("one", F.lit(1)), "one").drop("one")
