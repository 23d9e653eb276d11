"""Files beside the event files: rosters, teams, and lists of the whole corpus, archived like event files; and published logs of games as a table.

    publish(spark, folder, root)     archives the auxiliary files below a folder, in versions (see `archive`); changed ones are refused, unless refresh=True
    lines(spark, root, kind)         their lines, for the readers of `reference_files`
    load_logs(spark, folder, root)   brings the table of logs into line with the log files below a folder

Defined cases: names that fit no kind are left alone, whatever they hold. A file whose line ends differ within it comes out as it went in, for each line keeps its own; it is told of in `mixed`. Files of no bytes aren't seen, as Spark's
reader leaves them out. No auxiliary file at all makes no version. Log lines that can't be read are counted and left out. A log file that holds lines which another path holds already, or which a new file of a smaller path
brings too, is refused whole: one game would count twice. A log file that is held and has changed replaces its own rows alone; one that isn't below the folder any more keeps its rows. Log files
are read by lines, so their size is no matter; a byte order mark before the first line is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import archive as A
from . import event_files as E
from . import reference_files as R
from . import sinks

#: Names of files, and what they hold.
LISTS = {"ballparks.csv": "park", "biofile.csv": "bio", "teams.csv": "teamlist", "allplayers.csv": "appearances"}
ROSTER, TEAM = "(?i)^[A-Z0-9]{3}([0-9]{4})\\.ROS$", "(?i)^TEAM([0-9]{4})$"
#: Names that can fit at all, so that the others aren't read.
NAMES = f"{{*.[Rr][Oo][Ss],[Tt][Ee][Aa][Mm][0-9][0-9][0-9][0-9],{','.join(LISTS)}}}"
LOG_NAMES = "{*.txt,*.TXT}"
#: Lines of a log file whose hashes are put together at a time.
RUN = 1000


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def kind_of(path: Column) -> Column:
    """What a file holds, by its name; null for others."""
    name = name_of(path)
    lists = F.create_map(*[F.lit(x) for pair in LISTS.items() for x in pair])
    return F.when(name.rlike(ROSTER), "roster").when(name.rlike(TEAM), "team").otherwise(F.try_element_at(lists, name))


def season_of(path: Column) -> Column:
    """The season that a roster or a list of teams is of; null for lists of the whole corpus."""
    name = name_of(path)
    return F.coalesce(F.nullif(F.regexp_extract(name, ROSTER, 1), F.lit("")), F.nullif(F.regexp_extract(name, TEAM, 1), F.lit(""))).cast("int")


def discovered(spark: SparkSession, folder: str) -> DataFrame:
    """path, modificationTime, length, content of the auxiliary files below a folder."""
    return E.event_files(spark, folder, NAMES).where(kind_of(F.col("path")).isNotNull())


def publish(spark: SparkSession, folder: str, root: str, refresh: bool = False) -> int | None:
    """Archives them; gives the new version, or None if nothing is new."""
    files = discovered(spark, folder)
    return None if files.select("path").isEmpty() else A.publish(spark, files, root, refresh)


def lines(spark: SparkSession, root: str, kind: str | None = None) -> DataFrame:
    """path, line_no, raw_line, kind, season of the archived files, of one kind or of all."""
    df = A.lines(spark, root).withColumns({"kind": kind_of(F.col("path")), "season": season_of(F.col("path"))})
    return df if kind is None else df.where(F.col("kind") == kind)


def by_kind(manifest: DataFrame) -> DataFrame:
    """kind, files, records, seasons, mixed (files whose line ends differ)."""
    df = manifest.withColumns({"kind": kind_of(F.col("path")), "season": season_of(F.col("path"))})
    return df.groupBy("kind").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"), F.countDistinct("season").alias("seasons"), F.count_if(F.col("line_ending") == "mixed").alias("mixed"))


def checks(lines_: DataFrame, manifest: DataFrame) -> dict[str, DataFrame]:
    """By name the archived files that are wrong: V07, another number of lines than the manifest says; V08, lines of no file; V09, bytes that don't come out as they went in."""
    counted = lines_.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    again = E.rebuilt(lines_).select("path", F.col("digest").alias("again"))
    held = manifest.select("path", "digest", "records")
    return {
        "V07_records_of_file": held.join(counted, "path", "left").where("NOT (records <=> n)").select("path"),
        "V08_lines_without_file": lines_.select("path").distinct().join(manifest.select("path"), "path", "left_anti"),
        "V09_bytes_differ": held.join(again, "path", "left").where("NOT (digest <=> again)").select("path"),
    }


def log_rows(spark: SparkSession, root: str) -> DataFrame | None:
    """The table of logs below root; None before the first load."""
    fs, at = A.files_of(spark, f"{root}/game_logs")
    return spark.read.parquet(f"{root}/game_logs") if fs.exists(at) else None


def overlaps(rows: DataFrame, held: DataFrame | None) -> DataFrame:
    """path, other, lines: files of rows (path, game_id, raw_line) that share lines with a held file of another path, or with one of rows whose path is smaller."""
    among = R.held_elsewhere(rows, rows.select("path", "game_id", "raw_line")).where("other < path")
    return among if held is None else R.held_elsewhere(rows, held).unionByName(among).groupBy("path", "other").agg(F.max("lines").alias("lines"))


def log_text(spark: SparkSession, folder: str, names: str) -> DataFrame:
    """path, block (where the part of the file begins that a task reads), id (in order within a block, without gaps), raw_line, hash of the lines of the files below folder. Large files are read in parts, by several tasks."""
    text = spark.read.option("pathGlobFilter", names).option("recursiveFileLookup", True).option("lineSep", "\n").text(folder)
    # As the reader of whole files spells paths: decoded, and without an empty authority.
    path = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^([A-Za-z0-9]+):///", "$1:/")
    raw = text.select(path.alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").cast("binary").alias("value"))
    return raw.select("path", "block", "id", F.regexp_replace(E.text_of(F.col("value")), "\r$", "").alias("raw_line"), F.unhex(F.sha2("value", 256)).alias("hash"))


def numbered(read: DataFrame) -> DataFrame:
    """Stored lines (path, block, id, ...) with line_no (from 1) in place of block and id. Only the blocks' sizes, a row a block, are added up by file."""
    blocks = read.groupBy("path", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = blocks.select("path", "block", "first", before.alias("before"))
    return read.join(F.broadcast(at), ["path", "block"]).withColumn("line_no", (F.col("id") - F.col("first") + F.col("before") + 1).cast("int")).drop("block", "id", "first", "before")


def digests(lines_: DataFrame) -> DataFrame:
    """path, digest of numbered lines (path, line_no, hash): of the digests of runs of lines, so that no task holds a file."""
    run = ((F.col("line_no") - 1) / RUN).cast("long")
    in_order = lambda place, x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, x))), lambda r: r[x] if x != "hash" else F.hex(r[x])), "")
    runs = lines_.groupBy("path", run.alias("run")).agg(F.sha2(in_order("line_no", "hash"), 256).alias("of_run"))
    return runs.groupBy("path").agg(F.sha2(in_order("run", "of_run"), 256).alias("digest"))


def load_logs(spark: SparkSession, folder: str, root: str, names: str = LOG_NAMES) -> DataFrame:
    """Loads new and changed log files into the table game_logs below root, by file. Gives path, state (loaded, replaced, current, refused), records, malformed, and for refused files other (the smallest path that holds
    lines of theirs) and shared (how many)."""
    held = log_rows(spark, root)
    # What is known and read of the files is set down before the table changes; the steps below read it from there.
    text = R.game_logs(log_text(spark, folder, names), ("path", "block", "id", "hash")).withColumn("series", R.series(F.col("path")))
    text = numbered(sinks.set_down(text, f"{root}/.logs_lines"))
    about = digests(text)
    if held is None:
        about = about.withColumn("state", F.lit("loaded"))
    else:
        was = held.select("path", F.col("digest").alias("was")).distinct()
        about = about.join(was, "path", "left").withColumn("state", F.when(F.col("was").isNull(), "loaded").when(F.col("was") == F.col("digest"), "current").otherwise("replaced")).drop("was")
    about = sinks.set_down(about, f"{root}/.logs_about")
    # A row a file.
    read = text.where("trim(raw_line) <> ''").drop("hash").join(F.broadcast(about), "path")
    good = read.where("problem IS NULL")
    refused = sinks.set_down(overlaps(good.where("state <> 'current'").select("path", "game_id", "raw_line"), held), f"{root}/.logs_refused")
    own = good.where("state <> 'current'").join(refused.select("path").distinct(), "path", "left_anti").drop("state", "problem").withColumn("file", F.hex(F.xxhash64("path")))
    # A changed file all of whose lines can't be read has no rows to put in the place of its old ones.
    bare = about.where("state = 'replaced'").join(good.select("path").distinct(), "path", "left_anti").select(F.hex(F.xxhash64("path")))
    sinks.drop_partitions(spark, f"{root}/game_logs", [r[0] for r in bare.collect()], "file")
    if not own.isEmpty():
        sinks.replace_partitions(own.repartition("file"), f"{root}/game_logs", "file")
    counts = read.groupBy("path").agg(F.count_if(F.col("problem").isNull()).alias("records"), F.count_if(F.col("problem").isNotNull()).alias("malformed"))
    why = refused.groupBy("path").agg(F.min("other").alias("other"), F.max_by("lines", F.col("lines")).alias("shared"))
    df = about.join(counts, "path", "left").join(why, "path", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("records", "malformed", "shared")}
    return df.withColumns(zero).withColumn("state", F.when(F.col("other").isNotNull(), "refused").otherwise(F.col("state"))).select("path", "state", "records", "malformed", "other", "shared")
