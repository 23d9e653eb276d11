"""The archive of event files: every line of every file, in versions.

    publish(spark, files, root)     adds new files; a file that is held with other bytes is refused, unless refresh=True
    manifest(spark, root)           the files of the newest version, or of another one
    lines(spark, root)              their lines, by season

Lines are stored by season and by the digest of their file, and never change. A version is a manifest: which digests count. Publishing has two phases: lines of new and
changed files are staged and checked (their bytes put together again must have the file's digest; each event's text put together again from its parts is compared with the event), and then
one rename makes the manifest visible, with its revisions (which file took which one's place) and its statistics. A run that is killed in between leaves the version before as it was; what it
staged is written again by the next run, or left for `unreferenced`.

Defined cases: files whose digest is held already under their path are skipped. Files in which nothing is new make no new version. Two paths with equal bytes are two files. Two runs that
publish the same version at once: the second one's rename fails, which is an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlog.functions import events as P

from . import event_files as E

#: Changed files that the error names.
NAMED = 20
REVISIONS = "path string, old_digest string, digest string, old_records long, records long, games_replaced long, version int"


class CorpusChanged(ValueError):
    """Files are held with other bytes. paths: some of them, in order."""

    def __init__(self, n: int, paths: Sequence[str]):
        super().__init__(f"{n} files have changed since they were archived, among them {', '.join(paths)}; publish with refresh=True to replace them")
        self.paths = tuple(paths)


class BrokenRoundTrip(ValueError):
    """Staged lines don't give their file's bytes again."""


def files_of(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, root: str) -> list[int]:
    fs, at = files_of(spark, f"{root}/manifests")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(at)) if fs.exists(at) else []


def part(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame | None:
    held = versions(spark, root)
    if not held:
        return None
    return spark.read.parquet(f"{root}/manifests/{held[-1] if version is None else version}/{name}")


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    """path, digest, bytes, modified, line_ending, open_end, season, records, and of its plays how many there are, aren't parsed, or don't come out of their parts as they went in; the version that brought it.
    None where nothing has been published."""
    return part(spark, root, "files", version)


def revisions(spark: SparkSession, root: str) -> DataFrame:
    """All revisions so far: path, old and new digest and records, games replaced, version."""
    held = versions(spark, root)
    return spark.read.schema(REVISIONS).parquet(*[f"{root}/manifests/{v}/revisions" for v in held]) if held else spark.createDataFrame([], REVISIONS)


def lines(spark: SparkSession, root: str, seasons: Sequence[int] | None = None, version: int | None = None) -> DataFrame:
    """path, line_no, raw_line, line_end, season, digest of the files of a version. Folders of other seasons aren't read."""
    held = manifest(spark, root, version)
    if held is None:
        raise FileNotFoundError(f"nothing is archived below {root}")
    found = spark.read.parquet(f"{root}/raw_records")
    if seasons is not None:
        found = found.where(F.col("season").isin(*seasons))
    return found.join(held.select("path", "digest"), ["path", "digest"], "left_semi")


def event_checks(all_lines: DataFrame) -> DataFrame:
    """By file: plays, those without a parse, and those whose parts don't make the event again. Both follow from an event's text, so each different text is read once."""
    held = E.plays(E.records(all_lines)).where("event IS NOT NULL").groupBy("path", "event").agg(F.count(F.lit(1)).alias("n"))
    read = P.parsed(held.select("event").distinct())
    told = read.select("event", "parse_ok", F.coalesce(F.col("parse_ok") & (P.emitted() != F.col("clean")), F.lit(False)).alias("changed"))
    of = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return held.join(told, "event").groupBy("path").agg(F.sum("n").alias("plays"), of(~F.col("parse_ok")).alias("unparsed"), of(F.col("changed")).alias("altered"))


def publish(spark: SparkSession, files: DataFrame, root: str, refresh: bool = False) -> int | None:
    """Archives files (as `event_files` gives them) and gives the new version; None if nothing is new."""
    held = manifest(spark, root)
    found = E.provenance(files)
    if held is None:
        wanted, changed = found, None
    else:
        new, changed = E.new_and_changed(found, held.select("path", "digest"))
        n = changed.count()
        if n and not refresh:
            raise CorpusChanged(n, [r[0] for r in changed.select("path").orderBy("path").limit(NAMED).collect()])
        wanted = new.unionByName(changed.drop("held_digest"))
    # Phase one: stage lines, then check what is stored.
    about = wanted.select("path", "digest", "season")
    E.lines(files).join(about, "path").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season", "digest").parquet(f"{root}/raw_records")
    stored = spark.read.parquet(f"{root}/raw_records").join(about.select("path", "digest"), ["path", "digest"], "left_semi")
    again = E.rebuilt(stored).select("path", F.col("digest").alias("again"))
    checked = wanted.join(again, "path", "left").join(event_checks(stored), "path", "left")
    version = (versions(spark, root) or [0])[-1] + 1
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("plays", "unparsed", "altered")}
    stage = f"{root}/staged/{uuid.uuid4().hex}"
    checked.withColumns({**zero, "version": F.lit(version)}).write.parquet(f"{stage}/checked")
    told = spark.read.parquet(f"{stage}/checked")
    count, broken = told.agg(F.count(F.lit(1)), F.count_if(~F.col("again").eqNullSafe(F.col("digest")))).first()
    if broken:
        raise BrokenRoundTrip(f"{broken} files don't come out of the archive as they went in")
    fs, at = files_of(spark, stage)
    if not count:
        fs.delete(at, True)
        return None
    told = told.drop("again")
    stay = None if held is None else held.join(told.select("path"), "path", "left_anti")
    (told if stay is None else stay.unionByName(told)).write.parquet(f"{stage}/files")
    if changed is None:
        revised = spark.createDataFrame([], REVISIONS)
    else:
        games = E.records(lines(spark, root).join(changed.select("path"), "path", "left_semi")).groupBy("path").agg(F.count_if(F.col("record_type") == "id").alias("games_replaced"))
        old = held.select("path", F.col("digest").alias("old_digest"), F.col("records").alias("old_records"))
        revised = told.join(old, "path").join(games, "path", "left").select("path", "old_digest", "digest", "old_records", "records", F.coalesce("games_replaced", F.lit(0)).alias("games_replaced"), F.lit(version).alias("version"))
    revised.write.parquet(f"{stage}/revisions")
    # Phase two: one rename.
    fs.delete(files_of(spark, f"{stage}/checked")[1], True)
    fs.mkdirs(files_of(spark, f"{root}/manifests")[1])
    target = files_of(spark, f"{root}/manifests/{version}")[1]
    if fs.exists(target) or not fs.rename(at, target):
        raise RuntimeError(f"another run has published version {version}")
    return version


def statistics(spark: SparkSession, root: str, version: int) -> DataFrame:
    """One row for a version: files it brought, replaced and left as they were; records, plays, failures to parse and to come out as they went in among what it brought."""
    files, of = manifest(spark, root, version), F.col("version") == version
    revised = spark.read.schema(REVISIONS).parquet(f"{root}/manifests/{version}/revisions").count()
    counts = {c: F.coalesce(F.sum(F.when(of, F.col(c))), F.lit(0)).alias(c) for c in ("records", "plays", "unparsed", "altered")}
    return files.agg(F.count_if(of).alias("files"), F.count_if(~of).alias("skipped"), *counts.values()).withColumn("refreshed", F.lit(revised).cast("long"))


def unreferenced(spark: SparkSession, root: str) -> DataFrame:
    """season, digest of stored lines that no version counts: what killed runs left."""
    held = spark.read.parquet(*[f"{root}/manifests/{v}/files" for v in versions(spark, root)]).select("digest").distinct()
    return spark.read.parquet(f"{root}/raw_records").select("season", "digest").distinct().join(held, "digest", "left_anti")
