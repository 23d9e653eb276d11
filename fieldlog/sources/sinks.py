"""Where tables and results go: an archive and derived tables as Parquet, results as CSV or JSON."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Derived tables are laid out by season, so that a season's search reads only its files.
BY = "season"
#: Spark's setting for `freed`.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Inside, what a step has shuffled is deleted as the step ends; otherwise it stays until the driver collects garbage, so that disks hold the shuffles of many steps. For steps that run each frame
    once: one that runs again would have to shuffle again. The session has its own setting back afterwards."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that driver and executors share. Only a session on one machine may go without it."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="fieldlog-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def write_event_files(lines: DataFrame, root: str, game: list[str], order: list[str], suffix: str = "EVA", files: int | None = None) -> None:
    """Lines of games (season, line, the columns of game and order) as event files below root: whole games, in order, a season's games spread over files that are named after it."""
    spark = lines.sparkSession
    parts = [*([files] if files else []), BY, *game]
    lines.repartition(*parts).sortWithinPartitions(BY, *game, *order).select(BY, F.col("line").alias("value")).write.partitionBy(BY).text(root)
    # Spark names files after its tasks; sources name them after what they hold.
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in fs.globStatus(path(f"{root}/{BY}=*")):
        season = folder.getPath().getName().partition("=")[2]
        found = sorted(f.getPath().toString() for f in fs.listStatus(folder.getPath()))
        for k, name in enumerate(n for n in found if not n.rsplit("/", 1)[1].startswith(("_", "."))):
            fs.rename(path(name), path(f"{root}/{season}T{k}.{suffix}"))


def write_named_files(lines: DataFrame, root: str) -> None:
    """Lines (name, place, line) as one file a name below root, in the order of their places."""
    spark = lines.sparkSession
    lines.repartition("name").sortWithinPartitions("name", "place").select("name", F.col("line").alias("value")).write.mode("overwrite").partitionBy("name").text(root)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in fs.globStatus(path(f"{root}/name=*")):
        for f in fs.listStatus(folder.getPath()):
            if not f.getPath().getName().startswith(("_", ".")):
                fs.rename(f.getPath(), path(f"{root}/{folder.getPath().getName().partition('=')[2]}"))
        fs.delete(folder.getPath(), True)


def replace_partitions(df: DataFrame, path: str, by: str = BY) -> None:
    """Rewrites the partitions that df has rows of, and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def set_down(df: DataFrame, path: str) -> DataFrame:
    """df as a table that takes the place of what was there."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def drop_partitions(spark: SparkSession, path: str, values: Sequence | None, by: str = BY) -> None:
    """Deletes the folders of some values, where there are any; of None, the whole table."""
    for folder in [path] if values is None else [f"{path}/{by}={v}" for v in values]:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """df without the keys in gone; rows whose key is null stay."""
    return df.join(gone.select(key).distinct(), key, "left_anti")


def flat(df: DataFrame) -> DataFrame:
    """Arrays as text, since CSV has none."""
    return df.select([F.array_join(F.col(c).cast("array<string>"), ";").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    flat(df).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def stamped(df: DataFrame, version: str) -> DataFrame:
    """Results say which build of the tables they come from."""
    return df.withColumn("corpus_version", F.lit(version))
