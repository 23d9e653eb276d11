"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch at most (a single longer row is a batch of its own), so that long documents don't meet in a worker.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Rows of a few numbers each that are sent to every task at most: about 60 MB as a hash table. More meet their partners in a shuffle.
SENT_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A session that names none gets a temporary one if it runs on this machine alone; else it's an error."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="fieldlog-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder. Cuts the lineage: lost executors don't lose it, and columns are pruned on reading."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Bounds what a Python worker holds at once, for the session, unless its bounds are closer already."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, rows):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    bound = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").lower().rstrip("b")
    if not bound.isdigit() or int(bound) > size:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def sent(df: DataFrame) -> DataFrame:
    """A table of written(), of a few numbers a row: with the hint to send it to every task where it has at most SENT_ROWS rows."""
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id as text; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
