"""Helpers that several corpus operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the standard tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    ``spark.checkpoint.dir`` (or a checkpoint folder set already) is used as
    given.  Where neither is set, a session on one machine gets a temporary folder;
    on a cluster that is an error, since executors would not see it.
    """
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="tidewell-checkpoint-")
        atexit.register(shutil.rmtree, where, True)
    sc.setCheckpointDir(where)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small frame through a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write a frame as Parquet into the shared folder and read it back.

    Unlike a checkpoint the result can be read by column.  The schema is passed
    on, so an empty frame keeps its columns.  The folder goes when the driver's JVM
    ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewell-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


#: Rows in a batch that goes to Python.  Texts can be long, so batches are kept small.
BATCH_ROWS = 500


def in_small_batches(df: DataFrame) -> DataFrame:
    """The same frame, with the session set to send rows to Python in small batches.

    Spark reads the setting when a frame is planned, so it stays set for the session;
    a smaller one is left alone.  A batch is held several times over (in the JVM, as Arrow, as Python strings);
    the default of 10,000 whole texts would make memory follow their length.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        df.sparkSession.conf.set(key, BATCH_ROWS)
    return df


def word_count(text: Column) -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def drawn_numbers(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits that a seed and an id give; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that no column of the frame clashes with."""
    taken = {c.lower() for c in df.columns}
    name, n = stem, 0
    while name.lower() in taken:
        n += 1
        name = f"{stem}_{n}"
    return name
