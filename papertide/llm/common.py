"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The definition of a word in every contract of this subpackage: ASCII white space separates.
WORD_SPACE = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file on this machine (every executor has the package)."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Folders made by this driver, so that release() can remove them.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where the setting is missing, one is set below the warehouse, on a local master (tests) only: a
    cluster must name a folder that all its machines see.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        sc.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/papertide/{uuid.uuid4().hex}"
    _made.append(folder)
    return folder


#: Spark removes a query's shuffle files at its end if this is set, not only when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage is cut, and lost executors cost nothing.

    Nothing reads the shuffles of the write again, so their files go with it.
    """
    path, conf = os.path.join(folder, name), df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        conf.set(CLEANUP, before) if before is not None else conf.unset(CLEANUP)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Remove what settle() wrote, through the file system that holds it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if folder in _made:
        _made.remove(folder)


def made() -> set[str]:
    """The folders that this driver has made and not removed yet."""
    return set(_made)


def drop_since(spark: SparkSession, before: set[str], but: str) -> None:
    """Remove the folders made since made() gave `before`, but for one: call it when what read them is written."""
    for folder in made() - before - {but}:
        drop_folder(spark, folder)


def release(spark: SparkSession) -> None:
    """Remove all that the operators have written to the shared folder for results of this driver.

    A result reads what its operator has settled, so call this once results are written or no longer
    needed. Operators remove by themselves what none of their results reads.
    """
    for folder in list(_made):
        drop_folder(spark, folder)


def words_of(text: Column) -> Column:
    """Words of a text as an array: maximal runs of anything but ASCII white space (null text: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SPACE), lambda w: w != "")


def sized(df: DataFrame, rows: int) -> DataFrame:
    """Mark a written table for broadcasting if it has at most so many rows; else joins shuffle it."""
    return F.broadcast(df) if df.count() <= rows else df


def join_few(rows: DataFrame, few: DataFrame, key: str, most: int, how: str = "left", spread: int = 32) -> DataFrame:
    """rows joined to few, a written table with one row a key, where one key may hold most of rows.

    A few table of at most `most` rows is broadcast; a larger one goes to each of `spread` parts of
    every key, so that the rows of one key are dealt over as many tasks.
    """
    if few.count() <= most:
        return rows.join(F.broadcast(few), key, how)
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(spread)).cast("int")
    copies = few.withColumn("_pt_salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    return rows.withColumn("_pt_salt", salt).join(copies, [key, "_pt_salt"], how).drop("_pt_salt")
