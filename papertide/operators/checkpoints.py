"""Cutting the lineage of what is read several times, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark removes a query's shuffle files at its end if this is set, not only when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders made by this driver that results may still read.
_made: list[str] = []


def shared_base(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set, one machine gets a folder below the warehouse, and a cluster
    an error."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return folder


def checkpointed(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """df written to a new shared folder and read back; the folder that `instead_of` came from goes.

    Nothing reads the shuffles of the write again, so their files go with it.
    """
    spark = df.sparkSession
    path = f"{shared_base(spark).rstrip('/')}/papertide-engine/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    _made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._papertide_path = path
    if instead_of is not None:
        forget(instead_of)
    return out


def forget(df: DataFrame) -> None:
    """Remove what checkpointed() wrote for a table that nothing reads any more."""
    path = getattr(df, "_papertide_path", None)
    if path in _made:
        _remove(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Remove all that results of this driver have been reading; call it once they are written or no longer needed."""
    for path in list(_made):
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    _made.remove(path)
