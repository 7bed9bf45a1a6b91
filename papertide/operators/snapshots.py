"""Weekly snapshots: written by week, read by the weeks that are asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOARD_ORDER = ["board", "rank_pos"]


def write_snapshots(rows: DataFrame, path: str) -> None:
    """Write rows (week_id, board, ...) by week; the weeks that rows hold are replaced, others stay."""
    rows.repartition("week_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("week_id").parquet(path)


def snapshots_of(spark: SparkSession, path: str, weeks: DataFrame, board: str | None = None) -> DataFrame:
    """The snapshots of the weeks (week_id) in a table, of one board or all, boards in order.

    The weeks prune the partitions while the query runs: only the files of the weeks asked for are read,
    however many there are. Weeks that repeat count once; weeks without a snapshot have no rows.
    """
    rows = spark.read.parquet(path)
    rows = rows.filter(F.col("board") == board) if board else rows
    asked = weeks.select("week_id").distinct()
    return rows.join(asked, "week_id", "left_semi").orderBy("week_id", *BOARD_ORDER, F.desc("emerging_score"))


def recent_weeks(runs: DataFrame, limit: int = 12) -> DataFrame:
    """(week_id): the weeks of runs (week_id, snapshot_at) that were taken last."""
    return runs.orderBy(F.desc("snapshot_at"), F.desc("week_id")).select("week_id").limit(limit)


def recent_assessments(assessments: DataFrame, limit: int = 50) -> DataFrame:
    """Assessments (id, assessed_at, ...), the last ones first."""
    return assessments.orderBy(F.desc("assessed_at"), F.desc("id")).limit(limit)


def hotspot_counts(runs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row: runs and snapshot rows."""
    return runs.agg(F.count(F.lit(1)).alias("hotspot_runs")).join(snapshots.agg(F.count(F.lit(1)).alias("hotspot_snapshot_rows")))
