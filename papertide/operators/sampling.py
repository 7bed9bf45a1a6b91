"""Samples that are the same wherever the rows lie."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def bottom_k(rows: DataFrame, key: str, k: int, seed: int, by: list[str] | None = None) -> DataFrame:
    """The k rows, of each group of `by`, whose keys hash least with a seed: a random sample that is fixed by seed and keys.

    Samples of parts can be merged by sampling them again. Rows that share a key share their hash; of
    them the least rows by their other columns come first. Null keys are keys; k of 0 or less is none.
    """
    order = [F.xxhash64(F.lit(seed), F.col(key)), F.col(key), *[F.col(c) for c in rows.columns if c != key]]
    if k <= 0:
        return rows.limit(0)
    if not by:
        return rows.orderBy(*order).limit(k)  # each task keeps k rows
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")  # tasks keep k rows of a group before they meet


def papers_to_compare(spark, sf_dir: str) -> DataFrame:
    """Twenty finished orders of each priority, ordered by a hash that SQL has too: md5 of seed and key."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderstatus <> 'P'").select("o_orderkey", "o_orderpriority")
    place = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.md5(F.concat(F.lit("7:"), F.col("o_orderkey").cast("string"))), "o_orderkey"))
    return orders.withColumn("place", place).filter("place <= 20")
