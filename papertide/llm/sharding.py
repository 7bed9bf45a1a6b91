"""Sharding by jump consistent hashing (law `key`).

A row's shard depends on its key and the number of shards alone: no ring table, no state. Going
from n to n + 1 shards moves 1/(n + 1) of the keys, all of them into the new shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read_table

#: Multiplier of the published jump hash (Lamping and Veach, 2014); a fixed value.
JUMP_MULTIPLIER = 2862933555777941757


def jump_buckets(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of unsigned 64-bit keys, all keys of a batch at a time."""
    key = keys.astype(np.uint64)
    bucket = np.zeros(len(key), dtype=np.int64)
    jump = np.zeros(len(key), dtype=np.int64)
    live = np.arange(len(key))
    while len(live):
        bucket[live] = jump[live]
        k = key[live] * np.uint64(JUMP_MULTIPLIER) + np.uint64(1)
        key[live] = k
        jump[live] = ((bucket[live] + 1) * (float(1 << 31) / ((k >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        live = live[jump[live] < shards]
    return bucket


def jump_shard(key: Column, shards: int) -> Column:
    """The shard (0 .. shards - 1) of a stable key of any type; a null key counts as one key of its own."""
    if shards < 1:
        raise ValueError("shards must be at least 1")

    @F.pandas_udf("int")
    def bucket(hashes: pd.Series) -> pd.Series:
        return pd.Series(jump_buckets(hashes.to_numpy(np.int64), shards).astype(np.int32))

    return bucket(F.xxhash64(key))


def slots(df: DataFrame, shard: str, order: list[str], salts: int = 64, slot: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without a gap.

    Rows are ordered within (shard, salt) groups, where the salt hashes the order columns; the groups'
    starts come from their counts, so that no shard is ever one task. `salts` is raised for larger
    inputs so that a group stays small. Rows alike in all order columns are numbered in any order.
    """
    salted = df.withColumn("_pt_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = salted.groupBy(shard, "_pt_salt").agg(F.count(F.lit(1)).alias("_pt_n"))
    before = Window.partitionBy(shard).orderBy("_pt_salt").rowsBetween(Window.unboundedPreceding, -1)
    # at most shards x salts rows of four numbers
    starts = F.broadcast(counts.select(shard, "_pt_salt", F.coalesce(F.sum("_pt_n").over(before), F.lit(0)).alias("_pt_start")))
    within = Window.partitionBy(shard, "_pt_salt").orderBy(*order)
    return (
        salted.withColumn("_pt_rank", F.row_number().over(within))
        .join(starts, [shard, "_pt_salt"])
        .withColumn(slot, F.col("_pt_start") + F.col("_pt_rank") - 1)
        .drop("_pt_salt", "_pt_rank", "_pt_start")
    )


def shard_documents(docs: DataFrame, shards: int = 40, salts: int = 64, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard, size, checksum and slot of every row of docs.

    Returns one row per input row: the key, size (UTF-8 bytes of the text plus 16; 16 without a text),
    text_crc32 (of the text's UTF-8 bytes; 0 without a text), law, shard, slot and grown_shard (with one
    more shard). Null keys share one shard; repeated rows each get a slot of their own; an empty table
    gives an empty result. Other columns of docs, whatever their names, aren't read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias(key),
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = rows.withColumns({"shard": jump_shard(F.col(key), shards), "grown_shard": jump_shard(F.col(key), shards + 1)})
    out = slots(rows, "shard", [key, "text_crc32", "size"], salts)
    return out.select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 40, key: str = "doc_id", files_per_shard: int = 8) -> None:
    """Write docs below path, one folder per shard; a large shard is dealt over several files by its keys."""
    placed = docs.withColumn("shard", jump_shard(F.col(key), shards))
    part = F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.lit(files_per_shard))
    placed.repartition(F.col("shard"), part).write.mode("overwrite").partitionBy("shard").parquet(path)


def op3_jump_hash_shards(spark, sf_dir):
    return shard_documents(read_table(spark, sf_dir, "documents"))
