"""Token ids as binary shards in training order.

A keyed Feistel network permutes the smallest even-bit domain that holds all sequences; walking its
cycles until a number falls below their count makes it a permutation of exactly 0 .. n - 1. So each
sequence's global slot follows from its number and the key alone, without sorting by random numbers.
Range partitions of the slots then lay their sequences out as records of one fixed stride: slot s is
record s % size of shard s // size, which makes reads sequential and lets them resume anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, settle, shared_dir, tokenizer_path
from .packing import pieces_of

#: Tokens of a record, records of a shard, rounds of the network.
WINDOW, SHARD, ROUNDS = 2_048, 256, 6
SHARDS = "shard long, first_slot long, records int, stride int, doc_ids array<long>, starts array<long>, lengths array<int>, data binary"


def mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit hash of numbers under a key (the finaliser of splitmix64)."""
    x = x ^ np.uint64(key & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(numbers: np.ndarray, n: int, key: int, rounds: int = ROUNDS) -> np.ndarray:
    """Where each number of 0 .. n - 1 goes under the key's permutation of them."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = numbers.astype(np.uint64)
    live = np.arange(len(out))
    while len(live):
        left, right = out[live] >> np.uint64(half), out[live] & mask
        for r in range(rounds):
            left, right = right, left ^ (mix(right, key + 0x9E3779B97F4A7C15 * (r + 1)) & mask)
        out[live] = (left << np.uint64(half)) | right
        live = live[out[live] >= np.uint64(n)]  # outside: walk on along the cycle
    return out.astype(np.int64)


def slot_of(number: Column, n: int, key: int) -> Column:
    @F.pandas_udf("long")
    def slot(numbers: pd.Series) -> pd.Series:
        return pd.Series(permuted(numbers.to_numpy(np.int64), n, key))

    return slot(number)


def numbered(pieces: DataFrame) -> tuple[DataFrame, int]:
    """Written pieces with a gapless number, and how many there are.

    The driver holds one count for each task that wrote pieces.
    """
    counts = pieces.groupBy(F.shiftright("piece_id", 33).alias("task")).agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("task")
    first = counts.assign(first=(counts["n"].cumsum() - counts["n"]).astype("int64"))[["task", "first"]].astype("int64")
    starts = F.broadcast(pieces.sparkSession.createDataFrame(first, "task long, first long"))
    place = F.col("piece_id").bitwiseAND(F.lit((1 << 33) - 1))
    rows = pieces.withColumn("task", F.shiftright("piece_id", 33)).join(starts, "task").withColumn("number", F.col("first") + place).drop("task", "first")
    return rows, int(counts["n"].sum())


def training_shards(docs: DataFrame, path: str, ranks: str | None = None, key: int = 42, end: int = 1, window: int = WINDOW, size: int = SHARD, folder: str | None = None) -> DataFrame:
    """All docs (doc_id, text) as token sequences in the key's order: a row per shard of `size` records.

    data holds `records` records of `stride` bytes: a sequence's ids as little-endian unsigned 16-bit
    numbers, padded with zeros; lengths has its ids without the padding, doc_ids and starts say whose
    ids they are and from which one on. A document is its ids and the end token, cut at every window;
    a null or empty text is the end token alone; repeated rows are there as often as in docs, null
    doc_ids are kept as null, an empty table gives no shard, and other columns of docs aren't read.
    Every slot of 0 .. n - 1 is filled once. Shards are written to the caller's place; see write_shards.
    """
    stride = 2 * window
    pieces = settle(pieces_of(docs, path, ranks, end, window, "<u2"), folder or shared_dir(docs.sparkSession), "sequences")
    rows, n = numbered(pieces.select("piece_id", "doc_id", "start", "length", "ids"))
    placed = rows.withColumn("slot", slot_of(F.col("number"), n, key)).withColumn("shard", F.expr(f"slot div {size}")).select("shard", "slot", "doc_id", "start", "length", "ids")

    def laid(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done() -> pd.DataFrame:
            one = pd.concat(held)
            data = b"".join(bytes(x).ljust(stride, b"\0") for x in one["ids"])
            ids = [None if pd.isna(x) else int(x) for x in one["doc_id"]]
            return pd.DataFrame([(int(one["shard"].iloc[0]), int(one["slot"].iloc[0]), len(one), stride, ids, one["start"].tolist(), one["length"].tolist(), data)], columns=[c.split()[0] for c in SHARDS.split(", ")])

        for batch in batches:
            for shard, part in batch.groupby("shard", sort=True):
                if held and held[0]["shard"].iloc[0] != shard:
                    yield done()
                    held.clear()
                held.append(part)
        if held:
            yield done()

    return placed.repartitionByRange("shard").sortWithinPartitions("slot").mapInPandas(laid, SHARDS)


def write_shards(shards: DataFrame, path: str, per_folder: int = 1_000) -> None:
    """Write shards below path, so many to a folder, each file's shards in order."""
    shards.withColumn("folder", F.expr(f"shard div {per_folder}")).write.mode("overwrite").option("compression", "zstd").partitionBy("folder").parquet(path)


def read_from(spark: SparkSession, path: str, slot: int = 0, per_folder: int = 1_000, size: int = SHARD) -> DataFrame:
    """(slot, doc_id, start, ids) from a slot on, by the shards and records that hold it or come behind it."""
    shards = spark.read.parquet(path).filter((F.col("folder") >= slot // size // per_folder) & (F.col("shard") >= slot // size))
    one = shards.select("first_slot", "stride", "data", F.posexplode(F.arrays_zip("doc_ids", "starts", "lengths")).alias("record", "x"))
    return one.select((F.col("first_slot") + F.col("record")).alias("slot"), F.col("x.doc_ids").alias("doc_id"), F.col("x.starts").alias("start"), F.expr("substring(data, record * stride + 1, x.lengths * 2)").alias("ids")).filter(F.col("slot") >= slot)


def op7_feistel_order(spark, sf_dir):
    return training_shards(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"))
