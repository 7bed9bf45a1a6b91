"""Packing token sequences by non-negative least squares.

Documents are cut into full windows and a remainder. Shallow combinations of two or three remainder
lengths that fill a window are enumerated; non-negative least squares finds how often to repeat each
so that together they use up the histogram of lengths; the counts are rounded down, and what is left
is packed greedily, best fit first. Items of badly filled leftovers are laid end to end and cut at
the windows' borders, so that padding stays small for any lengths.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import encoding
from .common import read_table, settle, shared_dir, tokenizer_path
from .sharding import slots

#: Tokens of a sequence; lengths that may stand third in a combination; steps of the solver; the least
#: share of a window that a leftover pattern must fill to be kept uncut.
WINDOW, THIRDS, STEPS, FILLED = 2_048, 48, 400, 0.995

#: Letters, marks and signs whose classes have long been settled: here the two libraries split alike.
SETTLED = re.compile("[^\x00-ͯЀ-ӿ‐-‧€]")
PIECES = "piece_id long, doc_id long, start long, length int, doc_tokens long, ids_crc32 long, ids binary"


@lru_cache(maxsize=2)
def encoder(path: str, ranks: str | None):
    """A function from a text to its ids, as tokenizers gives them for the .json file at path.

    ranks: the same vocabulary as a rank file; it gives the same ids sooner, and is used for texts that
    hold no special token's string and no character whose class could differ between Unicode versions.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    quick = encoding(ranks).encode_ordinary if ranks else None

    def encode(text: str) -> list[int]:
        if quick is None or SETTLED.search(text) or any(s in text for s in special):
            return tokenizer.encode(text, add_special_tokens=False).ids
        return quick(text)

    return encode


def pieces_of(docs: DataFrame, path: str, ranks: str | None, end: int, window: int, kind: str = "<u4") -> DataFrame:
    """Each document's ids (with the end token), cut into full windows and a remainder.

    kind: the little-endian number type of an id. A piece's number is its task's, shifted by 33 bits,
    plus its place in the task.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path, ranks)
        number = TaskContext.get().partitionId() << 33
        rows, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.array((encode(text) if text else []) + [end], dtype=kind)
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window].tobytes()
                    rows.append((number, doc_id, start, len(piece) // ids.itemsize, len(ids), zlib.crc32(piece), piece))
                    number += 1
                    held += len(piece)
                    if held > 16 << 20:
                        yield frame(rows)
                        rows, held = [], 0
        yield frame(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInPandas(cut, PIECES)


def frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in PIECES.split(", ")]
    return pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})


def combinations(counts: np.ndarray, window: int, thirds: int = THIRDS) -> np.ndarray:
    """Rows of two or three lengths (0: none) that fill a window exactly; the third is one of the commonest."""
    there = np.flatnonzero(counts)
    pairs = np.array([(a, window - a, 0) for a in there if a <= window - a and counts[window - a]], dtype=np.int64).reshape(-1, 3)
    commonest = there[np.argsort(-counts[there], kind="stable")[:thirds]]
    found = [pairs]
    for c in commonest:
        a = there[(there * 2 <= window - c) & (there > 0)]
        a = a[counts[window - c - a] > 0]
        found.append(np.column_stack([a, window - c - a, np.full(len(a), c)]))
    return np.unique(np.sort(np.concatenate(found), axis=1), axis=0)


def repeats(combos: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """How often to use each combination: non-negative least squares against the histogram.

    Accelerated projected gradient; each combination has at most three entries, so a step is a gather
    and a sum. The solution is rounded down and held within what is there, largest repeats first.
    """
    size, use = len(counts), combos > 0
    target = counts.astype(np.float64).copy()
    target[0] = 0
    # step sizes: one over the sum of the loads of the lengths that a combination uses
    load = np.bincount(combos[use], minlength=size).astype(np.float64)
    rate = 1.0 / np.maximum(1.0, np.where(use, load[combos], 0).sum(axis=1))
    x = np.zeros(len(combos))
    y, t = x.copy(), 1.0
    for _ in range(steps):
        left = target - np.bincount(combos.ravel(), weights=np.repeat(y, 3), minlength=size)
        left[0] = 0
        new = np.maximum(0.0, y + rate * left[combos].sum(axis=1))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / after * (new - x)
        x, t = new, after
    n, rest = np.zeros(len(combos), dtype=np.int64), counts.astype(np.int64).copy()
    for j in np.argsort(-x, kind="stable"):
        if x[j] < 1:
            break
        lengths, each = np.unique(combos[j][use[j]], return_counts=True)
        n[j] = min(int(x[j]), int((rest[lengths] // each).min()))
        rest[lengths] -= n[j] * each
    return n


def greedy(rest: np.ndarray, window: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns [(length, times)] and their repeats that use up a histogram, best fit first.

    Each pattern is repeated until one of its lengths runs out, so that the work depends on the
    number of lengths and not on that of the items.
    """
    rest, out = rest.copy(), []
    for top in range(window, 0, -1):
        while rest[top]:
            pattern, gap = [(top, 1)], window - top
            length = min(gap, top)
            while gap and length:
                spare = rest[length] - (length == top)
                if spare > 0 and length <= gap:
                    times = min(gap // length, int(spare))
                    pattern.append((length, times))
                    gap -= times * length
                length = min(gap, length - 1)
            need: dict[int, int] = {}
            for length, times in pattern:
                need[length] = need.get(length, 0) + times
            repeat = min(int(rest[length]) // times for length, times in need.items())
            for length, times in need.items():
                rest[length] -= repeat * times
            out.append((list(need.items()), repeat))
    return out


def plan(counts: np.ndarray, window: int = WINDOW, filled: float = FILLED) -> tuple[pd.DataFrame, dict]:
    """Where the n-th item of each length goes.

    counts: items of each length below the window. Returns intervals (length, low, high, sequence,
    place, times: item r of low <= r < high is number (r - low) % times of its length in sequence
    + (r - low) // times, which has them from place on) and, for the items laid end to end, times = 0:
    item r starts at token place + (r - low) * length of a stream whose windows begin at sequence.
    """
    combos = combinations(counts, window)
    n = repeats(combos, counts) if len(combos) else np.zeros(0, dtype=np.int64)
    rest = counts.astype(np.int64).copy()
    patterns = []
    for combo, times in zip(combos[n > 0], n[n > 0], strict=True):
        lengths, each = np.unique(combo[combo > 0], return_counts=True)
        rest[lengths] -= times * each
        patterns.append((list(zip(lengths.tolist(), each.tolist(), strict=True)), int(times)))
    solved = len(patterns)
    patterns += greedy(rest, window)
    stream = np.zeros(len(counts), dtype=np.int64)
    given, sequence, rows = np.zeros(len(counts), dtype=np.int64), 0, []
    kept = 0
    for items, times in patterns:
        if sum(length * each for length, each in items) < filled * window:
            for length, each in items:
                stream[length] += each * times
            continue
        kept, place = kept + 1, 0
        for length, each in items:
            rows.append((length, given[length], given[length] + each * times, sequence, place, each))
            given[length] += each * times
            place += length * each
        sequence += times
    place = 0
    for length in np.flatnonzero(stream)[::-1].tolist():
        rows.append((length, given[length], given[length] + stream[length], sequence, place, 0))
        place += length * int(stream[length])
    table = pd.DataFrame(rows, columns=["length", "low", "high", "sequence", "place", "times"]).astype({"length": "int32", "low": "int64", "high": "int64", "sequence": "int64", "place": "int64", "times": "int32"})
    return table, {"sequences": sequence + -(-place // window), "combinations": solved, "patterns": kept, "streamed": int(stream.sum())}


def pack_documents(docs: DataFrame, path: str, ranks: str | None = None, end: int = 1, window: int = WINDOW, folder: str | None = None) -> DataFrame:
    """Pack all docs (doc_id, text) into sequences of at most `window` tokens.

    Returns a row per piece: piece_id, doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset. Each document is its ids and the end token; a null or empty text is the end token alone; a
    repeated row is packed as often as it is there; null doc_ids are kept; an empty table gives an
    empty result; other columns of docs aren't read. Full windows are sequences by themselves. The
    driver holds the histogram of remainders (one number for each length below the window) and the
    plan made from it, of at most about window x 50 rows at any size. The encoded pieces, with their
    ids, are written to `folder` once, from where packed_ids() reads them.
    """
    spark = docs.sparkSession
    pieces = settle(pieces_of(docs, path, ranks, end, window), folder or shared_dir(spark), "pieces")
    histogram = pieces.groupBy("length").count().toPandas()
    counts = np.zeros(window + 1, dtype=np.int64)
    counts[histogram["length"]] = histogram["count"]
    full, counts[window] = int(counts[window]), 0
    table, about = plan(counts, window)

    small = pieces.select("piece_id", "doc_id", "start", "length", "doc_tokens", "ids_crc32")
    out = ["piece_id", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    windows = (
        slots(small.filter(F.col("length") == window), "length", ["piece_id"], int(np.clip(full // 500_000, 16, 65_536)), "rank")
        .withColumns({"sequence_id": F.col("rank") + about["sequences"], "offset": F.lit(0).cast("long")})
    )
    rest = slots(small.filter(F.col("length") < window), "length", ["piece_id"], int(np.clip(counts.max() // 500_000, 16, 512)), "rank")
    # bounded by the window: see above
    where = F.broadcast(spark.createDataFrame(table.rename(columns={"length": "of"}), "of int, low long, high long, sequence long, place long, times int"))
    placed = rest.join(where, (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    nth = F.col("rank") - F.col("low")
    whole = placed.filter("times > 0").withColumns({
        "sequence_id": F.col("sequence") + F.expr("(rank - low) div times"),
        "offset": F.col("place") + nth % F.col("times") * F.col("length"),
    })
    at = F.col("place") + nth * F.col("length")
    streamed = placed.filter("times = 0").withColumns({"at": at, "room": (window - at % window).cast("int")})
    fits = streamed.filter("length <= room").withColumns({"sequence_id": F.expr(f"sequence + at div {window}"), "offset": F.col("at") % window})
    found = windows.select(out).unionByName(whole.select(out)).unionByName(fits.select(out))
    lengths = [int(x) for x in table.loc[table["times"] == 0, "length"]]
    if not lengths:
        return found
    # those that a border cuts take the ids, and so their parts' checksums, from the written pieces
    ids = pieces.filter(F.col("length").isin(lengths)).select("piece_id", "ids")
    parts = (
        streamed.filter("length > room")
        .join(ids, "piece_id")
        .withColumn("part", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumns({"skip": F.expr("part * room"), "take": F.expr("if(part = 0, room, length - room)")})
        .withColumns({
            "start": F.col("start") + F.col("skip"),
            "length": F.col("take"),
            "ids_crc32": F.crc32(F.expr("substring(ids, skip * 4 + 1, take * 4)")),
            "sequence_id": F.expr(f"sequence + at div {window} + part"),
            "offset": F.expr(f"if(part = 0, at % {window}, 0L)"),
        })
    )
    return found.unionByName(parts.select(out))


def packed_ids(spark: SparkSession, packed: DataFrame, folder: str) -> DataFrame:
    """Add the ids (little-endian unsigned 32-bit numbers) to what pack_documents() gave for this folder."""
    ids = spark.read.parquet(f"{folder}/pieces").select("piece_id", F.col("start").alias("_pt_start"), "ids")
    part = F.expr("substring(ids, int(start - _pt_start) * 4 + 1, length * 4)")
    return packed.join(ids, "piece_id").withColumn("ids", part).drop("_pt_start")


def op5_nnls_packing(spark, sf_dir):
    packed = pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"))
    return packed.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")
