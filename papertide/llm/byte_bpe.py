"""Byte-level BPE encoding by overlapping chunks, and decoding.

A long text is sliced into overlapping chunks, which are pre-tokenised in parallel. The pattern looks
only forward, so once two neighbouring chunks agree on one pre-token boundary inside their overlap
they agree from there on: the text is cut there, and each piece is encoded by itself. Decoding
concatenates the tokens' raw bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read_table, settle, shared_dir, tokenizer_path

#: Characters of a chunk, and those that it shares with the next one (at most half of a chunk).
CHUNK, OVERLAP = 32_768, 2_048
#: Near a chunk's end the text behind it could still change a match; the pattern looks at most this far.
AHEAD = 4


@lru_cache(maxsize=4)
def encoding(path: str):
    """The encoder of a rank file, without special tokens; kept by each Python worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def encoded(path: str, text: Column) -> Column:
    """Ids of a text as little-endian unsigned 32-bit numbers (null text: none)."""

    @F.pandas_udf("binary")
    def ids(texts: pd.Series) -> pd.Series:
        encode = encoding(path).encode_ordinary
        return pd.Series([np.array(encode(t), dtype="<u4").tobytes() if t else b"" for t in texts], dtype=object)

    return ids(text)


def decoded(path: str, ids: Column) -> Column:
    """The bytes that ids stand for."""

    @F.pandas_udf("binary")
    def text(many: pd.Series) -> pd.Series:
        decode = encoding(path).decode_bytes
        return pd.Series([decode(np.frombuffer(x, dtype="<u4").tolist()) if x else b"" for x in many], dtype=object)

    return text(ids)


def digests(path: str, ids: Column) -> Column:
    """n_tokens, ids_sha256 (of the decimal ids, joined by commas) and decoded_sha256 (of decoded ids).

    Laid upon encoded(), it runs in the same Python worker, so that the ids needn't pass through Spark.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def told(many: pd.Series) -> pd.DataFrame:
        decode, rows = encoding(path).decode_bytes, []
        for x in many:
            numbers = np.frombuffer(x or b"", dtype="<u4").tolist()
            rows.append((len(numbers), hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest(), hashlib.sha256(decode(numbers)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return told(ids)


def boundaries(chunk: str, start: int, overlap: int, size: int, last: bool) -> tuple[list[int], list[int]]:
    """Pre-token starts of a chunk, as places in its text: those in the overlap with the chunk before it
    and the certain ones in the overlap with the chunk behind it."""
    heads, tails = [], []
    for match in pattern().finditer(chunk):
        at = match.start()
        if start and at < overlap:
            heads.append(start + at)
        if not last and size - overlap <= at <= size - AHEAD:
            tails.append(start + at)
    return heads, tails


def encode_long(texts: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(doc, ids) for each distinct doc (a struct that identifies the text) of texts (doc, text)."""
    step = chunk - overlap

    def sliced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, digest, text in zip(batch["doc_id"], batch["digest"], batch["text"], strict=True):
                n = max(1, -(-(len(text) - overlap) // step))
                for i in range(0, n, 64):
                    at = range(i, min(n, i + 64))
                    yield pd.DataFrame({"doc_id": pd.array([doc_id] * len(at), dtype="Int64"), "digest": digest, "chunk_no": list(at), "last": [j == n - 1 for j in at], "text": [text[j * step : j * step + chunk] for j in at]})

    slices = (
        texts.mapInPandas(sliced, "doc_id long, digest long, chunk_no long, last boolean, text string")
        .groupBy("doc_id", "digest", "chunk_no", "last")  # a repeated row's chunks are the same; this also deals the chunks over all tasks
        .agg(F.first("text").alias("text"))
    )

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = [boundaries(t, i * step, overlap, chunk, last) for t, i, last in zip(batch["text"], batch["chunk_no"], batch["last"], strict=True)]
            yield batch[["doc_id", "digest", "chunk_no", "last"]].assign(heads=[h for h, _ in both], tails=[t for _, t in both])

    ends = slices.mapInPandas(found, "doc_id long, digest long, chunk_no long, last boolean, heads array<long>, tails array<long>")
    # one document's chunks at most, without their texts
    near = Window.partitionBy("doc_id", "digest").orderBy("chunk_no")
    whole = Window.partitionBy("doc_id", "digest")
    shared = F.array_min(F.array_intersect("tails", F.lead("heads").over(near)))
    cuts = (
        ends.select("doc_id", "digest", "chunk_no", "last", shared.alias("until"))
        .withColumn("since", F.coalesce(F.lag("until").over(near), F.lit(0)))
        .withColumn("broken", F.max(F.col("until").isNull() & ~F.col("last")).over(whole))
    )
    cuts = settle(cuts, shared_dir(texts.sparkSession), "cuts")  # three numbers a chunk
    pieces = (
        slices.withColumnsRenamed({"doc_id": "d", "digest": "g", "chunk_no": "c"})
        .join(cuts.filter(~F.col("broken")).drop("last"), F.expr("d <=> doc_id AND g = digest AND c = chunk_no"))
        .select(
            "doc_id", "digest", "chunk_no",
            F.expr(f"substring(text, int(since - chunk_no * {step}) + 1, int(coalesce(until - since, {chunk})))").alias("text"),
        )
    )
    joined = (
        pieces.select("doc_id", "digest", "chunk_no", encoded(path, F.col("text")).alias("ids"))
        .groupBy("doc_id", "digest")
        .agg(F.sort_array(F.collect_list(F.struct("chunk_no", "ids"))).alias("pieces"))
        .select("doc_id", "digest", concatenated(F.transform("pieces", lambda p: p["ids"])).alias("ids"))
    )
    # where neighbours never agree (a pre-token longer than the overlap), the text is encoded in one piece
    broken = cuts.filter("broken").select("doc_id", "digest").distinct().withColumnsRenamed({"doc_id": "d", "digest": "g"})
    rest = texts.join(broken, F.expr("d <=> doc_id AND g = digest"), "left_semi").groupBy("doc_id", "digest").agg(F.first("text").alias("text"))
    return joined.unionByName(rest.select("doc_id", "digest", encoded(path, F.col("text")).alias("ids")))


def concatenated(parts: Column) -> Column:
    @F.pandas_udf("binary")
    def join(many: pd.Series) -> pd.Series:
        return pd.Series([b"".join(parts) for parts in many], dtype=object)

    return join(parts)


def encode_documents(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids) of every row of docs (doc_id, text); ids are little-endian unsigned 32-bit numbers.

    A null or empty text has no ids. Texts of up to one chunk are encoded where they are read; longer
    ones are cut as the module says, so that one very long text keeps many tasks busy. Repeated rows
    stay repeated, null doc_ids are kept, an empty table gives an empty result, and other columns of
    docs, whatever their names, aren't read.
    """
    if not 0 < 2 * overlap <= chunk:
        raise ValueError("the overlap must be at most half of a chunk")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    long = F.coalesce(F.length("text"), F.lit(0)) > chunk
    short = rows.filter(~long).select("doc_id", encoded(path, F.col("text")).alias("ids"))
    texts = rows.filter(long).select("doc_id", F.xxhash64("text").alias("digest"), "text")
    again = texts.select(F.col("doc_id").alias("d"), F.col("digest").alias("g"))
    ids = encode_long(texts, path, chunk, overlap)
    return short.unionByName(again.join(ids, F.expr("d <=> doc_id AND g = digest")).select(F.col("d").alias("doc_id"), "ids"))


def op6_chunked_byte_bpe(spark, sf_dir):
    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    ids = encode_documents(read_table(spark, sf_dir, "documents"), path)
    return ids.select("doc_id", digests(path, F.col("ids")).alias("told")).select("doc_id", "told.*")
