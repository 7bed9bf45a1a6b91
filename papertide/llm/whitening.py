"""Whitening of embeddings by matrix-free block Lanczos.

The covariance is never formed: each pass over the vectors multiplies a small block of directions by
it, centred before multiplying, and Spark adds the tasks' parts by dimension. The basis is fully
orthogonalised, twice, after each pass; directions that break down (nothing new is left of them) are
replaced by fresh random ones. A pass ends the iteration if the residuals of the wanted pairs and of
the next one are at rounding level and a block of fresh directions confirms them, or if the basis
spans all dimensions. The trace comes from the vectors' deviations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_folder, read_table, settle, shared_dir

#: Components that are told; directions of a block; residuals at rounding level, as a part of the largest eigenvalue.
COMPONENTS, BLOCK, ROUNDING = 4, 8, 64 * np.finfo(np.float64).eps
#: The share of the trace at and below which a direction holds nothing that doubles can tell from 0.
NOTHING = 1e-12
SCALE, MOST = 256, 2**53


def integral(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the vectors that take part: all entries finite, and of the commonest length."""
    wide = rows.select("vec_id", F.col(vector).cast("array<double>").alias("c"))
    sound = wide.filter(F.col("c").isNotNull() & (F.size("c") > 0)).filter(F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < MOST)))
    lengths = sound.groupBy(F.size("c").alias("d")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("d")).limit(1)
    top = lengths.first()
    d = top["d"] if top else 0
    return sound.filter(F.size("c") == d).select("vec_id", F.transform("c", lambda c: F.floor(c * SCALE).cast("long")).alias("x"))


def blocks_of(batches: Iterator[pa.RecordBatch], column: str, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def added(fit: DataFrame, d: int, width: int, of: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """The sum over all vectors of of(block of rows), a table of few rows and `width` columns.

    Each task adds its own; Spark adds the tasks' rows by their number.
    """
    schema = pa.schema([("row", pa.int64()), ("v", pa.list_(pa.int64() if kind == "long" else pa.float64()))])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in blocks_of(batches, "x", d):
            got = of(x)
            total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int64()), pa.array(total.tolist(), schema.field("v").type)], schema=schema)

    parts = fit.select("x").mapInArrow(part, f"row long, v array<{kind}>")
    rows = parts.groupBy("row").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(width)]).collect()  # as many as the block has rows
    return np.array([r[1:] for r in sorted(rows, key=lambda r: r[0])], dtype=np.int64 if kind == "long" else np.float64)


def orthonormal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """What of block isn't in the span of basis, as unit vectors; fresh directions for what breaks down."""
    d = len(basis)
    out = basis
    for column in block.T:
        if out.shape[1] == d:
            break
        size = np.linalg.norm(column)
        for attempt in range(100):
            for _ in range(2):
                column = column - out @ (out.T @ column)
            left = np.linalg.norm(column)
            if left > 1e-10 * size:
                break
            column = rng.standard_normal(d)
            size = np.linalg.norm(column)
        column = column / left
        column = column - out @ (out.T @ column)
        out = np.column_stack([out, column / np.linalg.norm(column)])
    return out[:, basis.shape[1] :]


def block_lanczos(product: Callable[[np.ndarray], np.ndarray], d: int, wanted: int = COMPONENTS, width: int = BLOCK, seed: int = 12) -> tuple[np.ndarray, np.ndarray, int]:
    """Largest eigenvalues, unit eigenvectors as columns, and passes, of a symmetric matrix known by its products."""
    rng = np.random.default_rng(seed)
    basis, images, passes, settled = np.empty((d, 0)), np.empty((d, 0)), 0, None
    block = rng.standard_normal((d, min(width, d)))
    while True:
        new = orthonormal(block, basis, rng)
        basis, images, passes = np.column_stack([basis, new]), np.column_stack([images, product(new)]), passes + 1
        small = basis.T @ images
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
        found = basis @ vectors
        if basis.shape[1] == d:
            break
        # what the images leave of the Ritz pairs spans the next Lanczos block, and tells how far the pairs are
        block = images @ vectors[:, :width] - found[:, :width] * values[:width]
        held = slice(0, min(wanted + 1, len(values)))  # one more, so that the last wanted one is told from the next
        residuals = np.linalg.norm(block[:, held], axis=0)
        rounding = ROUNDING * max(abs(values[0]), np.finfo(float).tiny)
        if residuals.max() <= rounding:
            if settled is not None and np.abs(values[held] - settled).max() <= rounding:
                break
            settled = values[held].copy()
            block = rng.standard_normal((d, min(width, d)))  # a multiple eigenvalue may have hidden from the block
        else:
            settled = None
    return values[:wanted], found[:, :wanted], passes


def fitted(fit: DataFrame, d: int) -> dict:
    """What whitening needs of the distinct vectors x: n, sums, eigenvalues, directions, trace, identity_error."""
    n = fit.count()
    if not n:
        return {"n": 0, "values": np.empty(0)}
    sums = added(fit, d, d, lambda x: x.sum(axis=0, dtype=np.int64)[None, :], "long")[0]
    mean = sums / n
    trace = added(fit, d, 1, lambda x: np.square(x - mean).sum(keepdims=True).reshape(1, 1), "double")[0, 0] / n

    def product(block: np.ndarray) -> np.ndarray:
        def of(x: np.ndarray) -> np.ndarray:
            y = x - mean
            return y.T @ (y @ block)

        return added(fit, d, block.shape[1], of, "double") / n

    values, directions, passes = block_lanczos(product, d) if trace > 0 else (np.empty(0), np.empty((d, 0)), 0)
    some = values > NOTHING * trace
    values, directions = values[some], directions[:, some]
    k, error = len(values), 0.0
    if k:

        def moments(x: np.ndarray) -> np.ndarray:
            z = ((x - mean) @ directions) / np.sqrt(values)
            return np.vstack([z.T @ z, z.sum(axis=0)])

        got = added(fit, d, k, moments, "double") / n
        error = float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max())
    return {"n": n, "sums": sums, "mean": mean, "values": values, "directions": directions, "trace": trace, "passes": passes, "identity_error": error}


OUT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
OUT_DDL = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(embeddings: DataFrame) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each vector and component.

    Vectors that are null, empty or hold null, non-finite or (from 2 ** 53 on) inexact entries take no
    part, nor do those of another length than the commonest (the longer one of several). Equal vectors
    count once in the fit; every row is projected, also with repeated or null vec_ids. Components are
    up to four, fewer where the dimensions or the directions that vary are fewer; with none (one
    distinct vector, or no rows) the result is empty. A deviation beyond a long is null. Other columns
    aren't read, however named. The driver holds dimensions x dimensions numbers at most. Written rows
    that the result reads stay until release().
    """
    spark = embeddings.sparkSession
    folder = shared_dir(spark)
    rows = settle(integral(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")), folder, "rows")
    first = rows.select(F.size("x").alias("d")).first()
    d = first["d"] if first else 0
    fit = settle(rows.select("x").distinct(), folder, "fit")
    facts = fitted(fit, d)
    drop_folder(spark, f"{folder}/fit")

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, n = len(facts["values"]), facts["n"]
        if not k:
            return
        scale, shares = np.sqrt(facts["values"]), facts["values"] / facts["trace"]
        for batch, x in blocks_of(batches, "x", d):
            m = len(x)
            z = ((x - facts["mean"]) @ facts["directions"]) / scale
            with np.errstate(over="ignore"):
                deviation = np.square(np.int64(n) * x - facts["sums"]).sum(axis=1)  # exact where it is below 2 ** 63
            too_large = np.square(n * x.astype(np.float64) - facts["sums"]).sum(axis=1) >= 2**63
            columns = [
                batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n)),
                pa.array(np.repeat(deviation, k), mask=np.repeat(too_large, k)),
                pa.array(z.ravel()),
                pa.array(np.tile(shares, m)),
                pa.array(np.full(m * k, facts["identity_error"])),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=OUT)

    return rows.mapInArrow(project, OUT_DDL)


def op12_block_lanczos_whitening(spark, sf_dir):
    return whitened(read_table(spark, sf_dir, "embeddings"))
