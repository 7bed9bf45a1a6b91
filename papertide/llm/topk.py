"""Exact top-k search by Fagin's threshold algorithm.

Queries and candidates meet in blocks of bounded size. Within a pair of blocks each dimension has a
list of the candidates, sorted once for all queries of the block; a query reads its lists from the
favourable end in growing steps, scores the candidates that it hasn't met before and no others, and
stops when the bound on all that it hasn't met (the sum of the last read components, weighted by the
query's) is below the k-th score. Each query's best of all blocks are then ranked. How far the lists
are read depends on the vectors: search_effort tells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read_table

#: Rows of a block of queries and of candidates (each candidate goes to every block of queries, and the
#: other way round), and entries that a query first reads of each list.
QUERY_BLOCK, CANDIDATE_BLOCK, FIRST_STEP = 8_192, 16_384, 16


def threshold_top(vectors: np.ndarray, ids: np.ndarray, lists: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Ids and scores of the k best candidates (ties: smaller id) of one query, entries read, scores computed.

    vectors: a row per candidate; lists: for each dimension the rows by falling component. Entries read
    are those of one list; all lists of non-zero weight are read to the same depth.
    """
    n = len(ids)
    up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
    seen = ids == own  # no row under the query's own id is met
    best_ids, best_scores = np.empty(0, dtype=np.int64), np.empty(0, dtype=vectors.dtype)
    depth, step, scored = 0, FIRST_STEP, 0
    while depth < n:
        until = min(n, depth + step)
        met = np.zeros(n, dtype=bool)
        if len(up) + len(down):
            met[lists[up, depth:until].ravel()] = True
            met[lists[down, n - until : n - depth].ravel()] = True
        else:
            met[:] = True  # every score is 0
            until = n
        met &= ~seen
        seen |= met
        new = np.flatnonzero(met)
        got = vectors[new] @ query
        scored += len(new)
        if len(best_ids) >= k:
            hope = got >= best_scores[-1]
            new, got = new[hope], got[hope]
        elif len(got) > 4 * k:
            hope = got >= np.partition(got, len(got) - k)[len(got) - k]
            new, got = new[hope], got[hope]
        all_ids, all_scores = np.concatenate([best_ids, ids[new]]), np.concatenate([best_scores, got])
        order = np.lexsort((all_ids, -all_scores))[:k]
        best_ids, best_scores = all_ids[order], all_scores[order]
        depth, step = until, step * 2
        bound = query[up] @ vectors[lists[up, depth - 1], up] + query[down] @ vectors[lists[down, n - depth], down]
        if len(best_ids) == k and bound < best_scores[-1]:
            break
    return best_ids, best_scores, depth, scored


def exact_type(a: np.ndarray, b: np.ndarray) -> type:
    """The quickest number type in which all scores are exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


FOUND, EFFORT = "query_id long, vec_id long, score long", "query_id long, candidates long, depth long, scored long"


def search_block(k: int, effort: bool = False):
    def search(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(candidates) or not len(queries):
            return pd.DataFrame({x.split()[0]: [] for x in (EFFORT if effort else FOUND).split(", ")}).astype("int64")
        vectors, asked = np.stack(candidates["v"].to_numpy()).astype(np.int64), np.stack(queries["v"].to_numpy()).astype(np.int64)
        kind = exact_type(vectors, asked)
        lists = np.ascontiguousarray(np.argsort(-vectors, axis=0, kind="stable").T)
        vectors, asked, ids = vectors.astype(kind), asked.astype(kind), candidates["vec_id"].to_numpy(np.int64)
        found = [(q, *threshold_top(vectors, ids, lists, v, q, k)) for q, v in zip(queries["vec_id"].to_numpy(np.int64), asked, strict=True)]
        if effort:
            return pd.DataFrame([(q, len(ids), depth, scored) for q, _, _, depth, scored in found], columns=["query_id", "candidates", "depth", "scored"])
        return pd.DataFrame({
            "query_id": np.repeat([q for q, *_ in found], [len(i) for _, i, *_ in found]).astype(np.int64),
            "vec_id": np.concatenate([i for _, i, *_ in found]),
            "score": np.concatenate([s for _, _, s, *_ in found]).astype(np.int64),
        })

    return search


def quantised(table: DataFrame, scale: int = 64, key: str = "vec_id", vector: str = "embedding", repeats: bool = False) -> DataFrame:
    """(vec_id, v) with v = floor(scale * x) of each component; see exact_top_k for the rows left out.

    Rows alike in vec_id and v are one row, unless repeats keeps every row as it is.
    """
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = (
        table.filter(F.col(vector).isNotNull() & F.col(key).isNotNull())
        .filter(~bad)
        .select(F.col(key).cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))
    )
    return rows if repeats else rows.distinct()


def searched_blocks(candidates: DataFrame, queries: DataFrame, query_block: int, candidate_block: int, search, schema: str) -> DataFrame:
    """What search gives for every block of candidates with every block of queries."""
    parts = max(1, -(-candidates.count() // candidate_block))
    asks = max(1, -(-queries.count() // query_block))
    place = F.xxhash64("vec_id", "_pt_row")
    numbered = lambda rows: rows.withColumn("_pt_row", F.monotonically_increasing_id())
    c = numbered(candidates).select("vec_id", "v", F.size("v").alias("dims"), F.pmod(place, F.lit(parts)).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(asks - 1))).alias("q"))
    q = numbered(queries).select("vec_id", "v", F.size("v").alias("dims"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("c"), F.pmod(place, F.lit(asks)).cast("int").alias("q"))
    keys = ["dims", "c", "q"]
    return c.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInPandas(search, schema)


def exact_top_k(candidates: DataFrame, queries: DataFrame, k: int = 20, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products with other candidates.

    Both tables are (vec_id, v) with integer components, as quantised() makes them: it leaves out vectors
    that are null or hold a null, NaN or infinite component and rows without an id. Rows that repeat a
    vec_id are candidates each, but not for a query of that id, and queries that repeat one share its k
    places, as in OP4_SQL. Ties go to the smaller vec_id; a query with fewer than k others gets all of
    them; vectors of different lengths don't meet. Scores must fit in a long. Blocks have about the stated
    rows, at any size of the input and however often an id is repeated. Empty tables give an empty result;
    other columns are left out by quantised().
    """
    found = searched_blocks(candidates, queries, query_block, candidate_block, search_block(k), FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_effort(candidates: DataFrame, queries: DataFrame, k: int = 20, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, candidates, depth, scored): what exact_top_k reads of each query's lists and scores, of how many."""
    found = searched_blocks(candidates, queries, query_block, candidate_block, search_block(k, True), EFFORT)
    return found.groupBy("query_id").agg(*[F.sum(x).alias(x) for x in ("candidates", "depth", "scored")])


def op4_threshold_top_k(spark, sf_dir):
    vectors = quantised(read_table(spark, sf_dir, "embeddings"), repeats=True)
    return exact_top_k(vectors, vectors.filter("vec_id % 20 = 0"))


OP4_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 20 = 0
),
r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
