"""Top-k search over tables that repeat ids, against its SQL."""

import random

from papertide.llm import topk


def test_repeated_ids_keep_all_vectors(spark):
    import duckdb

    pick = random.Random(4)
    rows = [(i, [pick.uniform(-1, 1) for _ in range(6)]) for i in [*range(60), *range(0, 60, 2), *[20] * 150, *[33] * 40]]
    rows += [rows[20], rows[41]]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    want = sorted(con.sql(topk.OP4_SQL).fetchall())
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), repeats=True)
    assert vectors.count() == len(rows)
    for blocks in ((1_024, 16_384), (7, 50)):
        assert sorted(tuple(r) for r in topk.exact_top_k(vectors, vectors.filter("vec_id % 20 = 0"), 20, *blocks).collect()) == want
