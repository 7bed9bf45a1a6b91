"""Operators without a SQL twin against brute force, and pure helpers."""

from datetime import date

from pyspark.sql import functions as F

from papertide.functions import scoring
from papertide.operators import documents, feasibility, focus, graph, hotspot, merge


def test_pagerank_matches_power_iteration(spark):
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "d", 3)]
    got = {r["node"]: r["rank"] for r in graph.pagerank(spark.createDataFrame(edges, "src string, dst string, weight long"), steps=20).collect()}
    weight = {}
    for a, b, w in edges:
        weight[a, b] = weight[b, a] = w
    nodes = sorted({n for e in weight for n in e})
    out = {n: sum(w for (a, _), w in weight.items() if a == n) for n in nodes}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(20):
        rank = {n: 0.15 / len(nodes) + 0.85 * sum(rank[a] * w / out[a] for (a, b), w in weight.items() if b == n) for n in nodes}
    assert all(abs(rank[n] - got[n]) < 1e-12 for n in nodes)


def test_communities_keep_cliques_apart(spark):
    clique = lambda xs: [(a, b, 3) for a in xs for b in xs if a < b]
    edges = clique("abcd") + clique("wxyz") + [("d", "w", 1)]
    labels = {r["node"]: r["label"] for r in graph.communities(spark.createDataFrame(edges, "src string, dst string, weight long")).collect()}
    assert len({labels[n] for n in "abcd"}) == 1 and len({labels[n] for n in "wxyz"}) == 1 and labels["a"] != labels["z"]


def test_merge_relations_folds_in_order(spark):
    schema = "pmid string, k string, seq int, metric_value string, confidence double, section string, quote string, granularity string, polarity string"
    rows = [
        ("1", "x", 1, None, 0.5, "methods", "first", "abstract", "asserted"),
        ("1", "x", 2, "0.9", 0.4, "", "second", "fulltext", "hypothesized"),
        ("1", "x", 3, "0.1", 0.99, "other", "weak", "abstract", "asserted"),
        ("1", "x", 4, "", 0.7, "results", "second", "fulltext", "asserted"),
        (None, "x", 5, None, 0.1, None, "loose", "abstract", "asserted"),
        (None, "x", 6, None, 0.1, None, "loose", "abstract", "asserted"),
    ]
    got = sorted((r.asDict() for r in merge.merge_relations(spark.createDataFrame(rows, schema), ["pmid", "k"]).collect()), key=lambda r: r["pmid"] or "")
    assert len(got) == 3
    assert got[2] == {"pmid": "1", "k": "x", "metric_value": "0.9", "confidence": 0.7, "section": "results", "quote": "first; second", "granularity": "fulltext", "polarity": "asserted", "arrivals": 4}


def test_merge_papers_by_pmid_or_doi(spark):
    schema = "pmid string, doi string, title string, abstract string, pub_date string, year int, date_precision string, source_queries array<string>"
    old = spark.createDataFrame([("1", "d1", "old", "kept", None, None, "", ["q1"])], schema)
    new = spark.createDataFrame([("9", "d1", "new", "", "2001-01-02", 2001, "day", ["q2"], 1), ("2", "", "b", "c", None, None, None, None, 2)], schema + ", seq int")
    got = {r["pmid"]: r for r in merge.merge_papers(old, new).collect()}
    assert set(got) == {"1", "2"}
    assert (got["1"]["title"], got["1"]["abstract"], got["1"]["year"], got["1"]["source_queries"]) == ("new", "kept", 2001, ["q1", "q2"])


def test_entities_keep_the_strongest_access(spark):
    rows = spark.createDataFrame([(" TCGA ", "Dataset", "private"), ("tcga", "Dataset", "public"), ("tcga", "Dataset", None)], "name string, type string, access_class string")
    assert [tuple(r) for r in merge.merge_entities(rows).collect()] == [("tcga", "Dataset", "public")]


def test_markdown_sections(spark):
    long = "word " * 40
    text = f"preamble {long}\n# Methods used\n{long}\n## Short\nx\n### Results\n![a](b) [link](u) {long}"
    docs = spark.createDataFrame([(1, text), (2, "no heading"), (3, "")], "id int, text string")
    got = {(r["id"], r["order_idx"]): r for r in documents.markdown_sections(docs, "id", "text").collect()}
    assert [got[k]["section_type"] for k in sorted(got)] == ["other", "methods", "results", "other", "other"]
    assert got[1, 2]["content"].startswith("link word") and got[2, 0]["content"] == "no heading"


def test_fingerprint_and_overlap(spark):
    row = spark.range(1).select(documents.fingerprint(F.lit("B a, A!")).alias("x"), documents.fingerprint(F.lit("a b")).alias("y"), documents.jaccard(documents.fingerprint_tokens(F.lit("a b c")), documents.fingerprint_tokens(F.lit("b c d"))).alias("j")).first()
    assert row["x"] == row["y"] and row["j"] == 0.5


def test_revisited(spark):
    titles = spark.createDataFrame([("survival model for glioma",), ("unrelated thing",)], "title string")
    memory = spark.createDataFrame([("glioma survival model",)], "title string")
    assert {r["title"]: r["revisited"] for r in documents.revisited(titles, memory).collect()} == {"survival model for glioma": True, "unrelated thing": False}


def test_html_blocks(spark):
    pages = spark.createDataFrame([(1, "<script><p>no</p></script><h1>T</h1><!-- <p>no</p> --><p class='x'>a <b>b</b></p><li>c</li>")], "page_id int, html string")
    assert [(r["tag"], r["content"]) for r in documents.html_blocks(pages).orderBy("order_idx").collect()] == [("h1", "T"), ("p", "a b"), ("li", "c")]


def test_week_ids(spark):
    row = spark.range(1).select(hotspot.week_id(F.lit(date(2024, 12, 30))).alias("w"), hotspot.previous_week_id(F.lit(date(2024, 12, 30))).alias("p")).first()
    assert tuple(row) == ("2025-W01", "2024-W52")


def test_week_comparison(spark):
    now = spark.createDataFrame([("m", "a", 1), ("m", "b", 2), ("m", "c", 3)], "board string, item_key string, rank_pos int")
    then = spark.createDataFrame([("m", "a", 5), ("m", "d", 1), ("m", "c", 3)], "board string, item_key string, rank_pos int")
    assert sorted((r["change"], r["item_key"]) for r in hotspot.compare_weeks(now, then).collect()) == [("cooled", "d"), ("moved", "a"), ("new", "b")]


def test_snapshot_replaces_one_week(spark, tmp_path):
    board = lambda k: spark.createDataFrame([("m", k, 1)], "board string, item_key string, rank_pos int")
    for key, week in (("a", "2024-W01"), ("b", "2024-W02"), ("c", "2024-W02")):
        hotspot.write_snapshot(board(key), week, f"file://{tmp_path}/snap")
    assert {r["item_key"] for r in spark.read.parquet(f"file://{tmp_path}/snap").collect()} == {"a", "c"}


def test_feasibility_rules(spark):
    pools = {"has_wsi": 100, "has_survival": 60, "has_msi": 30, "all_survival_no_msi": 80}
    rows = [(1, pools, ["survival"], [], ["MSI"], 0), (2, pools, ["survival"], [], [], 0), (3, pools, [], ["tumor"], ["EGFR"], 0)]
    asked = spark.createDataFrame(rows, "id int, pools map<string,int>, labels array<string>, annotations array<string>, markers array<string>, min_followup_months int")
    got = {r["id"]: (r["cohort"], r["status"]) for r in feasibility.assess_from_pools(asked).collect()}
    assert got == {1: (30, "RISKY"), 2: (80, "APPROVED"), 3: (0, "REJECTED_DATA_INSUFFICIENT")}


def test_temporal_status_rules(spark):
    rows = [(2000, 2001, 1, 1), (1995, 1996, 4, 0), (1990, 2001, 10, 4), (1990, 2001, 10, 1), (0, 2001, 3, 3), (None, None, 0, 0)]
    df = spark.createDataFrame(rows, "f int, l int, p int, r int")
    got = [r[0] for r in df.select(scoring.temporal_status(F.col("f"), F.col("l"), F.col("p"), F.col("r"), F.lit(2001), 3, 3, 0.3)).collect()]
    assert got == ["emerging", "declining", "persistent", "stable", "stable", "stable"]


def test_keyword_helpers():
    assert focus.meaningful_tokens("The use of Deep learning in CT") == ["use", "deep", "learning", "ct"]
    assert focus.bigrams(["a", "b", "c"]) == ["a b", "b c"]
    assert [focus.min_hits(n) for n in (1, 2, 3, 4, 5)] == [1, 2, 2, 2, 3]
