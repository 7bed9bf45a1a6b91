"""What keeps shuffles and pairs from outgrowing the tables, read from the plans."""

import itertools
import os
from dataclasses import replace

import pandas as pd
import pytest

import __spark_entry__ as entry
from papertide.operators import articles, focus, gap, graph, hypotheses, lifecycle, merge, projection
from papertide.sources.corpus import RELATION_OF, Corpus, from_star

DATA = "/root/testdata/sf0.001"
has_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
COLUMNS = "pmid long, relation string, type string, name string, section string, polarity string, quote string, metric_value double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df, key):
    return [line for line in plan(df).splitlines() if f"Exchange hashpartitioning({key}" in line]


@has_data
def test_relations_are_shuffled_by_paper_before_they_are_made(spark):
    corpus = from_star(spark, DATA)
    assert not exchanges(corpus.relations.select("pmid", "type", "name").distinct(), "pmid")
    assert len(exchanges(corpus.relations, "l_orderkey")) == 1


def corpus_of(spark, rows):
    empty = spark.createDataFrame([], "pmid long")
    relations = spark.createDataFrame([(p, RELATION_OF[k], k, n, "methods", "asserted", "q", None) for p, k, n in rows], COLUMNS)
    return Corpus(empty, empty, relations, spark.createDataFrame([("d", "public")], "name string, access_class string"))


def test_pairs_are_made_once_for_papers_of_the_same_entities(spark):
    rows = [(p, "Task", n) for p in range(50) for n in "abc"] + [(99, "Task", n) for n in "ab"]
    edges = graph.cooccurrence_edges(corpus_of(spark, rows))
    assert {(r.src, r.dst): r.weight for r in edges.collect()} == {("Task|a", "Task|b"): 51, ("Task|a", "Task|c"): 50, ("Task|b", "Task|c"): 50}
    assert exchanges(edges, "nodes")


def long_papers():
    return [(1, "Task", f"t{i:03}") for i in range(150)] + [(2, "Method", f"m{i:03}") for i in range(45)] + [(2, "Task", "t149"), (3, "Task", "t000"), (3, "Task", "t149"), (None, "Task", "t000"), (None, "Task", "t149")]


def plain_edges(rows):
    edges = {}
    for pmid in {p for p, _, _ in rows if p is not None}:
        for pair in itertools.combinations(sorted({f"{k}|{n}" for p, k, n in rows if p == pmid}), 2):
            edges[pair] = edges.get(pair, 0) + 1
    return edges


def test_all_entities_of_a_paper_are_paired(spark):
    want = plain_edges(long_papers())
    edges = graph.cooccurrence_edges(corpus_of(spark, long_papers()))
    assert {(r.src, r.dst): r.weight for r in edges.collect()} == want and want["Task|t000", "Task|t149"] == 2
    long = spark.createDataFrame([(list(range(1000)),)], "nodes array<int>")
    assert graph.weighted_pairs(long).count() == 1000 * 999 // 2  # in blocks, which are dealt by the blocks' nodes


def test_degrees_count_all_entities_of_a_paper(spark):
    degree, strength = {}, {}
    for pair, weight in plain_edges(long_papers()).items():
        for node in pair:
            degree[node], strength[node] = degree.get(node, 0) + 1, strength.get(node, 0) + weight
    found = graph.degrees(graph.cooccurrence_edges(corpus_of(spark, long_papers()))).collect()
    assert {r.node: (r.degree, r.strength) for r in found} == {n: (degree[n], strength[n]) for n in degree}


@has_data
def test_an_entitys_papers_are_counted_without_shuffling_relations(spark):
    counted = merge.entities_of(from_star(spark, DATA))
    assert not [line for line in plan(counted).splitlines() if "Exchange" in line and "pmid" in line]


def test_papers_of_the_same_links_are_one_list(spark):
    columns = "paper long, place int, node string, relation string, section string, quote string"
    rows = [(p, i, n, "r", "s", f"q{n}") for p in range(40) for i, n in enumerate("ab")] + [(77, 0, "a", "r", "s", "q"), (78, 0, None, "r", "s", "q")]
    links = spark.createDataFrame(rows, columns).filter("node IS NOT NULL")
    (one,) = projection.linked_alike(links).collect()
    assert (one.n, list(one.papers)) == (40, [0, 1, 2])
    (edge,) = projection.entity_projection(links).collect()
    assert tuple(edge) == ("a", "b", 40, "CO_OCCURS", "r(80)", "s(80)", "qa | qb | qa")


def test_what_pairs_show_meets_by_one_shuffle(spark):
    columns = "paper long, place int, node string, relation string, section string, quote string"
    rows = [(p, i, f"n{(p * i) % 7}", f"r{i % 2}", f"s{p % 3}", f"q{p}") for p in range(30) for i in range(5)]
    edges = projection.entity_projection(spark.createDataFrame(rows, columns))
    shuffles = [line for line in plan(edges).splitlines() if "Exchange" in line]
    assert shuffles and all("hashpartitioning(src" in line and "REPARTITION_BY_COL" in line for line in shuffles) and "Join" not in plan(edges)
    weights = {}
    for p in range(30):
        for i, j in itertools.combinations(range(5), 2):
            pair = tuple(sorted((f"n{(p * i) % 7}", f"n{(p * j) % 7}")))
            weights[pair] = weights.get(pair, 0) + 1
    assert {(r.src, r.dst): r.weight for r in edges.collect()} == weights


def test_hotspots_shuffle_no_relations(spark):
    relations = [(p, "Task", n) for p in range(6) for n in "ab"] + [(0, "Method", "a")]
    papers = spark.createDataFrame([(p, f"t{p}", 2000, 10 * p, "x", 1) for p in range(6)], "pmid long, title string, year int, citation_count long, study_type string, journal_id long")
    corpus = corpus_of(spark, relations)
    corpus = replace(corpus, papers=papers, journals=spark.createDataFrame([(1, 50000, "Q1")], "journal_id long, if_cents long, quartile string"))
    hot = gap.hotspot_entities(corpus)
    assert [tuple(r) for r in hot.collect()] == [("a", "Task", 6, 150, 150), ("b", "Task", 6, 150, 150)]
    assert not [line for line in plan(hot).splitlines() if "Exchange hashpartitioning(name" in line and "pmid" in line]


def test_keywords_are_looked_for_by_one_pass(spark, monkeypatch):
    corpus = corpus_of(spark, [(1, "Task", "red anvil"), (2, "Task", "blue ring")])
    corpus = replace(corpus, papers=spark.createDataFrame([(1, "of red things"), (2, None), (3, "anvil red")], "pmid long, title string"))
    passes = []
    once = focus.topic_candidates
    monkeypatch.setattr(focus, "topic_candidates", lambda *a: passes.append(a) or once(*a))
    found = [tuple(r) for r in focus.topic_strategies(corpus, ["red anvil", "anvil red ring", " ", "qqq www"]).collect()]
    assert found == [("red anvil", "full_phrase", 1, 1, 0), ("anvil red ring", "token_score", 2, 4, 5), (" ", "empty", 0, 0, 0), ("qqq www", "no_match", 0, 0, 0)]
    assert len(passes) == 1


def test_arrivals_are_shuffled_by_key_once(spark, monkeypatch):
    columns = "pmid string, k string, seq int, metric_value string, confidence double, section string, quote string, granularity string, polarity string"
    rows = [("1", None, n, None, float(n), None, f"q{n % 3}", "abstract" if n % 2 else "fulltext", "p") for n in range(12)] + [("2", "x", n, "m", None, "s", "q", "fulltext", "p") for n in range(2)]
    arrivals = spark.createDataFrame(rows, columns)
    merged = merge.merge_relations(arrivals, ["pmid", "k"])
    cold = sorted(map(repr, merged.collect()))
    once = merge.folded_relations(arrivals, ["pmid", "k"], "seq", 1)
    assert all("(_pt_key" in line and "REPARTITION" in line for line in plan(once).splitlines() if "Exchange" in line)
    monkeypatch.setattr(merge, "MANY", 5)
    assert sorted(map(repr, merge.merge_relations(arrivals, ["pmid", "k"]).collect())) == cold and len(cold) == 2


def test_articles_are_parsed_in_parts():
    batches = list(articles.parse(iter([pd.Series(["<a/>"] * (2 * articles.AT_ONCE + 1))])))
    assert [len(b) for b in batches] == [articles.AT_ONCE, articles.AT_ONCE, 1]


@has_data
def test_alike_hypotheses_evolve_once(spark, monkeypatch):
    seen = []
    once = hypotheses.evolved
    monkeypatch.setattr(hypotheses, "evolved", lambda rows, *a: seen.append(rows) or once(rows, *a))
    found = hypotheses.evolved_orders(spark, DATA).count()
    assert found == spark.read.parquet(f"{DATA}/orders.parquet").count()
    assert seen[0].count() < found


def test_gap_status_makes_relations_once(spark):
    year_of = {1: 1990, 2: 1991, 3: 1993, 4: 1994, 5: 1994, 6: None, 7: 2000}
    facts = [(1, "Limitation", "x"), (1, "Disease", "d"), (1, "Method", "m"), (2, "Limitation", "x"), (2, "Disease", "e")]
    facts += [(p, k, n) for p in (3, 4, 5, 6) for k, n in (("Disease", "d"), ("Task", "t"))] + [(5, "Disease", "c"), (7, "Limitation", "y"), (None, "Limitation", "x"), (8, "Limitation", "x")]
    corpus = corpus_of(spark, facts)
    papers = [(p, y, 3) for p, y in year_of.items()] + [(1, 1990, 4)]  # a repeated paper counts once, its rows twice
    corpus = replace(corpus, papers=spark.createDataFrame(papers, "pmid long, year int, citation_count long"))
    made = []

    def stated(*kinds, quoted=True):
        made.append(kinds)
        return corpus.relations.filter(corpus.relations["type"].isin(*kinds))

    status = lifecycle.limitation_gap_status(replace(corpus, stated=stated)).filter("limitation = 'x'").collect()
    assert [tuple(r) for r in status] == [("x", "declining", 1990, 1991, 2, 3, 1993, "moderate")] and len(made) == 1
    (told,), (plain,) = [lifecycle.temporal_profiles(corpus, told=t).filter("limitation = 'x'").collect() for t in (lifecycle.told_by_paper(corpus), None)]
    assert told == plain and (told["paper_cnt"], told["asserted_cnt"], told["cites"]) == (2, 3, 10)


@has_data
def test_places_need_no_quotes(spark):
    corpus = from_star(spark, DATA)
    kinds = ["Limitation", "Disease", "Method", "Task"]
    placed = corpus.placed(*kinds)
    assert placed.exceptAll(corpus.typed(*kinds).select(placed.columns)).isEmpty() and placed.count() == corpus.typed(*kinds).count()


@has_data
def test_shared_entities_are_made_of_anchor_papers_only(spark):
    corpus = from_star(spark, DATA)
    found = lifecycle.shared_entity_rows(corpus, lifecycle.temporal_profiles(corpus))
    assert "LeftSemi" in plan(found)
    assert found.count() == found.distinct().count() > 0
    some = corpus.papers.filter("pmid % 3 = 0").select("pmid")
    rows = lambda c: sorted(map(tuple, c.collect()), key=repr)
    of = ("Disease", "Task", "Method")
    plain = rows(corpus.placed(*of).join(some, "pmid", "left_semi"))
    assert plain and rows(corpus.placed_within(some, *of)) == plain
    assert rows(corpus.relations.filter(corpus.relations.type.isin(*of)).join(some, "pmid", "left_semi").select("pmid", "relation", "type", "name", "section", "polarity")) == plain
