"""Operators of a few lines: supporting papers, links, cut texts, expanded foci, ids of articles, preprints, lists of metrics."""

from pyspark.sql import functions as F

from papertide.operators import articles, concepts, documents, focus, gap, lifecycle, merge, opportunity, snapshots
from papertide.operators.concepts import Concept
from papertide.sources.corpus import RELATION_OF, Corpus


def corpus(spark):
    papers = spark.createDataFrame([(1, "flu a", 2001, 10, 5), (2, "x", 2003, 10, 6), (3, "y", 2003, None, 7), (4, "z", None, 10, 8)], "pmid long, title string, year int, journal_id int, citation_count long")
    journals = spark.createDataFrame([(10, 50_000, "Q1")], "journal_id int, if_cents long, quartile string")
    rows = [(2, RELATION_OF["Metric"], "Metric", "auc", "results", "flu"), (1, RELATION_OF["Metric"], "Metric", "auc", "methods", "q"), (1, RELATION_OF["Metric"], "Metric", "f1", "results", "q"), (3, RELATION_OF["Disease"], "Disease", "flu b", "results", "q")]
    relations = spark.createDataFrame([(*r, None) for r in rows], "pmid long, relation string, type string, name string, section string, quote string, metric_value double")
    return Corpus(papers, journals, relations, papers)


def test_supporting_papers(spark):
    c, ids = corpus(spark), spark.createDataFrame([(" 3 ",), ("2",), ("2",), ("",), (None,), ("x",), ("4",), ("99",)], "pmid string")
    assert [(r.pmid, r.yr, r.quartile) for r in focus.supporting_papers(c, ids, 10).collect()] == [(2, 2003, "Q1"), (3, 2003, None), (4, None, "Q1")]
    assert [r.pmid for r in focus.supporting_papers(c, ids, 1).collect()] == [2] and focus.supporting_papers(c, ids, -1).count() == 0
    assert [r.pmid for r in focus.supporting_papers_for(c, "flu", 5).collect()] == [3, 1]
    harvested = spark.createDataFrame([(2, 8), (1, 9)], "place int, pmid long")
    rows, how = focus.harvested_or_corpus(c, harvested, "flu", 1)
    assert ([r.pmid for r in rows.collect()], how) == ([9], "debate_tools")
    rows, how = focus.harvested_or_corpus(c, harvested.filter("false"), "flu")
    assert ({r.pmid for r in rows.collect()}, how) == ({1, 3}, "corpus_full_phrase")
    assert focus.harvested_or_corpus(c, harvested.filter("false"), " all ")[1] == "empty" and focus.harvested_or_corpus(c, harvested.filter("false"), "zz")[1] == "corpus_no_match"


def test_metric_lists(spark):
    backed, every = gap.metric_lists(corpus(spark))
    assert [(r.pmid, r.metric) for r in backed.collect()] == [(1, "f1"), (2, "auc")] and every.count() == 3


def test_links(spark):
    known = spark.createDataFrame([(1, 2, 0)], "paper int, author int, place int")
    more = spark.createDataFrame([(1, 2, 5), (1, 3, 9), (1, 3, 4), (None, 3, 1), (2, 2, 1)], "paper int, author int, place int")
    assert sorted(tuple(r) for r in merge.new_links(known, more, ["paper", "author"], "place").collect()) == [(1, 3, 4), (2, 2, 1)]


def test_cut_texts(spark):
    row = spark.createDataFrame([("abcdef",), (None,)], "t string")
    of = lambda n: [r[0] for r in row.select(documents.truncated(F.col("t"), n)).collect()]
    assert of(3) == ["abc\n... [truncated]", None] and of(6) == ["abcdef", None] and of(0) == ["abcdef", None]


def test_expanded(spark):
    table = concepts.table(spark, [Concept("c", "Lung Cancer", phrases=("b x", "a", "lung cancer"), sites=("lung",), abbreviations=("LC",))])
    got = [tuple(r) for r in concepts.expanded(spark.createDataFrame([("LC",), (None,), ("zz",)], "focus string"), table).orderBy("focus").collect()]
    assert got == [(None, None, None, [], [], [], [], [], []), ("LC", "c", "Lung Cancer", ["a", "b x", "lung cancer"], ["lung"], [], ["LC"], [], []), ("zz", None, None, [], [], [], [], [], [])]


def test_article_ids():
    ids = lambda *pairs: "<article-meta>" + "".join(f'<article-id pub-id-type="{k}">{v}</article-id>' for k, v in pairs) + "</article-meta>"
    xml = f"<a><front>{ids(('pmid', '1'), ('pmid', ' 2 '), ('doi', 'A'), ('doi', 'B'), ('doi', ' '), ('pmc', 'P1'), ('pmcid', 'P2'))}</front><response>{ids(('pmid', '9'), ('doi', 'Z'))}</response><body/></a>"
    row = articles.parsed(xml)
    assert (row["pmid"], row["doi"], row["pmcid"]) == ("2", "b", "P1")
    assert articles.parsed("<a/>")["pmid"] is None and articles.parsed("<a") is None


def test_preprints_by_any_name(spark):
    rows = [("k", "Nature", None, "Q1", 40.0), ("k", None, "bioRxiv", "Q1", 99.0), ("k", "x", "Research Square", "Q1", 50.0)]
    row = opportunity.research_bar(spark.createDataFrame(rows, "k string, journal_name string, journal_abbr string, quartile string, impact_factor double"), ["k"]).first()
    assert (row.support_papers, round(row.q1_ratio, 3), row.avg_if) == (3, 0.333, 40.0)


def test_journals_by_issn_then_name(spark):
    known = spark.createDataFrame([(1, "Nature", None, "1-1"), (2, "Cell", "C.", None), (3, "Cell", "x", "3-3")], "journal_id int, name string, abbr string, issn string")
    rows = [(1, "other name", None, "1-1"), (2, "Cell", None, "9-9"), (3, "Zeta", "Z", "7-7"), (4, "Alpha", None, None), (5, "Zeta", "later", None), (6, "Zeta two", None, "7-7"), (7, "", None, "3-3"), (8, None, None, "8-8"), (9, "alpha", None, "")]
    meant, every = merge.upserted_journals(known, spark.createDataFrame(rows, "seq int, name string, abbr string, issn string"))
    assert {r.seq: r.journal_id for r in meant.collect()} == {1: 1, 2: 2, 3: 5, 4: 4, 5: 5, 6: 5, 7: 3, 8: None, 9: 6}
    assert {tuple(r) for r in every.collect()} == {tuple(r) for r in known.collect()} | {(4, "Alpha", None, None), (5, "Zeta", "Z", "7-7"), (6, "alpha", None, None)}


def test_counts_of_tables(spark):
    profiles = spark.createDataFrame([("a", "persistent"), ("b", "emerging"), ("c", "active")], "limitation string, temporal_status string")
    signals = spark.createDataFrame([("a", "topic_followup", 0.7), ("a", "topic_followup", 0.9), ("b", "topic_followup", 0.6), ("b", "other", 0.9)], "limitation string, signal_type string, confidence double")
    assert tuple(lifecycle.limitation_lifecycle_counts(profiles, signals).first()) == (3, 1, 0, 1, 4, 1)
    assert tuple(snapshots.hotspot_counts(profiles, signals).first()) == (3, 4)
