"""Values that must be exact: classes of sections, words without focus, points, preprints, and tools' foci."""

import pytest
from pyspark.sql import functions as F

from papertide.functions import scoring
from papertide.operators import documents, focus, gap, opportunity
from papertide.registry import run_tool
from papertide.sources.corpus import Corpus


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(column).collect()]


def test_section_classes(spark):
    titles = ["Introduction", "Background and Methods", "Patients", "Findings", "Conclusions", "weakness", "Acknowledgements", None]
    assert values(spark, documents.section_type(F.col("x")), titles) == ["introduction", "introduction", "methods", "results", "future_work", "limitations", "other", "other"]
    assert values(spark, documents.section_type(F.col("x"), F.lit("methods")), ["Cohort"]) == ["methods"]
    headings = ["Abstract", "Summary", "Materials and  Methods", "Method", "Conclusion", "Future directions", "Results", ""]
    assert values(spark, documents.heading_type(F.col("x")), headings) == ["abstract", "other", "methods", "other", "future_work", "future_work", "results", "other"]


def test_data_support_points(spark):
    assert values(spark, scoring.data_support_points(F.col("x")), [0, 199, 200, 499, 500], "x int") == [0, 0, 1, 1, 3]


@pytest.mark.parametrize("journal", ["Research Square", "bioRxiv", "medRxiv", "arXiv", "Preprints.org"])
def test_preprints_are_not_ranked(spark, journal):
    papers = spark.createDataFrame([(1, journal, "Q1", 9.0)], "gap int, journal string, quartile string, impact_factor double")
    assert opportunity.research_bar(papers, ["gap"]).select("q1_ratio", "avg_if").first() == (0.0, 0.0)


def test_focus_words(spark):
    names = ["lung cancer", "cancer of the lung", "lung", None]
    assert [focus.normalized(x) for x in (" All ", "corpus", "", None, " lung ")] == [None, None, None, None, "lung"]
    assert values(spark, focus.mentions(F.col("x"), "entire"), names) == [True] * 4
    assert values(spark, focus.mentions(F.col("x"), "Lung Cancer"), names) == [True, True, False, None]


@pytest.fixture(scope="module")
def little(spark):
    papers = spark.createDataFrame([(i, f"title {i}", 2000 + i % 2, None, "day", 10, "trial", "available", True, i) for i in range(4)], "pmid long, title string, year int, pub_date date, date_precision string, citation_count long, study_type string, full_text_status string, extraction_done boolean, journal_id long")
    journals = spark.createDataFrame([(0, "a", 100000, "Q1"), (1, "b", None, None), (2, "c", None, "Q2"), (3, "d", 300000, "Q3")], "journal_id long, journal string, if_cents long, quartile string")
    rows = [(i, "TARGETS_DISEASE", "Disease", "lung cancer") for i in range(4)] + [(i, "APPLIES_METHOD", "Method", "cnn") for i in range(2)] + [(i, "RELATED_TO", "Method", "deep learning") for i in range(4)]
    rows += [(i, "REPORTS_LIMITATION", "Limitation", name) for i, name in ((0, "small lung sample"), (1, "small lung sample"), (2, "no follow up"))] + [(3, "ACHIEVES_METRIC", "Metric", "auc"), (2, "USES_MODALITY", "Modality", "ct")]
    relations = spark.createDataFrame([(*r, "results", "asserted", "said so", None) for r in rows], "pmid long, relation string, type string, name string, section string, polarity string, quote string, metric_value double")
    return Corpus(papers, journals, relations, spark.createDataFrame([], "name string, access_class string"))


def test_foci_go_by_the_entity(little):
    assert [r["limitation"] for r in gap.limitation_impact_rank(little, "lung").collect()] == ["small lung sample"]
    assert {r["name"] for r in gap.hotspot_entities(little).collect()} == {"lung cancer", "cnn", "small lung sample"}  # a mention isn't an application
    assert {r["name"] for r in gap.hotspot_entities(little, "all").collect()} == {"lung cancer", "cnn", "small lung sample"}
    assert {r["name"] for r in gap.hotspot_entities(little, "lung").collect()} == {"lung cancer", "small lung sample"}


def test_mean_impact_factor_is_over_those_known(little):
    row = gap.impact_priority_matrix(little).filter("method = 'cnn' AND disease = 'lung cancer'").first()
    cells = little.papers.filter("pmid < 2")
    score = cells.limit(1).select(scoring.impact_score(F.lit(10.0), F.lit((10 / 2 + 10 / 1) / 2), F.lit(2.0), F.lit(0.5))).first()[0]
    assert row["priority_pct"] == int(100 * (2 + score) + 0.5)


def test_topic_tools(little):
    assert [tuple(r) for r in run_tool("modality_coverage_for_topic", little, keyword="lung cancer").collect()] == [("ct", 1)]
    rows = run_tool("limitations_for_topic", little, keyword="lung cancer").collect()
    assert [(r["pmid"], r["limitation"], r["quote"]) for r in rows] == [(0, "small lung sample", "said so"), (1, "small lung sample", "said so"), (2, "no follow up", "said so")]
    assert [r["metric"] for r in run_tool("metrics_for_topic", little, keyword="lung cancer").collect()] == ["auc"] * 3  # once for each relation of its paper
