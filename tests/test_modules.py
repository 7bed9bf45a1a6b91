"""Readers, dates, extraction, opportunity, streaming and registry on small fixtures."""

import os

import pytest
from pyspark.sql import functions as F

from papertide import registry
from papertide.functions.dates import free_date, parts_date
from papertide.operators import extraction, opportunity
from papertide.sources import readers
from papertide.streaming import hotspots

XML = """<PubmedArticleSet>
<PubmedArticle><MedlineCitation><PMID>1</PMID><Article><ArticleTitle>First title</ArticleTitle>
<Abstract><AbstractText Label="AIM">a</AbstractText><AbstractText Label="END">b</AbstractText></Abstract>
<Journal><ISSN>1234-5678</ISSN><Title>J One</Title><JournalIssue><PubDate><Year>2020</Year><Month>Mar</Month><Day>5</Day></PubDate></JournalIssue></Journal>
<AuthorList><Author><LastName>Li</LastName><ForeName>A</ForeName></Author></AuthorList></Article></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/x</ArticleId><ArticleId IdType="pmc">PMC9</ArticleId></ArticleIdList></PubmedData></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>2</PMID><Article><Journal><JournalIssue><PubDate><MedlineDate>2019 Nov-Dec</MedlineDate></PubDate></JournalIssue></Journal></Article></MedlineCitation></PubmedArticle>
</PubmedArticleSet>"""


def test_read_articles(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    rows = readers.read_articles(spark, f"file://{tmp_path}/a.xml").collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["pmid"], r["title"], r["abstract"], r["doi"], r["pmc_id"], r["pub_date"], r["year"], r["date_precision"], r["authors"]) == ("1", "First title", "AIM: a\nEND: b", "10.1/x", "PMC9", "2020-03-05", 2020, "day", ["A Li"])


@pytest.mark.parametrize("text, want", [
    ("2020 Spring", ("2020-03-01", 2020, "month")), ("2019 Nov-Dec", ("2019-11-01", 2019, "month")), ("2018", ("2018-01-01", 2018, "year")),
    ("soon", ("", 0, "unknown")), (None, ("", 0, "unknown")), ("2017 xyz", ("2017-01-01", 2017, "unknown")), ("2016 7", ("2016-07-01", 2016, "month")),
])
def test_free_dates(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(free_date(F.col("t")).alias("d")).select("d.*").first()
    assert tuple(row) == want


def test_parts_dates(spark):
    rows = [("2020", "Feb", "3", None), ("2020", "13", None, None), ("2020", None, None, None), ("", None, None, "2001 Winter")]
    got = spark.createDataFrame(rows, "y string, m string, d string, f string").select(parts_date(F.col("y"), F.col("m"), F.col("d"), F.col("f")).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in got] == [("2020-02-03", 2020, "day"), ("2020-01-01", 2020, "year"), ("2020-01-01", 2020, "year"), ("2001-12-01", 2001, "month")]


def test_csv_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("name,if\nRevue médicale,1.5\n".encode("latin-1"))
    assert [tuple(r) for r in readers.read_csv(spark, f"file://{tmp_path}/a.csv").collect()] == [("Revue médicale", "1.5")]


def test_journal_cascade(spark):
    journals = spark.createDataFrame([(1, "1234-5678", "Journal of Pathology"), (2, None, "Nature Medicine"), (3, None, "Modern Imaging Letters")], "journal_id int, issn string, name string")
    rows = spark.createDataFrame([(1, "12345678", None, "x"), (2, None, "1234-5678", "y"), (3, None, None, " nature medicine"), (4, None, None, "Imaging Letters, Modern"), (5, None, None, "Nothing alike")], "row_id int, issn string, eissn string, name string")
    assert {r["row_id"]: r["journal_id"] for r in readers.match_journals(rows, journals).collect()} == {1: 1, 2: 1, 3: 2, 4: 3, 5: None}


def test_loads(spark):
    landed = spark.createDataFrame([("1",), ("2",), ("2",)], "pmid string")
    known = spark.createDataFrame([("1",)], "pmid string")
    assert [r["pmid"] for r in readers.new_only(landed, known).collect()] == ["2"]
    papers = spark.createDataFrame([("1", 0, "", None), ("2", 5, "A", "kept"), ("3", 0, None, "mine")], "pmid string, citation_count int, citation_source string, abstract string")
    found = spark.createDataFrame([("1", 7, "B", "new"), ("2", 9, "B", "new")], "pmid string, citation_count int, source string, abstract string")
    got = {r["pmid"]: (r["citation_count"], r["citation_source"], r["abstract"]) for r in readers.with_citations(papers, found).collect()}
    assert got == {"1": (7, "B", "new"), "2": (5, "A", "kept"), "3": (0, "unavailable", "mine")}
    ids = readers.mapped_ids(spark.createDataFrame([("1",), ("2",), ("3",)], "pmid string"), spark.createDataFrame([("1", "9")], "pmid string, pmc_id string"), spark.createDataFrame([("1", "PMC1"), ("2", "PMC2")], "pmid string, pmc_id string"))
    assert {r["pmid"]: r["pmc_id"] for r in ids.collect()} == {"1": "PMC9", "2": "PMC2", "3": None}


TRIPLE = "pmid int, section string, subject_type string, relation string, object_type string, object_name string, confidence double"


def test_triple_repair_and_pruning(spark):
    rows = [
        (1, "methods", "Paper", "PERFORMS_TASK", "Method", " Deep  Learning ", 0.9), (1, "methods", "Paper", "APPLIES_METHOD", "Method", "resnet-50", 0.9), (1, "methods", "Paper", "COMPARES_METHOD", "Method", "resnet-50", 0.8),
        (1, "methods", "Paper", "RELATED_TO", "Disease", "x", 0.5), (1, "methods", "Paper", "TARGETS_DISEASE", "Disease", "cancer", 0.5), (1, "methods", "Paper", "TARGETS_DISEASE", "Disease", "lung cancer", 0.5),
        (2, "methods", "Paper", "APPLIES_METHOD", "Method", "dl", 0.9), (3, "introduction", "Paper", "APPLIES_METHOD", "Method", "unet", 0.9), (4, "results", "Paper", "USES_MODALITY", "Modality", "ct", 0.9), (4, "results", "Paper", "INVENTED", "Task", "t", 0.9),
    ]
    aliases = spark.createDataFrame([("Method", "dl", "deep learning")], "type string, alias string, canonical string")
    fixed = extraction.repaired(extraction.with_aliases(spark.createDataFrame(rows, TRIPLE), aliases))
    got = sorted((r["pmid"], r["relation"], r["object_name"], r["confidence"]) for r in extraction.pruned(fixed, ["deep learning"], ["ai"], ["ct"], ["introduction"]).collect())
    assert got == [(1, "APPLIES_METHOD", "resnet-50", 0.9), (1, "TARGETS_DISEASE", "lung cancer", 0.5), (2, "APPLIES_METHOD", "deep learning", 0.5)]


def test_dataset_access(spark):
    rows = [("TCGA-LUAD", None, None), ("our cohort", "in-house data", "public"), ("new set", None, "Private"), ("z", None, None), ("notcga", None, None)]
    df = spark.createDataFrame(rows, "n string, q string, h string")
    got = [r[0] for r in df.select(extraction.dataset_access(F.col("n"), F.col("q"), F.col("h"), ["tcga"], "in-house|private")).collect()]
    assert got == ["public", "private", "private", "unknown", "unknown"]
    assert spark.range(1).select(extraction.stronger_access(F.lit("private"), F.lit(None).cast("string"))).first()[0] == "private"


def test_thin_full_texts(spark):
    papers = spark.createDataFrame([(1, "short"), (2, "short"), (3, "x" * 300)], "paper_id int, abstract string")
    sections = spark.createDataFrame([(1, "other", "tiny"), (1, "abstract", "y" * 900), (2, "methods", "z" * 900), (3, "other", "tiny")], "paper_id int, section_type string, content string")
    assert [r["paper_id"] for r in extraction.non_substantive(papers, sections, "paper_id").collect()] == [1]


def test_opportunities(spark):
    gaps = spark.createDataFrame([("unet", "glioma", 0, "unexplored"), ("resnet", "melanoma", 2, "minimal"), ("vit", "lymphoma", 0, "unexplored")], "method string, disease string, paper_cnt int, gap string")
    cohorts = spark.createDataFrame([("glioma", 600), ("melanoma", 250)], "disease string, cases int")
    debated = spark.createDataFrame([("A melanoma question",)], "title string")
    assert [(r["disease"], r["source"], r["tier"]) for r in opportunity.opportunity_rows(gaps, cohorts, debated).collect()] == [("melanoma", "Debate", "medium"), ("glioma", "Corpus", "high"), ("lymphoma", "Corpus", "none")]


def test_difficulty(spark):
    papers = spark.createDataFrame([(1, "J", "Q1", 9.0), (1, "bioRxiv", "Q1", 50.0), (2, "J", "Q3", 1.0), (2, "J", "nan", None)], "gap int, journal string, quartile string, impact_factor double")
    bars = {r["gap"]: (r["research_bar"], r["q1_ratio"], r["avg_if"]) for r in opportunity.research_bar(papers, ["gap"]).collect()}
    assert bars == {1: ("hard", 0.5, 9.0), 2: ("easy", 0.0, 1.0)}
    rows = spark.createDataFrame([("easy", 0.9, 600, [], "moderate"), ("hard", 0.1, 10, ["tcga"], "easy"), ("easy", 0.1, 10, ["tcga"], "odd")], "research_bar string, score double, cohort int, public_sets array<string>, target string")
    assert [(r["assessed"], r["delta"], r["color"]) for r in opportunity.difficulty(rows).collect()] == [("easy", -1, "amber"), ("hard", 2, "red"), ("moderate", 0, "green")]


def test_public_data(spark):
    usage = spark.createDataFrame([("tcga", "public", 4, True), ("own", "private", 9, False)], "dataset string, access_class string, used_by int, listed boolean")
    row = opportunity.public_data_score(usage, 8).first()
    assert (round(row["score"], 3), row["status"]) == (0.55, "OK")


def test_event_statistics(spark):
    events = spark.createDataFrame([("r", 1, "found", "scout", "a", 5, "c1", "p"), ("r", 2, "review", "skeptic", "v1", 3, None, None), ("r", 3, "review", "skeptic", "v2", 4, None, None), ("r", 4, "call", "x", "t", 0, "c2", None), ("r", 5, "result", "x", "t", 0, "c2", "one"), ("r", 6, "result", "x", "t", 0, "c2", "two")], "run string, seq int, type string, role string, name string, n int, call_id string, payload string")
    row = opportunity.funnel(events).first()
    assert (row["scouted"], row["reviewed"], row["kept"], row["last_review"]) == (5, 4, 0, "v2")
    assert [(r["call_id"], r["result"]) for r in opportunity.call_result_pairs(events).collect()] == [("c2", "two")]
    tools = spark.createDataFrame([("t", "sql")], "name string, category string")
    assert {r["name"]: r["records"] for r in opportunity.category_stats(events, tools).filter("category = 'sql'").collect()} == {"t": 3}


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 10:00:00", 1, "a"), (1, "2024-01-01 10:00:00", 1, "a"), (2, "2024-01-09 10:00:00", 2, "a"), (3, "2024-01-20 10:00:00", 2, "b")]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").selectExpr("event_id", "cast(ts as timestamp) ts", "user_id", "event_type", "cast(0 as double) value", "'' props").write.parquet(f"file://{tmp_path}/events")
    events = hotspots.read_events(spark, f"file://{tmp_path}/events")
    hotspots.write_weekly(hotspots.new_events(events), f"file://{tmp_path}/weeks", f"file://{tmp_path}/c1").awaitTermination()
    weeks = spark.read.parquet(f"file://{tmp_path}/weeks")
    assert sorted((r["week_id"], r["event_id"]) for r in weeks.collect()) == [("2024-W01", 1), ("2024-W02", 2), ("2024-W03", 3)]
    query = hotspots.window_counts(events).writeStream.format("memory").queryName("counts").outputMode("update").option("checkpointLocation", f"file://{tmp_path}/c2").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("counts").filter("event_type = 'a'").agg(F.max("n")).first()[0] == 3


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_registry(spark):
    from papertide.sources.corpus import from_star

    corpus = from_star(spark, "/root/testdata/sf0.001")
    assert registry.run_tool("methods_for_topic", corpus, keyword="anvil").count() > 0
    text = registry.report(corpus, ["author_stated_gaps"], focus="anvil")
    assert text.startswith("## author_stated_gaps") and text.count("\n") == 23
    with pytest.raises(KeyError):
        registry.run_tool("nothing", corpus)


def small_corpus(spark, relations, papers=()):
    """A corpus of (pmid, relation, type, name) rows; papers are their pmids and those given, all titled paper."""
    from papertide.sources.corpus import Corpus

    pmids = sorted({r[0] for r in relations} | set(papers))
    dated = spark.createDataFrame([(p, "paper", 2001, "2001-07-25", 10) for p in pmids], "pmid long, title string, year int, day string, citation_count long")
    return Corpus(
        dated.selectExpr("pmid", "title", "year", "cast(day as date) pub_date", "'day' date_precision", "citation_count", "'1' study_type", "'available' full_text_status", "true extraction_done", "1L journal_id"),
        spark.createDataFrame([(1, "J", 100, "Q1")], "journal_id long, journal string, if_cents long, quartile string"),
        spark.createDataFrame([(*r, "results", "asserted", "q", None) for r in relations], "pmid long, relation string, type string, name string, section string, polarity string, quote string, metric_value double"),
        spark.createDataFrame([], "name string, access_class string"),
    )


def test_modality_tool_counts_modalities(spark):
    corpus = small_corpus(spark, [
        (1, "TARGETS_DISEASE", "Disease", "glioma"), (1, "USES_MODALITY", "Modality", "wsi"), (1, "PERFORMS_TASK", "Task", "grading"),
        (2, "TARGETS_DISEASE", "Disease", "glioma"), (2, "USES_MODALITY", "Modality", "wsi"), (2, "USES_MODALITY", "Modality", "ihc"), (2, "OPERATES_ON", "Tissue", "brain"),
        (3, "TARGETS_DISEASE", "Disease", "melanoma"), (3, "USES_MODALITY", "Modality", "ct"),
    ])
    assert {r["modality"]: r["paper_cnt"] for r in registry.run_tool("modality_coverage_for_topic", corpus, keyword="glioma").collect()} == {"wsi": 2, "ihc": 1}
    assert [r["name"] for r in corpus.of("Tissue").collect()] == ["brain"]


def test_focus_reaches_the_tools(spark):
    common = [(p, "TARGETS_DISEASE", "Disease", f"common {d:02}") for d in range(32) for p in (10 * d, 10 * d + 1)]
    methods = [(10 * d, "APPLIES_METHOD", "Method", f"net {d:02}") for d in range(32)]
    rare = [
        (900, "TARGETS_DISEASE", "Disease", "rare glioma"), (900, "APPLIES_METHOD", "Method", "unet"), (900, "PERFORMS_TASK", "Task", "t"), (900, "ACHIEVES_METRIC", "Metric", "auc"),
        (901, "APPLIES_METHOD", "Method", "vit"), (901, "APPLIES_METHOD", "Method", "glioma net"), (901, "PERFORMS_TASK", "Task", "t"), (901, "ACHIEVES_METRIC", "Metric", "dice"), (901, "TARGETS_DISEASE", "Disease", "common 00"),
        (902, "APPLIES_METHOD", "Method", "unet"),
    ]
    corpus = small_corpus(spark, common + methods + rare)
    assert [r["metric"] for r in registry.run_tool("metric_evidence", corpus, focus="AUC").collect()] == ["auc"]
    assert registry.run_tool("metric_evidence", corpus).count() == 2
    reach = lambda focus: [tuple(r) for r in registry.run_tool("graph_disease_method_reach", corpus, focus=focus).select("disease", "gap_methods", "strongest", "direct_methods").collect()]
    assert reach("glioma") == [("rare glioma", 1, "glioma net", 1)]
    assert [d for d, *_ in reach("vit")] == ["common 00"] and reach("nothing") == []
    assert "rare glioma" not in [d for d, *_ in reach(None)]
    pairs = lambda focus: {(r["method"], r["disease"]) for r in registry.run_tool("emerging_gap_opportunities", corpus, focus=focus).filter("literature_gap <> 'active'").collect()}
    assert ("unet", "rare glioma") in pairs("glioma") and ("unet", "rare glioma") not in pairs(None)
