"""Concepts, the extraction queue, articles, reports and the life-cycle job on small fixtures."""

import os

import pytest
from pyspark.sql import functions as F

from papertide.functions import scoring
from papertide.operators import articles, concepts, feasibility, focus, lifecycle, queue, reports
from papertide.operators.concepts import Concept
from papertide.sources.corpus import from_star

DATA = "/root/testdata/sf0.001"
NPC = Concept("npc", "nasopharyngeal carcinoma", phrases=("nasopharynx cancer",), sites=("nasopharyn",), histology=("carcinoma", "cancer"), abbreviations=("npc",), zh=("鼻咽癌",))
POLYP = Concept("polyp", "colorectal polyp", phrases=("colon polyp",), sites=("colon", "colorectal"), histology=("carcinoma",), zh=("肠息肉", "息肉"), morphology=("polyp", "adenoma"))
LUNG = Concept("lung", "lung cancer", sites=("lung", "pulmonary"), histology=("carcinoma", "cancer"), abbreviations=("nsclc",))


@pytest.fixture(scope="module")
def known(spark):
    return concepts.table(spark, [NPC, POLYP, LUNG])


def test_names_that_belong_to_a_concept(spark):
    names = ["Nasopharyngeal Carcinoma", "cancer of the nasopharynx", "npc", "NPC cancer", "stage npc carcinoma", "enpc cancer", "carcinoma", "colorectal adenoma", "colon carcinoma", None, ""]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = lambda c: [r[0] for r in df.filter(concepts.belongs(F.col("name"), c)).collect()]
    assert got(NPC) == ["Nasopharyngeal Carcinoma", "cancer of the nasopharynx", "NPC cancer", "stage npc carcinoma"]
    assert got(POLYP) == ["colorectal adenoma"]


def test_foci_resolve_to_the_longest_alias(spark, known):
    cases = {
        "鼻咽癌筛查": "npc", "肠息肉": "polyp", "Colorectal  Polyp": "polyp", "NPC": "npc", "enpc": None, "NSCLC survival": "lung",
        "lung": "lung", "unrelated": None, "": None, None: None, "npc.": "npc", "colon polyp and lung cancer": "polyp",
    }
    df = spark.createDataFrame([(k,) for k in cases] + [("NPC",)], "focus string")
    rows = concepts.resolved(df, known).collect()
    assert len(rows) == len(cases) + 1
    # in the last one both aliases are 11 characters long, and a phrase goes before a canonical name
    assert {r["focus"]: r["concept_id"] for r in rows} == cases


def test_focus_keys_are_stable(spark, known):
    df = spark.createDataFrame([("NPC",), ("  Deep   Learning ",), ("",), (None,), ("__all__",)], "focus string")
    once = concepts.focus_keys(df, known)
    assert sorted(r["focus_key"] for r in once.collect()) == ["__all__", "__all__", "__all__", "deep learning", "nasopharyngeal carcinoma"]
    again = concepts.focus_keys(once.select(F.col("focus_key").alias("focus")), known)
    assert sorted(r["focus_key"] for r in again.collect()) == sorted(r["focus_key"] for r in once.collect())


def test_alias_maps(known):
    got = {r["alias"]: r["target"] for r in concepts.alias_map(known).collect()}
    assert got["npc"] == "nasopharyngeal carcinoma" and got["pulmonary"] == "lung cancer" and "colon" not in got
    assert {r["alias"]: r["target"] for r in concepts.alias_map(known, "concept_id").collect()}["息肉"] == "polyp"


def test_synonyms_need_two_words(spark):
    df = spark.createDataFrame([("pulmonary neoplasms",), ("lung",), ("lung tumor board",)], "t string")
    assert [r[0] for r in df.filter(focus.mentions(F.col("t"), "lung cancer")).collect()] == ["pulmonary neoplasms", "lung tumor board"]
    assert df.filter(focus.mentions(F.col("t"), "cancer")).count() == 0


SKIPS = [
    ("Correction: x", "", [], "erratum/correction notice"),
    ("Special Issue: y", "a" * 300, [], "special issue / section notice"),
    ("Editor's note: z", "", [], "editor note"),
    ("Annual meeting report", "", [], "meeting/workshop/proceedings report"),
    ("t", "This meeting brought together us", [], "meeting/workshop summary"),
    ("Comment on: t", "short", [], "comment/reply (no substantive abstract)"),
    ("t", "a" * 300, ["Editorial"], "non-extractable pub_type (editorial)"),
    ("t", "a" * 300, ["Published Erratum"], None),
    ("t", "a" * 100, ["Published Erratum"], "published erratum"),
    ("t", "a" * 300, ["Letter"], "short letter (thin abstract)"),
    ("t", "a" * 500, ["Letter"], None),
    ("t", "It corrects the article 1", [], "doi correction stub"),
    ("t", "An opinion on models", [], "thin commentary/viewpoint"),
    ("A model", "We train a model. " * 30, ["Journal Article"], None),
    (None, None, None, None),
]


def test_skip_reasons(spark):
    df = spark.createDataFrame([(i, *row[:3]) for i, row in enumerate(SKIPS)], "i int, title string, abstract string, pub_types array<string>")
    got = {r[0]: r[1] for r in df.select("i", queue.skip_reason(F.col("title"), F.col("abstract"), F.col("pub_types"))).collect()}
    assert [got[i] for i in range(len(SKIPS))] == [row[3] for row in SKIPS]


def test_study_types(spark):
    df = spark.createDataFrame([(["Meta-Analysis", "Review"],), (["Systematic Review"],), (["Clinical Trial, Phase I"],), (["Validation Study"],), (["Letter"],), (None,)], "p array<string>")
    assert [r[0] for r in df.select(queue.study_type(F.col("p"))).collect()] == ["meta_analysis", "review", "clinical_study", "clinical_study", None, None]


PAPERS = "pmid string, doi string, pmc_id string, title string, abstract string, year int, full_text_status string, extraction_done boolean, study_type string, full_text_fetched_at string"


def test_the_queue_and_its_marks(spark):
    rows = [
        ("1", "10/A", None, "Erratum: a", "b", 2020, "available", False, None, None),
        ("2", "10/b", "PMC2", "t", "b", 2001, "pending", None, None, None),
        ("3", None, None, "t", "b", None, "available", False, None, None),
        ("4", "10/d", None, "t", "b", 2010, "available", False, None, None),
        ("5", "10/e", None, "t", "b", 2010, "pdf_available", False, None, None),
        ("6", "10/f", None, "t", "", 2010, "available", False, None, None),
        ("7", "10/g", None, "t", "b", 2010, "available", True, "review", None),
    ]
    papers = spark.createDataFrame(rows, PAPERS)
    assert [r["pmid"] for r in queue.extraction_queue(papers).collect()] == ["4", "3", "5", "2", "1"]
    assert [r["pmid"] for r in queue.extraction_queue(papers, 2).collect()] == ["4", "3"]
    assert [r["pmid"] for r in queue.needing_full_text(papers).collect()] == ["2"]
    marked = queue.marked_full_text(papers, spark.createDataFrame([("2", "available", None), ("4", "unavailable", "PMC4")], "pmid string, status string, pmc_id string"), "now")
    got = {r["pmid"]: r for r in queue.marked_extracted(marked, spark.createDataFrame([("4", "review")], "pmid string, study_type string")).collect()}
    assert len(got) == 7 and (got["2"]["full_text_status"], got["2"]["pmc_id"], got["2"]["full_text_fetched_at"]) == ("available", "PMC2", "now")
    assert (got["4"]["pmc_id"], got["4"]["extraction_done"], got["4"]["study_type"]) == ("PMC4", True, "review") and got["7"]["study_type"] == "review"
    embedded = spark.createDataFrame([("1", "1", "10/a "), ("2", "9", None), ("3", None, "10/z"), ("4", "", "10/x"), ("8", "1", None)], "pmid string, xml_pmid string, xml_doi string")
    assert sorted(r["pmid"] for r in queue.mismatches(papers, embedded).collect()) == ["2", "4"]
    sections = spark.createDataFrame([("2", "a"), ("1", "b"), (None, "c")], "pmid string, content string")
    reset, left = queue.reset_mismatches(papers, sections, embedded, "now")
    after = {r["pmid"]: r for r in reset.collect()}
    assert (after["2"]["full_text_status"], after["2"]["pmc_id"], after["1"]["full_text_status"]) == ("unavailable", None, "available")
    assert sorted(r["content"] for r in left.collect()) == ["b", "c"]


ARTICLE = """<article><front><article-meta><article-id pub-id-type="pmid"> 12 </article-id><article-id pub-id-type="doi">10.1/AbC</article-id>
<article-id pub-id-type="pmc">PMC7</article-id><abstract><sec sec-type="methods"><title>Design</title><p>We  did.</p></sec><sec><p>So.</p></sec></abstract></article-meta></front>
<body><sec><title>Background</title><p>One <b>two</b>.</p><p>Three.</p><sec><title>Results</title><p>short</p></sec><sec><title>Cohort outcome</title><p>{long}</p></sec></sec>
<sec sec-type="discussion"><title/><p>End.</p></sec><sec><title>Empty</title></sec></body></article>"""


def test_articles(spark):
    long = "word " * 20000
    rows = [("a", ARTICLE.format(long=long)), ("b", "<article><abstract>Only  this</abstract></article>"), ("c", "<x>bare <y>text</y></x>"), ("d", "not xml"), ("e", None), ("f", "<x/>")]
    got = sorted(tuple(r) for r in articles.sections(spark.createDataFrame(rows, "pmid string, xml string")).collect())
    own = ("a", "12", "10.1/abc", "PMC7")
    assert got == [
        (*own, 0, "methods", "Design", "DesignWe did."),
        (*own, 1, "other", "Abstract section", "So."),
        (*own, 2, "introduction", "Background", "One two. Three."),
        (*own, 3, "results", "Cohort outcome", long.strip()),
        (*own, 4, "discussion", "Section 4", "End."),
        ("b", None, None, None, 0, "abstract", "Abstract", "Only this"),
        ("c", None, None, None, 0, "other", "Full text", "bare text"),
    ]
    merged = spark.createDataFrame([("a", "other", "", "x" * 1500), ("b", "other", "t", "x" * 1499), ("c", "results", "t", "x" * 2000)], "pmid string, section_type string, title string, content string")
    assert [(r["pmid"], r["section_type"], r["title"]) for r in articles.promoted_other(merged, "pmid").collect()] == [("a", "discussion", "discussion (from other)")]


REPORT = "# Report\n### Research Gap 1: Rare cells **\n**Research question**: Can we?\nmore\n### 研究空白 2：第二\n**研究问题**： 能否\n### Gap 3: Rare cells\nend"


def test_reports(spark):
    df = spark.createDataFrame([(1, REPORT), (2, "**1. Stain transfer** and **2. No**"), (3, ""), (4, None)], "run_id int, report string")
    titles = {r[0]: r[1] for r in df.select("run_id", reports.gap_titles(F.col("report"))).collect()}
    assert titles == {1: ["Rare cells", "第二"], 2: ["Stain transfer"], 3: [], 4: []}
    items = reports.gap_items(df, "run_id", "report").orderBy("run_id", "rank_pos").collect()
    assert [(r["run_id"], r["rank_pos"], r["title"], r["research_question"]) for r in items] == [(1, 1, "Rare cells", "Can we?"), (1, 2, "第二", "能否"), (1, 3, "Rare cells", ""), (2, 1, "Stain transfer", "")]
    assert items[0]["section_md"].endswith("more") and items[2]["section_md"].endswith("end")
    counted = spark.createDataFrame([("Gap 1 and ### Research Gap 2",), ("1. a long enough one\n2) two\n3. another long one",), ("- a bullet of ten or more\n- no",), ("plain",), (None,)], "c string")
    assert [r[0] for r in counted.select(reports.candidate_count(F.col("c"))).collect()] == [2, 2, 1, 0, 0]
    hints = spark.createDataFrame([("**研究问题**：胃癌\nx",), ("plain text",), ("",)], "c string")
    assert [r[0] for r in hints.select(reports.disease_hint(F.col("c"))).collect()] == ["胃癌", "plain text", None]


def test_titles_find_their_items(spark):
    items = spark.createDataFrame([(1, 10, "Rare cell detection in slides"), (1, 11, "rare cells"), (1, 12, "Rare Cells "), (2, 13, "rare cells"), (1, 14, None)], "run_id int, item_id long, title string")
    asked = [(1, "RARE cells"), (1, "cell detection in rare slides"), (1, "nothing alike"), (1, " "), (2, "rare cells"), (3, "rare cells")]
    got = {(r["run_id"], r["title"]): r["item_id"] for r in reports.resolved_items(spark.createDataFrame(asked, "run_id int, title string"), items).collect()}
    assert got == dict(zip(asked, [11, 10, None, None, 13, None], strict=True))


def test_wordings(spark):
    df = spark.createDataFrame([("阳性",), ("HER2 3+",), ("Negative (0)",), ("弱阳性，阴性对照",), ("",), (None,)], "r string")
    assert [r[0] for r in df.select(scoring.is_positive(F.col("r"))).collect()] == [True, True, False, False, False, False]
    df = spark.createDataFrame([("unexplored", 600, 1.234), ("minimal", 200, 0.5), ("other", None, None)], "g string, n int, s double")
    assert [r[0] for r in df.select(scoring.total_priority(F.col("g"), F.col("n"), F.col("s"))).collect()] == [7.23, 3.5, 1.0]
    df = spark.createDataFrame([(0.9, 600), (0.9, 100), (0.3, 10), (0.1, 10)], "s double, n int")
    told = df.select("s", "n", scoring.recommendation(F.col("s"), F.col("n")).alias("r"))
    assert [r[0] for r in told.select("r").collect()] == ["FEASIBLE", "MARGINAL", "RISKY", "INSUFFICIENT"]
    notes = [r[0] for r in told.select(scoring.recommendation_note(F.col("r"), F.col("s"), F.col("n"))).collect()]
    assert notes[0] == "600例满足全部条件，建议80/20训练测试划分后训练集480例，可支撑深度学习建模" and "0.9" in notes[1] and notes[3].startswith("数据不足（10例）")


def test_subtypes_and_matches_of_nothing(spark):
    patients = spark.createDataFrame([], "patient_id string")
    rows = spark.createDataFrame([("1", "胃癌", "", "A"), (None, None, None, None)], "patient_id string, disease_name string, subtype string, subtype_code string")
    assert feasibility.subtype_distribution(rows, patients).count() == 0
    assert [tuple(r) for r in feasibility.subtype_distribution(rows, patients, "胃").collect()] == [("A", 1)]
    matches = spark.createDataFrame([(None, "", None, "raw"), ("待审核", "rule", "m", "raw")], "status string, method string, mention string, raw_mention string")
    assert {tuple(r) for r in feasibility.match_summary(matches, pending_only=True).collect()} == {("status", "待审核", 1), ("method", "rule", 1), ("mention", "m", 1)}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_the_job_writes_what_the_tables_say(spark, tmp_path):
    corpus = from_star(spark, DATA)
    stats = {(r["kind"], r["value"]): r["n"] for r in lifecycle.run_lifecycle(corpus, str(tmp_path)).collect()}
    again = {(r["kind"], r["value"]): r["n"] for r in lifecycle.run_lifecycle(corpus, str(tmp_path)).collect()}
    assert stats == again
    assert {v: n for (k, v), n in stats.items() if k == "status"} == {r["temporal_status"]: r["count"] for r in lifecycle.temporal_profiles(corpus).groupBy("temporal_status").count().collect()}
    stored = spark.read.parquet(f"{tmp_path}/signals")
    assert stored.count() == sum(n for (k, _), n in stats.items() if k == "signal") > 0
    assert lifecycle.signal_rows(stored, signal_type="mention_decline", limit=5).count() == 5


def test_early_papers_count_out_of_focus(spark):
    """Papers of the first years count whether in focus or not; the other counts are of papers in focus."""
    from papertide.sources.corpus import Corpus

    papers = spark.createDataFrame([(1, "lung", 2000, 5), (2, "skin", 2001, 7), (3, "skin", 1990, 1), (4, "lung", 2004, 2)], "pmid long, title string, year int, citation_count long")
    said = [(p, "REPORTS_LIMITATION", "Limitation", "small", "results", "asserted", "q", None) for p in (1, 2, 3, 4)]
    relations = spark.createDataFrame(said, "pmid long, relation string, type string, name string, section string, polarity string, quote string, metric_value double")
    row = lifecycle.temporal_profiles(Corpus(papers, None, relations, None), "lung").collect()[0]
    assert (row["first_year"], row["last_year"], row["paper_cnt"], row["early_cnt"], row["cites"]) == (2000, 2004, 2, 3, 7)


def test_followups_on_several_diseases_count_once(spark):
    """A later paper on two of a limitation's diseases is one follow-up; brute force over the papers."""
    from papertide.sources.corpus import Corpus

    diseases = {1: "ab", 2: "b", 3: "ab", 4: "ab", 5: "a", 6: "abc", 7: "c", 8: "a", 9: "bc"}
    years = {1: 2000, 2: 2001, 3: 2003, 4: 2003, 5: 2004, 6: 2005, 7: 2006, 8: 2000, 9: None}
    said = [(p, "TARGETS_DISEASE", "Disease", d, "results", "asserted") for p, ds in diseases.items() for d in ds]
    said += [(p, "APPLIES_METHOD", "Method", "cnn", "methods" if p != 5 else "discussion", "asserted") for p in diseases]
    said += [(p, "REPORTS_LIMITATION", "Limitation", "small", "results", "asserted") for p in (1, 2)]
    relations = spark.createDataFrame(said, "pmid long, relation string, type string, name string, section string, polarity string")
    papers = spark.createDataFrame([(p, y, 0) for p, y in years.items()], "pmid long, year int, citation_count long")
    profiles = spark.createDataFrame([("small", 2000, 2001, "persistent")], "limitation string, first_year int, last_year int, temporal_status string")
    row = lifecycle.followup_stats(Corpus(papers, None, relations, None), profiles).collect()
    anchors = {d for p in (1, 2) for d in diseases[p]}
    later = [p for p in diseases if years[p] and years[p] > 2000 and p != 5 and anchors & set(diseases[p])]
    assert [tuple(r) for r in row] == [("small", len(later), min(years[p] for p in later))]
