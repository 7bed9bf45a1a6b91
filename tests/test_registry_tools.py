"""Every tool of the registry, those of a data centre on a small one."""

from papertide import registry
from papertide.sources.corpus import RELATION_OF, Corpus

REQUEST = "disease_id string, task_type string, labels array<string>, markers array<string>, annotations array<string>, followup int, stages array<string>"


def centre(spark):
    of = spark.createDataFrame
    return registry.Centre(
        of([("A", "flu", "lung", "Chest", 100), ("B", "cold", "nose", "head", 20)], "disease_id string, name string, organ string, organ_system string, total_cases long"),
        of([("A", {"has_wsi": 100, "has_survival_label": 85, "has_who_grade": 10, "has_her2": 40})], "disease_id string, pools map<string,bigint>"),
        of([("A", 0, 9), ("B", 20, 0)], "disease_id string, patient_count long, slide_count long"),
        of([("A", 1), ("A", 2), ("B", 3)], "disease_id string, patient_id long"),
        of([(1, "Stage", "III"), (2, "Stage", "III"), (3, "Stage", "I"), (1, "size", "x")], "patient_id long, attribute string, value string"),
        of([(1, "other", "s1", ""), (9, "a flu", None, "c1"), (3, "cold", "s3", "")], "patient_id long, disease_name string, subtype string, subtype_code string"),
        of([(1, "HER2", "positive"), (2, "HER2", "negative"), (3, "HER2", "positive")], "patient_id long, biomarker string, result string"),
        of([("A", "pending", "m", "x", None), ("A", "ok", None, None, "y"), ("B", "ok", "m", "z", "z")], "disease_id string, status string, method string, mention string, raw_mention string"),
    )


def test_centre_tools(spark):
    c = centre(spark)
    run = lambda name, *more, **a: [tuple(r) for r in registry.run_tool(name, c, *more, **a).collect()]
    assert run("pathology_disease_catalog", organ_system="chest") == [("A", "flu", "lung", "Chest", 100)] and len(run("pathology_disease_catalog", min_cases=0)) == 2
    assert sorted(run("pathology_tasks_for_disease", disease_id="A")) == [("A", "grade_classification", 10, 0.1), ("A", "molecular_subtype_classification", 40, 0.4), ("A", "survival_prediction", 85, 0.85)]
    requests = spark.createDataFrame([("A", "survival_prediction", ["overall_survival_months"], ["HER2"], [], None, []), ("Z", "t", [], [], [], None, [])], REQUEST)
    got = {r.disease_id: (r.cohort, r.score, r.status) for r in registry.run_tool("feasibility_assess", c, requests).collect()}
    assert got == {"A": (40, 0.4, "RISKY"), "Z": (0, 0.0, "REJECTED_DATA_INSUFFICIENT")}
    gaps = {r.disease_id: ([g.severity for g in r.gaps], r.suggestions) for r in registry.run_tool("data_gap_analysis", c, requests).collect()}
    assert gaps["A"] == (["HIGH"], ["去除HER2条件，聚焦纯形态学任务（可用样本约40例）"]) and gaps["Z"][0] == []
    assert {r.disease_id: (r.patient_count, r.patient_rows) for r in registry.run_tool("disease_cohort_stats", c).collect()} == {"A": (2, 2), "B": (20, 1)}
    assert sorted(run("subtype_distribution", disease_id="A")) == [("c1", 1), ("s1", 1)]
    assert run("attribute_distribution", disease_id="A") == [("Stage", "III", 2, 2), ("size", "x", 1, 1)] and run("attribute_distribution", keyword="SIZ") == [("size", "x", 1, 1)]
    assert run("molecular_positivity", disease_id="A") == [(2, 1, 0.5)] and run("molecular_positivity", biomarker="MSI") == [(0, 0, 0.0)]
    assert len(run("text_disease_matches", disease_id="A", pending_only=True)) == 3


def test_public_datasets(spark):
    papers = spark.createDataFrame([(i, "flu", 2000, 1, 1) for i in range(4)], "pmid long, title string, year int, journal_id int, citation_count long")
    relations = spark.createDataFrame([(i, RELATION_OF["Dataset"], "Dataset", n) for i, n in [(0, "tcga"), (1, "tcga"), (2, "own")]], "pmid long, relation string, type string, name string")
    c = Corpus(papers, papers, relations, spark.createDataFrame([("tcga", "public")], "name string, access_class string"))
    row = registry.run_tool("public_dataset_assess", c, keyword="flu", listed=spark.createDataFrame([("tcga",)], "name string")).first()
    assert (row.public_sets, row.covered, row.status, round(row.score, 2)) == (1, 2, "WEAK", 0.55)
    assert registry.run_tool("public_dataset_assess", c, keyword=" ").first().status == "NONE"


def test_all_names():
    assert len(registry.TOOLS) + len(registry.DATA_TOOLS) == 34
