"""The landscape's payloads: what is written comes back, and odd rows have a defined result."""

import json

from papertide.operators import landscape

STATS = "disease_id string, patient_count long, slide_count long"


def entries(spark):
    diseases = spark.createDataFrame([("A", 1, "胃", "stomach", "Digestive", None), ("B", 2, None, None, None, "d"), ("", 3, "x", "y", "z", None), (None, 4, "x", "y", "z", None), ("C", 5, "none", "y", "z", None)], "disease_id string, disease_db_id int, name_zh string, organ string, organ_system string, description string")
    stats = spark.createDataFrame([("A", 100, 10), ("B", 7, 0), ("C", 0, 3), ("", 5, 5)], STATS)
    patients = spark.createDataFrame([("A", i) for i in range(3)] + [("A", 1), ("A", None)], "disease_id string, patient_id long")
    attributes = spark.createDataFrame([(0, "pTNM stage IV"), (0, "who"), (1, "Lauren type"), (9, "stage"), (None, "stage"), (2, None)], "patient_id long, told string")
    results = spark.createDataFrame([(0, "msi"), (1, "PD-L1"), (1, "pdl1"), (9, "HER2"), (2, None)], "patient_id long, biomarker string")
    return landscape.catalogue_entries(diseases, stats), landscape.pools_of(stats, patients, attributes, results)


def test_pools_and_catalogue(spark):
    catalogue, pools = entries(spark)
    assert {(r.disease_id, r.total_cases, r.has_ihc, r.name_zh) for r in catalogue.collect()} == {("A", 100, True, "胃"), ("B", 7, False, "")}
    found = {r.disease_id: (r.pools, r.lauren_cases) for r in pools.collect()}
    assert found["A"] == ({"has_wsi": 3, "has_survival_label": 85, "has_death_event": 85, "has_tnm_stage": 1, "has_who_grade": 1, "has_tumor_region": 0, "meets_followup_6m": 80, "meets_followup_12m": 75, "in_target_stage_III_IV": 1, "all_survival_no_msi": 75, "all_survival_tnm_no_msi": 1, "has_msi_status": 1, "has_her2": 0, "has_egfr": 0, "has_alk": 0, "has_pd_l1": 1, "all_msi_survival_tnm_stage_III_IV": 1}, 1)
    assert found["B"][0] == {"has_wsi": 7, "has_survival_label": 5, "has_death_event": 5, "has_tnm_stage": 6, "has_who_grade": 5, "has_tumor_region": 0, "meets_followup_6m": 5, "meets_followup_12m": 5, "in_target_stage_III_IV": 0, "all_survival_no_msi": 5, "all_survival_tnm_no_msi": 5}


def test_round_trip(spark):
    catalogue, pools = entries(spark)
    table = landscape.payloads(catalogue, pools).withColumnRenamed("payload", "payload").cache()
    odd = spark.createDataFrame([("X", "not json"), ("Y", None), ("Z", "{}"), ("W", '{"catalog": {"total_cases": "12", "name_en": "w"}, "sample_size": {"total_cases": 0}, "feasibility_pools": {"has_her2": 4, "has_wsi": 9, "meets_followup_12m": 2}}')], "disease_id string, payload string")
    whole = table.unionByName(odd)
    back = {r.disease_id: json.loads(r.p) for r in landscape.landscape(table).selectExpr("disease_id", "to_json(payload) AS p").collect()}
    assert back == {r.disease_id: json.loads(r.payload) for r in table.collect()}
    assert back["A"]["catalog"]["has_molecular"] is True and back["A"]["marker"] == [{"field": "MSI_status", "available_cases": 1, "coverage": 0.01}, {"field": "PD_L1_TPS", "available_cases": 1, "coverage": 0.01}]
    metrics = {r.disease_id: tuple(r[1:]) for r in landscape.scale_metrics(landscape.landscape(whole)).collect()}
    assert metrics == {"A": (100, 10, 85, 1, ["胃", "A"]), "B": (7, 7, 5, 0, ["B"]), "X": (0, 0, 0, 0, ["X"]), "Y": (0, 0, 0, 0, ["Y"]), "Z": (0, 0, 0, 0, ["Z"]), "W": (12, 9, 2, 4, ["w", "W"])}
    assert "feasibility_pools" in landscape.schema_of_landscape(table)
    assert [r.disease_id for r in landscape.organ_catalogue(catalogue, "digestive").collect()] == ["A"] and landscape.organ_catalogue(catalogue, None, 0).count() == 2


def test_extras(spark):
    none = lambda columns: spark.createDataFrame([], columns)
    matches = spark.createDataFrame([("A", None, m) for m in "abcdefghijkl"] + [("A", "ok", "l"), ("A", "ok", None)], "disease_id string, status string, mention string")
    results = spark.createDataFrame([("A", 1, "HER2", "+"), ("A", 1, "HER2", "negative"), ("A", 2, "HER2", None), ("A", 2, "BRAF", "+")], "disease_id string, patient_id long, biomarker string, result string")
    row = landscape.extras(none("disease_id string, value string"), none("disease_id string, attribute string, value string"), matches, results).collect()[0]
    assert row.v11.text_match_summary.total_matches == 14 and row.v11.text_match_summary.verification_status == {"(unknown)": 12, "ok": 2}
    assert [m.mention for m in row.v11.text_match_summary.top_mentions] == ["l", "(unknown)", *"abcdefgh"]
    assert [tuple(m) for m in row.v11.molecular_positivity] == [("HER2", 2, 1, 0.5)]
