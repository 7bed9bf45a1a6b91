"""SQL twins of the landscape queries, written from the rules."""

from __future__ import annotations

#: Each pool as a row: one SELECT a pool.
NAMES = """has_wsi has_survival_label has_death_event has_tnm_stage has_who_grade has_tumor_region meets_followup_6m meets_followup_12m in_target_stage_III_IV
all_survival_no_msi all_survival_tnm_no_msi has_msi_status has_her2 has_egfr has_alk has_pd_l1 all_msi_survival_tnm_stage_III_IV""".split()
POOLS = " UNION ALL ".join(f"SELECT disease_id, '{n}' AS pool, CAST(\"{n}\" AS BIGINT) AS cases FROM wide" for n in NAMES)
CENTRE = f"""
stats AS (
    SELECT 'D' || c_nationkey AS disease_id, count(*) FILTER (WHERE c_acctbal > 2000) AS patient_count,
           CAST(sum(CASE WHEN c_nationkey % 5 = 0 THEN 0 ELSE coalesce(slides, 0) END) AS BIGINT) AS slide_count
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS slides FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey) ON o_custkey = c_custkey GROUP BY c_nationkey
),
told AS (
    SELECT o_custkey AS patient_id, o_orderstatus AS status, o_orderpriority AS priority,
           CASE WHEN o_totalprice > 480000 THEN 'TNM: stage III' WHEN o_totalprice > 420000 THEN 'WHO Grade 2' WHEN o_totalprice > 400000 THEN 'segment' WHEN o_totalprice > 398000 THEN 'Lauren' ELSE 'size' END AS told,
           CASE WHEN o_orderkey % 13 = 0 THEN 'HER2' WHEN o_orderkey % 17 = 0 THEN 'MSI' WHEN o_orderkey % 19 = 0 THEN 'PDL1' WHEN o_orderkey % 23 = 0 THEN 'egfr' END AS biomarker
    FROM orders
),
entries AS (
    SELECT 'D' || n_nationkey AS disease_id, n_name AS name_zh, r_name AS organ, lower(r_name) AS organ_system, patient_count AS total_cases, slide_count AS total_wsi_slides, slide_count > 0 AS has_ihc
    FROM nation JOIN region ON n_regionkey = r_regionkey JOIN stats ON stats.disease_id = 'D' || n_nationkey WHERE patient_count > 0
),
counted AS (
    SELECT 'D' || c_nationkey AS disease_id, count(DISTINCT c_custkey) AS listed,
           count(DISTINCT c_custkey) FILTER (WHERE told = 'TNM: stage III') AS tnm, count(DISTINCT c_custkey) FILTER (WHERE told = 'WHO Grade 2') AS graded,
           count(DISTINCT c_custkey) FILTER (WHERE told = 'segment') AS region,
           count(DISTINCT c_custkey) FILTER (WHERE biomarker = 'HER2') AS her2, count(DISTINCT c_custkey) FILTER (WHERE biomarker = 'MSI') AS msi,
           count(DISTINCT c_custkey) FILTER (WHERE biomarker = 'PDL1') AS pdl1, count(DISTINCT c_custkey) FILTER (WHERE biomarker = 'egfr') AS egfr
    FROM customer LEFT JOIN told ON patient_id = c_custkey WHERE c_nationkey % 2 = 0 GROUP BY c_nationkey
),
sized AS (SELECT s.*, coalesce(listed, 0) AS listed, greatest(patient_count, coalesce(listed, 0)) AS cases, c.* EXCLUDE (disease_id, listed) FROM stats s LEFT JOIN counted c USING (disease_id)),
wide AS (
    SELECT disease_id, CASE WHEN slide_count > 0 AND listed > 0 THEN listed ELSE CASE WHEN slide_count > 0 AND patient_count > 0 THEN patient_count ELSE cases END END AS has_wsi,
           cases * 85 // 100 AS has_survival_label, cases * 85 // 100 AS has_death_event, coalesce(nullif(tnm, 0), cases * 90 // 100) AS has_tnm_stage, coalesce(nullif(graded, 0), cases * 85 // 100) AS has_who_grade,
           coalesce(region, 0) AS has_tumor_region, cases * 80 // 100 AS meets_followup_6m, cases * 75 // 100 AS meets_followup_12m, coalesce(tnm, 0) AS "in_target_stage_III_IV", cases * 75 // 100 AS all_survival_no_msi,
           least(cases * 75 // 100, coalesce(nullif(tnm, 0), cases * 75 // 100)) AS all_survival_tnm_no_msi,
           msi AS has_msi_status, her2 AS has_her2, egfr AS has_egfr, CASE WHEN listed > 0 THEN 0 END AS has_alk, pdl1 AS has_pd_l1,
           CASE WHEN msi > 0 AND tnm > 0 THEN least(msi, cases * 85 // 100, tnm) END AS "all_msi_survival_tnm_stage_III_IV"
    FROM sized
),
pools AS (SELECT * FROM ({POOLS}) WHERE cases IS NOT NULL)"""

SQL = {
    "b05_catalogue": f"WITH {CENTRE.strip()}\nSELECT * FROM entries",
    "b03_centre_pools": f"WITH {CENTRE.strip()}\nSELECT * FROM pools",
    "b06_coverage": f"""
WITH {CENTRE.strip()},
fields(part, field, pool) AS (VALUES
    ('task', 'survival_prediction', 'has_survival_label'), ('task', 'grade_classification', 'has_who_grade'), ('task', 'region_segmentation', 'has_tumor_region'),
    ('task', 'molecular_subtype_classification', 'has_msi_status'), ('task', 'molecular_subtype_classification', 'has_her2'), ('task', 'molecular_subtype_classification', 'has_egfr'),
    ('annotation', 'tnm_stage', 'has_tnm_stage'), ('annotation', 'who_grade', 'has_who_grade'), ('annotation', 'tumor_region', 'has_tumor_region'), ('annotation', 'lauren_classification', 'has_who_grade'),
    ('followup', 'overall_survival_months', 'has_survival_label'), ('followup', 'death_event', 'has_survival_label'),
    ('marker', 'MSI_status', 'has_msi_status'), ('marker', 'HER2', 'has_her2'), ('marker', 'EGFR_mutation', 'has_egfr'), ('marker', 'ALK_fusion', 'has_alk'), ('marker', 'PD_L1_TPS', 'has_pd_l1'))
SELECT disease_id, part, field, max(cases) AS cases, CASE WHEN field <> 'region_segmentation' THEN CAST(floor(max(cases) * 100.0 / max(total_cases) + 0.5) AS BIGINT) END AS coverage_pct
FROM entries JOIN pools USING (disease_id) JOIN fields USING (pool) WHERE cases > 0 GROUP BY disease_id, part, field""",
    "b13_extras": f"""
WITH {CENTRE.strip()},
people AS (SELECT 'D' || c_nationkey AS disease_id, c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), '(unknown)') AS segment FROM customer),
joined AS (SELECT p.disease_id, t.* FROM told t JOIN people p ON patient_id = c_custkey)
SELECT disease_id, 'subtype' AS part, segment AS field, count(*) AS n, CAST(0 AS BIGINT) AS "of" FROM people GROUP BY ALL
UNION ALL SELECT disease_id, 'attribute', told, count(*), 0 FROM joined GROUP BY ALL
UNION ALL SELECT disease_id, 'status', status, count(*), CAST(sum(count(*)) OVER (PARTITION BY disease_id) AS BIGINT) FROM joined GROUP BY disease_id, status
UNION ALL SELECT * FROM (SELECT disease_id, 'mention', priority, count(*) AS n, 0 FROM joined GROUP BY disease_id, priority QUALIFY row_number() OVER (PARTITION BY disease_id ORDER BY count(*) DESC, priority) <= 10)
UNION ALL SELECT disease_id, 'marker', biomarker, count(DISTINCT patient_id) FILTER (WHERE status = 'F'), count(DISTINCT patient_id) FROM joined WHERE biomarker IN ('HER2', 'MSI') GROUP BY ALL""",
    "v09_scale_metrics": f"""
WITH {CENTRE.strip()}
SELECT disease_id, total_cases, CAST(coalesce(nullif(total_wsi_slides, 0), has_wsi) AS BIGINT) AS wsi, CAST(has_survival_label AS BIGINT) AS followup,
       CAST(greatest(coalesce(has_msi_status, 0), coalesce(has_her2, 0), coalesce(has_egfr, 0), coalesce(has_alk, 0), coalesce(has_pd_l1, 0)) AS BIGINT) AS molecular, name_zh || '|' || disease_id AS names
FROM entries JOIN wide USING (disease_id)""",
}
