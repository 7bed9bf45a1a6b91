"""SQL twins of the hypotheses, written from the rules for the words and pools of the star schema."""

from __future__ import annotations

from papertide.plans.landscape_twins import CENTRE

GAPS = """
gaps AS (
    SELECT o_orderkey, 'D' || c_nationkey AS disease_id, o_orderstatus,
           lower(['Survival of all', 'Region growing', 'WHO grade', 'molecular MSI', 'her2 and msi', 'PD-L1 molecular', 'nothing told', 'molecular HER2 TNM'][o_orderkey % 8 + 1]
                 || ' ' || CASE o_orderstatus WHEN 'P' THEN 'by stage' WHEN 'F' THEN '' ELSE 'x' END) AS text
    FROM orders JOIN customer ON o_custkey = c_custkey
),
kinds AS (
    SELECT *, CASE WHEN regexp_matches(text, 'survival|生存|prognos|os |dfs') THEN 'survival' WHEN regexp_matches(text, 'segment|分割|region') THEN 'region'
                   WHEN regexp_matches(text, 'grade|分级|who') THEN 'grade' WHEN regexp_matches(text, 'molecular|分子|msi|her2|pd-l1|pd_l1') THEN 'molecular' END AS kind FROM gaps
),
asked AS (
    SELECT *, CASE kind WHEN 'region' THEN 'region_segmentation' WHEN 'grade' THEN 'grade_classification' WHEN 'molecular' THEN 'molecular_subtype_classification' ELSE 'survival_prediction' END AS task,
           CASE WHEN kind = 'survival' THEN ['overall_survival_months', 'death_event'] ELSE CAST([] AS VARCHAR[]) END AS labels,
           CASE WHEN kind = 'molecular' AND contains(text, 'her2') THEN ['HER2'] WHEN kind = 'molecular' AND contains(text, 'msi') THEN ['MSI_status'] ELSE CAST([] AS VARCHAR[]) END AS markers,
           list_concat(CASE kind WHEN 'region' THEN ['tumor_region'] WHEN 'grade' THEN ['who_grade'] ELSE CAST([] AS VARCHAR[]) END, CASE WHEN regexp_matches(text, 'tnm|stage|分期') THEN ['tnm_stage'] ELSE CAST([] AS VARCHAR[]) END) AS notes,
           CASE WHEN kind = 'survival' THEN 12 END AS followup
    FROM kinds
)"""
#: The state with its cohort, score and suggestions; takes {source}.
JUDGED = """
    SELECT *, CASE WHEN len(short) > 0 THEN list_transform(short, lambda m: '去除' || m || '条件，聚焦纯形态学任务（可用样本约' || all_survival_no_msi || '例）')[1:3]
                   ELSE list_concat(['放宽分子标记条件，聚焦形态学+临床标签（可用约' || all_survival_no_msi || '例）'],
                        CASE WHEN len(tasks) > 0 THEN ['切换任务类型为 ' || coalesce(list_filter(tasks, lambda t: t <> task)[1], 'grade_classification') || ' 以提高可用样本量'] ELSE CAST([] AS VARCHAR[]) END) END AS said
    FROM (
        SELECT *, floor(cohort * 100.0 / greatest(has_wsi, 1) + 0.5) / 100 AS score, list_filter(markers, lambda m: floor((CASE m WHEN 'HER2' THEN coalesce(has_her2, 0) ELSE coalesce(has_msi_status, 0) END) * 100.0 / greatest(has_wsi, 1) + 0.5) < 70) AS short
        FROM (
            SELECT s.*, w.* EXCLUDE (disease_id),
                   CASE WHEN len(markers) = 0 AND len(labels) > 0 THEN list_min(list_concat([all_survival_no_msi], of_notes))
                        ELSE list_min(list_filter(list_concat([has_wsi, CASE WHEN len(labels) > 0 THEN has_survival_label END, CASE WHEN followup = 12 THEN meets_followup_12m WHEN followup = 6 THEN meets_followup_6m END,
                             CASE WHEN len(stages) > 0 THEN "in_target_stage_III_IV" END, CASE WHEN len(stages) > 0 AND len(labels) > 0 AND list_contains(markers, 'MSI_status') THEN "all_msi_survival_tnm_stage_III_IV" END,
                             CASE WHEN list_contains(markers, 'HER2') THEN coalesce(has_her2, 0) END, CASE WHEN list_contains(markers, 'MSI_status') THEN coalesce(has_msi_status, 0) END], of_notes), lambda x: x IS NOT NULL)) END AS cohort
            FROM (SELECT t.*, list_transform(notes, lambda k: CASE k WHEN 'tnm_stage' THEN v.has_tnm_stage WHEN 'who_grade' THEN v.has_who_grade ELSE v.has_tumor_region END) AS of_notes FROM {source} t JOIN wide v USING (disease_id)) s JOIN wide w USING (disease_id)
        )
    )"""
START = """
start AS (
    SELECT o_orderkey, disease_id, task, labels, markers, notes, followup, CASE WHEN o_orderkey % 2 = 0 THEN ['III'] ELSE CAST([] AS VARCHAR[]) END AS stages,
           CASE WHEN o_orderkey % 3 = 0 THEN ['survival_prediction', 'grade_classification'] ELSE CAST([] AS VARCHAR[]) END AS tasks, CAST([] AS VARCHAR[]) AS log, true AS open, 0 AS step
    FROM asked WHERE disease_id IN (SELECT disease_id FROM wide)
)"""

SQL = {
    "b17_hypotheses": f"WITH {GAPS.strip()}\nSELECT o_orderkey, task AS task_type, array_to_string(labels, '|') AS labels, array_to_string(markers, '|') AS markers, array_to_string(notes, '|') AS annotations, followup FROM asked",
    "b02_data_gaps": f"""
WITH {CENTRE.strip()},
{GAPS.strip()},
{START.strip()},
judged AS ({JUDGED.format(source="start")}),
shown AS (
    SELECT *, list_concat(
        list_transform(short, lambda m: lower(m) || ':' || CAST(floor((CASE m WHEN 'HER2' THEN coalesce(has_her2, 0) ELSE coalesce(has_msi_status, 0) END) * 100.0 / greatest(has_wsi, 1) + 0.5) AS INTEGER)
            || CASE WHEN floor((CASE m WHEN 'HER2' THEN coalesce(has_her2, 0) ELSE coalesce(has_msi_status, 0) END) * 100.0 / greatest(has_wsi, 1) + 0.5) < 50 THEN ':HIGH' ELSE ':MEDIUM' END),
        CASE WHEN followup = 12 THEN ['min_followup_12months:' || meets_followup_12m || CASE WHEN meets_followup_12m < 500 THEN ':MEDIUM' ELSE ':LOW' END] ELSE CAST([] AS VARCHAR[]) END) AS gaps
    FROM judged
)
SELECT o_orderkey, CAST(cohort AS BIGINT) AS cohort, CAST(floor(score * 100 + 0.5) AS BIGINT) AS score_pct, array_to_string(gaps, '|') AS gaps, array_to_string(said, '|') AS suggestions FROM shown""",
    "b18_evolution": f"""
WITH RECURSIVE {CENTRE.strip()},
{GAPS.strip()},
{START.strip()},
walk AS (
    SELECT * FROM start
    UNION ALL
    SELECT o_orderkey, disease_id, task, labels, markers, notes, followup, stages, tasks,
           list_concat(log, list_concat([next_step || ':assess:' || CAST(floor(score * 100 + 0.5) AS INTEGER) || ':' || CASE WHEN score >= 0.8 THEN 'APPROVED' WHEN score >= 0.5 THEN 'REFINED' WHEN score >= 0.2 THEN 'RISKY' ELSE 'REJECTED_DATA_INSUFFICIENT' END || ':' || cohort],
               CASE WHEN score >= 0.8 THEN CAST([] AS VARCHAR[]) WHEN score < 0.2 THEN [next_step || ':reject'] WHEN same THEN [next_step || ':no_change'] ELSE [next_step || ':refine'] END)),
           score < 0.8 AND score >= 0.2 AND NOT same, next_step
    FROM (
        SELECT o_orderkey, disease_id, tasks, log, score, cohort, step + 1 AS next_step, same,
               CASE WHEN goes THEN new_task ELSE task END AS task, CASE WHEN goes THEN new_labels ELSE labels END AS labels, CASE WHEN goes THEN new_markers ELSE markers END AS markers,
               CASE WHEN goes THEN new_notes ELSE notes END AS notes, CASE WHEN goes THEN new_followup ELSE followup END AS followup, stages
        FROM (
            SELECT *, score < 0.8 AND score >= 0.2 AS goes, new_task = task AND new_labels = labels AND new_markers = markers AND new_notes = notes AND new_followup IS NOT DISTINCT FROM followup AS same
            FROM (
                SELECT *, CASE WHEN len(new_markers) = 0 AND len(mid_labels) = 0 THEN 'survival_prediction' ELSE mid_task END AS new_task,
                       CASE WHEN len(new_markers) = 0 AND len(mid_labels) = 0 THEN ['overall_survival_months', 'death_event'] ELSE mid_labels END AS new_labels,
                       CASE WHEN len(new_markers) = 0 AND len(mid_labels) = 0 THEN coalesce(followup, 12) ELSE followup END AS new_followup
                FROM (
                    SELECT *, CASE WHEN graded THEN CAST([] AS VARCHAR[]) ELSE labels END AS mid_labels,
                           CASE WHEN graded THEN CAST([] AS VARCHAR[]) ELSE list_filter(markers, lambda m: NOT (m = 'MSI_status' AND (contains(words, '去除MSI') OR contains(words, '纯形态学'))) AND NOT (m = 'HER2' AND contains(words, '去除HER2'))) END AS new_markers,
                           CASE WHEN graded AND len(notes) = 0 THEN ['who_grade'] ELSE notes END AS new_notes,
                           CASE WHEN regexp_matches(words, '切换任务类型为') THEN regexp_extract(words, '切换任务类型为 (\\w+)', 1) WHEN graded THEN 'grade_classification' ELSE task END AS mid_task
                    FROM (SELECT *, array_to_string(said, ' ') AS words, contains(array_to_string(said, ' '), 'grade_classification') AS graded FROM ({JUDGED.format(source="(SELECT * FROM walk WHERE open AND step < 2)")}))
                )
            )
        )
    )
)
SELECT o_orderkey, task AS task_type, array_to_string(labels, '|') AS labels, array_to_string(markers, '|') AS markers, array_to_string(notes, '|') AS annotations, followup, array_to_string(stages, '|') AS stages, array_to_string(log, '|') AS log
FROM walk QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY step DESC) = 1""",
}
