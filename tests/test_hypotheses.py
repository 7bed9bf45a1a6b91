"""Hypotheses against a plain walk through the same rules, one row at a time."""

import random
import re

import pytest
from pyspark.sql import functions as F

from papertide.operators import hypotheses as h

COLUMNS = "id int, task_type string, labels array<string>, markers array<string>, annotations array<string>, followup int, stages array<string>, pools map<string,bigint>, other_tasks array<string>, given array<string>"


def half_up(x, digits):
    return int(x * 10**digits + 0.5) / 10**digits


def plain_assess(s, pools):
    wsi = pools.get("has_wsi", 0)
    needs = [wsi]
    needs += [pools.get(h.LABEL_POOLS.get(k, f"has_{k}"), wsi) for k in s["labels"]]
    needs += [pools.get(h.ANNOTATION_POOLS.get(k, f"has_{k}"), wsi) for k in s["annotations"]]
    needs += [pools.get(h.MARKER_POOLS.get(k, f"has_{k.lower()}"), 0) for k in s["markers"]]
    if s["followup"]:
        needs.append(pools.get(f"meets_followup_{s['followup']}m", pools.get("meets_followup_12m", min(needs))))
    if {"III", "IV", "III/IV"} & set(s["stages"]):
        needs.append(pools.get("in_target_stage_III_IV", min(needs)))
    if "MSI_status" in s["markers"] and s["labels"] and s["stages"]:
        needs.append(pools.get("all_msi_survival_tnm_stage_III_IV", min(needs)))
    cohort = min(needs)
    if not s["markers"] and s["labels"] and "all_survival_no_msi" in pools:
        cohort = pools["all_survival_no_msi"]
        for k in s["annotations"]:
            if k in h.ANNOTATION_POOLS:
                cohort = min(cohort, pools.get(h.ANNOTATION_POOLS[k], cohort))
    return cohort, min(1.0, max(0.0, half_up(cohort / max(wsi, 1), 2)))


def plain_suggestions(s, pools, tasks):
    out = []
    for m in s["markers"]:
        have = pools.get(h.MARKER_POOLS.get(m, f"has_{m.lower()}"), 0)
        if half_up(have / max(pools.get("has_wsi", 1), 1), 2) < 0.7:
            out.append(f"去除{m}条件，聚焦纯形态学任务（可用样本约{pools.get('all_survival_no_msi', have)}例）")
    if not out:
        out.append(f"放宽分子标记条件，聚焦形态学+临床标签（可用约{pools.get('all_survival_no_msi', pools.get('has_survival_label', 0))}例）")
        if tasks:
            out.append(f"切换任务类型为 {next((t for t in tasks if t != s['task_type']), 'grade_classification')} 以提高可用样本量")
    return out[:3]


def plain_apply(s, said):
    s, words = dict(s), " ".join(said)
    text = words.lower()
    if any(k in text for k in ("去除msi", "remove msi", "不依赖msi", "纯形态学")):
        s["markers"] = [m for m in s["markers"] if m.lower() not in ("msi_status", "msi")]
    if any(k in text for k in ("去除her2", "不依赖her2")):
        s["markers"] = [m for m in s["markers"] if m.upper() != "HER2"]
    if "grade_classification" in text or "分级" in text:
        s |= {"task_type": "grade_classification", "labels": [], "markers": [], "annotations": s["annotations"] or ["who_grade"]}
    if "segmentation" in text or "分割" in text:
        s |= {"task_type": "region_segmentation", "labels": [], "markers": [], "followup": None}
    if found := re.search(r"切换任务类型为\s*(\w+)", words):
        s["task_type"] = found.group(1)
    if any(k in text for k in ("缩短随访", "放宽随访")) and s["followup"]:
        s["followup"] = max(6, s["followup"] - 6)
    if "stage" in text or "分期" in text:
        s["stages"] = []
    if not s["markers"] and not s["labels"]:
        s |= {"task_type": "survival_prediction", "labels": list(h.SURVIVAL), "followup": s["followup"] or 12}
    return s


def plain_evolve(s, pools, tasks, given, steps):
    log = []
    for step in range(1, steps + 1):
        cohort, score = plain_assess(s, pools)
        log.append((step, "assess", score, cohort))
        if score >= 0.8:
            break
        if score < 0.2:
            log.append((step, "reject", None, None))
            break
        said = given if step == 1 and given is not None else plain_suggestions(s, pools, tasks)
        after = plain_apply(s, said)
        if after == s:
            log.append((step, "no_change", None, None))
            break
        log.append((step, "refine", None, None))
        s = after
    return s, log


@pytest.mark.parametrize("steps", [1, 2, 3])
def test_evolution(spark, steps):
    rng, rows = random.Random(steps), []
    some = lambda values, n: rng.sample(values, rng.randint(0, n))
    for i in range(250):
        pools = {k: rng.choice([0, 3, 150, 400, 600, 700, 1000]) for k in some(["has_survival_label", "has_death_event", "has_tnm_stage", "has_who_grade", "has_msi_status", "has_her2", "has_egfr", "meets_followup_6m", "meets_followup_12m", "in_target_stage_III_IV", "all_survival_no_msi", "all_msi_survival_tnm_stage_III_IV", "has_other"], 9)}
        pools["has_wsi"] = rng.choice([0, 700, 1000])
        given = rng.choice([None, None, [], ["缩短随访"], ["分割 segmentation"], ["按分级"], ["remove MSI", "drop stage"], ["切换任务类型为 别的_x 吧"]])
        rows.append((i, rng.choice(["survival_prediction", "grade_classification"]), some(["overall_survival_months", "other", "death_event"], 2), some(["MSI_status", "HER2", "EGFR", "Odd"], 3), some(["tnm_stage", "who_grade", "odd"], 2), rng.choice([None, 0, 6, 12, 24]), some(["III", "I"], 2), pools, some(["survival_prediction", "grade_classification", "x"], 2), given))
    rows.append((999, "t", None, None, None, None, None, None, None, None))
    got = {r.id: r for r in h.evolved(spark.createDataFrame(rows, COLUMNS), steps, "given").collect()}
    for r in rows:
        state = dict(zip(h.STATE, [r[1], *[x or [] for x in r[2:5]], r[5], r[6] or []], strict=True))
        want, log = plain_evolve(state, r[7] or {}, r[8] or [], r[9], steps)
        mine = got[r[0]]
        assert {c: mine[c] for c in h.STATE} == want, r
        assert [(x.iteration, x.action, x.score, x.cohort) for x in mine.log] == log, r


def test_gap_words(spark):
    rows = [("Survival and HER2", None), ("Tumour segmentation", "stage II"), ("WHO classes", ""), ("MSI by HER2", "molecular"), ("pd-l1 分期", None), (None, None), ("msi", "x")]
    got = [tuple(r[2:]) for r in h.from_gap(spark.createDataFrame(rows, "gap_title string, gap_text string")).collect()]
    assert got == [
        ("survival_prediction", list(h.SURVIVAL), [], [], 12, []), ("region_segmentation", [], [], ["tumor_region", "tnm_stage"], None, []), ("grade_classification", [], [], ["who_grade"], None, []),
        ("molecular_subtype_classification", [], ["HER2"], [], None, []), ("molecular_subtype_classification", [], [], ["tnm_stage"], None, []), ("survival_prediction", [], [], [], None, []), ("molecular_subtype_classification", [], ["MSI_status"], [], None, []),
    ]


def test_data_gaps(spark):
    pools = {"has_wsi": 1000, "has_her2": 697, "has_msi_status": 499, "has_egfr": 690, "meets_followup_12m": 400, "all_survival_no_msi": 700}
    row = spark.createDataFrame([(1, "t", [], ["HER2", "MSI_status", "EGFR", "Odd"], [], 12, [], pools, [], None)], COLUMNS)
    gaps, said = h.data_gaps()
    found = row.select(gaps.alias("g"), said.alias("s")).first()
    # .697 is .70 with two decimals: no gap; .499 is .50: no longer grave
    assert [(g.field, g.coverage, g.eligible, g.severity) for g in found.g] == [("msi_status", 0.5, None, "MEDIUM"), ("egfr", 0.69, None, "MEDIUM"), ("odd", 0.0, None, "HIGH"), ("min_followup_12months", None, 400, "MEDIUM")]
    assert len(found.s) == 3 and found.s[0] == "去除MSI_status条件，聚焦纯形态学任务（可用样本约700例）"
    bare = row.withColumn("markers", F.array().cast("array<string>")).withColumn("other_tasks", F.array(F.lit("t"), F.lit("u")))
    assert bare.select(said.alias("s")).first().s == ["放宽分子标记条件，聚焦形态学+临床标签（可用约700例）", "切换任务类型为 u 以提高可用样本量"]
