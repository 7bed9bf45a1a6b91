"""Hypotheses from gaps, the gaps of their data, and their evolution by what the gap analysis suggests.

A hypothesis is a row: task_type, labels, markers, annotations (arrays), followup (months or null) and
stages (the subgroup), beside its pools (map<string,long>) and the other tasks of its disease. Its
evolution is a bounded number of unrolled steps over that row's state, so that it needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertide.functions import scoring
from papertide.operators.checkpoints import checkpointed
from papertide.operators.concepts import holds_any

#: Pools of markers, labels and annotations; others are called has_ and their name. Fixed values.
MARKER_POOLS = {"MSI_status": "has_msi_status", "msi_status": "has_msi_status", "HER2": "has_her2", "her2": "has_her2", "EGFR_mutation": "has_egfr", "egfr_mutation": "has_egfr", "EGFR": "has_egfr", "ALK_fusion": "has_alk", "alk_fusion": "has_alk", "ALK": "has_alk", "PD_L1_TPS": "has_pd_l1", "PD-L1": "has_pd_l1", "pd_l1": "has_pd_l1"}
LABEL_POOLS = {"overall_survival_months": "has_survival_label", "death_event": "has_death_event", "disease_free_survival": "has_survival_label"}
ANNOTATION_POOLS = {"tnm_stage": "has_tnm_stage", "who_grade": "has_who_grade", "tumor_region": "has_tumor_region", "lauren_classification": "has_who_grade"}
SURVIVAL, LATE = ("overall_survival_months", "death_event"), ("III", "IV", "III/IV")
STATE = ["task_type", "labels", "markers", "annotations", "followup", "stages"]
ENOUGH, TOO_LITTLE, STEPS, COHORT = 0.8, 0.2, 2, 500


def texts(*values: str) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def named(key: Column, known: dict[str, str], other: Column) -> Column:
    """The pool of a key: a fixed one, or else `other`."""
    cells = [F.lit(x) for pair in known.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*cells), key), other)


def from_gap(gaps: DataFrame) -> DataFrame:
    """gaps (gap_title, gap_text) with the state of the hypothesis that their words ask for.

    The first family of words decides: survival, segmentation, grading, molecular (where HER2 takes the
    place of MSI); without any, the task is survival prediction that needs no label. Words of a stage
    add its annotation. Null titles and texts are empty.
    """
    text = F.lower(F.concat_ws(" ", F.coalesce("gap_title", F.lit("")), F.coalesce("gap_text", F.lit(""))))
    survival, region = holds_any(text, ["survival", "生存", "prognos", "os ", "dfs"]), holds_any(text, ["segment", "分割", "region"])
    grade, molecular = holds_any(text, ["grade", "分级", "who"]), holds_any(text, ["molecular", "分子", "msi", "her2", "pd-l1", "pd_l1"])
    kind = F.when(survival, "survival").when(region, "region").when(grade, "grade").when(molecular, "molecular").otherwise("")
    rows = gaps.withColumn("_text", text).withColumn("_kind", kind)
    marker = F.when(F.contains("_text", F.lit("her2")), texts("HER2")).when(F.contains("_text", F.lit("msi")), texts("MSI_status")).otherwise(texts())
    annotation = F.when(F.col("_kind") == "region", texts("tumor_region")).when(F.col("_kind") == "grade", texts("who_grade")).otherwise(texts())
    staged = F.when(holds_any(F.col("_text"), ["tnm", "stage", "分期"]), texts("tnm_stage")).otherwise(texts())
    return rows.select(
        *gaps.columns, F.expr("CASE _kind WHEN 'region' THEN 'region_segmentation' WHEN 'grade' THEN 'grade_classification' WHEN 'molecular' THEN 'molecular_subtype_classification' ELSE 'survival_prediction' END").alias("task_type"),
        F.when(F.col("_kind") == "survival", texts(*SURVIVAL)).otherwise(texts()).alias("labels"), F.when(F.col("_kind") == "molecular", marker).otherwise(texts()).alias("markers"), F.array_union(annotation, staged).alias("annotations"),
        F.when(F.col("_kind") == "survival", 12).cast("int").alias("followup"), texts().alias("stages"),
    )


def held(pool: Column | str, default: Column | int) -> Column:
    pool = F.lit(pool) if isinstance(pool, str) else pool
    return F.coalesce(F.try_element_at(F.col("pools"), pool), F.lit(default) if isinstance(default, int) else default)


def pool_of_marker(marker: Column) -> Column:
    return held(named(marker, MARKER_POOLS, F.concat(F.lit("has_"), F.lower(marker))), 0)


def months() -> Column:
    return F.concat(F.lit("meets_followup_"), F.col("followup").cast("string"), F.lit("m"))


def assessed(rows: DataFrame) -> DataFrame:
    """rows with wsi, cohort and score: the least of the pools that the state needs, and its share of the slides.

    A missing label or annotation counts as the slides, a missing marker as none, a missing follow-up as
    that of twelve months or else as no limit. Late stages take their pool, and with MSI and labels that
    of all three. Labels without markers take the pool of survival without MSI instead, less the known
    annotations, where there is one.
    """
    wsi = held("has_wsi", 0)
    other = lambda k: F.concat(F.lit("has_"), k)
    labels = F.transform("labels", lambda k: held(named(k, LABEL_POOLS, other(k)), wsi))
    notes = F.transform("annotations", lambda k: held(named(k, ANNOTATION_POOLS, other(k)), wsi))
    markers = F.transform("markers", pool_of_marker)
    follow = F.when(F.coalesce("followup", F.lit(0)) > 0, F.coalesce(F.try_element_at("pools", months()), F.try_element_at("pools", F.lit("meets_followup_12m"))))
    late = F.arrays_overlap("stages", texts(*LATE))
    stage = F.when(late, F.try_element_at("pools", F.lit("in_target_stage_III_IV")))
    all_three = F.when(F.array_contains("markers", "MSI_status") & (F.size("labels") > 0) & (F.size("stages") > 0), F.try_element_at("pools", F.lit("all_msi_survival_tnm_stage_III_IV")))
    least = F.array_min(F.array_compact(F.concat(F.array(wsi), labels, notes, markers, F.array(follow, stage, all_three))))
    plain = F.try_element_at(F.col("pools"), F.lit("all_survival_no_msi"))
    known = F.filter("annotations", lambda k: k.isin(*ANNOTATION_POOLS))
    instead = F.array_min(F.concat(F.array(plain), F.transform(known, lambda k: held(named(k, ANNOTATION_POOLS, k), plain))))
    cohort = F.when((F.size("markers") == 0) & (F.size("labels") > 0) & plain.isNotNull(), instead).otherwise(least)
    rows = rows.withColumns({"wsi": wsi, "cohort": cohort})
    share = scoring.half_up(F.col("cohort") / F.greatest("wsi", F.lit(1)), 2)
    return rows.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)))


def data_gaps() -> tuple[Column, Column]:
    """The gaps of a state's data, and at most three suggestions; other_tasks are the tasks that its disease supports.

    A marker is a gap below seven tenths of the slides (grave below half); a follow-up always is one,
    of weight where fewer than 500 patients have it. Without a marker's gap, to relax the markers is
    suggested and, where the disease's tasks are known, the first other task.
    """
    wsi = F.greatest(held("has_wsi", 1), F.lit(1))
    share = lambda m: scoring.half_up(pool_of_marker(m) / wsi, 2)
    short = F.filter("markers", lambda m: share(m) < 0.7)
    cell = lambda field, coverage, eligible, severity: F.struct(field.alias("field"), coverage.cast("double").alias("coverage"), eligible.cast("long").alias("eligible"), severity.alias("severity"))
    nothing = F.lit(None)
    of_markers = F.transform(short, lambda m: cell(F.lower(m), share(m), nothing, F.when(share(m) < 0.5, "HIGH").otherwise("MEDIUM")))
    eligible = held(months(), 0)
    of_follow = F.when(F.coalesce("followup", F.lit(0)) > 0, F.array(cell(F.concat(F.lit("min_followup_"), F.col("followup").cast("string"), F.lit("months")), nothing, eligible, F.when(eligible < COHORT, "MEDIUM").otherwise("LOW"))))
    gaps = F.concat(of_markers, F.coalesce(of_follow, F.array().cast("array<struct<field:string,coverage:double,eligible:bigint,severity:string>>")))
    told = lambda n: n.cast("string")
    drop = F.transform(short, lambda m: F.concat(F.lit("去除"), m, F.lit("条件，聚焦纯形态学任务（可用样本约"), told(held("all_survival_no_msi", pool_of_marker(m))), F.lit("例）")))
    relax = F.concat(F.lit("放宽分子标记条件，聚焦形态学+临床标签（可用约"), told(held("all_survival_no_msi", held("has_survival_label", 0))), F.lit("例）"))
    task = F.coalesce(F.try_element_at(F.filter("other_tasks", lambda t: t != F.col("task_type")), F.lit(1)), F.lit("grade_classification"))
    switch = F.when(F.coalesce(F.size("other_tasks"), F.lit(0)) > 0, F.concat(F.lit("切换任务类型为 "), task, F.lit(" 以提高可用样本量")))
    suggestions = F.when(F.size(short) > 0, F.slice(drop, 1, 3)).otherwise(F.array_compact(F.array(relax, switch)))
    return gaps, suggestions


def applied(rows: DataFrame, suggestions: str) -> DataFrame:
    """rows with their state changed by the words of the suggestions, one edit after the other."""
    words = F.array_join(suggestions, " ")
    text = F.lower(words)
    says = lambda *w: holds_any(text, w)
    none = texts()
    rows = rows.withColumn("markers", F.when(says("去除msi", "remove msi", "不依赖msi", "纯形态学"), F.filter("markers", lambda m: ~F.lower(m).isin("msi_status", "msi"))).otherwise(F.col("markers")))
    rows = rows.withColumn("markers", F.when(says("去除her2", "不依赖her2"), F.filter("markers", lambda m: F.upper(m) != "HER2")).otherwise(F.col("markers")))
    grade, region = says("grade_classification", "分级"), says("segmentation", "分割")
    named_task = F.regexp_extract(words, r"(?U)切换任务类型为\s*(\w+)", 1)
    rows = rows.withColumns({
        "labels": F.when(grade | region, none).otherwise(F.col("labels")), "markers": F.when(grade | region, none).otherwise(F.col("markers")),
        "annotations": F.when(grade & (F.size("annotations") == 0), texts("who_grade")).otherwise(F.col("annotations")),
        "task_type": F.when(named_task != "", named_task).when(region, "region_segmentation").when(grade, "grade_classification").otherwise(F.col("task_type")),
        "followup": F.when(region, F.lit(None)).when(says("缩短随访", "放宽随访") & (F.col("followup") > 0), F.greatest(F.lit(6), F.col("followup") - 6)).otherwise(F.col("followup")),
        "stages": F.when(says("stage", "分期"), none).otherwise(F.col("stages")),
    })
    bare = (F.size("markers") == 0) & (F.size("labels") == 0)
    return rows.withColumns({
        "task_type": F.when(bare, "survival_prediction").otherwise(F.col("task_type")), "labels": F.when(bare, texts(*SURVIVAL)).otherwise(F.col("labels")),
        "followup": F.when(bare, F.coalesce(F.nullif("followup", F.lit(0)), F.lit(12))).otherwise(F.col("followup")),
    })


def evolved(rows: DataFrame, steps: int = STEPS, given: str | None = None) -> DataFrame:
    """Hypotheses (state, pools, other_tasks) after at most `steps` refinements, and their log.

    Each step assesses the state. It ends at a score of .8 or more, is rejected below .2, and ends where
    the suggestions change nothing; else it goes on with the changed state. The first step takes the
    suggestions of the column `given`, where there is one, the others those of data_gaps. The log has
    (iteration, action, score, status, cohort) for each assessment and for what followed: reject,
    no_change or refine. Null arrays count as empty; rows that repeat evolve alike.
    """
    empty = {c: F.coalesce(c, texts()) for c in ("labels", "markers", "annotations", "stages", "other_tasks")}
    entry = "struct<iteration:int,action:string,score:double,status:string,cohort:bigint>"
    rows = rows.withColumns(empty | {"pools": F.coalesce("pools", F.create_map().cast("map<string,bigint>")), "log": F.array().cast(f"array<{entry}>"), "_open": F.lit(True)})
    keep = [c for c in rows.columns if c != "_open"]
    for step in range(1, steps + 1):
        rows = assessed(rows)
        _, own = data_gaps()
        rows = rows.withColumn("_said", F.coalesce(F.col(given), own) if step == 1 and given else own)
        rows = rows.withColumn("_old", F.struct(*STATE))
        after = applied(rows, "_said").withColumn("_new", F.struct(*STATE))
        action = F.when(~F.col("_open"), None).when(F.col("score") >= ENOUGH, "done").when(F.col("score") < TOO_LITTLE, "reject").when(F.col("_new").eqNullSafe(F.col("_old")), "no_change").otherwise("refine")
        after = after.withColumn("_action", action)
        line = lambda what, full: F.struct(F.lit(step).alias("iteration"), what.alias("action"), *[(F.col(c) if full else F.lit(None)).cast(t).alias(n) for n, t, c in (("score", "double", "score"),)], (scoring.feasibility_status(F.col("score")) if full else F.lit(None).cast("string")).alias("status"), (F.col("cohort") if full else F.lit(None)).cast("bigint").alias("cohort"))
        lines = F.when(F.col("_action").isNull(), F.array().cast(f"array<{entry}>")).when(F.col("_action") == "done", F.array(line(F.lit("assess"), True))).otherwise(F.array(line(F.lit("assess"), True), line(F.col("_action"), False)))
        goes = F.coalesce(F.col("_action") == "refine", F.lit(False))
        state = {c: F.when(goes, F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")) for c in STATE}
        rows = after.withColumns({"log": F.concat("log", lines), "_open": goes, **state}).select(*keep, "_open")
    return rows.drop("_open")


# The star schema's hypotheses: orders are gaps, their customers' nations the diseases. ----------------


def gaps_of_orders(spark, sf_dir: str) -> DataFrame:
    """(o_orderkey, gap_title, gap_text, disease_id): what an order's key and status say."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    words = F.expr("element_at(array('Survival of all', 'Region growing', 'WHO grade', 'molecular MSI', 'her2 and msi', 'PD-L1 molecular', 'nothing told', 'molecular HER2 TNM'), CAST(o_orderkey % 8 + 1 AS INT))")
    more = F.expr("CASE o_orderstatus WHEN 'P' THEN 'by stage' WHEN 'F' THEN NULL ELSE 'x' END")
    rows = t("orders").join(t("customer"), F.expr("o_custkey = c_custkey"))
    return rows.select("o_orderkey", words.alias("gap_title"), more.alias("gap_text"), F.concat(F.lit("D"), "c_nationkey").alias("disease_id"))


def hypotheses_of_orders(spark, sf_dir: str) -> DataFrame:
    found = from_gap(gaps_of_orders(spark, sf_dir))
    joined = lambda c: F.array_join(c, "|").alias(c)
    return found.select("o_orderkey", "task_type", joined("labels"), joined("markers"), joined("annotations"), "followup")


def evolving(spark, sf_dir: str) -> DataFrame:
    """Hypotheses of all orders with their nation's pools, at late stages where the key is even, and the tasks it supports."""
    return evolving_of(gaps_of_orders(spark, sf_dir), spark, sf_dir)


def evolving_of(gaps: DataFrame, spark, sf_dir: str) -> DataFrame:
    from papertide.operators import landscape

    pools = landscape.pools_of_nations(spark, sf_dir).select("disease_id", "pools")
    rows = from_gap(gaps).join(pools, "disease_id")
    tasks = F.expr("IF(o_orderkey % 3 = 0, array('survival_prediction', 'grade_classification'), array())").cast("array<string>")
    return rows.withColumns({"stages": F.expr("IF(o_orderkey % 2 = 0, array('III'), array())").cast("array<string>"), "other_tasks": tasks})


def data_gaps_of_orders(spark, sf_dir: str) -> DataFrame:
    gaps, suggestions = data_gaps()
    rows = assessed(evolving(spark, sf_dir)).withColumns({"_g": gaps, "_s": suggestions})
    shown = F.array_join(F.transform("_g", lambda g: F.concat_ws(":", g["field"], F.round(g["coverage"] * 100).cast("long").cast("string"), g["eligible"].cast("string"), g["severity"])), "|")
    return rows.select("o_orderkey", F.col("cohort").cast("long").alias("cohort"), F.floor(F.col("score") * 100 + 0.5).cast("long").alias("score_pct"), shown.alias("gaps"), F.array_join("_s", "|").alias("suggestions"))


def evolved_orders(spark, sf_dir: str) -> DataFrame:
    # what repeats evolves alike, so that each gap of a disease, late or not, with tasks or without, evolves once
    gaps = gaps_of_orders(spark, sf_dir).withColumns({"_late": F.expr("o_orderkey % 2 = 0"), "_tasks": F.expr("o_orderkey % 3 = 0")})
    alike = ["gap_title", "gap_text", "disease_id", "_late", "_tasks"]
    kinds = checkpointed(evolved(evolving_of(gaps.groupBy(*alike).agg(F.min("o_orderkey").alias("o_orderkey")), spark, sf_dir)))
    same = F.lit(True)
    for c in alike:
        same = same & F.col(f"g.{c}").eqNullSafe(F.col(f"k.{c}"))
    rows = gaps.alias("g").join(kinds.alias("k"), same).select("g.o_orderkey", *[f"k.{c}" for c in ("task_type", "labels", "markers", "annotations", "followup", "stages", "log")])
    joined = lambda c: F.array_join(c, "|").alias(c)
    line = lambda x: F.concat_ws(":", x["iteration"].cast("string"), x["action"], F.floor(x["score"] * 100 + 0.5).cast("long").cast("string"), x["status"], x["cohort"].cast("string"))
    return rows.select("o_orderkey", "task_type", joined("labels"), joined("markers"), joined("annotations"), "followup", joined("stages"), F.array_join(F.transform("log", line), "|").alias("log"))
