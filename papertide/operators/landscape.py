"""The landscape of a data centre: one entry a disease (catalogue, pools, coverage), kept as JSON and read as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertide.functions import scoring
from papertide.operators.concepts import holds_any

#: Words of an attribute that tell what is annotated, and stages that count as advanced; fixed values.
ANNOTATED = {"tnm_stage": ["tnm", "分期", "stage"], "who_grade": ["who", "分级", "grade", "分化"], "tumor_region": ["肿瘤", "区域", "segment"], "lauren_classification": ["lauren", "劳伦"]}
ADVANCED = ["III", "IV", "3期", "4期", "晚期"]
#: Pools of molecular results and the markers' names there; fixed values.
MOLECULAR = {"has_msi_status": ["MSI"], "has_her2": ["HER2"], "has_egfr": ["EGFR"], "has_alk": ["ALK"], "has_pd_l1": ["PD-L1", "PDL1", "PD_L1"]}
#: What a coverage row is called and the pool that it comes from; fixed values.
ANNOTATIONS = {"tnm_stage": "has_tnm_stage", "who_grade": "has_who_grade", "tumor_region": "has_tumor_region", "lauren_classification": "has_who_grade"}
FOLLOWED = {"overall_survival_months": "has_survival_label", "death_event": "has_survival_label"}
MARKERS = {"MSI_status": "has_msi_status", "HER2": "has_her2", "EGFR_mutation": "has_egfr", "ALK_fusion": "has_alk", "PD_L1_TPS": "has_pd_l1"}
#: Markers whose positivity an entry tells, mentions that it lists.
POSITIVE, MENTIONS = ("HER2", "EGFR", "MSI", "P16", "Ki-67", "PD-L1"), 10


def catalogue_entries(diseases: DataFrame, stats: DataFrame) -> DataFrame:
    """diseases (disease_id, disease_db_id, name_zh, organ, organ_system, description) with the sums of their hospitals
    (disease_id, patient_count, slide_count): those without a code or patients are left out."""
    rows = diseases.filter("disease_id <> ''").join(stats.select("disease_id", "patient_count", "slide_count"), "disease_id").filter("patient_count > 0")
    return rows.select(
        "disease_id", "disease_db_id", F.coalesce("name_zh", F.lit("")).alias("name_zh"), F.lit("").alias("name_en"), F.coalesce("organ", F.lit("")).alias("organ"), F.coalesce("organ_system", F.lit("")).alias("organ_system"), "description",
        F.col("patient_count").alias("total_cases"), F.col("slide_count").alias("total_wsi_slides"), (F.col("slide_count") > 0).alias("has_ihc"), F.lit(True).alias("has_followup"), F.lit(None).cast("int").alias("data_since_year"),
    )


def pools_of(stats: DataFrame, patients: DataFrame, attributes: DataFrame, results: DataFrame) -> DataFrame:
    """(disease_id, pools map<string,long>, lauren_cases): what of each disease's patients has what.

    stats (disease_id, patient_count, slide_count), patients (disease_id, patient_id), attributes
    (patient_id, told: all that an attribute says), results (patient_id, biomarker). Patients without
    an attribute are estimated where the centre tells none; molecular pools are there only where
    patients are listed. Flags are settled a patient first, so that no disease is one task's.
    """
    listed = patients.filter("patient_id IS NOT NULL").select("disease_id", "patient_id").distinct()
    flags = [F.max(holds_any(F.col("told"), words)).alias(name) for name, words in (ANNOTATED | {"advanced": ADVANCED}).items()]
    told = attributes.groupBy("patient_id").agg(*flags)
    markers = [F.max(F.upper("biomarker").isin([n.upper() for n in names])).alias(pool) for pool, names in MOLECULAR.items()]
    tested = results.groupBy("patient_id").agg(*markers)
    names = [*ANNOTATED, "advanced", *MOLECULAR]
    counts = listed.join(told, "patient_id", "left").join(tested, "patient_id", "left").groupBy("disease_id").agg(F.count(F.lit(1)).alias("listed"), *[F.count_if(F.col(n)).alias(n) for n in names])
    rows = stats.join(counts, "disease_id", "left").fillna(0, ["listed", *names])
    cases = F.greatest("patient_count", "listed")
    slides = F.when(F.col("slide_count") > 0, F.coalesce(F.nullif(F.col("listed"), F.lit(0)), F.col("patient_count"))).otherwise(F.lit(0))
    part = lambda hundredths: F.floor(cases * hundredths / 100).cast("long")
    or_else = lambda count, guess: F.coalesce(F.nullif(F.col(count), F.lit(0)), guess)
    molecular = {pool: F.when(F.col("listed") > 0, F.col(pool)) for pool in MOLECULAR}
    every = {
        "has_wsi": F.coalesce(F.nullif(slides, F.lit(0)), cases), "has_survival_label": part(85), "has_death_event": part(85), "has_tnm_stage": or_else("tnm_stage", part(90)), "has_who_grade": or_else("who_grade", part(85)),
        "has_tumor_region": F.col("tumor_region"), "meets_followup_6m": part(80), "meets_followup_12m": part(75), "in_target_stage_III_IV": F.col("advanced"), "all_survival_no_msi": part(75),
        "all_survival_tnm_no_msi": F.least(part(75), or_else("tnm_stage", part(75))),
    } | molecular
    all_of = ["has_msi_status", "has_survival_label", "has_tnm_stage", "in_target_stage_III_IV"]
    every["all_msi_survival_tnm_stage_III_IV"] = F.when((every["has_msi_status"] > 0) & (every["has_tnm_stage"] > 0) & (F.col("advanced") > 0), F.least(*[every[p] for p in all_of]))
    cells = F.array_compact(F.array(*[F.when(value.isNotNull(), F.struct(F.lit(pool).alias("key"), value.cast("long").alias("value"))) for pool, value in every.items()]))
    return rows.select("disease_id", F.map_from_entries(cells).alias("pools"), F.col("lauren_classification").alias("lauren_cases"))


def have(pool: str, pools: str = "pools") -> Column:
    return F.coalesce(F.try_element_at(F.col(pools), F.lit(pool)), F.lit(0))


def covered(count: Column, total: Column) -> Column:
    return scoring.half_up(count / F.greatest(total, F.lit(1)), 2)


def coverage_rows(entries: DataFrame) -> DataFrame:
    """(disease_id, part, field, cases, coverage): what the pools of entries (disease_id, pools, total_cases) support,
    one row for each task, annotation, follow-up field and marker that has cases.

    The tasks are survival prediction, grading, molecular subtypes (the largest of three markers) and
    segmentation, whose share isn't told.
    """
    total = F.coalesce("total_cases", F.lit(0))
    cell = lambda part, field, count, share=True: F.struct(F.lit(part).alias("part"), F.lit(field).alias("field"), count.alias("cases"), (covered(count, total) if share else F.lit(None).cast("double")).alias("coverage"))
    subtype = F.greatest(have("has_msi_status"), have("has_her2"), have("has_egfr"))
    cells = [
        cell("task", "survival_prediction", have("has_survival_label")), cell("task", "grade_classification", have("has_who_grade")),
        cell("task", "molecular_subtype_classification", subtype), cell("task", "region_segmentation", have("has_tumor_region"), False),
    ]
    for part, fields in (("annotation", ANNOTATIONS), ("followup", FOLLOWED), ("marker", MARKERS)):
        cells += [cell(part, field, have(pool)) for field, pool in fields.items()]
    return entries.select("disease_id", F.inline(F.filter(F.array(*cells), lambda c: c["cases"] > 0)))


def extras(subtypes: DataFrame, attributes: DataFrame, matches: DataFrame, results: DataFrame) -> DataFrame:
    """(disease_id, v11): distributions of subtypes (disease_id, value) and attributes (disease_id, attribute, value), the
    matches (disease_id, status, mention) by state with the commonest mentions, and positivity of six markers from
    results (disease_id, patient_id, biomarker, result)."""
    count = lambda rows, *by: rows.groupBy("disease_id", *by).agg(F.count(F.lit(1)).alias("n"))
    order = lambda *by: F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("rank"), *by)))
    listed = lambda cells, *by: F.transform(cells, lambda c: F.struct(*[c[b].alias(b) for b in by], (-c["rank"]).alias("count")))
    unknown = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("(unknown)")).alias(c)
    parts = [
        count(subtypes.select("disease_id", unknown("value")), "value").groupBy("disease_id").agg(listed(order("value"), "value").alias("subtype_distribution")),
        count(attributes, "attribute", "value").groupBy("disease_id").agg(listed(order("attribute", "value"), "attribute", "value").alias("attribute_distribution")),
    ]
    states = count(matches.select("disease_id", unknown("status")), "status").groupBy("disease_id").agg(F.sum("n").alias("total_matches"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("verification_status"))
    # only a disease's commonest mentions are gathered
    ranked = count(matches.select("disease_id", unknown("mention")), "mention").groupBy("disease_id").agg(F.expr(f"slice(array_sort(collect_list(struct(-n AS rank, mention))), 1, {MENTIONS})").alias("_m"))
    summary = states.join(ranked, "disease_id").select("disease_id", F.struct("total_matches", "verification_status", listed(F.col("_m"), "mention").alias("top_mentions")).alias("text_match_summary"))
    tested = results.filter(F.col("biomarker").isin(*POSITIVE)).groupBy("disease_id", "biomarker", "patient_id").agg(F.max(scoring.is_positive(F.col("result"))).alias("positive"))
    rates = tested.groupBy("disease_id", "biomarker").agg(F.count(F.lit(1)).alias("tested_patients"), F.count_if("positive").alias("positive_patients")).withColumn("positivity_rate", scoring.half_up(F.col("positive_patients") / F.col("tested_patients"), 3))
    place = F.array_position(F.array(*map(F.lit, POSITIVE)), F.col("biomarker"))
    rates = rates.groupBy("disease_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("_p"), F.struct("biomarker", "tested_patients", "positive_patients", "positivity_rate").alias("_r")))), lambda x: x["_r"]).alias("molecular_positivity"))
    out = parts[0]
    for other in (parts[1], summary, rates):
        out = out.join(other, "disease_id", "full")
    return out.select("disease_id", F.struct(F.lit("v1.1").alias("schema_version"), *[c for c in out.columns if c != "disease_id"]).alias("v11"))


def payloads(catalogue: DataFrame, pools: DataFrame, v11: DataFrame | None = None) -> DataFrame:
    """(disease_id, payload): each disease's entry as JSON."""
    rows = catalogue.join(pools, "disease_id")
    total, markers = F.col("total_cases"), ("has_msi_status", "has_her2", "has_egfr", "has_alk")
    catalogue_cell = F.struct("disease_id", "disease_db_id", "name_zh", "name_en", "organ", "organ_system", "description", "total_cases", "total_wsi_slides", "has_ihc", F.greatest(*[have(m) > 0 for m in markers]).alias("has_molecular"), "has_followup", "data_since_year")
    sizes = F.struct("disease_id", "total_cases", "total_wsi_slides", F.coalesce(F.try_element_at("pools", F.lit("has_wsi")), total).alias("cases_with_wsi"), have("has_survival_label").alias("cases_with_followup"))
    rows = rows.join(coverage_rows(rows.select("disease_id", "pools", "total_cases")).groupBy("disease_id").agg(F.array_sort(F.collect_list(F.struct("part", "field", "cases", "coverage"))).alias("_rows")), "disease_id", "left")
    of = lambda part: F.transform(F.filter("_rows", lambda c: c["part"] == part), lambda c: F.struct(c["field"].alias("field"), c["cases"].alias("available_cases"), c["coverage"].alias("coverage"))).alias(part)
    cells = [F.col("disease_id"), catalogue_cell.alias("catalog"), sizes.alias("sample_size"), *[of(p) for p in ("task", "annotation", "followup", "marker")], F.col("pools").alias("feasibility_pools"), F.lit("v1.1").alias("schema_version")]
    if v11 is not None:
        rows, cells = rows.join(v11, "disease_id", "left"), [*cells, F.col("v11")]
    return rows.select("disease_id", F.to_json(F.struct(*cells)).alias("payload"))


def landscape(table: DataFrame) -> DataFrame:
    """All entries of a landscape table (disease_id, payload, ...), their payloads as VARIANT; null where a payload is
    no JSON. Other columns stay."""
    return table.withColumn("payload", F.try_parse_json("payload"))


def schema_of_landscape(table: DataFrame) -> str:
    """The fields that the payloads have, as one schema: found by the executors, a string for the driver."""
    return landscape(table).agg(F.schema_of_variant_agg("payload")).first()[0]


def scale_metrics(entries: DataFrame) -> DataFrame:
    """(disease_id, total_cases, wsi, followup, molecular, names) of landscape entries: for each number the first that is
    told and not 0, the largest molecular pool, and the names that lead to the entry."""
    number = lambda path: F.try_variant_get("payload", f"$.{path}", "long")
    first = lambda *paths: F.coalesce(*[F.nullif(number(p), F.lit(0)) for p in paths], F.lit(0)).cast("long")
    text = lambda path: F.nullif(F.try_variant_get("payload", f"$.{path}", "string"), F.lit(""))
    pools = [f"feasibility_pools.{p}" for p in MOLECULAR]
    return entries.select(
        "disease_id", first("sample_size.total_cases", "catalog.total_cases").alias("total_cases"), first("sample_size.total_wsi_slides", "sample_size.cases_with_wsi", "feasibility_pools.has_wsi").alias("wsi"),
        first("sample_size.cases_with_followup", "feasibility_pools.has_survival_label", "feasibility_pools.meets_followup_12m").alias("followup"),
        F.greatest(*[F.coalesce(number(p), F.lit(0)) for p in pools]).cast("long").alias("molecular"), F.array_compact(F.array(text("catalog.name_en"), text("catalog.name_zh"), F.nullif(F.col("disease_id"), F.lit("")))).alias("names"),
    )


def organ_catalogue(catalogue: DataFrame, organ: str | None = None, min_cases: int = 50) -> DataFrame:
    """The diseases of an organ or organ system, in any case, with at least so many cases."""
    rows = catalogue.filter(F.coalesce("total_cases", F.lit(0)) >= min_cases) if min_cases else catalogue
    return rows.filter((F.lower("organ_system") == organ.lower()) | (F.lower("organ") == organ.lower())) if organ else rows


# The star schema as a data centre: nations are diseases, customers patients, orders attributes and results. ----------


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def patients_of(spark, sf_dir: str) -> DataFrame:
    """Every customer of a nation with an even key counts as listed."""
    return read(spark, sf_dir, "customer").filter("c_nationkey % 2 = 0").select(F.concat(F.lit("D"), "c_nationkey").alias("disease_id"), F.col("c_custkey").alias("patient_id"))


def stats_of(spark, sf_dir: str) -> DataFrame:
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    slides = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("slides"))
    per = c.join(slides, "c_custkey", "left").groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") > 2000).alias("patient_count"), F.sum(F.expr("IF(c_nationkey % 5 = 0, 0L, coalesce(slides, 0L))")).alias("slide_count"))
    return per.select(F.concat(F.lit("D"), "c_nationkey").alias("disease_id"), "patient_count", "slide_count")


def diseases_of(spark, sf_dir: str) -> DataFrame:
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    rows = n.join(r, n.n_regionkey == r.r_regionkey)
    return rows.select(F.concat(F.lit("D"), "n_nationkey").alias("disease_id"), F.col("n_nationkey").alias("disease_db_id"), F.col("n_name").alias("name_zh"), F.col("r_name").alias("organ"), F.lower("r_name").alias("organ_system"), F.lit(None).cast("string").alias("description"))


def orders_told(spark, sf_dir: str) -> DataFrame:
    """Orders with what they say as attributes and as molecular results of their customers."""
    told = F.expr("CASE WHEN o_totalprice > 480000 THEN 'TNM: stage III' WHEN o_totalprice > 420000 THEN 'WHO Grade 2' WHEN o_totalprice > 400000 THEN 'segment' WHEN o_totalprice > 398000 THEN 'Lauren' ELSE 'size' END")
    marker = F.expr("CASE WHEN o_orderkey % 13 = 0 THEN 'HER2' WHEN o_orderkey % 17 = 0 THEN 'MSI' WHEN o_orderkey % 19 = 0 THEN 'PDL1' WHEN o_orderkey % 23 = 0 THEN 'egfr' END")
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("patient_id"), told.alias("told"), marker.alias("biomarker"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))


def pools_of_nations(spark, sf_dir: str) -> DataFrame:
    orders = orders_told(spark, sf_dir)
    return pools_of(stats_of(spark, sf_dir), patients_of(spark, sf_dir), orders, orders.filter("biomarker IS NOT NULL"))


def catalogue_of_centre(spark, sf_dir: str) -> DataFrame:
    return catalogue_entries(diseases_of(spark, sf_dir), stats_of(spark, sf_dir)).select("disease_id", "name_zh", "organ", "organ_system", "total_cases", "total_wsi_slides", "has_ihc")


def pool_rows(spark, sf_dir: str) -> DataFrame:
    return pools_of_nations(spark, sf_dir).select("disease_id", F.explode("pools").alias("pool", "cases"))


def coverage_of_centre(spark, sf_dir: str) -> DataFrame:
    entries = catalogue_entries(diseases_of(spark, sf_dir), stats_of(spark, sf_dir)).join(pools_of_nations(spark, sf_dir), "disease_id")
    return coverage_rows(entries).select("disease_id", "part", "field", F.col("cases").cast("long").alias("cases"), F.floor(F.col("coverage") * 100 + 0.5).cast("long").alias("coverage_pct"))


def extras_of_centre(spark, sf_dir: str) -> DataFrame:
    of = read(spark, sf_dir, "customer").select(F.concat(F.lit("D"), "c_nationkey").alias("disease_id"), F.col("c_custkey").alias("patient_id"), "c_mktsegment")
    orders = orders_told(spark, sf_dir).join(of, "patient_id")
    results = orders.select("disease_id", "patient_id", "biomarker", F.when(F.col("status") == "F", "positive").otherwise("negative").alias("result"))
    return extras(of.select("disease_id", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("value")), orders.select("disease_id", F.lit("told").alias("attribute"), F.col("told").alias("value")), orders.select("disease_id", "status", F.col("priority").alias("mention")), results)


def metrics_of_centre(spark, sf_dir: str) -> DataFrame:
    """The centre's entries written as JSON and read back as VARIANT, with their metrics."""
    entries = payloads(catalogue_entries(diseases_of(spark, sf_dir), stats_of(spark, sf_dir)), pools_of_nations(spark, sf_dir), extras_of_centre(spark, sf_dir))
    return scale_metrics(landscape(entries)).withColumn("names", F.array_join("names", "|"))


def extras_rows(spark, sf_dir: str) -> DataFrame:
    """The extras unfolded: (disease_id, part, field, n, of)."""
    v = extras_of_centre(spark, sf_dir)
    cell = lambda part, field, n, of: F.struct(F.lit(part).alias("part"), field.alias("field"), n.cast("long").alias("n"), of.cast("long").alias("of"))
    zero = F.lit(0)
    cells = F.concat(
        F.transform("v11.subtype_distribution", lambda c: cell("subtype", c["value"], c["count"], zero)), F.transform("v11.attribute_distribution", lambda c: cell("attribute", c["value"], c["count"], zero)),
        F.transform(F.map_entries("v11.text_match_summary.verification_status"), lambda c: cell("status", c["key"], c["value"], F.col("v11.text_match_summary.total_matches"))),
        F.transform("v11.text_match_summary.top_mentions", lambda c: cell("mention", c["mention"], c["count"], zero)),
        F.coalesce(F.transform("v11.molecular_positivity", lambda c: cell("marker", c["biomarker"], c["positive_patients"], c["tested_patients"])), F.array()),
    )
    return v.select("disease_id", F.inline(cells))
