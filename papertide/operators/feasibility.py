"""Cohort feasibility: pools of patients, the cohort that a hypothesis leaves, and its score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertide.config import DEFAULT, EngineConfig
from papertide.functions import scoring
from papertide.operators import gap
from papertide.operators.strings import containments
from papertide.sources.corpus import Corpus


def pool(pools: Column, key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(pools, key), default)


def assess_from_pools(requests: DataFrame) -> DataFrame:
    """requests (pools map<string,int>, labels, annotations, markers arrays, min_followup_months) with cohort, score and status.

    The cohort is the least of the pools that the request needs: a missing label or annotation counts
    as the whole-slide pool, a missing marker as none. Labels without any marker take the pool of
    survival without that marker in its place, where there is one.
    """
    wsi = pool(F.col("pools"), F.lit("has_wsi"), F.lit(0))
    each = lambda col, default: F.transform(col, lambda k: pool(F.col("pools"), F.concat(F.lit("has_"), F.lower(k)), default))
    months = F.concat(F.lit("meets_followup_"), F.col("min_followup_months").cast("string"), F.lit("m"))
    follow = F.when(F.coalesce("min_followup_months", F.lit(0)) > 0, pool(F.col("pools"), months, pool(F.col("pools"), F.lit("meets_followup_12m"), wsi)))
    least = F.array_min(F.array_compact(F.concat(F.array(wsi), each("labels", wsi), each("annotations", wsi), each("markers", F.lit(0)), F.array(follow))))
    other = F.try_element_at(F.col("pools"), F.lit("all_survival_no_msi"))
    swap = (F.size("markers") == 0) & (F.size("labels") > 0) & other.isNotNull()
    replaced = F.array_min(F.concat(F.array(other), F.transform("annotations", lambda k: pool(F.col("pools"), F.concat(F.lit("has_"), F.lower(k)), other))))
    cohort = F.when(swap, replaced).otherwise(least)
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), scoring.half_up(F.col("cohort") / F.greatest(F.col("wsi"), F.lit(1)), 2)))
    scored = requests.withColumns({"wsi": wsi, "cohort": cohort}).withColumn("score", score)
    return scored.withColumn("status", scoring.feasibility_status(F.col("score")))


def coverage_gaps(assessed: DataFrame) -> DataFrame:
    """One row for each required marker that covers less than seven tenths of the whole-slide pool, and how grave that is."""
    rows = assessed.withColumn("marker", F.explode("markers"))
    have = pool(F.col("pools"), F.concat(F.lit("has_"), F.lower("marker")), F.lit(0))
    rows = rows.withColumn("coverage", scoring.half_up(have / F.greatest("wsi", F.lit(1)), 2)).filter("coverage < 0.7")
    return rows.withColumn("severity", F.when(F.col("coverage") < 0.5, "HIGH").otherwise("MEDIUM"))


def keyword_patients(attributes: DataFrame, patients: DataFrame, keywords: list[str], fields: list[str], key: str = "patient_id") -> DataFrame:
    """Distinct patients of a cohort with a keyword in one of an attribute's fields, in any case; null fields are empty."""
    told = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]))
    hit = F.exists(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(told, k))
    return attributes.filter(hit).select(key).distinct().join(patients.select(key), key, "left_semi")


def hospital_stats(rows: DataFrame, key: list[str], sums: list[str]) -> DataFrame:
    """Sums over the hospitals of each key, unknown numbers as 0, and the number of hospital rows."""
    return rows.groupBy(*key).agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in sums], F.count(F.lit(1)).alias("hospital_count"))


def cohort_counts(stats: DataFrame, patients: DataFrame, key: list[str]) -> DataFrame:
    """hospital_stats with patient_count taken from the patients where the hospitals tell none; patient_rows: theirs."""
    listed = patients.groupBy(*key).agg(F.count(F.lit(1)).alias("patient_rows"))
    both = stats.join(listed, key, "left").withColumn("patient_rows", F.coalesce("patient_rows", F.lit(0)))
    return both.withColumn("patient_count", F.coalesce(F.nullif(F.col("patient_count"), F.lit(0)), F.col("patient_rows")))


def subtype_distribution(subtypes: DataFrame, patients: DataFrame, disease_name: str | None = None) -> DataFrame:
    """(subtype, n): rows of subtypes (patient_id, disease_name, subtype, subtype_code) of the cohort or of a disease
    whose name holds disease_name; subtypes without name or code are (unknown)."""
    cohort = patients.select("patient_id").distinct().withColumn("_in", F.lit(True))
    named = F.contains(F.coalesce("disease_name", F.lit("")), F.lit(disease_name)) if disease_name else F.lit(False)
    rows = subtypes.join(cohort, "patient_id", "left").filter(F.coalesce("_in", F.lit(False)) | named)
    label = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("subtype", "subtype_code")], F.lit("(unknown)"))
    return rows.groupBy(label.alias("subtype")).agg(F.count(F.lit(1)).alias("n"))


#: Verification states that wait for a review; fixed values.
PENDING = ("待审核", "pending", "待核验", "待确认")


def match_summary(matches: DataFrame, pending_only: bool = False, top: int = 20) -> DataFrame:
    """(histogram, value, n): matches (status, method, mention, raw_mention) by state, by method, and the `top` mentions."""
    if pending_only:
        state = F.coalesce("status", F.lit(""))
        matches = matches.filter(F.exists(F.array(*map(F.lit, PENDING)), lambda s: F.contains(state, s)))
    filled = lambda *c: F.coalesce(*[F.nullif(F.col(x), F.lit("")) for x in c])
    cell = lambda kind, value: F.struct(F.lit(kind).alias("histogram"), value.alias("value"))
    cells = F.array(cell("status", F.coalesce(filled("status"), F.lit("(unknown)"))), cell("method", F.coalesce(filled("method"), F.lit("(unknown)"))), cell("mention", F.coalesce(filled("mention", "raw_mention"), F.lit("(mention)"))))
    counts = matches.select(F.explode(cells).alias("x")).groupBy("x.histogram", "x.value").agg(F.count(F.lit(1)).alias("n"))
    mentions = counts.filter("histogram = 'mention'").orderBy(F.desc("n"), "value").limit(top)
    return counts.filter("histogram <> 'mention'").unionByName(mentions)


def matched_catalogue(names: DataFrame, catalogue: DataFrame, column: str = "disease") -> DataFrame:
    """names with the first entry of a catalogue (place, disease_id, name, cases) whose name holds theirs or is held by
    it, in any case; null where none does. Both meet by grams, in both directions."""
    asked = names.select(column, F.lower(column).alias("_own")).distinct()
    entries = catalogue.select("place", "disease_id", F.lower("name").alias("_other"), "cases")
    met = containments(asked, entries, "_own", "_other").unionByName(containments(entries, asked, "_other", "_own")).distinct()
    best = met.join(asked, "_own").join(entries, "_other").groupBy(column).agg(F.min_by(F.struct("disease_id", "cases"), "place").alias("_best"))
    return names.join(best, column, "left").select(*names.columns, "_best.disease_id", "_best.cases")


def cross_matrix(corpus: Corpus, catalogue: DataFrame, focus: str | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """The first gaps of the grid with the cohort of their disease in the catalogue, the impact of the papers that fill
    them a little and the priority of all three, the highest first."""
    gaps = gap.impact_priority_matrix(corpus, focus, config)  # priority_pct: gap points and impact
    rows = matched_catalogue(gaps, catalogue).withColumn("cases", F.coalesce("cases", F.lit(0)))
    support = F.when(F.col("cases") >= 500, "high").when(F.col("cases") >= 200, "medium").otherwise("low")
    impact = F.col("priority_pct") / 100 - scoring.literature_gap_points(F.col("gap"))
    total = F.floor(scoring.total_priority(F.col("gap"), F.col("cases"), impact) * 100 + 0.5).cast("long")
    return rows.select("method", "disease", "disease_id", "gap", "paper_cnt", F.col("cases").cast("long").alias("cohort"), support.alias("data_support"), total.alias("priority_pct")).orderBy(F.desc("priority_pct"), "method", "disease")


def opportunity_summary(rows: DataFrame) -> DataFrame:
    """One row over opportunities (gap, disease_id, data_support): all, scarce and mapped ones, and the share with high
    support in hundredths of a percent, 0 for none."""
    scarce, high = F.count_if(F.col("gap").isin("unexplored", "minimal")), F.count_if(F.col("data_support") == "high")
    share = F.coalesce(F.floor(high * 10000 / F.nullif(F.count(F.lit(1)), F.lit(0)) + 0.5), F.lit(0)).cast("long")
    return rows.agg(F.count(F.lit(1)).alias("combo_count"), scarce.alias("scarce_count"), F.count_if(F.col("disease_id") != "").alias("mapped_count"), share.alias("high_bp"))


def read(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pools_by_nation(spark, sf_dir: str) -> DataFrame:
    """Pools of each hospital group (nation), its patients being customers and their attributes orders."""
    c, o, n = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders"), read(spark, sf_dir, "nation")
    facts = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("orders"), F.max((F.col("o_orderstatus") == "F").cast("int")).alias("survival"),
        F.max((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("her2"), F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).alias("days"),
    )
    per = c.join(facts, "c_custkey", "left").groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("has_wsi"), F.count_if(F.col("survival") == 1).alias("has_survival"), F.count_if(F.col("her2") == 1).alias("has_her2"),
        F.count_if(F.col("days") >= 365).alias("meets_followup_12m"), F.count_if(F.col("c_acctbal") > 0).alias("has_annotation"),
    )
    return per.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).drop("c_nationkey", "n_nationkey", "n_regionkey")


def cohort_pools(spark, sf_dir: str) -> DataFrame:
    return pools_by_nation(spark, sf_dir)


def feasibility_of_cohorts(spark, sf_dir: str) -> DataFrame:
    """One hypothesis (survival, HER2, a year's follow-up) held against every hospital group."""
    names = ["has_wsi", "has_survival", "has_her2", "meets_followup_12m", "has_annotation"]
    pools = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(x).cast("int") for x in names]))
    asked = pools_by_nation(spark, sf_dir).select("n_name", pools.alias("pools"), F.array(F.lit("survival")).alias("labels"), F.array(F.lit("annotation")).alias("annotations"), F.array(F.lit("HER2")).alias("markers"), F.lit(12).alias("min_followup_months"))
    return assess_from_pools(asked).select("n_name", F.col("wsi").cast("long").alias("wsi"), F.col("cohort").cast("long").alias("cohort"), F.floor(F.col("score") * 100 + 0.5).cast("long").alias("score_pct"), "status")


def attribute_distribution(spark, sf_dir: str) -> DataFrame:
    """Values of each attribute with their count and the attribute's total."""
    o = read(spark, sf_dir, "orders")
    rows = o.select(F.explode(F.array(F.struct(F.lit("status").alias("attribute"), F.col("o_orderstatus").alias("value")), F.struct(F.lit("priority").alias("attribute"), F.col("o_orderpriority").alias("value")))).alias("x")).select("x.*")
    counts = rows.groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(counts.groupBy("attribute").agg(F.sum("n").alias("total")), "attribute")


def marker_positivity(spark, sf_dir: str) -> DataFrame:
    """Patients tested and positive in each segment, and the rate in thousandths."""
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    rows = o.join(c, o.o_custkey == c.c_custkey)
    counts = rows.groupBy("c_mktsegment").agg(F.count_distinct("c_custkey").alias("tested"), F.count_distinct(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("c_custkey"))).alias("positive"))
    return counts.withColumn("rate_milli", F.floor(F.col("positive") * 1000 / F.col("tested") + 0.5).cast("long"))


def urgent_patients(spark, sf_dir: str) -> DataFrame:
    """Customers in credit with an urgent or high order, as patients with a keyword among their attributes."""
    c = read(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("patient_id"))
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("patient_id"), "o_orderpriority", "o_orderstatus")
    return keyword_patients(o, c, ["urgent", "HIGH"], ["o_orderpriority", "o_orderstatus"])


def counts_of_segments(spark, sf_dir: str) -> DataFrame:
    """Segments as diseases: their nations' sums of patients in credit, orders the slides."""
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    slides = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("slides"))
    rows = c.join(slides, "c_custkey", "left").groupBy("c_mktsegment", "c_nationkey").agg(F.count_if((F.col("c_acctbal") > 0) & (F.col("c_mktsegment") != "MACHINERY")).alias("patient_count"), F.sum("slides").alias("slide_count"))
    return cohort_counts(hospital_stats(rows, ["c_mktsegment"], ["patient_count", "slide_count"]), c, ["c_mktsegment"])


def subtypes_of_orders(spark, sf_dir: str) -> DataFrame:
    """Orders as subtype rows (their priority the subtype) of one segment's customers or of finished orders."""
    patients = read(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("patient_id"))
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("patient_id"), F.col("o_orderstatus").alias("disease_name"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("subtype"), F.lit("").alias("subtype_code"))
    return subtype_distribution(rows, patients, "F")


def matches_of_lines(spark, sf_dir: str) -> DataFrame:
    """Order lines as matches of mentions: their state, the way they were returned, and the part's name."""
    lines, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    rows = lines.join(part, lines.l_partkey == part.p_partkey).select(F.when(F.col("l_linestatus") == "F", "pending review").otherwise("confirmed").alias("status"), F.nullif(F.col("l_returnflag"), F.lit("N")).alias("method"), F.nullif(F.col("p_type"), F.lit("PROMO")).alias("mention"), F.col("p_name").alias("raw_mention"))
    return match_summary(rows, pending_only=True)


def recommended_cohorts(spark, sf_dir: str) -> DataFrame:
    """feasibility_of_cohorts with what is recommended."""
    scored = feasibility_of_cohorts(spark, sf_dir)
    return scored.select("n_name", "cohort", scoring.recommendation(F.col("score_pct") / 100, F.col("cohort")).alias("recommendation"))


def catalogue_of_nations(spark, sf_dir: str) -> DataFrame:
    """Suppliers' names as the names of a catalogue, which diseases of the star schema end with, at most one a nation;
    cases: the nation's customers."""
    cases = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("cases"))
    first = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.min_by("s_name", "s_suppkey").alias("name"))
    return first.join(cases, "nation").select(F.col("nation").alias("place"), F.concat(F.lit("D"), F.col("nation").cast("string")).alias("disease_id"), "name", (F.col("cases") * 10).alias("cases"))
