"""Life cycles of limitations and of method-by-disease cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papertide.config import DEFAULT, EngineConfig
from papertide.functions import scoring
from papertide.operators import gap
from papertide.operators.checkpoints import checkpointed
from papertide.operators.focus import focus_papers, mentions, normalized
from papertide.sources.corpus import RELATION_OF, Corpus


def dated_limitations(corpus: Corpus) -> DataFrame:
    return corpus.of("Limitation").join(corpus.papers.select("pmid", "year", "citation_count"), "pmid").filter("year IS NOT NULL").withColumnRenamed("name", "limitation")


def told_by_paper(corpus: Corpus) -> DataFrame:
    """One row of each paper with a year, written once, so that relations are made once however often they are read.

    pmid, year, copies (rows of the paper with this year), cites (their sum), limitations (name, section, polarity),
    diseases, means (a method or task is stated) and shown (in methods or results). Papers without limitations that
    are no follow-ups either are left out.
    """
    rows = corpus.placed("Limitation", "Disease", "Method", "Task").filter("pmid IS NOT NULL")
    stated = lambda kind: (F.col("type") == kind) & (F.col("relation") == RELATION_OF[kind])
    is_means = F.col("type").isin("Method", "Task")
    found = rows.groupBy("pmid").agg(
        F.collect_list(F.when(stated("Limitation"), F.struct("name", "section", "polarity"))).alias("limitations"),
        F.array_sort(F.collect_set(F.when(stated("Disease"), F.col("name")))).alias("diseases"),
        F.bool_or(is_means).alias("means"),
        F.coalesce(F.bool_or(is_means & F.col("section").isin("methods", "results")), F.lit(False)).alias("shown"),
    ).filter((F.size("limitations") > 0) | (F.size("diseases") > 0) & F.col("shown"))
    papers = corpus.papers.select("pmid", "year", "citation_count").filter("pmid IS NOT NULL AND year IS NOT NULL").repartition("pmid")
    return checkpointed(found.join(papers.groupBy("pmid", "year").agg(F.count(F.lit(1)).alias("copies"), F.sum("citation_count").alias("cites")), "pmid"))


def years_of_told(chosen: DataFrame) -> DataFrame:
    """years_of_rows of told_by_paper's rows; a paper states a limitation once, so that papers of the sections add up."""
    rows = chosen.select("year", "copies", "cites", "chosen", F.inline("limitations")).withColumnRenamed("name", "limitation")
    here = F.col("chosen").isNotNull()
    copies = lambda when: F.sum(F.when(when, F.col("copies")).otherwise(0))
    placed = rows.groupBy("limitation", "year", "section").agg(
        F.count(F.lit(1)).alias("all_papers"),
        F.count_if(here).alias("papers"),
        copies(here).alias("stated"),
        copies(here & (F.col("polarity") == "asserted")).alias("asserted"),
        copies(here & (F.col("polarity") == "hypothesized")).alias("hypothesized"),
        F.sum(F.when(here, F.col("cites"))).alias("cites"),
    )
    sums = [F.sum(c).alias(c) for c in ("all_papers", "papers", "stated", "asserted", "hypothesized", "cites")]
    return placed.groupBy("limitation", "year").agg(*sums, F.collect_set(F.when(F.col("papers") > 0, F.col("section"))).alias("sections"))


def years_of_rows(chosen: DataFrame) -> DataFrame:
    """Counts of every limitation and year over dated_limitations' rows, those in focus marked as chosen."""
    here = F.col("chosen").isNotNull()
    return chosen.groupBy("limitation", "year").agg(
        F.count_distinct("pmid").alias("all_papers"),
        F.count_distinct(F.when(here, F.col("pmid"))).alias("papers"),
        F.count_if(here).alias("stated"),
        F.count_if(here & (F.col("polarity") == "asserted")).alias("asserted"),
        F.count_if(here & (F.col("polarity") == "hypothesized")).alias("hypothesized"),
        F.collect_set(F.when(here, F.col("section"))).alias("sections"),
        F.sum(F.when(here, F.col("citation_count"))).alias("cites"),
    )


def temporal_profiles(corpus: Corpus, focus: str | None = None, config: EngineConfig = DEFAULT, told: DataFrame | None = None) -> DataFrame:
    """Every limitation's years, counts and status. early_cnt counts all papers, in focus or not.

    recent_cnt, asserted_cnt and hypothesized_cnt count relation rows, paper_cnt papers; the latest year
    of any limitation is the clock (a single number, joined as such). told: told_by_paper, where it is there.
    """
    rows = dated_limitations(corpus) if told is None else told.filter(F.size("limitations") > 0)
    as_of = F.broadcast(rows.agg(F.max("year").alias("as_of_year")))  # one row
    chosen = rows.withColumn("chosen", F.lit(1))
    if normalized(focus):
        chosen = rows.join(focus_papers(corpus, focus).withColumn("chosen", F.lit(1)), "pmid", "left")
    # a paper has one year, so that papers of the years add up; a limitation has no more rows than years
    yearly = years_of_rows(chosen) if told is None else years_of_told(chosen)
    base = yearly.join(as_of, F.lit(True)).groupBy("limitation", "as_of_year").agg(
        F.min(F.when(F.col("stated") > 0, F.col("year"))).alias("first_year"),
        F.max(F.when(F.col("stated") > 0, F.col("year"))).alias("last_year"),
        F.sum("papers").alias("paper_cnt"),
        F.sum("asserted").alias("asserted_cnt"),
        F.sum("hypothesized").alias("hypothesized_cnt"),
        F.sum(F.when(F.col("year") >= F.col("as_of_year") - config.recent_years, F.col("stated")).otherwise(0)).alias("recent_cnt"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sections")))), ",").alias("sections"),
        F.sum("cites").alias("cites"),
        F.collect_list(F.struct("year", "all_papers")).alias("years"),
    ).filter("paper_cnt > 0")
    early = F.filter("years", lambda y: y["year"] <= F.col("first_year") + config.early_years)
    status = scoring.temporal_status(F.col("first_year"), F.col("last_year"), F.col("paper_cnt"), F.col("recent_cnt"), F.col("as_of_year"), config.recent_years, config.emerging_max_age, config.persistent_ratio)
    span = F.when((F.col("first_year") != 0) & (F.col("last_year") != 0), F.col("last_year") - F.col("first_year")).otherwise(0)
    return base.withColumns({
        "early_cnt": F.aggregate(early, F.lit(0).cast("long"), lambda n, y: n + y["all_papers"]),
        "year_span": span,
        "proposal_age": F.col("as_of_year") - F.col("first_year"),
        "recent_ratio_milli": F.floor(F.col("recent_cnt") * 1000 / F.col("paper_cnt") + 0.5).cast("long"),
        "temporal_status": status,
    }).drop("years")


def followup_stats(corpus: Corpus, profiles: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """(limitation, followup_cnt, first_followup) of persistent and declining limitations.

    Anchors are the diseases of a limitation's papers of its first two years that also have a method or
    a task; follow-ups are later papers on such a disease with a method or task stated in their methods
    or results. Later papers that name the same diseases in the same year are counted before they meet the
    anchors, so that a disease of many papers costs an anchor its years and sets of diseases, not its papers.
    told: told_by_paper, where it is there.
    """
    told = (told_by_paper(corpus) if told is None else told).filter(F.size("diseases") > 0)
    targets = profiles.filter(F.col("temporal_status").isin("persistent", "declining")).select("limitation", "first_year")
    anchors = (
        told.filter("means").select("year", "diseases", F.explode("limitations.name").alias("limitation")).join(targets, "limitation")
        .filter(F.col("year") <= F.col("first_year") + 1).select("limitation", "first_year", F.explode("diseases").alias("disease")).distinct()
    )
    later = told.filter("shown").groupBy(F.col("diseases").alias("on"), F.col("year").alias("followup_year")).agg(F.count(F.lit(1)).alias("papers"))
    met = anchors.join(later.withColumn("disease", F.explode("on")), "disease").filter("followup_year > first_year")
    # a set of diseases may be met through several of them
    once = met.groupBy("limitation", "on", "followup_year").agg(F.max("papers").alias("papers"))
    return once.groupBy("limitation").agg(F.sum("papers").alias("followup_cnt"), F.min("followup_year").alias("first_followup"))


def limitation_gap_status(corpus: Corpus, focus: str | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """Persistent and declining limitations with the signal of their follow-up papers."""
    told = told_by_paper(corpus)
    return limitation_gap_status_of(corpus, temporal_profiles(corpus, focus, config, told), config, told)


def limitation_gap_status_of(corpus: Corpus, profiles: DataFrame, config: EngineConfig = DEFAULT, told: DataFrame | None = None) -> DataFrame:
    profiles = checkpointed(profiles.filter(F.col("temporal_status").isin("persistent", "declining")))  # read twice
    joined = profiles.join(followup_stats(corpus, profiles, told), "limitation", "left").withColumn("followup_cnt", F.coalesce("followup_cnt", F.lit(0)))
    signal = scoring.resolution_signal(F.col("first_year"), F.col("last_year"), F.col("followup_cnt"), F.col("first_followup"), config.min_followups)
    return joined.select("limitation", "temporal_status", "first_year", "last_year", "paper_cnt", "followup_cnt", "first_followup", signal.alias("resolution_signal"))


def resolution_signals(status: DataFrame) -> DataFrame:
    """Signal rows: topic_followup for weak and moderate signals, mention_decline for declining limitations."""
    follow = status.filter(F.col("resolution_signal").isin("weak", "moderate")).select(
        "limitation", F.lit("topic_followup").alias("signal_type"), F.col("first_year").alias("anchor_year"), F.col("first_followup").alias("followup_year"),
        F.when(F.col("resolution_signal") == "moderate", 70).otherwise(45).alias("confidence_pct"),
    )
    decline = status.filter(F.col("temporal_status") == "declining").select(
        "limitation", F.lit("mention_decline").alias("signal_type"), F.col("first_year").alias("anchor_year"), F.col("last_year").alias("followup_year"), F.lit(55).alias("confidence_pct"),
    )
    return follow.unionByName(decline)


def gap_status_board(corpus: Corpus, focus: str | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    rank = F.when(F.col("resolution_signal") == "moderate", 2).when(F.col("resolution_signal") == "weak", 1).otherwise(0)
    return limitation_gap_status(corpus, focus, config).orderBy(F.desc(rank), F.desc("paper_cnt"), "limitation").limit(config.top_n)


def combo_gap_temporal(corpus: Corpus, focus: str | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """The grid's cells with their years: unexplored, dormant, nascent or active."""
    cells = gap.grid(corpus, focus, config)
    as_of = F.broadcast(dated_limitations(corpus).agg(F.max("year").alias("as_of_year")))  # one row
    found = gap.in_grid(corpus, cells).join(corpus.papers.select("pmid", "year"), "pmid").filter("year IS NOT NULL").join(as_of, F.lit(True))
    counts = found.groupBy("method", "disease").agg(
        F.count(F.lit(1)).alias("paper_cnt"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.count_if(F.col("year") >= F.col("as_of_year") - config.recent_years).alias("recent_cnt"),
    )
    filled = cells.join(counts, ["method", "disease"], "left").fillna(0, ["paper_cnt", "recent_cnt"])
    phase = F.when(F.col("paper_cnt") == 0, "unexplored").when(F.col("recent_cnt") == 0, "dormant").when(F.col("paper_cnt") <= 2, "nascent").otherwise("active")
    return (
        filled.withColumn("phase", phase)
        .orderBy(F.col("phase") != "unexplored", "paper_cnt", F.lower("method"), "disease").limit(config.gap_rows)
        .select("method", "disease", "paper_cnt", "first_year", "last_year", "recent_cnt", "phase")
    )


def shared_entity_rows(corpus: Corpus, profiles: DataFrame) -> DataFrame:
    """(limitation, type, name): what the anchor papers of each eligible limitation share with later work.

    Anchors are written once, so that entities are made of their papers only.
    """
    targets = profiles.filter(F.col("temporal_status").isin("persistent", "declining")).select("limitation", "first_year")
    anchors = dated_limitations(corpus).select("limitation", "pmid", "year").join(targets, "limitation").filter(F.col("year") <= F.col("first_year") + 1).select("limitation", "pmid").distinct()
    anchors = checkpointed(anchors)  # read twice
    found = anchors.join(corpus.placed_within(anchors.select("pmid"), "Disease", "Task", "Method"), "pmid")
    return found.select("limitation", "type", "name").distinct()


def shared_entities(corpus: Corpus, profiles: DataFrame) -> DataFrame:
    """The rows of shared_entity_rows as sorted lists, which makes one row of each limitation."""
    found = shared_entity_rows(corpus, profiles)
    names = lambda kind: F.array_join(F.array_sort(F.collect_set(F.when(F.col("type") == kind, F.col("name")))), "|")
    return found.groupBy("limitation").agg(names("Disease").alias("diseases"), names("Task").alias("tasks"), names("Method").alias("methods"))


def latest_by_status(profiles: DataFrame, n: int) -> DataFrame:
    """The n most written-about limitations of each status."""
    place = Window.partitionBy("temporal_status").orderBy(F.desc("paper_cnt"), F.desc("recent_ratio_milli"), "limitation")
    return profiles.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= n).select("temporal_status", "rank", "limitation", "paper_cnt", "recent_ratio_milli")


def limitation_impact(corpus: Corpus, config: EngineConfig = DEFAULT) -> DataFrame:
    """Every limitation's impact by the papers with a year that state it: papers, mean citations, mean impact factor
    of those that have one, share of first-quartile journals, score and tier."""
    rows = corpus.of("Limitation").join(corpus.judged.filter("year IS NOT NULL"), "pmid").groupBy(F.col("name").alias("limitation"))
    sums = gap.averages(rows.agg(*gap.impact_sums(config), F.count_if(F.col("quartile").startswith("Q1")).alias("q1")).drop("paper_cnt"))
    avg_if = F.when(F.col("if_rows") > 0, F.col("if_cents") / F.col("if_rows") / 50000).otherwise(0.0)
    score = scoring.impact_score(F.col("avg_cite"), F.col("avg_cite_per_year"), avg_if, F.col("q1") / F.col("rows"))
    return sums.withColumn("impact_score", score).select("limitation", F.col("rows").alias("support_papers"), "cites", "q1", "impact_score", scoring.impact_tier(F.col("impact_score")).alias("impact_tier"))


def profile_rows(profiles: DataFrame, focus: str | None = None, statuses: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Stored profiles whose limitation mentions the focus, of the statuses asked for, most papers first."""
    rows = profiles.filter(mentions(F.col("limitation"), focus))
    rows = rows.filter(F.col("temporal_status").isin(statuses)) if statuses else rows
    ordered = rows.orderBy(F.desc("paper_cnt"), F.desc("recent_ratio_milli"), "limitation")
    return ordered if limit is None else ordered.limit(limit)


def signal_rows(signals: DataFrame, limitation: str | None = None, signal_type: str | None = None, limit: int | None = None) -> DataFrame:
    """Stored signals of a limitation and a type, where asked for, the surest and latest first."""
    for name, value in (("limitation", limitation), ("signal_type", signal_type)):
        signals = signals if value is None else signals.filter(F.col(name) == value)
    ordered = signals.orderBy(F.desc("confidence_pct"), F.desc_nulls_last("followup_year"), "limitation", "signal_type")
    return ordered if limit is None else ordered.limit(limit)


def run_lifecycle(corpus: Corpus, folder: str, temporal_only: bool = False, config: EngineConfig = DEFAULT) -> DataFrame:
    """Write all profiles with their impact to `folder`/profiles and all signals to `folder`/signals, in place of what is
    there, and give the counts of both as read back (lifecycle_stats). A run that is repeated writes the same."""
    spark = corpus.papers.sparkSession
    told = None if temporal_only else told_by_paper(corpus)
    profiles = temporal_profiles(corpus, None, config, told).join(limitation_impact(corpus, config).select("limitation", "impact_score", "impact_tier"), "limitation", "left")
    profiles.write.mode("overwrite").parquet(f"{folder}/profiles")
    stored = spark.read.parquet(f"{folder}/profiles")
    if not temporal_only:
        resolution_signals(limitation_gap_status_of(corpus, stored, config, told)).write.mode("overwrite").parquet(f"{folder}/signals")
    signals = None if temporal_only else spark.read.parquet(f"{folder}/signals")
    return lifecycle_stats(stored, signals)


def lifecycle_stats(profiles: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """(kind, value, n): profiles by status and signals by type."""
    counts = profiles.groupBy(F.col("temporal_status").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("status").alias("kind"), "value", "n")
    if signals is None:
        return counts
    return counts.unionByName(signals.groupBy(F.col("signal_type").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("signal").alias("kind"), "value", "n"))


def limitation_lifecycle_counts(profiles: DataFrame, signals: DataFrame, least: float = 0.7) -> DataFrame:
    """One row: profiles, those of each status, signals, and limitations with a topic follow-up of at least so much
    confidence."""
    of = lambda status: F.count_if(F.col("temporal_status") == status).alias(status)
    one = profiles.agg(F.count(F.lit(1)).alias("limitation_temporal"), of("persistent"), of("declining"), of("emerging"))
    sure = F.when((F.col("signal_type") == "topic_followup") & (F.col("confidence") >= least), F.col("limitation"))
    return one.join(signals.agg(F.count(F.lit(1)).alias("resolution_signals"), F.count_distinct(sure).alias("topic_followup_moderate")))  # one row each
