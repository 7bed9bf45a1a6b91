"""Research-gap and coverage tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papertide.config import DEFAULT, EngineConfig
from papertide.functions import scoring
from papertide.operators.focus import focus_papers, in_focus, mentions
from papertide.sources.corpus import RELATION_OF, Corpus


def joined(col: str) -> Column:
    return F.array_join(F.array_sort(F.collect_set(col)), ",")


def author_stated_gaps(corpus: Corpus, focus: str | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """Limitations by the papers that state them; where none is stated, by any relation to one."""
    rows = corpus.typed("Limitation").filter(mentions(F.col("name"), focus))
    level = F.when(F.col("relation") == RELATION_OF["Limitation"], 0).otherwise(1).alias("_level")
    counts = rows.groupBy(level, F.col("name").alias("limitation")).agg(F.count_distinct("pmid").alias("paper_cnt"), joined("section").alias("sections"), joined("quote").alias("quotes"))
    # the first rows in the order of levels tell the least one; rows of the other may fill the list and go
    first = counts.orderBy("_level", F.desc("paper_cnt"), "limitation").limit(config.top_n).withColumn("_least", F.min("_level").over(Window.partitionBy(F.lit(0))))  # top_n rows
    return first.filter("_level = _least").drop("_level", "_least").orderBy(F.desc("paper_cnt"), "limitation")


def disease_task_coverage(corpus: Corpus, focus: str | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """Diseases with the fewest kinds of task; diseases without any task are there too."""
    diseases = corpus.of("Disease").filter(mentions(F.col("name"), focus)).select("pmid", F.col("name").alias("disease"))
    tasks = corpus.of("Task").select("pmid", F.col("name").alias("task"))
    return (
        diseases.join(tasks, "pmid", "left").groupBy("disease")
        .agg(F.count_distinct("pmid").alias("paper_cnt"), F.count_distinct("task").alias("task_variety"), joined("task").alias("tasks"))
        .orderBy("task_variety", F.desc("paper_cnt"), "disease").limit(config.top_n)
    )


#: What a small subset is warned of; fixed values.
FEW_PAPERS = "Focus subset has only {} papers — temporal/combo statistics are low-confidence; do not cite corpus-wide totals."
NO_PAPERS = "No papers match this focus — gaps may reflect missing extraction, not true absence."


def corpus_focus_coverage(corpus: Corpus, focus: str, config: EngineConfig = DEFAULT) -> DataFrame:
    """One row: how much of the corpus a focus covers.

    Limitations and methods are those of the focus' papers; diseases are those whose names mention the
    focus, on whatever papers, the five commonest of them listed as name (papers). A subset of few papers
    carries warnings.
    """
    chosen = focus_papers(corpus, focus)
    papers = corpus.papers.join(chosen.withColumn("chosen", F.lit(1)), "pmid", "left").agg(
        F.count(F.lit(1)).alias("total_papers"),
        F.count("chosen").alias("focus_papers"),
        F.count_if(F.col("chosen").isNotNull() & F.col("extraction_done")).alias("extracted_papers"),
    )
    found = corpus.typed("Method", "Limitation").join(chosen, "pmid", "left_semi").agg(
        F.count_if(F.col("relation") == "REPORTS_LIMITATION").alias("limitation_relations"),
        F.count_distinct(F.when((F.col("type") == "Method") & (F.col("relation") == "APPLIES_METHOD"), F.col("name"))).alias("methods"),
    )
    named = corpus.of("Disease").filter(mentions(F.col("name"), focus)).groupBy("name").agg(F.count_distinct("pmid").alias("n"))
    first = named.orderBy(F.desc("n"), "name").limit(5).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("r"), "name"))).alias("_top"))  # five rows
    listed = F.array_join(F.transform("_top", lambda d: F.concat(d["name"], F.lit(" ("), (-d["r"]).cast("string"), F.lit(")"))), "|")
    ratio = F.when(F.col("total_papers") > 0, F.floor(F.col("focus_papers") * 10000 / F.col("total_papers") + 0.5)).otherwise(0)
    both = papers.join(found).join(named.agg(F.count(F.lit(1)).alias("diseases"))).join(first)  # one row each
    few = F.when(F.col("focus_papers") < config.ready_papers, F.format_string(FEW_PAPERS.replace("{}", "%d"), "focus_papers"))
    warnings = F.array_join(F.array_compact(F.array(few, F.when(F.col("focus_papers") == 0, NO_PAPERS))), "|")
    return both.withColumns({"coverage_bp": ratio.cast("long"), "analysis_ready": F.col("focus_papers") >= config.ready_papers, "top_diseases": listed, "warnings": warnings}).drop("_top")


def commonest(rows: DataFrame, n: int, name: str) -> DataFrame:
    """The n names with most rows, with their rank from 1; the list is n rows long at most."""
    top = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(n)
    return top.select(F.col("name").alias(name), F.row_number().over(Window.orderBy(F.desc("n"), "name")).alias(f"{name}_rank"))


def pairs_of(corpus: Corpus) -> DataFrame:
    """(pmid, method, disease) of every paper that has both."""
    methods = corpus.of("Method").select("pmid", F.col("name").alias("method"))
    return methods.join(corpus.of("Disease").select("pmid", F.col("name").alias("disease")), "pmid")


def grid(corpus: Corpus, focus: str | None, config: EngineConfig) -> DataFrame:
    """The commonest methods by the commonest diseases, both of them top_n long."""
    methods = commonest(in_focus(corpus.of("Method"), corpus, focus), config.top_n, "method")
    diseases = commonest(corpus.of("Disease").filter(mentions(F.col("name"), focus)), config.top_n, "disease")
    return methods.crossJoin(F.broadcast(diseases))  # top_n x top_n cells


def in_grid(corpus: Corpus, cells: DataFrame) -> DataFrame:
    """Pairs within the grid only: both sides are held against its short lists before they meet."""
    methods = corpus.of("Method").select("pmid", F.col("name").alias("method")).join(F.broadcast(cells.select("method").distinct()), "method", "left_semi")
    diseases = corpus.of("Disease").select("pmid", F.col("name").alias("disease")).join(F.broadcast(cells.select("disease").distinct()), "disease", "left_semi")
    return methods.join(diseases, "pmid")


def method_disease_combo_gap(corpus: Corpus, focus: str | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """Cells of the grid that few papers fill, in grid order."""
    cells = grid(corpus, focus, config)
    counts = in_grid(corpus, cells).groupBy("method", "disease").agg(F.count_distinct("pmid").alias("paper_cnt"))
    filled = cells.join(counts, ["method", "disease"], "left").withColumn("paper_cnt", F.coalesce("paper_cnt", F.lit(0)))
    gap = F.when(F.col("paper_cnt") == 0, "unexplored").when(F.col("paper_cnt") <= 2, "minimal")
    return filled.withColumn("gap", gap).filter("gap IS NOT NULL").orderBy("method_rank", "disease_rank").limit(config.gap_rows).select("method", "disease", "paper_cnt", "gap", "method_rank", "disease_rank")


def metric_evidence(corpus: Corpus, focus: str | None = None) -> DataFrame:
    """All statements of metrics whose names mention the focus, and whether they are backed by a results section."""
    return corpus.of("Metric").filter(mentions(F.col("name"), focus)).select("pmid", F.col("name").alias("metric"), "metric_value", "section", (F.col("section") == "results").alias("results_backed"))


def impact_sums(config: EngineConfig) -> list[Column]:
    """Sums over relation rows, in whole numbers, so that any order of adding gives the same."""
    cpy = F.floor(1000 * scoring.cite_per_year(F.col("citation_count"), F.col("year"), config.clock_year, config.end_year)).cast("long")
    return [
        F.count_distinct("pmid").alias("paper_cnt"),
        F.count(F.lit(1)).alias("rows"),
        F.sum("citation_count").alias("cites"),
        F.sum(cpy).alias("cpy_milli"),
        F.sum(F.coalesce("if_cents", F.lit(0))).alias("if_cents"),
        F.count_if(F.col("if_cents") > 0).alias("if_rows"),
        F.count_if(F.col("study_type") != "5-LOW").alias("non_review_cnt"),
    ]


def impact_of(rows: DataFrame, config: EngineConfig, *by: str) -> DataFrame:
    """The sums of impact_sums by some columns, added up by paper first, which needs no shuffle where rows lie by paper."""
    of_papers = rows.groupBy("pmid", *by).agg(*impact_sums(config)[1:])
    sums = [c for c in of_papers.columns if c not in ("pmid", *by)]
    return of_papers.groupBy(*by).agg(F.count("pmid").alias("paper_cnt"), *[F.sum(c).alias(c) for c in sums])


def averages(rows: DataFrame) -> DataFrame:
    n = F.col("rows")
    return rows.withColumns({"avg_cite": F.col("cites") / n, "avg_cite_per_year": F.col("cpy_milli") / n / 1000, "avg_if": F.col("if_cents") / n / 50000})


def limitation_impact_rank(corpus: Corpus, focus: str | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """Limitations whose names mention the focus by papers x mean citations, with an impact score of 0 to 3."""
    rows = corpus.of("Limitation").filter(mentions(F.col("name"), focus)).join(corpus.judged, "pmid").groupBy(F.col("name").alias("limitation")).agg(*impact_sums(config))
    heat = F.floor(F.col("paper_cnt") * F.col("cites") * 1000 / F.col("rows")).cast("long")
    top = averages(rows).withColumn("heat_milli", heat).orderBy(F.desc("heat_milli"), "limitation").limit(config.top_n)
    score = scoring.impact_score(F.col("avg_cite"), F.col("avg_cite_per_year"), F.col("avg_if"), F.when(F.col("avg_if") >= 5, 1.0).otherwise(0.0))
    return top.withColumn("impact_score", score).select("limitation", "paper_cnt", "cites", "non_review_cnt", "heat_milli", "impact_score", scoring.impact_tier(F.col("impact_score")).alias("impact_tier"))


def hotspot_entities(corpus: Corpus, focus: str | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """Entities of at least two papers whose names mention the focus by papers x mean citations.

    Methods count where they are applied, not where they are only mentioned.
    """
    told = corpus.relations.filter(mentions(F.col("name"), focus)).filter("type <> 'Method' OR relation = 'APPLIES_METHOD'")
    rows = impact_of(told.join(corpus.judged, "pmid"), config, "name", "type").filter("paper_cnt >= 2")
    heat = F.floor(F.col("paper_cnt") * F.col("cites") / F.col("rows") + 0.5).cast("long")
    return rows.withColumn("heat", heat).orderBy(F.desc("heat"), "name", "type").limit(config.top_n).select("name", "type", "paper_cnt", "cites", "heat")


def recent_highcite_papers(corpus: Corpus, focus: str | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """Papers since start_year by citations a year, in tenths."""
    recent = in_focus(corpus.judged.filter(F.col("year") >= config.start_year), corpus, focus)
    tenths = F.floor(10 * scoring.cite_per_year(F.col("citation_count"), F.col("year"), config.clock_year, config.end_year) + 0.5).cast("long")
    return recent.withColumn("cpy_tenths", tenths).orderBy(F.desc("cpy_tenths"), F.desc("citation_count"), "pmid").limit(config.top_n).select("pmid", "title", F.col("year").alias("yr"), "citation_count", "cpy_tenths", "quartile")


def combo_support_papers(corpus: Corpus, cells: DataFrame) -> DataFrame:
    """The papers behind each cell of a short table (method, disease), with their journals."""
    found = in_grid(corpus, cells).join(F.broadcast(cells.select("method", "disease")), ["method", "disease"], "left_semi")
    return found.join(corpus.judged, "pmid")


def impact_priority_matrix(corpus: Corpus, focus: str | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """The first gaps of the grid by gap points plus the impact of the papers that fill them a little."""
    gaps = method_disease_combo_gap(corpus, focus, config).limit(config.top_n)
    support = averages(combo_support_papers(corpus, gaps).groupBy("method", "disease").agg(*impact_sums(config), F.count_if(F.col("quartile") == "Q1").alias("q1")).drop("paper_cnt"))
    # the mean impact factor is over the papers that have one
    avg_if = F.when(F.col("if_rows") > 0, F.col("if_cents") / F.col("if_rows") / 50000).otherwise(0.0)
    score = scoring.impact_score(F.col("avg_cite"), F.col("avg_cite_per_year"), avg_if, F.col("q1") / F.col("rows"))
    ranked = gaps.join(support.select("method", "disease", score.alias("impact_score")), ["method", "disease"], "left").withColumn("impact_score", F.coalesce("impact_score", F.lit(0.0)))
    priority = F.floor((scoring.literature_gap_points(F.col("gap")) + F.col("impact_score")) * 100 + 0.5).cast("long")
    return ranked.withColumn("priority_pct", priority).orderBy(F.desc("priority_pct"), "method_rank", "disease_rank").select("method", "disease", "paper_cnt", "gap", "priority_pct")


def method_disease_pivot(corpus: Corpus, config: EngineConfig = DEFAULT, columns: int = 5) -> DataFrame:
    """Papers of the commonest methods by the commonest diseases, one column a disease rank."""
    cells = grid(corpus, None, config)
    counts = in_grid(corpus, cells).join(F.broadcast(cells), ["method", "disease"]).filter(F.col("disease_rank") <= columns)
    wide = counts.groupBy("method").pivot("disease_rank", list(range(1, columns + 1))).agg(F.count_distinct("pmid"))
    names = [f"disease_{i}" for i in range(1, columns + 1)]
    return wide.toDF("method", *names).fillna(0, names)


def top_entities(corpus: Corpus, kind: str, relation: str, n: int = 20) -> DataFrame:
    """(name, n): the entities of a kind with most rows of a relation, ties by name."""
    rows = corpus.typed(kind).filter(F.col("relation") == relation)
    return rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(n)


def counts_by_group(papers: DataFrame, groups: str) -> DataFrame:
    """(name, n): papers of each query group of an array column; null and empty arrays belong to none."""
    return papers.select(F.explode(groups).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def corpus_stats(corpus: Corpus) -> DataFrame:
    """One row of counts over the corpus."""
    papers = corpus.papers.agg(
        F.count(F.lit(1)).alias("papers"), F.count_if(F.col("full_text_status") == "available").alias("full_texts"), F.count_if("extraction_done").alias("extracted"),
        F.count_if(F.col("date_precision").isin("day", "month")).alias("dated"), F.sum("citation_count").alias("citations"),
    )
    found = corpus.relations.agg(
        F.count(F.lit(1)).alias("relations"), F.count_distinct("type", "name").alias("entities"), F.count_if(F.col("polarity") == "hypothesized").alias("hypothesized"),
    )
    return papers.withColumn("one", F.lit(1)).join(found.withColumn("one", F.lit(1)), "one").drop("one")


def metric_lists(corpus: Corpus, focus: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The statements of metrics whose names mention the focus: those backed by a results section, by paper, and all."""
    rows = metric_evidence(corpus, focus)
    return rows.filter("results_backed").orderBy("pmid", "metric"), rows


#: Where a paper's full text comes from by its status, what a relation was extracted from, and sources of citations; fixed values.
STATUSES = {"fulltext_jats": "available", "fulltext_mineru_pdf": "pdf_available", "fulltext_unavailable": "unavailable"}
GRANULARITIES = {"relations_fulltext": "fulltext", "relations_mineru_pdf": "mineru_pdf", "relations_abstract": "abstract"}
SOURCES = {"citations_openalex": "openalex", "citations_semantic_scholar": "semantic_scholar"}
PRECISIONS = {f"date_precision_{p}": p for p in ("day", "month", "year", "unknown")}


def database_stats(papers: DataFrame, relations: DataFrame, journals: DataFrame, sections: DataFrame) -> DataFrame:
    """(metric, value): the counts of a whole database, one pass over each table.

    papers (full_text_status, extraction_done, citation_source, date_precision), relations (type, name,
    granularity), journals (if_cents) and sections, of which rows are counted. Null and empty precisions are
    missing; null, empty and unavailable sources aren't enriched. fulltext_available sums both kinds.
    """
    count = lambda column, values: [F.count_if(F.col(column) == v).alias(n) for n, v in values.items()]
    source = F.coalesce("citation_source", F.lit(""))
    of_papers = papers.agg(
        F.count(F.lit(1)).alias("papers"), *count("full_text_status", STATUSES), F.count_if(F.col("full_text_status").isin("available", "pdf_available")).alias("fulltext_available"), F.count_if("extraction_done").alias("extracted"),
        F.count_if(~source.isin("", "unavailable")).alias("s2_enriched"), *count("citation_source", SOURCES), *count("date_precision", PRECISIONS), F.count_if(F.coalesce("date_precision", F.lit("")) == "").alias("date_precision_missing"),
    )
    of_relations = relations.agg(F.count(F.lit(1)).alias("relations"), F.count_distinct("type", "name").alias("entities"), *count("granularity", GRANULARITIES))
    of_journals = journals.agg(F.count("if_cents").alias("journals_with_if"))
    rows = None
    for one in (of_papers, of_relations, of_journals, sections.agg(F.count(F.lit(1)).alias("sections"))):
        told = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("value")) for c in one.columns])))
        rows = told if rows is None else rows.unionByName(told)
    return rows


def stats_of_corpus(corpus: Corpus) -> DataFrame:
    """The corpus as a database: sources by the paper's key, granularity by section, limitations as sections."""
    papers = corpus.papers.withColumn("citation_source", F.expr("CASE pmid % 5 WHEN 0 THEN 'openalex' WHEN 1 THEN 'semantic_scholar' WHEN 2 THEN 'unavailable' WHEN 3 THEN 'other' END")).withColumn("date_precision", F.expr("IF(pmid % 7 = 0, '', date_precision)"))
    relations = corpus.relations.withColumn("granularity", F.expr("CASE section WHEN 'results' THEN 'fulltext' WHEN 'methods' THEN 'mineru_pdf' WHEN 'discussion' THEN 'abstract' END"))
    return database_stats(papers, relations, corpus.journals, corpus.of("Limitation"))
