"""Tools by name: each takes a corpus and keyword arguments and gives a table; and Markdown reports of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertide.config import DEFAULT
from papertide.functions import scoring
from papertide.operators import feasibility, focus, gap, graph, hotspot, hypotheses, landscape, lifecycle, opportunity
from papertide.sources.corpus import Corpus

TOOLS: dict[str, Callable[..., DataFrame]] = {
    "author_stated_gaps": gap.author_stated_gaps,
    "disease_task_coverage": gap.disease_task_coverage,
    "corpus_focus_coverage": gap.corpus_focus_coverage,
    "method_disease_combo_gap": gap.method_disease_combo_gap,
    "metric_evidence": gap.metric_evidence,
    "limitation_temporal_profile": lifecycle.temporal_profiles,
    "limitation_gap_status": lifecycle.gap_status_board,
    "combo_gap_temporal": lifecycle.combo_gap_temporal,
    "limitation_impact_rank": gap.limitation_impact_rank,
    "hotspot_entities": gap.hotspot_entities,
    "recent_highcite_papers": gap.recent_highcite_papers,
    "impact_priority_matrix": gap.impact_priority_matrix,
    "emerging_gap_opportunities": hotspot.emerging_gap_opportunities,
    "graph_entity_pagerank": lambda corpus, focus=None, kind="Method": graph.entity_pagerank(corpus, kind, focus),
    "graph_community_gaps": graph.community_gaps,
    "graph_disease_method_reach": graph.disease_method_reach,
    "related_papers": lambda corpus, keyword: focus.search_papers(corpus, keyword, DEFAULT.top_n),
    "recent_papers_for_topic": lambda corpus, keyword: focus.search_papers(corpus, keyword, DEFAULT.top_n, DEFAULT.start_year),
    "methods_for_topic": lambda corpus, keyword: focus.methods_for_topic(corpus, keyword, DEFAULT.top_n),
    "datasets_for_topic": lambda corpus, keyword: focus.datasets_for_topic(corpus, keyword, DEFAULT.top_n),
    "metrics_for_topic": lambda corpus, keyword: focus.metrics_for_topic(corpus, keyword, DEFAULT.top_n),
    "limitations_for_topic": lambda corpus, keyword: focus.limitations_for_topic(corpus, keyword, DEFAULT.top_n),
    "modality_coverage_for_topic": lambda corpus, keyword: focus.modalities_for_topic(corpus, keyword, DEFAULT.top_n),
}


@dataclass(frozen=True)
class Centre:
    """A data centre. catalogue: disease_id, name, organ, organ_system, total_cases. pools: disease_id, pools. stats:
    disease_id, patient_count, slide_count. patients: disease_id, patient_id. attributes: patient_id,
    attribute, value. subtypes: patient_id, disease_name, subtype, subtype_code. results: patient_id,
    biomarker, result. matches: disease_id, status, method, mention, raw_mention."""

    catalogue: DataFrame
    pools: DataFrame
    stats: DataFrame
    patients: DataFrame
    attributes: DataFrame
    subtypes: DataFrame
    results: DataFrame
    matches: DataFrame

    def of(self, rows: DataFrame, disease_id: str | None) -> DataFrame:
        return rows if disease_id is None else rows.filter(F.col("disease_id") == disease_id)

    def cohort(self, disease_id: str | None) -> DataFrame:
        return self.of(self.patients, disease_id).select("patient_id").distinct()


def tasks_for(centre: Centre, disease_id: str | None = None) -> DataFrame:
    """What the pools of a disease, or of all, support as tasks."""
    rows = centre.of(centre.catalogue, disease_id).select("disease_id", "total_cases").join(centre.pools, "disease_id")
    return landscape.coverage_rows(rows).filter("part = 'task'").select("disease_id", F.col("field").alias("task_type"), "cases", "coverage")


def requests_of(centre: Centre, requests: DataFrame) -> DataFrame:
    """Hypotheses with their disease's pools and the tasks that it supports; unknown diseases have none."""
    tasks = tasks_for(centre).groupBy("disease_id").agg(F.array_sort(F.collect_list("task_type")).alias("other_tasks"))
    rows = requests.join(centre.pools, "disease_id", "left").join(tasks, "disease_id", "left")
    return rows.withColumns({"pools": F.coalesce("pools", F.create_map().cast("map<string,bigint>")), "other_tasks": F.coalesce("other_tasks", F.array().cast("array<string>"))})


def assess(centre: Centre, requests: DataFrame) -> DataFrame:
    rows = hypotheses.assessed(requests_of(centre, requests))
    return rows.withColumns({"status": scoring.feasibility_status(F.col("score")), "recommendation": scoring.recommendation(F.col("score"), F.col("cohort"))}).drop("pools", "other_tasks")


def data_gaps(centre: Centre, requests: DataFrame) -> DataFrame:
    gaps, suggestions = hypotheses.data_gaps()
    return hypotheses.assessed(requests_of(centre, requests)).withColumns({"gaps": gaps, "suggestions": suggestions}).drop("pools", "other_tasks")


def attribute_counts(centre: Centre, disease_id: str | None = None, keyword: str | None = None) -> DataFrame:
    """Values of the attributes of a cohort, those of the commonest attributes first; a keyword chooses attributes."""
    rows = centre.attributes.join(centre.cohort(disease_id), "patient_id", "left_semi")
    rows = rows.filter(F.contains(F.lower("attribute"), F.lit(keyword.lower()))) if keyword else rows
    counts = rows.groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("attribute").agg(F.sum("n").alias("total"))
    return counts.join(totals, "attribute").orderBy(F.desc("total"), "attribute", F.desc("n"), "value")


def positivity(centre: Centre, disease_id: str | None = None, biomarker: str = "HER2") -> DataFrame:
    """Tested and positive patients of a cohort for one marker."""
    per = centre.results.filter(F.col("biomarker") == biomarker).join(centre.cohort(disease_id), "patient_id", "left_semi").groupBy("patient_id").agg(F.max(scoring.is_positive(F.col("result"))).alias("positive"))
    sums = per.agg(F.count(F.lit(1)).alias("tested_patients"), F.count_if("positive").alias("positive_patients"))
    return sums.withColumn("positivity_rate", scoring.half_up(F.col("positive_patients") / F.greatest("tested_patients", F.lit(1)), 3))


def public_datasets(corpus: Corpus, keyword: str, listed: DataFrame | None = None) -> DataFrame:
    """How well public data sets cover a topic's papers; listed (name): data sets that are known to be public."""
    papers, _ = focus.topic_papers(corpus, keyword)
    used = focus.entities_for_topic(corpus, keyword, "Dataset").join(corpus.datasets, "name", "left")
    known = (listed.select("name").distinct() if listed is not None else used.select("name").limit(0)).withColumn("listed", F.lit(True))
    usage = used.join(known, "name", "left").select(F.col("name").alias("dataset"), F.coalesce("access_class", F.lit("unknown")).alias("access_class"), F.col("paper_cnt").alias("used_by"), F.coalesce("listed", F.lit(False)).alias("listed"))
    return opportunity.public_data_score(usage, papers.count())


def subtypes(centre: Centre, disease_id: str | None = None) -> DataFrame:
    name = centre.of(centre.catalogue, disease_id).select("name").first()["name"] if disease_id else None
    return feasibility.subtype_distribution(centre.subtypes, centre.cohort(disease_id), name)


#: Tools over a data centre; the two that need a corpus take it first.
DATA_TOOLS: dict[str, Callable[..., DataFrame]] = {
    "pathology_disease_catalog": lambda centre, organ_system=None, min_cases=50: landscape.organ_catalogue(centre.catalogue, organ_system, min_cases),
    "pathology_tasks_for_disease": tasks_for,
    "feasibility_assess": assess,
    "data_gap_analysis": data_gaps,
    "public_dataset_assess": public_datasets,
    "literature_data_cross_matrix": feasibility.cross_matrix,
    "disease_cohort_stats": lambda centre, disease_id=None: feasibility.cohort_counts(centre.of(centre.stats, disease_id), centre.patients, ["disease_id"]),
    "subtype_distribution": subtypes,
    "attribute_distribution": attribute_counts,
    "molecular_positivity": positivity,
    "text_disease_matches": lambda centre, disease_id=None, pending_only=False: feasibility.match_summary(centre.of(centre.matches, disease_id), pending_only),
}


def run_tool(name: str, source: Corpus | Centre, *more, **arguments) -> DataFrame:
    tools = TOOLS | DATA_TOOLS
    if name not in tools:
        raise KeyError(f"no tool {name!r}; there are {', '.join(sorted(tools))}")
    return tools[name](source, *more, **arguments)


def markdown_table(df: DataFrame, rows: int = 20, width: int = 80) -> str:
    """The first rows of a ranked table as Markdown, cells cut at a width (what a report shows)."""
    cell = lambda x: ("" if x is None else str(x)).replace("|", "\\|").replace("\n", " ")[:width]
    head = [f"| {' | '.join(df.columns)} |", f"|{' --- |' * len(df.columns)}"]
    return "\n".join(head + [f"| {' | '.join(map(cell, r))} |" for r in df.limit(rows).collect()])


def report(corpus: Corpus, names: list[str], **arguments) -> str:
    return "\n\n".join(f"## {name}\n\n{markdown_table(run_tool(name, corpus, **arguments))}" for name in names)
