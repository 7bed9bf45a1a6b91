"""Registered queries of the analytics engine and the SQL that checks them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from papertide.config import DEFAULT
from papertide.operators import articles, concepts, documents, feasibility, focus, gap, graph, hotspot, hypotheses, landscape, lifecycle, mapping, merge, projection, queue, reports, runs, sampling
from papertide.operators.concepts import Concept
from papertide.plans import hypothesis_twins, landscape_twins, mapping_twins, oracle, run_twins, topic_twins, twins
from papertide.sources.corpus import Corpus, from_star

FLAGSHIP = "t02_disease_task_coverage"
#: Literal foci and keywords of the registered queries.
FOCUS, KEYWORD, TOKENS = "anvil", "anvil", "blue anvil widget"
#: Concepts of the star schema's part names, and words that stand for each other there.
CONCEPTS = [
    Concept("anvils", "blue anvil", phrases=("red anvil", "new  gear"), sites=("hot", "cold"), histology=("gear", "plate"), abbreviations=("rod",), zh=("砧",)),
    Concept("widgets", "old widget", phrases=("small widget",), sites=("widget", "gizmo"), morphology=("large", "tiny"), abbreviations=("old",)),
]
#: A concept, a phrase, telling words, neighbouring words, blanks, a single telling word, and words that aren't there.
TOPICS = ["about RED anvil", "Small Ring", "urgent widget of blue economy", "blue ring qqq www eee rrr", "  ", "the urgent", "qqq www"]
SAME = {"anvil": ["anvil", "rod"], "red": ["red", "blue", "hot"]}


def with_modalities(corpus: Corpus) -> Corpus:
    """The corpus with every task as a modality too."""
    more = corpus.of("Task").withColumns({"relation": F.lit("USES_MODALITY"), "type": F.lit("Modality")})
    return replace(corpus, relations=corpus.relations.unionByName(more), stated=None)


def with_mentions(corpus: Corpus) -> Corpus:
    """The corpus with the methods that a discussion names as mentions, not applications."""
    mention = F.expr("IF(type = 'Method' AND section = 'discussion', 'RELATED_TO', relation)")
    return replace(corpus, relations=corpus.relations.withColumn("relation", mention), stated=None)


def on_corpus(call):
    return lambda spark, sf_dir: call(from_star(spark, sf_dir))


CORPUS_QUERIES = {
    "t01_author_stated_gaps": gap.author_stated_gaps,
    "t01_author_stated_gaps_focus": lambda c: gap.author_stated_gaps(c, FOCUS),
    "t02_disease_task_coverage": gap.disease_task_coverage,
    "t03_corpus_focus_coverage": lambda c: gap.corpus_focus_coverage(c, FOCUS),
    "t04_method_disease_combo_gap": gap.method_disease_combo_gap,
    "t05_limitation_temporal": lambda c: lifecycle.temporal_profiles(c).select("limitation", "first_year", "last_year", "year_span", "as_of_year", "proposal_age", "paper_cnt", "asserted_cnt", "hypothesized_cnt", "early_cnt", "recent_cnt", "recent_ratio_milli", "sections", "temporal_status", "cites"),
    "t05b_top_by_status": lambda c: lifecycle.latest_by_status(lifecycle.temporal_profiles(c), 10),
    "t06_limitation_gap_status": lifecycle.limitation_gap_status,
    "t06b_gap_status_board": lifecycle.gap_status_board,
    "t07_combo_gap_temporal": lifecycle.combo_gap_temporal,
    "t08_metric_evidence": gap.metric_evidence,
    "t09_limitation_impact_rank": gap.limitation_impact_rank,
    "t09_limitation_impact_rank_focus": lambda c: gap.limitation_impact_rank(c, FOCUS),
    "t10_hotspot_entities": gap.hotspot_entities,
    "t10_hotspot_entities_focus": lambda c: gap.hotspot_entities(with_mentions(c), FOCUS),
    "t11_recent_highcite_papers": gap.recent_highcite_papers,
    "t13_impact_priority_matrix": gap.impact_priority_matrix,
    "t14_emerging_gap_opportunities": hotspot.emerging_gap_opportunities,
    "t16_resolution_signals": lambda c: lifecycle.resolution_signals(lifecycle.limitation_gap_status(c)),
    "t17_shared_entities": lambda c: lifecycle.shared_entities(c, lifecycle.temporal_profiles(c)),
    "t17_shared_entity_rows": lambda c: lifecycle.shared_entity_rows(c, lifecycle.temporal_profiles(c)),
    "a09_corpus_stats": gap.corpus_stats,
    "a09_database_stats": gap.stats_of_corpus,
    "p06_expanded_foci": lambda c: concepts.expanded(c.of("Disease").select("name").distinct(), concepts.table(c.papers.sparkSession, CONCEPTS), "name").select("name", "concept_id", "canonical", *[F.array_join(x, "|").alias(x) for x in ("phrases", "sites", "morphology")]),
    "a16_method_disease_pivot": gap.method_disease_pivot,
    "h01_window_counts": hotspot.window_counts,
    "h02_emerging_methods": lambda c: hotspot.emerging_entities(c, "Method"),
    "h02_heating_diseases": lambda c: hotspot.emerging_entities(c, "Disease", replace(DEFAULT, min_recent=1)),
    "h02_emerging_tasks": lambda c: hotspot.emerging_entities(c, "Task"),
    "h03_hot_combos": hotspot.hot_combos,
    "h04_emerging_limitations": hotspot.emerging_limitations,
    "h05_top_papers": lambda c: hotspot.top_papers(c, "Method"),
    "h09_board_snapshot": hotspot.boards,
    "h10_week_over_week": hotspot.week_over_week,
    "h11_week_ids": lambda c: c.papers.select(hotspot.week_id(F.col("pub_date")).alias("week"), hotspot.previous_week_id(F.col("pub_date")).alias("before")).groupBy("week", "before").agg(F.count(F.lit(1)).alias("papers")),
    "i01_topic_strategies": lambda c: focus.topic_strategies(c, TOPICS, CONCEPTS),
    "i02_phrase_papers": lambda c: focus.phrase_papers(c, [KEYWORD]),
    "i03_token_scores": lambda c: focus.token_scores(c, focus.meaningful_tokens(TOKENS)),
    "i10_related_papers": lambda c: focus.search_papers(c, KEYWORD, DEFAULT.top_n),
    "i11_methods_for_topic": lambda c: focus.methods_for_topic(c, KEYWORD, DEFAULT.top_n),
    "i12_datasets_for_topic": lambda c: focus.datasets_for_topic(c, KEYWORD, DEFAULT.top_n),
    "i13_metrics_for_topic": lambda c: focus.metrics_for_topic(c, KEYWORD, DEFAULT.top_n),
    "i14_limitations_for_topic": lambda c: focus.limitations_for_topic(c, KEYWORD, DEFAULT.top_n),
    "i15_modalities_for_topic": lambda c: focus.modalities_for_topic(with_modalities(c), KEYWORD, DEFAULT.top_n),
    "i16_recent_papers_for_topic": lambda c: focus.search_papers(c, KEYWORD, DEFAULT.top_n, DEFAULT.start_year),
    "p02_synonym_papers": lambda c: c.of("Disease").filter(focus.mentions(F.col("name"), "red anvil", SAME)).select("pmid", "name"),
    "p03_concept_papers": lambda c: focus.focus_papers(c, CONCEPTS[0]),
    "p03_morphology_papers": lambda c: focus.focus_papers(c, CONCEPTS[1]),
    "p04_focus_papers": lambda c: focus.focus_papers(c, FOCUS),
    "p05_resolved_foci": lambda c: concepts.resolved(c.of("Disease").select("name").distinct(), concepts.table(c.papers.sparkSession, CONCEPTS), "name"),
    "x18_focus_keys": lambda c: concepts.focus_keys(c.of("Disease").select("name"), concepts.table(c.papers.sparkSession, CONCEPTS), "name").groupBy("focus_key").agg(F.count(F.lit(1)).alias("n")),
    "p11_profile_rows": lambda c: lifecycle.profile_rows(lifecycle.temporal_profiles(c), FOCUS, ["persistent", "emerging"]).select("limitation", "temporal_status", "paper_cnt", "recent_ratio_milli"),
    "p12_signal_rows": lambda c: lifecycle.signal_rows(lifecycle.resolution_signals(lifecycle.limitation_gap_status(c)), signal_type="topic_followup", limit=DEFAULT.gap_rows),
    "t19_limitation_impact": lifecycle.limitation_impact,
    "g01_graph_stats": graph.graph_stats,
    "g02_cooccurrence_edges": graph.cooccurrence_edges,
    "g03_degrees": lambda c: graph.degrees(graph.cooccurrence_edges(c)),
    "g04_entity_pagerank": graph.entity_pagerank,
    "g05_community_gaps": graph.community_gaps,
    "g06_disease_method_reach": graph.disease_method_reach,
    "g08_entity_projection": projection.projection_of_corpus,
    "m05_entities": merge.entities_of,
    "o08_top_entities": lambda c: gap.top_entities(c, "Method", "APPLIES_METHOD"),
}
TABLE_QUERIES = {
    "m06_relation_merge": merge.merged_lines,
    "m21_papers_without_relations": merge.papers_without_relations,
    "x04_document_sections": documents.sections_of_documents,
    "x04_markdown_sections": documents.markdown_sections_of_documents,
    "x08_merged_sections": documents.merged_sections,
    "x13_fingerprints": documents.benchmark_fingerprints,
    "x14_title_overlap": documents.title_overlap,
    "v04_turn_funnel": documents.turn_funnel,
    "v10_latest_assistant": documents.latest_assistant,
    "x01_page_sections": documents.page_sections,
    "b03_cohort_pools": feasibility.cohort_pools,
    "b01_feasibility": feasibility.feasibility_of_cohorts,
    "b09_attribute_distribution": feasibility.attribute_distribution,
    "b10_marker_positivity": feasibility.marker_positivity,
    "b04_keyword_patients": feasibility.urgent_patients,
    "b07_cohort_counts": feasibility.counts_of_segments,
    "b08_subtype_distribution": feasibility.subtypes_of_orders,
    "b11_match_summary": feasibility.matches_of_lines,
    "b21_cross_matrix": lambda spark, sf_dir: feasibility.cross_matrix(from_star(spark, sf_dir), feasibility.catalogue_of_nations(spark, sf_dir)),
    "a17_opportunity_summary": lambda spark, sf_dir: feasibility.opportunity_summary(feasibility.cross_matrix(from_star(spark, sf_dir), feasibility.catalogue_of_nations(spark, sf_dir))),
    "w06_recent_runs": reports.recent_orders,
    "x09_other_as_discussion": documents.user_turns_as_discussion,
    "f14_recommendations": feasibility.recommended_cohorts,
    "p09_extraction_queue": queue.queue_of_orders,
    "p14_skip_reasons": queue.skip_reasons_of_texts,
    "m08_marked_papers": queue.marked_orders,
    "m22_mismatches": queue.mismatched_orders,
    "x01_article_sections": articles.article_sections_of_documents,
    "x11_gap_items": reports.gap_items_of_conversations,
    "r03_event_windows": documents.event_windows,
    "b03_centre_pools": landscape.pool_rows,
    "b05_catalogue": landscape.catalogue_of_centre,
    "b06_coverage": landscape.coverage_of_centre,
    "b13_extras": landscape.extras_rows,
    "v09_scale_metrics": landscape.metrics_of_centre,
    "b17_hypotheses": hypotheses.hypotheses_of_orders,
    "b02_data_gaps": hypotheses.data_gaps_of_orders,
    "b18_evolution": hypotheses.evolved_orders,
    "m16_run_states": runs.runs_of_orders,
    "m16_latest_runs": runs.weeks_of_orders,
    "v06_latest_results": runs.results_of_events,
    "v11_support_pmids": runs.support_of_events,
    "o07_sample": sampling.papers_to_compare,
    "b12_mentions": mapping.mentions_of_parts,
    "b14_gap_diseases": mapping.gaps_of_parts,
    "b14_title_diseases": mapping.titles_of_parts,
    "f12_similar_names": mapping.similar_part_names,
}


def queries() -> dict:
    return {name: on_corpus(call) for name, call in CORPUS_QUERIES.items()} | TABLE_QUERIES


def oracle_sql() -> dict[str, str]:
    return oracle.SQL | twins.SQL | mapping_twins.SQL | landscape_twins.SQL | hypothesis_twins.SQL | topic_twins.SQL | run_twins.SQL
