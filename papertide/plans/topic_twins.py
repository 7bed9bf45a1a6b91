"""SQL twins of the projection and of the topic cascade, written from the rules."""

from __future__ import annotations

from papertide.plans import twins
from papertide.plans.oracle import star



def hits(column: str, *tokens: str) -> str:
    return "(" + " + ".join(f"CAST(contains(lower({column}), '{t}') AS INTEGER)" for t in tokens) + ")"


FOUR, SIX = ("urgent", "widget", "blue", "economy"), ("blue", "ring", "qqq", "www", "eee", "rrr")
BEST = "\n".join(
    f"{name} AS (SELECT p.pmid, {hits('title', *words)} + coalesce(best, 0) AS score FROM papers p LEFT JOIN (SELECT pmid, max({hits('name', *words)}) AS best FROM relations GROUP BY pmid) b ON b.pmid = p.pmid),"
    for name, words in (("scored", FOUR), ("six", SIX))
)

SQL = {
    "g08_entity_projection": star(
        """links AS (SELECT pmid AS paper, type || '|' || name AS node, relation, section, substr(quote, 1, 120) AS quote, quote AS whole, row_number() OVER (PARTITION BY pmid ORDER BY type || '|' || name, relation) AS place FROM relations WHERE type IN ('Disease', 'Task')),
pairs AS (SELECT least(p.node, q.node) AS src, greatest(p.node, q.node) AS dst, p.paper, p.place AS i, q.place AS j, p.relation AS r0, q.relation AS r1, p.section AS s0, q.section AS s1, p.quote AS q0, q.quote AS q1 FROM links p JOIN links q ON p.paper = q.paper AND p.place < q.place),
sides AS (SELECT src, dst, paper, i, j, 0 AS side, r0 AS relation, s0 AS section, q0 AS quote FROM pairs UNION ALL SELECT src, dst, paper, i, j, 1, r1, s1, q1 FROM pairs),
met AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY paper, i, j, side) AS at_ FROM sides),
rel AS (SELECT src, dst, string_agg(relation || '(' || n || ')', ', ' ORDER BY n DESC, first) AS relations FROM (SELECT src, dst, relation, count(*) AS n, min(at_) AS first FROM met GROUP BY src, dst, relation QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY count(*) DESC, min(at_)) <= 4) GROUP BY ALL),
sec AS (SELECT src, dst, string_agg(section || '(' || n || ')', ', ' ORDER BY n DESC, first) AS sections FROM (SELECT src, dst, section, count(*) AS n, min(at_) AS first FROM met GROUP BY src, dst, section QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY count(*) DESC, min(at_)) <= 3) GROUP BY ALL),
quo AS (SELECT src, dst, string_agg(quote, ' | ' ORDER BY at_) AS quotes FROM met WHERE at_ <= 3 GROUP BY ALL),
wei AS (SELECT src, dst, count(*) AS weight FROM pairs GROUP BY ALL),
related AS (SELECT t.paper, t.node AS a, d.node AS b, t.section, t.whole FROM links t JOIN links d ON t.paper = d.paper AND t.node LIKE 'Task|%' AND t.relation = 'PERFORMS_TASK' AND t.section = 'discussion' AND d.node LIKE 'Disease|%' AND d.relation = 'TARGETS_DISEASE'),
more AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, count(*) AS n, arg_max(section, (paper, a)) AS section, arg_max(whole, (paper, a)) AS quote FROM related GROUP BY least(a, b), greatest(a, b))""",
        """SELECT coalesce(w.src, m.src) AS src, coalesce(w.dst, m.dst) AS dst, coalesce(weight, 0) + coalesce(n, 0) AS weight, CASE WHEN n IS NULL THEN 'CO_OCCURS' ELSE 'RELATED_TO' END AS relation,
CASE WHEN n IS NULL THEN relations ELSE 'RELATED_TO' END AS relations, CASE WHEN n IS NULL THEN sections ELSE m.section END AS sections, CASE WHEN n IS NULL THEN quotes ELSE m.quote END AS quotes
FROM wei w LEFT JOIN rel USING (src, dst) LEFT JOIN sec USING (src, dst) LEFT JOIN quo USING (src, dst) FULL JOIN more m ON m.src = w.src AND m.dst = w.dst""",
    ),
    "i01_topic_strategies": star(
        f"""asked(no, keyword, strategy, need) AS (VALUES (0, 'about RED anvil', 'concept(anvils)', 0), (1, 'Small Ring', 'full_phrase', 0), (2, 'urgent widget of blue economy', 'token_score', 2), (3, 'blue ring qqq www eee rrr', 'key_phrases', 0)),
phrases(no, phrase) AS (VALUES (0, 'blue anvil'), (0, 'new  gear'), (0, 'red anvil'), (1, 'small ring'), (3, 'blue ring'), (3, 'ring qqq'), (3, 'qqq www'), (3, 'www eee'), (3, 'eee rrr')),
named AS (SELECT DISTINCT no, pmid FROM relations JOIN phrases ON contains(lower(name), phrase) UNION SELECT no, pmid FROM papers JOIN phrases ON contains(lower(title), phrase)),
{BEST}
found AS (SELECT no, pmid, 0 AS score FROM named UNION ALL SELECT 2, pmid, score FROM scored WHERE score >= 2),
missing AS (  -- the strategies above hold only if no earlier one finds any paper, and the last topic none at all
    SELECT count(*) AS n FROM (SELECT pmid FROM relations WHERE contains(lower(name), 'urgent widget of blue economy') OR contains(lower(name), 'qqq') OR contains(lower(name), 'the urgent')
    UNION ALL SELECT pmid FROM papers WHERE contains(lower(title), 'urgent widget of blue economy') OR contains(lower(title), 'qqq') OR contains(lower(title), 'the urgent')
    UNION ALL SELECT pmid FROM six WHERE score >= 3)
)""",
        """SELECT keyword, strategy, count(pmid) AS papers, CAST(coalesce(sum(pmid), 0) AS BIGINT) AS pmids, CAST(coalesce(sum(score), 0) AS BIGINT) AS score
FROM asked LEFT JOIN found USING (no), missing WHERE n = 0 GROUP BY keyword, strategy
UNION ALL SELECT '  ', 'empty', 0, 0, 0 UNION ALL SELECT 'the urgent', 'no_match', 0, 0, 0 UNION ALL SELECT 'qqq www', 'no_match', 0, 0, 0""",
    ),
    "a09_database_stats": star("""told AS (
    SELECT *, CASE pmid % 5 WHEN 0 THEN 'openalex' WHEN 1 THEN 'semantic_scholar' WHEN 2 THEN 'unavailable' WHEN 3 THEN 'other' END AS src, CASE WHEN pmid % 7 <> 0 THEN date_precision END AS prec FROM papers
)""", " UNION ALL ".join(f"SELECT '{name}' AS metric, count(*) AS value FROM {rows}" for name, rows in {
        "papers": "told", "fulltext_jats": "told WHERE full_text_status = 'available'", "fulltext_mineru_pdf": "told WHERE full_text_status = 'pdf_available'", "fulltext_unavailable": "told WHERE full_text_status = 'unavailable'",
        "fulltext_available": "told WHERE full_text_status IN ('available', 'pdf_available')", "extracted": "told WHERE extraction_done", "s2_enriched": "told WHERE src <> 'unavailable'", "citations_openalex": "told WHERE src = 'openalex'",
        "citations_semantic_scholar": "told WHERE src = 'semantic_scholar'", "date_precision_day": "told WHERE prec = 'day'", "date_precision_month": "told WHERE prec = 'month'", "date_precision_year": "told WHERE prec = 'year'",
        "date_precision_unknown": "told WHERE prec = 'unknown'", "date_precision_missing": "told WHERE prec IS NULL", "relations": "relations", "entities": "(SELECT DISTINCT type, name FROM relations)",
        "relations_fulltext": "relations WHERE section = 'results'", "relations_mineru_pdf": "relations WHERE section = 'methods'", "relations_abstract": "relations WHERE section = 'discussion'",
        "journals_with_if": "journals WHERE if_cents IS NOT NULL", "sections": "relations WHERE type = 'Limitation'",
    }.items())),
    "p06_expanded_foci": f"""
SELECT k.name, k.concept_id, k.canonical, coalesce(phrases, '') AS phrases, coalesce(sites, '') AS sites, coalesce(morphology, '') AS morphology
FROM ({twins.SQL["p05_resolved_foci"]}) k LEFT JOIN (VALUES
    ('anvils', 'blue anvil|new  gear|red anvil', 'hot|cold', ''), ('widgets', 'old widget|small widget', 'widget|gizmo', 'large|tiny')) c(concept_id, phrases, sites, morphology) ON c.concept_id = k.concept_id""",
}
