"""SQL twins of the queries on concepts, the extraction queue, articles, reports and cohorts, for DuckDB."""

from __future__ import annotations

from papertide.operators.documents import SECTION_WORDS
from papertide.plans import oracle
from papertide.plans.oracle import GAP_ROWS, GAPS, PROFILES, STATUS, SUMS, impact, star


def either(column: str, *terms: str) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{t}')" for t in terms) + ")"


def anvils(c: str) -> str:
    short = f"({c} LIKE '% rod %' OR {c} LIKE 'rod %' OR {c} LIKE '% rod')"
    site, tissue = either(c, "hot", "cold"), either(c, "gear", "plate")
    return f"({either(c, 'blue anvil', 'red anvil', 'new  gear')} OR ({site} AND {tissue}) OR ({short} AND ({site} OR {tissue})))"


def widgets(c: str) -> str:
    return f"({either(c, 'old widget', 'small widget')} OR ({either(c, 'widget', 'gizmo')} AND {either(c, 'large', 'tiny')}))"


def in_concept(test) -> str:
    return star("", f"SELECT pmid FROM relations WHERE type = 'Disease' AND {test('name')} UNION SELECT pmid FROM papers WHERE {test('title')}")


RESOLVED = """
aliases(place, concept_id, canonical, alias, kind) AS (VALUES
    (0, 'anvils', 'blue anvil', '砧', 0), (0, 'anvils', 'blue anvil', 'red anvil', 1), (0, 'anvils', 'blue anvil', 'new  gear', 1), (0, 'anvils', 'blue anvil', 'blue anvil', 2), (0, 'anvils', 'blue anvil', 'rod', 3),
    (1, 'widgets', 'old widget', 'small widget', 1), (1, 'widgets', 'old widget', 'old widget', 2), (1, 'widgets', 'old widget', 'old', 3)),
names AS (SELECT DISTINCT name FROM relations WHERE type = 'Disease'),
best AS (
    SELECT name, concept_id, canonical FROM names JOIN aliases
    ON CASE kind WHEN 0 THEN contains(name, alias) WHEN 3 THEN regexp_matches(name, '\\b' || alias || '\\b') ELSE contains(name, alias) OR contains(alias, name) END
    QUALIFY row_number() OVER (PARTITION BY name ORDER BY length(alias) DESC, kind, place) = 1
),
known AS (SELECT n.name, concept_id, canonical FROM names n LEFT JOIN best b ON b.name = n.name)"""

TITLE, BODY = "lower(trim(title))", "lower(trim(body))"


def begins(*values: str) -> str:
    return "(" + " OR ".join(f"starts_with({TITLE}, '{v}')" for v in values) + ")"


def types_rule(kind: str) -> str:
    has = f"contains(types, '{kind}')"
    if kind in ("published erratum", "retracted publication"):
        return f"WHEN {has} AND (length(trim(body)) < 200 OR contains({BODY}, 'corrects the article')) THEN 'published erratum'"
    return f"WHEN {has} THEN 'non-extractable pub_type ({kind})'"


KINDS = ("editorial", "news", "interview", "newspaper article", "patient education handout", "published erratum", "retracted publication", "expression of concern")
REASON = f"""CASE
    WHEN {begins('correction:', 'corrigendum:', 'erratum:', 'retraction:', 'withdrawn:', 'publisher correction:', 'author correction:')} THEN 'erratum/correction notice'
    WHEN {begins('special issue:', 'special issue ', 'special section:')} THEN 'special issue / section notice'
    WHEN {begins('in this issue:', "editor''s note:", "editors'' note:", 'from the editor:')} THEN 'editor note'
    WHEN {either('title', 'meeting report', 'workshop report', 'conference report', 'conference proceedings', 'proceeding of the', 'proceedings of the')} THEN 'meeting/workshop/proceedings report'
    WHEN {either('body', 'this meeting brought together', 'this workshop brought together', 'workshop on translational')} THEN 'meeting/workshop summary'
    WHEN {begins('comment on:')} AND length(trim(body)) < 200 THEN 'comment/reply (no substantive abstract)'
    {' '.join(map(types_rule, KINDS))}
    {' '.join(f"WHEN contains(types, '{k}') AND length(trim(body)) < 400 THEN 'short {k} (thin abstract)'" for k in ('letter', 'comment', 'commentary'))}
    WHEN length(trim(body)) < 80 AND contains({BODY}, 'corrects the article') THEN 'doi correction stub'
    WHEN length(trim(body)) <= 250 AND {either('body', 'anecdotal', 'viewpoint', 'commentary', 'opinion')} THEN 'thin commentary/viewpoint' END"""
QUEUE_PAPERS = """
WITH papers AS (
    SELECT o_orderkey AS pmid, '10.1/C' || c_custkey AS doi, year(o_orderdate) AS yr, o_orderstatus, o_orderpriority,
           CASE WHEN o_orderpriority = '1-URGENT' THEN 'Erratum: ' || c_mktsegment ELSE o_orderpriority END AS title,
           CASE WHEN c_mktsegment <> 'MACHINERY' THEN o_orderpriority || ' ' || c_mktsegment END AS abstract,
           CASE WHEN o_orderstatus = 'F' THEN 'available' WHEN o_orderpriority = '5-LOW' THEN 'pdf_available' ELSE 'pending' END AS full_text_status,
           o_orderstatus = 'O' AS extraction_done
    FROM orders JOIN customer ON o_custkey = c_custkey)"""

SQL = {
    "p02_synonym_papers": star("", f"SELECT pmid, name FROM relations WHERE type = 'Disease' AND (contains(name, 'red anvil') OR ({either('name', 'red', 'blue', 'hot')} AND {either('name', 'anvil', 'rod')}))"),
    "p03_concept_papers": in_concept(anvils),
    "p03_morphology_papers": in_concept(widgets),
    "p05_resolved_foci": star(RESOLVED, "SELECT name, concept_id, canonical FROM known"),
    "x18_focus_keys": star(RESOLVED, """
SELECT coalesce(canonical, name) AS focus_key, count(*) AS n FROM known k JOIN (SELECT name AS said FROM relations WHERE type = 'Disease') r ON r.said = k.name GROUP BY 1"""),
    "p11_profile_rows": star(PROFILES, """
SELECT limitation, temporal_status, paper_cnt, recent_ratio_milli FROM profiles WHERE contains(limitation, 'anvil') AND temporal_status IN ('persistent', 'emerging')"""),
    "p12_signal_rows": star(STATUS, f"""
SELECT limitation, 'topic_followup' AS signal_type, first_year AS anchor_year, first_followup AS followup_year, CAST(CASE resolution_signal WHEN 'moderate' THEN 70 ELSE 45 END AS INTEGER) AS confidence_pct
FROM status WHERE resolution_signal IN ('weak', 'moderate') ORDER BY confidence_pct DESC, followup_year DESC, limitation LIMIT {GAP_ROWS}"""),
    "t19_limitation_impact": star("", f"""
SELECT *, CASE WHEN impact_score >= 2 THEN 'High' WHEN impact_score >= 1 THEN 'Medium' WHEN impact_score > 0 THEN 'Emerging' ELSE 'Unknown' END AS impact_tier
FROM (SELECT limitation, n AS support_papers, cites, q1,
             {impact('CAST(cites AS DOUBLE) / n', 'CAST(cpy_milli AS DOUBLE) / n / 1000', 'CASE WHEN if_n > 0 THEN CAST(if_cents AS DOUBLE) / if_n / 50000 ELSE 0.0 END', 'CAST(q1 AS DOUBLE) / n')} AS impact_score
      FROM (SELECT name AS limitation, {SUMS} FROM relations r JOIN judged j ON j.pmid = r.pmid WHERE type = 'Limitation' AND yr IS NOT NULL GROUP BY name))"""),
    "b04_keyword_patients": """
SELECT DISTINCT c_custkey AS patient_id FROM customer JOIN orders ON o_custkey = c_custkey
WHERE c_acctbal > 0 AND (contains(lower(o_orderpriority), 'urgent') OR contains(lower(o_orderpriority), 'high'))""",
    "b07_cohort_counts": """
SELECT c_mktsegment, CASE WHEN told = 0 THEN patient_rows ELSE told END AS patient_count, slide_count, hospital_count, patient_rows FROM (
    SELECT c_mktsegment, CAST(count(DISTINCT c_custkey) FILTER (WHERE c_acctbal > 0 AND c_mktsegment <> 'MACHINERY') AS BIGINT) AS told, count(o_orderkey) AS slide_count,
           count(DISTINCT c_nationkey) AS hospital_count, count(DISTINCT c_custkey) AS patient_rows
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment)""",
    "b08_subtype_distribution": """
SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority ELSE '(unknown)' END AS subtype, count(*) AS n
FROM orders WHERE o_orderstatus = 'F' OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1""",
    "b11_match_summary": """
WITH rows AS (SELECT 'pending review' AS status, CASE WHEN l_returnflag = 'N' THEN '(unknown)' ELSE l_returnflag END AS method,
                     CASE WHEN p_type = 'PROMO' THEN p_name ELSE p_type END AS mention FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'F')
SELECT 'status' AS histogram, status AS value, count(*) AS n FROM rows GROUP BY status
UNION ALL SELECT 'method', method, count(*) FROM rows GROUP BY method
UNION ALL (SELECT 'mention', mention, count(*) FROM rows GROUP BY mention ORDER BY count(*) DESC, mention LIMIT 20)""",
    "f14_recommendations": f"SELECT n_name, cohort, CASE WHEN score_pct >= 80 AND cohort >= 500 THEN 'FEASIBLE' WHEN score_pct >= 50 OR cohort >= 200 THEN 'MARGINAL' WHEN score_pct >= 20 OR cohort >= 50 THEN 'RISKY' ELSE 'INSUFFICIENT' END AS recommendation FROM ({oracle.SQL['b01_feasibility']})",
    "b21_cross_matrix": star(f"""{GAPS},
few AS (SELECT * FROM gaps ORDER BY method_rank, disease_rank LIMIT 30),
support AS (
    SELECT method, disease, {impact('CAST(cites AS DOUBLE) / n', 'CAST(cpy_milli AS DOUBLE) / n / 1000', 'CASE WHEN if_n > 0 THEN CAST(if_cents AS DOUBLE) / if_n / 50000 ELSE 0.0 END', 'CAST(q1 AS DOUBLE) / n')} AS score
    FROM (SELECT r.method, r.disease, {SUMS} FROM pairs r JOIN judged j ON j.pmid = r.pmid GROUP BY r.method, r.disease)),
named AS (SELECT s_nationkey AS nation, lower(s_name) AS name FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) = 1),
entries AS (SELECT nation, name, 10 * count(*) AS cases FROM named JOIN customer ON c_nationkey = nation GROUP BY nation, name),
chosen AS (SELECT disease, nation, cases FROM (SELECT DISTINCT disease FROM few) f JOIN entries e ON contains(disease, name) OR contains(name, disease) QUALIFY row_number() OVER (PARTITION BY disease ORDER BY nation) = 1)""", """
SELECT f.method, f.disease, 'D' || nation AS disease_id, gap, paper_cnt, coalesce(cases, 0) AS cohort,
       CASE WHEN coalesce(cases, 0) >= 500 THEN 'high' WHEN coalesce(cases, 0) >= 200 THEN 'medium' ELSE 'low' END AS data_support,
       CAST(floor((CASE gap WHEN 'unexplored' THEN 3 ELSE 2 END + CASE WHEN coalesce(cases, 0) >= 500 THEN 3 WHEN coalesce(cases, 0) >= 200 THEN 1 ELSE 0 END + coalesce(score, 0.0)) * 100 + 0.5) AS BIGINT) AS priority_pct
FROM few f LEFT JOIN support s ON s.method = f.method AND s.disease = f.disease LEFT JOIN chosen c ON c.disease = f.disease"""),
    "p09_extraction_queue": QUEUE_PAPERS + """
SELECT pmid, CAST(CASE WHEN starts_with(title, 'Erratum:') THEN 2 ELSE 0 END AS INTEGER) AS notice_rank, CAST(yr AS INTEGER) AS yr,
       CAST(CASE full_text_status WHEN 'available' THEN 0 WHEN 'pdf_available' THEN 1 ELSE 2 END AS INTEGER) AS text_rank
FROM papers WHERE NOT extraction_done AND abstract IS NOT NULL""",
    "p14_skip_reasons": f"""
WITH told AS (SELECT 'document' AS kind, doc_id AS id, CAST(0 AS BIGINT) AS turn, text FROM documents UNION ALL SELECT 'turn', conv_id, CAST(turn AS BIGINT), text FROM conversations),
parts AS (SELECT kind, id, turn, split_part(coalesce(text, ''), chr(10), 1) AS title, coalesce(text, '') AS body, lower(coalesce(text, '')) AS types FROM told)
SELECT kind, id, turn, {REASON} AS reason,
       CASE WHEN contains(types, 'meta-analysis') OR contains(types, 'meta analysis') THEN 'meta_analysis' WHEN contains(types, 'review') THEN 'review'
            WHEN contains(types, 'clinical trial') OR contains(types, 'clinical study') OR contains(types, 'validation study') THEN 'clinical_study' END AS study_type
FROM parts""",
    "m08_marked_papers": QUEUE_PAPERS + """,
texts AS (SELECT l_orderkey AS pmid FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), types AS (SELECT l_orderkey AS pmid FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT CASE WHEN t.pmid IS NOT NULL THEN 'available' ELSE full_text_status END AS full_text_status, y.pmid IS NOT NULL OR extraction_done AS extraction_done,
       CASE WHEN y.pmid IS NOT NULL THEN 'review' END AS study_type, count(*) AS papers, count(t.pmid) AS with_pmc, count(t.pmid) AS fetched
FROM papers p LEFT JOIN texts t ON t.pmid = p.pmid LEFT JOIN types y ON y.pmid = p.pmid GROUP BY 1, 2, 3""",
    "m22_mismatches": QUEUE_PAPERS + """
SELECT pmid, doi, CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(pmid + CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END AS VARCHAR) END AS xml_pmid,
       '10.1/c' || (CAST(replace(doi, '10.1/C', '') AS BIGINT) + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS xml_doi
FROM papers WHERE o_orderpriority = '2-HIGH' OR o_orderstatus = 'P'""",
    "x11_gap_items": r"""
WITH turns AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank_pos FROM conversations WHERE conv_id IS NOT NULL),
items AS (SELECT conv_id, rank_pos, role || ' of ' || turn AS title, '### Gap ' || turn || ': ' || role || ' of ' || turn || '**' || chr(10) || '- **Research question**: ' || text AS part, text FROM turns)
SELECT conv_id, rank_pos, title, substr(trim(regexp_extract(text, '^\s*([^\n]+)', 1)), 1, 500) AS research_question,
       substr(sha1(array_to_string(list_sort(list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+'))), ' ')), 1, 16) AS fingerprint, length(trim(part)) AS chars
FROM items""",
    "x01_article_sections": f"""
WITH lines AS (SELECT doc_id, unnest(string_split(regexp_replace(coalesce(text, ''), '[\\x00-\\x08\\x0B-\\x1F]', ' ', 'g'), chr(10))) AS line FROM documents),
told AS (SELECT doc_id, lower(' ' || split_part(line, ' ', 1)) AS title, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS content FROM lines)
SELECT doc_id, CASE {' '.join(f"WHEN {either('title', *words)} THEN '{name}'" for name, words in SECTION_WORDS)} ELSE 'other' END AS section_type,
       count(*) AS sections, CAST(sum(length(content)) AS BIGINT) AS chars, count(*) AS own
FROM told WHERE content <> '' GROUP BY 1, 2""",
    "o08_top_entities": star("", "SELECT name, count(*) AS n FROM relations WHERE type = 'Method' AND relation = 'APPLIES_METHOD' GROUP BY name ORDER BY n DESC, name LIMIT 20"),
    "w06_recent_runs": """
SELECT o_orderkey AS run_id, o_orderpriority AS focus_key, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) AS INTEGER) AS place
FROM orders WHERE o_orderstatus <> 'O' QUALIFY place <= 5""",
    "x09_other_as_discussion": """
SELECT conv_id, 'discussion' AS section_type, 'discussion (from other)' AS title, CAST(length(content) AS BIGINT) AS chars
FROM (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS content FROM conversations
      WHERE role = 'user' AND conv_id IS NOT NULL AND trim(coalesce(text, '')) <> '' GROUP BY conv_id) WHERE length(trim(content)) >= 200""",
}
SQL["a17_opportunity_summary"] = f"""
SELECT count(*) AS combo_count, count(*) FILTER (WHERE gap IN ('unexplored', 'minimal')) AS scarce_count, count(*) FILTER (WHERE disease_id <> '') AS mapped_count,
       CAST(coalesce(floor(count(*) FILTER (WHERE data_support = 'high') * 10000.0 / nullif(count(*), 0) + 0.5), 0) AS BIGINT) AS high_bp
FROM ({SQL['b21_cross_matrix']})"""
