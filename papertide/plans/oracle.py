"""SQL twins of the registered queries, for DuckDB on the same tables."""

from __future__ import annotations

from papertide.operators.documents import SECTION_WORDS
from papertide.sources.corpus import STAR_SQL

#: The same literal settings as papertide.config.DEFAULT and papertide.plans.catalogue.
TOP, GAP_ROWS, HOT, CLOCK, END, START, AS_OF = 30, 40, 20, 2002, 2001, 1999, "DATE '2001-08-01'"
CPY = f"(CAST(citation_count AS DOUBLE) / greatest({CLOCK} - coalesce(nullif(yr, 0), {END}), 1))"
NORM_IF = "CASE WHEN {0} > 0 THEN least({0} / 20, 1.0) ELSE 0.0 END"


def impact(cite: str, cpy: str, avg_if: str, q1: str) -> str:
    raw = f"(0.30 * ln(1 + {cite}) + 0.30 * ln(1 + {cpy}) + 0.20 * ({NORM_IF.format(avg_if)}) + 0.20 * {q1})"
    return f"(floor(least(3.0, {raw} * 1.2) * 100 + 0.5) / 100)"


def emerging(recent: str, prior: str, cpy: str, avg_if: str) -> str:
    raw = f"(0.4 * ln(1 + {recent}) + 0.3 * greatest(0.0, CAST({recent} - {prior} AS DOUBLE) / greatest({prior}, 1)) + 0.2 * ln(1 + {cpy}) + 0.1 * ({NORM_IF.format(avg_if)}))"
    return f"CAST(floor(floor({raw} * 1000 + 0.5) / 1000 * 1000 + 0.5) AS BIGINT)"


PAIRS = """
pairs AS (
    SELECT m.pmid, m.name AS method, d.name AS disease
    FROM relations m JOIN relations d ON m.pmid = d.pmid AND m.type = 'Method' AND d.type = 'Disease'
)"""
GRID = f"""
methods AS (SELECT name AS method, row_number() OVER (ORDER BY count(*) DESC, name) AS method_rank FROM relations WHERE type = 'Method' GROUP BY name QUALIFY method_rank <= {TOP}),
diseases AS (SELECT name AS disease, row_number() OVER (ORDER BY count(*) DESC, name) AS disease_rank FROM relations WHERE type = 'Disease' GROUP BY name QUALIFY disease_rank <= {TOP}),
cells AS (SELECT * FROM methods CROSS JOIN diseases),
{PAIRS.strip()}"""
GAPS = f"""{GRID},
gaps AS (
    SELECT c.method, c.disease, count(DISTINCT p.pmid) AS paper_cnt,
           CASE WHEN count(DISTINCT p.pmid) = 0 THEN 'unexplored' ELSE 'minimal' END AS gap,
           CAST(method_rank AS INTEGER) AS method_rank, CAST(disease_rank AS INTEGER) AS disease_rank
    FROM cells c LEFT JOIN pairs p ON p.method = c.method AND p.disease = c.disease
    GROUP BY c.method, c.disease, method_rank, disease_rank HAVING count(DISTINCT p.pmid) <= 2
    ORDER BY method_rank, disease_rank LIMIT {GAP_ROWS}
)"""
PROFILES = f"""
dated AS (SELECT r.*, p.yr, p.citation_count FROM relations r JOIN papers p ON r.pmid = p.pmid WHERE r.type = 'Limitation' AND p.yr IS NOT NULL),
clock AS (SELECT max(yr) AS as_of_year FROM dated),
base AS (
    SELECT name AS limitation, as_of_year, min(yr) AS first_year, max(yr) AS last_year, count(DISTINCT pmid) AS paper_cnt,
           count(*) FILTER (WHERE polarity = 'asserted') AS asserted_cnt, count(*) FILTER (WHERE polarity = 'hypothesized') AS hypothesized_cnt,
           count(*) FILTER (WHERE yr >= as_of_year - 3) AS recent_cnt,
           array_to_string(list_sort(list(DISTINCT section)), ',') AS sections, CAST(sum(citation_count) AS BIGINT) AS cites
    FROM dated, clock GROUP BY name, as_of_year
),
early AS (
    SELECT b.limitation, count(DISTINCT d.pmid) AS early_cnt FROM base b JOIN dated d ON d.name = b.limitation AND d.yr <= b.first_year + 1 GROUP BY b.limitation
),
profiles AS (
    SELECT b.*, early_cnt, last_year - first_year AS year_span, as_of_year - first_year AS proposal_age,
           CAST(floor(CAST(recent_cnt * 1000 AS DOUBLE) / paper_cnt + 0.5) AS BIGINT) AS recent_ratio_milli,
           CASE WHEN as_of_year - first_year <= 3 THEN 'emerging'
                WHEN recent_cnt = 0 AND last_year < as_of_year - 3 THEN 'declining'
                WHEN recent_cnt > 0 AND floor(CAST(recent_cnt AS DOUBLE) / paper_cnt * 1000 + 0.5) / 1000 >= 0.3 THEN 'persistent'
                ELSE 'stable' END AS temporal_status
    FROM base b JOIN early e ON e.limitation = b.limitation
)"""
STATUS = f"""{PROFILES},
targets AS (SELECT * FROM profiles WHERE temporal_status IN ('persistent', 'declining')),
anchors AS (
    SELECT DISTINCT t.limitation, t.first_year, r.name AS disease
    FROM targets t JOIN dated d ON d.name = t.limitation AND d.yr <= t.first_year + 1
    JOIN relations r ON r.pmid = d.pmid AND r.type = 'Disease'
    WHERE d.pmid IN (SELECT pmid FROM relations WHERE type IN ('Method', 'Task'))
),
later AS (
    SELECT DISTINCT r.name AS disease, r.pmid, p.yr FROM relations r JOIN papers p ON p.pmid = r.pmid
    WHERE r.type = 'Disease' AND p.yr IS NOT NULL
      AND r.pmid IN (SELECT pmid FROM relations WHERE type IN ('Method', 'Task') AND section IN ('methods', 'results'))
),
followups AS (
    SELECT a.limitation, count(DISTINCT l.pmid) AS followup_cnt, min(l.yr) AS first_followup
    FROM anchors a JOIN later l ON l.disease = a.disease AND l.yr > a.first_year GROUP BY a.limitation
),
status AS (
    SELECT t.limitation, temporal_status, first_year, last_year, paper_cnt, coalesce(followup_cnt, 0) AS followup_cnt, first_followup,
           CASE WHEN coalesce(followup_cnt, 0) >= 2 THEN CASE WHEN first_followup > last_year OR first_followup > first_year THEN 'moderate' ELSE 'weak' END
                WHEN coalesce(followup_cnt, 0) = 1 THEN 'weak' ELSE 'none' END AS resolution_signal
    FROM targets t LEFT JOIN followups f ON f.limitation = t.limitation
)"""
SUMS = f"""count(DISTINCT r.pmid) AS paper_cnt, count(*) AS n, CAST(sum(citation_count) AS BIGINT) AS cites,
           CAST(sum(CAST(floor(1000 * {CPY}) AS BIGINT)) AS BIGINT) AS cpy_milli, CAST(sum(coalesce(if_cents, 0)) AS BIGINT) AS if_cents, count(*) FILTER (WHERE if_cents > 0) AS if_n,
           count(*) FILTER (WHERE study_type <> '5-LOW') AS non_review_cnt, count(*) FILTER (WHERE quartile = 'Q1') AS q1"""


def windows(as_of: str) -> str:
    return f"""
    SELECT *, pub_date >= {as_of} - 14 AS recent, pub_date >= {as_of} - 28 AND pub_date < {as_of} - 14 AS prior
    FROM judged WHERE date_precision IN ('day', 'month') AND pub_date IS NOT NULL"""


def emerging_board(kind: str, seen: str = "seen", least: int = 2) -> str:
    mean_if = "(CAST(if_cents AS DOUBLE) / n / 50000)"
    cpy = "coalesce(nullif(CAST(cpy_milli AS DOUBLE) / n / 1000, 0.0), CAST(cites AS DOUBLE) / n)"
    return f"""
    SELECT name, recent_cnt, prior_cnt, CAST(floor(CAST((recent_cnt - prior_cnt) * 100 AS DOUBLE) / greatest(prior_cnt, 1) + 0.5) AS BIGINT) AS velocity_pct,
           {emerging('recent_cnt', 'prior_cnt', cpy, mean_if)} AS score_milli, cites
    FROM (
        SELECT name, count(DISTINCT pmid) FILTER (WHERE recent) AS recent_cnt, count(DISTINCT pmid) FILTER (WHERE prior) AS prior_cnt,
               count(*) FILTER (WHERE recent) AS n, CAST(sum(citation_count) FILTER (WHERE recent) AS BIGINT) AS cites,
               CAST(sum(CAST(floor(1000 * {CPY}) AS BIGINT)) FILTER (WHERE recent) AS BIGINT) AS cpy_milli,
               CAST(sum(coalesce(if_cents, 0)) FILTER (WHERE recent) AS BIGINT) AS if_cents
        FROM (SELECT r.name, s.* FROM relations r JOIN {seen} s ON s.pmid = r.pmid WHERE r.type = '{kind}') GROUP BY name
    ) WHERE recent_cnt >= {least} ORDER BY score_milli DESC, name LIMIT {HOT}"""


def combos(seen: str = "seen") -> str:
    return f"""
    SELECT method, disease, recent_cnt, prior_cnt,
           CASE WHEN prior_cnt = 0 AND recent_cnt <= 2 THEN 'nascent' WHEN recent_cnt > prior_cnt THEN 'heating' WHEN recent_cnt >= 2 THEN 'active' ELSE 'stable' END AS phase,
           {emerging('recent_cnt', 'prior_cnt', '0.0', '0.0')} AS score_milli
    FROM (
        SELECT method, disease, count(DISTINCT s.pmid) FILTER (WHERE recent) AS recent_cnt, count(DISTINCT s.pmid) FILTER (WHERE prior) AS prior_cnt
        FROM pairs p JOIN {seen} s ON s.pmid = p.pmid GROUP BY method, disease
        HAVING count(DISTINCT s.pmid) FILTER (WHERE recent) >= 1 ORDER BY recent_cnt DESC, prior_cnt, method, disease LIMIT {2 * HOT}
    ) ORDER BY score_milli DESC, method, disease LIMIT {HOT}"""


def limitation_board(seen: str = "seen") -> str:
    return f"""
    SELECT name AS limitation, count(DISTINCT s.pmid) AS recent_cnt, CAST(sum(citation_count) AS BIGINT) AS cites
    FROM relations r JOIN {seen} s ON s.pmid = r.pmid AND s.recent WHERE r.type = 'Limitation' GROUP BY name ORDER BY recent_cnt DESC, limitation LIMIT {HOT}"""


def boards(seen: str, names: str) -> str:
    """A board for each of the kinds in names, ranked."""
    parts = {
        "method": f"SELECT 'method' AS board, name AS item_key, recent_cnt, prior_cnt, score_milli FROM ({emerging_board('Method', seen)})",
        "disease": f"SELECT 'disease', name, recent_cnt, prior_cnt, score_milli FROM ({emerging_board('Disease', seen)})",
        "task": f"SELECT 'task', name, recent_cnt, prior_cnt, score_milli FROM ({emerging_board('Task', seen)})",
        "combo": f"SELECT 'combo', method || '|' || disease, recent_cnt, prior_cnt, score_milli FROM ({combos(seen)})",
        "limitation": f"SELECT 'limitation', limitation, recent_cnt, 0, recent_cnt * 1000 FROM ({limitation_board(seen)})",
    }
    rows = " UNION ALL ".join(parts[n] for n in names.split())
    return f"SELECT board, item_key, recent_cnt, CAST(prior_cnt AS BIGINT) AS prior_cnt, score_milli, CAST(row_number() OVER (PARTITION BY board ORDER BY score_milli DESC, item_key) AS INTEGER) AS rank_pos FROM ({rows})"


SEEN = f"seen AS ({windows(AS_OF)})"
TOPIC = "topic AS (SELECT pmid FROM papers WHERE contains(title, 'anvil') UNION SELECT pmid FROM relations WHERE contains(lower(name), 'anvil'))"
FOCUS = "chosen AS (SELECT pmid FROM relations WHERE type = 'Disease' AND contains(name, 'anvil') UNION SELECT pmid FROM papers WHERE contains(title, 'anvil'))"
EDGES = """
nodes AS (SELECT DISTINCT pmid, type || '|' || name AS node FROM relations WHERE type <> 'Limitation'),
edges AS (SELECT a.node AS src, b.node AS dst, count(*) AS weight FROM nodes a JOIN nodes b ON a.pmid = b.pmid AND a.node < b.node GROUP BY a.node, b.node)"""


def star(ctes: str, select: str) -> str:
    return STAR_SQL + (f", {ctes.strip()}" if ctes else "") + "\n" + select


def stated(where: str) -> str:
    return star("", f"""
SELECT name AS limitation, count(DISTINCT pmid) AS paper_cnt, array_to_string(list_sort(list(DISTINCT section)), ',') AS sections,
       array_to_string(list_sort(list(DISTINCT quote)), ',') AS quotes
FROM relations WHERE type = 'Limitation' {where} GROUP BY name ORDER BY paper_cnt DESC, limitation LIMIT {TOP}""")


def for_topic(kind: str) -> str:
    return star(TOPIC, f"""
SELECT name, count(DISTINCT r.pmid) AS paper_cnt, min(yr) AS first_used, max(yr) AS last_used
FROM relations r JOIN papers p ON p.pmid = r.pmid WHERE r.type = '{kind}' AND r.pmid IN (SELECT pmid FROM topic) GROUP BY name""")


def papers_for_topic(where: str) -> str:
    return star(TOPIC, f"SELECT pmid, title, yr, citation_count, CAST(0 AS INTEGER) AS match_score FROM papers WHERE pmid IN (SELECT pmid FROM topic) {where} ORDER BY yr DESC, pmid LIMIT {TOP}")


TOKEN_HITS = " + ".join(f"CAST(contains(lower({{0}}), '{t}') AS INTEGER)" for t in ("blue", "anvil", "widget"))

SQL: dict[str, str] = {
    "t01_author_stated_gaps": stated(""),
    "t01_author_stated_gaps_focus": stated("AND contains(name, 'anvil')"),
    "t02_disease_task_coverage": star("", f"""
SELECT d.name AS disease, count(DISTINCT d.pmid) AS paper_cnt, count(DISTINCT t.name) AS task_variety,
       coalesce(array_to_string(list_sort(list(DISTINCT t.name) FILTER (WHERE t.name IS NOT NULL)), ','), '') AS tasks
FROM relations d LEFT JOIN relations t ON t.pmid = d.pmid AND t.type = 'Task'
WHERE d.type = 'Disease' GROUP BY d.name ORDER BY task_variety, paper_cnt DESC, disease LIMIT {TOP}"""),
    "t03_corpus_focus_coverage": star(FOCUS, """
SELECT *, CAST(CASE WHEN total_papers > 0 THEN floor(CAST(focus_papers * 10000 AS DOUBLE) / total_papers + 0.5) ELSE 0 END AS BIGINT) AS coverage_bp, focus_papers >= 30 AS analysis_ready,
       CASE WHEN focus_papers < 30 THEN 'Focus subset has only ' || focus_papers || ' papers — temporal/combo statistics are low-confidence; do not cite corpus-wide totals.' ELSE '' END AS warnings
FROM (SELECT count(*) AS total_papers, count(c.pmid) AS focus_papers, count(*) FILTER (WHERE c.pmid IS NOT NULL AND extraction_done) AS extracted_papers
      FROM papers p LEFT JOIN chosen c ON c.pmid = p.pmid),
     (SELECT count(*) FILTER (WHERE relation = 'REPORTS_LIMITATION') AS limitation_relations, count(DISTINCT name) FILTER (WHERE relation = 'APPLIES_METHOD') AS methods
      FROM relations WHERE pmid IN (SELECT pmid FROM chosen)),
     (SELECT count(DISTINCT name) AS diseases FROM relations WHERE relation = 'TARGETS_DISEASE' AND contains(lower(name), 'anvil')),
     (SELECT string_agg(name || ' (' || n || ')', '|' ORDER BY n DESC, name) AS top_diseases
      FROM (SELECT name, count(DISTINCT pmid) AS n FROM relations WHERE relation = 'TARGETS_DISEASE' AND contains(lower(name), 'anvil') GROUP BY name ORDER BY n DESC, name LIMIT 5))"""),
    "t04_method_disease_combo_gap": star(GAPS, "SELECT * FROM gaps"),
    "t05_limitation_temporal": star(PROFILES, "SELECT limitation, first_year, last_year, year_span, as_of_year, proposal_age, paper_cnt, asserted_cnt, hypothesized_cnt, early_cnt, recent_cnt, recent_ratio_milli, sections, temporal_status, cites FROM profiles"),
    "t05b_top_by_status": star(PROFILES, """
SELECT * FROM (SELECT temporal_status, CAST(row_number() OVER (PARTITION BY temporal_status ORDER BY paper_cnt DESC, recent_ratio_milli DESC, limitation) AS INTEGER) AS rank, limitation, paper_cnt, recent_ratio_milli FROM profiles) WHERE rank <= 10"""),
    "t06_limitation_gap_status": star(STATUS, "SELECT * FROM status"),
    "t06b_gap_status_board": star(STATUS, f"SELECT * FROM status ORDER BY CASE resolution_signal WHEN 'moderate' THEN 2 WHEN 'weak' THEN 1 ELSE 0 END DESC, paper_cnt DESC, limitation LIMIT {TOP}"),
    "t07_combo_gap_temporal": star(f"""{GRID},
clock AS (SELECT max(p.yr) AS as_of_year FROM relations r JOIN papers p ON r.pmid = p.pmid WHERE r.type = 'Limitation'),
counts AS (
    SELECT method, disease, count(*) AS paper_cnt, min(yr) AS first_year, max(yr) AS last_year, count(*) FILTER (WHERE yr >= as_of_year - 3) AS recent_cnt
    FROM pairs JOIN papers p ON p.pmid = pairs.pmid, clock WHERE yr IS NOT NULL GROUP BY method, disease
)""", f"""
SELECT * FROM (
    SELECT c.method, c.disease, coalesce(paper_cnt, 0) AS paper_cnt, first_year, last_year, coalesce(recent_cnt, 0) AS recent_cnt,
           CASE WHEN coalesce(paper_cnt, 0) = 0 THEN 'unexplored' WHEN recent_cnt = 0 THEN 'dormant' WHEN paper_cnt <= 2 THEN 'nascent' ELSE 'active' END AS phase
    FROM cells c LEFT JOIN counts n ON n.method = c.method AND n.disease = c.disease
) ORDER BY phase <> 'unexplored', paper_cnt, lower(method), disease LIMIT {GAP_ROWS}"""),
    "t08_metric_evidence": star("", "SELECT pmid, name AS metric, metric_value, section, section = 'results' AS results_backed FROM relations WHERE type = 'Metric'"),
    "t09_limitation_impact_rank": star("", f"""
SELECT limitation, paper_cnt, cites, non_review_cnt, heat_milli, impact_score,
       CASE WHEN impact_score >= 2 THEN 'High' WHEN impact_score >= 1 THEN 'Medium' WHEN impact_score > 0 THEN 'Emerging' ELSE 'Unknown' END AS impact_tier
FROM (
    SELECT *, {impact('(CAST(cites AS DOUBLE) / n)', '(CAST(cpy_milli AS DOUBLE) / n / 1000)', '(CAST(if_cents AS DOUBLE) / n / 50000)', 'CASE WHEN CAST(if_cents AS DOUBLE) / n / 50000 >= 5 THEN 1.0 ELSE 0.0 END')} AS impact_score
    FROM (SELECT *, CAST(floor(CAST(paper_cnt * cites * 1000 AS DOUBLE) / n) AS BIGINT) AS heat_milli
          FROM (SELECT name AS limitation, {SUMS} FROM relations r JOIN judged j ON j.pmid = r.pmid WHERE type = 'Limitation' GROUP BY name)
          ORDER BY heat_milli DESC, limitation LIMIT {TOP})
)"""),
    "t10_hotspot_entities": star("", f"""
SELECT name, type, paper_cnt, cites, CAST(floor(CAST(paper_cnt * cites AS DOUBLE) / n + 0.5) AS BIGINT) AS heat
FROM (SELECT name, type, {SUMS} FROM relations r JOIN judged j ON j.pmid = r.pmid GROUP BY name, type) WHERE paper_cnt >= 2 ORDER BY heat DESC, name, type LIMIT {TOP}"""),
    "t11_recent_highcite_papers": star("", f"SELECT pmid, title, yr, citation_count, CAST(floor(10 * {CPY} + 0.5) AS BIGINT) AS cpy_tenths, quartile FROM judged WHERE yr >= {START} ORDER BY cpy_tenths DESC, citation_count DESC, pmid LIMIT {TOP}"),
    "t13_impact_priority_matrix": star(f"""{GAPS},
few AS (SELECT * FROM gaps ORDER BY method_rank, disease_rank LIMIT {TOP}),
support AS (
    SELECT method, disease, {impact('(CAST(cites AS DOUBLE) / n)', '(CAST(cpy_milli AS DOUBLE) / n / 1000)', '(CASE WHEN if_n > 0 THEN CAST(if_cents AS DOUBLE) / if_n / 50000 ELSE 0.0 END)', '(CAST(q1 AS DOUBLE) / n)')} AS impact_score
    FROM (SELECT r.method, r.disease, {SUMS} FROM pairs r JOIN judged j ON j.pmid = r.pmid GROUP BY r.method, r.disease)
)""", """
SELECT f.method, f.disease, paper_cnt, gap, CAST(floor((CASE gap WHEN 'unexplored' THEN 3 WHEN 'minimal' THEN 2 ELSE 1 END + coalesce(impact_score, 0.0)) * 100 + 0.5) AS BIGINT) AS priority_pct
FROM few f LEFT JOIN support s ON s.method = f.method AND s.disease = f.disease"""),
    "t14_emerging_gap_opportunities": star(f"""{GAPS}, {SEEN},
hot AS ({combos()}), hot_methods AS ({emerging_board('Method')}), hot_diseases AS ({emerging_board('Disease')}),
both_ways AS (
    SELECT h.method, h.disease, coalesce(gap, 'active') AS literature_gap, coalesce(g.paper_cnt, h.recent_cnt) AS paper_cnt, phase, recent_cnt, score_milli, 0 AS branch
    FROM hot h LEFT JOIN gaps g ON g.method = h.method AND g.disease = h.disease WHERE gap IS NOT NULL OR phase IN ('heating', 'nascent')
    UNION ALL
    SELECT method, disease, gap, paper_cnt, 'nascent', 0, 0, 1 FROM gaps WHERE method IN (SELECT name FROM hot_methods) OR disease IN (SELECT name FROM hot_diseases)
)""", """
SELECT method, disease, literature_gap, paper_cnt, phase, CAST(recent_cnt AS BIGINT) AS recent_cnt,
       CAST(score_milli + 1000 * CASE literature_gap WHEN 'unexplored' THEN 3 WHEN 'minimal' THEN 2 ELSE 1 END AS BIGINT) AS opportunity_milli
FROM (SELECT *, row_number() OVER (PARTITION BY method, disease ORDER BY branch) AS nth FROM both_ways) WHERE nth = 1
ORDER BY opportunity_milli DESC, method, disease LIMIT 20"""),
    "t16_resolution_signals": star(STATUS, """
SELECT limitation, 'topic_followup' AS signal_type, first_year AS anchor_year, first_followup AS followup_year, CAST(CASE resolution_signal WHEN 'moderate' THEN 70 ELSE 45 END AS INTEGER) AS confidence_pct
FROM status WHERE resolution_signal IN ('weak', 'moderate')
UNION ALL SELECT limitation, 'mention_decline', first_year, last_year, CAST(55 AS INTEGER) FROM status WHERE temporal_status = 'declining'"""),
    "t17_shared_entities": star(PROFILES, """
SELECT a.limitation,
       array_to_string(list_sort(coalesce(list(DISTINCT r.name) FILTER (WHERE r.type = 'Disease'), [])), '|') AS diseases,
       array_to_string(list_sort(coalesce(list(DISTINCT r.name) FILTER (WHERE r.type = 'Task'), [])), '|') AS tasks,
       array_to_string(list_sort(coalesce(list(DISTINCT r.name) FILTER (WHERE r.type = 'Method'), [])), '|') AS methods
FROM (SELECT DISTINCT p.limitation, d.pmid FROM profiles p JOIN dated d ON d.name = p.limitation AND d.yr <= p.first_year + 1 WHERE p.temporal_status IN ('persistent', 'declining')) a
JOIN relations r ON r.pmid = a.pmid AND r.type IN ('Disease', 'Task', 'Method') GROUP BY a.limitation"""),
    "a09_corpus_stats": star("", """
SELECT * FROM (SELECT count(*) AS papers, count(*) FILTER (WHERE full_text_status = 'available') AS full_texts, count(*) FILTER (WHERE extraction_done) AS extracted,
                      count(*) FILTER (WHERE date_precision IN ('day', 'month')) AS dated, CAST(sum(citation_count) AS BIGINT) AS citations FROM papers),
              (SELECT count(*) AS relations, count(DISTINCT type || '|' || name) AS entities, count(*) FILTER (WHERE polarity = 'hypothesized') AS hypothesized FROM relations)"""),
    "a16_method_disease_pivot": star(GRID, "SELECT p.method, " + ", ".join(f"count(DISTINCT p.pmid) FILTER (WHERE disease_rank = {i}) AS disease_{i}" for i in range(1, 6)) + """
FROM pairs p JOIN cells c ON c.method = p.method AND c.disease = p.disease WHERE disease_rank <= 5 GROUP BY p.method"""),
    "h01_window_counts": star("", f"SELECT count(*) FILTER (WHERE date_precision IN ('day', 'month')) AS in_window, count(*) FILTER (WHERE date_precision NOT IN ('day', 'month')) AS low_precision FROM papers WHERE pub_date >= {AS_OF} - 14"),
    "h02_emerging_methods": star(SEEN, emerging_board("Method")),
    "h02_heating_diseases": star(SEEN, emerging_board("Disease", least=1)),
    "h02_emerging_tasks": star(SEEN, emerging_board("Task")),
    "h03_hot_combos": star(f"{PAIRS.strip()}, {SEEN}", combos()),
    "h04_emerging_limitations": star(SEEN, limitation_board()),
    "h05_top_papers": star(f"{SEEN}, board AS (SELECT name FROM ({emerging_board('Method')}) ORDER BY score_milli DESC, name LIMIT 5)", """
SELECT name, CAST(place AS INTEGER) AS place, pmid, citation_count FROM (
    SELECT name, pmid, citation_count, row_number() OVER (PARTITION BY name ORDER BY citation_count DESC, yr DESC, pmid) AS place
    FROM (SELECT DISTINCT r.name, s.pmid, s.citation_count, s.yr FROM relations r JOIN seen s ON s.pmid = r.pmid AND s.recent WHERE r.type = 'Method' AND r.name IN (SELECT name FROM board))
) WHERE place <= 3"""),
    "h09_board_snapshot": star(f"{PAIRS.strip()}, {SEEN}", boards("seen", "method disease task combo limitation")),
    "h10_week_over_week": star(f"""{PAIRS.strip()}, {SEEN}, seen_before AS ({windows("DATE '2001-07-25'")}),
now AS ({boards('seen', 'method disease combo')}), earlier AS ({boards('seen_before', 'method disease combo')}),
first_ten AS (SELECT * FROM now WHERE rank_pos <= 10)""", """
SELECT l.board, l.item_key, 'new' AS change, CAST(NULL AS INTEGER) AS old_rank, l.rank_pos AS new_rank FROM first_ten l LEFT JOIN earlier e ON e.board = l.board AND e.item_key = l.item_key WHERE e.board IS NULL
UNION ALL SELECT e.board, e.item_key, 'cooled', e.rank_pos, NULL FROM earlier e LEFT JOIN first_ten l ON e.board = l.board AND e.item_key = l.item_key WHERE e.rank_pos <= 10 AND l.board IS NULL
UNION ALL SELECT l.board, l.item_key, 'moved', e.rank_pos, l.rank_pos FROM first_ten l JOIN earlier e ON e.board = l.board AND e.item_key = l.item_key WHERE abs(e.rank_pos - l.rank_pos) >= 3"""),
    "h11_week_ids": star("", "SELECT strftime(pub_date, '%G-W%V') AS week, strftime(pub_date - INTERVAL 7 DAY, '%G-W%V') AS before, count(*) AS papers FROM papers GROUP BY 1, 2"),
    "i02_phrase_papers": star(TOPIC, "SELECT pmid FROM topic"),
    "i03_token_scores": star("", f"""
SELECT * FROM (
    SELECT p.pmid, CAST({TOKEN_HITS.format('p.title')} + coalesce(b.hits, 0) AS INTEGER) AS match_score
    FROM papers p LEFT JOIN (SELECT pmid, max({TOKEN_HITS.format('name')}) AS hits FROM relations GROUP BY pmid) b ON b.pmid = p.pmid
) WHERE match_score >= 2"""),
    "i10_related_papers": papers_for_topic(""),
    "i11_methods_for_topic": for_topic("Method") + f" ORDER BY paper_cnt DESC, name LIMIT {TOP}",
    "i12_datasets_for_topic": star(TOPIC, f"""
SELECT r.name, coalesce(access_class, 'unknown') AS access_class, count(DISTINCT r.pmid) AS used_by
FROM relations r LEFT JOIN datasets d ON d.name = r.name WHERE r.type = 'Dataset' AND r.pmid IN (SELECT t.pmid FROM topic t JOIN papers p ON p.pmid = t.pmid)
GROUP BY r.name, access_class ORDER BY CASE coalesce(access_class, 'unknown') WHEN 'public' THEN 0 WHEN 'private' THEN 1 ELSE 2 END, used_by DESC, r.name LIMIT {TOP}"""),
    "i13_metrics_for_topic": star(TOPIC, f"""
SELECT m.pmid, title, m.name AS metric, m.metric_value, m.section, m.quote, yr
FROM relations any_of JOIN papers p ON any_of.pmid = p.pmid JOIN relations m ON m.pmid = p.pmid
WHERE m.relation = 'ACHIEVES_METRIC' AND m.type = 'Metric' AND any_of.pmid IN (SELECT pmid FROM topic)
ORDER BY yr DESC, m.pmid, metric, m.section, m.quote LIMIT {TOP}"""),
    "i14_limitations_for_topic": star(TOPIC, f"""
SELECT name AS limitation, r.pmid, section, quote FROM relations r JOIN papers p ON p.pmid = r.pmid
WHERE r.type = 'Limitation' AND r.pmid IN (SELECT pmid FROM topic) ORDER BY r.pmid, limitation LIMIT {TOP}"""),
    "i15_modalities_for_topic": star(f"""
shown AS (SELECT * FROM relations UNION ALL SELECT * REPLACE ('USES_MODALITY' AS relation, 'Modality' AS type) FROM relations WHERE type = 'Task'),
{TOPIC}""", f"""
SELECT name AS modality, count(DISTINCT r.pmid) AS paper_cnt FROM shown r JOIN papers p ON p.pmid = r.pmid
WHERE r.relation = 'USES_MODALITY' AND r.type = 'Modality' AND r.pmid IN (SELECT pmid FROM topic) GROUP BY name ORDER BY paper_cnt DESC, name LIMIT {TOP}"""),
    "i16_recent_papers_for_topic": papers_for_topic(f"AND yr >= {START}"),
    "p04_focus_papers": star(FOCUS, "SELECT pmid FROM chosen"),
    "g01_graph_stats": star("", """
SELECT 'node_type:Paper' AS metric, count(*) AS value FROM papers UNION ALL SELECT 'node_type:Journal', count(*) FROM journals
UNION ALL SELECT 'node_type:' || type, count(DISTINCT name) FROM relations GROUP BY type
UNION ALL SELECT 'relation:PUBLISHED_IN', count(*) FROM papers WHERE journal_id IN (SELECT journal_id FROM journals)
UNION ALL SELECT 'relation:' || relation, count(*) FROM relations WHERE pmid IN (SELECT pmid FROM papers) GROUP BY relation"""),
    "g02_cooccurrence_edges": star(EDGES, "SELECT * FROM edges"),
    "g03_degrees": star(EDGES, "SELECT node, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS strength FROM (SELECT src AS node, weight FROM edges UNION ALL SELECT dst, weight FROM edges) GROUP BY node"),
    "m05_entities": star("", """
SELECT r.type, r.name, count(DISTINCT pmid) AS papers, coalesce(max(access_class), 'unknown') AS access_class
FROM relations r LEFT JOIN datasets d ON d.name = r.name AND r.type = 'Dataset' GROUP BY r.type, r.name"""),
    "m21_papers_without_relations": "SELECT o_orderkey AS pmid, o_orderstatus AS status FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "x08_merged_sections": """
SELECT conv_id, role AS section_type, CAST(length(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS BIGINT) AS chars,
       sha1(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS content_sha1, min(turn) AS first_idx
FROM (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations) WHERE trim(text) <> '' GROUP BY conv_id, role""",
    "x13_fingerprints": """
SELECT item_id, substr(sha1(array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9\\x{4e00}-\\x{9fff}]+'))), ' ')), 1, 16) AS fingerprint FROM benchmark""",
    "x14_title_overlap": """
WITH t AS (SELECT title, list_distinct(regexp_extract_all(title, '[a-z0-9]+')) AS a FROM (SELECT DISTINCT lower(p_name || ' ' || p_type) AS title FROM part))
SELECT x.title, y.title AS other, CAST(len(list_intersect(x.a, y.a)) AS BIGINT) AS shared FROM t x JOIN t y ON x.title < y.title
WHERE len(list_intersect(x.a, y.a)) > 0 AND len(list_intersect(x.a, y.a)) * 100 >= 50 * len(list_distinct(list_concat(x.a, y.a)))""",
    "v04_turn_funnel": """
SELECT user_turns, assistant_turns, count(*) AS conversations, CAST(max(longest) AS BIGINT) AS longest
FROM (SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS user_turns, count(*) FILTER (WHERE role = 'assistant') AS assistant_turns, max(length(text)) AS longest FROM conversations GROUP BY conv_id)
GROUP BY user_turns, assistant_turns""",
    "v10_latest_assistant": "SELECT conv_id, max(turn) AS turn, CAST(length(arg_max(text, turn)) AS BIGINT) AS chars FROM conversations WHERE role = 'assistant' GROUP BY conv_id",
    "b03_cohort_pools": """
WITH facts AS (SELECT o_custkey, max(CAST(o_orderstatus = 'F' AS INTEGER)) AS survival, max(CAST(o_orderpriority = '1-URGENT' AS INTEGER)) AS her2,
                      date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) AS days FROM orders GROUP BY o_custkey)
SELECT n_name, count(*) AS has_wsi, count(*) FILTER (WHERE survival = 1) AS has_survival, count(*) FILTER (WHERE her2 = 1) AS has_her2,
       count(*) FILTER (WHERE days >= 365) AS meets_followup_12m, count(*) FILTER (WHERE c_acctbal > 0) AS has_annotation
FROM customer LEFT JOIN facts ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
    "b09_attribute_distribution": """
SELECT attribute, value, n, CAST(sum(n) OVER (PARTITION BY attribute) AS BIGINT) AS total FROM (
    SELECT 'status' AS attribute, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY o_orderstatus
    UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority)""",
    "b10_marker_positivity": """
SELECT *, CAST(floor(CAST(positive * 1000 AS DOUBLE) / tested + 0.5) AS BIGINT) AS rate_milli FROM (
    SELECT c_mktsegment, count(DISTINCT c_custkey) AS tested, count(DISTINCT c_custkey) FILTER (WHERE o_orderpriority = '1-URGENT') AS positive
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment)""",
    "r03_event_windows": """
SELECT *, CAST(row_number() OVER (ORDER BY recent_cnt DESC, event_type) AS INTEGER) AS rank_pos FROM (
    SELECT event_type, count(*) FILTER (WHERE CAST(ts AS DATE) >= DATE '2024-01-31' - 14) AS recent_cnt,
           count(*) FILTER (WHERE CAST(ts AS DATE) >= DATE '2024-01-31' - 28 AND CAST(ts AS DATE) < DATE '2024-01-31' - 14) AS prior_cnt,
           count(DISTINCT user_id) FILTER (WHERE CAST(ts AS DATE) >= DATE '2024-01-31' - 14) AS recent_users FROM events GROUP BY event_type)""",
}
#: t09 and t10 for a focus, by the entity's name; t10 with methods of discussions as mentions only.
SQL["t09_limitation_impact_rank_focus"] = SQL["t09_limitation_impact_rank"].replace("WHERE type = 'Limitation' GROUP BY name)", "WHERE type = 'Limitation' AND contains(name, 'anvil') GROUP BY name)")
SQL["t10_hotspot_entities_focus"] = SQL["t10_hotspot_entities"].replace(
    "ON j.pmid = r.pmid GROUP BY name, type)", "ON j.pmid = r.pmid WHERE contains(name, 'anvil') AND (type <> 'Method' OR section <> 'discussion') GROUP BY name, type)"
)
SECTION = "CASE " + " ".join(
    f"WHEN {' OR '.join(f'contains(lower(content), {chr(39)}{w}{chr(39)})' for w in words)} THEN '{name}'" for name, words in SECTION_WORDS
) + " ELSE 'other' END"
SQL["x04_document_sections"] = f"""
SELECT lang, section_type, count(*) AS sections, count(DISTINCT doc_id) AS documents, CAST(sum(length(content)) AS BIGINT) AS chars
FROM (SELECT doc_id, lang, content, {SECTION} AS section_type
      FROM (SELECT doc_id, lang, unnest(string_split(coalesce(text, ''), chr(10))) AS content FROM documents) WHERE trim(content) <> '')
GROUP BY lang, section_type"""
SQL["b01_feasibility"] = f"""
WITH pools AS ({SQL['b03_cohort_pools']}),
c AS (SELECT n_name, has_wsi AS wsi, least(has_wsi, has_survival, has_annotation, has_her2, meets_followup_12m) AS cohort FROM pools),
s AS (SELECT *, least(1.0, floor(CAST(cohort AS DOUBLE) / greatest(wsi, 1) * 100 + 0.5) / 100) AS score FROM c)
SELECT n_name, wsi, cohort, CAST(floor(score * 100 + 0.5) AS BIGINT) AS score_pct,
       CASE WHEN score >= 0.8 THEN 'APPROVED' WHEN score >= 0.5 THEN 'REFINED' WHEN score >= 0.2 THEN 'RISKY' ELSE 'REJECTED_DATA_INSUFFICIENT' END AS status FROM s"""
