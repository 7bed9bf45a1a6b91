"""SQL twins of runs, latest results and samples, written from the rules."""

from __future__ import annotations

STATES = """
told AS (
    SELECT l_orderkey AS run_id, l_shipdate AS at_, l_partkey * 1000000 + CAST(trunc(l_extendedprice) AS BIGINT) * 10 + l_linenumber AS seq,
           CASE WHEN l_linenumber = 2 THEN 'insert' WHEN l_returnflag = 'R' THEN 'finalize' WHEN l_returnflag = 'A' THEN 'hotspot' ELSE 'proposal' END AS kind,
           strftime(o_orderdate, '%Y-%m') AS week_id, o_orderpriority AS focus_key, o_orderstatus AS source,
           CASE WHEN l_suppkey % 3 <> 0 THEN 'g' || l_suppkey END AS gap, CASE WHEN l_suppkey % 4 <> 0 THEN 'w' || l_suppkey END AS week, CASE WHEN l_suppkey % 5 <> 0 THEN 'p' || l_suppkey END AS proposal
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
begun AS (SELECT * FROM told WHERE kind = 'insert' QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY at_, seq) = 1),
valid AS (SELECT t.* FROM told t JOIN begun b USING (run_id) WHERE (t.at_, t.seq) >= (b.at_, b.seq)),
states AS (
    SELECT b.run_id, b.week_id, b.focus_key, b.source, b.at_ AS started_at, f.finished_at, g.gap AS gap_report_path, w.week AS hotspot_week_id, p.proposal AS proposal_report_path
    FROM begun b
    LEFT JOIN (SELECT run_id, max(at_) AS finished_at FROM valid WHERE kind = 'finalize' GROUP BY run_id) f USING (run_id)
    LEFT JOIN (SELECT run_id, gap FROM valid WHERE kind = 'finalize' AND gap IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY at_ DESC, seq DESC) = 1) g USING (run_id)
    LEFT JOIN (SELECT run_id, week FROM valid WHERE kind = 'hotspot' OR kind = 'finalize' AND week IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY at_ DESC, seq DESC) = 1) w USING (run_id)
    LEFT JOIN (SELECT run_id, proposal FROM valid WHERE kind IN ('finalize', 'proposal') AND proposal IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY at_ DESC, seq DESC) = 1) p USING (run_id)
)"""

SQL = {
    "m16_run_states": f"WITH {STATES.strip()}\nSELECT run_id, week_id, focus_key, source, strftime(started_at, '%Y-%m-%d') AS started_at, strftime(finished_at, '%Y-%m-%d') AS finished_at, gap_report_path, hotspot_week_id, proposal_report_path FROM states",
    "m16_latest_runs": f"WITH {STATES.strip()}\nSELECT week_id, focus_key, run_id FROM states QUALIFY row_number() OVER (PARTITION BY week_id, focus_key ORDER BY coalesce(finished_at, started_at) DESC, run_id DESC) = 1",
    "v06_latest_results": """
SELECT user_id AS session, event_type AS name, event_id AS seq, CAST(CASE WHEN value > 5 THEN CAST(floor(value) AS BIGINT) % 7 + 1 ELSE 0 END AS INTEGER) AS records, event_id AS told
FROM events WHERE event_id % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1""",
    "v11_support_pmids": """
SELECT session, string_agg(CAST(pmid AS VARCHAR), ',' ORDER BY place) AS pmids
FROM (SELECT user_id % 50 AS session, CAST(trunc(value) AS INTEGER) % 40 AS pmid, min(event_id) AS place FROM events WHERE value >= 1 GROUP BY ALL) GROUP BY session""",
    "o07_sample": """
SELECT o_orderkey, o_orderpriority, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('7:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS INTEGER) AS place
FROM orders WHERE o_orderstatus <> 'P' QUALIFY place <= 20""",
}
