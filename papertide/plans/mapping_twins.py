"""SQL twins of the mapping queries, written from the rules. The hand-made lists are spelled out once more."""

from __future__ import annotations

#: After sim_pairs (a, b), in lower case: their ratio by longest common blocks, the earliest of equals, left and right of it.
SIMS = """
places AS (SELECT a, b, i, j, max(l) AS k FROM sim_pairs, unnest(range(1, length(a) + 1)) x(i), unnest(range(1, length(b) + 1)) y(j), unnest(range(1, least(length(a), length(b)) + 1)) z(l)
           WHERE substr(a, i, l) = substr(b, j, l) AND i + l <= length(a) + 1 AND j + l <= length(b) + 1 GROUP BY a, b, i, j),
work AS (
    SELECT a, b, 1 AS alo, length(a) + 1 AS ahi, 1 AS blo, length(b) + 1 AS bhi, 0 AS size FROM sim_pairs
    UNION ALL
    SELECT a, b, CASE side WHEN 1 THEN best.i + best.k ELSE alo END, CASE side WHEN 0 THEN best.i ELSE ahi END,
           CASE side WHEN 1 THEN best.j + best.k ELSE blo END, CASE side WHEN 0 THEN best.j ELSE bhi END, CASE side WHEN 0 THEN best.k ELSE 0 END
    FROM (
        SELECT w.a, w.b, alo, ahi, blo, bhi, min(struct_pack(less := -least(k, ahi - i, bhi - j), i := i, j := j, k := least(k, ahi - i, bhi - j))) AS best
        FROM work w JOIN places p ON p.a = w.a AND p.b = w.b AND i >= alo AND i < ahi AND j >= blo AND j < bhi
        WHERE alo < ahi AND blo < bhi GROUP BY w.a, w.b, alo, ahi, blo, bhi
    ), (VALUES (0), (1)) s(side)
),
sims AS (SELECT a, b, CASE WHEN length(a) + length(b) = 0 THEN 1.0 ELSE 2.0 * sum(size) / (length(a) + length(b)) END AS ratio FROM work GROUP BY a, b)"""

CATALOGUE = "catalogue AS (SELECT p_name AS name, min(p_partkey) AS place, count(*) AS cases, 'P' || CAST(min(p_partkey) AS VARCHAR) AS id FROM part GROUP BY p_name)"
LISTS = """
codes(place, alias, target) AS (VALUES (0, 'blue bolt', 'C1'), (1, 'hot', 'C2'), (2, 'cold gear', 'C3'), (3, 'Brand#9', 'C4')),
aliases(place, alias, target) AS (VALUES (0, 'tiny', 'A1'), (1, 'tiny ring', 'A2'), (2, 'promo', 'A3'), (3, 'bolt', 'A4')),
names(place, id, zh, en) AS (VALUES (0, 'N1', 'gizmo', 'large standard'), (1, 'N2', 'rod', 'medium'), (2, 'N3', 'gear', 'cold small')),
ruled AS (
    SELECT gap, 1 AS rule_no, -length(alias) AS o, place AS o2, 96 AS pct, target AS id, 'code' AS rule FROM texts JOIN codes ON contains(gap, alias) OR contains(low, alias)
    UNION ALL SELECT gap, 5, -length(alias), place, 95, target, 'alias' FROM texts JOIN aliases ON contains(low, alias)
    UNION ALL SELECT gap, 7, place, 0, 90, id, 'name' FROM texts JOIN names ON contains(gap, zh) OR contains(low, en)
    UNION ALL SELECT gap, 8, spot, 0, 85, target, 'alias_token' FROM words JOIN aliases ON lower(token) = alias
)"""
TEXTS = "texts AS (SELECT DISTINCT {} AS gap, lower({}) AS low FROM part),\nwords AS (SELECT gap, unnest(regexp_extract_all(gap, '[a-zA-Z]{{2,}}')) AS token, generate_subscripts(regexp_extract_all(gap, '[a-zA-Z]{{2,}}'), 1) AS spot FROM texts)"
FIRST = "chosen AS (SELECT * FROM ({}) QUALIFY row_number() OVER (PARTITION BY gap ORDER BY rule_no, o, o2) = 1)"

SQL = {
    "b14_gap_diseases": f"""
WITH RECURSIVE {CATALOGUE},
{TEXTS.format("p_name || ' ' || p_type || ' ' || p_brand", "p_name || ' ' || p_type || ' ' || p_brand")},
{LISTS.strip()},
keywords(place, alias, keyword) AS (VALUES (0, 'anvil', 'anvil'), (1, 'red widget', 'widget'), (2, 'small', 'small gear'), (3, 'plate', 'old'), (4, 'brand', 'nothing'), (5, 'economy', 'ring')),
asks AS (
    SELECT DISTINCT keyword AS wanted, keyword AS needle, 10 AS most FROM keywords UNION ALL SELECT DISTINCT keyword, keyword, 5 FROM keywords
    UNION ALL SELECT gap, substr(gap, 1, 20), 3 FROM texts
),
listed AS (SELECT a.*, c.* FROM asks a JOIN catalogue c ON contains(lower(id || ' ' || name || ' '), lower(needle)) QUALIFY row_number() OVER (PARTITION BY wanted, needle, most ORDER BY place) <= most),
sim_pairs AS (SELECT DISTINCT lower(wanted) AS a, lower(name) AS b FROM listed),
{SIMS.strip()},
best AS (
    SELECT l.* FROM listed l JOIN sims ON a = lower(wanted) AND b = lower(name)
    QUALIFY row_number() OVER (PARTITION BY wanted, needle, most ORDER BY ratio + least(cases, 1000) / 10000.0 DESC, place) = 1
),
{FIRST.format('''SELECT * FROM ruled
    UNION ALL SELECT gap, 2, -length(alias), k.place, 92, b.id, 'search' FROM texts JOIN keywords k ON contains(low, alias) JOIN best b ON b.needle = keyword AND most = 10
    UNION ALL SELECT gap, 3, spot, 0, 85, b.id, 'search_token' FROM words JOIN keywords k ON lower(token) = alias JOIN best b ON b.needle = keyword AND most = 5
    UNION ALL SELECT gap, 9, 0, 0, 35, b.id, 'broad' FROM texts JOIN best b ON b.wanted = gap AND most = 3''')}
SELECT p_partkey, p_name || ' ' || p_type || ' ' || p_brand AS gap_text, c.id AS disease_id, CAST(coalesce(pct, 0) AS BIGINT) AS confidence_pct, coalesce(rule, 'none') AS rule
FROM part LEFT JOIN chosen c ON c.gap = p_name || ' ' || p_type || ' ' || p_brand""",
    "b14_title_diseases": f"""
WITH RECURSIVE {TEXTS.format("p_name", "p_name")},
{LISTS.strip()},
known(place, known) AS (VALUES (0, 'old gizmos'), (1, 'mediums'), (2, 'small cold')),
each AS (SELECT place, id, zh AS name FROM names UNION SELECT place, id, en FROM names),
sim_pairs AS (SELECT DISTINCT lower(known) AS a, lower(name) AS b FROM known, each),
{SIMS.strip()},
fuzzy AS (SELECT e.id, ratio FROM known k, each e, sims WHERE a = lower(known) AND b = lower(name) AND ratio >= 0.55 ORDER BY ratio DESC, k.place, e.place LIMIT 1),
{FIRST.format('''SELECT gap, rule_no, o, o2, pct * 100 AS bp, id, rule FROM ruled
    UNION ALL SELECT gap, 6, 0, 0, CAST(round(ratio * 10000) AS BIGINT), id, 'fuzzy' FROM texts, fuzzy''')}
SELECT p_partkey, c.id AS disease_id, CAST(coalesce(bp, 0) AS BIGINT) AS confidence_bp, coalesce(rule, 'none') AS rule FROM part LEFT JOIN chosen c ON c.gap = p_name""",
    "f12_similar_names": f"""
WITH RECURSIVE x AS (SELECT DISTINCT p_name AS n FROM part), y AS (SELECT DISTINCT lower(p_type) || ' ' || substr(p_name, 1, 5) AS w FROM part),
sim_pairs AS (SELECT DISTINCT lower(n) AS a, lower(w) AS b FROM x, y),
{SIMS.strip()}
SELECT n AS a, w AS b, CAST(round(ratio * 10000) AS BIGINT) AS similarity_bp FROM x, y JOIN sims ON b = lower(w) WHERE a = lower(n) AND ratio >= 0.55""",
    "b12_mentions": f"""
WITH {CATALOGUE},
mentions AS (SELECT DISTINCT unnest([p_name || ' ' || p_brand, string_split(p_name, ' ')[-1], p_brand]) AS mention FROM part),
matches AS (SELECT p_partkey AS place, p_type AS code, p_name AS raw, CASE WHEN p_size % 2 = 0 THEN upper(p_brand) END AS normalized, p_size AS pct FROM part),
worded AS (SELECT unnest([lower(raw), lower(normalized)]) AS word, * FROM matches),
brief AS (SELECT * FROM worded WHERE word IS NOT NULL QUALIFY row_number() OVER (PARTITION BY word, code ORDER BY place) = 1),
hits AS (
    SELECT mention, code, 0 AS rank, place, raw, normalized, pct AS confidence_pct, 'text_disease_match' AS source FROM mentions JOIN brief ON contains(lower(mention), word) OR contains(word, lower(mention))
    UNION ALL
    SELECT * FROM (
        SELECT mention, id, 1, place, mention, name, NULL, 'disease_dict' FROM mentions JOIN catalogue ON contains(lower(id || ' ' || name || ' '), lower(mention))
        QUALIFY row_number() OVER (PARTITION BY mention ORDER BY place) <= 10
    )
)
SELECT mention, code, place, raw, normalized, CAST(confidence_pct AS BIGINT) AS confidence_pct, source FROM hits
QUALIFY row_number() OVER (PARTITION BY mention, code ORDER BY rank, place) = 1""",
}
