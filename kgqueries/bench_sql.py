"""Hand-written Spark SQL for some headline queries, as the yardstick of ``bench.py``."""

import re

from kgqueries.registry import X
from kgqueries.scans import GRAPH_SQL

# The SQL check of the graph view, in Spark's words.
_GRAPH = re.sub(r"\bFROM (region|nation|customer|supplier|part|orders|lineitem|events)\b", r"FROM t_\1", GRAPH_SQL.replace("AS VARCHAR", "AS STRING").replace(
    "strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')", "date_format(l_shipdate, 'yyyy-MM-dd HH:mm:ss')").replace("json_extract(props", "get_json_object(props"))

HAND_WRITTEN = {
    "flagship_top_customers": """
SELECT c_name AS name, count(*) AS n FROM t_orders JOIN t_customer ON o_custkey = c_custkey
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "g2_four_hops": """
SELECT r_name, count(*), CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM t_orders
JOIN t_customer ON o_custkey = c_custkey JOIN t_nation ON c_nationkey = n_nationkey
JOIN t_region ON n_regionkey = r_regionkey GROUP BY 1""",
    "g3_star_orders": f"""
SELECT concat('{X}order/', o_orderkey), o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE),
CAST(CAST(o_orderdate AS DATE) AS STRING), concat('{X}customer/', o_custkey) FROM t_orders""",
    "g3_star_lineitem": f"""
SELECT concat('{X}lineitem/', l_orderkey, '/', l_linenumber), CAST(q AS DOUBLE), CAST(e AS DOUBLE) FROM
(SELECT DISTINCT l_orderkey, l_linenumber, CAST(l_quantity AS DECIMAL(18,2)) AS q FROM t_lineitem)
JOIN (SELECT DISTINCT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(18,2)) AS e FROM t_lineitem)
USING (l_orderkey, l_linenumber)""",
    "g3_star_rows": """
SELECT l_returnflag, l_linestatus, count(*), CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE),
CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS DOUBLE)
FROM t_lineitem GROUP BY 1, 2""",
    "m13_set_semantics": f"""
SELECT concat('{X}lineitem/', l_orderkey, '/', l_linenumber), l_returnflag FROM
(SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM t_lineitem)""",
    "j1_optional": f"""
SELECT c_name, concat('{X}event/', event_id) FROM t_customer LEFT JOIN t_events ON user_id = c_custkey""",
    "j4_minus": f"""
SELECT concat('{X}customer/', c_custkey) FROM t_customer LEFT ANTI JOIN t_events ON user_id = c_custkey""",
    "j5_exists": f"""
SELECT concat('{X}customer/', c_custkey) FROM t_customer LEFT SEMI JOIN
(SELECT * FROM t_orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey""",
    "j6_not_exists": f"""
SELECT concat('{X}order/', o_orderkey) FROM t_orders LEFT ANTI JOIN t_lineitem ON l_orderkey = o_orderkey""",
    "j10_theta_filter": f"""
SELECT concat('{X}order/', o_orderkey), count(*) FROM t_orders JOIN t_lineitem ON l_orderkey = o_orderkey
WHERE CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE) GROUP BY 1""",
    "p1_sequence": f"""
SELECT concat('{X}order/', o_orderkey), concat('{X}region/', n_regionkey) FROM t_orders
JOIN t_customer ON o_custkey = c_custkey JOIN t_nation ON c_nationkey = n_nationkey""",
    "o3_top_k": "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS p FROM t_orders ORDER BY 2 DESC, 1 LIMIT 25",
    "j1_optional_filter": f"""
SELECT concat('{X}order/', o_orderkey), CASE WHEN l_orderkey IS NOT NULL THEN concat('{X}lineitem-row/', md5(concat_ws('|', l_orderkey,
l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate))) END
FROM t_orders LEFT JOIN t_lineitem ON l_orderkey = o_orderkey AND CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE)""",
    "p4_bounded": f"""
WITH e AS (SELECT p_partkey AS a, p_partkey DIV 2 AS b FROM t_part WHERE p_partkey > 0)
SELECT concat('{X}part/', a), concat('{X}part/', b) FROM e
UNION ALL SELECT concat('{X}part/', e1.a), concat('{X}part/', e2.b) FROM e e1 JOIN e e2 ON e1.b = e2.a
UNION ALL SELECT concat('{X}part/', e1.a), concat('{X}part/', e3.b) FROM e e1 JOIN e e2 ON e1.b = e2.a JOIN e e3 ON e2.b = e3.a""",
    # The same pattern: an event counts if it has a type, a value and a number in its properties.
    "a1_count": """
SELECT c_mktsegment, count(*), count(event_id) FROM t_customer LEFT JOIN (SELECT user_id, event_id FROM t_events WHERE event_type IS NOT NULL
AND value IS NOT NULL AND try_cast(get_json_object(props, '$.k') AS BIGINT) IS NOT NULL) ON user_id = c_custkey GROUP BY 1""",
    "a2_count_distinct_solutions": "SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM t_lineitem)",
    "q3_construct": f"""
SELECT DISTINCT * FROM (
SELECT concat('{X}customer/', c_custkey) AS s, 'iri', '{X}lastSeen', event_type, 'literal', 'string', NULL FROM t_customer JOIN t_events ON user_id = c_custkey
UNION ALL SELECT concat('{X}customer/', c_custkey), 'iri', '{X}segment', c_mktsegment, 'literal', 'string', NULL FROM t_customer
UNION ALL SELECT concat('{X}customer/', c_custkey), 'iri', '{X}did', concat('{X}event/', event_id), 'iri', NULL, NULL
FROM t_customer JOIN t_events ON user_id = c_custkey)""",
    "s6_sparql_json": f"""
SELECT to_json(named_struct('c', named_struct('type', 'uri', 'value', concat('{X}customer/', c_custkey)),
'name', named_struct('type', 'literal', 'value', c_name, 'datatype', 'string'),
'o', CASE WHEN o_orderkey IS NOT NULL THEN named_struct('type', 'uri', 'value', concat('{X}order/', o_orderkey)) END,
'total', CASE WHEN o_orderkey IS NOT NULL THEN named_struct('type', 'literal', 'value', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING),
'datatype', 'decimal') END)) FROM t_customer LEFT JOIN t_orders ON o_custkey = c_custkey""",
    "x41_md5": "SELECT concat('doc/', doc_id), md5(text) FROM t_documents WHERE text IS NOT NULL",
    "m15_graph_view": f"SELECT * FROM ({_GRAPH}) WHERE s IS NOT NULL AND o IS NOT NULL",
    "c6_instance": f"""
SELECT 'shop' AS unit_id, '{X}byUser', '{X}User', '{X}placedBy', '{X}Person', CAST(sum(e.n * o.n) AS BIGINT) FROM
(SELECT user_id AS c, count(*) AS n FROM t_events GROUP BY 1) e JOIN (SELECT o_custkey AS c, count(*) AS n FROM t_orders GROUP BY 1) o ON e.c = o.c""",
    "d2_fuzzy_search": f"""
WITH idx AS (SELECT concat('{X}part/', p_partkey) AS iri, p_name AS text FROM t_part WHERE p_size >= 10
UNION ALL SELECT concat('{X}part/', p_partkey), concat(p_type, ' ', p_name, ' by ', p_brand) FROM t_part WHERE p_size >= 10
UNION ALL SELECT concat('{X}part/', p_partkey), concat('{X}part/', p_partkey) FROM t_part WHERE p_size < 10
UNION ALL SELECT concat('{X}supplier/', s_suppkey), s_name FROM t_supplier),
q AS (SELECT DISTINCT query FROM (SELECT replace(p_name, 'i', 'y') AS query FROM t_part
UNION ALL SELECT concat(split_part(p_name, ' ', 2), ' ', split_part(p_name, ' ', 1)) FROM t_part)),
pairs AS (SELECT query, iri, text, array_distinct(filter(split(query, ' '), x -> x <> '')) AS a, array_distinct(filter(split(text, ' '), x -> x <> '')) AS b
FROM q CROSS JOIN idx),
scored AS (SELECT query, iri, max(round(100 * greatest(1.0D - levenshtein(query, text) / greatest(length(query), length(text)),
0.95D * size(array_intersect(a, b)) / least(size(a), size(b))), 4)) AS score FROM pairs GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, iri) AS rank FROM scored) WHERE rank <= 5""",
    "p5_one_or_more": f"""
WITH RECURSIVE c(a, b) AS (SELECT p_partkey, p_partkey DIV 2 FROM t_part WHERE p_partkey > 0
UNION ALL SELECT c.a, e.b FROM c JOIN (SELECT p_partkey AS a, p_partkey DIV 2 AS b FROM t_part WHERE p_partkey > 0) e ON c.b = e.a)
SELECT concat('{X}part/', a), concat('{X}part/', b) FROM c""",
}
