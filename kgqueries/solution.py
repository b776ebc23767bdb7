"""Filters, projection, aggregation, ordering, query forms and typing."""

import datetime as dt

from pyspark.sql import functions as F

from kgqueries.model import EX, order_graph, row
from kgqueries.registry import X, XSD as XS, query
from kgqueries.scans import GRAPH_SQL, web_graph
from kgspark import RDF, XSD, agg, desc, fn
from kgspark.operators.graphs import type_profile

PRICE = "CAST(o_totalprice AS DECIMAL(18,2))"


def orders(spark, sf, *props, **options):
    names = {"status": EX.orderStatus, "price": EX.totalPrice, "day": EX.orderDate, "priority": EX.orderPriority,
             "c": EX.placedBy, "key": EX.orderKey}
    return order_graph(spark, sf, **options).bgp([("?o", names[p], f"?{p}") for p in props])


@query("f1_filter", f"""
SELECT o_orderkey AS key, CAST({PRICE} AS DOUBLE) AS price FROM orders
WHERE {PRICE} > 250000 AND o_orderstatus <> 'F' AND CAST(o_orderdate AS DATE) >= DATE '1998-01-01'""")
def _(spark, sf):
    return orders(spark, sf, "key", "price", "status", "day").filter(
        lambda r: (r.price > 250000) & (r.status != "F") & (r.day >= dt.date(1998, 1, 1))).select("key", "price")


@query("f1_filter_error", f"SELECT o_orderkey AS key FROM orders WHERE o_orderkey <> 0 AND 100000 / o_orderkey > 20")
def _(spark, sf):
    """Division by zero is an error, and an error drops the solution."""
    return orders(spark, sf, "key").filter(lambda r: 100000 / r.key > 20).select("key")


@query("f2_bind", """
SELECT o_orderkey AS key, CASE WHEN o_custkey <> 0 THEN CAST(o_orderkey AS DOUBLE) / o_custkey END AS ratio FROM orders""")
def _(spark, sf):
    """An error leaves the variable unbound."""
    return (orders(spark, sf, "key", "c").bind("ck", lambda r: fn.cast(fn.strafter(fn.str(r.c), "customer/"), XSD.integer))
            .bind("ratio", lambda r: fn.cast(r.key, XSD.double) / r.ck).select("key", "ratio"))


@query("f3_select_expression", f"""
SELECT o_orderkey AS key, CAST({PRICE} * 2 AS DOUBLE) AS twice, upper(o_orderpriority) AS p FROM orders""")
def _(spark, sf):
    return orders(spark, sf, "key", "price", "priority").select("key", twice=lambda r: r.price * 2,
                                                                p=lambda r: fn.ucase(r.priority))


@query("f3_select_all", f"""
SELECT '{X}order/' || o_orderkey AS o, o_orderstatus AS status, '{X}customer/' || o_custkey AS c FROM orders""")
def _(spark, sf):
    return orders(spark, sf, "status", "c").select()


@query("f4_distinct", f"SELECT DISTINCT o_orderstatus AS status, '{X}customer/' || o_custkey AS c FROM orders")
def _(spark, sf):
    return orders(spark, sf, "status", "c").select("status", "c").distinct()


@query("f5_reduced", "SELECT DISTINCT o_orderstatus AS status, o_orderpriority AS priority FROM orders")
def _(spark, sf):
    return orders(spark, sf, "status", "priority").select("status", "priority").reduced()


def with_events(spark, sf):
    """Every customer, with its events where there are any."""
    kg = order_graph(spark, sf)
    events = kg.bgp([("?e", EX.byUser, "?c"), ("?e", EX.eventValue, "?v"), ("?e", EX.eventType, "?t"), ("?e", EX.propK, "?k")])
    return kg.bgp([("?c", EX.custKey, "?ck"), ("?c", EX.marketSegment, "?segment")]).optional(events)


CE = "customer LEFT JOIN events ON user_id = c_custkey"


@query("a1_count", f"SELECT c_mktsegment AS segment, count(*) AS rows, count(event_id) AS events FROM {CE} GROUP BY 1")
def _(spark, sf):
    return with_events(spark, sf).group_by("segment").agg(rows=agg.count(), events=agg.count("e"))


@query("a2_count_distinct", f"""
SELECT c_mktsegment AS segment, count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS types FROM {CE} GROUP BY 1""")
def _(spark, sf):
    b = with_events(spark, sf).bind("user", lambda r: fn.if_(fn.bound(r.e), fn.str(r.c), fn.strdt("", XSD.string)))
    b = b.bind("u", lambda r: fn.if_(fn.strlen(r.user) > 0, r.user, fn.str(r.e)))
    return b.group_by("segment").agg(users=agg.count_distinct("u"), types=agg.count_distinct("t"))


@query("a2_count_distinct_solutions", """
SELECT count(*) AS n FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)""")
def _(spark, sf):
    b = order_graph(spark, sf).bgp([("?l", row("ofPart"), "?p"), ("?l", row("lineSuppliedBy"), "?s")])
    return b.select("p", "s").agg(n=agg.count_distinct())


@query("a3_sum", """
SELECT '{X}customer/' || c_custkey AS c, coalesce(sum(CAST(json_extract(props, '$.k') AS BIGINT)), 0) AS total
FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1""".replace("{X}", X))
def _(spark, sf):
    """An empty group sums to 0."""
    return with_events(spark, sf).group_by("c").agg(total=agg.sum("k"))


@query("a4_avg", """
SELECT '{X}customer/' || c_custkey AS c,
       round(coalesce(CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS DOUBLE) / count(event_id), 0), 6) AS mean
FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1""".replace("{X}", X))
def _(spark, sf):
    out = with_events(spark, sf).group_by("c").agg(mean=agg.avg("k")).df
    return out.withColumn("mean", F.round(F.col("mean").cast("double"), 6))


@query("a5_min_max", f"""
SELECT '{X}customer/' || c_custkey AS c, min(value) AS low, max(value) AS high, min(event_type) AS first,
       max('{X}event/' || event_id) AS last FROM {CE} GROUP BY 1""")
def _(spark, sf):
    return with_events(spark, sf).group_by("c").agg(low=agg.min("v"), high=agg.max("v"), first=agg.min("t"), last=agg.max("e"))


@query("a6_group_concat", """
SELECT c_name AS name, string_agg(o_orderpriority, ', ' ORDER BY o_orderpriority) AS every,
       (SELECT string_agg(p, '|' ORDER BY p) FROM (SELECT DISTINCT o_orderpriority AS p FROM orders WHERE o_custkey = c_custkey)) AS kinds
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name, c_custkey""")
def _(spark, sf):
    b = order_graph(spark, sf).bgp([("?o", EX.placedBy, "?c"), ("?o", EX.orderPriority, "?p"), ("?c", EX.name, "?name")])
    return b.group_by("name").agg(every=agg.group_concat("p", ", "), kinds=agg.group_concat("p", "|", distinct=True))


@query("a7_sample", "SELECT DISTINCT c_name AS name, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark, sf):
    """Any value of the group; here a group has one."""
    b = order_graph(spark, sf).bgp([("?o", EX.placedBy, "?c"), ("?c", EX.name, "?name"), ("?c", EX.marketSegment, "?s")])
    return b.group_by("name").agg(segment=agg.sample("s"))


@query("a8_distinct_aggregates", """
SELECT o_orderpriority AS priority, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS s,
       round(CAST(sum(DISTINCT o_custkey) AS DOUBLE) / count(DISTINCT o_custkey), 6) AS m FROM orders GROUP BY 1""")
def _(spark, sf):
    b = orders(spark, sf, "priority", "c").bind("k", lambda r: fn.cast(fn.strafter(fn.str(r.c), "customer/"), XSD.integer))
    out = b.group_by("priority").agg(s=agg.sum("k", distinct=True), m=agg.avg("k", distinct=True)).df
    return out.withColumn("m", F.round(F.col("m").cast("double"), 6))


@query("a9_group_by_expression", """
SELECT year(o_orderdate) AS y, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1, 2""")
def _(spark, sf):
    return orders(spark, sf, "day", "status").group_by("status", y=lambda r: fn.year(r.day)).agg(n=agg.count())


@query("a9_unbound_group", f"SELECT event_type AS t, count(*) AS n FROM {CE} GROUP BY 1")
def _(spark, sf):
    """Unbound is a group of its own."""
    return with_events(spark, sf).group_by("t").agg(n=agg.count())


@query("a10_one_group", "SELECT count(*) AS n, CAST(0 AS DOUBLE) AS total, CAST(NULL AS VARCHAR) AS least FROM orders WHERE o_orderstatus = 'none'")
def _(spark, sf):
    return orders(spark, sf, "status", "price").filter(lambda r: r.status == "none").agg(
        n=agg.count(), total=agg.sum("price"), least=agg.min("status"))


@query("a11_having", f"""
SELECT '{X}customer/' || o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 10""")
def _(spark, sf):
    return orders(spark, sf, "c").group_by("c").agg(n=agg.count("o")).having(lambda r: r.n > 10)


@query("o1_order_by", "SELECT c_name AS name, c_mktsegment AS segment FROM customer ORDER BY 2 DESC, 1")
def _(spark, sf):
    kg = order_graph(spark, sf)
    return kg.bgp([("?c", EX.marketSegment, "?segment"), ("?c", EX.name, "?name")]).select("name", "segment").order_by(
        desc("segment"), "name")


@query("o1_unbound_lowest", f"""
SELECT '{X}customer/' || c_custkey AS c, n FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
ON user_id = c_custkey ORDER BY n NULLS FIRST, 1 LIMIT 20""")
def _(spark, sf):
    kg = order_graph(spark, sf)
    n = kg.match("?e", EX.byUser, "?c").group_by("c").agg(n=agg.count("e"))
    return kg.match("?c", EX.custKey, "?k").select("c").optional(n).order_by("n", "c").slice(limit=20)


@query("o2_slice", "SELECT DISTINCT o_orderpriority AS priority, o_orderstatus AS status FROM orders ORDER BY 1, 2 LIMIT 6 OFFSET 4")
def _(spark, sf):
    return orders(spark, sf, "priority", "status").select("priority", "status").distinct().order_by(
        "priority", "status").slice(limit=6, offset=4)


@query("o2_offset", "SELECT o_orderkey AS key, o_orderstatus AS status FROM orders ORDER BY 2, 1 OFFSET 700")
def _(spark, sf):
    """An offset alone: the rest is not moved to one task."""
    return orders(spark, sf, "key", "status").select("key", "status").order_by("status", "key").slice(offset=700)


@query("o2_deep_slice", f"SELECT o_orderkey AS key, CAST({PRICE} AS DOUBLE) AS price FROM orders ORDER BY 2, 1 LIMIT 10 OFFSET 12000")
def _(spark, sf):
    """Ten rows far inside: the rows before them are counted, and not moved to one task."""
    return orders(spark, sf, "key", "price").select("key", "price").order_by("price", "key").slice(limit=10, offset=12_000)


@query("o3_top_k", f"SELECT o_orderkey AS key, CAST({PRICE} AS DOUBLE) AS price FROM orders ORDER BY 2 DESC, 1 LIMIT 25")
def _(spark, sf):
    return orders(spark, sf, "key", "price").select("key", "price").order_by(desc("price"), "key").slice(limit=25)


@query("q1_select", f"SELECT '{X}part/' || p_partkey AS p, p_name AS name, p_size AS size FROM part WHERE p_size >= 40")
def _(spark, sf):
    kg = order_graph(spark, sf)
    return kg.bgp([("?p", RDF.type, EX.Part), ("?p", EX.name, "?name"), ("?p", EX["size"], "?size")]).filter(
        lambda r: r["size"] >= 40)


@query("q2_ask", "SELECT count(*) > 0 AS ask FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'")
def _(spark, sf):
    return orders(spark, sf, "status", "priority").filter(
        lambda r: (r.status == "P") & (r.priority == "1-URGENT")).ask()


@query("q2_ask_empty", "SELECT count(*) > 0 AS ask FROM orders WHERE o_orderstatus = 'X'")
def _(spark, sf):
    return order_graph(spark, sf).match("?o", EX.orderStatus, "X").ask()


@query("q3_construct", f"""
SELECT DISTINCT * FROM (
SELECT '{X}customer/' || c_custkey AS s, 'iri' AS s_kind, '{X}lastSeen' AS p, event_type AS o, 'literal' AS o_kind,
       '{XS}string' AS o_dt, CAST(NULL AS VARCHAR) AS o_lang FROM customer JOIN events ON user_id = c_custkey
UNION ALL SELECT '{X}customer/' || c_custkey, 'iri', '{X}segment', c_mktsegment, 'literal', '{XS}string', NULL FROM customer
UNION ALL SELECT '{X}customer/' || c_custkey, 'iri', '{X}did', '{X}event/' || event_id, 'iri', NULL, NULL
FROM customer JOIN events ON user_id = c_custkey)""")
def _(spark, sf):
    """Triples of a template; what is unbound gives none; literal subjects are left out."""
    return with_events(spark, sf).construct([
        ("?c", EX.lastSeen, "?t"), ("?c", EX.segment, "?segment"), ("?c", EX.did, "?e"), ("?segment", EX.of, "?c")])


@query("q3_construct_blank", f"""
SELECT count(*) AS triples, count(DISTINCT o_orderkey) AS nodes FROM (
SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders)""")
def _(spark, sf):
    """One fresh blank node per solution."""
    t = orders(spark, sf, "c", "price").construct([
        ("?o", EX.sale, "_:x"), ("_:x", EX.amount, "?price"), ("_:x", EX.buyer, "?c")])
    nodes = F.when(F.col("s_kind") == "bnode", F.col("s")).otherwise(F.when(F.col("o_kind") == "bnode", F.col("o")))
    return t.agg(F.count("*").alias("triples"), F.count_distinct(nodes).alias("nodes"))


@query("q4_describe", f"""
WITH o AS (SELECT '{X}order/' || o_orderkey AS iri FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT * FROM ({GRAPH_SQL}) WHERE s IN (SELECT iri FROM o) AND o IS NOT NULL""")
def _(spark, sf):
    """Every outgoing triple of many IRIs, also those that an inverse gives."""
    kg = order_graph(spark, sf)
    return kg.describe(kg.match("?o", EX.orderPriority, "1-URGENT").df.withColumnRenamed("o", "iri"))


@query("q4_describe_list", f"""
SELECT * FROM ({GRAPH_SQL}) WHERE s IN ('{X}customer/5', '{X}customer/9', '{X}nation/3') AND o IS NOT NULL""")
def _(spark, sf):
    return order_graph(spark, sf).describe([EX["customer/5"], EX["customer/9"], EX["nation/3"]])


@query("q5_provably_empty", f"SELECT '{X}customer/' || c_custkey AS x, c_mktsegment AS y FROM customer")
def _(spark, sf):
    """A customer is never an order: the first part of the union reads no table."""
    kg = order_graph(spark, sf)
    never = kg.bgp([("?x", EX.marketSegment, "?y"), ("?x", EX.placedBy, "?z")]).select("x", "y")
    return never.union(kg.match("?x", EX.marketSegment, "?y"))


VALUE_SQL = f"""
SELECT '{X}customer/' || c_custkey AS x, 'literal' AS kind, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS value,
       '{XS}decimal' AS dt, '' AS lang FROM customer
UNION ALL SELECT '{X}customer/' || c_custkey, 'literal', c_mktsegment, '{XS}string', '' FROM customer
UNION ALL SELECT '{X}customer/' || c_custkey, 'iri', '{X}nation/' || c_nationkey, '', '' FROM customer"""


def mixed(spark, sf, **options):
    kg = order_graph(spark, sf, **options)
    return (kg.bgp([("?x", RDF.type, EX.Customer), ("?x", EX.accountBalance, "?v")])
            .union(kg.match("?x", EX.marketSegment, "?v")).union(kg.match("?x", EX.customerInNation, "?v")))


@query("t2_mixed_variable", VALUE_SQL)
def _(spark, sf):
    return mixed(spark, sf).df.select("x", "v.kind", "v.value", "v.dt", "v.lang")


@query("t3_narrow_datatype", f"""
SELECT '{X}customer/' || c_custkey AS x, c_mktsegment AS v FROM customer""")
def _(spark, sf):
    """The filter rules out branches, so the variable has one type and the others are not read."""
    return mixed(spark, sf, strict=True).filter(lambda r: fn.datatype(r.v) == XSD.string)


@query("t3_narrow_iri", f"SELECT '{X}customer/' || c_custkey AS x, '{X}nation/' || c_nationkey AS v FROM customer")
def _(spark, sf):
    return mixed(spark, sf, strict=True).filter(lambda r: fn.is_iri(r.v))


@query("t4_type_profile", f"""
SELECT '{X}text' AS p, 'literal' AS o_kind, CAST(NULL AS VARCHAR) AS o_dt, count(*) AS n FROM documents
  WHERE text IS NOT NULL
UNION ALL SELECT '{X}pageId', 'literal', '{XS}integer', count(*) FROM (SELECT DISTINCT url, page_id FROM pages)
UNION ALL SELECT '{X}origin', 'literal', '{XS}string', count(*) FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL
UNION ALL SELECT '{X}site', 'iri', NULL, count(*) FROM documents WHERE source IS NOT NULL
UNION ALL SELECT '{X}collection', 'iri', NULL, count(*) FROM documents WHERE source IS NOT NULL
UNION ALL SELECT '{X}status', 'literal', '{XS}string', count(*) FROM documents WHERE source IS NOT NULL
UNION ALL SELECT '{X}chars', 'literal', '{XS}integer', count(*) FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL
UNION ALL SELECT '{X}quality', 'literal', '{XS}integer', count(*) FROM labels WHERE quality IS NOT NULL""")
def _(spark, sf):
    names = [EX[p] for p in ("text", "pageId", "origin", "site", "collection", "status", "chars", "quality")]
    return type_profile(web_graph(spark, sf).triples(predicates=names))


@query("t4_graph_profile", f"""
SELECT p, o_kind, o_dt, count(*) AS n FROM ({GRAPH_SQL}) WHERE s IS NOT NULL AND o IS NOT NULL GROUP BY ALL""")
def _(spark, sf):
    """What kinds of objects each predicate of the whole graph has."""
    return type_profile(order_graph(spark, sf).triples())


_LINE = [("lineNumber", "CAST(l_linenumber AS VARCHAR)", "integer"), ("partKey", "CAST(l_partkey AS VARCHAR)", "integer"),
         ("supplierKey", "CAST(l_suppkey AS VARCHAR)", "integer"), ("quantity", "CAST(l_quantity AS DECIMAL(18,2))", "decimal"),
         ("extendedPrice", "CAST(l_extendedprice AS DECIMAL(18,2))", "decimal"), ("discount", "CAST(l_discount AS DECIMAL(18,2))", "decimal"),
         ("tax", "CAST(l_tax AS DECIMAL(18,2))", "decimal"), ("returnFlag", "l_returnflag", "string"),
         ("lineStatus", "l_linestatus", "string"), ("shipDate", "CAST(l_shipdate AS DATE)", "date"),
         ("partOfOrder", "l_orderkey", None), ("ofPart", "l_partkey", None), ("lineSuppliedBy", "l_suppkey", None)]
_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


@query("t4_line_profile", " UNION ALL ".join(
    [f"SELECT '{X}{p}' AS p, '{'literal' if dt else 'iri'}' AS o_kind, {f'{chr(39)}{XS}{dt}{chr(39)}' if dt else 'CAST(NULL AS VARCHAR)'} AS o_dt, "
     f"count(*) AS n FROM (SELECT DISTINCT l_orderkey AS a, l_linenumber AS b, {e} AS c FROM lineitem)" for p, e, dt in _LINE]
    + [f"SELECT '{_TYPE}', 'iri', CAST(NULL AS VARCHAR), count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)"]))
def _(spark, sf):
    """Every triple of the line items, whose IRIs repeat, as a set."""
    return type_profile(order_graph(spark, sf).triples(classes=[EX.LineItem]))
