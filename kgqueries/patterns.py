"""Graph patterns, join algebra, paths and reasoning."""

from pyspark.sql import functions as F

from kgqueries.model import EX, BASE, integer, order_graph, row, tbox, tbox_rows
from kgqueries.registry import X, frame, query, tables
from kgqueries.scans import GRAPH_SQL
from kgspark import (IRI, KG, RDF, RDFS, Mapping, Ontology, RefObj, Source, TriplesMap, agg,
                     desc, fn, graph, path)
from kgspark.operators.closure import reach_counts

# ---- patterns ------------------------------------------------------------------------------


@query("g1_constant_object", f"SELECT '{X}order/' || o_orderkey AS o FROM orders WHERE o_orderstatus = 'F'")
def _(spark, sf):
    return order_graph(spark, sf).match("?o", EX.orderStatus, "F")


@query("g1_constant_subject", f"SELECT c_name AS name FROM customer WHERE c_custkey = 7")
def _(spark, sf):
    return order_graph(spark, sf).match(EX["customer/7"], EX.name, "?name")


@query("g1_constant_link", f"SELECT '{X}order/' || o_orderkey AS o FROM orders WHERE o_custkey = 7")
def _(spark, sf):
    return order_graph(spark, sf).match("?o", EX.placedBy, EX["customer/7"])


@query("g2_basic_pattern", """
SELECT c_name AS customer, n_name AS nation, r_name AS region FROM customer
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def _(spark, sf):
    return order_graph(spark, sf).bgp([
        ("?c", EX.name, "?customer"), ("?c", EX.customerInNation, "?n"), ("?n", EX.name, "?nation"),
        ("?n", EX.inRegion, "?r"), ("?r", EX.name, "?region")]).select("customer", "nation", "region")


@query("g2_four_hops", """
SELECT r_name AS region, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def _(spark, sf):
    return (order_graph(spark, sf).bgp([
        ("?o", EX.totalPrice, "?price"), ("?o", EX.placedBy, "?c"), ("?c", EX.customerInNation, "?n"),
        ("?n", EX.inRegion, "?r"), ("?r", EX.name, "?region")])
        .group_by("region").agg(orders=agg.count("o"), total=agg.sum("price")))


LOCAL = [("?l", row("partOfOrder"), "?o"), ("?o", EX.placedBy, "?c"), ("?c", EX.customerInNation, "?n"),
         ("?l", row("lineSuppliedBy"), "?s"), ("?s", EX.supplierInNation, "?n"), ("?n", EX.name, "?nation")]


@query("g2_cycle", """
SELECT n_name AS nation, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def _(spark, sf):
    """Patterns in a cycle: lines whose supplier and customer are of one nation."""
    return order_graph(spark, sf).bgp(LOCAL).group_by("nation").agg(lines=agg.count())


@query("g3_star_orders", f"""
SELECT '{X}order/' || o_orderkey AS o, o_orderstatus AS status, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS price,
       CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, '{X}customer/' || o_custkey AS c FROM orders""")
def _(spark, sf):
    return order_graph(spark, sf).bgp([
        ("?o", RDF.type, EX.Order), ("?o", EX.orderStatus, "?status"), ("?o", EX.totalPrice, "?price"),
        ("?o", EX.orderDate, "?day"), ("?o", EX.placedBy, "?c")])


LINE_STAR_SQL = """
WITH q AS (SELECT DISTINCT l_orderkey, l_linenumber, CAST(l_quantity AS DECIMAL(18,2)) AS quantity FROM lineitem),
     e AS (SELECT DISTINCT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(18,2)) AS price FROM lineitem)
"""


@query("g3_star_lineitem", LINE_STAR_SQL + f"""
SELECT '{X}lineitem/' || q.l_orderkey || '/' || q.l_linenumber AS l, CAST(quantity AS DOUBLE) AS quantity,
       CAST(price AS DOUBLE) AS price
FROM q JOIN e ON q.l_orderkey = e.l_orderkey AND q.l_linenumber = e.l_linenumber""")
def _(spark, sf):
    """No declared key: each property is a set of its own and the two are joined."""
    return order_graph(spark, sf).bgp([("?l", EX.quantity, "?quantity"), ("?l", EX.extendedPrice, "?price")])


@query("g3_star_rows", """
SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS lines,
       CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS DOUBLE) AS revenue
FROM lineitem GROUP BY 1, 2""")
def _(spark, sf):
    """Row-faithful line items: one scan, sums equal to the table's."""
    b = order_graph(spark, sf).bgp([
        ("?l", row("returnFlag"), "?flag"), ("?l", row("lineStatus"), "?status"), ("?l", row("quantity"), "?q"),
        ("?l", row("extendedPrice"), "?e"), ("?l", row("discount"), "?d")])
    return b.group_by("flag", "status").agg(lines=agg.count("l"), quantity=agg.sum("q"),
                                            revenue=agg.sum(lambda r: r.e * (1 - r.d)))


@query("g4_type_pattern", f"SELECT '{X}customer/' || c_custkey AS c FROM customer")
def _(spark, sf):
    return order_graph(spark, sf).match("?c", RDF.type, EX.Customer)


@query("g4_any_type", f"""
SELECT cls, count(*) AS n FROM (
SELECT '{X}Order' AS cls FROM orders UNION ALL SELECT '{X}Customer' FROM customer UNION ALL SELECT '{X}Supplier' FROM supplier
UNION ALL SELECT '{X}Part' FROM part UNION ALL SELECT '{X}Nation' FROM nation UNION ALL SELECT '{X}Region' FROM region
UNION ALL SELECT '{X}LineItem' FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
UNION ALL SELECT '{X}PartSupp' FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
UNION ALL SELECT '{X}LineItemRow' FROM lineitem UNION ALL SELECT '{X}Event' FROM events) GROUP BY 1""")
def _(spark, sf):
    kg = order_graph(spark, sf, ontology=None)
    return kg.match("?x", RDF.type, "?cls").group_by("cls").agg(n=agg.count("x"))


@query("g5_variable_predicate", f"""
SELECT '{X}customer/' || c_custkey AS s, '{X}name' AS p, c_name AS o FROM customer
UNION ALL SELECT '{X}customer/' || c_custkey, '{X}marketSegment', c_mktsegment FROM customer""")
def _(spark, sf):
    kg = order_graph(spark, sf)
    return kg.match("?s", "?p", "?o", predicates=[EX.name, EX.marketSegment]).join(
        kg.match("?s", RDF.type, EX.Customer))


def self_link_graph(spark, sf):
    """Orders linked to the customer whose key equals the order's rest: some link to themselves."""
    return KG(spark, Mapping([
        TriplesMap("#Node", Source.sql("SELECT o_orderkey AS k, o_custkey AS t FROM orders", ["orders"]),
                   BASE + "node/{k}", [EX.Node], {EX.linksTo: RefObj("#Target", [])}, ["k"]),
        TriplesMap("#Target", Source.sql("SELECT o_orderkey AS k, o_custkey AS t FROM orders", ["orders"]),
                   BASE + "node/{t}", [])]), tables=tables(spark, sf))


@query("g6_repeated_variable", f"SELECT '{X}node/' || o_orderkey AS x FROM orders WHERE o_orderkey = o_custkey")
def _(spark, sf):
    return self_link_graph(spark, sf).match("?x", EX.linksTo, "?x")


@query("g7_named_graph", """
SELECT md5(text) AS digest, lang FROM documents WHERE text IS NOT NULL AND lang = 'fr'""")
def _(spark, sf):
    from kgqueries.scans import WEB, web_graph
    quads = web_graph(spark, sf).triples(predicates=[EX.text], quads=True)
    b = graph(quads, WEB + "graph/fr").bgp([("?d", EX.text, "?t")])
    return b.select(digest=lambda r: fn.md5(fn.str(r.t)), lang=lambda r: fn.lang(r.t))


@query("g8_disconnected", """
SELECT r_name AS region, s_name AS supplier FROM region, supplier""")
def _(spark, sf):
    """Two patterns without a shared variable, spread over all tasks by slot."""
    kg = order_graph(spark, sf)
    regions = kg.bgp([("?r", RDF.type, EX.Region), ("?r", EX.name, "?region")]).select("region")
    suppliers = kg.bgp([("?s", RDF.type, EX.Supplier), ("?s", EX.name, "?supplier")]).select("supplier")
    return regions.join(suppliers)


# ---- joins ---------------------------------------------------------------------------------

@query("j1_optional", f"""
SELECT c_name AS name, '{X}event/' || event_id AS e FROM customer LEFT JOIN events ON user_id = c_custkey""")
def _(spark, sf):
    kg = order_graph(spark, sf)
    return (kg.bgp([("?c", EX.custKey, "?k"), ("?c", EX.name, "?name")])
            .optional(kg.match("?e", EX.byUser, "?c")).select("name", "e"))


@query("j1_optional_filter", f"""
SELECT '{X}order/' || o_orderkey AS o, CASE WHEN l_orderkey IS NOT NULL THEN '{X}lineitem-row/' || md5(concat_ws('|',
  l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
  l_linestatus, l_shipdate)) END AS l
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE)""")
def _(spark, sf):
    """The OPTIONAL's own filter uses an outer variable."""
    kg = order_graph(spark, sf)
    return (kg.match("?o", EX.orderDate, "?day")
            .optional(kg.bgp([("?l", row("partOfOrder"), "?o"), ("?l", row("shipDate"), "?ship")]),
                      where=lambda r: r.ship < r.day).select("o", "l"))


@query("j1_optional_siblings", f"""
SELECT '{X}customer/' || c_custkey AS c, c_name AS name, e.n AS events, o.n AS orders FROM customer
LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) e ON e.user_id = c_custkey
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey""")
def _(spark, sf):
    kg = order_graph(spark, sf)
    events = kg.match("?e", EX.byUser, "?c").group_by("c").agg(events=agg.count("e"))
    orders = kg.match("?o", EX.placedBy, "?c").group_by("c").agg(orders=agg.count("o"))
    return (kg.bgp([("?c", EX.custKey, "?k"), ("?c", EX.name, "?name")]).optional(events).optional(orders)
            .select("c", "name", "events", "orders"))


@query("j2_nested_optional", f"""
SELECT c_name AS name, '{X}order/' || o.o_orderkey AS o, i.n AS lines FROM customer
LEFT JOIN orders o ON o.o_custkey = c_custkey
LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) i ON i.l_orderkey = o.o_orderkey""")
def _(spark, sf):
    kg = order_graph(spark, sf)
    lines = kg.match("?l", row("partOfOrder"), "?o").group_by("o").agg(lines=agg.count("l"))
    return (kg.bgp([("?c", EX.custKey, "?k"), ("?c", EX.name, "?name")])
            .optional(kg.match("?o", EX.placedBy, "?c").optional(lines)).select("name", "o", "lines"))


@query("j3_unbound_join", f"""
WITH a AS (SELECT c_custkey, s FROM customer LEFT JOIN
             (SELECT DISTINCT o_custkey, o_orderstatus AS s FROM orders WHERE o_orderstatus = 'P'
              AND o_orderpriority = '5-LOW') ON o_custkey = c_custkey),
     b AS (SELECT o_custkey, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT '{X}customer/' || c_custkey AS c, b.s AS status, n FROM a JOIN b ON c_custkey = o_custkey AND (a.s = b.s OR a.s IS NULL)""")
def _(spark, sf):
    """A shared variable that may be unbound fits any value: the two cases are joined apart."""
    kg = order_graph(spark, sf)
    pending = kg.bgp([("?o", EX.placedBy, "?c"), ("?o", EX.orderStatus, "?status"), ("?o", EX.orderPriority, "5-LOW")])
    pending = pending.filter(lambda r: r.status == "P").select("c", "status").distinct()
    counts = (kg.bgp([("?o", EX.placedBy, "?c"), ("?o", EX.orderStatus, "?status")])
              .group_by("c", "status").agg(n=agg.count("o")))
    return kg.match("?c", EX.custKey, "?k").select("c").optional(pending).join(counts)


TWO_UNBOUND = """
WITH a AS (SELECT c_custkey AS k, CASE WHEN CAST(c_acctbal AS DECIMAL(18,2)) > 0 THEN CAST(c_acctbal AS DECIMAL(18,2)) END AS x,
           CASE WHEN c_nationkey < 10 THEN c_nationkey END AS y FROM customer),
b AS (SELECT s_suppkey AS sk, CASE WHEN CAST(s_acctbal AS DECIMAL(18,2)) > 5000 THEN CAST(s_acctbal AS DECIMAL(18,2)) END AS x,
      CASE WHEN s_nationkey > 4 THEN s_nationkey END AS y FROM supplier),
pairs AS (SELECT k, sk, a.x IS NOT NULL OR b.x IS NOT NULL AS has_x, coalesce(a.y, b.y) AS y FROM a JOIN b
          ON (a.x IS NULL OR b.x IS NULL OR a.x = b.x) AND (a.y IS NULL OR b.y IS NULL OR a.y = b.y))
"""


def two_unbound(spark, sf):
    """Customers and suppliers, each with a balance and a nation that may be unbound."""
    kg = order_graph(spark, sf)

    def side(key, name, low, nation):
        out = kg.match("?s", key, f"?{name}").optional(kg.match("?s", EX.accountBalance, "?x").filter(lambda r: r.x > low))
        return out.optional(kg.match("?s", EX.nationKey, "?y").filter(nation)).select(name, "x", "y")

    return (side(EX.custKey, "k", 0, lambda r: r.y < 10),
            kg.match("?s", RDF.type, EX.Supplier).join(kg.match("?s", EX.supplierKey, "?sk")).optional(
                kg.match("?s", EX.accountBalance, "?x").filter(lambda r: r.x > 5000)).optional(
                kg.match("?s", EX.nationKey, "?y").filter(lambda r: r.y > 4)).select("sk", "x", "y"))


@query("j3_two_unbound", TWO_UNBOUND + "SELECT k, count(*) AS n, count(DISTINCT y) AS nations, count(*) FILTER (has_x) AS balances FROM pairs GROUP BY k")
def _(spark, sf):
    """Two shared variables, both of which may be unbound on either side; pairs are counted by what they show."""
    a, b = two_unbound(spark, sf)
    has = lambda r: fn.if_(fn.bound(r.x), 1, 0)
    out = a.bind("xa", has).join_counted(b.bind("xb", has), "w", keep=["y", "xb"])
    out = out.bind("b", lambda r: fn.if_((r.xa == 1) | (r.xb == 1), r.w, 0))
    return out.group_by("k").agg(n=agg.sum("w"), nations=agg.count_distinct("y"), balances=agg.sum("b"))


@query("j3_two_unbound_optional", TWO_UNBOUND + """
SELECT a.k, count(p.sk) AS n FROM a LEFT JOIN pairs p ON p.k = a.k AND p.sk < a.k GROUP BY a.k""")
def _(spark, sf):
    """The partners of an OPTIONAL with a condition, counted."""
    a, b = two_unbound(spark, sf)
    partners = a.join_counted(b, "w", below=("sk", "k")).group_by("k").agg(partners=agg.sum("w"))
    return a.select("k").distinct().optional(partners).select("k", n=lambda r: fn.coalesce(r.partners, 0))


@query("j4_minus", f"""
SELECT '{X}customer/' || c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)""")
def _(spark, sf):
    kg = order_graph(spark, sf)
    return kg.match("?c", EX.custKey, "?k").select("c").minus(kg.match("?e", EX.byUser, "?c"))


@query("j4_minus_nothing_shared", f"SELECT '{X}customer/' || c_custkey AS c FROM customer")
def _(spark, sf):
    kg = order_graph(spark, sf)
    return kg.match("?c", EX.custKey, "?k").select("c").minus(kg.match("?x", EX.orderStatus, "?y"))


@query("j5_exists", f"""
SELECT '{X}customer/' || c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey
AND o_orderstatus = 'P')""")
def _(spark, sf):
    kg = order_graph(spark, sf)
    return kg.match("?c", EX.custKey, "?k").select("c").exists(
        kg.bgp([("?o", EX.placedBy, "?c"), ("?o", EX.orderStatus, "P")]))


@query("j6_not_exists", f"""
SELECT '{X}order/' || o_orderkey AS o FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def _(spark, sf):
    kg = order_graph(spark, sf)
    return kg.match("?o", EX.orderKey, "?k").select("o").not_exists(kg.match("?l", EX.partOfOrder, "?o"))


@query("j6_not_exists_nothing_shared", f"SELECT '{X}customer/' || c_custkey AS c FROM customer WHERE FALSE")
def _(spark, sf):
    kg = order_graph(spark, sf)
    return kg.match("?c", EX.custKey, "?k").select("c").not_exists(kg.match("?x", EX.orderStatus, "?y"))


@query("j7_correlated_exists", f"""
SELECT '{X}order/' || o_orderkey AS o FROM orders WHERE EXISTS (SELECT 1 FROM lineitem
WHERE l_orderkey = o_orderkey AND CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE))""")
def _(spark, sf):
    kg = order_graph(spark, sf)
    return kg.match("?o", EX.orderDate, "?day").exists(
        kg.bgp([("?l", row("partOfOrder"), "?o"), ("?l", row("shipDate"), "?ship")]),
        where=lambda r: r.ship < r.day).select("o")


@query("j8_subselect", """
WITH t AS (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent FROM orders GROUP BY 1)
SELECT c_name AS name, spent FROM customer JOIN t ON o_custkey = c_custkey""")
def _(spark, sf):
    kg = order_graph(spark, sf)
    spent = (kg.bgp([("?o", EX.placedBy, "?c"), ("?o", EX.totalPrice, "?price")])
             .group_by("c").agg(spent=agg.sum("price")))
    return kg.bgp([("?c", EX.custKey, "?k"), ("?c", EX.name, "?name")]).join(spent).select("name", "spent")


@query("j9_values", f"""
SELECT '{X}order/' || o_orderkey AS o, o_orderstatus AS status, o_orderpriority AS priority FROM orders
WHERE (o_orderstatus = 'F' AND o_orderpriority = '5-LOW') OR o_orderstatus = 'P'""")
def _(spark, sf):
    """One row of the inline data leaves the priority open."""
    kg = order_graph(spark, sf)
    return kg.bgp([("?o", EX.orderStatus, "?status"), ("?o", EX.orderPriority, "?priority")]).values(
        ["status", "priority"], [("F", "5-LOW"), ("P", None)])


@query("j9_values_iris", f"""
SELECT '{X}customer/' || o_custkey AS c, '{X}order/' || o_orderkey AS o FROM orders WHERE o_custkey IN (3, 7, 11)""")
def _(spark, sf):
    kg = order_graph(spark, sf)
    return kg.match("?o", EX.placedBy, "?c").values("c", [EX["customer/3"], EX["customer/7"], EX["customer/11"], EX["order/1"]])


@query("j10_theta_filter", f"""
SELECT '{X}order/' || o_orderkey AS o, count(*) AS late FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE) GROUP BY 1""")
def _(spark, sf):
    return (order_graph(spark, sf).bgp([
        ("?l", row("partOfOrder"), "?o"), ("?l", row("shipDate"), "?ship"), ("?o", EX.orderDate, "?day")])
        .filter(lambda r: r.ship < r.day).group_by("o").agg(late=agg.count("l")))


@query("j10_string_order", f"""
SELECT '{X}customer/' || c_custkey AS c, r_name AS region FROM customer, region WHERE r_name < c_mktsegment""")
def _(spark, sf):
    """Patterns without a shared variable, ordered by their texts: a join of ranges."""
    kg = order_graph(spark, sf)
    customers = kg.bgp([("?c", EX.marketSegment, "?segment")])
    regions = kg.bgp([("?r", RDF.type, EX.Region), ("?r", EX.name, "?region")])
    return customers.join(regions).filter(lambda r: fn.str(r.region) < fn.str(r.segment)).select("c", "region")


@query("j10_band", f"""
SELECT '{X}part/' || p_partkey AS p, '{X}supplier/' || s_suppkey AS s FROM part, supplier
WHERE CAST(p_retailprice AS DECIMAL(18,2)) >= CAST(s_acctbal AS DECIMAL(18,2))
  AND CAST(p_retailprice AS DECIMAL(18,2)) <= CAST(s_acctbal AS DECIMAL(18,2)) + 5""")
def _(spark, sf):
    """Parts whose price lies in a band above a supplier's balance."""
    kg = order_graph(spark, sf)
    parts = kg.bgp([("?p", EX.retailPrice, "?price")])
    suppliers = kg.bgp([("?s", RDF.type, EX.Supplier), ("?s", EX.accountBalance, "?balance")])
    return (parts.join(suppliers).filter(lambda r: (r.price >= r.balance) & (r.price <= r.balance + 5)).select("p", "s"))


@query("j11_union", f"""
SELECT '{X}customer/' || c_custkey AS x, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance FROM customer
UNION ALL SELECT '{X}supplier/' || s_suppkey, NULL, CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS DOUBLE) FROM supplier""")
def _(spark, sf):
    kg = order_graph(spark, sf)
    suppliers = kg.bgp([("?x", RDF.type, EX.Supplier), ("?x", EX.accountBalance, "?balance")])
    return kg.match("?x", EX.marketSegment, "?segment").union(suppliers)


# ---- paths ---------------------------------------------------------------------------------

@query("p1_sequence", f"""
SELECT '{X}order/' || o_orderkey AS o, '{X}region/' || n_regionkey AS r FROM orders
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def _(spark, sf):
    return order_graph(spark, sf).match("?o", path.seq(EX.placedBy, EX.customerInNation, EX.inRegion), "?r")


@query("p2_alternative", f"""
SELECT '{X}customer/' || c_custkey AS x, '{X}nation/' || c_nationkey AS n FROM customer
UNION ALL SELECT '{X}supplier/' || s_suppkey, '{X}nation/' || s_nationkey FROM supplier""")
def _(spark, sf):
    return order_graph(spark, sf).match("?x", path.alt(EX.customerInNation, EX.supplierInNation), "?n")


@query("p3_inverse", f"SELECT '{X}customer/' || o_custkey AS c, '{X}order/' || o_orderkey AS o FROM orders")
def _(spark, sf):
    return order_graph(spark, sf).match("?c", path.inv(EX.placedBy), "?o")


def tree_graph(spark, sf, **options):
    """Parts as a tree: part k is under part k DIV 2."""
    return KG(spark, Mapping([
        TriplesMap("#Tree", Source.sql("SELECT p_partkey, p_partkey DIV 2 AS up FROM part WHERE p_partkey > 0", ["part"]),
                   BASE + "part/{p_partkey}", [EX.Part], {EX.partOf: RefObj("#Up", []), EX.key: integer("p_partkey")},
                   ["p_partkey"]),
        TriplesMap("#Up", Source.sql("SELECT p_partkey DIV 2 AS up FROM part WHERE p_partkey > 0", ["part"]),
                   BASE + "part/{up}", [])]), tables=tables(spark, sf), **options)


TREE_SQL = "e AS (SELECT p_partkey AS a, p_partkey // 2 AS b FROM part WHERE p_partkey > 0)"
CLOSURE_SQL = f"""WITH RECURSIVE {TREE_SQL}, c(a, b) AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a)"""


@query("p4_bounded", f"""
WITH {TREE_SQL}
SELECT '{X}part/' || a AS x, '{X}part/' || b AS y FROM e
UNION ALL SELECT '{X}part/' || e1.a, '{X}part/' || e2.b FROM e e1 JOIN e e2 ON e1.b = e2.a
UNION ALL SELECT '{X}part/' || e1.a, '{X}part/' || e3.b FROM e e1 JOIN e e2 ON e1.b = e2.a JOIN e e3 ON e2.b = e3.a""")
def _(spark, sf):
    return tree_graph(spark, sf).match("?x", path.repeat(EX.partOf, 1, 3), "?y")


@query("p5_one_or_more", CLOSURE_SQL + f"SELECT '{X}part/' || a AS x, '{X}part/' || b AS y FROM c")
def _(spark, sf):
    return tree_graph(spark, sf).match("?x", path.plus(EX.partOf), "?y")


@query("p5_zero_or_more", CLOSURE_SQL + f"""
SELECT '{X}part/' || a AS x, '{X}part/' || b AS y FROM (SELECT a, b FROM c UNION SELECT a, a FROM e UNION SELECT b, b FROM e)""")
def _(spark, sf):
    return tree_graph(spark, sf).match("?x", path.star(EX.partOf), "?y")


@query("p5_from_constant", CLOSURE_SQL + f"SELECT '{X}part/' || a AS x FROM c WHERE b = 3")
def _(spark, sf):
    """A bound end: only its own ancestry is walked."""
    return tree_graph(spark, sf).match("?x", path.plus(EX.partOf), EX["part/3"])


RING = ("SELECT p_partkey AS a, coalesce(lead(p_partkey) OVER w, min(p_partkey) OVER (PARTITION BY {ring})) AS b FROM part "
        "WINDOW w AS (PARTITION BY {ring} ORDER BY p_partkey) UNION ALL SELECT p_partkey, {half} FROM part WHERE p_partkey % 20 = 7")
RING_SQL = f"""WITH RECURSIVE e AS ({RING.format(ring="p_partkey // 20", half="p_partkey // 2")}),
c(a, b) AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) """


def ring_source():
    return RING.format(ring="p_partkey DIV 20", half="p_partkey DIV 2")


def ring_graph(spark, sf):
    """Twenty parts each follow each other round, and one of them leads on to part k DIV 2."""
    return KG(spark, Mapping([
        TriplesMap("#Ring", Source.sql(ring_source(), ["part"]), BASE + "part/{a}", [], {EX.next: RefObj("#Next", [])}),
        TriplesMap("#Next", Source.sql(ring_source(), ["part"]), BASE + "part/{b}", [])]), tables=tables(spark, sf))


@query("p5_cycles", RING_SQL + f"SELECT '{X}part/' || a AS x, '{X}part/' || b AS y FROM c")
def _(spark, sf):
    """All pairs of a graph of cycles: each cycle is one node until the end."""
    return ring_graph(spark, sf).match("?x", path.plus(EX.next), "?y")


@query("p5_reach_counts", RING_SQL + "SELECT a AS node, count(*) AS reached FROM c GROUP BY a")
def _(spark, sf):
    """How many parts each part leads to, without their pairs."""
    frame(spark, sf, "part").createOrReplaceTempView("part")
    edges = spark.sql(ring_source()).toDF("src", "dst")
    return reach_counts(edges)


@query("p5_both_ends", RING_SQL + "SELECT count(*) > 0 AS ask FROM c WHERE a = 190 AND b = 3")
def _(spark, sf):
    """Both ends bound: two walks towards each other."""
    return ring_graph(spark, sf).match(EX["part/190"], path.plus(EX.next), EX["part/3"]).ask()


def part_tbox(spark, sf):
    """A class tree out of the parts: each part class is below part class k DIV 2."""
    p = frame(spark, sf, "part").where("p_partkey > 0")
    iri = lambda c: F.concat(F.lit(BASE + "part/"), c.cast("string"))
    none = F.lit(None).cast("string")
    sub = p.select(iri(F.col("p_partkey")).alias("s"), F.lit("iri").alias("s_kind"),
                   F.lit(str(RDFS.subClassOf)).alias("p"), iri(F.expr("p_partkey DIV 2")).alias("o"),
                   F.lit("iri").alias("o_kind"), none.alias("o_dt"), none.alias("o_lang"))
    return sub


@query("p6_subclass_closure", CLOSURE_SQL + f"""
SELECT '{X}part/' || a AS src, '{X}part/' || b AS dst FROM (SELECT a, b FROM c UNION SELECT a, a FROM e UNION SELECT b, b FROM e)""")
def _(spark, sf):
    from kgspark.operators.check import subclass_closure
    return subclass_closure(part_tbox(spark, sf))


@query("p7_zero_or_one", f"""
WITH {TREE_SQL}
SELECT DISTINCT '{X}part/' || a AS x, '{X}part/' || b AS y
FROM (SELECT a, b FROM e UNION SELECT a, a FROM e UNION SELECT b, b FROM e)""")
def _(spark, sf):
    return tree_graph(spark, sf).match("?x", path.opt(EX.partOf), "?y")


@query("p7_negated_set", f"""
SELECT '{X}nation/' || n_nationkey AS x, '{X}region/' || n_regionkey AS y FROM nation
UNION ALL SELECT '{X}region/' || n_regionkey, '{X}nation/' || n_nationkey FROM nation
UNION ALL SELECT '{X}customer/' || c_custkey, '{X}nation/' || c_nationkey FROM customer
UNION ALL SELECT '{X}nation/' || c_nationkey, '{X}customer/' || c_custkey FROM customer""")
def _(spark, sf):
    """Every property of the geographic part but literals, types and the supplier links."""
    kg = order_graph(spark, sf)
    wanted = {str(EX[p]) for p in ("inRegion", "hasNation", "customerInNation", "hasCustomer")}
    return kg.match("?x", path.neg(*[IRI(p) for p in kg.predicates() if p not in wanted]), "?y")


# ---- reasoning -----------------------------------------------------------------------------

@query("r1_top_classes", f"""
WITH {TREE_SQL}, cls AS (SELECT '{X}part/' || a AS c FROM e UNION SELECT '{X}part/' || b FROM e),
tops AS (SELECT 'http://www.w3.org/2000/01/rdf-schema#Resource' AS t UNION ALL SELECT 'http://www.w3.org/2002/07/owl#Thing')
SELECT s, o FROM (SELECT '{X}part/' || a AS s, '{X}part/' || b AS o FROM e
UNION SELECT c, t FROM cls, tops UNION SELECT a.t, b.t FROM tops a, tops b WHERE a.t <> b.t)""")
def _(spark, sf):
    from kgspark.operators.check import add_top_classes
    return add_top_classes(part_tbox(spark, sf)).select("s", "o")


@query("r2_inverse", "SELECT c_name AS name, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def _(spark, sf):
    return (order_graph(spark, sf).bgp([("?c", EX.name, "?name"), ("?c", EX.placesOrder, "?o")])
            .group_by("name").agg(orders=agg.count("o")))


PARTY = Ontology([(EX.Customer, RDFS.subClassOf, EX.Party), (EX.Supplier, RDFS.subClassOf, EX.Party),
                  (EX.customerInNation, RDFS.subPropertyOf, EX.locatedIn),
                  (EX.supplierInNation, RDFS.subPropertyOf, EX.locatedIn),
                  (EX.byUser, RDFS.domain, EX.Activity), (EX.byUser, RDFS.range, EX.User)])


@query("r3_subclass", f"""
SELECT '{X}customer/' || c_custkey AS x, '{X}nation/' || c_nationkey AS n FROM customer
UNION ALL SELECT '{X}supplier/' || s_suppkey, '{X}nation/' || s_nationkey FROM supplier""")
def _(spark, sf):
    """Classes and properties that are only the ontology's."""
    kg = order_graph(spark, sf, ontology=PARTY)
    return kg.bgp([("?x", RDF.type, EX.Party), ("?x", EX.locatedIn, "?n")])


@query("r4_domain_range", f"""
SELECT '{X}event/' || event_id AS x, 'activity' AS role FROM events WHERE user_id IS NOT NULL
UNION ALL SELECT DISTINCT '{X}customer/' || user_id, 'user' FROM events WHERE user_id IS NOT NULL""")
def _(spark, sf):
    kg = order_graph(spark, sf, ontology=PARTY)
    return (kg.match("?x", RDF.type, EX.Activity).bind("role", lambda r: "activity")
            .union(kg.match("?x", RDF.type, EX.User).bind("role", lambda r: "user")))


def _quote(v):
    return "CAST(NULL AS VARCHAR)" if v is None else "'" + v.replace("'", "''") + "'"


@query("r5_tbox_facts", f"""
SELECT s, p, o, o_kind FROM ({GRAPH_SQL}) WHERE s IS NOT NULL AND o IS NOT NULL
UNION ALL SELECT * FROM (VALUES {", ".join("(" + ", ".join(_quote(r[i]) for i in (0, 2, 3, 4)) + ")" for r in tbox_rows())}) t""")
def _(spark, sf):
    """The ontology's own statements beside the data's."""
    return order_graph(spark, sf, ontology=tbox(spark)).triples(include_tbox=True).select("s", "p", "o", "o_kind")


@query("flagship_top_customers", """
SELECT c_name AS name, count(*) AS "numOrders" FROM orders JOIN customer ON o_custkey = c_custkey
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def _(spark, sf):
    """Customer names by number of orders; the orders are reached by an unmapped inverse."""
    return (order_graph(spark, sf).bgp([("?c", EX.name, "?name"), ("?c", EX.placesOrder, "?o")])
            .group_by("name").agg(numOrders=agg.count("o"))
            .order_by(desc("numOrders"), "name").slice(limit=10))
