"""Graphs as data: mappings in RDF, merging, renaming, deleting, bootstrap and validation."""

from pyspark.sql import functions as F

from kgqueries.model import EX, order_graph
from kgqueries.registry import X, frame, query
from kgspark import KG, RDF, RR, XSD
from kgspark.operators import catalog, graphs
from kgspark.operators import metadata as md
from kgspark.plans.mapping import Tables
from kgspark.sources import prefixes as px
from kgspark.sources.ntriples import parse_ntriples

R = str(RR)


def mapping_triples(spark, sf):
    """A mapping graph with one triples map per customer and one property per order.

    Orders by status: F a typed column, O a link to a parent map, P a template; urgent P a part the
    catalog cannot hold.
    """
    c, o = frame(spark, sf, "customer"), frame(spark, sf, "orders")
    ck, ok = F.col("c_custkey").cast("string"), F.col("o_orderkey").cast("string")
    tm, lt, sm = (F.concat(F.lit(p), ck) for p in (f"{X}map#T", "lt", "sm"))

    def rows(df, items):
        out = []
        for cond, s, s_kind, p, obj, o_kind in items:
            dt = F.lit(str(XSD.string) if o_kind == "literal" else None).cast("string")
            t = F.struct(s.alias("s"), F.lit(s_kind).alias("s_kind"), F.lit(str(p)).alias("p"), obj.alias("o"),
                         F.lit(o_kind).alias("o_kind"), dt.alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))
            out.append(t if cond is None else F.when(cond, t))
        return df.select(F.explode(F.array(*out)).alias("t")).where("t IS NOT NULL").select("t.*")

    heads = rows(c, [
        (None, tm, "iri", RDF.type, F.lit(str(RR.TriplesMap)), "iri"),
        (None, tm, "iri", RR.logicalTable, lt, "bnode"),
        (None, lt, "bnode", RR.tableName, F.concat(F.lit("main.shop.t"), ck), "literal"),
        (None, tm, "iri", RR.subjectMap, sm, "bnode"),
        (None, sm, "bnode", RR.template, F.concat(F.lit(f"{X}t"), ck, F.lit("/{id}")), "literal"),
        (None, sm, "bnode", RR["class"], F.concat(F.lit(X), F.col("c_mktsegment")), "iri")])
    parent_map = F.concat(F.lit(f"{X}map#T"), F.col("o_custkey").cast("string"))
    pom, om, jc = (F.concat(F.lit(p), ok) for p in ("pom", "om", "jc"))
    st = F.col("o_orderstatus")
    odd = (st == "P") & (F.col("o_orderpriority") == "1-URGENT")
    props = rows(o, [
        (None, parent_map, "iri", RR.predicateObjectMap, pom, "bnode"),
        (None, pom, "bnode", RR.predicate, F.concat(F.lit(f"{X}p"), ok), "iri"),
        (None, pom, "bnode", RR.objectMap, om, "bnode"),
        (st == "F", om, "bnode", RR.column, F.concat(F.lit("c"), ok), "literal"),
        (st == "F", om, "bnode", RR.datatype, F.lit(str(XSD.integer)), "iri"),
        (st == "P", om, "bnode", RR.template, F.concat(F.lit("x{c"), ok, F.lit("}")), "literal"),
        (odd, om, "bnode", RR.language, F.lit("en"), "literal"),
        (st == "O", om, "bnode", RR.parentTriplesMap, F.concat(F.lit(f"{X}map#T"), F.expr("o_custkey DIV 2").cast("string")), "iri"),
        (st == "O", om, "bnode", RR.joinCondition, jc, "bnode"),
        (st == "O", jc, "bnode", RR.child, F.concat(F.lit("c"), ok), "literal"),
        (st == "O", jc, "bnode", RR.parent, F.lit("id"), "literal")])
    return heads.union(props)


HEAD_SQL = f"""
SELECT c_custkey AS k, s, p, o FROM customer, LATERAL (VALUES
 ('{X}map#T' || c_custkey, '{RDF.type}', '{R}TriplesMap'), ('{X}map#T' || c_custkey, '{R}logicalTable', 'lt' || c_custkey),
 ('lt' || c_custkey, '{R}tableName', 'main.shop.t' || c_custkey), ('{X}map#T' || c_custkey, '{R}subjectMap', 'sm' || c_custkey),
 ('sm' || c_custkey, '{R}template', '{X}t' || c_custkey || '/{{id}}'), ('sm' || c_custkey, '{R}class', '{X}' || c_mktsegment)) v(s, p, o)
UNION ALL
SELECT o_custkey, s, p, o FROM orders, LATERAL (SELECT * FROM (VALUES
 ('{X}map#T' || o_custkey, '{R}predicateObjectMap', 'pom' || o_orderkey, ''), ('pom' || o_orderkey, '{R}predicate', '{X}p' || o_orderkey, ''),
 ('pom' || o_orderkey, '{R}objectMap', 'om' || o_orderkey, ''), ('om' || o_orderkey, '{R}column', 'c' || o_orderkey, 'F'),
 ('om' || o_orderkey, '{R}datatype', '{XSD.integer}', 'F'), ('om' || o_orderkey, '{R}template', 'x{{c' || o_orderkey || '}}', 'P'),
 ('om' || o_orderkey, '{R}language', 'en', 'P1-URGENT'), ('om' || o_orderkey, '{R}parentTriplesMap', '{X}map#T' || (o_custkey // 2), 'O'),
 ('om' || o_orderkey, '{R}joinCondition', 'jc' || o_orderkey, 'O'), ('jc' || o_orderkey, '{R}child', 'c' || o_orderkey, 'O'),
 ('jc' || o_orderkey, '{R}parent', 'id', 'O')) v(s, p, o, w) WHERE w IN ('', o_orderstatus, o_orderstatus || o_orderpriority))"""


def flat(m):
    """Catalog rows with one row per property, all join conditions in one cell."""
    conditions = F.array_join(F.transform("x.join", lambda j: F.concat(j["child"], F.lit("="), j["parent"])), ",")
    return m.select("map_id", "source_type", "source", "s_template", F.array_join("s_classes", " ").alias("s_class"), "has_stubs",
                    F.explode_outer("poms").alias("x")).select(
        "map_id", "source_type", "source", "s_template", "s_class", "has_stubs", "x.predicate", "x.om_type", "x.column",
        "x.template", "x.datatype", "x.language", "x.parent_map", conditions.alias("pairs"))


@query("m18_read_mapping", f"""
SELECT '#T' || c_custkey AS map_id, 'tableName' AS source_type, 'main.shop.t' || c_custkey AS source,
 '{X}t' || c_custkey || '/{{id}}' AS s_template, '{X}' || c_mktsegment AS s_class, FALSE AS has_stubs,
 '{X}p' || o_orderkey AS predicate, kind AS om_type,
 CASE WHEN kind = 'column' THEN 'c' || o_orderkey END AS "column", CASE WHEN kind = 'template' THEN 'x{{c' || o_orderkey || '}}' END AS template,
 CASE WHEN kind = 'column' THEN '{XSD.integer}' WHEN kind = 'template' THEN '' END AS datatype,
 CASE WHEN kind = 'column' THEN '' WHEN kind = 'template' AND o_orderpriority = '1-URGENT' THEN 'en' WHEN kind = 'template' THEN '' END AS language,
 CASE WHEN kind = 'parentJoin' THEN '#T' || (o_custkey // 2) END AS parent_map,
 CASE WHEN kind = 'parentJoin' THEN 'c' || o_orderkey || '=id' END AS pairs
FROM customer LEFT JOIN (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 'column' WHEN o_orderstatus = 'O' THEN 'parentJoin'
 ELSE 'template' END AS kind FROM orders) ON o_custkey = c_custkey""")
def _(spark, sf):
    return flat(catalog.mapping_from_triples(mapping_triples(spark, sf)))


FULL_MAPPING = """
<http://m#Customer> <{rdf}type> <{rr}TriplesMap> .
<http://m#Customer> <{rr}logicalTable> _:t1 .
_:t1 <{rr}tableName> "customer" .
<http://m#Customer> <{rr}subjectMap> _:s1 .
_:s1 <{rr}template> "{x}customer/{{c_custkey}}" .
_:s1 <{rr}class> <{x}Buyer> .
_:s1 <{rr}class> <{x}Party> .
_:s1 <{rr}graphMap> _:g1 .
_:g1 <{rr}template> "{x}segment/{{c_mktsegment}}" .
<http://m#Customer> <{rr}predicateObjectMap> _:p1 .
_:p1 <{rr}predicate> <{x}name> .
_:p1 <{rr}predicate> <{x}title> .
_:p1 <{rr}objectMap> _:o1 .
_:o1 <{rr}column> "c_name" .
_:o1 <{rr}language> "en" .
_:p1 <{rr}objectMap> _:o2 .
_:o2 <{rr}template> "No. {{c_custkey}}" .
_:o2 <{rr}termType> <{rr}Literal> .
_:p1 <{rr}object> "fixed"^^<{xsd}token> .
<http://m#Customer> <{rr}predicateObjectMap> _:p2 .
_:p2 <{rr}predicateMap> _:q2 .
_:q2 <{rr}constant> <{x}kind> .
_:p2 <{rr}object> <{x}Thing> .
<http://m#Line> <{rr}logicalTable> _:t2 .
_:t2 <{rr}SQLQuery> "SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem" .
<http://m#Line> <{rr}subjectMap> _:s2 .
_:s2 <{rr}template> "{x}line/{{l_orderkey}}/{{l_partkey}}/{{l_suppkey}}" .
_:s2 <{rr}graph> <{x}lines> .
<http://m#Line> <{rr}predicateObjectMap> _:p3 .
_:p3 <{rr}predicate> <{x}supply> .
_:p3 <{rr}objectMap> _:o3 .
_:o3 <{rr}parentTriplesMap> <http://m#Supply> .
_:o3 <{rr}joinCondition> _:j1 .
_:j1 <{rr}child> "l_partkey" .
_:j1 <{rr}parent> "pk" .
_:o3 <{rr}joinCondition> _:j2 .
_:j2 <{rr}child> "l_suppkey" .
_:j2 <{rr}parent> "sk" .
<http://m#Supply> <{rr}logicalTable> _:t3 .
_:t3 <{rr}SQLQuery> "SELECT DISTINCT l_partkey AS pk, l_suppkey AS sk FROM lineitem WHERE l_returnflag = 'R'" .
<http://m#Supply> <{rr}subjectMap> _:s3 .
_:s3 <{rr}template> "{x}supply/{{pk}}/{{sk}}" .
"""


def full_mapping(spark):
    """A mapping with several classes, predicates and objects, a language, constants, graphs and a composite join."""
    text = FULL_MAPPING.strip().format(rdf=str(RDF), rr=R, x=X, xsd=str(XSD))
    return parse_ntriples(spark.createDataFrame([(line,) for line in text.split("\n")], "value string"))


_C = f"'{X}segment/' || c_mktsegment AS g, '{X}customer/' || c_custkey AS s"
_L = f"'{X}lines' AS g, '{X}line/' || l.l_orderkey || '/' || l.l_partkey || '/' || l.l_suppkey AS s"
FULL_SQL = " UNION ALL ".join(
    [f"SELECT {_C}, '{RDF.type}' AS p, '{X}{c}' AS o, CAST(NULL AS VARCHAR) AS o_dt, CAST(NULL AS VARCHAR) AS o_lang FROM customer" for c in ("Buyer", "Party")]
    + [f"SELECT {_C}, '{X}{p}', {o}, {dt}, {lang} FROM customer" for p in ("name", "title") for o, dt, lang in (
        ("c_name", "NULL", "'en'"), ("'No. ' || c_custkey", f"'{XSD.string}'", "NULL"), ("'fixed'", f"'{XSD.token}'", "NULL"))]
    + [f"SELECT {_C}, '{X}kind', '{X}Thing', NULL, NULL FROM customer",
       f"SELECT {_L}, '{X}supply', '{X}supply/' || pk || '/' || sk, NULL, NULL FROM "
       "(SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem) l JOIN "
       "(SELECT DISTINCT l_partkey AS pk, l_suppkey AS sk FROM lineitem WHERE l_returnflag = 'R') ON l_partkey = pk AND l_suppkey = sk"])


def full_graph(spark, sf, triples):
    names = {"customer": frame(spark, sf, "customer"), "lineitem": frame(spark, sf, "lineitem")}
    frame(spark, sf, "lineitem").createOrReplaceTempView("lineitem")
    spec = catalog.mapping_spec(catalog.mapping_from_triples(triples), {"#Customer": ("c_custkey",)})
    return KG(spark, spec, tables=Tables(spark, names)).triples(quads=True).select("g", "s", "p", "o", "o_dt", "o_lang")


@query("m18_whole_mapping", FULL_SQL)
def _(spark, sf):
    """A mapping read from its triples gives every triple that it says."""
    return full_graph(spark, sf, full_mapping(spark))


@query("m18_written_mapping", FULL_SQL)
def _(spark, sf):
    """Read, written as triples again, and read: nothing is lost on the way."""
    rows = catalog.mapping_from_triples(full_mapping(spark))
    return full_graph(spark, sf, catalog.catalog_to_triples(rows, "http://m"))


@query("m19_merge", f"""
SELECT '{X}order/' || o_orderkey AS s, '{X}orderStatus' AS p, o_orderstatus AS o FROM orders
UNION ALL SELECT '{X}order/' || o_orderkey, '{X}placedBy', '{X}customer/' || o_custkey FROM orders""")
def _(spark, sf):
    """Two graphs that overlap."""
    t = order_graph(spark, sf).triples(predicates=[EX.orderStatus, EX.placedBy])
    a = t.where("o <> 'P'")
    b = t.where("o <> 'F'").withColumn("o_kind", F.lit("literal"))
    return graphs.merge_triples(a, b).select("s", "p", "o")


@query("m20_rename", f"""
SELECT '{X}order/' || o_orderkey AS s, '{X}placedBy' AS p, CASE WHEN c_mktsegment = 'BUILDING' THEN '{X}builder/' ELSE '{X}customer/' END || o_custkey AS o
FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN '{X}builder/' ELSE '{X}customer/' END || c_custkey, '{X}custKey',
 CAST(c_custkey AS VARCHAR) FROM customer
UNION ALL SELECT '{X}event/' || event_id, '{X}byUser', '{X}customer/' || user_id FROM events""")
def _(spark, sf):
    """Renamed as subject everywhere, as object only of one property."""
    t = order_graph(spark, sf).triples(predicates=[EX.placedBy, EX.custKey, EX.byUser])
    key = F.col("c_custkey").cast("string")
    renames = frame(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.concat(F.lit(f"{X}customer/"), key).alias("old"), F.concat(F.lit(f"{X}builder/"), key).alias("new"))
    return graphs.rename_terms(t, renames, [EX.placedBy]).select("s", "p", "o")


@query("m21_drop_nodes", f"""
SELECT s, p, o FROM ({HEAD_SQL}) JOIN customer ON k = c_custkey WHERE c_mktsegment <> 'BUILDING'""")
def _(spark, sf):
    roots = frame(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.concat(F.lit(f"{X}map#T"), F.col("c_custkey").cast("string")).alias("node"))
    return graphs.drop_nodes(mapping_triples(spark, sf), roots).select("s", "p", "o")


def metadata(spark, sf):
    """Columns, primary and foreign keys of one table per customer; its orders are the columns."""
    o = frame(spark, sf, "orders")
    table = F.concat(F.lit("main.shop.t"), F.col("o_custkey").cast("string")).alias("table_fqn")
    name = F.concat(F.lit("c "), F.col("o_orderkey").cast("string"))
    kind = F.when(F.col("o_orderstatus") == "F", "BIGINT").when(F.col("o_orderstatus") == "O", "decimal(18,2)").otherwise("string")
    columns = o.select(table, F.col("o_orderkey").cast("int").alias("pos"), name.alias("name"), kind.alias("type"),
                       F.lit(None).cast("string").alias("comment"))
    pk = o.where("o_orderstatus = 'P'").select(table, F.col("o_orderkey").cast("int").alias("pos"), name.alias("column"))
    fk = o.where("o_orderstatus = 'O'").select(
        table, F.col("o_orderkey").alias("fk_id"), F.lit(1).alias("pos"), name.alias("child_column"),
        F.concat(F.lit("main.shop.t"), F.col("o_orderkey").cast("string")).alias("parent_fqn"), F.lit("id").alias("parent_column"))
    return columns, pk, fk


BOOTSTRAP_SQL = f"""
WITH o AS (SELECT *, 'main.shop.t' || o_custkey AS t, '{X}main.shop.t' || o_custkey AS b, 'c%20' || o_orderkey AS e FROM orders),
key AS (SELECT o_custkey AS k, string_agg('c%20' || o_orderkey || '={{c ' || o_orderkey || '}}', ';' ORDER BY o_orderkey) AS slots
        FROM orders a WHERE o_orderstatus = 'P' OR NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus = 'P') GROUP BY 1)
SELECT '#' || t AS map_id, 'tableName' AS source_type, t AS source, b || '/' || slots AS s_template, b AS s_class, FALSE AS has_stubs,
 b || '#' || e AS predicate, 'column' AS om_type, 'c ' || o_orderkey AS "column", CAST(NULL AS VARCHAR) AS template,
 CASE o_orderstatus WHEN 'F' THEN '{XSD.integer}' WHEN 'O' THEN '{XSD.decimal}' ELSE '' END AS datatype,
 '' AS language, CAST(NULL AS VARCHAR) AS parent_map, CAST(NULL AS VARCHAR) AS pairs
FROM o JOIN key ON k = o_custkey
UNION ALL SELECT '#' || t, 'tableName', t, b || '/' || slots, b, FALSE, b || '#ref-' || e, 'parentJoin', NULL, NULL, NULL, NULL,
 '#main.shop.t' || o_orderkey, 'c ' || o_orderkey || '=id' FROM o JOIN key ON k = o_custkey WHERE o_orderstatus = 'O'"""


@query("m22_bootstrap", BOOTSTRAP_SQL)
def _(spark, sf):
    return flat(md.bootstrap_mapping(*metadata(spark, sf), X))


@query("m22_bootstrap_written", BOOTSTRAP_SQL)
def _(spark, sf):
    """A bootstrapped mapping written as triples and read back."""
    rows = md.bootstrap_mapping(*metadata(spark, sf), X)
    return flat(catalog.mapping_from_triples(catalog.catalog_to_triples(rows, X)))


def listing(spark, sf):
    c = frame(spark, sf, "customer")
    fqn = F.when(F.col("c_nationkey") > 2, F.concat(F.lit("main.shop.t"), F.col("c_custkey").cast("string")))
    return c.select(fqn.alias("fqn"), F.when(F.col("c_mktsegment") == "BUILDING", F.lit("no access")).alias("error"))


@query("m23_generation_set", """
SELECT 'table' AS outcome, 'main.shop.t' || c_custkey AS fqn FROM customer WHERE c_nationkey > 2 AND c_mktsegment <> 'BUILDING'
 AND c_custkey IN (SELECT user_id FROM events)
UNION ALL SELECT 'no access', 'main.shop.t' || c_custkey FROM customer WHERE c_nationkey > 2 AND c_mktsegment = 'BUILDING'
 AND c_custkey IN (SELECT user_id FROM events)""")
def _(spark, sf):
    """A retry run: only the tables that failed before, one of them again."""
    retry = frame(spark, sf, "events").select(F.concat(F.lit("main.shop.t"), F.col("user_id").cast("string")).alias("table"))
    ready, errors = md.generation_set(listing(spark, sf), "schema", retry=retry)
    return ready.select(F.lit("table").alias("outcome"), "fqn").union(errors.select("error", "table"))


@query("m24_join_candidates", """
SELECT 'main.shop.t' || o_custkey AS table_fqn, o_orderkey AS fk_id, 'main.shop.t' || o_orderkey AS parent_fqn
FROM orders JOIN customer ON c_custkey = o_orderkey WHERE o_orderstatus = 'O' AND c_nationkey > 2""")
def _(spark, sf):
    _, _, fk = metadata(spark, sf)
    return md.join_candidates(fk, listing(spark, sf).select("fqn")).select("table_fqn", "fk_id", "parent_fqn")


@query("m25_validate", """
SELECT '#T' || o_custkey AS map_id, 'no such column' AS problem, 'main.shop.t' || o_custkey || '.c' || o_orderkey AS detail
 FROM orders
UNION ALL SELECT '#T' || c_custkey, 'no such column', 'main.shop.t' || c_custkey || '.id' FROM customer
 WHERE c_custkey IN (SELECT o_custkey FROM orders)
UNION ALL SELECT * FROM (SELECT DISTINCT '#T' || o_custkey, 'no such column', 'main.shop.t' || (o_custkey // 2) || '.id' FROM orders
 WHERE o_orderstatus = 'O' AND (o_custkey // 2) IN (SELECT o_custkey FROM orders) AND o_custkey // 2 <> o_custkey)
UNION ALL SELECT '#T' || c_custkey, 'no such table', 'main.shop.t' || c_custkey FROM customer
 WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def _(spark, sf):
    """The mapping of m18 against tables that have other columns, or none."""
    columns, _, _ = metadata(spark, sf)
    return md.validate_mapping(catalog.mapping_from_triples(mapping_triples(spark, sf)), columns)


@query("m26_prefixes", """
SELECT o_custkey AS doc_id, o_orderstatus AS prefix, 'http://x/' || max(o_orderkey) AS iri FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2
UNION ALL SELECT o_custkey, 'O', 'http://x/' || min(o_orderkey) FROM orders WHERE o_orderstatus = 'O' GROUP BY 1
UNION ALL SELECT o_custkey, 'base', 'http://x/' || max(o_orderkey) FROM orders WHERE o_orderstatus = 'P' GROUP BY 1""")
def _(spark, sf):
    """One text per customer, one declaration per order."""
    iri = F.concat(F.lit("<http://x/"), F.col("o_orderkey").cast("string"), F.lit(">"))
    line = (F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("@prefix F: "), iri, F.lit(" .")))
            .when(F.col("o_orderstatus") == "O", F.concat(F.lit("prefix  O:"), iri))
            .otherwise(F.concat(F.lit("@base "), iri, F.lit("."))))
    texts = (frame(spark, sf, "orders").groupBy(F.col("o_custkey").alias("doc_id"))
             .agg(F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("line")))).alias("x")))
    return px.extract_prefixes(texts.select("doc_id", F.array_join("x.line", "\n").alias("text")))


PREFIXES = {"m": "https://m.", "web": "http://", "": "https://"}


@query("m27_compact", """
SELECT page_id, CASE WHEN starts_with(url, 'https://m.') THEN 'm:' || substr(url, 11) WHEN starts_with(url, 'http://') THEN 'web:' || substr(url, 8)
 ELSE ':' || substr(url, 9) END AS short, CASE WHEN contains(url, '#') THEN '<#' || string_split(url, '#')[-1] || '>' ELSE url END AS fragment FROM pages""")
def _(spark, sf):
    return frame(spark, sf, "pages").select("page_id", px.compact_iri(F.col("url"), PREFIXES).alias("short"),
                                            px.compact_iri(F.col("url"), {"no": "ftp://"}).alias("fragment"))


@query("m27_expand", "SELECT page_id, url AS a, url AS b, 'un:known' AS c FROM pages")
def _(spark, sf):
    url = F.col("url")
    short = F.when(F.startswith(url, F.lit("https:")), F.concat(F.lit("s:"), F.substr(url, F.lit(9)))).otherwise(
        F.concat(F.lit("p:"), F.substr(url, F.lit(8))))
    known = {"s": "https://", "p": "http://"}
    return frame(spark, sf, "pages").select(
        "page_id", px.expand_curie(short, known).alias("a"),
        px.expand_curie(F.concat(F.lit("<"), url, F.lit(">")), known).alias("b"), px.expand_curie(F.lit("un:known"), known).alias("c"))


@query("m28_map_id", "SELECT p_partkey, '#' || url_encode(p_name || '!' || p_brand) AS id FROM part")
def _(spark, sf):
    name = F.concat(F.col("p_name"), F.lit("!"), F.col("p_brand"))
    return frame(spark, sf, "part").select("p_partkey", px.map_id(name).alias("id"))


@query("m29_normalize_bnodes", f"""
WITH g AS (SELECT o_custkey AS k, o_orderstatus AS st, count(*) AS triples FROM orders GROUP BY 1, 2),
r AS (SELECT *, count(*) OVER (PARTITION BY k) AS size, bool_or(st = 'P') OVER (PARTITION BY k) AS kept FROM g)
SELECT 'n' || k AS base, count(*) AS nodes, sum(triples) AS triples,
       count(*) - 1 AS highest FROM r GROUP BY k""")
def _(spark, sf):
    """Every customer is a blank node of up to three graphs; status P has the plain label."""
    o = frame(spark, sf, "orders")
    key = F.concat(F.lit("n"), F.col("o_custkey").cast("string"))
    label = (F.when(F.col("o_orderstatus") == "P", key).when(F.col("o_orderstatus") == "F", F.concat(F.lit("b1_"), key))
             .otherwise(F.concat(F.lit("b2_b17_"), key)))
    none = F.lit(None).cast("string")
    t = o.select(label.alias("s"), F.lit("bnode").alias("s_kind"), F.lit(str(EX.has)).alias("p"),
                 F.col("o_orderkey").cast("string").alias("o"), F.lit("literal").alias("o_kind"),
                 F.lit(str(XSD.string)).alias("o_dt"), none.alias("o_lang"))
    out = graphs.normalize_bnodes(t)
    base = F.regexp_extract("s", r"^(n\d+)(?:_\d+)?$", 1)
    number = F.coalesce(F.regexp_extract("s", r"^n\d+_(\d+)$", 1).try_cast("bigint"), F.lit(0))
    return out.groupBy(base.alias("base")).agg(F.count_distinct("s").alias("nodes"), F.count("*").alias("triples"),
                                               F.max(number).alias("highest"))
