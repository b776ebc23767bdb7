"""Sources, sinks, and rows to triples."""

from pyspark.sql import functions as F

from kgqueries.model import BASE, EX, integer, order_graph
from kgqueries.registry import TYPE, X, XSD as XS, frame, query, tables
from kgspark import (KG, RDF, XSD, ColumnObj, ConstObj, IriColumn, Mapping, RefObj, Source, TemplateObj, agg,
                     TriplesMap)
from kgspark.operators import metadata as md
from kgspark.sources.ntriples import ntriples_lines, parse_ntriples
from kgspark.terms import enc

WEB = "http://example.org/web/"


def web_graph(spark, sf, **options):
    """Pages, documents and links with the less common mapping forms."""
    docs = [TriplesMap("#Text", "documents", WEB + "doc/{doc_id}", [], {EX.text: ColumnObj("text", lang_column="lang")},
                       ["doc_id"], graph=WEB + "graph/{lang}")]
    maps = docs + [
        TriplesMap("#Page", "pages", IriColumn("url"), [EX.Page], {EX.pageId: integer("page_id")}),
        TriplesMap("#Document", "documents", WEB + "source/{source}/{doc_id}", [EX.Document], {
            EX.origin: TemplateObj("{source}/{lang}", XSD.string),
            EX.site: TemplateObj(WEB + "source/{source}"),
            EX.collection: ConstObj(WEB + "collection", is_iri=True),
            EX.status: ConstObj("stored"),
            EX.chars: ColumnObj("n_chars"),
        }, ["doc_id"]),
        TriplesMap("#Label", "labels", WEB + "label/{doc_id}", [EX.Label], {
            EX.quality: ColumnObj("quality"),
            EX.labels: RefObj("#Document", [("doc_id", "doc_id")]),
        }, ["doc_id"]),
        TriplesMap("#Placed", "orders", BASE + "order/{o_orderkey}", [], {
            EX.buyer: RefObj("#Buyer", [("o_custkey", "c_custkey")]),
        }, ["o_orderkey"]),
        TriplesMap("#Buyer", "customer", BASE + "customer/{c_custkey}", [EX.Buyer], {
            EX.country: RefObj("#Country", [("", "")]),
        }, ["c_custkey"]),
        TriplesMap("#Country", "customer", BASE + "nation/{c_nationkey}", [EX.Country]),
        TriplesMap("#Supply", Source.sql("SELECT DISTINCT l_partkey AS pk, l_suppkey AS sk FROM lineitem "
                                         "WHERE l_returnflag = 'R'", ["lineitem"]),
                   BASE + "partsupp/{pk}/{sk}", [], {}, ["pk", "sk"]),
        TriplesMap("#Line", "lineitem", BASE + "lineitem/{l_orderkey}/{l_linenumber}", [], {
            EX.returnedSupply: RefObj("#Supply", [("l_partkey", "pk"), ("l_suppkey", "sk")]),
        }),
        TriplesMap("#Event", Source.sql("SELECT *, nullif(event_type, 'error') AS good FROM events", ["events"]),
                   BASE + "event/{event_id}", [], {EX.goodType: ColumnObj("good")}, ["event_id"]),
        TriplesMap("#PartName", "part", BASE + "part/{p_partkey}", [],
                   {EX.called: TemplateObj(BASE + "called/{p_name}/{p_brand}")}, ["p_partkey"]),
    ]
    return KG(spark, Mapping(maps), tables=tables(spark, sf), **options)


@query("s1_table_scan", f"SELECT '{X}order/' || o_orderkey AS o, o_orderstatus AS status FROM orders")
def _(spark, sf):
    return order_graph(spark, sf).match("?o", EX.orderStatus, "?status")


@query("s2_sql_source", f"""
SELECT DISTINCT '{X}partsupp/' || l_partkey || '/' || l_suppkey AS ps, l_partkey AS part FROM lineitem""")
def _(spark, sf):
    return order_graph(spark, sf).bgp([("?ps", RDF.type, EX.PartSupp), ("?ps", EX.partKey, "?part")])


# The columns of the given tables.
COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def _column_values() -> str:
    rows = [(f"main.shop.{t}", i, *c.split(" ")) for t, cols in COLUMNS.items() for i, c in enumerate(cols.split(", "), 1)]
    return ", ".join(f"('{t}', {i}, '{name}', '{kind}')" for t, i, name, kind in rows)


@query("s3_table_columns", f"""
SELECT table_fqn, CAST(pos AS BIGINT) AS pos, name, type, CAST(NULL AS VARCHAR) AS comment
FROM (VALUES {_column_values()}) AS t(table_fqn, pos, name, type)""")
def _(spark, sf):
    return md.columns_df(spark, {n: frame(spark, sf, n) for n in COLUMNS}, "main", "shop")


def constraints(spark, sf):
    """Declared keys of one table per customer: its orders stand for the constraints."""
    o = frame(spark, sf, "orders")
    kind = F.when(F.col("o_orderstatus") == "P", "PRIMARY KEY").otherwise("FOREIGN KEY")
    cols = F.array(F.concat(F.lit("k"), F.col("o_orderkey").cast("string")), F.lit("line"))
    return o.select(F.concat(F.lit("main.shop.t"), F.col("o_custkey").cast("string")).alias("table_fqn"),
                    F.col("o_orderkey").alias("pos"), kind.alias("kind"), cols.alias("child_columns"),
                    F.concat(F.lit("main.shop."), F.col("o_orderpriority")).alias("parent_table"),
                    F.array(F.lit("a"), F.lit("b")).alias("parent_columns"))


@query("s4_primary_keys", """
WITH first AS (SELECT o_custkey, min(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT 'main.shop.t' || o_custkey AS table_fqn, CAST(1 AS BIGINT) AS pos, 'k' || k AS "column" FROM first
UNION ALL SELECT 'main.shop.t' || o_custkey, CAST(2 AS BIGINT), 'line' FROM first""")
def _(spark, sf):
    return md.primary_keys(constraints(spark, sf))


@query("s4_foreign_keys", """
SELECT 'main.shop.t' || o_custkey AS table_fqn, o_orderkey AS fk_id, CAST(1 AS BIGINT) AS pos,
       'k' || o_orderkey AS child_column, 'main.shop.' || o_orderpriority AS parent_fqn, 'a' AS parent_column
FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT 'main.shop.t' || o_custkey, o_orderkey, CAST(2 AS BIGINT), 'line', 'main.shop.' || o_orderpriority, 'b'
FROM orders WHERE o_orderstatus <> 'P'""")
def _(spark, sf):
    return md.foreign_keys(constraints(spark, sf))


def text_triples(spark, sf):
    return web_graph(spark, sf).triples(predicates=[EX.text])


TEXT_SQL = f"""
SELECT '{WEB}doc/' || doc_id AS s, 'iri' AS s_kind, '{X}text' AS p, text AS o, 'literal' AS o_kind,
       CAST(NULL AS VARCHAR) AS o_dt, lang AS o_lang FROM documents WHERE text IS NOT NULL"""


@query("s5_ntriples_read", TEXT_SQL)
def _(spark, sf):
    """Whole document texts through N-Triples lines and back."""
    return parse_ntriples(ntriples_lines(text_triples(spark, sf)), "line").drop("g")


@query("s6_sparql_json", f"""
SELECT '{{"c":{{"type":"uri","value":"{X}customer/' || c_custkey || '"}},"name":{{"type":"literal","value":"' || c_name
  || '","datatype":"{XS}string"}}' || CASE WHEN o_orderkey IS NULL THEN '' ELSE ',"o":{{"type":"uri","value":"{X}order/'
  || o_orderkey || '"}},"total":{{"type":"literal","value":"' || CAST(o_totalprice AS DECIMAL(18,2)) || '","datatype":"{XS}decimal"}}'
  END || '}}' AS json
FROM customer LEFT JOIN orders ON o_custkey = c_custkey""")
def _(spark, sf):
    kg = order_graph(spark, sf)
    return (kg.match("?c", EX.name, "?name").join(kg.match("?c", EX.custKey, "?k"))
            .optional(kg.bgp([("?o", EX.placedBy, "?c"), ("?o", EX.totalPrice, "?total")]))
            .select("c", "name", "o", "total").to_sparql_json())


@query("s7_ntriples_write", f"""
SELECT '<{WEB}doc/' || doc_id || '> <{X}text> "' || replace(replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'),
       chr(10), '\\n'), chr(13), '\\r') || '"@' || lang || ' .' AS line
FROM documents WHERE text IS NOT NULL""")
def _(spark, sf):
    return ntriples_lines(text_triples(spark, sf))


# ---- mapping -------------------------------------------------------------------------------

NAMES_SQL = f"""
SELECT '{X}region/' || r_regionkey AS s, r_name AS name FROM region
UNION ALL SELECT '{X}nation/' || n_nationkey, n_name FROM nation
UNION ALL SELECT '{X}customer/' || c_custkey, c_name FROM customer
UNION ALL SELECT '{X}supplier/' || s_suppkey, s_name FROM supplier
UNION ALL SELECT '{X}part/' || p_partkey, p_name FROM part"""


@query("m1_template_subject", NAMES_SQL)
def _(spark, sf):
    return order_graph(spark, sf).match("?s", EX.name, "?name")


@query("m2_column_subject", "SELECT DISTINCT url AS page, page_id AS id FROM pages")
def _(spark, sf):
    return web_graph(spark, sf).match("?page", EX.pageId, "?id")


@query("m4_column_literal", f"SELECT '{X}customer/' || c_custkey AS c, c_mktsegment AS segment FROM customer")
def _(spark, sf):
    return order_graph(spark, sf).match("?c", EX.marketSegment, "?segment")


@query("m5_typed_literal", f"""
SELECT '{X}order/' || o_orderkey AS o, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS price,
       CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders""")
def _(spark, sf):
    return order_graph(spark, sf).bgp([("?o", EX.totalPrice, "?price"), ("?o", EX.orderDate, "?day")])


@query("m6_template_object", f"""
SELECT '{WEB}source/' || source || '/' || doc_id AS d, source || '/' || lang AS origin, '{WEB}source/' || source AS site
FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL""")
def _(spark, sf):
    return web_graph(spark, sf).bgp([("?d", EX.origin, "?origin"), ("?d", EX.site, "?site")])


@query("m7_constant_object", f"""
SELECT '{WEB}source/' || source || '/' || doc_id AS d, '{WEB}collection' AS coll, 'stored' AS status
FROM documents WHERE source IS NOT NULL""")
def _(spark, sf):
    return web_graph(spark, sf).bgp([("?d", EX.collection, "?coll"), ("?d", EX.status, "?status")])


@query("m8_parent_semi", f"""
SELECT '{X}order/' || o_orderkey AS o, '{X}customer/' || c_custkey AS c
FROM orders JOIN customer ON o_custkey = c_custkey""")
def _(spark, sf):
    """The parent must exist; its IRI is made of the child's own columns."""
    return web_graph(spark, sf).match("?o", EX.buyer, "?c")


@query("m8_parent_join", f"""
SELECT '{WEB}label/' || l.doc_id AS label, '{WEB}source/' || source || '/' || d.doc_id AS d
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""")
def _(spark, sf):
    """The parent's IRI needs columns only the parent has."""
    return web_graph(spark, sf).match("?label", EX.labels, "?d")


@query("m9_same_row_parent", f"SELECT '{X}customer/' || c_custkey AS c, '{X}nation/' || c_nationkey AS n FROM customer")
def _(spark, sf):
    return web_graph(spark, sf).match("?c", EX.country, "?n")


@query("m10_composite_join", f"""
SELECT DISTINCT '{X}lineitem/' || l.l_orderkey || '/' || l.l_linenumber AS l,
       '{X}partsupp/' || pk || '/' || sk AS ps
FROM lineitem l JOIN (SELECT DISTINCT l_partkey AS pk, l_suppkey AS sk FROM lineitem WHERE l_returnflag = 'R')
  ON l.l_partkey = pk AND l.l_suppkey = sk""")
def _(spark, sf):
    return web_graph(spark, sf).match("?l", EX.returnedSupply, "?ps")


@query("m11_null_suppression", f"""
SELECT '{X}event/' || event_id AS e, event_type AS t FROM events WHERE event_type <> 'error'""")
def _(spark, sf):
    return web_graph(spark, sf).match("?e", EX.goodType, "?t")


@query("m12_percent_encoding", f"""
SELECT '{X}called/' || url_encode(p_name) || '/' || url_encode(p_brand) AS called, count(*) AS n FROM part GROUP BY 1""")
def _(spark, sf):
    from kgspark import agg
    return web_graph(spark, sf).match("?p", EX.called, "?called").group_by("called").agg(n=agg.count())


@query("m12_encode_text", "SELECT doc_id, url_encode(text) AS enc FROM documents")
def _(spark, sf):
    return frame(spark, sf, "documents").select("doc_id", enc(F.col("text")).alias("enc"))


@query("m13_set_semantics", f"""
SELECT DISTINCT '{X}lineitem/' || l_orderkey || '/' || l_linenumber AS l, l_returnflag AS flag FROM lineitem""")
def _(spark, sf):
    return order_graph(spark, sf).match("?l", EX.returnFlag, "?flag")


@query("m14_natural_type", f"""
SELECT '{WEB}source/' || source || '/' || doc_id AS s, CAST(n_chars AS VARCHAR) AS o, '{XS}integer' AS o_dt
FROM documents WHERE source IS NOT NULL AND n_chars IS NOT NULL""")
def _(spark, sf):
    return web_graph(spark, sf).triples(predicates=[EX.chars]).select("s", "o", "o_dt")


def _rows(source, s, props, cls):
    lit = "'literal'"
    parts = [f"SELECT {s} AS s, 'iri' AS s_kind, '{TYPE}' AS p, '{X}{cls}' AS o, 'iri' AS o_kind, "
             f"CAST(NULL AS VARCHAR) AS o_dt, CAST(NULL AS VARCHAR) AS o_lang FROM {source}"]
    for p, (expr, dt) in props.items():
        kind, typ = (lit, f"'{XS}{dt}'") if dt else ("'iri'", "CAST(NULL AS VARCHAR)")
        parts.append(f"SELECT {s}, 'iri', '{X}{p}', {expr}, {kind}, {typ}, CAST(NULL AS VARCHAR) FROM {source}")
    return " UNION ALL ".join(parts)


def _dec(c):
    return f"CAST(CAST({c} AS DECIMAL(18,2)) AS VARCHAR)"


def _str(c):
    return f"CAST({c} AS VARCHAR)"


def _links(source, s, o, p, inverse):
    """A link in both directions."""
    rest = "'iri', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)"
    return (f"SELECT {s}, 'iri', '{X}{p}', {o}, {rest} FROM {source} "
            f"UNION ALL SELECT {o}, 'iri', '{X}{inverse}', {s}, {rest} FROM {source}")


def _line(suffix):
    out = {f"{p}{suffix}": (_str(c), "integer") for p, c in (
        ("lineNumber", "l_linenumber"), ("partKey", "l_partkey"), ("supplierKey", "l_suppkey"))}
    out |= {f"{p}{suffix}": (_dec(c), "decimal") for p, c in (
        ("quantity", "l_quantity"), ("extendedPrice", "l_extendedprice"), ("discount", "l_discount"), ("tax", "l_tax"))}
    out |= {f"{p}{suffix}": (c, "string") for p, c in (("returnFlag", "l_returnflag"), ("lineStatus", "l_linestatus"))}
    return out | {f"shipDate{suffix}": ("CAST(CAST(l_shipdate AS DATE) AS VARCHAR)", "date")}


_LINE_IRI = f"'{X}lineitem/' || l_orderkey || '/' || l_linenumber"
_ROW_IRI = f"'{X}lineitem-row/' || l_rowid"
_ROWS = """(SELECT *, md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
 l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S'))) AS l_rowid FROM lineitem)"""
_ENDS = [("partOfOrder", "hasLineItem", f"'{X}order/' || l_orderkey"), ("ofPart", "orderedInLineItem", f"'{X}part/' || l_partkey"),
         ("lineSuppliedBy", "suppliesLineItem", f"'{X}supplier/' || l_suppkey")]

GRAPH_SQL = " UNION ".join([
    _rows("region", f"'{X}region/' || r_regionkey",
          {"regionKey": (_str("r_regionkey"), "integer"), "name": ("r_name", "string")}, "Region"),
    _rows("nation", f"'{X}nation/' || n_nationkey",
          {"nationKey": (_str("n_nationkey"), "integer"), "name": ("n_name", "string"),
           "regionKey": (_str("n_regionkey"), "integer")}, "Nation"),
    _links("nation", f"'{X}nation/' || n_nationkey", f"'{X}region/' || n_regionkey", "inRegion", "hasNation"),
    _rows("customer", f"'{X}customer/' || c_custkey",
          {"custKey": (_str("c_custkey"), "integer"), "name": ("c_name", "string"),
           "accountBalance": (_dec("c_acctbal"), "decimal"), "marketSegment": ("c_mktsegment", "string"),
           "nationKey": (_str("c_nationkey"), "integer")}, "Customer"),
    _links("customer", f"'{X}customer/' || c_custkey", f"'{X}nation/' || c_nationkey", "customerInNation", "hasCustomer"),
    _rows("supplier", f"'{X}supplier/' || s_suppkey",
          {"supplierKey": (_str("s_suppkey"), "integer"), "name": ("s_name", "string"),
           "accountBalance": (_dec("s_acctbal"), "decimal"), "nationKey": (_str("s_nationkey"), "integer")}, "Supplier"),
    _links("supplier", f"'{X}supplier/' || s_suppkey", f"'{X}nation/' || s_nationkey", "supplierInNation", "hasSupplier"),
    _rows("part", f"'{X}part/' || p_partkey",
          {"partKey": (_str("p_partkey"), "integer"), "name": ("p_name", "string"), "brand": ("p_brand", "string"),
           "partType": ("p_type", "string"), "size": (_str("p_size"), "integer"),
           "retailPrice": (_dec("p_retailprice"), "decimal")}, "Part"),
    _rows("lineitem", f"'{X}partsupp/' || l_partkey || '/' || l_suppkey",
          {"partKey": (_str("l_partkey"), "integer"), "supplierKey": (_str("l_suppkey"), "integer")}, "PartSupp"),
    _links("lineitem", f"'{X}partsupp/' || l_partkey || '/' || l_suppkey", f"'{X}part/' || l_partkey", "forPart", "hasPartSupply"),
    _links("lineitem", f"'{X}partsupp/' || l_partkey || '/' || l_suppkey", f"'{X}supplier/' || l_suppkey", "bySupplier", "suppliesPart"),
    _rows("orders", f"'{X}order/' || o_orderkey",
          {"orderKey": (_str("o_orderkey"), "integer"), "orderStatus": ("o_orderstatus", "string"),
           "totalPrice": (_dec("o_totalprice"), "decimal"),
           "orderDate": ("CAST(CAST(o_orderdate AS DATE) AS VARCHAR)", "date"),
           "orderPriority": ("o_orderpriority", "string")}, "Order"),
    _links("orders", f"'{X}order/' || o_orderkey", f"'{X}customer/' || o_custkey", "placedBy", "placesOrder"),
    _rows("lineitem", _LINE_IRI, _line(""), "LineItem"),
    *[_links("lineitem", _LINE_IRI, end, p, inverse) for p, inverse, end in _ENDS],
    _rows(_ROWS, _ROW_IRI, _line("OfRow") | {f"{p}OfRow": (end, None) for p, _, end in _ENDS}, "LineItemRow"),
    _rows("events", f"'{X}event/' || event_id",
          {"eventType": ("event_type", "string"), "eventTime": ("replace(CAST(ts AS VARCHAR), ' ', 'T')", "dateTime"),
           "eventValue": (_str("value"), "double"), "propK": (_str("CAST(json_extract(props, '$.k') AS BIGINT)"), "integer"),
           "byUser": (f"'{X}customer/' || user_id", None)}, "Event"),
])


@query("m15_graph_view", f"SELECT * FROM ({GRAPH_SQL}) WHERE s IS NOT NULL AND o IS NOT NULL")
def _(spark, sf):
    """Every triple of the graph, with inverses; each table is read once per map."""
    return order_graph(spark, sf).triples()


@query("m3_class_assertion", f"SELECT * FROM ({GRAPH_SQL}) WHERE p = '{TYPE}' AND s IS NOT NULL")
def _(spark, sf):
    """The class of every subject of the graph."""
    return order_graph(spark, sf).triples(predicates=[RDF.type])


@query("g5_open_pattern", f"""
SELECT p, count(*) AS n FROM (SELECT * FROM ({GRAPH_SQL}) WHERE s IS NOT NULL AND o IS NOT NULL) GROUP BY p""")
def _(spark, sf):
    """Any subject, predicate and object: as many solutions of each predicate as the graph has triples."""
    return order_graph(spark, sf).match("?s", "?p", "?o").group_by("p").agg(n=agg.count())


@query("m16_language_tag", TEXT_SQL)
def _(spark, sf):
    return text_triples(spark, sf)


@query("m17_named_graphs", f"""
SELECT '{WEB}graph/' || lang AS g, '{WEB}doc/' || doc_id AS s, md5(text) AS digest, lang AS o_lang
FROM documents WHERE text IS NOT NULL""")
def _(spark, sf):
    quads = web_graph(spark, sf).triples(predicates=[EX.text], quads=True)
    return quads.select("g", "s", F.md5("o").alias("digest"), "o_lang")

