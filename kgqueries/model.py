"""The order-processing tables as a graph: mapping and ontology."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kgspark import (KG, XSD, ColumnObj, IRI, Mapping, Namespace, OWL, RDF, RDFS, RefObj, SKOS, Source,
                     TemplateObj, TriplesMap)
from kgqueries.registry import tables

BASE = "http://example.org/tpch/"
EX = Namespace(BASE)
MONEY = "decimal(18,2)"


def money(column: str) -> ColumnObj:
    return ColumnObj(column, XSD.decimal, decimal=MONEY)


def integer(column: str) -> ColumnObj:
    return ColumnObj(column, XSD.integer)


# Line items have no unique key, so a second map numbers their rows by a digest of all columns.
ROW_SQL = """
SELECT *, md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
                        l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)) AS l_rowid
FROM lineitem
"""
PARTSUPP_SQL = "SELECT DISTINCT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey FROM lineitem"
EVENT_SQL = """
SELECT *, get_json_object(props, '$.k') AS prop_k FROM events
"""


def line_properties():
    return {
        EX.lineNumber: integer("l_linenumber"),
        EX.partKey: integer("l_partkey"),
        EX.supplierKey: integer("l_suppkey"),
        EX.quantity: money("l_quantity"),
        EX.extendedPrice: money("l_extendedprice"),
        EX.discount: money("l_discount"),
        EX.tax: money("l_tax"),
        EX.returnFlag: ColumnObj("l_returnflag"),
        EX.lineStatus: ColumnObj("l_linestatus"),
        EX.shipDate: ColumnObj("l_shipdate", XSD.date),
        EX.partOfOrder: RefObj("#Order", [("l_orderkey", "o_orderkey")], trusted=True),
        EX.ofPart: RefObj("#Part", [("l_partkey", "p_partkey")], trusted=True),
        EX.lineSuppliedBy: RefObj("#Supplier", [("l_suppkey", "s_suppkey")], trusted=True),
    }


def tpch_mapping() -> Mapping:
    return Mapping([
        TriplesMap("#Region", "region", BASE + "region/{r_regionkey}", [EX.Region], {
            EX.regionKey: integer("r_regionkey"),
            EX.name: ColumnObj("r_name"),
        }, ["r_regionkey"]),
        TriplesMap("#Nation", "nation", BASE + "nation/{n_nationkey}", [EX.Nation], {
            EX.nationKey: integer("n_nationkey"),
            EX.name: ColumnObj("n_name"),
            EX.regionKey: integer("n_regionkey"),
            EX.inRegion: RefObj("#Region", [("n_regionkey", "r_regionkey")], trusted=True),
        }, ["n_nationkey"]),
        TriplesMap("#Customer", "customer", BASE + "customer/{c_custkey}", [EX.Customer], {
            EX.custKey: integer("c_custkey"),
            EX.name: ColumnObj("c_name"),
            EX.accountBalance: money("c_acctbal"),
            EX.marketSegment: ColumnObj("c_mktsegment"),
            EX.nationKey: integer("c_nationkey"),
            EX.customerInNation: RefObj("#Nation", [("c_nationkey", "n_nationkey")], trusted=True),
        }, ["c_custkey"]),
        TriplesMap("#Supplier", "supplier", BASE + "supplier/{s_suppkey}", [EX.Supplier], {
            EX.supplierKey: integer("s_suppkey"),
            EX.name: ColumnObj("s_name"),
            EX.accountBalance: money("s_acctbal"),
            EX.nationKey: integer("s_nationkey"),
            EX.supplierInNation: RefObj("#Nation", [("s_nationkey", "n_nationkey")], trusted=True),
        }, ["s_suppkey"]),
        TriplesMap("#Part", "part", BASE + "part/{p_partkey}", [EX.Part], {
            EX.partKey: integer("p_partkey"),
            EX.name: ColumnObj("p_name"),
            EX.brand: ColumnObj("p_brand"),
            EX.partType: ColumnObj("p_type"),
            EX["size"]: integer("p_size"),
            EX.retailPrice: money("p_retailprice"),
        }, ["p_partkey"]),
        TriplesMap("#PartSupp", Source.sql(PARTSUPP_SQL, ["lineitem"]),
                   BASE + "partsupp/{ps_partkey}/{ps_suppkey}", [EX.PartSupp], {
            EX.partKey: integer("ps_partkey"),
            EX.supplierKey: integer("ps_suppkey"),
            EX.forPart: RefObj("#Part", [("ps_partkey", "p_partkey")], trusted=True),
            EX.bySupplier: RefObj("#Supplier", [("ps_suppkey", "s_suppkey")], trusted=True),
        }, ["ps_partkey", "ps_suppkey"]),
        TriplesMap("#Order", "orders", BASE + "order/{o_orderkey}", [EX.Order], {
            EX.orderKey: integer("o_orderkey"),
            EX.orderStatus: ColumnObj("o_orderstatus"),
            EX.totalPrice: money("o_totalprice"),
            EX.orderDate: ColumnObj("o_orderdate", XSD.date),
            EX.orderPriority: ColumnObj("o_orderpriority"),
            EX.placedBy: RefObj("#Customer", [("o_custkey", "c_custkey")], trusted=True),
        }, ["o_orderkey"]),
        TriplesMap("#LineItem", "lineitem", BASE + "lineitem/{l_orderkey}/{l_linenumber}", [EX.LineItem],
                   line_properties()),
        TriplesMap("#LineItemRow", Source.sql(ROW_SQL, ["lineitem"]), BASE + "lineitem-row/{l_rowid}",
                   [EX.LineItemRow], {IRI(p + "OfRow"): o for p, o in line_properties().items()}, ["l_rowid"]),
        TriplesMap("#Event", Source.sql(EVENT_SQL, ["events"]), BASE + "event/{event_id}", [EX.Event], {
            EX.eventType: ColumnObj("event_type"),
            EX.eventTime: ColumnObj("ts", XSD.dateTime),
            EX.eventValue: ColumnObj("value"),
            EX.propK: ColumnObj("prop_k", XSD.integer),
            EX.byUser: TemplateObj(BASE + "customer/{user_id}"),
        }, ["event_id"]),
    ])


MAPPING = tpch_mapping()


def row(prop: str) -> IRI:
    """The row-faithful twin of a line-item property."""
    return IRI(EX[prop] + "OfRow")


CLASSES = ["Customer", "Order", "LineItem", "LineItemRow", "Part", "Supplier", "PartSupp", "Nation", "Region", "Event"]
# (property, domain, range, inverse or None)
OBJECT_PROPERTIES = [
    ("placedBy", "Order", "Customer", "placesOrder"),
    ("placesOrder", "Customer", "Order", None),
    ("partOfOrder", "LineItem", "Order", "hasLineItem"),
    ("hasLineItem", "Order", "LineItem", None),
    ("ofPart", "LineItem", "Part", "orderedInLineItem"),
    ("orderedInLineItem", "Part", "LineItem", None),
    ("lineSuppliedBy", "LineItem", "Supplier", "suppliesLineItem"),
    ("suppliesLineItem", "Supplier", "LineItem", None),
    ("forPart", "PartSupp", "Part", "hasPartSupply"),
    ("hasPartSupply", "Part", "PartSupp", None),
    ("bySupplier", "PartSupp", "Supplier", "suppliesPart"),
    ("suppliesPart", "Supplier", "PartSupp", None),
    ("customerInNation", "Customer", "Nation", "hasCustomer"),
    ("hasCustomer", "Nation", "Customer", None),
    ("supplierInNation", "Supplier", "Nation", "hasSupplier"),
    ("hasSupplier", "Nation", "Supplier", None),
    ("inRegion", "Nation", "Region", "hasNation"),
    ("hasNation", "Region", "Nation", None),
]
# (property, domain or None for a union domain, range)
DATA_PROPERTIES = [
    ("custKey", "Customer", "integer"), ("orderKey", "Order", "integer"), ("lineNumber", "LineItem", "integer"),
    ("partKey", None, "integer"), ("supplierKey", None, "integer"), ("nationKey", None, "integer"),
    ("regionKey", None, "integer"), ("name", None, "string"), ("accountBalance", None, "decimal"),
    ("marketSegment", "Customer", "string"), ("orderStatus", "Order", "string"),
    ("totalPrice", "Order", "decimal"), ("orderDate", "Order", "date"), ("orderPriority", "Order", "string"),
    ("quantity", "LineItem", "decimal"), ("extendedPrice", "LineItem", "decimal"),
    ("discount", "LineItem", "decimal"), ("tax", "LineItem", "decimal"), ("returnFlag", "LineItem", "string"),
    ("lineStatus", "LineItem", "string"), ("shipDate", "LineItem", "date"), ("brand", "Part", "string"),
    ("partType", "Part", "string"), ("size", "Part", "integer"), ("retailPrice", "Part", "decimal"),
    ("eventType", "Event", "string"), ("eventTime", "Event", "dateTime"),
]


def tbox_rows() -> list[tuple]:
    """(s, s_kind, p, o, o_kind, o_dt, o_lang)"""
    rows = []

    def link(s, p, o):
        rows.append((str(s), "iri", str(p), str(o), "iri", None, None))

    def text(s, p, o):
        rows.append((str(s), "iri", str(p), o, "literal", str(XSD.string), None))

    for c in CLASSES:
        link(EX[c], RDF.type, OWL.Class)
        text(EX[c], RDFS.label, c)
        text(EX[c], SKOS.altLabel, f"{c} record")
        text(EX[c], RDFS.comment, f"A {c} of the order system.")
    for p, dom, rng, inverse in OBJECT_PROPERTIES:
        link(EX[p], RDF.type, OWL.ObjectProperty)
        link(EX[p], RDFS.domain, EX[dom])
        link(EX[p], RDFS.range, EX[rng])
        if inverse:
            link(EX[p], OWL.inverseOf, EX[inverse])
    for i, (p, dom, rng) in enumerate(DATA_PROPERTIES):
        link(EX[p], RDF.type, OWL.DatatypeProperty)
        if dom:
            link(EX[p], RDFS.domain, EX[dom])
        else:
            rows.append((str(EX[p]), "iri", str(RDFS.domain), f"u{i}", "bnode", None, None))
            rows.append((f"u{i}", "bnode", str(RDF.type), str(OWL.Class), "iri", None, None))
        link(EX[p], RDFS.range, XSD[rng])
    return rows


TBOX_DDL = "s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string"


def tbox(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(tbox_rows(), TBOX_DDL)


_ONTOLOGY = None


def ontology():
    """The sample ontology's schema triples, without a Spark job."""
    global _ONTOLOGY
    if _ONTOLOGY is None:
        from kgspark import Ontology
        _ONTOLOGY = Ontology([(s, p, o) for s, k, p, o, ok, _, _ in tbox_rows() if k == ok == "iri"])
    return _ONTOLOGY


_GRAPHS: dict[tuple, KG] = {}


def order_graph(spark: SparkSession, sf_dir: str, **options) -> KG:
    """The sample graph over a folder of tables; the plain one is made once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if not options and key in _GRAPHS:
        return _GRAPHS[key]
    kg = KG(spark, MAPPING, tables=tables(spark, sf_dir), **{"ontology": ontology(), **options})
    return kg if options else _GRAPHS.setdefault(key, kg)
