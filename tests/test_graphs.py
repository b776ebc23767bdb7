import pytest
from pyspark.sql import functions as F

from kgspark import IRI, KG, RDF, RR, XSD
from kgspark.operators import catalog, graphs
from kgspark.operators import metadata as md
from kgspark.sources.ntriples import parse_ntriples
from tests.helpers import bag, triples


def spo(df):
    return sorted((r.s, r.p, r.o) for r in df.collect())


def test_merge_compares_text_only(spark):
    a = triples(spark, [("s", "p", "o"), ("s", "p", '"x')])
    b = triples(spark, [("s", "p", '"o'), ("s", "q", "o"), ("s", "q", '"o')])
    got = graphs.merge_triples(a, b)
    assert spo(got) == [("s", "p", "o"), ("s", "p", "x"), ("s", "q", "o")]
    assert got.where("p = 'p' AND o = 'o'").first().o_kind == "iri"


def test_rename(spark):
    t = triples(spark, [("a", "p", "b"), ("b", "parent", "a"), ("c", "other", "a"), ("c", "parent", '"a'), ("z", "p", "b")])
    table = spark.createDataFrame([("a", "z"), ("b", "b")], "old string, new string")
    assert spo(graphs.rename_terms(t, table, ["parent"])) == [
        ("b", "parent", "z"), ("c", "other", "a"), ("c", "parent", "a"), ("z", "p", "b")]
    assert ("c", "other", "z") in spo(graphs.rename_terms(t, table))


def test_drop_nodes_with_what_hangs_below(spark):
    t = triples(spark, [("m", "table", "_:x"), ("_:x", "name", '"t'), ("_:x", "sub", "_:y"), ("_:y", "v", '"1'), ("_:y", "back", "_:x"),
                        ("n", "table", "_:z"), ("_:z", "name", '"u'), ("n", "ref", "m")])
    roots = spark.createDataFrame([("m",)], "node string")
    assert spo(graphs.drop_nodes(t, roots)) == [("n", "ref", "m"), ("n", "table", "z"), ("z", "name", "u")]
    assert ("n", "ref", "m") not in spo(graphs.drop_nodes(t, roots, links=True))


@pytest.mark.parametrize("splits", [256, 1])
def test_blank_node_labels(spark, monkeypatch, splits):
    monkeypatch.setattr(graphs, "HOT_SPLITS", splits)
    t = triples(spark, [("_:b1_x", "p", "_:x"), ("_:b2_x", "p", "_:b7_b8_y"), ("_:x_4", "p", '"b9_x'), ("_:b3_b1_x", "q", "b1_iri")]
                + [(f"_:b{i}_hot", "p", '"v') for i in range(500)])
    out = graphs.normalize_bnodes(t).collect()
    nodes = {r.s for r in out if r.s_kind == "bnode"} | {r.o for r in out if r.o_kind == "bnode"}
    assert len(nodes) == 6 + 500 and {"x", "x_4", "y", "hot", "x_5", "x_6", "x_7", "hot_499"} <= nodes
    assert ("b1_iri", "iri") in {(r.o, r.o_kind) for r in out} and ("b9_x", "literal") in {(r.o, r.o_kind) for r in out}


R2RML = """
<http://m#Dept> <{rdf}type> <{rr}TriplesMap> .
<http://m#Dept> <{rr}logicalTable> _:l1 .
_:l1 <{rr}tableName> "depts" .
<http://m#Dept> <{rr}subjectMap> _:s1 .
_:s1 <{rr}template> "http://e/d/{{id}}" .
_:s1 <{rr}class> <http://e/Dept> .
<http://m#Dept> <{rr}predicateObjectMap> _:p1 .
_:p1 <{rr}predicate> <http://e/label> .
_:p1 <{rr}objectMap> _:o1 .
_:o1 <{rr}column> "label" .
<http://m#Person> <{rdf}type> <{rr}TriplesMap> .
<http://m#Person> <{rr}logicalTable> _:l2 .
_:l2 <{rr}tableName> "people" .
<http://m#Person> <{rr}subjectMap> _:s2 .
_:s2 <{rr}template> "http://e/p/{{id}}" .
<http://m#Person> <{rr}predicateObjectMap> _:p2 .
_:p2 <{rr}predicate> <http://e/in> .
_:p2 <{rr}objectMap> _:o2 .
_:o2 <{rr}parentTriplesMap> <http://m#Dept> .
_:o2 <{rr}joinCondition> _:j2 .
_:j2 <{rr}child> "dept" .
_:j2 <{rr}parent> "id" .
<http://m#Person> <{rr}predicateObjectMap> _:p3 .
_:p3 <{rr}predicate> <http://e/age> .
_:p3 <{rr}objectMap> _:o3 .
_:o3 <{rr}column> "age" .
_:o3 <{rr}datatype> <{xsd}integer> .
<http://m#Odd> <{rdf}type> <{rr}TriplesMap> .
<http://m#Odd> <{rr}predicateObjectMap> _:p4 .
_:p4 <{rr}objectMap> _:o4 .
""".replace("{rdf}", str(RDF)).replace("{rr}", str(RR)).replace("{xsd}", str(XSD)).replace("{{", "{").replace("}}", "}")


def mapping_rows(spark):
    lines = spark.createDataFrame([(x,) for x in R2RML.strip().split("\n")], "value string")
    return catalog.mapping_from_triples(parse_ntriples(lines))


def test_read_mapping_from_rdf(spark):
    rows = {r.map_id: r for r in mapping_rows(spark).collect()}
    assert set(rows) == {"#Dept", "#Person", "#Odd"}
    person = rows["#Person"]
    link, age = sorted(person.poms, key=lambda p: p.om_type, reverse=True)
    assert (link.parent_map, [(j.child, j.parent) for j in link.join]) == ("#Dept", [("dept", "id")])
    assert (age.column, age.datatype) == ("age", XSD.integer) and not person.has_stubs
    odd = rows["#Odd"]
    assert (odd.source_type, odd.has_stubs, odd.poms[0].om_type, odd.poms[0].column) == ("unknown", True, "stub", None)
    assert odd.problems == ["no logical table", "no object", "no predicate"]
    with pytest.raises(ValueError, match="#Odd cannot be held: no logical table"):
        catalog.mapping_spec(mapping_rows(spark))


def test_query_a_mapping_read_from_rdf(spark):
    m = catalog.mapping_spec(mapping_rows(spark).where("NOT has_stubs"), {"#Dept": ("id",), "#Person": ("id",)})
    tables = {"depts": spark.createDataFrame([(1, "x")], "id long, label string"),
              "people": spark.createDataFrame([(7, 1, "40"), (8, 2, "no")], "id long, dept long, age string")}
    kg = KG(spark, m, tables=tables)
    assert bag(kg.bgp([("?p", IRI("http://e/in"), "?d"), ("?d", IRI("http://e/label"), "?l")])) == [("http://e/p/7", "http://e/d/1", "x")]
    assert bag(kg.match("?p", IRI("http://e/age"), "?a")) == [("http://e/p/7", 40)]


def test_validation(spark):
    columns = spark.createDataFrame([("depts", 1, "id", "long", None), ("people", 1, "id", "long", None), ("people", 2, "age", "int", None)], md.COLUMNS_DDL)
    got = {(r.map_id, r.problem, r.detail) for r in md.validate_mapping(mapping_rows(spark), columns).collect()}
    assert got == {("#Dept", "no such column", "depts.label"), ("#Person", "no such column", "people.dept"),
                   ("#Odd", "no logical table", ""), ("#Odd", "no subject", "")}


def test_type_profile(spark):
    t = triples(spark, [("a", "p", "x"), ("b", "p", '"1'), ("c", "p", '"2')])
    assert {(r.o_kind, r.n) for r in graphs.type_profile(t).collect()} == {("iri", 1), ("literal", 2)}


def test_bootstrap_is_a_usable_mapping(spark):
    columns = spark.createDataFrame([("main.s.t a", 1, "k", "int", None), ("main.s.t a", 2, "f", "int", None), ("main.s.u", 1, "id", "int", None),
                                     ("main.s.u", 2, "v", "timestamp", None)], md.COLUMNS_DDL)
    pk = spark.createDataFrame([("main.s.t a", 1, "k")], "table_fqn string, pos int, column string")
    fk = spark.createDataFrame([("main.s.t a", 1, 1, "f", "main.s.u", "id")],
                               "table_fqn string, fk_id int, pos int, child_column string, parent_fqn string, parent_column string")
    rows = md.bootstrap_mapping(columns, pk, fk, "http://b/")
    assert md.validate_mapping(rows, columns).count() == 0
    by_id = {r.map_id: r for r in rows.collect()}
    t = by_id["#main.s.t%20a"]
    assert t.s_template == "http://b/main.s.t%20a/k={k}"
    assert [(p.predicate.split("#")[1], p.om_type) for p in t.poms] == [("k", "column"), ("f", "column"), ("ref-f", "parentJoin")]
    assert by_id["#main.s.u"].s_template == "http://b/main.s.u/id={id};v={v}"
    kg = KG(spark, catalog.mapping_spec(rows), tables={
        "main.s.t a": spark.createDataFrame([(1, 5)], "k int, f int"),
        "main.s.u": spark.createDataFrame([(5, None)], "id int, v timestamp").withColumn("v", F.lit("2020-01-02").cast("timestamp"))})
    assert bag(kg.match("?t", IRI("http://b/main.s.t%20a#ref-f"), "?u")) == [
        ("http://b/main.s.t%20a/k=1", "http://b/main.s.u/id=5;v=2020-01-02T00%3A00%3A00")]
