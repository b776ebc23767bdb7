import re
from datetime import date
from decimal import Decimal

from kgspark import (IRI, KG, OWL, RDF, RDFS, XSD, ColumnObj, ConstObj, IriColumn, Mapping, Namespace, Ontology,
                     RefObj, TemplateObj, TriplesMap, agg, fn)
from tests.helpers import bag

E = Namespace("http://e/")


def tables(spark):
    return {
        "people": spark.createDataFrame([(1, "Ann", 10), (2, None, 11), (3, "Cid", None)], "id int, name string, dept long"),
        "depts": spark.createDataFrame([(10, "a b"), (12, "c")], "id int, label string"),
        "works": spark.createDataFrame([(1, 5, 2.5), (1, 5, 2.5), (1, 5, 3.5)], "p int, w int, hours double"),
    }


MAPPING = Mapping([
    TriplesMap("#P", "people", "http://e/p/{id}", [E.Person], {
        E.name: ColumnObj("name"), E["in"]: RefObj("#D", [("dept", "id")]), E.home: TemplateObj("http://e/d/{dept}"),
        E.code: TemplateObj("{id}-{name}", XSD.string), E.kind: ConstObj(E.Human, is_iri=True)}, ["id"]),
    TriplesMap("#D", "depts", "http://e/d/{id}", [E.Dept], {E.name: ColumnObj("label"), E.tag: ColumnObj("label", lang="de")}, ["id"]),
    TriplesMap("#W", "works", "http://e/w/{p}/{w}", [E.Work], {E.hours: ColumnObj("hours", XSD.decimal), E.by: RefObj("#P", [("p", "id")])}),
    TriplesMap("#L", "depts", IriColumn("label"), [], {E.key: ColumnObj("id")}, ["label"], graph="http://e/g"),
])


def kg(spark, **options):
    return KG(spark, MAPPING, tables=tables(spark), **options)


def test_null_gives_no_triple(spark):
    k = kg(spark)
    assert bag(k.match("?s", E.name, "?n")) == [("http://e/d/10", "a b"), ("http://e/d/12", "c"), ("http://e/p/1", "Ann"), ("http://e/p/3", "Cid")]
    assert bag(k.match("?s", E.code, "?c")) == [("http://e/p/1", "1-Ann"), ("http://e/p/3", "3-Cid")]


def test_dangling_keys_have_no_parent(spark):
    k = kg(spark)
    assert bag(k.match("?s", E["in"], "?d")) == [("http://e/p/1", "http://e/d/10")]
    assert bag(k.match("?s", E.home, "?d")) == [("http://e/p/1", "http://e/d/10"), ("http://e/p/2", "http://e/d/11")]


def test_triples_are_a_set(spark):
    k = kg(spark)
    assert bag(k.match("?w", E.hours, "?h")) == [("http://e/w/1/5", Decimal("2.5000000000")), ("http://e/w/1/5", Decimal("3.5000000000"))]
    assert bag(k.match("?w", RDF.type, E.Work)) == [("http://e/w/1/5",)]
    assert bag(k.match("?w", E.by, "?p")) == [("http://e/w/1/5", "http://e/p/1")]
    t = k.triples(predicates=[E.hours, E.by, RDF.type], classes=[E.Work])
    assert t.count() == t.distinct().count() == 4


def test_constants_at_both_ends(spark):
    k = kg(spark)
    assert bag(k.match(IRI("http://e/p/1"), E.name, "?n")) == [("Ann",)]
    assert bag(k.match("?s", E.name, "Ann")) == [("http://e/p/1",)]
    assert k.match(IRI("http://e/p/1"), E.name, "Ann").ask().first().ask
    assert not k.match(IRI("http://e/p/1"), E.name, 5).ask().first().ask
    assert bag(k.match("?s", E.kind, E.Human)) == [("http://e/p/1",), ("http://e/p/2",), ("http://e/p/3",)]


def test_same_constant_twice_is_one_scan(spark):
    b = kg(spark).bgp([(E["p/1"], E.name, "?n"), (E["p/1"], E.home, "?h")])
    assert bag(b) == [("Ann", "http://e/d/10")]
    assert b.df._jdf.queryExecution().executedPlan().toString().count("Join") == 0


def test_language_graph_and_iri_column(spark):
    k = kg(spark)
    tag = k.triples(predicates=[E.tag]).orderBy("o").first()
    assert (tag.o_lang, tag.o_dt) == ("de", None)
    quads = k.triples(predicates=[E.key], quads=True).orderBy("s").collect()
    assert [(q.g, q.s, q.o, q.o_dt) for q in quads] == [("http://e/g", "a b", "10", XSD.integer), ("http://e/g", "c", "12", XSD.integer)]
    assert bag(k.match("?s", E.key, "?o", graph="http://e/none")) == []


def test_variable_predicate_covers_the_graph(spark):
    k = kg(spark)
    n = k.match("?s", "?p", "?o").agg(n=agg.count()).df.first().n
    assert n == k.triples().count()


def test_iri_text_joins_mapped_keys(spark):
    k = kg(spark)
    asked = k.values("d", [E["d/10"], E["d/99"], E["p/1"], IRI("http://e/d/x%20y")])
    assert bag(asked.join(k.match("?d", E.name, "?n"))) == [("http://e/d/10", "a b"), ("http://e/p/1", "Ann")]
    text = k.match("?s", E.home, "?d").select(d2=lambda r: fn.iri(fn.str(r.d))).rename(d2="d")
    assert bag(text.join(k.match("?d", E.tag, "?n"))) == [("http://e/d/10", "a b")]
    assert bag(text.optional(k.match("?d", E.tag, "?n"))) == [("http://e/d/10", "a b"), ("http://e/d/11", None)]
    assert bag(text.minus(k.match("?d", E.tag, "?n"))) == [("http://e/d/11",)]
    assert bag(k.match("?d", E.tag, "?n").exists(text)) == [("http://e/d/10", "a b")]


def test_reasoning_over_hierarchy_and_inverse(spark):
    onto = Ontology([(E.Person, RDFS.subClassOf, E.Agent), (E.home, RDFS.subPropertyOf, E.at),
                     (E.at, OWL.inverseOf, E.hosts), (E.by, RDFS.range, E.Worker)])
    k = kg(spark, ontology=onto)
    assert len(bag(k.match("?x", RDF.type, E.Agent))) == 3
    assert bag(k.match("?d", E.hosts, "?p")) == [("http://e/d/10", "http://e/p/1"), ("http://e/d/11", "http://e/p/2")]
    assert bag(k.match("?x", RDF.type, E.Worker)) == [("http://e/p/1",)]
    assert bag(kg(spark, ontology=onto, reasoning=False).match("?x", RDF.type, E.Agent)) == []


def test_reasoning_is_neutral_without_an_ontology(spark):
    patterns = [("?p", E.name, "?n"), ("?p", E["in"], "?d"), ("?d", RDF.type, E.Dept)]
    assert bag(kg(spark, ontology=Ontology()).bgp(patterns)) == bag(kg(spark, reasoning=False).bgp(patterns)) == [
        ("http://e/p/1", "Ann", "http://e/d/10")]


def test_star_equals_self_join(spark):
    keyless = Mapping([TriplesMap(m.id, m.source, m.subject, m.classes, m.properties) for m in MAPPING.maps])
    patterns = [("?p", E.name, "?n"), ("?p", E.home, "?h"), ("?p", RDF.type, E.Person)]
    assert bag(kg(spark).bgp(patterns)) == bag(KG(spark, keyless, tables=tables(spark)).bgp(patterns))


def test_optional_property_of_the_same_row(spark):
    k = kg(spark)
    b = k.match("?p", E.kind, "?k").optional(k.match("?p", E.name, "?n"))
    assert [r[2] for r in bag(b)] == ["Ann", None, "Cid"]
    assert "Join" not in b.df._jdf.queryExecution().executedPlan().toString()
    chosen = k.match("?p", E.kind, "?k").optional(k.match("?p", E.name, "?n"), where=lambda r: r.n == "Cid")
    assert [r[2] for r in bag(chosen)] == [None, None, "Cid"]


def test_describe(spark):
    k = kg(spark)
    iris = spark.createDataFrame([("http://e/p/1",), ("http://e/p/01",), ("http://e/zz",)], "iri string")
    assert sorted(r.p for r in k.describe(iris).collect()) == sorted(r.p for r in k.describe([E["p/1"]]).collect())
    assert {r.s for r in k.describe(iris).collect()} == {"http://e/p/1"}


def test_tables_of_the_session_catalog(spark):
    for name, df in tables(spark).items():
        df.createOrReplaceTempView(name)
    from kgspark import Source
    m = Mapping([TriplesMap("#P", "people", "http://e/p/{id}", [], {E.name: ColumnObj("name")}, ["id"]),
                 TriplesMap("#Q", Source.sql("SELECT id, upper(label) AS u FROM depts"), "http://e/d/{id}", [], {E.name: ColumnObj("u")}, ["id"])])
    assert bag(KG(spark, m).match("?s", E.name, "?n")) == [
        ("http://e/d/10", "A B"), ("http://e/d/12", "C"), ("http://e/p/1", "Ann"), ("http://e/p/3", "Cid")]


def test_problems_of_a_mapping(spark):
    bad = Mapping([TriplesMap("#A", "people", "http://e/{id}/{no}", [], {E.x: ColumnObj("gone"), E.y: RefObj("#Z", [("dept", "id")])}),
                   TriplesMap("#B", "nowhere", "http://e/{id}")])
    assert KG(spark, bad, tables=tables(spark)).problems() == [
        "#A: no parent map #Z", "#A: no column no", "#A: no column gone", "#B: source cannot be read (KeyError)"]
    assert kg(spark).problems() == []


def test_keyless_triples_of_two_maps(spark):
    """The same triples from two maps, and equal rows of one, are one each."""
    twice = Mapping(list(MAPPING.maps) + [TriplesMap("#W2", "works", "http://e/w/{p}/{w}", [E.Work], {E.hours: ColumnObj("hours", XSD.decimal)})])
    t = KG(spark, twice, tables=tables(spark)).triples(classes=[E.Work])
    assert t.count() == t.distinct().count() == 4
    assert {r.o_dt for r in t.where(f"p = '{E.hours}'").collect()} == {XSD.decimal}


def test_same_row_link_to_a_map_of_another_table(spark):
    """Nothing says that the linked IRI is a subject of the other map, so its class is checked."""
    m = Mapping([TriplesMap("#A", "people", "http://e/p/{id}", [], {E.to: RefObj("#D", [])}, ["id"]),
                 TriplesMap("#D", "depts", "http://e/x/{id}", [E.Dept], {}, ["id"])])
    k = KG(spark, m, tables=tables(spark))
    assert len(bag(k.match("?a", E.to, "?d"))) == 3
    assert bag(k.bgp([("?a", E.to, "?d"), ("?d", RDF.type, E.Dept)])) == []


def test_typed_literals_from_text(spark):
    """A value outside its datatype gives no triple."""
    rows = spark.createDataFrame([(1, "true", "300", "12:30:00", "-P1Y2M"), (2, "yes", "12", "noon", "P")],
                                 "id int, b string, u string, t string, d string")
    m = Mapping([TriplesMap("#A", "a", "http://e/{id}", [], {
        E.b: ColumnObj("b", XSD.boolean), E.u: ColumnObj("u", XSD.unsignedByte), E.t: ColumnObj("t", XSD.time),
        E.d: ColumnObj("d", XSD.duration), E.h: ColumnObj("b", XSD.hexBinary)}, ["id"])])
    k = KG(spark, m, tables={"a": rows})
    assert bag(k.match("?s", E.b, "?o")) == [("http://e/1", True)]
    assert bag(k.match("?s", E.u, "?o")) == [("http://e/2", 12)]
    assert bag(k.match("?s", E.t, "?o")) == [("http://e/1", "12:30:00")]
    assert bag(k.match("?s", E.d, "?o")) == [("http://e/1", "-P1Y2M")]
    assert bag(k.match("?s", E.h, "?o")) == []


def test_links_of_a_map_without_a_key_are_distinct_by_their_keys(spark):
    """Text is made of what is left: the links of the map are grouped by the keys of both ends."""
    from kgqueries.graphs import full_graph, full_mapping
    from tests.conftest import SMALL
    found = full_graph(spark, SMALL, full_mapping(spark))
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    groups = [line for line in plan if "Aggregate [" in line]
    assert any("__s0" in keys and "__o0" in keys for keys in (line.split("], [")[0] for line in groups))


def test_key_columns_are_moved_once(spark):
    """A map without a key: what the subject's keys hold is made of them again, with its type."""
    rows = [(1, "a b", 2.5, date(2020, 1, 2), 7), (1, "a b", 2.5, date(2020, 1, 2), 8), (1, "a b", 3.5, date(2020, 1, 2), 7),
            (-2, "c", None, None, None), (None, "c", 1.5, date(2020, 1, 3), 9), (3, "d", -0.0, date(2020, 1, 3), None)]
    notes = spark.createDataFrame(rows, "k smallint, `n.o` string, x double, d date, z bigint")
    m = Mapping([TriplesMap("#N", "notes", "http://e/n/{k}/{n.o}/{z}", [E.Note], {
        E.k: ColumnObj("k"), E.kk: ColumnObj("k", XSD.decimal), E.no: ColumnObj("n.o"), E.x: ColumnObj("x"), E.d: ColumnObj("d"),
        E.at: TemplateObj("http://e/{k}"), E.both: TemplateObj("{n.o} {d}", XSD.string)}),
        TriplesMap("#D", "notes", "http://e/d/{d}/{k}", [], {E.day: ColumnObj("d"), E.k: ColumnObj("k"), E.x: ColumnObj("x")})])
    found = KG(spark, m, tables={"notes": notes}).triples()
    want = set()
    for k, no, x, d, z in rows:
        ends = [(E.k, k), (E.kk, f"{k}.0000000000"), (E.no, no), (E.x, x), (E.d, d), (E.at, f"http://e/{k}"), (E.both, d and f"{no} {d}"), (RDF.type, E.Note)]
        s = f"http://e/n/{k}/{no.replace(' ', '%20')}/{z}"
        want |= {(s, str(p), str(o)) for p, o in ends if o is not None and k is not None and z is not None}
        want |= {(f"http://e/d/{d}/{k}", str(p), str(o)) for p, o in [(E.day, d), (E.k, k), (E.x, x)] if o is not None and k is not None and d is not None}
    got = [(r.s, r.p, r.o) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    dts = {r.p: r.o_dt for r in found.where("p IN ('http://e/k', 'http://e/kk')").collect()}
    assert dts == {str(E.k): str(XSD.integer), str(E.kk): str(XSD.decimal)}
    lines = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    moved = [lines[i + 1].split("[", 1)[1] for i, line in enumerate(lines) if "RepartitionByExpression [" in line]
    assert len(moved) == 2 and not any(re.search(r"(?:^|, )(?:k|n\.o|z)#\d+L?(?:,|\])", cols) for cols in moved), moved
