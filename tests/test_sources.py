import json

import pytest
from pyspark.sql import functions as F

from kgspark import IRI, Lit, agg
from kgspark.plans.bindings import inline
from kgspark.sources import ntriples as nt
from kgspark.sources import prefixes as px
from kgspark.sources.sparql_json import untyped_binding_json
from tests.helpers import T_DDL

LINES = [
    "# a comment", "", "   ",
    '<http://s> <http://p> "plain" .',
    r'<http://s> <http://p> "q\" \\ \n \t é \U0001F600 \\U0001F600"@en-GB .',
    '_:b1 <http://p> _:b2 .',
    '<http://s> <http://p> "5"^^<http://www.w3.org/2001/XMLSchema#integer> <http://g> . # why',
    r'<http://é> <http://p> <http://o> .',
]


def lines(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_read_statements(spark):
    rows = {r.o: r for r in nt.parse_ntriples(lines(spark, LINES)).collect()}
    assert rows["plain"].o_dt.endswith("#string") and rows["plain"].g is None
    tagged = next(r for r in rows.values() if r.o_lang)
    assert tagged.o == 'q" \\ \n \t é 😀 \\U0001F600' and tagged.o_lang == "en-GB" and tagged.o_dt is None
    assert (rows["b2"].s, rows["b2"].s_kind, rows["b2"].o_kind) == ("b1", "bnode", "bnode")
    assert rows["5"].g == "http://g" and rows["5"].o_dt.endswith("#integer")
    assert rows["http://o"].s == "http://é"


@pytest.mark.parametrize("bad", ["<http://s> <http://p> .", '<http://s> "p" <http://o> .', "nonsense", '<http://s> <http://p> "a"b" .',
                                 "<http://s> <http://p> <http://o>"])
def test_malformed(spark, tmp_path, bad):
    rows = nt.parse_lines(lines(spark, [*LINES, bad])).collect()
    assert [r.bad_line for r in rows if r.bad_line] == [bad] and all(r.s for r in rows if not r.bad_line)
    with pytest.raises(Exception, match="malformed statement"):
        nt.parse_ntriples(lines(spark, [bad])).collect()
    path = tmp_path / "x.nt"
    path.write_text(bad + "\n" + LINES[3] + "\n")
    assert nt.read_ntriples(spark, str(path), keep_bad_lines=True).where("bad_line IS NULL").count() == 1


def test_missing_file_is_unavailable(spark, tmp_path):
    assert nt.read_ntriples(spark, str(tmp_path / "none.nt")) is None


def test_round_trip(spark, tmp_path):
    text = 'a "b" \\ c\r\nd\te 😀 <x> ' + "long \\\" " * 5000
    rows = [("http://s", "iri", "http://p q", text, "literal", "http://www.w3.org/2001/XMLSchema#string", None),
            ("b0", "bnode", "http://p", "x", "literal", None, "fr"), ("http://s", "iri", "http://p", "b0", "bnode", None, None),
            ("http://s", "iri", "http://p", "1.5", "literal", "http://www.w3.org/2001/XMLSchema#decimal", None)]
    df = spark.createDataFrame(rows, T_DDL)
    nt.write_ntriples(df, str(tmp_path / "out"))
    back = nt.read_ntriples(spark, str(tmp_path / "out"))
    key = lambda r: tuple(x or "" for x in r)
    assert sorted((tuple(r) for r in back.drop("g").collect()), key=key) == sorted(rows, key=key)


def found(bindings):
    return [json.loads(r.json) for r in bindings.to_sparql_json().collect()]


def test_results_json(spark, tmp_path):
    b = inline(spark, ["c", "name"], [(IRI("http://c/1"), "Ann"), (IRI("http://c/2"), None)])
    assert sorted(found(b), key=str) == sorted([
        {"c": {"type": "uri", "value": "http://c/1"},
         "name": {"type": "literal", "value": "Ann", "datatype": "http://www.w3.org/2001/XMLSchema#string"}},
        {"c": {"type": "uri", "value": "http://c/2"}}], key=str)
    b.write_sparql_json(str(tmp_path / "r"))
    assert json.loads(spark.read.text(str(tmp_path / "r" / "head")).first().value) == {"vars": ["c", "name"]}
    assert spark.read.text(str(tmp_path / "r" / "bindings")).count() == 2


def test_results_json_terms(spark):
    b = inline(spark, "v", [Lit("x", lang="en"), True, IRI("http://i")])
    got = {json.dumps(x["v"], sort_keys=True) for x in found(b)}
    assert json.dumps({"type": "literal", "value": "x", "xml:lang": "en"}, sort_keys=True) in got
    assert json.dumps({"type": "literal", "value": "true", "datatype": "http://www.w3.org/2001/XMLSchema#boolean"}, sort_keys=True) in got
    assert found(inline(spark, "v", [1]).filter(lambda r: r.v > 1).agg(m=agg.max("v"))) == [{}]


def test_rows_without_types_are_plain_literals(spark):
    df = spark.createDataFrame([("http://c/1", "Ann")], "c string, name string")
    plain = json.loads(untyped_binding_json(df).first().json)
    assert plain == {"c": {"type": "literal", "value": "http://c/1"}, "name": {"type": "literal", "value": "Ann"}}
    typed = json.loads(untyped_binding_json(df, {"c": "IRI", "name": "xsd:string"}).first().json)
    assert typed["c"]["type"] == "uri" and typed["name"]["datatype"].endswith("#string")


def test_prefixes(spark):
    text = "\n".join(["PREFIX ex: <http://one/>", "@prefix ex: <http://two/> .", "@prefix  : <http://empty/>.", "prefix foaf: <http://f/>",
                      "PREFIX foaf: <http://late/>", "@base <http://base/> .", " @prefix a-b.c: <http://indented/> .", "@prefix ex: <http://three/> .",
                      "BASE <http://later/>", "@prefix open: <http://no-full-stop/>", "@prefix bad: <http://two words/> .", "prefixed: <http://x/>"])
    rows = px.extract_prefixes(spark.createDataFrame([(1, text), (2, "none")], "doc_id int, text string")).collect()
    assert {(r.doc_id, r.prefix): r.iri for r in rows} == {
        (1, "ex"): "http://three/", (1, ""): "http://empty/", (1, "foaf"): "http://f/", (1, "base"): "http://base/",
        (1, "a-b.c"): "http://indented/"}


def test_compact_expand_and_map_ids(spark):
    known = {"ex": "http://example.org/", "exx": "http://example.org/x/"}
    rows = [("http://example.org/x/a", "ex:x/a"), ("http://o/#frag", "<#frag>"), ("http://o/x", "http://o/x"), ("", "")]
    df = spark.createDataFrame(rows, "iri string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", px.compact_iri(F.col("iri"), known)).collect())
    rows = [("ex:a:b", "http://example.org/a:b"), ("<http://x>", "http://x"), ("zz:a", "zz:a"), ("plain", "plain"), ("ex:", "http://example.org/")]
    df = spark.createDataFrame(rows, "c string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", px.expand_curie(F.col("c"), known)).collect())
    rows = [("main.sales.orders", "#main.sales.orders"), ("a b#<>", "#a%20b%23%3C%3E"), ("it's (*)!", "#it%27s%20%28%2A%29%21"), ("", "#Map"), (None, "#Map")]
    df = spark.createDataFrame(rows, "n string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", px.map_id(F.col("n"))).collect())
