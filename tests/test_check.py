import pytest
from pyspark.sql import functions as F

from kgqueries.checks import INS, insurance_tbox
from kgspark import IRI, KG, OWL, RDF, RDFS, Mapping
from kgspark.operators import check
from kgspark.operators.check import PATTERNS_DDL, Checker, pattern_rows, patterns_df
from tests.helpers import triples

A = RDF.type


def i(name):
    return IRI(INS + name)


UNITS = {
    "wrong direction": ([("?agent", i("soldByAgent"), "?policy"), ("?agent", A, i("Agent"))], {"domain"}),
    "short path": ([("?claim", A, i("Claim")), ("?policy", A, i("Policy")), ("?claim", i("against"), "?policy")], {"range"}),
    "shared object": ([("?claim", i("against"), "?policy"), ("?detail", i("hasPolicy"), "?policy")], {"double_range"}),
    "shared subject": ([("?x", i("soldByAgent"), "?agent"), ("?x", i("against"), "?detail")], {"double_domain"}),
    "chain": ([("?claim", i("against"), "?policy"), ("?policy", i("soldByAgent"), "?agent")], {"domain_range"}),
    "unknown property": ([("?p", A, i("Policy")), ("?p", i("unknownProp"), "?v")], {"incorrect_property"}),
    "valid": ([("?policy", A, i("Policy")), ("?agent", A, i("Agent")), ("?policy", i("soldByAgent"), "?agent")], set()),
    "variable class": ([("?policy", A, "?c"), ("?policy", i("soldByAgent"), "?agent")], {"domain"}),
    "variable predicate": ([("?s", "?p", "?o")], set()),
    "standard property": ([("?s", RDFS.label, "?o")], set()),
}


@pytest.fixture(scope="module")
def checker(spark):
    return Checker(insurance_tbox(spark))


@pytest.fixture(scope="module")
def report(spark, checker):
    rows = None
    for name, (patterns, _) in UNITS.items():
        part = pattern_rows(spark, name, patterns)
        rows = part if rows is None else rows.union(part)
    rows = rows.coalesce(1)
    return rows, checker.all(patterns_df(rows)).collect()


@pytest.mark.parametrize("unit", UNITS)
def test_rules(report, unit):
    assert {r.rule for r in report[1] if r.unit_id == unit} == UNITS[unit][1]


def test_messages_and_bindings(report):
    row = next(r for r in report[1] if r.unit_id == "wrong direction")
    assert row.message == ("The property sold by agent has domain Policy, but its subject ?agent is a Agent, "
                           "which isn't a subclass of Policy.")
    assert row.bindings == {"p": "sold by agent", "domain": "Policy", "s": "?agent", "cls": "Agent"} and row.rule_order == 3


def test_summary_lists_every_unit(report, checker):
    rows, _ = report
    got = {r.unit_id: (r.ok, r.n) for r in checker.summary(rows, patterns_df(rows)).collect()}
    assert got["valid"] == (True, 0) and got["chain"] == (False, 1) and len(got) == len(UNITS)


def test_patterns_inside_optional_and_negation(spark, checker):
    kg = KG(spark, Mapping([]))
    inner = kg.match("?agent", i("soldByAgent"), "?policy")
    for query in (kg.match("?agent", A, i("Agent")).optional(inner), kg.match("?agent", A, i("Agent")).minus(inner),
                  kg.match("?agent", A, i("Agent")).not_exists(inner), kg.match("?agent", A, i("Agent")).union(inner)):
        assert [r.rule for r in checker.all(patterns_df(query.patterns("q"))).collect()] == ["domain"]


def test_subclasses_and_top_classes(spark):
    tbox = triples(spark, [
        (i("covers"), A, OWL.ObjectProperty), (i("covers"), RDFS.domain, RDFS.Resource), (i("owns"), A, OWL.ObjectProperty),
        (i("owns"), RDFS.domain, i("Person")), (i("Child"), RDFS.subClassOf, i("Person")), (i("Baby"), RDFS.subClassOf, i("Child")),
        (i("drives"), A, OWL.ObjectProperty), (i("drives"), RDFS.domain, "_:union"), ("_:union", A, OWL.Class)])
    c = Checker(tbox)
    rows = pattern_rows(spark, "ok", [("?x", i("owns"), "?y"), ("?x", A, i("Baby")), ("?x", i("covers"), "?z"), ("?x", i("drives"), "?w")])
    rows = rows.union(pattern_rows(spark, "bad", [("?x", i("owns"), "?y"), ("?x", A, i("Car"))]))
    assert {(r.unit_id, r.rule) for r in c.all(patterns_df(rows)).collect()} == {("bad", "domain")}


def test_literals_of_two_types_are_two_nodes(spark):
    t = triples(spark, [("s1", i("against"), '"5'), ("s2", i("hasPolicy"), '"5')])
    other = t.withColumn("o_dt", F.when(F.col("s") == "s1", F.lit("other")).otherwise(F.col("o_dt")))
    c = Checker(insurance_tbox(spark))
    assert c.double_range(check.instance_patterns(t, F.lit("g"))).count() == 1
    assert c.double_range(check.instance_patterns(other, F.lit("g"))).count() == 0


def test_a_hot_node_is_counted_not_paired(spark, checker):
    """One object with a third of all statements: pairs are counted, never listed."""
    n, hot = 30_000, 10_000
    ids = spark.range(n)
    o = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("o"), F.col("id").cast("string")))
    p = F.when(F.col("id") % 2 == 0, F.lit(i("against"))).otherwise(F.lit(i("hasPolicy")))
    rows = ids.select(F.lit("g").alias("unit_id"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("s"),
                      F.lit("iri").alias("s_kind"), p.cast("string").alias("p"), o.alias("o"), F.lit("iri").alias("o_kind"))
    assert checker.facts(rows).where("node = 'hot'").count() == 2  # one row per property
    got = checker.double_range(rows).collect()
    assert [(r.p, r.q, r.n) for r in got] == [(i("against"), i("hasPolicy"), (hot // 2) ** 2)]


def test_counts(spark, checker):
    rows = spark.createDataFrame([("u", f"s{k}", "iri", str(i(p)), "o", "iri") for k, p in enumerate(["against", "against", "hasPolicy"])],
                                 "unit_id string, s string, s_kind string, p string, o string, o_kind string")
    assert checker.double_range(rows).first().n == 2
    # As many statements as no bigint can count the pairs of.
    many = check.Checker(checker.tbox)
    plain = many.facts
    many.facts = lambda patterns, roles: plain(patterns, roles).withColumn("n", F.col("n") * 4_000_000_000)
    assert many.double_range(rows).first().n == 2 * 4_000_000_000 ** 2
    assert many.summary(rows, rows).first().n == 2 * 4_000_000_000 ** 2


def test_without_an_ontology_nothing_passes(spark):
    rows = spark.createDataFrame([("u", "x", "var", "p", "iri", "y", "var")], PATTERNS_DDL)
    assert [(r.unit_id, r.rule) for r in check.not_available(rows).collect()] == [("u", "not_available")]


@pytest.mark.parametrize("reasoning", [False, True])
def test_graphs_are_counted_from_their_tables(spark, reasoning):
    """The same violations as from all statements of the graph, written out."""
    from kgqueries.checks import misfit_tbox
    from kgqueries.model import order_graph
    from tests.conftest import SMALL
    kg, c = order_graph(spark, SMALL, reasoning=reasoning), check.Checker(misfit_tbox(spark))
    written = check.instance_patterns(kg.triples(), F.lit("shop")).cache()
    counted = check.GraphPatterns(kg, "shop")
    for rule in ("double_domain", "domain_range", "domain", "range", "double_range", "incorrect_property"):
        want = sorted(map(tuple, getattr(c, rule)(written).collect()))
        assert sorted(map(tuple, getattr(c, rule)(counted).collect())) == want, rule
    written.unpersist()


def test_only_statements_that_may_be_wrong_are_read(spark):
    """Of a mapped graph: one table here, a row per node and use, without text and without a join."""
    from kgqueries.checks import misfit_tbox
    from kgqueries.model import order_graph
    from tests.conftest import SMALL
    c, graph = check.Checker(misfit_tbox(spark)), check.GraphPatterns(order_graph(spark, SMALL, reasoning=False), "shop")
    for rule in (c.domain, c.double_domain):
        found = rule(graph)
        assert {f.rsplit("/", 1)[-1] for f in found.inputFiles()} == {"orders.parquet"}
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
