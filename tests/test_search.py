import random

import pytest

from kgspark import OWL, RDF, RDFS, SKOS
from kgspark.operators import search
from tests.helpers import triples

E = "http://e/"


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def score(q, t):
    a, b = set(q.split(" ")) - {""}, set(t.split(" ")) - {""}
    words = len(a & b) / min(len(a), len(b)) if a and b else 0.0
    return round(100 * max(1 - lev(q, t) / max(len(q), len(t)), 0.95 * words), 4)


def part_score(q, t):
    a, b = q.split(), t.split()
    runs = [" ".join(b[k:k + len(a)]) for k in range(len(b) - len(a) + 1)] if len(b) > len(a) else []
    return max([score(q, t), *[round(90 * (1 - lev(q, r) / max(len(q), len(r))), 4) for r in runs]])


def best_of(index, q, limit, scorer):
    best = {}
    for iri, t in index:
        best[iri] = max(best.get(iri, 0.0), scorer(q, t))
    return [(k + 1, iri, pytest.approx(s, abs=1e-3)) for k, (iri, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:limit])]


@pytest.mark.parametrize("partial", [False, True])
@pytest.mark.parametrize("limit", [1, 4, 200])
def test_best_terms_equal_brute_force(spark, limit, partial):
    """Queries with near, far and no texts at all, of one letter, with repeated words and letters; ties by IRI."""
    rng = random.Random(5)
    words = ["order", "line", "item", "part", "supplier", "customer", "price", "of", "a", "aaaa"]
    index = [(f"{E}{rng.randrange(40)}", " ".join(rng.choices(words, k=rng.randint(1, 6)))) for _ in range(120)]
    index += [(f"{E}x{k}", "same text") for k in range(9)] + [(E + "z", "q")]
    queries = ["line item", "custmer", " order price ", "zzz", "supplier", "a", "aaaaaa a", "same  text", "xq", "prt of suplier lne", "of of of"]
    got = search.fuzzy_search(spark.createDataFrame([(q,) for q in queries + ["", "  ", "zzz"]], "query string"),
                              spark.createDataFrame(index, "iri string, text string"), limit, partial=partial).collect()
    for q in {q.strip() for q in queries}:
        mine = sorted((r.rank, r.iri, r.score) for r in got if r.query == q)
        assert best_of(index, q, limit, part_score if partial else score) == mine, q
    assert {r.query for r in got} == {q.strip() for q in queries}


def test_few_pairs_are_scored(spark):
    """Of all pairs of queries and texts of the part catalog less than one in twenty is scored."""
    from kgqueries.checks import catalog_tbox
    from tests.conftest import SMALL
    folder = SMALL.replace("sf0.001", "sf0.01")
    asked = spark.read.parquet(f"{folder}/part.parquet").selectExpr("replace(p_name, 'i', 'y') AS query")
    s = search._Search(asked, search.search_index(catalog_tbox(spark, folder)), 5, False, False)
    seeds = s.scored(s.seeds())
    bound = search._best(seeds, 5).where("rank = 5").selectExpr("query", "score AS bound")
    pairs, rest = s.candidates(bound)
    every = s.asked.count() * s.texts.count()
    assert rest.isEmpty() and 0 < pairs.count() + seeds.count() < every / 20


def tbox(spark):
    return triples(spark, [
        (E + "Customer", RDF.type, OWL.Class), (E + "Customer", RDFS.label, '"Customer'), (E + "Customer", SKOS.altLabel, '"Buyer'),
        (E + "Widget", RDF.type, OWL.Class), (E + "Widget", RDFS.comment, '"sprocket used in assembly lines'),
        (E + "Bare", RDF.type, OWL.Class), (E + "Blank", RDF.type, OWL.Class), (E + "Blank", RDFS.label, '"  '),
        (E + "thing", RDF.type, E + "Own"), (E + "buys", RDF.type, OWL.ObjectProperty), (E + "buys", RDFS.label, '"buys'),
        (E + "buys", RDFS.domain, E + "Customer"), (E + "boughtBy", OWL.inverseOf, E + "buys"), (E + "boughtBy", RDFS.label, '"bought by'),
        (E + "note", E + "mentions", E + "Customer")])


def test_index(spark):
    got = {(r.iri[len(E):], r.text) for r in search.search_index(tbox(spark)).collect()}
    assert got == {("Customer", "Customer"), ("Widget", "sprocket used in assembly lines"), ("Bare", E + "Bare"), ("Blank", E + "Blank"),
                   ("buys", "buys"), ("boughtBy", "bought by")}


def test_limit_is_at_least_one_and_case_is_kept(spark):
    q = spark.createDataFrame([("sprocket assembly",), ("CUSTOMER",)], "query string")
    index = search.search_index(tbox(spark))
    got = {r.query: r for r in search.fuzzy_search(q, index, 0).collect()}
    assert got["sprocket assembly"].iri == E + "Widget" and got["sprocket assembly"].score == 95.0
    folded = {r.query: r for r in search.fuzzy_search(q, index, 1, ignore_case=True).collect()}
    assert folded["CUSTOMER"].score == 100.0 and got["CUSTOMER"].score < 100


def test_expand_and_describe(spark):
    t = tbox(spark)
    hits = spark.createDataFrame([(E + "Customer",)], "iri string")
    assert {(r.p, r.o) for r in search.expand_terms(hits, t).collect()} == {(str(RDF.type), str(OWL.Class)), (str(RDFS.label), "Customer")}
    got = {(r.s[len(E):], r.p) for r in search.describe_terms(hits, t).collect()}
    assert got == {("Customer", str(RDF.type)), ("Customer", str(RDFS.label)), ("Customer", str(SKOS.altLabel)),
                   ("buys", str(RDFS.domain)), ("buys", str(RDFS.label)), ("buys", str(RDF.type))}
    short = spark.createDataFrame([("Customer",)], "iri string")
    assert search.describe_terms(short, t).count() == 0


def test_term_index(spark):
    from pyspark.sql import functions as F
    t = tbox(spark).withColumn("active", F.col("s") != E + "Bare")
    assert [(r.kind, r.iri[len(E):]) for r in search.term_index(t).collect()] == [
        ("class", "Blank"), ("class", "Customer"), ("class", "Widget"), ("property", "buys")]
