import random

import pytest

from pyspark.sql import functions as F

from kgspark import IRI, graph, path
from kgspark.operators import closure as closures
from kgspark.operators.closure import closure, connected, reach_counts
from kgspark.operators.cycles import strong_components
from tests.helpers import triples

EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "x"), ("e", "d")]


def reach(edges):
    out = set(edges)
    while True:
        more = out | {(a, d) for a, b in out for c, d in edges if b == c}
        if more == out:
            return out
        out = more


@pytest.fixture(scope="module")
def g(spark):
    return graph(triples(spark, [(s, "http://p", o) for s, o in EDGES] + [("a", "http://q", "e")]))


def pairs(b):
    def text(v):
        return v if isinstance(v, str) else v["value"]
    return sorted(tuple(text(r[n]) for n in b.names) for r in b.df.collect())


P = IRI("http://p")


def test_closure_of_a_cyclic_graph(spark):
    df = spark.createDataFrame(EDGES, "src string, dst string")
    nodes = {n for e in EDGES for n in e}
    assert {tuple(r) for r in closure(df).collect()} == reach(EDGES)
    assert sorted(tuple(r) for r in closure(df, reflexive=True).collect()) == sorted(reach(EDGES) | {(n, n) for n in nodes})
    assert {tuple(r) for r in closure(df, max_depth=2).collect()} == set(EDGES) | {
        (a, d) for a, b in EDGES for c, d in EDGES if b == c}
    some = spark.createDataFrame([("b",)], "src string")
    assert {tuple(r) for r in closure(df, sources=some).collect()} == {p for p in reach(EDGES) if p[0] == "b"}


def test_open_paths(g):
    nodes = {n for e in EDGES for n in e}
    assert pairs(g.match("?s", path.plus(P), "?o")) == sorted(reach(EDGES))
    assert pairs(g.match("?s", path.star(P), "?o")) == sorted(reach(EDGES) | {(n, n) for n in nodes})
    assert pairs(g.match("?s", path.opt(P), "?o")) == sorted(set(EDGES) | {(n, n) for n in nodes})


def test_bound_ends(g):
    assert pairs(g.match(IRI("b"), path.plus(P), "?o")) == sorted((o,) for s, o in reach(EDGES) if s == "b")
    assert pairs(g.match("?s", path.plus(P), IRI("d"))) == sorted((s,) for s, o in reach(EDGES) if o == "d")
    assert pairs(g.match("?s", path.star(P), IRI("nowhere"))) == [("nowhere",)]
    assert pairs(g.match("?s", path.plus(P), "?s")) == [("a",), ("b",), ("c",), ("x",)]


def test_fixed_lengths_keep_duplicates(g):
    two = sorted((a, d) for a, b in EDGES for c, d in EDGES if b == c)
    assert pairs(g.match("?s", path.repeat(P, 2, 2), "?o")) == two
    assert pairs(g.match("?s", path.repeat(P, 1, 2), "?o")) == sorted(two + EDGES)
    assert pairs(g.match("?s", path.repeat(P, 1, 2, distinct=True), "?o")) == sorted(set(two + EDGES))


def test_inverse_sequence_alternative(g):
    assert pairs(g.match("?s", path.inv(P), "?o")) == sorted((o, s) for s, o in EDGES)
    assert pairs(g.match("?s", path.seq(IRI("http://q"), P), "?o")) == [("a", "d")]
    assert pairs(g.match("?s", path.alt(P, IRI("http://q")), "?o")) == sorted(EDGES + [("a", "e")])


def plain_components(edges):
    to = reach(edges)
    return {n: min(m for m in {x for e in edges for x in e} if m == n or ((n, m) in to and (m, n) in to)) for e in edges for n in e}


def random_graphs():
    """Small graphs of all kinds: sparse and dense, chains, rings with chords, loops, rings on rings."""
    rng = random.Random(3)
    out = [[(k, (k + 1) % 7) for k in range(7)], [(1, 1)], [(1, 2), (2, 1), (2, 3), (3, 2), (3, 3)],
           [(k, k + 1) for k in range(12)] + [(5, 2), (9, 7)], [(0, 1), (1, 2), (2, 0), (0, 3), (3, 4), (4, 0), (4, 5), (5, 6)]]
    for n, m in ((6, 7), (12, 14), (12, 20), (16, 40), (25, 27)):
        out.append([(rng.randrange(n), rng.randrange(n)) for _ in range(m)])
    return out


def test_strong_components(spark):
    """Many graphs side by side, as one with disjoint nodes."""
    edges = [(1000 * g + a, 1000 * g + b) for g, part in enumerate(random_graphs()) for a, b in part]
    got = {r.node: r.root for r in strong_components(spark.createDataFrame(edges + edges[:3] + [(None, 1), (2, None)], "src bigint, dst bigint")).collect()}
    want = {}
    for g, part in enumerate(random_graphs()):
        want |= {1000 * g + k: 1000 * g + v for k, v in plain_components(part).items()}
    assert all(got[root] == root for root in got.values())
    groups = {}
    for n, root in got.items():
        groups.setdefault(root, set()).add(n)
    plain = {}
    for n, root in want.items():
        plain.setdefault(root, set()).add(n)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in plain.values() if len(g) > 1)


def test_closures_of_condensed_graphs(spark, monkeypatch):
    monkeypatch.setattr(closures, "GROWTH", 0)
    edges = [(1000 * g + a, 1000 * g + b) for g, part in enumerate(random_graphs()) for a, b in part]
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    to = set().union(*[{(1000 * g + a, 1000 * g + b) for a, b in reach(part)} for g, part in enumerate(random_graphs())])
    got = [tuple(r) for r in closure(df).collect()]
    assert len(got) == len(to) and set(got) == to
    counts = {r.node: r.reached for r in reach_counts(df).collect()}
    assert counts == {n: len([1 for a, _ in to if a == n]) for e in edges for n in e}


def test_a_long_cycle_with_a_tail(spark, monkeypatch):
    """10,000 nodes round and a tail of 40: few rounds, and no pair of two nodes of the cycle is written."""
    n, rounds = 10_000, []
    for module in ("kgspark.operators.closure", "kgspark.operators.cycles"):
        import importlib
        m = importlib.import_module(module)
        monkeypatch.setattr(m, "materialize", lambda df, f=m.materialize: rounds.append(f(df)) or rounds[-1])
    edges = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst")).union(
        spark.range(40).select(F.when(F.col("id") == 0, 5).otherwise(n + F.col("id") - 1).alias("src"), (n + F.col("id")).alias("dst")))
    counts = reach_counts(edges).groupBy("reached").count().collect()
    assert {r["reached"]: r["count"] for r in counts} == {n + 40: n} | {k: 1 for k in range(40)}
    assert len(rounds) < 45 and max(df.count() for df in rounds) <= 2 * n
    assert closure(edges).where("src = 17").count() == n + 40


def test_strong_components_without_near_pairs(spark, monkeypatch):
    """No round of pairs is allowed, so that components are told apart by their greatest nodes."""
    from kgspark.operators import cycles
    monkeypatch.setattr(cycles, "GROWTH", 0)
    test_strong_components(spark)


def test_a_tree_of_cycles_takes_few_rounds(spark, monkeypatch):
    """Cycles of four nodes, each with a way into that of half its number: rounds do not follow the depth of the tree."""
    from kgspark.operators import cycles
    rounds = []
    monkeypatch.setattr(cycles, "materialize", lambda df, f=cycles.materialize: rounds.append(1) and None or f(df))
    n = 511
    ring = spark.range(4 * n).select(F.col("id").alias("src"), F.expr("id DIV 4 * 4 + (id + 1) % 4").alias("dst"))
    up = spark.range(1, n).select((4 * F.col("id") + 1).alias("src"), F.expr("id DIV 2 * 4 + id % 2 * 2").alias("dst"))
    parts = strong_components(ring.union(up)).groupBy("root").agg(F.count("*").alias("n"), F.expr("max(node DIV 4) = min(node DIV 4)").alias("one"))
    assert [tuple(r) for r in parts.groupBy("n", "one").count().collect()] == [(4, True, n)]
    assert len(rounds) < 50


def test_both_ends_bound(spark, g):
    def ask(s, o, p=path.plus):
        return g.match(IRI(s), p(P), IRI(o)).ask().collect()[0][0]
    assert ask("a", "d") and ask("a", "a") and ask("x", "x") and ask("e", "d")
    assert not ask("d", "a") and not ask("e", "e") and not ask("a", "nowhere") and not ask("nowhere", "a")
    assert ask("e", "e", path.star)
    # The target is reached backwards over one edge; what fans out from the source is not walked through.
    fan = spark.range(1, 3000).select(F.floor(F.col("id") / 3).alias("src"), F.col("id").alias("dst"))
    fan = fan.union(spark.createDataFrame([(0, 10**6), (10**6, 10**6 + 1)], "src bigint, dst bigint"))
    met, followed = connected(fan, lambda c: c == 0, lambda c: c == 10**6 + 1)
    assert met and followed < 10
    met, followed = connected(fan, lambda c: c == 1, lambda c: c == 10**6 + 1)
    assert not met and followed < 20
