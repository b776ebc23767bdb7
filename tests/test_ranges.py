import random
import warnings

import pytest

from pyspark.sql import functions as F

from kgspark import IRI, fn, graph
from kgspark.operators import ranges
from tests.helpers import triples


def values(seed, n, kind):
    rng = random.Random(seed)
    number = lambda: rng.choice([rng.randrange(50), rng.randrange(5000), 7, 7, 7])
    out = [None if rng.random() < 0.05 else number() for _ in range(n)]
    if kind == "string":
        return [v if v is None else f"{v:x}é" for v in out]
    return out


@pytest.mark.parametrize("leaf_rows", [2048, 3])
@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_equals_all_pairs(spark, monkeypatch, leaf_rows, kind):
    """Open and closed intervals, empty and reversed ones, ties, nulls; few and many ranges."""
    monkeypatch.setattr(ranges, "LEAF_ROWS", leaf_rows)
    xs, lows, highs = values(1, 150, kind), values(2, 130, kind), values(3, 130, kind)
    points = spark.createDataFrame([(k, x) for k, x in enumerate(xs)], f"a bigint, x {kind}")
    spans = spark.createDataFrame([(k, lo, hi) for k, (lo, hi) in enumerate(zip(lows, highs))], f"b bigint, lo {kind}, hi {kind}")
    x, lo, hi = F.col("x"), F.col("lo"), F.col("hi")
    for on, low, high, holds in (
            (x > lo, lo, None, lambda v, p, q: p is not None and v > p), (x <= hi, None, hi, lambda v, p, q: q is not None and v <= q),
            ((x >= lo) & (x < hi), lo, hi, lambda v, p, q: p is not None and q is not None and p <= v < q)):
        got = ranges.range_join(points, spans, x, on, low, high)
        assert got.columns == ["a", "x", "b", "lo", "hi"]
        want = sorted((i, j) for i, v in enumerate(xs) for j, (p, q) in enumerate(zip(lows, highs)) if v is not None and holds(v, p, q))
        assert sorted((r.a, r.b) for r in got.collect()) == want
    assert ranges.range_join(points.limit(0), spans, x, x > lo, lo).collect() == []


def test_rows_that_are_shuffled(spark, monkeypatch):
    """A narrow band over 4,000 values: rows are copied as often as there are levels, not as there are rows."""
    monkeypatch.setattr(ranges, "LEAF_ROWS", 32)
    points = spark.range(4000).select(F.col("id").alias("x"))
    spans = spark.range(4000).select(F.col("id").alias("y"))
    left, right = ranges.sides(points, spans, F.col("x"), F.col("y") - 2, F.col("y") + 2)
    assert left.count() <= 4000 * 9 and right.count() <= 4000 * 2
    met = left.join(right, "__node")
    assert met.where("abs(x - y) <= 2").count() == 5 * 4000 - 6 and met.count() < 4000 * 200
    wide = ranges.sides(points, spans, F.col("x"), F.col("y"), None)[1]
    assert wide.count() <= 4000 * 8


def test_filters_over_unconnected_patterns(spark):
    rows = [(f"p{k}", "http://p", f'"{w}') for k, w in enumerate(["b", "a", "dd", "c", "c"])] + [
        (f"q{k}", "http://q", f'"{w}') for k, w in enumerate(["c", "a", "e", "b"])]
    g = graph(triples(spark, rows))
    p, q = g.match("?x", IRI("http://p"), "?p"), g.match("?y", IRI("http://q"), "?q")
    text = {s: o[1:] for s, _, o in rows}
    every = [(a, b) for a in text for b in text if a[0] == "p" and b[0] == "q"]

    def answer(cond):
        with warnings.catch_warnings():
            warnings.simplefilter("error")  # no product is made
            out = p.join(q).filter(cond)
            df = out.select("x", "y").df
        return sorted(tuple(v if isinstance(v, str) else v["value"] for v in r) for r in df.collect())

    assert answer(lambda r: fn.str(r.p) < fn.str(r.q)) == sorted((a, b) for a, b in every if text[a] < text[b])
    assert answer(lambda r: (fn.str(r.q) <= fn.str(r.p)) & (fn.str(r.p) < "d")) == sorted(
        (a, b) for a, b in every if text[b] <= text[a] < "d")
    assert answer(lambda r: (fn.strlen(r.p) >= fn.strlen(r.q)) & (fn.strlen(r.p) <= fn.strlen(r.q) + 0)) == sorted(
        (a, b) for a, b in every if len(text[a]) == len(text[b]))
    met = p.exists(q, where=lambda r: fn.str(r.q) > fn.str(r.p))
    assert sorted(v if isinstance(v, str) else v["value"] for v, in met.select("x").df.collect()) == sorted(
        a for a in text if a[0] == "p" and any(text[a] < text[b] for b in text if b[0] == "q"))
    with pytest.warns(UserWarning, match="share no variable"):
        assert p.join(q).df.count() == 20
