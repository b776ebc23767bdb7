import datetime
import random
from decimal import Decimal

import pytest

from kgspark import KG, XSD, ColumnObj, Lit, Mapping, NotUniquelyTyped, TriplesMap, agg, desc, fn
from kgspark.plans.bindings import inline
from kgspark.terms import IRI
from tests.helpers import (as_dicts, bag, brute_exists, brute_join, brute_minus, brute_optional, rows_of, solutions)

A, B = ["x", "y", "a"], ["x", "y", "b"]


def cell(rng):
    return rng.choice([None, 1, 2, 3])


def sides(spark, seed):
    rng = random.Random(seed)
    left = [(cell(rng), cell(rng), i) for i in range(9)]
    right = [(cell(rng), cell(rng), i) for i in range(7)]
    return left, right, solutions(spark, A, left), solutions(spark, B, right)


@pytest.mark.parametrize("seed", range(2))
def test_joins_with_unbound_variables(spark, seed):
    left, right, a, b = sides(spark, seed)
    da, db, names = as_dicts(A, left), as_dicts(B, right), ["x", "y", "a", "b"]
    assert bag(a.join(b)) == rows_of(brute_join(da, db), names)
    assert bag(a.optional(b)) == rows_of(brute_optional(da, db), names)
    assert bag(a.minus(b)) == rows_of(brute_minus(da, db), A)
    assert bag(a.exists(b)) == rows_of(brute_exists(da, db), A)
    assert bag(a.not_exists(b)) == rows_of(brute_exists(da, db, False), A)


def test_three_shared_unbound_variables(spark):
    """Any number of them: right answers, and no more scans of a side."""
    rng = random.Random(9)
    names_a, names_b, all_names = ["x", "y", "z", "a"], ["x", "y", "z", "b"], ["x", "y", "z", "a", "b"]
    left = [(*(rng.choice([None, 1, 2]) for _ in "xyz"), i) for i in range(14)]
    right = [(*(rng.choice([None, 1, 2]) for _ in "xyz"), i) for i in range(12)]
    a, b = solutions(spark, names_a, left), solutions(spark, names_b, right)
    da, db = as_dicts(names_a, left), as_dicts(names_b, right)
    assert bag(a.join(b)) == rows_of(brute_join(da, db), all_names)
    smaller = lambda d: d["b"] < d["a"]
    assert bag(a.optional(b, where=lambda r: r.b < r.a)) == rows_of(brute_optional(da, db, smaller), all_names)
    assert bag(a.minus(b)) == rows_of(brute_minus(da, db), names_a)
    assert bag(a.exists(b)) == rows_of(brute_exists(da, db), names_a)
    firm = lambda q, n: q.filter(lambda r: fn.bound(r.x))
    assert bag(firm(a, "x").optional(firm(b, "x"), where=lambda r: r.b < r.a)) == rows_of(
        brute_optional([d for d in da if "x" in d], [d for d in db if "x" in d], smaller), all_names)
    plan = a.join(b).df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LocalTableScan") + plan.count("Scan ExistingRDD") <= 2
    assert len(a.join(b).branches) == 1 and len(a.optional(b).branches) <= 2


@pytest.mark.parametrize("bound", [True, False])
def test_optional_filter_sees_outer_variables(spark, bound):
    left, right = [(1, 5), (2, 5)], [(1, 4), (1, 6), (2, 9)]
    if not bound:
        left, right = left + [(None, 7), (None, 7), (None, 1)], right + [(None, 2)]
    a, b = solutions(spark, ["x", "a"], left), solutions(spark, ["x", "b"], right)
    if bound:  # the filter shows that the shared variable is bound: one ordinary join
        a, b = a.filter(lambda r: fn.bound(r.x)), b.filter(lambda r: r.x > 0)
        assert not a.branches[0].vars["x"].nullable and not b.branches[0].vars["x"].nullable
    got = bag(a.optional(b, where=lambda r: r.b < r.a))
    assert got == rows_of(brute_optional(as_dicts(["x", "a"], left), as_dicts(["x", "b"], right),
                                         lambda d: d["b"] < d["a"]), ["x", "a", "b"])


def test_minus_and_not_exists_differ_without_shared_variables(spark):
    a, b = solutions(spark, ["x"], [(1,)]), solutions(spark, ["z"], [(1,)])
    assert bag(a.minus(b)) == [(1,)] and bag(a.not_exists(b)) == []
    assert bag(a.not_exists(b.filter(lambda r: r.z > 5))) == [(1,)]


def test_product_keeps_every_pair(spark):
    a = solutions(spark, ["x"], [(i,) for i in range(30)] + [(0,)] * 5)
    b = solutions(spark, ["z"], [(1,), (1,), (2,)])
    got = bag(a.join(b))
    assert len(got) == 35 * 3 and got.count((0, 1)) == 12


def test_union_and_missing_variables(spark):
    a, b = solutions(spark, ["x"], [(1,)]), solutions(spark, ["y"], [(2,), (2,)])
    assert bag(a.union(b)) == rows_of([{"x": 1}, {"y": 2}, {"y": 2}], ["x", "y"])


def test_inline_data_with_open_cells(spark):
    a = solutions(spark, ["x", "y"], [(1, 1), (1, 2), (3, 1)])
    got = bag(a.values(["x", "y"], [(1, None), (3, 1)]))
    assert got == rows_of(brute_join(as_dicts(["x", "y"], [(1, 1), (1, 2), (3, 1)]), [{"x": 1}, {"x": 3, "y": 1}]), ["x", "y"])


def test_inline_duplicates_multiply(spark):
    a = solutions(spark, ["x"], [(1,)]).filter(lambda r: fn.bound(r.x))
    assert bag(a.values("x", [1, 1])) == [(1,), (1,)]


def test_strict_projection(spark):
    mixed = inline(spark, "v", ["unknown", 42], strict=True)
    with pytest.raises(NotUniquelyTyped) as err:
        mixed.select("v")
    assert err.value.var == "v" and err.value.types == ["xsd:integer", "xsd:string"]
    assert bag(inline(spark, "v", ["a", "42"], strict=True)) == [("42",), ("a",)]
    assert bag(mixed.select(t=lambda r: fn.str(r.v))) == [("42",), ("unknown",)]
    assert bag(mixed.filter(lambda r: fn.datatype(r.v) == XSD.integer)) == [(42,)]


def test_if_and_coalesce_must_be_uniquely_typed(spark):
    b = solutions(spark, ["x"], [(1,), (None,)])
    b.strict = True
    with pytest.raises(NotUniquelyTyped):
        b.select(v=lambda r: fn.if_(fn.bound(r.x), r.x, "unknown"))
    with pytest.raises(NotUniquelyTyped):
        b.select(v=lambda r: fn.coalesce(r.x, "unknown"))
    assert bag(b.select(v=lambda r: fn.coalesce(fn.str(r.x), "unknown"))) == [("1",), ("unknown",)]


def test_terms_of_different_datatypes_do_not_join(spark):
    assert bag(inline(spark, "v", [1]).join(inline(spark, "v", [Lit(1, XSD.int)]))) == []
    assert bag(inline(spark, "v", ["a"]).join(inline(spark, "v", [Lit("a", lang="en")]))) == []


def test_three_valued_logic(spark):
    b = solutions(spark, ["x"], [(1,), (None,)])
    rows = {r.x: r for r in b.bind("o", lambda r: (r.x == 1) | (1 / r.x > 5)).bind(
        "n", lambda r: ~(r.x == 1)).bind("t", lambda r: fn.bound(r.x) | (r.x == 9)).df.collect()}
    assert (rows[1].o, rows[1].n, rows[1].t) == (True, False, True)
    assert (rows[None].o, rows[None].n, rows[None].t) == (None, None, None)


def test_errors_are_unbound(spark):
    b = solutions(spark, ["x"], [(0,), (2**63 - 1,)])
    got = bag(b.select(d=lambda r: 1 / r.x, o=lambda r: r.x + 1, c=lambda r: fn.cast(fn.concat("z", fn.str(r.x)), XSD.integer)))
    assert [r[0] for r in got if r[1] == 1] == [None] and any(r[1] is None for r in got) and all(r[2] is None for r in got)


def test_round_halves_up(spark):
    b = inline(spark, "x", [-2.5, 2.5, -0.4])
    assert sorted(r[0] for r in bag(b.select(v=lambda r: fn.round(r.x)))) == [-2.0, 0.0, 3.0]


def test_numbers_at_the_edges(spark):
    b = inline(spark, "x", [1e300, float("inf"), -1e17])
    assert sorted(r[0] for r in bag(b.select(v=lambda r: fn.round(r.x)))) == [-1e17, 1e300, float("inf")]
    low = solutions(spark, ["x"], [(-2**63,), (-5,)])
    assert sorted((r[0] for r in bag(low.select(v=lambda r: fn.abs(r.x)))), key=repr) == [5, None]
    assert sorted((r[0] for r in bag(low.select(v=lambda r: -r.x))), key=repr) == [5, None]


def test_aggregates_over_nothing(spark):
    none = solutions(spark, ["x"], [])
    got = none.agg(n=agg.count("x"), s=agg.sum("x"), a=agg.avg("x"), m=agg.min("x"), g=agg.group_concat("x")).df.first()
    assert (got.n, got.s, got.a, got.m, got.g) == (0, 0, 0, None, "")
    assert none.group_by("x").agg(n=agg.count()).df.count() == 0


def test_sum_of_integers_has_no_bound(spark):
    b = solutions(spark, ["x"], [(2**63 - 1,), (2**63 - 1,), (5,)])
    total = b.agg(s=agg.sum("x"))
    assert total.df.first().s == 2**64 + 3
    assert [r.more for r in total.select(more=lambda r: r.s + 1).df.collect()] == [None]  # an error, not a failure


def test_mixed_values_compare_by_value(spark):
    rows = [(9, 10), (10, 9), (1, Decimal("1.0")), (1, 2.5), (Decimal("3.5"), 3), ("9", "10"), ("a", 5), (IRI("urn:a"), IRI("urn:a")),
            (IRI("urn:a"), "urn:a"), (True, False), (datetime.date(2020, 1, 2), datetime.date(2020, 1, 1))]
    b = inline(spark, ["a", "b"], rows).distinct()  # one frame in which both variables are mixed
    got = b.select("a", "b", lt=lambda r: r.a < r.b, eq=lambda r: r.a == r.b, ne=lambda r: r.a != r.b,
                   same=lambda r: fn.same_term(r.a, r.b)).df.collect()

    def short(cell):
        return cell.value.rstrip("0").rstrip(".") if "." in cell.value else cell.value

    seen = {(short(r.a), short(r.b), r.a.dt == r.b.dt): (r.lt, r.eq, r.ne, r.same) for r in got}
    less, equal, more, error = (True, False, True), (False, True, False), (False, False, True), (None, None, None)
    assert len(got) == len(rows) and [seen[k][:3] for k in (
        ("10", "9", True), ("1", "1", False), ("1", "2.5", False), ("3.5", "3", False), ("a", "5", False),
        ("true", "false", True), ("2020-01-02", "2020-01-01", True))] == [more, equal, less, more, error, more, more]
    assert sorted((r.lt, r.eq) for r in got if (r.a.value, r.b.value) == ("9", "10")) == [(False, False), (True, False)]
    assert seen[("1", "1", False)][3] is False  # equal values, but not the same term
    assert sorted(((r.lt, r.eq) for r in got if r.a.value == "urn:a"), key=repr) == [(None, False), (None, True)]


def test_least_and_greatest_of_mixed_values(spark):
    b = inline(spark, "v", [9, 1, 10, Decimal("10.5"), 2.5, "text", IRI("urn:z")])
    numbers = inline(spark, "v", [9, 1, 10, Decimal("1.5"), 2.5])
    got = b.agg(lo=agg.min("v"), hi=agg.max("v")).df.first()
    assert (got.lo.value, float(got.hi.value)) == ("urn:z", 10.5)
    got = numbers.agg(lo=agg.min("v"), hi=agg.max("v")).df.first()
    assert (got.lo.value, got.hi.value) == ("1", "10")
    assert inline(spark, "v", []).agg(lo=agg.min("v")).df.first().lo is None


def test_order_and_slice(spark):
    b = solutions(spark, ["x"], [(2,), (None,), (1,)])
    assert [r.x for r in b.order_by("x").df.collect()] == [None, 1, 2]
    assert [r.x for r in b.order_by(desc("x")).slice(limit=1, offset=1).df.collect()] == [1]


@pytest.mark.parametrize("offset", [0, 1, 37, 95, 99, 100, 500])
@pytest.mark.parametrize("limit", [0, 1, 10, 200])
def test_deep_slice(spark, monkeypatch, offset, limit):
    from kgspark.plans import bindings
    monkeypatch.setattr(bindings, "DEEP", 0)
    b = solutions(spark, ["x"], [(i * 7 % 100,) for i in range(100)]).order_by("x").slice(limit=limit, offset=offset)
    assert [r.x for r in b.df.collect()] == list(range(100))[offset:offset + limit]


def test_no_task_holds_what_is_skipped(spark):
    """The plan of a deep slice has no limit in it, and reads the rows of the slice by their numbers."""
    b = solutions(spark, ["x"], [(i,) for i in range(20)]).order_by("x")
    deep = b.slice(limit=5, offset=1_000_000).df
    assert deep.collect() == []
    from kgspark.plans.bindings import _slice
    plan = _slice(b.df, 8, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Limit" not in plan and "TakeOrdered" not in plan and "PushedFilters: [IsNotNull(__id), GreaterThanOrEqual(__id" in plan


@pytest.mark.parametrize("offset", [1, 37, 99, 100, 500])
def test_offset_without_limit(spark, offset):
    b = solutions(spark, ["x"], [(i * 7 % 100,) for i in range(100)]).order_by("x").slice(offset=offset)
    assert [r.x for r in b.df.collect()] == list(range(100))[offset:]
    assert "GlobalLimit" not in b.df._jdf.queryExecution().executedPlan().toString()


def test_ask(spark):
    b = solutions(spark, ["x"], [(2,)])
    assert b.ask().first().ask is True and b.filter(lambda r: r.x > 2).ask().first().ask is False


def test_construct_skips_what_is_unbound_or_no_triple(spark):
    b = solutions(spark, ["x", "y"], [(1, None), (1, 2), (1, 2)]).bind("s", lambda r: fn.iri(fn.concat("http://x/", fn.str(r.x))))
    p = IRI("http://p")
    rows = b.construct([("?s", p, "?y"), ("?y", p, "?s"), ("?s", p, "_:n"), ("?s", "?y", "?x")]).collect()
    assert sorted((r.o_kind, r.o) for r in rows if r.o_kind == "literal") == [("literal", "2")]
    assert len({r.o for r in rows if r.o_kind == "bnode"}) == 2  # one per distinct solution


def test_fresh_values_are_evaluated_once(spark):
    kg = KG(spark, Mapping([TriplesMap("#a", "t", "http://a/{k}", [], {IRI("http://p"): ColumnObj("k")}, ["k"])]),
            tables={"t": spark.range(50).withColumnRenamed("id", "k")})
    b = kg.match("?s", IRI("http://p"), "?k").bind("r", lambda r: fn.rand())
    rows = b.bind("again", lambda r: r.r + 0.0).filter(lambda r: r.r > 0.5).df.collect()
    assert rows and all(r.r == r.again and r.r > 0.5 for r in rows)


def test_registered_function(spark):
    from pyspark.sql import functions as F
    fn.register(IRI("http://f/norm"), lambda c: F.trim(F.lower(c)))
    assert bag(inline(spark, "v", [" AbC "]).select(n=lambda r: fn.call(IRI("http://f/norm"), r.v))) == [("abc",)]


def test_rows_stand_under_masks_that_occur(spark):
    """Five variables that may be unbound, three ways of being bound on each side: three copies of a row, not 32."""
    from kgspark.plans import loose
    rng = random.Random(4)
    names = ["u", "v", "w", "x", "y"]
    ways_a, ways_b = [(1, 1, 0, 0, 0), (0, 0, 1, 1, 0), (1, 1, 1, 1, 1)], [(1, 0, 0, 0, 0), (0, 0, 0, 0, 0), (0, 1, 1, 0, 1)]
    left = [(*(rng.choice([1, 2]) if on else None for on in rng.choice(ways_a)), i) for i in range(30)]
    right = [(*(rng.choice([1, 2]) if on else None for on in rng.choice(ways_b)), i) for i in range(25)]
    a, b = solutions(spark, [*names, "a"], left), solutions(spark, [*names, "b"], right)
    da, db = as_dicts([*names, "a"], left), as_dicts([*names, "b"], right)
    assert bag(a.join(b)) == rows_of(brute_join(da, db), [*names, "a", "b"])
    assert bag(a.optional(b)) == rows_of(brute_optional(da, db), [*names, "a", "b"])
    assert bag(a.minus(b)) == rows_of(brute_minus(da, db), [*names, "a"])
    one, other, _, shared = loose._aligned(a.branches[0], b.branches[0])
    lefts, rights, _ = loose._masked(one, other, shared)
    assert lefts.count() == 3 * 30 and rights.where("__slot = 0").count() == 3 * 25


def test_simple_case_mapping_keeps_one_character_for_each(spark):
    texts = ["ßar", "ﬁn ǰ ᾀ", "ΟΔΟΣ", "İz", "Abc", ""]
    b = inline(spark, ["t"], [(t,) for t in texts])
    got = {r["t"]: (r["u"], r["l"], r["f"]) for r in b.select("t", u=lambda r: fn.ucase(r.t, simple=True), l=lambda r: fn.lcase(
        r.t, simple=True), f=lambda r: fn.ucase(r.t)).df.collect()}
    assert got == {"ßar": ("ẞAR", "ßar", "SSAR"), "ﬁn ǰ ᾀ": ("ﬁN ǰ ᾈ", "ﬁn ǰ ᾀ", "FIN J̌ ἈΙ"), "ΟΔΟΣ": ("ΟΔΟΣ", "οδοσ", "ΟΔΟΣ"),
                   "İz": ("İZ", "iz", "İZ"), "Abc": ("ABC", "abc", "ABC"), "": ("", "", "")}


@pytest.mark.parametrize("seed", range(2))
def test_counted_joins_of_unbound_variables(spark, seed):
    """As the join, but each solution of the left side meets groups."""
    left, right, a, b = sides(spark, seed)
    pairs = brute_join(as_dicts(A, left), as_dicts(B, right))
    for keep, below in ((["y"], None), ([], None), (["x", "b"], None), ([], ("b", "a"))):
        want = {}
        for d in (d for d in pairs if below is None or d["b"] < d["a"]):
            key = tuple(d.get(n) for n in ("a", *keep))
            want[key] = want.get(key, 0) + 1
        got = a.join_counted(b, "w", keep, below).group_by("a", *keep).agg(n=agg.sum("w"))
        assert {tuple(r[n] for n in ("a", *keep)): r["n"] for r in got.df.collect()} == want


def test_copies_over_slots_are_not_broadcast(spark):
    a, b = (solutions(spark, names, [(None, 1, 1), (2, None, 2)]) for names in (A, B))
    plan = a.join(b).df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
