import pytest

from kgspark.operators import metadata as md

CON = "table_fqn string, pos int, kind string, child_columns array<string>, parent_table string, parent_columns array<string>"


def constraints(spark):
    return spark.createDataFrame([
        ("m.s.orders", 1, "FOREIGN KEY", ["a", "b"], "m.s.lines", ["x", "y"]),
        ("m.s.orders", 2, "PRIMARY KEY", ["id", "day"], None, None),
        ("m.s.orders", 3, "PRIMARY KEY", ["other"], None, None),
        ("m.s.orders", 4, "FOREIGN KEY", ["c"], "customers", ["id"]),
        ("m.s.orders", 5, "FOREIGN KEY", ["d"], "m.s.orders", ["id"]),
        ("m.s.noted", 1, "PRIMARY KEY", [], None, None)], CON)


def test_keys_are_declared_never_guessed(spark):
    assert sorted(tuple(r) for r in md.primary_keys(constraints(spark)).collect()) == [("m.s.orders", 1, "id"), ("m.s.orders", 2, "day")]
    fk = md.foreign_keys(constraints(spark))
    assert [(r.child_column, r.parent_column) for r in fk.where("fk_id = 1").orderBy("pos").collect()] == [("a", "x"), ("b", "y")]


def test_join_candidates(spark):
    fk = md.foreign_keys(constraints(spark))

    def kept(*names):
        tables = spark.createDataFrame([(n,) for n in names], "fqn string")
        return {r.fk_id for r in md.join_candidates(fk, tables).collect()}

    assert kept("m.s.orders", "m.s.lines") == {1, 5}  # 'customers' is no full name
    assert kept("m.s.orders") == set() and kept("m.s.orders", "m.s.orders") == set()
    assert kept("m.s.orders", "m.x.lines", "m.s.customers") == {5}


def test_generation_set(spark):
    listing = spark.createDataFrame([("m.s.b", None), ("m.s.a", None), (None, None), ("m.s.c", "denied")], "fqn string, error string")
    ready, errors = md.generation_set(listing, "schema")
    assert [r.fqn for r in ready.collect()] == ["m.s.a", "m.s.b"] and [tuple(r) for r in errors.collect()] == [("m.s.c", "denied")]
    retry = spark.createDataFrame([("m.s.c",), ("m.s.b",), ("*",)], "table string")
    ready, errors = md.generation_set(listing, "schema", retry=retry)
    assert [r.fqn for r in ready.collect()] == ["m.s.b"] and errors.count() == 1
    ready, _ = md.generation_set(listing, "table", table="m.s.a", retry=retry)
    assert [r.fqn for r in ready.collect()] == ["m.s.a"]
    with pytest.raises(ValueError):
        md.generation_set(listing, "table")


def test_columns_and_names(spark):
    df = spark.createDataFrame([(1, "x")], "b int, a string")
    rows = md.columns_df(spark, {"t": df, "s2.u": df, "c.d.e": df}, "main", "shop").collect()
    assert [(r.table_fqn, r.name) for r in rows] == [("c.d.e", "a"), ("c.d.e", "b"), ("main.s2.u", "a"), ("main.s2.u", "b"),
                                                     ("main.shop.t", "a"), ("main.shop.t", "b")]
    with pytest.raises(ValueError):
        md.qualify("t", "", "shop")
