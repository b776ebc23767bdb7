"""Plans: what must be one scan, pushed down, or never appear."""

import re

import pytest

from kgqueries.model import EX, order_graph
from kgspark import RDF, KG, ColumnObj, Mapping, RefObj, TriplesMap, agg, fn
from tests.conftest import SMALL


def plan(x):
    df = x.df if hasattr(x, "df") else x
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def kg(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return order_graph(spark, SMALL)


def test_star_is_one_scan(kg):
    text = plan(kg.bgp([("?o", RDF.type, EX.Order), ("?o", EX.totalPrice, "?t"), ("?o", EX.orderStatus, "?s"), ("?o", EX.placedBy, "?c")]))
    assert text.count("FileScan") == 1 and "Join" not in text and "Exchange" not in text
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_totalprice:double>", text)


def test_trusted_link_needs_no_parent(kg):
    text = plan(kg.bgp([("?o", EX.placedBy, "?c"), ("?c", RDF.type, EX.Customer)]))
    assert text.count("FileScan") == 1 and "Join" not in text


def test_constants_reach_the_scan(kg):
    text = plan(kg.bgp([("?o", EX.placedBy, EX["customer/7"]), ("?o", EX.orderStatus, "F")]))
    assert "EqualTo(o_custkey,7)" in text and "EqualTo(o_orderstatus,F)" in text
    text = plan(kg.match("?o", EX.placedBy, "?c").values("c", [EX["customer/7"], EX["customer/9"], EX["part/1"]]))
    assert "In(o_custkey, [7,9])" in text and "Join" not in text
    text = plan(kg.match("?o", EX.placedBy, "?c").filter(lambda r: r.c == EX["customer/7"]))
    assert "EqualTo(o_custkey,7)" in text


def test_iris_are_built_after_the_joins(kg):
    text = plan(kg.bgp([("?o", EX.placedBy, "?c"), ("?c", EX.name, "?n"), ("?c", EX.customerInNation, "?x"), ("?x", EX.name, "?m")]).select("o", "n", "m"))
    assert text.count("concat(") == 1  # only the projected order IRI
    assert all("concat" not in line for line in text.splitlines() if "Join" in line)


def test_other_branches_are_pruned(kg):
    b = kg.bgp([("?c", EX.name, "?n"), ("?c", EX.marketSegment, "?s")])
    assert len(b.branches) == 1 and plan(b).count("FileScan") == 1


def test_provably_empty_reads_nothing(kg):
    b = kg.bgp([("?x", EX.marketSegment, "?y"), ("?x", EX.placedBy, "?z")])
    assert b.branches == [] and "FileScan" not in plan(b)


def test_type_filter_prunes_at_build_time(kg):
    b = kg.match("?s", EX.marketSegment, "?v").union(kg.match("?s", EX.custKey, "?v"))
    assert len(b.filter(lambda r: fn.is_numeric(r.v)).branches) == 1


def test_keyless_map_is_made_distinct_but_a_keyed_one_not(kg):
    assert "Exchange" in plan(kg.match("?l", EX.quantity, "?q"))
    assert "Exchange" not in plan(kg.match("?o", EX.orderStatus, "?q"))
    assert "Exchange" not in plan(kg.match("?o", EX.orderStatus, "?q").distinct())


def test_every_table_is_read_once_for_its_triples(kg):
    classes = [EX.Customer, EX.Order, EX.Nation, EX.Region, EX.Part, EX.Supplier]
    plain = KG(kg.spark, kg.mapping, kg.ontology, kg.tables, reasoning=False)
    text = plan(plain.triples(classes=classes))
    assert text.count("FileScan") == 6 and "Exchange" not in text
    # Inverses come from the rows that hold the link: two more sources, each read once.
    assert plan(kg.triples(classes=classes)).count("FileScan") == 8
    assert "Exchange" not in plan(kg.triples(classes=[EX.Customer, EX.Nation, EX.Region]))


def test_top_k_does_not_sort_everything(kg):
    assert "TakeOrderedAndProject" in plan(kg.match("?o", EX.totalPrice, "?p").order_by("p").slice(limit=5))


def test_semi_joins_thin_out_the_inner_side(kg):
    text = plan(kg.match("?c", EX.custKey, "?k").exists(kg.match("?e", EX.byUser, "?c")))
    assert "LeftSemi" in text and "HashAggregate" in text


@pytest.fixture
def small_partitions(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "60KB",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "40KB",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2.0", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_hot_key_is_split_over_tasks(spark, small_partitions, tmp_path):
    """A third of the children share one parent: the join is split and the result is whole."""
    n = 120_000
    spark.range(0, n, 1, 8).selectExpr("id AS k", "IF(id % 3 = 0, 0, id % 5000) AS parent", "sha2(string(id), 256) AS pad"
                                       ).write.parquet(str(tmp_path / "child"))
    spark.range(5000).selectExpr("id", "concat('n', id) AS name").write.parquet(str(tmp_path / "parent"))
    tables = {t: spark.read.parquet(str(tmp_path / t)) for t in ("child", "parent")}
    kg = KG(spark, Mapping([
        TriplesMap("#C", "child", "http://c/{k}", [], {EX.under: RefObj("#P", [("parent", "id")]), EX.pad: ColumnObj("pad")}, ["k"]),
        TriplesMap("#P", "parent", "http://p/{id}", [], {EX.name: ColumnObj("name")}, ["id"])]), tables=tables)
    b = kg.bgp([("?c", EX.under, "?p"), ("?c", EX.pad, "?pad"), ("?p", EX.name, "?n")])
    df = b.select("n", "pad").df
    assert len(df.collect()) == n
    assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    counts = b.group_by("n").agg(m=agg.count("pad")).df
    assert counts.where("n = 'n0'").first().m == n // 3 + sum(1 for i in range(n) if i % 3 and i % 5000 == 0)
    assert counts.agg({"m": "sum"}).first()[0] == n


def test_patterns_in_any_order_have_one_plan(spark):
    """The cheapest pattern first, whatever is written first; columns in the order of the patterns."""
    import random
    import re

    from kgqueries.model import order_graph
    from kgqueries.patterns import LOCAL
    from tests.conftest import SMALL
    kg, shapes, counts = order_graph(spark, SMALL), set(), set()
    rng = random.Random(1)
    for _ in range(5):
        out = kg.bgp(LOCAL)
        assert list(out.names)[:2] == [x[1:] for x in (LOCAL[0][0], LOCAL[0][2])]
        counts.add(out.df.count())
        plan = out.df._jdf.queryExecution().optimizedPlan().toString()
        shapes.add(tuple(re.findall(r"(Join \w+|Relation \[\w+)", re.sub(r"#\d+L?", "", plan))))
        LOCAL = rng.sample(LOCAL, len(LOCAL))
    assert len(shapes) == 1 and len(counts) == 1


def test_a_cycle_is_joined_along_keys(kg):
    """Customers and suppliers of a nation meet only where a line ties them, not on the nation alone."""
    from kgqueries.patterns import LOCAL
    joins = [line for line in kg.bgp(LOCAL).df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert len(joins) == 4
    assert sum("__k0_n#" in line and " AND " not in line for line in joins) == 1  # nation to supplier
    assert sum("__k0_n#" in line and "__k0_c#" in line for line in joins) == 1


def test_rows_without_a_key_are_moved_once(kg):
    """Not once per object: triples are made distinct where their subject is."""
    text = plan(kg.triples(classes=[EX.LineItem]))
    moved = re.findall(r"Exchange hashpartitioning\((.*?)\)", text)
    assert moved and all("__s0" in keys and "o#" not in keys for keys in moved)


def test_triples_of_a_part_fit_in_memory(spark, tmp_path):
    """A large table without a key has as many parts as its bytes ask for, not the usual few."""
    path = f"{tmp_path}/notes.parquet"
    spark.range(0, 240_000, 1, 8).selectExpr("id % 160000 AS k", "id % 3 AS n", "md5(cast(id AS string)) AS note").write.parquet(path)
    notes = Mapping([TriplesMap("#N", "notes", "http://e/{k}", [EX.Note], {EX.note: ColumnObj("note"), EX.n: ColumnObj("n")})])
    found = KG(spark, notes, tables={"notes": spark.read.parquet(path)}).triples()
    size = sum(f.stat().st_size for f in (tmp_path / "notes.parquet").glob("*.parquet"))
    parts = [int(n) for n in re.findall(r"Exchange hashpartitioning\(__s0#\d+L, (\d+)\)", plan(found))]
    assert size >> 20 > 4 == int(spark.conf.get("spark.sql.shuffle.partitions")) and parts == [size >> 20]
    assert found.count() == found.distinct().count() == 160_000 + 240_000 + 160_000 + 80_000
