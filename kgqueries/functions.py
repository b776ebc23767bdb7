"""One query per scalar function, over whole tables."""

import datetime as dt

from pyspark.sql import functions as F

from kgqueries.model import EX, order_graph, row
from kgqueries.registry import X, XSD as XS, query
from kgqueries.scans import WEB, web_graph
from kgspark import IRI, XSD, agg, fn, graph


def parts(spark, sf):
    kg = order_graph(spark, sf)
    return kg.bgp([("?p", EX.brand, "?brand"), ("?p", EX.name, "?name"), ("?p", EX.partType, "?type"),
                   ("?p", EX["size"], "?size"), ("?p", EX.retailPrice, "?price"), ("?p", EX.partKey, "?key")])


def docs(spark, sf):
    return web_graph(spark, sf).match("?d", EX.text, "?t")


def events(spark, sf):
    kg = order_graph(spark, sf)
    return kg.bgp([("?e", EX.eventTime, "?ts"), ("?e", EX.eventValue, "?val"), ("?e", EX.eventType, "?t"), ("?e", EX.propK, "?k")])


def orders(spark, sf):
    kg = order_graph(spark, sf)
    return kg.bgp([("?o", EX.orderKey, "?key"), ("?o", EX.totalPrice, "?price"), ("?o", EX.orderDate, "?day"),
                   ("?o", EX.orderStatus, "?status"), ("?o", EX.orderPriority, "?priority")])


def plain(t):
    return fn.str(t) if t.type.kind == "mixed" or t.type.lang else t


def part_query(name, sql_expr, build, alias="v"):
    """A query of one function over the parts: key and value."""
    @query(name, f"SELECT p_partkey AS key, {sql_expr} AS {alias} FROM part")
    def _(spark, sf):
        return parts(spark, sf).select("key", **{alias: build})


def order_query(name, sql_expr, build):
    @query(name, f"SELECT o_orderkey AS key, {sql_expr} AS v FROM orders")
    def _(spark, sf):
        return orders(spark, sf).select("key", v=build)


def doc_query(name, sql_expr, build):
    """A function over whole document texts."""
    @query(name, f"SELECT '{WEB}doc/' || doc_id AS d, {sql_expr} AS v FROM documents WHERE text IS NOT NULL")
    def _(spark, sf):  # texts of any language: the result is reduced to plain text
        return docs(spark, sf).select("d", v=lambda r: plain(build(r)))


def event_query(name, sql_expr, build):
    @query(name, f"SELECT '{X}event/' || event_id AS e, {sql_expr} AS v FROM events")
    def _(spark, sf):
        return events(spark, sf).select("e", v=build)


PRICE, TOTAL = "CAST(p_retailprice AS DECIMAL(18,2))", "CAST(o_totalprice AS DECIMAL(18,2))"

# ---- terms
part_query("x1_str", f"'{X}part/' || p_partkey || '|' || {PRICE} || '|' || p_size",
           lambda r: fn.concat(fn.str(r.p), "|", fn.str(r.price), "|", fn.str(r["size"])))
part_query("x2_datatype", f"'{XS}decimal|{XS}integer|{XS}string'",
           lambda r: fn.concat(fn.str(fn.datatype(r.price)), "|", fn.str(fn.datatype(r["size"])), "|", fn.str(fn.datatype(r.name))))


def kinds(spark, sf):
    kg = order_graph(spark, sf)
    return (kg.match("?x", EX.custKey, "?v").union(kg.match("?x", EX.marketSegment, "?v"))
            .union(kg.match("?x", EX.customerInNation, "?v")))


@query("x3_is_iri", f"SELECT '{X}customer/' || c_custkey AS x, '{X}nation/' || c_nationkey AS v FROM customer")
def _(spark, sf):
    return kinds(spark, sf).filter(lambda r: fn.is_iri(r.v))


@query("x4_is_literal", """
SELECT CAST(c_custkey AS VARCHAR) AS v FROM customer UNION ALL SELECT c_mktsegment FROM customer""")
def _(spark, sf):
    return kinds(spark, sf).filter(lambda r: fn.is_literal(r.v)).select(v2=lambda r: fn.str(r.v)).rename(v2="v")


@query("x2_datatype_mixed", f"""
SELECT '{X}customer/' || c_custkey AS x, '{XS}integer' AS d FROM customer UNION ALL SELECT '{X}customer/' || c_custkey, '{XS}string' FROM customer
UNION ALL SELECT '{X}customer/' || c_custkey, NULL FROM customer""")
def _(spark, sf):
    """Datatypes of a variable that is a number, a text or a resource; a resource has none."""
    return kinds(spark, sf).select("x", d=lambda r: fn.str(fn.datatype(r.v)))


@query("x5_is_blank", f"""
SELECT c_name AS name, '{X}customer/' || c_custkey AS c FROM customer""")
def _(spark, sf):
    """Each customer's name on a blank node of its own, found as the object and as the subject."""
    kg = order_graph(spark, sf)
    made = kg.bgp([("?c", EX.custKey, "?k"), ("?c", EX.name, "?n")]).construct(
        [("?c", EX.about, "_:b"), ("_:b", EX.label, "?n"), ("?c", EX.label, "?n")])
    g = graph(made)
    blank = g.bgp([("?x", EX.about, "?b"), ("?b", EX.label, "?n")]).filter(lambda r: fn.is_blank(r.b) & ~fn.is_blank(r.x))
    return blank.select(name=lambda r: fn.str(r.n), c=lambda r: fn.str(r.x)).select("name", "c")


@query("x6_is_numeric", "SELECT c_custkey AS v FROM customer")
def _(spark, sf):
    return kinds(spark, sf).filter(lambda r: fn.is_numeric(r.v)).select("v")


doc_query("x7_lang", "coalesce(lang, '')", lambda r: fn.lang(r.t))
doc_query("x8_langmatches", "coalesce(lang, '') IN ('en', 'fr')",
          lambda r: fn.lang_matches(fn.lang(r.t), "EN") | fn.lang_matches(fn.lang(r.t), "fr"))


@query("x9_bound", f"""
SELECT '{X}customer/' || c_custkey AS c, n IS NOT NULL AS v FROM customer
LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) ON user_id = c_custkey""")
def _(spark, sf):
    kg = order_graph(spark, sf)
    n = kg.match("?e", EX.byUser, "?c").group_by("c").agg(n=agg.count())
    return kg.match("?c", EX.custKey, "?k").select("c").optional(n).select("c", v=lambda r: fn.bound(r.n))


part_query("x10_sameterm", "p_partkey = p_size", lambda r: fn.same_term(r.key, r["size"]))
part_query("x11_iri", f"'{X}brand/' || url_encode(p_brand)",
           lambda r: fn.iri(fn.concat("brand/", fn.encode_for_uri(r.brand)), X))


@query("x12_bnode", "SELECT count(*) AS fresh, count(DISTINCT p_brand) AS fixed FROM part")
def _(spark, sf):
    """Without a label every row has its own node; with one, equal terms share a node."""
    b = parts(spark, sf).select("key", fresh=lambda r: fn.bnode(), fixed=lambda r: fn.bnode("a", [r.brand]))
    return b.agg(fresh=agg.count_distinct("fresh"), fixed=agg.count_distinct("fixed"))


order_query("x13_strdt", "CAST(o_orderkey AS DOUBLE)", lambda r: fn.strdt(fn.str(r.key), XSD.double))


@query("x13_strlang", f"SELECT p_partkey AS key, p_name || '@en-GB' AS v FROM part")
def _(spark, sf):
    b = parts(spark, sf).bind("tagged", lambda r: fn.strlang(r.name, "en-GB"))
    return b.select("key", v=lambda r: fn.concat(fn.str(r.tagged), "@", fn.lang(r.tagged)))


# ---- logic
order_query("x14_logic", f"(({TOTAL} > 100000 AND NOT o_orderstatus = 'F') OR o_orderpriority = '5-LOW')",
            lambda r: ((r.price > 100000) & ~(r.status == "F")) | (r.priority == "5-LOW"))
order_query("x14_error_logic", "CASE WHEN o_orderstatus = 'F' THEN TRUE ELSE CASE WHEN o_orderkey = 0 THEN NULL ELSE 1000 / o_orderkey > 1 END END",
            lambda r: (r.status == "F") | (1000 / r.key > 1))
order_query("x15_compare", f"CAST({TOTAL} >= 50000 AS INT) + CAST(o_orderstatus < 'P' AS INT) + CAST(CAST(o_orderdate AS DATE) <= DATE '1997-06-01' AS INT)",
            lambda r: fn.if_(r.price >= 50000, 1, 0) + fn.if_(r.status < "P", 1, 0)
            + fn.if_(r.day <= dt.date(1997, 6, 1), 1, 0))
order_query("x16_in", "(o_orderstatus IN ('F','P')) AND (o_orderpriority NOT IN ('5-LOW','1-URGENT'))",
            lambda r: fn.is_in(r.status, "F", "P") & fn.not_in(r.priority, "5-LOW", "1-URGENT"))
order_query("x17_if", "CASE WHEN o_orderkey = 0 THEN NULL WHEN 100000 / o_orderkey > 20 THEN 'low' ELSE 'high' END",
            lambda r: fn.if_(100000 / r.key > 20, "low", "high"))


@query("x18_coalesce", f"""
SELECT '{X}customer/' || c_custkey AS c, coalesce(n, -1) AS v FROM customer
LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) ON user_id = c_custkey""")
def _(spark, sf):
    kg = order_graph(spark, sf)
    n = kg.match("?e", EX.byUser, "?c").group_by("c").agg(n=agg.count())
    return kg.match("?c", EX.custKey, "?k").select("c").optional(n).select("c", v=lambda r: fn.coalesce(r.n, -1))


# ---- strings
doc_query("x19_strlen", "length(text)", lambda r: fn.strlen(r.t))
doc_query("x20_substr", "substr(text, 5, 40) || substr(text, greatest(length(text) - 3, 1))",
          lambda r: fn.concat(fn.substr(r.t, 5, 40), fn.substr(r.t, fn.strlen(r.t) - 3)))
part_query("x20_substr_edges", "substr(p_name, 1, 2) || '|' || substr(p_name, 4) || '|' || substr(p_name, 50, 5)",
           lambda r: fn.concat(fn.substr(r.name, -1, 4), "|", fn.substr(r.name, 4), "|", fn.substr(r.name, 50, 5)))
doc_query("x21_case", "upper(substr(text, 1, 1)) || lower(text)", lambda r: fn.concat(fn.ucase(fn.substr(r.t, 1, 1), simple=True), fn.lcase(r.t, simple=True)))
part_query("x22_strstarts", "starts_with(p_name, 'red')", lambda r: fn.strstarts(r.name, "red"))
part_query("x23_strends", "ends_with(p_name, 'widget')", lambda r: fn.strends(r.name, "widget"))
doc_query("x24_contains", "contains(text, 'the')", lambda r: fn.contains(r.t, "the"))
doc_query("x25_strbefore", "CASE WHEN instr(text, '. ') > 0 THEN substr(text, 1, instr(text, '. ') - 1) ELSE '' END",
          lambda r: fn.strbefore(r.t, ". "))
doc_query("x26_strafter", "CASE WHEN instr(text, '. ') > 0 THEN substr(text, instr(text, '. ') + 2) ELSE '' END",
          lambda r: fn.strafter(r.t, ". "))
doc_query("x27_encode_for_uri", "url_encode(text)", lambda r: fn.encode_for_uri(r.t))
part_query("x28_concat", "p_name || ' / ' || p_brand", lambda r: fn.concat(r.name, " / ", r.brand))
doc_query("x29_regex", "regexp_matches(text, '(?i)[aeiou]{3}n')", lambda r: fn.regex(r.t, "[aeiou]{3}n", "i"))
part_query("x29_regex_quoted", "contains(p_brand, 'd#1')", lambda r: fn.regex(r.brand, "d#1", "q"))
part_query("x29_regex_variable", "contains(lower(p_type), lower(split_part(p_name, ' ', 1)))",
           lambda r: fn.regex(r.type, fn.strbefore(fn.concat(r.name, " "), " "), "iq"))
part_query("x30_replace_variable", "replace(p_name, split_part(p_name, ' ', 1), '<' || p_brand || '$1>')",
           lambda r: fn.replace(r.name, fn.strbefore(fn.concat(r.name, " "), " "), fn.concat("<", r.brand, "$1>"), "q"))
part_query("x30_replace", r"regexp_replace(p_name, '([a-z]+) ([a-z]+)', '\2-\1')",
           lambda r: fn.replace(r.name, "([a-z]+) ([a-z]+)", "$2-$1"))

# ---- numbers
part_query("x31_arithmetic", f"CAST({PRICE} * 2 + p_size - 10 AS DOUBLE)", lambda r: r.price * 2 + r["size"] - 10)
part_query("x31_negate", "-p_size * 3", lambda r: -r["size"] * 3)
part_query("x31_overflow", "CASE WHEN p_partkey <= 1 THEN p_partkey * 9223372036854775807 END",
           lambda r: r.key * 9223372036854775807)
part_query("x32_divide", "CASE WHEN p_partkey <> 0 THEN CAST(p_size AS DOUBLE) / p_partkey END",
           lambda r: fn.cast(r["size"] / r.key, XSD.double))
part_query("x33_abs", f"CAST(abs({PRICE} - 950) AS DOUBLE)", lambda r: fn.abs(r.price - 950))
part_query("x34_round", "CAST(floor((p_size - 25) / 2.0 + 0.5) AS DOUBLE)", lambda r: fn.round((r["size"] - 25) / 2))
event_query("x34_round_double", "floor(value + 0.5)", lambda r: fn.round(r.val))
part_query("x35_ceil_floor", f"CAST(ceil({PRICE}) - floor({PRICE}) + ceil(p_size / 7.0) AS DOUBLE)",
           lambda r: fn.cast(fn.ceil(r.price) - fn.floor(r.price) + fn.ceil(fn.cast(r["size"], XSD.double) / 7.0), XSD.double))


@query("x36_rand", "SELECT p_partkey AS key, TRUE AS ok FROM part")
def _(spark, sf):
    b = parts(spark, sf).bind("v", lambda r: fn.rand())
    return b.select("key", ok=lambda r: (r.v >= 0.0) & (r.v < 1.0))


@query("x37_now", "SELECT count(*) AS n, count(DISTINCT 1) AS instants FROM part")
def _(spark, sf):
    """One instant per query."""
    return parts(spark, sf).bind("v", lambda r: fn.now()).agg(n=agg.count(), instants=agg.count_distinct("v"))


# ---- dates
order_query("x38_date_parts", "year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate)",
            lambda r: fn.year(r.day) * 10000 + fn.month(r.day) * 100 + fn.day(r.day))
event_query("x39_time_parts", "CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) + (microsecond(ts) % 1000000) / 1000000.0 AS DOUBLE)",
            lambda r: fn.cast(fn.hours(r.ts) * 3600 + fn.minutes(r.ts) * 60 + fn.seconds(r.ts), XSD.double))
event_query("x40_timezone", "'Z|PT0S'", lambda r: fn.concat(fn.tz(r.ts), "|", fn.str(fn.timezone(r.ts))))

# ---- hashes and identity
doc_query("x41_md5", "md5(text)", lambda r: fn.md5(fn.str(r.t)))
part_query("x41_sha1", "sha1(p_name)", lambda r: fn.sha1(r.name))
doc_query("x42_sha256", "sha256(text)", lambda r: fn.sha256(fn.str(r.t)))


# Published digests have no SQL function here, so these are the known answers for the five segments.
SHA = {
    "AUTOMOBILE": ("54f8b7c4107988ce392f2ed699a4f2b90b4578daf7434183334694aa7113b3da23a5584822c98666ca634da38485ab52",
                   "dd2eb93f355a0a5345f868cd6b2e10831d88543ca0998ac17c393286439e087b"
                   "e5809381632527766717aba34c356e0f5a931b2d9e1c5c1018dc4189aca0b49c"),
    "BUILDING": ("32bfe9bf65879b5e3c3e88467a9e160fe0e321a9874057b95a1817b26b3c87d47e416e2f00ac0746b8ae4ac3b3faf215",
                 "68b7c4eab56ba52ffe1566f22ddc55e7c9b69308b205edc105d11dc3233cd5da"
                 "9fd35d5dd482b41b5452684afcb532ec276d31ed0a5e96e16e4624984368b1eb"),
    "FURNITURE": ("6749048fe306bd0d79fbca045873d06eab2365a4079df9776912073a697b86dd947a31e7ec44b6109e980f75d917845b",
                  "ea199837549a6b6a1663dfd06c9c6b1a4da77c424c0d15d951a749d20c197297"
                  "f31cae5296ccf30408f2cb0c5777fc79b1074765130d3ceeb48048b0e5599bce"),
    "HOUSEHOLD": ("3620b466680e706395d770d47a4f1b94307e5fdeb0d14cceb1b15479b44cc32b8db243cc43e516338699d5e082c72728",
                  "88f489f4fd85a1cad4c8b7dcb2e2605f775c5251760bb98f6b4fd61e5ff51154"
                  "c87cfe50fa0d697761fdd1b48c3ed69e0e292c128ed585a2e1b0b766a6df1432"),
    "MACHINERY": ("937dc7036b40d4895431e928ea9e3048bf094e26224f3e72dd668b4c367f5d850e69ac18ebe011167fe33a4014d687c5",
                  "30e74b66abfb0c721d6959bb3e869a5feb8579c6edb94b6738e99647661f679e"
                  "cfd9482f39b40fda235bc33f701c0de88397bec5288b799ab63c241806fffd2e"),
}


@query("x42_sha384_sha512", f"""
SELECT '{X}customer/' || c_custkey AS c, a, b FROM customer
JOIN (VALUES {", ".join(f"('{t}', '{a}', '{b}')" for t, (a, b) in SHA.items())}) AS known(text, a, b) ON text = c_mktsegment""")
def _(spark, sf):
    segments = order_graph(spark, sf).match("?c", EX.marketSegment, "?s")
    return segments.select("c", a=lambda r: fn.sha384(r.s), b=lambda r: fn.sha512(r.s))


@query("x43_uuid", "SELECT count(*) AS iris, count(*) AS texts, TRUE AS ok FROM part")
def _(spark, sf):
    b = parts(spark, sf).bind("a", lambda r: fn.uuid()).bind("b", lambda r: fn.struuid())
    shape = "[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$"
    b = b.bind("good", lambda r: fn.regex(fn.str(r.a), "^urn:uuid:" + shape) & fn.regex(r.b, "^" + shape))
    return b.agg(iris=agg.count_distinct("a"), texts=agg.count_distinct("b"), ok=agg.min("good"))


# ---- casts
CASTS = [
    ("x44_cast_integer", "CAST(trunc(CAST(p_retailprice AS DECIMAL(18,2))) AS BIGINT)", lambda r: fn.cast(r.price, XSD.integer)),
    ("x44_cast_string_integer", "CAST(replace(p_brand, 'Brand#', '') AS BIGINT)",
     lambda r: fn.cast(fn.strafter(r.brand, "#"), XSD.integer)),
    ("x44_cast_bad", "CAST(NULL AS BIGINT)", lambda r: fn.cast(r.brand, XSD.integer)),
    ("x44_cast_double", f"CAST({PRICE} AS DOUBLE)", lambda r: fn.cast(r.price, XSD.double)),
    ("x44_cast_decimal", "CAST(p_size AS DOUBLE)", lambda r: fn.cast(fn.str(r["size"]), XSD.decimal)),
    ("x44_cast_boolean", "p_size <> 0", lambda r: fn.cast(r["size"], XSD.boolean)),
    ("x44_cast_string", f"CAST({PRICE} AS VARCHAR)", lambda r: fn.cast(r.price, XSD.string)),
    ("x44_cast_float", "CAST(CAST(p_size AS FLOAT) AS DOUBLE)", lambda r: fn.cast(r["size"], XSD.float)),
]
for _name, _sql, _build in CASTS:
    part_query(_name, _sql, _build)
order_query("x44_cast_datetime", "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')", lambda r: fn.str(fn.cast(r.day, XSD.dateTime)))
event_query("x44_cast_date", "CAST(CAST(ts AS DATE) AS VARCHAR)", lambda r: fn.str(fn.cast(r.ts, XSD.date)))
event_query("x45_json", "CAST(json_extract(props, '$.k') AS BIGINT)", lambda r: r.k)


# ---- values of several datatypes in one variable
@query("x15_mixed_less", f"""
SELECT '{X}customer/' || c_custkey AS x FROM customer WHERE c_nationkey < CAST(c_acctbal AS DECIMAL(18,2))
UNION ALL SELECT '{X}supplier/' || s_suppkey FROM supplier WHERE s_nationkey < CAST(s_acctbal AS DECIMAL(18,2))""")
def _(spark, sf):
    """In a graph of triples every object may be of any type: integers against decimals."""
    g = graph(order_graph(spark, sf).triples([EX.nationKey, EX.accountBalance]))
    return (g.bgp([("?s", EX.nationKey, "?n"), ("?s", EX.accountBalance, "?b")]).filter(lambda r: r.n < r.b)
            .select(x=lambda r: fn.str(r.s)))


@query("x15_mixed_equal", """
SELECT count(*) AS n FROM (SELECT DISTINCT * FROM lineitem) WHERE CAST(l_quantity AS DECIMAL(18,2)) = l_linenumber""")
def _(spark, sf):
    g = graph(order_graph(spark, sf).triples([row("lineNumber"), row("quantity")]))
    return (g.bgp([("?l", row("lineNumber"), "?a"), ("?l", row("quantity"), "?b")]).filter(lambda r: r.a == r.b)
            .agg(n=agg.count()))


@query("a5_min_max_mixed", f"""
SELECT CAST(min(v) AS DOUBLE) AS lo, CAST(max(v) AS DOUBLE) AS hi FROM (
SELECT CAST(c_custkey AS DECIMAL(20,2)) AS v FROM customer UNION ALL SELECT CAST(c_acctbal AS DECIMAL(18,2)) FROM customer
UNION ALL SELECT CAST(s_acctbal AS DECIMAL(18,2)) FROM supplier)""")
def _(spark, sf):
    """The least and the greatest over integers and decimals."""
    kg = order_graph(spark, sf)
    both = kg.match("?x", EX.custKey, "?v").union(kg.match("?x", EX.accountBalance, "?v"))
    return both.agg(a=agg.min("v"), b=agg.max("v")).select(
        lo=lambda r: fn.cast(fn.str(r.a), XSD.double), hi=lambda r: fn.cast(fn.str(r.b), XSD.double)).select("lo", "hi")


@query("u1_user_function", "SELECT p_partkey AS key, reverse(p_name) || '!' AS v FROM part")
def _(spark, sf):
    iri = IRI(X + "fn/backwards")
    fn.register(iri, lambda c: F.concat(F.reverse(c), F.lit("!")))
    return parts(spark, sf).select("key", v=lambda r: fn.call(iri, r.name))
