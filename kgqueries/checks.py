"""Ontology checks over a query log and over instance triples; search and description of terms."""

from pyspark.sql import functions as F

from kgqueries.model import EX, OBJECT_PROPERTIES, TBOX_DDL, order_graph
from kgqueries.registry import TYPE, X, frame, query
from kgqueries.scans import GRAPH_SQL
from kgspark import OWL, RDF, RDFS, XSD
from kgspark.operators import check, search
from kgspark.operators.check import VARIABLE_NS as QQ

INS = "http://example.org/insurance/"

# A small insurance ontology: (property, kind, domain, range).
INSURANCE = [
    ("soldByAgent", "ObjectProperty", "Policy", "Agent"),
    ("against", "ObjectProperty", "Claim", "PolicyCoverageDetail"),
    ("hasPolicy", "ObjectProperty", "PolicyCoverageDetail", "Policy"),
    ("policyNumber", "DatatypeProperty", "Policy", None),
]
# What the logged queries look like: (event type, subject, predicate, object); v: variable, i: IRI.
LOGGED = [
    ("view", "v:agent", "i:soldByAgent", "v:policy"), ("view", "v:agent", "a", "i:Agent"),
    ("click", "v:claim", "a", "i:Claim"), ("click", "v:policy", "a", "i:Policy"), ("click", "v:claim", "i:against", "v:policy"),
    ("error", "v:x", "i:soldByAgent", "v:agent"), ("error", "v:x", "i:against", "v:detail"),
    ("purchase", "v:claim", "i:against", "v:policy"), ("purchase", "v:policy", "i:soldByAgent", "v:agent"),
    ("signup", "v:claim", "i:against", "v:policy"), ("signup", "v:detail", "i:hasPolicy", "v:policy"),
    ("signup", "v:p", "a", "i:Policy"), ("signup", "v:p", "i:unknownProp", "b:w"),
]


def insurance_tbox(spark):
    rows = []
    for name, kind, dom, rng in INSURANCE:
        rows.append((INS + name, RDF.type, OWL[kind]))
        rows.append((INS + name, RDFS.domain, INS + dom))
        rows.append((INS + name, RDFS.range, INS + rng if rng else XSD.string))
    for c in ("Agent", "Policy", "Claim", "PolicyCoverageDetail"):
        rows.append((INS + c, RDF.type, OWL.Class))
    rows = [(str(s), "iri", str(p), str(o), "iri", None, None) for s, p, o in rows]
    rows.append((INS + "soldByAgent", "iri", str(RDFS.label), "sold by agent", "literal", str(XSD.string), None))
    return spark.createDataFrame(rows, TBOX_DDL)


_CHECKERS: dict[tuple, check.Checker] = {}


def checker_of(spark, build):
    """The rules against one fixed ontology; its closure is made once per application."""
    key = (spark.sparkContext.applicationId, build.__name__)
    if key not in _CHECKERS:
        _CHECKERS[key] = check.Checker(build(spark))
    return _CHECKERS[key]


def query_log(spark, sf):
    """Every event is a logged query, with the patterns of its type."""
    def split(x):
        if x == "a":
            return str(RDF.type), "iri"
        kind, name = x.split(":")
        return (INS + name, "iri") if kind == "i" else (name, "var" if kind == "v" else "bnode")

    shapes = [(t, *split(s), *split(p), *split(o)) for t, s, p, o in LOGGED]
    shapes = spark.createDataFrame(shapes, "event_type string, s string, s_kind string, p string, p_kind string, "
                                           "o string, o_kind string")
    ev = frame(spark, sf, "events").select(F.col("event_id").cast("string").alias("unit_id"), "event_type")
    return ev.join(F.broadcast(shapes), "event_type").drop("event_type")


def _skolem(x):
    if x == "a":
        return str(RDF.type)
    kind, name = x.split(":")
    return INS + name if kind == "i" else QQ + ("b_" if kind == "b" else "") + name


_SHAPES = ", ".join(f"('{t}', '{_skolem(s)}', '{_skolem(p)}', '{_skolem(o)}')" for t, s, p, o in LOGGED)


@query("c0_patterns", f"""
SELECT CAST(event_id AS VARCHAR) AS unit_id, s, p, o FROM events
JOIN (VALUES {_SHAPES}) t(event_type, s, p, o) USING (event_type)""")
def _(spark, sf):
    return check.patterns_df(query_log(spark, sf)).select("unit_id", "s", "p", "o")


def log_rule(name, rule, event_type, columns):
    """One rule over the whole log: ``columns`` is the one violation each query of a type has."""
    names = ", ".join(f"'{v}' AS \"{c}\"" for c, v in columns.items())

    @query(name, f"SELECT CAST(event_id AS VARCHAR) AS unit_id, {names}, CAST(1 AS BIGINT) AS n FROM events "
                 f"WHERE event_type = '{event_type}'")
    def _(spark, sf):
        checker = checker_of(spark, insurance_tbox)
        return getattr(checker, rule)(check.patterns_df(query_log(spark, sf)))


log_rule("c1_double_domain", "double_domain", "error",
         {"p": INS + "against", "domp": INS + "Claim", "q": INS + "soldByAgent", "domq": INS + "Policy"})
log_rule("c2_domain_range", "domain_range", "purchase",
         {"p": INS + "against", "rangep": INS + "PolicyCoverageDetail", "q": INS + "soldByAgent", "domq": INS + "Policy"})
log_rule("c3_domain", "domain", "view",
         {"p": INS + "soldByAgent", "domain": INS + "Policy", "s": QQ + "agent", "cls": INS + "Agent"})
log_rule("c4_incorrect_property", "incorrect_property", "signup", {"p": INS + "unknownProp"})
log_rule("c5_range", "range", "click",
         {"p": INS + "against", "range": INS + "PolicyCoverageDetail", "o": QQ + "policy", "cls": INS + "Policy"})
log_rule("c6_double_range", "double_range", "signup",
         {"p": INS + "against", "rangep": INS + "PolicyCoverageDetail", "q": INS + "hasPolicy", "rangeq": INS + "Policy"})

MESSAGES = [
    ("error", 1, "double_domain", "The property against has domain Claim, and sold by agent has domain Policy, and these are incompatible.", "against"),
    ("purchase", 2, "domain_range", "The property against has range PolicyCoverageDetail, and sold by agent has domain Policy, and these are incompatible with the query.", "against"),
    ("view", 3, "domain", "The property sold by agent has domain Policy, but its subject ?agent is a Agent, which isn''t a subclass of Policy.", "sold by agent"),
    ("signup", 4, "incorrect_property", "The property unknownProp isn''t defined in the ontology. Please only use properties from the ontology, or from a standard source like rdf:, rdfs:, owl:, or skos:.", "unknownProp"),
    ("click", 5, "range", "The property against has range PolicyCoverageDetail, but its object ?policy is a Policy, which isn''t a subclass of PolicyCoverageDetail.", "against"),
    ("signup", 6, "double_range", "The property against has range PolicyCoverageDetail, and hasPolicy has range Policy, and these are incompatible.", "against"),
]
_REPORT = ", ".join(f"('{t}', {i}, '{r}', '{m}', '{p}')" for t, i, r, m, p in MESSAGES)


@query("c7_report", f"""
SELECT CAST(event_id AS VARCHAR) AS unit_id, CAST(i AS BIGINT) AS rule_order, rule, message, p, CAST(1 AS BIGINT) AS n
FROM events JOIN (VALUES {_REPORT}) t(event_type, i, rule, message, p) USING (event_type)""")
def _(spark, sf):
    found = checker_of(spark, insurance_tbox).all(check.patterns_df(query_log(spark, sf)))
    return found.select("unit_id", "rule_order", "rule", "message", F.col("bindings")["p"].alias("p"), "n")


@query("c7_summary", """
SELECT CAST(event_id AS VARCHAR) AS unit_id, FALSE AS ok, CASE WHEN event_type = 'signup' THEN 2 ELSE 1 END AS n FROM events
UNION ALL SELECT 'customer ' || c_custkey, TRUE, 0 FROM customer""")
def _(spark, sf):
    """Also units without patterns are listed, as passed."""
    log = check.patterns_df(query_log(spark, sf))
    checker = checker_of(spark, insurance_tbox)
    units = log.select("unit_id").union(frame(spark, sf, "customer").select(
        F.concat(F.lit("customer "), F.col("c_custkey").cast("string"))))
    return checker.summary(units, log)


@query("c8_term_display", f"""
SELECT '{X}customer/' || c_custkey AS term, 'label of ' || c_name AS shown FROM customer WHERE c_nationkey > 4
UNION ALL SELECT '{X}customer/' || c_custkey, CAST(c_custkey AS VARCHAR) FROM customer WHERE c_nationkey <= 4
UNION ALL SELECT '{QQ}v' || c_custkey, '?v' || c_custkey FROM customer
UNION ALL SELECT '{QQ}b_x' || c_custkey, '_:x' || c_custkey FROM customer
UNION ALL SELECT '{X}s#f' || c_custkey, 'f' || c_custkey FROM customer""")
def _(spark, sf):
    c = frame(spark, sf, "customer")
    key = F.col("c_custkey").cast("string")
    iri = F.concat(F.lit(f"{X}customer/"), key)
    names = c.where("c_nationkey > 4").select(iri.alias("iri"), F.concat(F.lit("label of "), F.col("c_name")).alias("label"))
    terms = c.select(F.explode(F.array(iri, F.concat(F.lit(f"{QQ}v"), key), F.concat(F.lit(f"{QQ}b_x"), key),
                                       F.concat(F.lit(f"{X}s#f"), key))).alias("term"))
    return check.display(terms.withColumn("shown", F.col("term")), "shown", names)


# ---- the same rules over instance triples ------------------------------------------------------

# An ontology the order data does not fit: (property, domain, range).
MISFIT = [("orderPriority", "Ticket", None), ("orderStatus", "Order", None), ("totalPrice", "Order", None),
          ("placedBy", "Order", "Person"), ("byUser", "Event", "User"), ("custKey", "Customer", None),
          ("marketSegment", "Customer", None)]


def misfit_tbox(spark):
    rows = []
    for p, dom, rng in MISFIT:
        rows += [(EX[p], RDF.type, RDF.Property), (EX[p], RDFS.domain, EX[dom])]
        rows += [(EX[p], RDFS.range, EX[rng])] if rng else []
    rows += [(EX[c], RDF.type, OWL.Class) for c in ("Ticket", "Order", "Person", "Event", "User", "Customer")]
    rows += [(EX.Customer, RDFS.subClassOf, EX.Party), (EX.User, RDFS.subClassOf, EX.Party)]
    return spark.createDataFrame([(str(s), "iri", str(p), str(o), "iri", None, None) for s, p, o in rows], TBOX_DDL)


def instance(spark, sf):
    """Every mapped statement, line items included, counted from the tables."""
    return checker_of(spark, misfit_tbox), check.GraphPatterns(order_graph(spark, sf, reasoning=False), "shop")


@query("c1_instance", f"""
SELECT 'shop' AS unit_id, '{X}orderPriority' AS p, '{X}Ticket' AS domp, q, '{X}Order' AS domq, count(*) AS n
FROM orders, (VALUES ('{X}orderStatus'), ('{X}placedBy'), ('{X}totalPrice')) t(q) GROUP BY 4""")
def _(spark, sf):
    checker, patterns = instance(spark, sf)
    return checker.double_domain(patterns)


@query("c2_instance", f"""
SELECT 'shop' AS unit_id, p, r AS rangep, q, '{X}Customer' AS domq, n FROM (
SELECT '{X}placedBy' AS p, '{X}Person' AS r, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT '{X}byUser', '{X}User', count(*) FROM events JOIN customer ON user_id = c_custkey),
(VALUES ('{X}custKey'), ('{X}marketSegment')) t(q)""")
def _(spark, sf):
    checker, patterns = instance(spark, sf)
    return checker.domain_range(patterns)


@query("c3_instance", f"""
SELECT 'shop' AS unit_id, '{X}orderPriority' AS p, '{X}Ticket' AS domain, '{X}order/' || o_orderkey AS s, '{X}Order' AS cls,
       CAST(1 AS BIGINT) AS n FROM orders""")
def _(spark, sf):
    checker, patterns = instance(spark, sf)
    return checker.domain(patterns)


_KNOWN = ", ".join(f"'{X}{p}'" for p in [m[0] for m in MISFIT] + [inverse for *_, inverse in OBJECT_PROPERTIES if inverse])


@query("c4_instance", f"""
SELECT DISTINCT 'shop' AS unit_id, p, CAST(1 AS BIGINT) AS n FROM ({GRAPH_SQL})
WHERE s IS NOT NULL AND o IS NOT NULL AND p NOT IN ('{TYPE}', {_KNOWN})""")
def _(spark, sf):
    checker, patterns = instance(spark, sf)
    return checker.incorrect_property(patterns)


@query("c5_instance", f"""
SELECT 'shop' AS unit_id, '{X}placedBy' AS p, '{X}Person' AS range, '{X}customer/' || o_custkey AS o, '{X}Customer' AS cls, count(*) AS n
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 4
UNION ALL SELECT 'shop', '{X}byUser', '{X}User', '{X}customer/' || user_id, '{X}Customer', count(*)
FROM events JOIN customer ON user_id = c_custkey GROUP BY 4""")
def _(spark, sf):
    checker, patterns = instance(spark, sf)
    return checker.range(patterns)


@query("c6_instance", f"""
SELECT 'shop' AS unit_id, '{X}byUser' AS p, '{X}User' AS rangep, '{X}placedBy' AS q, '{X}Person' AS rangeq,
       CAST(sum(e.n * o.n) AS BIGINT) AS n
FROM (SELECT user_id AS c, count(*) AS n FROM events GROUP BY 1) e
JOIN (SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1) o ON e.c = o.c""")
def _(spark, sf):
    checker, patterns = instance(spark, sf)
    return checker.double_range(patterns)


# ---- search ------------------------------------------------------------------------------------

def catalog_tbox(spark, sf):
    """An ontology out of the parts and suppliers: parts are classes, suppliers properties."""
    p, s = frame(spark, sf, "part"), frame(spark, sf, "supplier")
    none = F.lit(None).cast("string")
    part = F.concat(F.lit(f"{X}part/"), F.col("p_partkey").cast("string"))
    supplier = F.concat(F.lit(f"{X}supplier/"), F.col("s_suppkey").cast("string"))

    def rows(df, subject, items):
        structs = []
        for cond, pred, value, kind in items:
            structs.append(F.when(cond, F.struct(
                subject.alias("s"), F.lit("iri").alias("s_kind"), F.lit(str(pred)).alias("p"), value.alias("o"),
                F.lit(kind).alias("o_kind"),
                (F.lit(str(XSD.string)) if kind == "literal" else none).alias("o_dt"), none.alias("o_lang"))))
        return df.select(F.explode(F.array(*structs)).alias("t")).where("t IS NOT NULL").select("t.*")

    always, big = F.lit(True), F.col("p_size") >= 10
    comment = F.concat(F.lit("\n "), F.col("p_type"), F.lit(" "), F.col("p_name"), F.lit(" by "), F.col("p_brand"), F.lit(" "))
    classes = rows(p, part, [
        (always, RDF.type, F.lit(str(OWL.Class)), "iri"), (big, RDFS.label, F.col("p_name"), "literal"),
        (big, RDFS.comment, comment, "literal"), (always, EX.altName, F.col("p_brand"), "literal"),
        (big, RDFS.subClassOf, F.concat(F.lit(f"{X}type/"), F.lower("p_type")), "iri")])
    properties = rows(s, supplier, [
        (always, RDF.type, F.lit(str(OWL.ObjectProperty)), "iri"), (always, RDFS.label, F.col("s_name"), "literal"),
        (always, RDFS.domain, F.concat(F.lit(f"{X}part/"), F.col("s_suppkey").cast("string")), "iri"),
        (always, RDFS.range, F.concat(F.lit(f"{X}nation/"), F.col("s_nationkey").cast("string")), "iri")])
    return classes.union(properties)


INDEX_SQL = f"""
SELECT '{X}part/' || p_partkey AS iri, p_name AS text FROM part WHERE p_size >= 10
UNION ALL SELECT '{X}part/' || p_partkey, p_type || ' ' || p_name || ' by ' || p_brand FROM part WHERE p_size >= 10
UNION ALL SELECT '{X}part/' || p_partkey, '{X}part/' || p_partkey FROM part WHERE p_size < 10
UNION ALL SELECT '{X}supplier/' || s_suppkey, s_name FROM supplier"""


@query("d1_search_index", INDEX_SQL)
def _(spark, sf):
    return search.search_index(catalog_tbox(spark, sf))


@query("d2_fuzzy_search", f"""
WITH idx AS ({INDEX_SQL}),
q AS (SELECT DISTINCT query FROM (SELECT replace(p_name, 'i', 'y') AS query FROM part
      UNION ALL SELECT split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) FROM part)),
pairs AS (SELECT query, iri, text, list_distinct(list_filter(string_split(query, ' '), lambda x: x <> '')) AS a,
                 list_distinct(list_filter(string_split(text, ' '), lambda x: x <> '')) AS b FROM q, idx),
scored AS (SELECT query, iri, max(round(100 * greatest(1.0::DOUBLE - levenshtein(query, text)::DOUBLE / greatest(length(query), length(text)),
   0.95::DOUBLE * (len(list_intersect(a, b))::DOUBLE / least(len(a), len(b)))), 4)) AS score FROM pairs GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, iri) AS rank FROM scored)
SELECT query, iri, score, rank FROM ranked WHERE rank <= 5""")
def _(spark, sf):
    """Misspelt and turned-round part names against all labels and comments."""
    p = frame(spark, sf, "part")
    words = F.split("p_name", " ")
    asked = p.select(F.explode(F.array(F.replace("p_name", F.lit("i"), F.lit("y")),
                                       F.concat(words[1], F.lit(" "), words[0]))).alias("query"))
    return search.fuzzy_search(asked, search.search_index(catalog_tbox(spark, sf)), 5)


@query("d2_partial_search", f"""
WITH idx AS (SELECT iri, text FROM ({INDEX_SQL}) WHERE text LIKE '% by %'),
q AS (SELECT DISTINCT replace(p_name, 'i', 'y') AS query FROM part),
pairs AS (SELECT query, iri, text, list_filter(string_split(query, ' '), lambda x: x <> '') AS a,
                 list_filter(string_split(text, ' '), lambda x: x <> '') AS b FROM q, idx),
scored AS (SELECT query, iri, max(greatest(
   round(100 * greatest(1.0::DOUBLE - levenshtein(query, text)::DOUBLE / greatest(length(query), length(text)),
     0.95::DOUBLE * (len(list_intersect(list_distinct(a), list_distinct(b)))::DOUBLE / least(len(list_distinct(a)), len(list_distinct(b))))), 4),
   round(90 * list_max(list_transform(range(1, len(b) - len(a) + 2), lambda i: 1.0::DOUBLE - levenshtein(query, array_to_string(b[i:i + len(a) - 1], ' '))::DOUBLE
     / greatest(length(query), length(array_to_string(b[i:i + len(a) - 1], ' '))))), 4))) AS score FROM pairs GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, iri) AS rank FROM scored)
SELECT query, iri, score, rank FROM ranked WHERE rank <= 5""")
def _(spark, sf):
    """Misspelt part names inside longer comments."""
    asked = frame(spark, sf, "part").select(F.replace("p_name", F.lit("i"), F.lit("y")).alias("query"))
    comments = search.search_index(catalog_tbox(spark, sf)).where("text LIKE '% by %'")
    return search.fuzzy_search(asked, comments, 5, partial=True)


@query("d3_expand_terms", f"""
SELECT '{X}part/' || p_partkey AS s, p, o FROM part, LATERAL (SELECT * FROM (VALUES
 ('{RDF.type}', '{OWL.Class}', 0), ('{RDFS.label}', p_name, 10), ('{RDFS.comment}', chr(10) || ' ' || p_type || ' ' || p_name || ' by ' || p_brand || ' ', 10),
 ('{RDFS.subClassOf}', '{X}type/' || lower(p_type), 10)) v(p, o, least_size) WHERE p_size >= least_size)
WHERE p_brand = 'Brand#7'""")
def _(spark, sf):
    hits = frame(spark, sf, "part").where("p_brand = 'Brand#7'").select(
        F.concat(F.lit(f"{X}part/"), F.col("p_partkey").cast("string")).alias("iri"))
    return search.expand_terms(hits, catalog_tbox(spark, sf)).select("s", "p", "o")


@query("d4_describe_terms", f"""
SELECT s, p, o FROM (
SELECT '{X}part/' || p_partkey AS s, p, o FROM part, LATERAL (SELECT * FROM (VALUES
 ('{RDF.type}', '{OWL.Class}', 0), ('{RDFS.label}', p_name, 10), ('{RDFS.comment}', chr(10) || ' ' || p_type || ' ' || p_name || ' by ' || p_brand || ' ', 10),
 ('{EX.altName}', p_brand, 0),
 ('{RDFS.subClassOf}', '{X}type/' || lower(p_type), 10)) v(p, o, least_size) WHERE p_size >= least_size)
WHERE p_type = 'ECONOMY'
UNION
SELECT '{X}supplier/' || s_suppkey, p, o FROM supplier JOIN part ON p_partkey = s_suppkey AND p_type = 'ECONOMY', LATERAL (VALUES
 ('{RDF.type}', '{OWL.ObjectProperty}'), ('{RDFS.label}', s_name), ('{RDFS.domain}', '{X}part/' || s_suppkey)) v(p, o))""")
def _(spark, sf):
    iris = frame(spark, sf, "part").where("p_type = 'ECONOMY'").select(
        F.concat(F.lit(f"{X}part/"), F.col("p_partkey").cast("string")).alias("iri"))
    return search.describe_terms(iris, catalog_tbox(spark, sf)).select("s", "p", "o")


@query("d5_term_index", f"""
SELECT 'class' AS kind, '{X}part/' || p_partkey AS iri FROM part WHERE p_type <> 'ECONOMY'
UNION ALL SELECT 'property', '{X}supplier/' || s_suppkey FROM supplier""")
def _(spark, sf):
    """One ontology is inactive: it has the parts of one type."""
    tbox = catalog_tbox(spark, sf)
    off = frame(spark, sf, "part").where("p_type = 'ECONOMY'").select(
        F.concat(F.lit(f"{X}part/"), F.col("p_partkey").cast("string")).alias("s"), F.lit(False).alias("active"))
    return search.term_index(tbox.join(off, "s", "left").withColumn("active", F.coalesce("active", F.lit(True))))


@query("d6_labels", f"""
SELECT '{X}part/' || p_partkey AS iri, p_name AS label FROM part WHERE p_size >= 10
UNION ALL SELECT '{X}supplier/' || s_suppkey, s_name FROM supplier""")
def _(spark, sf):
    return check.labels(catalog_tbox(spark, sf))
