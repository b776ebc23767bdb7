"""Ontology-based checks of graph patterns and of instance graphs.

``patterns`` has one row per triple pattern: unit_id, s, s_kind, p, p_kind, o, o_kind, with kind
in var, bnode, iri, literal; a unit is a logged query or a graph. Rule results carry ``n``, the
number of times a violation occurs: rows are counted per (unit, node, property) before any join,
so a node met by very many statements enters a join once per property.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.operators.closure import closure
from kgspark.session import materialize
from kgspark.terms import IRI, IRI_T, OWL, OWL_NS, RDF, RDF_NS, RDFS, RDFS_NS, SKOS_NS

if TYPE_CHECKING:
    from kgspark.plans.branch import Branch
    from kgspark.plans.kg import KG

# Reserved names of variables, and the universal classes.
VARIABLE_NS = "urn:obqc:qq#"
TOP_CLASSES = (str(RDFS.Resource), str(OWL.Thing))
STANDARD_NAMESPACES = (RDF_NS, RDFS_NS, OWL_NS, SKOS_NS)
# Rules in the order they are reported, with their message texts.
RULES = {
    "double_domain": "The property {p} has domain {domp}, and {q} has domain {domq}, and these are incompatible.",
    "domain_range": "The property {p} has range {rangep}, and {q} has domain {domq}, "
                    "and these are incompatible with the query.",
    "domain": "The property {p} has domain {domain}, but its subject {s} is a {cls}, "
              "which isn't a subclass of {domain}.",
    "incorrect_property": "The property {p} isn't defined in the ontology. Please only use properties from the "
                          "ontology, or from a standard source like rdf:, rdfs:, owl:, or skos:.",
    "range": "The property {p} has range {range}, but its object {o} is a {cls}, "
             "which isn't a subclass of {range}.",
    "double_range": "The property {p} has range {rangep}, and {q} has range {rangeq}, and these are incompatible.",
}
BINDINGS = {
    "double_domain": ["p", "domp", "q", "domq"], "domain_range": ["p", "rangep", "q", "domq"],
    "domain": ["p", "domain", "s", "cls"], "incorrect_property": ["p"],
    "range": ["p", "range", "o", "cls"], "double_range": ["p", "rangep", "q", "rangeq"],
}
# Counts are products of counts: at most 38 digits, far beyond a bigint.
COUNT = "decimal(38,0)"


def pattern_rows(spark: SparkSession, unit_id: str, patterns) -> DataFrame:
    """Builder patterns as rows: ``?v`` is a variable, ``_:b`` a blank node."""
    def split(x):
        if isinstance(x, IRI):
            return str(x), "iri"
        if isinstance(x, str) and x.startswith("?"):
            return x[1:], "var"
        if isinstance(x, str) and x.startswith("_:"):
            return x[2:], "bnode"
        return str(getattr(x, "value", x)), "literal"

    steps = [(s, q, o) for s, p, o in patterns for q in _plain_predicates(p)]
    rows = [(unit_id, *split(s), *split(p), *split(o)) for s, p, o in steps]
    return spark.createDataFrame(rows, PATTERNS_DDL)


PATTERNS_DDL = "unit_id string, s string, s_kind string, p string, p_kind string, o string, o_kind string"


def _plain_predicates(p):
    from kgspark.plans.paths import Path, _predicates
    return list(_predicates(p)) if isinstance(p, Path) else [p]


def patterns_df(rows: DataFrame) -> DataFrame:
    """Patterns as a graph per unit: variables and blank nodes become reserved IRIs; a set."""
    def skolem(x: str) -> Column:
        kind, v = F.col(f"{x}_kind"), F.col(x)
        return (F.when(kind == "var", F.concat(F.lit(VARIABLE_NS), v))
                .when(kind == "bnode", F.concat(F.lit(VARIABLE_NS + "b_"), v)).otherwise(v)).alias(x)

    def kind(x: str) -> Column:
        return F.when(F.col(f"{x}_kind") == "literal", F.lit("literal")).otherwise(F.lit("iri")).alias(f"{x}_kind")

    return rows.select("unit_id", skolem("s"), kind("s"), skolem("p"), skolem("o"), kind("o")).distinct()


def _node_kind(prefix: str = "") -> Column:
    """The kind of an object; equal text of two datatypes is two terms."""
    literal = F.concat_ws("|", F.lit("literal"), prefix + "o_dt", prefix + "o_lang")
    return F.when(F.col(prefix + "o_kind") == "literal", literal).otherwise(F.lit("iri"))


def instance_patterns(triples: DataFrame, unit: Column) -> DataFrame:
    """An instance graph in the form the rules read; blank nodes keep their own names."""
    return triples.select(unit.alias("unit_id"), "s", F.lit("iri").alias("s_kind"), "p", "o", _node_kind().alias("o_kind"))


# ---- the ontology side ---------------------------------------------------------------------

def add_top_classes(tbox: DataFrame) -> DataFrame:
    """Every class term is below rdfs:Resource and owl:Thing, and these below one another."""
    iri_o, iri_s = F.col("o_kind") == "iri", F.col("s_kind") == "iri"
    sub, cols = str(RDFS.subClassOf), tbox.columns
    is_class = (F.col("p") == str(RDF.type)) & F.col("o").isin(str(RDFS.Class), str(OWL.Class)) & iri_s
    end = F.col("p").isin(str(RDFS.domain), str(RDFS.range)) & iri_o
    link = F.col("p") == sub
    terms = F.array(F.when(is_class | (link & iri_s), F.col("s")), F.when(end | (link & iri_o), F.col("o")),
                    *[F.lit(c) for c in TOP_CLASSES])
    classes = tbox.select(F.explode(terms).alias("s")).where("s IS NOT NULL").distinct()
    tops = F.explode(F.array(*[F.lit(c) for c in TOP_CLASSES])).alias("o")
    added = classes.select("s", tops).where("s <> o")
    fill = {"s": F.col("s"), "s_kind": F.lit("iri"), "p": F.lit(sub), "o": F.col("o"), "o_kind": F.lit("iri")}
    added = added.select(*[fill.get(c, F.lit(None).cast("string")).alias(c) for c in cols])
    return tbox.union(added).distinct()


def subclass_closure(tbox: DataFrame) -> DataFrame:
    """(src, dst): src is a subclass of dst; reflexive over the class terms met."""
    edges = tbox.where((F.col("p") == str(RDFS.subClassOf)) & (F.col("s_kind") == "iri") & (F.col("o_kind") == "iri"))
    return closure(edges.select(F.col("s").alias("src"), F.col("o").alias("dst")), reflexive=True)


def _ends(tbox: DataFrame, predicate, name: str) -> DataFrame:
    rows = tbox.where((F.col("p") == str(predicate)) & (F.col("o_kind") == "iri"))
    return rows.select(F.col("s").alias("p"), F.col("o").alias(name)).distinct()


# What meets what at a node: the role on the left, the role on the right. Role d is a property with
# a domain (met at its subject), r one with a range (met at its object), t a class of the node.
_MEETINGS = {"double_domain": "dd", "domain_range": "rd", "domain": "dt", "range": "rt", "double_range": "rr"}


@dataclass(frozen=True)
class GraphPatterns:
    """The statements of a mapped graph as one unit, without being written out: what the rules ask is
    counted from the tables."""
    kg: "KG"
    unit_id: str

    def uses(self, role: str, name: str) -> list["Branch"]:
        """The nodes that have a role, a row each time: ``name`` is a property, for role t a class."""
        pattern = ("?o", RDF.type, IRI(name)) if role == "t" else ("?s", IRI(name), "?o") if role == "r" else ("?o", IRI(name), "?s")
        return [b.keep(["o"]) for b in self.kg.match(*pattern).branches]

    def used(self) -> DataFrame:
        """(unit_id, p): the properties that have a statement; one is read of each."""
        found = [b.df.limit(1).select(F.lit(self.unit_id).alias("unit_id"), F.lit(str(p)).alias("p"))
                 for p in self.kg.predicates() for b in self.kg.match("?s", IRI(p), "?o").branches]
        found = found or [self.kg.spark.createDataFrame([], "unit_id string, p string")]
        return materialize(reduce(DataFrame.union, found))  # a few rows; what is constant in each is not planned with


def _meetings(group: list[tuple[tuple[str, str], "Branch"]], wrong: list[tuple], rules: dict[str, str]) -> list[DataFrame]:
    """(rule, a, b, c, d, n) of the uses whose nodes may be the same: one row per node with a count per use."""
    from kgspark.plans.bindings import triple_struct
    from kgspark.plans.branch import Branch
    from kgspark.plans.expr import Term
    from kgspark.plans.kg import _parts
    info, uses = group[0][1].vars["o"], sorted({u for u, _ in group})
    by_key = info.template is not None and info.template.injective and len({b.vars["o"].signature for _, b in group}) == 1
    any_iri = Term(F.lit(""), IRI_T)

    def text(b: "Branch") -> list[Column]:
        t = triple_struct(any_iri, any_iri, b.term("o"))
        return [t["o"].alias("node"), F.when(t["o_kind"] == "literal", F.concat_ws("|", F.lit("literal"), t["o_dt"], t["o_lang"]))
                .otherwise(F.lit("iri")).alias("kind")]

    keys, frames, ways = info.columns("o") if by_key else ["node", "kind"], [], 1
    for use, b in group:
        rows = Branch(b.spark, b.vars, b.df, consts=b.consts)
        rows, u = rows.df if by_key else rows.df.select(*text(rows)), F.lit(uses.index(use)).alias("__u")
        if b.scan and b.scan.subjects:  # a row is a node
            rows = rows.select(*keys, u, F.lit(1).cast("bigint").alias("__n"))
        else:
            rows = rows.groupBy(*keys).agg(F.count("*").alias("__n")).select(*keys, u, "__n")
        frames.append(rows)
        ways = max(ways, _parts(b.scan.source if b.scan else b.df))
    # What is moved is one row per node and use at most: more parts for large tables keep each of them small.
    each = [F.sum(F.when(F.col("__u") == i, F.col("__n"))).alias(f"__n{i}") for i in range(len(uses))]
    nodes = reduce(DataFrame.union, frames).repartition(ways, *keys).groupBy(*keys).agg(*each)
    pairs = [(x, y) for x, y in wrong if x[:2] in uses and y[:2] in uses]
    of = {u: F.col(f"__n{i}") for i, u in enumerate(uses)}

    def row(x, y, c: Column, n: Column) -> Column:
        return F.when(n.isNotNull(), F.struct(F.lit(rules[x[0] + y[0]]).alias("rule"), F.lit(x[1]).alias("a"), F.lit(x[2]).alias("b"),
                                              c.alias("c"), F.lit(y[2]).alias("d"), n.alias("n")))

    typed, paired = [p for p in pairs if p[1][0] == "t"], [p for p in pairs if p[1][0] != "t"]
    out = []
    if typed:
        b = group[0][1]
        node = Branch(b.spark, b.vars, nodes).term("o").text if by_key else F.col("node")
        out.append((nodes, [row(x, y, node, F.when(of[y[:2]].isNotNull(), of[x[:2]]).cast(COUNT)) for x, y in typed]))
    if paired:
        products = [of[x[:2]].cast("decimal(19,0)") * of[y[:2]].cast("decimal(19,0)") for x, y in paired]
        sums = nodes.agg(*[F.sum(m.cast(COUNT)).cast(COUNT).alias(f"__m{i}") for i, m in enumerate(products)])
        out.append((sums, [row(x, y, F.lit(y[1]), F.col(f"__m{i}")) for i, (x, y) in enumerate(paired)]))
    return [df.select(F.explode(F.array(*structs)).alias("t")).where("t IS NOT NULL").select("t.*") for df, structs in out]


class Checker:
    """The six rules against one ontology.

    Its side tables are written once, so that Spark knows their bytes and broadcasts or shuffles them by size.
    """

    def __init__(self, tbox: DataFrame):
        self.tbox = tbox

    @cached_property
    def ends(self) -> DataFrame:
        """(role, p, c): IRI domains and ranges; union classes, being blank nodes, say nothing."""
        sides = [_ends(self.tbox, RDFS.domain, "c").withColumn("role", F.lit("d")),
                 _ends(self.tbox, RDFS.range, "c").withColumn("role", F.lit("r"))]
        return materialize(sides[0].unionByName(sides[1]))

    @cached_property
    def below(self) -> DataFrame:
        return materialize(subclass_closure(add_top_classes(self.tbox)).where("src <> dst"))

    @cached_property
    def declared(self) -> DataFrame:
        return materialize(self.tbox.where(F.col("p") == str(RDF.type)).select(F.col("s").alias("p")).distinct())

    def facts(self, patterns: DataFrame, roles: str = "drt") -> DataFrame:
        """What each node of each unit is, by role, property and class, with a count.

        One pass over the patterns: those no rule can use are dropped by a map-side join before
        they are counted, and counting shrinks hot nodes before anything is moved.
        """
        def fact(role: str, node: str, cls: Column) -> Column:
            return F.struct(F.lit(role).alias("role"), F.col(node).alias("node"), F.col(f"{node}_kind").alias("kind"),
                            F.when(F.lit(role != "t"), F.col("p")).alias("p"), cls.alias("cls"))

        no_class = F.lit(None).cast("string")
        typed = F.when(F.col("p") == str(RDF.type), fact("t", "s", F.col("o")))
        made = {"d": fact("d", "s", no_class), "r": fact("r", "o", no_class), "t": typed}
        rows = patterns.select("unit_id", F.explode(F.array(*[made[r] for r in roles])).alias("f")).where("f IS NOT NULL")
        rows = rows.select("unit_id", "f.*").join(self.ends, ["role", "p"], "left")
        rows = rows.withColumn("c", F.coalesce("c", "cls")).where("c IS NOT NULL")
        return rows.groupBy("unit_id", "node", "kind", "role", "p", "c").agg(F.count("*").alias("n"))

    def graph_violations(self, graph: "GraphPatterns", rules) -> DataFrame:
        """The violations of a mapped graph. The properties and classes that may not meet are found first, and only
        their statements are read, if their nodes can be the same. Nodes are grouped once, by their key columns."""
        known, classes = [str(p) for p in graph.kg.predicates()], [str(c) for c in graph.kg.classes()]
        wanted = {_MEETINGS[r]: r for r in rules}
        ends = sorted((r.role, r.p, r.c) for r in self.ends.where(F.col("p").isin(known)).collect())
        ends += [("t", c, c) for c in classes] if {"dt", "rt"} & set(wanted) else []
        met = sorted({c for *_, c in ends})
        below = {(r.src, r.dst) for r in self.below.where(F.col("src").isin(met) & F.col("dst").isin(met)).collect()}
        # A class of the node must be below the end; two ends must be related one way or the other.
        wrong = [(x, y) for x in ends for y in ends
                 if x[0] + y[0] in wanted and (x[0] != y[0] or x[1] < y[1]) and x[2] != y[2] and (y[2], x[2]) not in below
                 and (y[0] == "t" or (x[2], y[2]) not in below)]
        uses = {u: graph.uses(*u) for u in sorted({e[:2] for pair in wrong for e in pair})}

        def may_meet(a: "Branch", b: "Branch") -> bool:
            return not a.vars["o"].disjoint(b.vars["o"])

        partners = {u: [b for x, y in wrong for v, w in ((x, y), (y, x)) if v[:2] == u for b in uses[w[:2]]] for u in uses}
        groups: list[list[tuple]] = []
        for use, b in [(u, b) for u in uses for b in uses[u] if any(may_meet(b, x) for x in partners[u])]:
            same = [g for g in groups if any(may_meet(b, x) for _, x in g)]
            groups = [g for g in groups if g not in same] + [[*(x for g in same for x in g), (use, b)]]
        found = [rows for g in groups for rows in _meetings(g, wrong, wanted)]
        if not found:
            return self.ends.sparkSession.createDataFrame([], f"unit_id string, rule string, a string, b string, c string, d string, n {COUNT}")
        out = reduce(DataFrame.union, found)
        return out.select(F.lit(graph.unit_id).alias("unit_id"), "rule", "a", "b", "c", "d", F.col("n").cast(COUNT).alias("n"))

    def violations(self, patterns: "DataFrame | GraphPatterns", rules=tuple(_MEETINGS)) -> DataFrame:
        """(unit_id, rule, a, b, c, d, n) of the rules about nodes: all of them in one join.

        At a node there is one row per property and class of the ontology, however many
        statements meet there, so a hot node adds no more pairs than any other.
        """
        wanted = [_MEETINGS[r] for r in rules]
        if isinstance(patterns, GraphPatterns):
            return self.graph_violations(patterns, rules)
        roles = "".join(sorted(set("".join(wanted))))
        facts = materialize(self.facts(patterns, roles))  # both sides of the join
        key = ["unit_id", "node", "kind"]
        right = facts.select(*key, *[F.col(c).alias(f"{c}2") for c in ("role", "p", "c", "n")])
        meeting = F.concat("role", "role2")
        met = facts.join(right, key).where(meeting.isin(wanted) & ((F.col("role") != F.col("role2")) | (F.col("p") < F.col("p2"))))
        met = met.where("c <> c2")
        # A class of the node must be below the end; two ends must be related one way or the other.
        met = met.join(self.below.select(F.col("src").alias("c2"), F.col("dst").alias("c")), ["c", "c2"], "left_anti")
        both = self.below.select(F.col("src").alias("c"), F.col("dst").alias("c2"), F.lit(True).alias("two_ways"))
        met = met.withColumn("two_ways", F.col("role2") != "t").join(both, ["c", "c2", "two_ways"], "left_anti")
        rule = F.element_at(F.create_map(*[F.lit(x) for r, m in _MEETINGS.items() for x in (m, r)]), meeting)
        is_type = F.col("role2") == "t"
        weight = F.col("n").cast("decimal(19,0)") * F.when(is_type, F.lit(1)).otherwise(F.col("n2")).cast("decimal(19,0)")
        return (met.groupBy("unit_id", rule.alias("rule"), F.col("p").alias("a"), F.col("c").alias("b"),
                            F.when(is_type, F.col("node")).otherwise(F.col("p2")).alias("x"), F.col("c2").alias("d"))
                .agg(F.sum(weight.cast(COUNT)).cast(COUNT).alias("n"))
                .select("unit_id", "rule", "a", "b", F.col("x").alias("c"), "d", "n"))

    def _one(self, patterns: DataFrame, rule: str) -> DataFrame:
        names = zip("abcd", BINDINGS[rule])
        return self.violations(patterns, (rule,)).select("unit_id", *[F.col(c).alias(n) for c, n in names], "n")

    def double_domain(self, patterns: DataFrame) -> DataFrame:
        return self._one(patterns, "double_domain")

    def domain_range(self, patterns: DataFrame) -> DataFrame:
        return self._one(patterns, "domain_range")

    def domain(self, patterns: DataFrame) -> DataFrame:
        return self._one(patterns, "domain")

    def range(self, patterns: DataFrame) -> DataFrame:
        return self._one(patterns, "range")

    def double_range(self, patterns: DataFrame) -> DataFrame:
        return self._one(patterns, "double_range")

    def incorrect_property(self, patterns: DataFrame) -> DataFrame:
        own = reduce(lambda a, b: a | b, [F.startswith("p", F.lit(ns)) for ns in (VARIABLE_NS, *STANDARD_NAMESPACES)])
        used = patterns.used() if isinstance(patterns, GraphPatterns) else patterns.select("unit_id", "p")
        used = used.where(~own).distinct()
        return used.join(self.declared, "p", "left_anti").select("unit_id", "p", F.lit(1).cast(COUNT).alias("n"))

    def all(self, patterns: DataFrame) -> DataFrame:
        """Every violation: unit_id, rule_order, rule, message, bindings (display form), n."""
        none = F.lit(None).cast("string")
        unknown = self.incorrect_property(patterns).select(
            "unit_id", F.lit("incorrect_property").alias("rule"), F.col("p").alias("a"),
            *[none.alias(c) for c in "bcd"], "n")
        found = _displayed(self.violations(patterns).union(unknown), labels(self.tbox))

        def by_rule(build) -> Column:
            out = None
            for rule in RULES:
                hit = F.col("rule") == rule
                out = F.when(hit, build(rule)) if out is None else out.when(hit, build(rule))
            return out

        def message(rule: str) -> Column:
            shown, pieces = dict(zip(BINDINGS[rule], "abcd")), []
            for chunk in RULES[rule].split("{"):
                name, brace, tail = chunk.partition("}")
                pieces += [F.col(shown[name]), F.lit(tail)] if brace else [F.lit(chunk)]
            return F.concat(*pieces)

        def binding(rule: str) -> Column:
            return F.create_map(*[x for c, n in zip("abcd", BINDINGS[rule]) for x in (F.lit(n), F.col(c))])

        order = list(RULES)
        return found.select("unit_id", by_rule(lambda r: F.lit(order.index(r) + 1)).alias("rule_order"), "rule",
                            by_rule(message).alias("message"), by_rule(binding).alias("bindings"), "n")

    def summary(self, units: DataFrame, patterns: DataFrame) -> DataFrame:
        """(unit_id, ok, n) for every unit, also those without violations or patterns."""
        found = self.violations(patterns).select("unit_id", "n").union(
            self.incorrect_property(patterns).select("unit_id", "n"))
        counts = found.groupBy("unit_id").agg(F.sum("n").cast(COUNT).alias("n"))
        joined = units.select("unit_id").distinct().join(counts, "unit_id", "left")
        return joined.select("unit_id", F.col("n").isNull().alias("ok"), F.coalesce("n", F.lit(0)).cast(COUNT).alias("n"))


def not_available(units: DataFrame) -> DataFrame:
    """The report without an ontology: one row per unit, never a pass."""
    return units.select("unit_id").distinct().select(
        "unit_id", F.lit(0).alias("rule_order"), F.lit("not_available").alias("rule"),
        F.lit("Ontology not loaded").alias("message"),
        F.lit(None).cast("map<string,string>").alias("bindings"), F.lit(1).cast(COUNT).alias("n"))


def labels(tbox: DataFrame) -> DataFrame:
    """One rdfs:label per IRI (the least, so the choice is fixed)."""
    rows = tbox.where((F.col("p") == str(RDFS.label)) & (F.col("s_kind") == "iri") & (F.col("o_kind") == "literal"))
    return rows.groupBy(F.col("s").alias("iri")).agg(F.min("o").alias("label"))


def short_name(col: Column) -> Column:
    """``?v`` for a variable, ``_:b`` for a blank node, else the last part of the IRI."""
    local = F.substr(col, F.lit(len(VARIABLE_NS) + 1))
    variable = F.when(F.startswith(local, F.lit("b_")), F.concat(F.lit("_:"), F.substr(local, F.lit(3)))).otherwise(
        F.concat(F.lit("?"), local))
    segment = F.substring_index(col, "/", -1)
    return (F.when(F.startswith(col, F.lit(VARIABLE_NS)), variable)
            .when(F.contains(col, F.lit("#")), F.substring_index(col, "#", -1))
            .otherwise(F.when(segment == "", col).otherwise(segment)))


def display(df: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """Replace a term column by its display form: variable, label, or last IRI part."""
    table = names.select(F.col("iri").alias(column), F.col("label").alias("__label"))
    return df.join(table, column, "left").withColumn(column, _shown(F.col(column), F.col("__label"))).drop("__label")


def _shown(term: Column, label: Column) -> Column:
    own = F.startswith(term, F.lit(VARIABLE_NS))
    return F.when(own, short_name(term)).otherwise(F.coalesce(label, short_name(term)))


def _displayed(found: DataFrame, names: DataFrame) -> DataFrame:
    """Violations with all their terms in display form: the terms of a row meet the labels in one join."""
    key = ["__row", "unit_id", "rule", "n"]
    cells = (found.withColumn("__row", F.monotonically_increasing_id())
             .select(*key, F.posexplode(F.array(*"abcd")).alias("__i", "iri"))
             .join(names, "iri", "left").withColumn("__shown", _shown(F.col("iri"), F.col("label"))))
    return cells.groupBy(*key).agg(*[F.max(F.when(F.col("__i") == i, F.col("__shown"))).alias(c) for i, c in enumerate("abcd")])
