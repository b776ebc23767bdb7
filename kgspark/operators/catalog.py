"""Mappings written in RDF, as catalog rows and as specification objects.

A catalog row is one triples map: ``map_id``, ``source_type``, ``source``, ``s_template``, ``s_column``, ``s_classes``,
``graph`` (an IRI or a template; '' for none), ``poms`` (one entry per predicate and object map), and
``problems``: what is in the graph but not in the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.plans.mapping import (ColumnObj, ConstObj, IriColumn, Mapping, RefObj, Source, TemplateObj, TriplesMap)
from kgspark.session import materialize
from kgspark.terms import IRI, RDF, RR, XSD, Template

JOIN = "array<struct<child:string,parent:string>>"
POM = {"predicate": "string", "om_type": "string", "column": "string", "template": "string", "constant": "string",
       "is_iri": "boolean", "datatype": "string", "language": "string", "term_type": "string", "parent_map": "string", "join": JOIN}

# The properties of the mapping vocabulary that are read.
ONE = ("tableName", "sqlQuery", "template", "column", "constant", "child", "parent", "datatype", "language", "termType",
       "parentTriplesMap", "logicalTable", "subjectMap", "subject")
SEVERAL = ("class", "predicate", "predicateMap", "object", "objectMap", "graph", "graphMap", "joinCondition")


def pom_struct(**given: Column) -> Column:
    """One entry of ``poms``; what is not given is NULL."""
    return F.struct(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in POM.items()])


def _fragment(col: Column) -> Column:
    return F.when(F.contains(col, F.lit("#")), F.concat(F.lit("#"), F.substring_index(col, "#", -1))).otherwise(col)


def _local(col: Column) -> Column:
    return F.substr(col, F.lit(len(str(RR)) + 1))


SPELLINGS = {str(RR.SQLQuery): "sqlQuery"}  # another spelling that is in use


def _nodes(rr: DataFrame) -> DataFrame:
    """One row per node of the mapping graph: its cells, sorted by property name, literals first."""
    name = F.coalesce(*[F.when(F.col("p") == iri, F.lit(n)) for iri, n in SPELLINGS.items()], _local(F.col("p")))
    cell = F.struct(name.alias("name"), (F.col("o_kind") != "literal").alias("late"), "o", "o_kind", "o_dt", "o_lang")
    return (rr.where(~F.col("p").isin(str(RDF.type), str(RR.predicateObjectMap)))
            .groupBy("s").agg(F.sort_array(F.collect_set(cell)).alias("cells")))


def mapping_from_triples(triples: DataFrame) -> DataFrame:
    """Catalog rows of the triples maps in an RDF graph.

    The mapping's statements are read once; maps, properties and object maps then meet along the links of
    the graph. A property with several predicates or object maps gives an entry for each pair. Nothing is
    left out unsaid: whatever a row cannot hold is named in ``problems`` (``has_stubs``: there are some).
    """
    is_map = (F.col("p") == str(RDF.type)) & (F.col("o") == str(RR.TriplesMap))
    rr = materialize(triples.where(F.startswith("p", F.lit(str(RR))) | is_map).select("s", "p", "o", "o_kind", "o_dt", "o_lang"))
    nodes = materialize(_nodes(rr))  # joined once per role a node can have
    maps = rr.where(is_map | F.col("p").isin(str(RR.logicalTable), str(RR.subjectMap))).select("s").distinct()

    def role(name: str, *cells: str) -> DataFrame:
        """The nodes that have some of the cells, under the name of a role; the cells as arrays."""
        def named(n: str) -> Column:
            return F.filter("cells", lambda c: c["name"] == n).alias(n)

        arrays = [named(n) for n in cells]
        strange = F.transform(F.filter("cells", lambda c: ~c["name"].isin([*ONE, *SEVERAL])), lambda c: F.concat(F.lit("rr:"), c["name"]))
        some = F.exists("cells", lambda c: c["name"].isin(list(cells)) | ~c["name"].isin([*ONE, *SEVERAL]))
        return nodes.where(some).select(F.col("s").alias(name), F.struct(*arrays, strange.alias("unknown")).alias(f"{name}_n"))

    def first(col: Column) -> Column:
        return F.get(col, F.lit(0))["o"]

    def surplus(owner: str, *cells: str) -> list[Column]:
        """Problems of a node: more than one value where there is one place, and properties that are not read."""
        held = [F.when(F.size(F.col(f"{owner}_n.{c}")) > 1, F.array(F.lit(f"several rr:{c}"))) for c in cells]
        return [F.coalesce(x, F.array().cast("array<string>")) for x in (*held, F.col(f"{owner}_n.unknown"))]

    def problem(cond: Column, text: str) -> Column:
        return F.when(cond, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))

    # heads
    heads = (maps.join(role("s", "logicalTable", "subjectMap", "subject", "graph", "graphMap", "class"), "s", "left")
             .withColumns({"lt": first(F.col("s_n.logicalTable")), "sm": first(F.col("s_n.subjectMap"))})
             .join(role("lt", "tableName", "sqlQuery"), "lt", "left")
             .join(role("sm", "template", "column", "constant", "termType", "class", "graph", "graphMap"), "sm", "left"))
    graph_maps = F.concat(*[F.coalesce(F.col(c), F.array()) for c in ("s_n.graphMap", "sm_n.graphMap")])
    graphs = F.concat(*[F.coalesce(F.col(c), F.array()) for c in ("s_n.graph", "sm_n.graph")])
    heads = heads.withColumn("gm", first(graph_maps)).join(role("gm", "template", "column", "constant"), "gm", "left")
    table, text = first(F.col("lt_n.tableName")), first(F.col("lt_n.sqlQuery"))
    graph = F.coalesce(first(graphs), first(F.col("gm_n.constant")), first(F.col("gm_n.template")), F.lit(""))
    constant = (F.size("s_n.subject") > 0) | (F.size("sm_n.constant") > 0)
    said = F.concat(
        *surplus("s", "logicalTable", "subjectMap"), *surplus("lt", "tableName", "sqlQuery"),
        *surplus("sm", "template", "column"), *surplus("gm", "template", "constant"),
        problem(table.isNull() & text.isNull(), "no logical table"), problem(F.coalesce(constant, F.lit(False)), "constant subject"),
        problem(F.size(F.array_distinct(F.concat(graphs, graph_maps))) > 1, "several graphs"),
        problem(F.coalesce(F.size("gm_n.column") > 0, F.lit(False)), "graph from a column"),
        problem(F.coalesce(first(F.col("sm_n.termType")) == str(RR.BlankNode), F.lit(False)), "blank-node subject"))
    classes = F.array_sort(F.array_distinct(F.transform(
        F.concat(*[F.coalesce(F.col(c), F.array()) for c in ("s_n.class", "sm_n.class")]), lambda x: x["o"])))
    heads = heads.select(
        "s", F.when(table.isNotNull(), F.lit("tableName")).when(text.isNotNull(), F.lit("sqlQuery")).otherwise(F.lit("unknown")).alias("source_type"),
        F.coalesce(table, text, F.lit("")).alias("source"), F.coalesce(first(F.col("sm_n.template")), F.lit("")).alias("s_template"),
        F.coalesce(first(F.col("sm_n.column")), F.lit("")).alias("s_column"), classes.alias("s_classes"), graph.alias("graph"), said.alias("own"))

    # properties: every predicate with every object map
    links = rr.where(F.col("p") == str(RR.predicateObjectMap)).select(F.col("s").alias("map"), F.col("o").alias("pom")).distinct()
    poms = links.join(role("pom", "predicate", "predicateMap", "object", "objectMap", "graph", "graphMap"), "pom", "left")
    constants = rr.where(F.col("p") == str(RR.constant)).groupBy("s").agg(F.min("o").alias("o"))
    named = (poms.select("pom", F.explode("pom_n.predicateMap").alias("x")).distinct()
             .join(constants.select(F.col("s").alias("node"), F.col("o").alias("c")), F.col("x.o") == F.col("node"), "left")
             .groupBy("pom").agg(F.collect_list(F.coalesce("c", F.lit(""))).alias("mapped")))
    cell = F.transform(F.coalesce("pom_n.objectMap", F.array()), lambda x: F.struct(F.lit(True).alias("node"), x["o"].alias("o"), x["o_kind"].alias("o_kind"),
                                                                                 x["o_dt"].alias("o_dt"), x["o_lang"].alias("o_lang")))
    value = F.transform(F.coalesce("pom_n.object", F.array()), lambda x: F.struct(F.lit(False).alias("node"), x["o"].alias("o"), x["o_kind"].alias("o_kind"),
                                                                               x["o_dt"].alias("o_dt"), x["o_lang"].alias("o_lang")))
    poms = poms.join(named, "pom", "left").select(
        "map", "pom", F.concat(*surplus("pom"), problem(F.coalesce(F.size("pom_n.graph") + F.size("pom_n.graphMap") > 0, F.lit(False)),
                                                        "graph of one property")).alias("own"),
        F.explode_outer(F.concat(F.transform(F.coalesce("pom_n.predicate", F.array()), lambda x: x["o"]),
                                 F.coalesce("mapped", F.array().cast("array<string>")))).alias("predicate"),
        F.concat(cell, value).alias("objects"))
    poms = poms.select("map", "pom", "own", "predicate", F.explode_outer("objects").alias("x")).withColumn(
        "om", F.when(F.col("x.node"), F.col("x.o")))
    pairs = rr.where(F.col("p") == str(RR.joinCondition)).select(F.col("s").alias("om"), F.col("o").alias("jc")).distinct().join(
        role("jc", "child", "parent"), "jc", "left")
    pair = F.struct(F.coalesce(first(F.col("jc_n.child")), F.lit("")).alias("child"), F.coalesce(first(F.col("jc_n.parent")), F.lit("")).alias("parent"))
    pairs = pairs.groupBy("om").agg(F.transform(F.sort_array(F.collect_list(F.struct("jc", pair.alias("pair")))), lambda x: x["pair"]).alias("join"))
    poms = poms.join(role("om", "column", "template", "constant", "datatype", "language", "termType", "parentTriplesMap"), "om", "left").join(pairs, "om", "left")

    def om(name: str) -> Column:
        return first(F.col(f"om_n.{name}"))

    fixed = F.when(F.col("x.node"), F.get(F.col("om_n.constant"), F.lit(0))).otherwise(F.struct(
        F.lit("constant").alias("name"), F.lit(False).alias("late"), F.col("x.o").alias("o"), F.col("x.o_kind").alias("o_kind"), F.col("x.o_dt").alias("o_dt"), F.col("x.o_lang").alias("o_lang")))
    kind = (F.when(F.coalesce("x.node", F.lit(True)) & F.col("om_n").isNull(), F.lit("stub"))
            .when(om("parentTriplesMap").isNotNull() | F.col("join").isNotNull(), F.lit("parentJoin"))
            .when(om("column").isNotNull(), F.lit("column")).when(om("template").isNotNull(), F.lit("template"))
            .when(fixed["o"].isNotNull(), F.lit("constant")).otherwise(F.lit("stub")))
    poms = poms.withColumns({"kind": kind, "fixed": fixed})
    is_literal = (F.col("kind") == "column") | (om("datatype").isNotNull()) | (om("language").isNotNull())
    typed = F.col("kind").isin("column", "template")
    empty = F.lit("")

    def only(name: str, col: Column) -> Column:
        return F.when(F.col("kind") == name, col)

    term_type = F.coalesce(F.when(typed, om("termType")), empty)
    entry = pom_struct(
        predicate=F.coalesce("predicate", empty), om_type=F.col("kind"), column=only("column", om("column")),
        template=only("template", om("template")), constant=only("constant", F.col("fixed.o")),
        is_iri=only("constant", F.col("fixed.o_kind") == "iri"),
        datatype=F.when(typed, F.coalesce(om("datatype"), empty)).otherwise(only("constant", F.coalesce("fixed.o_dt", empty))),
        language=F.when(typed, F.coalesce(om("language"), empty)).otherwise(only("constant", F.coalesce("fixed.o_lang", empty))),
        term_type=F.when(typed, F.when(F.startswith(term_type, F.lit(str(RR))), _local(term_type)).otherwise(term_type)),
        parent_map=only("parentJoin", F.coalesce(_fragment(om("parentTriplesMap")), empty)),
        join=only("parentJoin", F.coalesce("join", F.array().cast(JOIN))))
    said = F.concat(
        "own", F.when(F.col("x.node"), F.concat(*surplus("om", "column", "template", "constant", "datatype", "language", "parentTriplesMap")))
        .otherwise(F.array().cast("array<string>")),
        problem(F.coalesce("predicate", empty) == "", "no predicate"), problem(F.col("kind") == "stub", "no object"),
        problem(term_type == str(RR.BlankNode), "blank-node object"),
        problem((F.col("kind") == "constant") & (F.coalesce("fixed.o_kind", empty) == "bnode"), "blank-node constant"),
        problem((term_type == str(RR.IRI)) & is_literal & (F.coalesce(om("datatype"), om("language")).isNotNull()), "datatype of an IRI"))
    poms = poms.groupBy(F.col("map").alias("s")).agg(
        F.transform(F.sort_array(F.collect_set(F.struct("pom", entry.alias("spec")))), lambda x: x["spec"]).alias("poms"),
        F.flatten(F.collect_list(said)).alias("theirs"))
    rows = heads.join(poms, "s", "left")
    problems = F.array_sort(F.array_distinct(F.concat("own", F.coalesce("theirs", F.array().cast("array<string>")))))
    return rows.select(_fragment(F.col("s")).alias("map_id"), "source_type", "source", "s_template", "s_column", "s_classes", "graph",
                       "poms", problems.alias("problems"), (F.size(problems) > 0).alias("has_stubs"))


def catalog_to_triples(catalog: DataFrame, base: str) -> DataFrame:
    """Catalog rows as a mapping graph; ``base`` is put before map ids, which are fragments.

    Inner nodes are blank nodes named after the map and their place, so that the same rows give the same
    graph. Reading it back gives the same rows.
    """
    none, empty = F.lit(None).cast("string"), F.lit("")
    me = F.concat(F.lit(base), F.col("map_id"))
    own = F.md5(F.col("map_id"))

    def node(kind: str, *place: Column) -> Column:
        return F.concat_ws("_", F.lit(kind), own, *[p.cast("string") for p in place])

    def cell(s: Column, s_kind: str, p: str, o: Column, o_kind, o_dt: Column = none, o_lang: Column = none, when: Column | None = None) -> Column:
        row = F.struct(s.alias("s"), F.lit(s_kind).alias("s_kind"), F.lit(str(p)).alias("p"), o.cast("string").alias("o"),
                       (o_kind if isinstance(o_kind, Column) else F.lit(o_kind)).alias("o_kind"), o_dt.alias("o_dt"), o_lang.alias("o_lang"))
        return F.when(o.isNotNull() & (o.cast("string") != "") & (F.lit(True) if when is None else when), row)

    def text(s: Column, p: str, o: Column, **how) -> Column:
        return cell(s, "bnode", p, o, "literal", F.lit(str(XSD.string)), **how)

    lt, sm, gm = node("lt"), node("sm"), node("gm")
    graph = F.coalesce("graph", empty)
    is_template = F.contains(graph, F.lit("{"))
    head = F.concat(
        F.array(cell(me, "iri", RDF.type, F.lit(str(RR.TriplesMap)), "iri"),
                cell(me, "iri", RR.logicalTable, lt, "bnode", when=F.col("source_type") != "unknown"),
                text(lt, RR.tableName, F.col("source"), when=F.col("source_type") == "tableName"),
                text(lt, RR.sqlQuery, F.col("source"), when=F.col("source_type") == "sqlQuery"),
                cell(me, "iri", RR.subjectMap, sm, "bnode"), text(sm, RR.template, F.col("s_template")), text(sm, RR.column, F.col("s_column")),
                cell(sm, "bnode", RR.graph, graph, "iri", when=~is_template), cell(sm, "bnode", RR.graphMap, gm, "bnode", when=is_template),
                text(gm, RR.template, graph, when=is_template)),
        F.transform(F.coalesce("s_classes", F.array().cast("array<string>")), lambda c: cell(sm, "bnode", RR["class"], c, "iri")))

    def prop(x: Column, i: Column) -> Column:
        pom, om = node("pom", i), node("om", i)
        is_join = x["om_type"] == "parentJoin"
        constant_kind = F.when(x["is_iri"], F.lit("iri")).otherwise(F.lit("literal"))
        fixed_dt = F.when(x["is_iri"], none).otherwise(F.nullif(x["datatype"], empty))
        fixed = x["om_type"] == "constant"
        cells = F.array(
            cell(me, "iri", RR.predicateObjectMap, pom, "bnode"), cell(pom, "bnode", RR.predicate, x["predicate"], "iri"),
            cell(pom, "bnode", RR.objectMap, om, "bnode", when=x["om_type"] != "stub"),
            text(om, RR.column, x["column"]), text(om, RR.template, x["template"]),
            cell(om, "bnode", RR.constant, x["constant"], constant_kind, fixed_dt, F.nullif(x["language"], empty), when=fixed),
            cell(om, "bnode", RR.datatype, x["datatype"], "iri", when=~fixed), text(om, RR.language, x["language"], when=~fixed),
            cell(om, "bnode", RR.termType, F.concat(F.lit(str(RR)), F.nullif(x["term_type"], empty)), "iri"),
            cell(om, "bnode", RR.parentTriplesMap, F.concat(F.lit(base), F.nullif(x["parent_map"], empty)), "iri", when=is_join))
        pairs = F.transform(F.coalesce(x["join"], F.array().cast(JOIN)), lambda j, k: F.array(
            cell(om, "bnode", RR.joinCondition, node("jc", i, F.lpad(k.cast("string"), 6, "0")), "bnode"),
            text(node("jc", i, F.lpad(k.cast("string"), 6, "0")), RR.child, j["child"]),
            text(node("jc", i, F.lpad(k.cast("string"), 6, "0")), RR.parent, j["parent"])))
        return F.concat(cells, F.flatten(pairs))

    blank = F.array().cast(f"array<struct<{','.join(f'{n}:{t}' for n, t in POM.items())}>>")
    props = F.flatten(F.transform(F.coalesce("poms", blank), lambda x, i: prop(x, F.lpad(i.cast("string"), 6, "0"))))
    return catalog.select(F.explode(F.concat(head, props)).alias("t")).where("t IS NOT NULL").select("t.*")


def mapping_spec(catalog: DataFrame, unique_keys: dict[str, tuple] | None = None, trusted: bool = False) -> Mapping:
    """Specification objects of catalog rows, for querying.

    ``unique_keys``: map id -> columns known to be unique; ``trusted``: foreign keys have no
    dangling values. A map that cannot be held as a whole is an error that names it.
    """
    maps = []
    for r in catalog.toLocalIterator():
        if r.problems:
            raise ValueError(f"triples map {r.map_id} cannot be held: {', '.join(r.problems)}")
        if r.source_type == "unknown" or not (r.s_template or r.s_column):
            raise ValueError(f"triples map {r.map_id} has no logical table or no subject")
        source = Source.table(r.source) if r.source_type == "tableName" else Source.sql(r.source)
        subject = Template(r.s_template) if r.s_template else IriColumn(r.s_column)
        key = (unique_keys or {}).get(r.map_id, ())
        props = [(IRI(p.predicate), _object(r.map_id, p, trusted)) for p in r.poms or []]
        maps.append(TriplesMap(r.map_id, source, subject, r.s_classes or [], props, key, r.graph or None))
    return Mapping(sorted(maps, key=lambda m: m.id))


def _object(map_id: str, p, trusted: bool):
    if p.om_type == "column":
        return IriColumn(p.column) if p.term_type == "IRI" else ColumnObj(p.column, p.datatype or None, p.language or None)
    if p.om_type == "template":
        literal = p.datatype or (str(XSD.string) if p.term_type == "Literal" else None)
        return TemplateObj(p.template, None if p.language else literal, p.language or None)
    if p.om_type == "constant":
        return ConstObj(p.constant, True) if p.is_iri else ConstObj(p.constant, False, p.datatype or None, p.language or None)
    if p.om_type == "parentJoin":
        return RefObj(p.parent_map, [(j.child, j.parent) for j in p.join or []], trusted)
    raise ValueError(f"triples map {map_id}: the object of {p.predicate} cannot be held")
