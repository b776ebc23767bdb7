"""The knowledge graph: a mapping, an ontology and tables, queried by triple patterns."""

from __future__ import annotations

import itertools
from collections import defaultdict
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark import terms as tm
from kgspark.plans import branch as br
from kgspark.plans import paths as pa
from kgspark.plans.bindings import TRIPLES_DDL, Bindings, inline, triple_struct
from kgspark.plans.branch import Branch, Scan, Var, qcol
from kgspark.plans.expr import Term, _same_resource
from kgspark.plans.mapping import (ColumnObj, ConstObj, IriColumn, Mapping, ObjectMap, RefObj, Tables,
                                   TemplateObj, TriplesMap)
from kgspark.plans.ontology import Ontology
from kgspark.terms import IRI, IRI_T, RDF, STRING_T, XSD, Template

PART_BYTES = 8 << 20  # of a table, for each part of its nodes
TRIPLE_BYTES = 1 << 20  # of a table without a key, for each part in which its triples are made distinct in memory
MOST_PARTS = 1 << 14  # of a table whose bytes are known
_fresh = itertools.count()


def is_var(x) -> bool:
    return isinstance(x, str) and not isinstance(x, IRI) and x.startswith("?")


def hidden() -> str:
    return f"?kgh{next(_fresh)}"


class KG:
    """``reasoning`` uses the ontology's inverses, hierarchies, domains and ranges in patterns.

    ``strict`` refuses projections whose variables are not uniquely typed.
    """

    def __init__(self, spark: SparkSession, mapping: Mapping, ontology: DataFrame | Ontology | None = None,
                 tables: dict[str, DataFrame] | str | Tables | None = None, *, reasoning: bool = True,
                 strict: bool = False):
        self.spark, self.mapping, self.strict = spark, mapping, strict
        self.tables = tables if isinstance(tables, Tables) else Tables(spark, tables)
        self.tbox = ontology if isinstance(ontology, DataFrame) else None
        if isinstance(ontology, DataFrame):
            used = {str(t) for m in mapping.maps for t in (*m.classes, *(p for p, _ in m.properties))}
            schema = Ontology.from_df(ontology, used)
        else:
            schema = ontology or Ontology()
        self.ontology = schema if reasoning else Ontology()
        self._frames: dict[str, DataFrame] = {}
        self._subjects: dict[str, Term] = {}
        self._objects: dict[tuple[str, int], tuple] = {}

    # -- mapped terms ------------------------------------------------------------------------
    def frame(self, m: TriplesMap) -> DataFrame:
        if m.id not in self._frames:
            self._frames[m.id] = self.tables.load(m.source)
        return self._frames[m.id]

    def _node(self, node, df: DataFrame, column=lambda c: c) -> Term:
        """An IRI made by a template or held in a column; ``column`` renames source columns."""
        if isinstance(node, IriColumn):
            return Term(qcol(column(node.column)).cast("string"), IRI_T)
        types = [df.schema[column(c)].dataType for c in node.columns]
        keys = [tm.key_column(qcol(column(c)), t) for c, t in zip(node.columns, types)]
        families = [tm.key_family(t) for t in types]
        if not node.injective:
            return Term(node.render(keys, families), IRI_T)
        return Term(None, IRI_T, template=node, keys=keys, families=families)

    def _subject(self, m: TriplesMap) -> Term:
        if m.id not in self._subjects:
            self._subjects[m.id] = self._node(m.subject, self.frame(m))
        return self._subjects[m.id]

    def _object(self, m: TriplesMap, om: ObjectMap):
        key = (m.id, id(om))
        if key not in self._objects:
            self._objects[key] = self._map_object(m, om, self.frame(m))
        return self._objects[key]

    def _map_object(self, m: TriplesMap, om: ObjectMap, df: DataFrame):
        """(term, frame, semi-joins, several): ``several`` when a row may give equal triples."""
        if isinstance(om, ColumnObj):
            source = df.schema[om.column].dataType
            if om.lang_column:
                tag, empty = F.coalesce(qcol(om.lang_column).cast("string"), F.lit("")), F.lit("")
                text, plain = tm.lexical(qcol(om.column), source), F.lit(str(XSD.string))
                cell = F.struct(F.lit("literal").alias("kind"), text.alias("value"),
                                F.when(tag == "", plain).otherwise(empty).alias("dt"), tag.alias("lang"))
                return Term(F.when(text.isNotNull(), cell), tm.MIXED_T), df, (), False
            if om.lang:
                return Term(tm.lexical(qcol(om.column), source), tm.literal_type(lang=om.lang)), df, (), False
            dt = om.dt or tm.xsd_of_spark(source)
            return Term(tm.typed(qcol(om.column), source, dt, om.decimal), tm.literal_type(dt)), df, (), False
        if isinstance(om, IriColumn):
            return self._node(om, df), df, (), False
        if isinstance(om, TemplateObj):
            if om.dt is None and om.lang is None:
                return self._node(om.template, df), df, (), False
            cols = [tm.lexical(qcol(c), df.schema[c].dataType) for c in om.template.columns]
            text = om.template.render_text(cols)
            if om.lang:
                return Term(text, tm.literal_type(lang=om.lang)), df, (), False
            target = tm.spark_type_of(om.dt)
            return Term(text if target == "string" else text.try_cast(target), tm.literal_type(om.dt)), df, (), False
        if isinstance(om, ConstObj):
            value = IRI(om.value) if om.is_iri else (tm.Lit(om.value, om.dt, om.lang) if om.dt or om.lang else om.value)
            col, rdf_type = tm.python_literal(value)
            return Term(col, rdf_type, const=str(value) if om.is_iri else None), df, (), False
        return self._parent(m, om, df)

    def _parent(self, m: TriplesMap, om: RefObj, df: DataFrame):
        parent = self.mapping.by_id(om.parent)
        if not om.join:
            return self._node(parent.subject, df), df, (), False
        pdf = self.frame(parent)
        child_of = {p: c for c, p in om.join}
        needed = [parent.subject.column] if isinstance(parent.subject, IriColumn) else list(parent.subject.columns)
        if not isinstance(parent.subject, IriColumn) and parent.subject.injective and set(needed) <= set(child_of):
            # The parent's IRI is made of the join columns, so the child's own columns build it.
            families = [tm.key_family(pdf.schema[c].dataType) for c in needed]
            keys = []
            for c, family in zip(needed, families):
                child = df.schema[child_of[c]].dataType
                key = tm.key_column(qcol(child_of[c]), child)
                if family != tm.key_family(child):
                    key = key.try_cast("bigint" if family == "long" else "string")
                keys.append(key)
            term = Term(None, IRI_T, template=parent.subject, keys=keys, families=families)
            semis = () if om.trusted else (((parent.id, om.join), pdf, om.join),)
            return term, df, semis, False
        wanted = dict.fromkeys(needed + [p for _, p in om.join])
        right = pdf.select(*[qcol(c).alias(f"__p_{c}") for c in wanted])
        on = reduce(lambda x, y: x & y, [qcol(c) == qcol(f"__p_{p}") for c, p in om.join])
        joined = df.join(right, on, "inner")
        unique = bool(parent.unique_key) and set(parent.unique_key) <= set(child_of)
        return self._node(parent.subject, joined, lambda c: f"__p_{c}"), joined, None, not unique

    # -- patterns ----------------------------------------------------------------------------
    def match(self, s, p, o, *, predicates=None, graph: str | None = None) -> Bindings:
        """Solutions of one triple pattern. ``p`` may be a variable or a path."""
        if isinstance(p, pa.Path):
            return pa.match_path(self, s, p, o, graph)
        names = [x[1:] for x in (s, p, o) if is_var(x)]
        if is_var(p):
            wanted = list(predicates) if predicates is not None else self.predicates()
            branches = []
            for pred in wanted:
                for b in self._match_fixed(s, IRI(pred), o, graph):
                    branches += self._bind_predicate(b, p[1:], IRI(pred))
        elif p == RDF.type and is_var(o):
            branches = [r for cls in self.classes() for b in self._match_class(s, cls, graph)
                        for r in self._bind_predicate(b, o[1:], IRI(cls))]
        else:
            branches = self._match_fixed(s, p, o, graph)
        declared = {n: (branches[0].vars[n] if branches else Var(STRING_T, True)) for n in dict.fromkeys(names)}
        return Bindings(self.spark, branches, declared, self.strict, [(s, p, o)])

    def _bind_predicate(self, b: Branch, name: str, value: IRI) -> list[Branch]:
        if name not in b.vars:
            return [replace(b.assign(name, Term(F.lit(str(value)), IRI_T, const=str(value)), nullable=False), refs=b.refs)]
        same = _same_resource(b.term(name), Term(F.lit(str(value)), IRI_T, const=str(value)))
        return [] if same is None else [b.where(same)]

    def _match_fixed(self, s, p: str, o, graph) -> list[Branch]:
        if p == RDF.type:
            if is_var(o):
                return [r for cls in self.classes() for b in self._match_class(s, cls, graph)
                        for r in self._bind_predicate(b, o[1:], IRI(cls))]
            return self._match_class(s, o, graph)
        found = []
        for prop, swapped in sorted(self.ontology.properties(p)):
            for m in self._maps_of(graph):
                for pred, om in m.properties:
                    if pred == prop:
                        found.append(self._pattern(m, om, *((o, s) if swapped else (s, o)), graph))
        return _as_set([b for b in found if b is not None])

    def _match_class(self, s, cls, graph) -> list[Branch]:
        found = []
        names = self.ontology.class_names(cls)
        maps = self._maps_of(graph)
        typed_maps = {m.id for m in maps if names & set(m.classes)}
        for m in maps:
            if m.id in typed_maps:
                found.append(self._pattern(m, None, s, None, graph))
        for name in sorted(names):
            sides = [(self.ontology.domains.get(name, ()), False), (self.ontology.ranges.get(name, ()), True)]
            for props, is_object in sides:
                for prop in sorted(props):
                    for used, swapped in sorted(self.ontology.properties(prop)):
                        for m in maps:
                            for pred, om in m.properties:
                                if pred != used:
                                    continue
                                object_side = is_object != swapped
                                holder = self._holder(m, om) if object_side else m.id
                                if holder in typed_maps:
                                    continue  # those nodes already carry the class
                                ends = (hidden(), s) if object_side else (s, hidden())
                                b = self._pattern(m, om, *ends, graph)
                                if b is not None:
                                    found.append(b.keep([s[1:]] if is_var(s) else []).distinct())
        return _as_set([b for b in found if b is not None])

    def _maps_of(self, graph) -> list[TriplesMap]:
        """The maps that may have triples in a graph (None: any)."""
        return [m for m in self.mapping.maps
                if graph is None or m.graph == graph or isinstance(m.graph, Template) and self._graph_conds(m, graph) is not None]

    def _graph_conds(self, m: TriplesMap, graph) -> list[Column] | None:
        """Conditions for a row's triples to be in a graph; None when none of them is."""
        if graph is None or not isinstance(m.graph, Template):
            return [] if graph is None or m.graph == graph else None
        return _equals_constant(self._node(m.graph, self.frame(m)), IRI(graph))

    def _graph_column(self, m: TriplesMap, df: DataFrame) -> Column:
        name = self._node(m.graph, df).value if isinstance(m.graph, Template) else F.lit(m.graph).cast("string")
        return name.alias("g")

    def _pattern(self, m: TriplesMap, om: ObjectMap | None, s, o, graph=None) -> Branch | None:
        """Subject and object of one property of one map (of the class assertion without ``om``)."""
        df = self.frame(m)
        subject = self._subject(m)
        ends = [(s, subject)]
        semis, several = (), False
        if om is not None:
            obj, df, semis, several = self._object(m, om)
            ends.append((o, obj))
        infos: dict[str, Var] = {}
        exprs: dict[str, Column] = {}
        conds: list[Column] = list(self._graph_conds(m, graph) or [])
        consts: dict[str, str] = {}
        for element, t in ends:
            conds += t.present()
            if is_var(element):
                name = element[1:]
                if name in infos:  # the same variable at both ends
                    same = _same_resource(subject, t)
                    if same is None:
                        return None
                    conds.append(same)
                    continue
                infos[name] = Var(t.type, False, t.template, t.families)
                exprs.update(zip(infos[name].columns(name), t.keys if t.template else [t.value]))
                if t.const is not None and t.type == IRI_T:
                    consts[name] = t.const
                continue
            fixed = _equals_constant(t, element)
            if fixed is None:
                return None
            conds += fixed
        unique = m.key_proved and not several
        refs = {}
        if is_var(s):
            refs[s[1:]] = m.id
        if is_var(o) and self._holder(m, om):
            refs.setdefault(o[1:], om.parent)
        row_vars = {s[1:]} if is_var(s) and unique else set()
        scan = Scan(m.id if semis is not None else hidden(), df, exprs or {"__row": F.lit(1)}, tuple(conds),
                    frozenset(row_vars), semis or ())
        b = Branch(self.spark, infos, scan=scan, consts=consts, refs=refs)
        if not unique:
            df = b.df.distinct() if infos else b.df.limit(1)
            b = Branch(self.spark, infos, df, consts=consts, refs=refs)
        return b

    def _holder(self, m: TriplesMap, om: ObjectMap | None) -> str | None:
        """The map among whose subjects all objects of a link are, when that is sure."""
        if not isinstance(om, RefObj):
            return None
        return om.parent if om.join or self.mapping.by_id(om.parent).source == m.source else None

    def predicates(self) -> list[str]:
        """Every predicate a triple of the graph may have."""
        mapped = {str(p) for m in self.mapping.maps for p, _ in m.properties}
        named = set(self.ontology.sub_props) | set(self.ontology.inverses)
        implied = {n for n in named if any(q in mapped for q, _ in self.ontology.properties(n))}
        return sorted(mapped | implied | {str(RDF.type)})

    def classes(self) -> list[str]:
        mapped = {str(c) for m in self.mapping.maps for c in m.classes}
        return sorted(mapped | set(self.ontology.sub_classes) | set(self.ontology.domains)
                      | {r for r in self.ontology.ranges if not r.startswith(XSD)})

    def bgp(self, patterns, *, graph: str | None = None) -> Bindings:
        """Natural join of triple patterns.

        Patterns over rows of the same table and subject become one scan; the others are joined
        along shared variables.
        """
        patterns = list(patterns)
        fixed = {}
        for x in (x for s, _, o in patterns for x in (s, o) if isinstance(x, IRI)):
            fixed[x] = fixed.get(x, 0) + 1
        shared_consts = {x: hidden() for x, n in fixed.items() if n > 1}
        items: list[Bindings] = []
        for s, p, o in patterns:
            if p == RDF.type:
                item = self.match(shared_consts.get(s, s), p, o, graph=graph)
            else:
                item = self.match(shared_consts.get(s, s), p, shared_consts.get(o, o), graph=graph)
            for iri, name in shared_consts.items():
                if name[1:] in item.names:
                    item = item.filter(lambda r, n=name, iri=iri: r[n] == iri)
            items.append(item)
        items = self._drop_implied_types(patterns, items)
        _prune(items)
        out = _join_all(items, bool(shared_consts))
        given = dict.fromkeys(n for it in items for n in it.names)  # in the order they are written
        names = [n for n in given if "?" + n not in shared_consts.values()]
        if names != list(out.names):
            hides = len(names) < len(out.names)
            out = out._with([b.keep(names) if hides else b for b in out.branches], {n: out.names[n] for n in names})
        out._patterns = patterns
        return out

    def _drop_implied_types(self, patterns, items: list[Bindings]) -> list[Bindings]:
        """A class pattern is skipped when another pattern only yields subjects of that class."""
        keep = list(items)
        for (s, p, o), item in zip(patterns, items):
            if p != RDF.type or not is_var(s) or is_var(o):
                continue
            holders = {b.refs.get(s[1:]) for b in item.branches} - {None}
            full = {m.id for m in self.mapping.maps if self.ontology.class_names(o) & set(m.classes)}
            for other in keep:
                if other is not item and other.branches and s[1:] in other.names and all(
                        b.refs.get(s[1:]) in holders & full for b in other.branches):
                    keep = [k for k in keep if k is not item]
                    break
        return keep

    def values(self, names, rows) -> Bindings:
        return inline(self.spark, names, rows, self.strict)

    # -- the graph as triples ------------------------------------------------------------------
    def triples(self, predicates=None, classes=None, *, include_tbox: bool = False, quads: bool = False,
                subjects=None) -> DataFrame:
        """All triples of the graph, as a set: the mapped ones and, with reasoning, those they entail, as
        patterns find them. Every table is read once for its own properties.

        ``classes``: only triples whose subjects are in these classes by their map. ``subjects``: only triples
        of these IRIs (a list, or a DataFrame with a column ``iri``).
        """
        entries = self._entries()
        if predicates is not None:
            entries = [e for e in entries if e.pred in {str(p) for p in predicates}]
        if classes is not None:
            names = set().union(*[self.ontology.class_names(c) for c in classes])
            entries = [e for e in entries if e.holder and names & set(self.mapping.by_id(e.holder).classes)]
        plain, repeated = [], []
        for m in self.mapping.maps:
            mine = [e for e in entries if e.map is m]
            alone = [e for e in mine if not e.many and not any(self._overlap(e, x) for x in entries if x is not e)]
            shared = [e for e in mine if e not in alone]
            if m.key_proved:
                plain += self._map_triples(m, alone, subjects, repeated, quads)
            elif isinstance(m.subject, IriColumn):
                shared = mine
            else:
                own = [e for e in alone if not e.swapped or subjects is None and e.cls is None]
                plain += self._distinct_triples(m, own, subjects, repeated, quads)
                shared = [e for e in mine if e not in own]
            repeated += self._map_triples(m, shared, subjects, repeated, quads)
        frames = plain
        if repeated:
            frames = plain + [reduce(DataFrame.union, repeated).distinct()]
        if include_tbox and self.tbox is not None:
            ddl = [f.split()[0] for f in TRIPLES_DDL.split(", ")]
            cols = [F.col(c) if c in self.tbox.columns else F.lit(None).cast("string").alias(c) for c in ddl]
            frames = frames + [self.tbox.select(*([F.lit(None).cast("string").alias("g")] if quads else []), *cols)]
        if not frames:
            return self.spark.createDataFrame([], ("g string, " if quads else "") + TRIPLES_DDL)
        return reduce(DataFrame.union, frames)

    def _entries(self) -> list["_Entry"]:
        """What each map gives: its classes and properties, and what the ontology makes of them."""
        out, typed = [], {}
        for cls in self.classes():
            names = self.ontology.class_names(cls)
            typed[cls] = {m.id for m in self.mapping.maps if names & set(m.classes)}
            out += [_Entry(m, str(RDF.type), None, cls, m.id) for m in self.mapping.maps if m.id in typed[cls]]
        given = defaultdict(list)
        for m in self.mapping.maps:
            for pred, om in m.properties:
                given[str(pred)].append((m, om))
        for pred in self.predicates():
            for used, swapped in sorted(self.ontology.properties(pred)) if pred != RDF.type else ():
                for m, om in given[used]:
                    out.append(_Entry(m, pred, om, None, self._holder(m, om) if swapped else m.id, swapped))
        for cls, have in typed.items():
            for name in sorted(self.ontology.class_names(cls)):
                for ends, is_object in ((self.ontology.domains, False), (self.ontology.ranges, True)):
                    for prop in sorted(ends.get(name, ())):
                        for used, swapped in sorted(self.ontology.properties(prop)):
                            for m, om in given[used]:
                                far = is_object != swapped
                                holder = self._holder(m, om) if far else m.id
                                if holder not in have:  # else those nodes already carry the class
                                    out.append(_Entry(m, str(RDF.type), om, cls, holder, far, True))
        return out

    def _node_of(self, e: "_Entry"):
        """The template or column of the entry's subject; None when it is never an IRI."""
        if not e.swapped:
            return e.map.subject
        om = e.om
        if isinstance(om, RefObj):
            return self.mapping.by_id(om.parent).subject
        if isinstance(om, TemplateObj):
            return om.template if om.dt is None and om.lang is None else None
        if isinstance(om, ConstObj):
            return IriColumn("") if om.is_iri else None
        return om if isinstance(om, IriColumn) else None

    def _overlap(self, a: "_Entry", b: "_Entry") -> bool:
        """Whether two entries may give the same triple."""
        if a.pred != b.pred or a.cls != b.cls:
            return False
        x, y = self._node_of(a), self._node_of(b)
        if x is None or y is None:
            return False
        return isinstance(x, IriColumn) or isinstance(y, IriColumn) or x.may_unify(y)

    def _map_triples(self, m: TriplesMap, entries, subjects, repeated: list, quads: bool) -> list[DataFrame]:
        """The triples of a map's entries; those a row may give twice go to ``repeated``."""
        if subjects is not None and any(e.swapped for e in entries):  # each object is looked for by itself
            near, far = [e for e in entries if not e.swapped], [e for e in entries if e.swapped]
            return self._map_triples(m, near, subjects, repeated, quads) + [
                t for e in far for t in self._map_triples_of(m, [e], subjects, repeated, quads)]
        return self._map_triples_of(m, entries, subjects, repeated, quads)

    def _map_triples_of(self, m: TriplesMap, entries, subjects, repeated: list, quads: bool) -> list[DataFrame]:
        if not entries:
            return []
        df = self.frame(m)
        subject = self._node(m.subject, df)
        graph = [self._graph_column(m, df)] if quads else []
        near = df if entries[0].swapped and subjects is not None else _only_subjects(df, subject, subjects)
        if near is None:
            return []
        structs, out, doubled = [], [], []
        once = Term(F.col("__subject"), IRI_T)  # the subject's text is made once per row, not once per triple
        for e in entries:
            obj, joined, semis, several = (
                self._map_object(m, e.om, near) if e.om is not None else (Term(F.lit(e.cls), IRI_T), near, (), False))
            if e.swapped and obj.type != IRI_T:
                continue
            same_row = joined is near and not semis and (subjects is None or not e.swapped)
            me = once if same_row and subject.type == IRI_T else subject
            start, end = (obj, me) if e.swapped else (me, obj)
            if e.om is not None and e.cls is not None:
                end = Term(F.lit(e.cls), IRI_T)
            predicate = Term(F.lit(e.pred), IRI_T)
            triple = F.when(me.bound & obj.bound, triple_struct(start, predicate, end))
            if same_row:
                structs.append(triple)
                continue
            rows = joined if semis is None else _scan_with(joined, semis)
            if e.swapped and subjects is not None:
                rows = _only_subjects(rows, obj, subjects)
            if rows is not None:
                (doubled if several else out).append(rows.select(*graph, triple.alias("t")))
        if structs:
            out.append(near.withColumn("__subject", subject.value).select(*graph, F.explode(F.array(*structs)).alias("t")))
        cols = ["g", "t.*"] if quads else ["t.*"]
        repeated += [rows.where("t IS NOT NULL").select(*cols) for rows in doubled]
        return [rows.where("t IS NOT NULL").select(*cols) for rows in out]

    def _distinct_triples(self, m: TriplesMap, entries, subjects, repeated: list, quads: bool) -> list[DataFrame]:
        """Triples of a map without a key: made distinct as (keys, object number, object), and
        only then written out, so that little is shuffled. An object stands for all properties that have it, and for
        their inverses, which are as distinct as they are."""
        df = self.frame(m)
        subject = self._node(m.subject, df)
        df = _only_subjects(df, subject, subjects)
        local: dict[object, tuple[Term, list]] = {}
        linked, far, plain = [], [], []
        for e in entries if df is not None else ():
            if e.om is None:
                obj, place = Term(F.lit(e.cls), IRI_T), e.cls
            else:
                obj, joined, semis, _ = self._map_object(m, e.om, df)
                place = id(e.om)
                both = [t.template and t.template.injective for t in (subject, obj)]
                if (joined is not df or semis) and all(both) and subjects is None and e.cls is None and not (quads and isinstance(m.graph, Template)):
                    far.append(self._distinct_links(m, e, joined if semis is None else _scan_with(joined, semis), subject, obj, quads))
                    continue
                if joined is not df or semis or obj.type.kind == "mixed" or quads and isinstance(m.graph, Template):
                    linked.append(e)
                    continue
                if e.swapped and obj.type != IRI_T:
                    continue
            local.setdefault(place, (obj, []))[1].append((str(e.pred), e.swapped))
            plain.append(e)
        repeated += self._map_triples(m, linked, subjects, repeated, quads)
        if not local or not subject.template:
            repeated += self._map_triples(m, plain, subjects, repeated, quads) if local else []
            return far
        names = [f"__s{i}" for i in range(len(subject.keys))]
        objects, uses = [o for o, _ in local.values()], [u for _, u in local.values()]
        cells = [F.struct(F.lit(i).alias("i"), obj.text.alias("o")) for i, obj in enumerate(objects)]
        rows = _present(df, subject).withColumns(dict(zip(names, subject.keys)))
        if len(cells) > 1:  # a row is moved once, to where its subject is, and not once per object
            again = _held_by_keys(df, subject, names)  # nor are the columns moved beside the keys made of them
            rows = rows.drop(*again).repartition(_triple_parts(df), *names).withColumns(again)
        rows = (rows.select(*names, F.explode(F.array(*cells)).alias("x"))
                .select(*names, "x.i", "x.o").where("o IS NOT NULL").distinct())

        def of(values) -> Column:
            return F.element_at(F.array(*values), F.col("i") + 1)

        def fixed(values) -> Column:
            return of([F.lit(v).cast("string") for v in values])

        text = subject.template.render([F.col(n) for n in names], subject.families)
        graph = [self._graph_column(m, df).alias("g")] if quads else []
        cols = {"o_kind": fixed([o.type.kind for o in objects]), "o_dt": fixed([str(o.type.dt) if o.type.dt else None for o in objects]),
                "o_lang": fixed([o.type.lang for o in objects])}
        used = of([F.array(*[F.struct(F.lit(p).alias("p"), F.lit(w).alias("swapped")) for p, w in some]) for some in uses])
        rows = rows.select(*graph, text.alias("s"), "o", *[c.alias(n) for n, c in cols.items()], F.explode(used).alias("u"))
        if not any(w for some in uses for _, w in some):
            return [*far, rows.select(*(["g"] if quads else []), "s", F.lit("iri").alias("s_kind"), "u.p", "o", *cols)]
        turned = F.col("u.swapped")  # an inverse has an IRI at either end
        return [*far, rows.select(*(["g"] if quads else []), F.when(turned, F.col("o")).otherwise(F.col("s")).alias("s"), F.lit("iri").alias("s_kind"),
                            "u.p", F.when(turned, F.col("s")).otherwise(F.col("o")).alias("o"), *cols)]

    def _distinct_links(self, m: TriplesMap, e: "_Entry", rows: DataFrame, subject: Term, obj: Term, quads: bool) -> DataFrame:
        """The triples of a link of a map without a key: pairs of keys are made distinct, and then their text is made."""
        ends = {"s": subject, "o": obj}
        names = {n: [f"__{n}{i}" for i in range(len(t.keys))] for n, t in ends.items()}
        rows = _present(_present(rows, subject), obj)
        rows = rows.select(*[k.alias(c) for n, t in ends.items() for c, k in zip(names[n], t.keys)]).distinct()
        start, end = [Term(None, t.type, template=t.template, keys=[F.col(c) for c in names[n]], families=t.families) for n, t in ends.items()]
        if e.swapped:
            start, end = end, start
        graph = [self._graph_column(m, rows).alias("g")] if quads else []
        return rows.select(*graph, triple_struct(start, Term(F.lit(e.pred), IRI_T), end).alias("t")).select(*(["g"] if quads else []), "t.*")

    def problems(self) -> list[str]:
        """What keeps the mapping from being read: missing tables, columns and parent maps."""
        out = []
        for m in self.mapping.maps:
            try:
                have = set(self.frame(m).columns)
            except Exception as e:  # any reason a source cannot be resolved
                out.append(f"{m.id}: source cannot be read ({type(e).__name__})")
                continue
            used = [m.subject.column] if isinstance(m.subject, IriColumn) else list(m.subject.columns)
            used += list(m.graph.columns) if isinstance(m.graph, Template) else []
            for _, om in m.properties:
                if isinstance(om, (ColumnObj, IriColumn)):
                    used += [om.column] + [c for c in (getattr(om, "lang_column", None),) if c]
                elif isinstance(om, TemplateObj):
                    used += om.template.columns
                elif isinstance(om, RefObj):
                    used += [c for c, _ in om.join]
                    if om.parent not in {p.id for p in self.mapping.maps}:
                        out.append(f"{m.id}: no parent map {om.parent}")
            out += [f"{m.id}: no column {c}" for c in dict.fromkeys(used) if c not in have]
        return out

    def describe(self, iris) -> DataFrame:
        """All outgoing triples of the given IRIs (a list, or a DataFrame with a column ``iri``)."""
        if isinstance(iris, DataFrame):
            iris = iris.select("iri").distinct()
        return self.triples(subjects=iris)


# -- helpers -----------------------------------------------------------------------------------

@dataclass(frozen=True, eq=False)
class _Entry:
    """Triples of one kind that a map's rows give. ``cls`` for class assertions, made of the rows alone or
    of a property's ends; ``swapped``: the property's object is the subject; ``many``: repeated per row."""
    map: TriplesMap
    pred: str
    om: ObjectMap | None
    cls: str | None
    holder: str | None  # the map whose subjects the subjects are, when that is sure
    swapped: bool = False
    many: bool = False


def _equals_constant(t: Term, element) -> list[Column] | None:
    """Conditions for a mapped term to be a constant, on source columns; None when it never is."""
    if isinstance(element, IRI):
        if t.type != IRI_T:
            return None
        if t.const is not None:
            return [] if t.const == element else None
        if t.template:
            keys = t.template.invert(element, t.families)
            return None if keys is None else [k == F.lit(v) for k, v in zip(t.keys, keys)]
        return [t.value == F.lit(str(element))]
    col, rdf_type = tm.python_literal(element)
    return [t.value == col] if rdf_type == t.type else None


def _parts(df: DataFrame) -> int:
    """More parts for a large table; Spark's sizes may be far too high, so sixteen times the usual number at most."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    ways = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(ways, min(size // PART_BYTES, 16 * ways))


def _held_by_keys(df: DataFrame, subject: Term, names: list[str]) -> dict[str, Column]:
    """Columns that a subject's keys hold unchanged, made of the keys again."""
    types = [df.schema[c].dataType for c in subject.template.columns]
    return {c: F.col(n).cast(t) for c, n, t in zip(subject.template.columns, names, types)
            if isinstance(t, (T.IntegralType, T.StringType))}


def _triple_parts(df: DataFrame) -> int:
    """Parts by the bytes of the tables that are read, so that the triples of each fit in a task's memory. Where Spark does not
    know them, sixteen times the usual number at most."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.length()))
    ways = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    unknown = size >= df.sparkSession._jsparkSession.sessionState().conf().defaultSizeInBytes()
    return max(ways, min(size // TRIPLE_BYTES, 16 * ways if unknown else MOST_PARTS))


def _present(df: DataFrame, t: Term) -> DataFrame:
    conds = t.present()
    return df.where(reduce(lambda x, y: x & y, conds)) if conds else df


def _as_set(branches: list[Branch]) -> list[Branch]:
    """Branches that may hold equal solutions are united and made distinct."""
    groups: list[list[Branch]] = []
    for b in branches:
        clash = [g for g in groups if any(_may_equal(b, x) for x in g)]
        groups = [g for g in groups if g not in clash] + [[b] + [x for g in clash for x in g]]
    out = []
    for g in groups:
        if len(g) == 1:
            out.append(g[0])
            continue
        one = br.unite(g)
        refs = {n: r for n, r in g[0].refs.items() if all(x.refs.get(n) == r for x in g)}
        df = one.df.distinct() if one.vars else one.df.limit(1)
        out.append(Branch(one.spark, one.vars, df, refs=refs))
    return out


def _may_equal(a: Branch, b: Branch) -> bool:
    return not any(a.vars[n].disjoint(b.vars[n]) for n in a.vars if n in b.vars) and br.may_join(a, b)


def _prune(items: list[Bindings]) -> None:
    """Drop branches that cannot meet any branch of a pattern they must join with."""
    changed = True
    while changed:
        changed = False
        for a in items:
            for b in items:
                if a is b or not set(a.names) & set(b.names):
                    continue
                kept = [x for x in a.branches if any(br.may_join(x, y) for y in b.branches)]
                if len(kept) < len(a.branches):
                    a.branches, changed = kept, True


def _join_all(items: list[Bindings], fixed_first: bool) -> Bindings:
    done = False
    while not done:  # first the joins that cost nothing: same rows of the same table
        done = True
        for i, a in enumerate(items):
            for b in items[i + 1:]:
                pairs = [(x, y) for x in a.branches for y in b.branches if br.may_join(x, y)]
                if set(a.names) & set(b.names) and pairs and all(br.merge_scans(x, y) for x, y in pairs):
                    items = [a.join(b) if it is a else it for it in items if it is not b]
                    done = False
                    break
            if not done:
                break
    if len(items) < 3:
        out = items[0]
        for it in items[1:]:
            out = out.join(it)
        return out
    return _join_by_cost(items)


def _cost(item: Bindings) -> float:
    """Bytes that Spark expects of the tables a pattern reads, a hundredth of them for each end that is fixed. The form of the
    patterns decides between equal ones, so that it does not matter in which order they are written."""
    size = sum(int(str(b.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for b in item.branches)
    fixed = sum(not is_var(x) for s, p, o in item._patterns for x in ((s,) if p == RDF.type else (s, o)))
    fixed += sum(bool(b.consts) for b in item.branches)
    return size / 100.0 ** fixed


def _keys(item: Bindings) -> set[frozenset]:
    """Sets of variables no two solutions of a pattern share, as far as they are known."""
    b = item.branches[0] if len(item.branches) == 1 else None
    return {frozenset({n}) for n in b.scan.subjects} if b is not None and b.scan else set()


def _join_by_cost(items: list[Bindings]) -> Bindings:
    """The cheapest pattern first, then always one that is linked to what is there: those that bring no new variable, as
    they only leave fewer rows, before others, then those joined on a key of either side, as each row of the other side
    meets one row at most, and the cheaper ones before the dearer."""
    ranked = sorted(items, key=lambda it: (_cost(it), sorted(" ".join(map(str, x)) for x in it._patterns)))
    keys = {id(it): _keys(it) for it in items}
    out, rest, mine = ranked[0], ranked[1:], keys[id(ranked[0])]
    while rest:
        linked = [it for it in rest if set(it.names) & set(out.names)]
        closing = [it for it in linked if set(it.names) <= set(out.names)]
        keyed = [it for it in linked if any(k <= set(out.names) & set(it.names) for k in mine | keys[id(it)])]
        nxt = (closing or keyed or linked or rest)[0]
        rest = [it for it in rest if it is not nxt]
        shared, theirs = set(out.names) & set(nxt.names), keys[id(nxt)]
        mine = ({k for k in mine if any(t <= shared for t in theirs)} | {k for k in theirs if any(m <= shared for m in mine)}
                or {m | t for m in mine for t in theirs})
        out = out.join(nxt)
    return out


def _scan_with(df: DataFrame, semis) -> DataFrame:
    names = df.columns
    keep = {f"__c{i}": qcol(c) for i, c in enumerate(names)}
    return Scan("", df, keep, (), frozenset(), semis).frame().toDF(*names)


def _only_subjects(df: DataFrame, subject: Term, subjects) -> DataFrame | None:
    if subjects is None:
        return df
    if isinstance(subjects, DataFrame) and subject.template:
        names = [f"__s{i}" for i in range(len(subject.keys))]
        keys = subject.template.parse(F.col("iri"), subject.families)
        wanted = subjects.select(*[k.alias(n) for k, n in zip(keys, names)]).where(F.col("__s0").isNotNull())
        return df.withColumns(dict(zip(names, subject.keys))).join(wanted, names, "left_semi").drop(*names)
    if isinstance(subjects, DataFrame):
        return (df.withColumn("__s", subject.value)
                .join(subjects.select(F.col("iri").alias("__s")), "__s", "left_semi").drop("__s"))
    if not subject.template:
        return df.where(subject.value.isin([str(x) for x in subjects]))
    keys = [k for k in (subject.template.invert(str(x), subject.families) for x in subjects) if k is not None]
    if not keys:
        return None
    if len(subject.keys) == 1:
        return df.where(subject.keys[0].isin([k[0] for k in keys]))
    either = [reduce(lambda x, y: x & y, [c == F.lit(v) for c, v in zip(subject.keys, k)]) for k in keys]
    return df.where(reduce(lambda x, y: x | y, either))


class TripleGraph:
    """Patterns over a triples DataFrame (optionally one named graph of it)."""

    def __init__(self, triples: DataFrame, graph: str | None = None, strict: bool = False):
        df = triples
        if graph is not None:
            df = df.where(F.col("g") == F.lit(str(graph)))
        self.spark, self.strict = df.sparkSession, strict
        self.df = df.select("s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang").distinct() \
            if "g" in triples.columns and graph is None else df

    def match(self, s, p, o) -> Bindings:
        if isinstance(p, pa.Path):
            return pa.match_path(self, s, p, o, None)
        empty = F.lit("")
        mixed = {
            0: F.struct(F.col("s_kind").alias("kind"), F.col("s").alias("value"), empty.alias("dt"), empty.alias("lang")),
            2: F.struct(F.col("o_kind").alias("kind"), F.col("o").alias("value"),
                        F.coalesce("o_dt", empty).alias("dt"), F.coalesce("o_lang", empty).alias("lang"))}
        df, exprs, infos = self.df, {}, {}
        for i, x in enumerate((s, p, o)):
            if is_var(x):
                name, col = x[1:], F.col("p") if i == 1 else mixed[i]
                info = Var(IRI_T if i == 1 else tm.MIXED_T)
                if name in exprs:
                    if info != infos[name]:
                        col = col if i != 1 else Term(col, IRI_T).as_mixed()
                        other = exprs[name] if infos[name].type.kind == "mixed" else Term(exprs[name], IRI_T).as_mixed()
                        df = df.where(col == other)
                    else:
                        df = df.where(col == exprs[name])
                else:
                    exprs[name], infos[name] = col, info
            elif isinstance(x, IRI):
                column, kind = (("s", "s_kind"), ("p", None), ("o", "o_kind"))[i]
                df = df.where(F.col(column) == F.lit(str(x)))
                df = df.where(F.col(kind) == "iri") if kind else df
            else:
                value, rdf_type = tm.python_literal(x)
                df = df.where((F.col("o_kind") == "literal") & (F.col("o") == tm.lexical(value, dt=rdf_type.dt)))
                df = df.where(F.coalesce("o_dt", empty) == F.lit(str(rdf_type.dt or "")))
                df = df.where(F.coalesce("o_lang", empty) == F.lit(rdf_type.lang or ""))
        cols = [c.alias(n) for n, c in exprs.items()] or [F.lit(1).alias("__row")]
        return Bindings(self.spark, [Branch(self.spark, infos, df.select(*cols))], infos, self.strict, [(s, p, o)])

    def bgp(self, patterns) -> Bindings:
        out = _join_all([self.match(*x) for x in patterns], False)
        out._patterns = list(patterns)
        return out


def graph(triples: DataFrame, name: str | None = None) -> TripleGraph:
    return TripleGraph(triples, name)
