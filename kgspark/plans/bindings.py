"""Solution sets and the SPARQL algebra over them, as lazy DataFrame plans."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark import terms as tm
from kgspark.functions.agg import Agg
from kgspark.plans import branch as br
from kgspark.plans import loose
from kgspark.plans.branch import Branch, Var
from kgspark.plans.expr import Row, Term, term
from kgspark.session import materialize
from kgspark.terms import BOOLEAN_T, IRI, IRI_T, INTEGER_T, MIXED_T, STRING_T, NotUniquelyTyped, RdfType

DEEP = 10_000  # rows up to the end of a slice that one task may hold


@dataclass(frozen=True)
class Desc:
    key: object


def desc(key) -> Desc:
    """Descending order for ``order_by``."""
    return Desc(key)


def _term_of(branch: Branch, expr) -> Term:
    """An expression is a variable name, a constant, or a function of the row."""
    if isinstance(expr, str) and not isinstance(expr, IRI):
        return branch.term(expr.lstrip("?"))
    return term(expr(branch.row()) if callable(expr) and not isinstance(expr, Term) else expr)


class Bindings:
    """``branches``: the parts of a bag of solutions; ``names``: its variables, in order."""

    def __init__(self, spark: SparkSession, branches: list[Branch], names: dict[str, Var] | None = None,
                 strict: bool = False, patterns: list | None = None):
        self.spark, self.branches, self.strict = spark, branches, strict
        self.names = dict(names or {})
        for b in branches:
            for n, info in b.vars.items():
                self.names.setdefault(n, info)
        self._patterns = patterns or []

    def _with(self, branches, names=None, patterns=None) -> "Bindings":
        keep = self.names if names is None else names
        return Bindings(self.spark, branches, keep, self.strict, self._patterns if patterns is None else patterns)

    # -- forms -----------------------------------------------------------------------------
    def merged(self) -> Branch:
        """All branches as one; every named variable has its columns."""
        if self.branches:
            out = br.unite(self.branches)
        else:
            out = self._empty()
        for n, info in self.names.items():
            if n not in out.vars:
                info = Var(info.type if not info.template else IRI_T, True)
                blank = Term(F.lit(None).cast(_spark_type(info.type)), info.type)
                out = out.assign(n, blank)
        return out

    def _empty(self) -> Branch:
        infos = {n: Var(i.type, True) for n, i in self.names.items()}
        schema = ", ".join(f"`{n}` {_spark_type(i.type)}" for n, i in infos.items()) or "__row int"
        return Branch(self.spark, infos, self.spark.createDataFrame([], schema))

    @property
    def types(self) -> dict[str, RdfType]:
        """RDF type of every variable; ``mixed`` when it has several."""
        out = {}
        for n, info in self.names.items():
            present = [b.vars[n] for b in self.branches if n in b.vars]
            out[n] = br.common_var(present).type if present else info.type
        return out

    def check_types(self, names=None) -> None:
        for n in names or self.names:
            kinds = {b.vars[n].type for b in self.branches if n in b.vars}
            if len(kinds) > 1 or MIXED_T in kinds:
                raise NotUniquelyTyped(n, kinds)

    @property
    def df(self) -> DataFrame:
        """SELECT: one natively typed column per variable, NULL when unbound."""
        if self.strict:
            self.check_types()
        b = self.merged()
        return _project(b, {n: b.term(n).value for n in self.names})

    def ask(self) -> DataFrame:
        """ASK: one row, true when there is a solution."""
        found = [b.df.select(F.lit(1).alias("x")).limit(1) for b in self.branches] or [self._empty().df.select(F.lit(1).alias("x"))]
        one = found[0]
        for more in found[1:]:
            one = one.union(more)
        return one.limit(1).agg((F.count("x") > 0).alias("ask"))

    # -- solution modifiers ----------------------------------------------------------------
    def filter(self, cond) -> "Bindings":
        """Keep solutions whose condition is true; a branch it rules out is not read at all."""
        out = []
        for b in self.branches:
            t = _term_of(b, cond)
            if b.frame is None and b.pairing and t.orders:
                met = br.paired(*b.pairing, t)
                if met is not None:
                    out.append(met)
                    continue
            if t.const is True:
                out.append(b)
            elif t.const is not False:
                if not t.stable and b.scan:
                    b = Branch(b.spark, b.vars, b.df, consts=b.consts)
                    t = _term_of(b, cond)
                b = b.where(t.truth())
                if t.proves:  # what the condition needs bound can be joined on as it is
                    b.vars = {n: replace(i, nullable=False) if n in t.proves else i for n, i in b.vars.items()}
                out.append(b)
        return self._with(out)

    def bind(self, name: str, expr) -> "Bindings":
        name = name.lstrip("?")
        if name in self.names:
            raise ValueError(f"?{name} is already in use")
        return self._with([_bind(b, name, expr) for b in self.branches], dict(self.names))

    def select(self, *names: str, **exprs) -> "Bindings":
        """Projection; without arguments every variable."""
        out = self
        for n, e in exprs.items():
            out = out.bind(n, e)
        wanted = [n.lstrip("?") for n in names] + list(exprs) or list(self.names)
        infos = {n: out.names.get(n, Var(STRING_T, True)) for n in wanted}
        out = out._with([b.keep(wanted) for b in out.branches], infos)
        if self.strict:
            out.check_types(wanted)
        return out

    def rename(self, **renames: str) -> "Bindings":
        """``rename(old="new")``."""
        return self._with([b.rename(renames) for b in self.branches],
                          {renames.get(n, n): i for n, i in self.names.items()})

    def distinct(self) -> "Bindings":
        return self._with([self.merged().distinct()])

    def reduced(self) -> "Bindings":
        return self.distinct()

    def order_by(self, *keys) -> "Bindings":
        """Ascending unless wrapped in ``desc``; an unbound value is lowest."""
        b = self.merged()
        if b.scan:
            b = Branch(b.spark, b.vars, b.df, consts=b.consts)
        orders = []
        for key in keys:
            down = isinstance(key, Desc)
            parts = _term_of(b, key.key if down else key).order_keys()
            orders += [p.desc_nulls_last() if down else p.asc_nulls_first() for p in parts]
        return self._with([replace(b, frame=b.df.orderBy(*orders), inline=None)])

    def slice(self, limit: int | None = None, offset: int = 0) -> "Bindings":
        """LIMIT and OFFSET. A deep offset is cut out by row numbers per partition, so that no task holds what
        is skipped, and only the files are read that the slice lies in."""
        b = self.merged()
        if limit is not None and (offset <= 0 or offset + limit <= DEEP):
            df = (b.df.offset(offset) if offset > 0 else b.df).limit(limit)
        else:
            df = _slice(b.df, offset, limit) if offset > 0 else b.df
        return self._with([Branch(b.spark, b.vars, df)])

    # -- grouping --------------------------------------------------------------------------
    def group_by(self, *names: str, **exprs) -> "Grouped":
        out = self
        for n, e in exprs.items():
            out = out.bind(n, e)
        return Grouped(out, [n.lstrip("?") for n in names] + list(exprs))

    def agg(self, **aggs: Agg) -> "Bindings":
        """One group, also over no solutions."""
        return Grouped(self, []).agg(**aggs)

    def having(self, cond) -> "Bindings":
        return self.filter(cond)

    # -- joins -----------------------------------------------------------------------------
    def join(self, other: "Bindings") -> "Bindings":
        names = {**self.names, **other.names}
        out = []
        for lefts, rights in _components(self.branches, other.branches):
            pairs = [(a, b) for a in lefts for b in rights if br.may_join(a, b)]
            if not pairs:
                continue
            one_to_one = len(lefts) == len(rights) == 1
            if one_to_one or all(br.merge_scans(a, b) or a.inline or b.inline for a, b in pairs):
                out += [r for a, b in pairs for r in br.join(a, b)]
            else:
                out += br.join(br.unite(lefts), br.unite(rights))
        return self._with(out, names, self._patterns + other._patterns)

    def join_counted(self, other: "Bindings", count: str, keep=(), below: tuple[str, str] | None = None) -> "Bindings":
        """Natural join that is only counted: solutions of ``other`` that show the same in the variables ``keep`` are one,
        and ``count`` is their number. Shared variables that are not kept go.

        ``below=(theirs, mine)`` admits pairs whose whole number ``theirs`` of ``other`` is less than ``mine``. Either
        way a solution meets groups, not solutions, so that variables that may be unbound make no product.
        """
        if below and not all(Term(None, side.types[n]).is_integer for side, n in ((other, below[0]), (self, below[1]))):
            raise ValueError("below compares whole numbers")
        out = []
        for a in self.branches:
            rights = [b for b in other.branches if br.may_join(a, b)]
            out += loose.counted(a, br.unite(rights), count, set(keep), below) if rights else []
        shared = set(self.names) & set(other.names)
        names = {n: i for n, i in {**other.names, **self.names}.items() if n in keep or n in self.names and n not in shared}
        return self._with(out, {**names, count: Var(INTEGER_T)}, self._patterns + other._patterns)

    def union(self, other: "Bindings") -> "Bindings":
        return self._with(self.branches + other.branches, {**self.names, **other.names},
                          self._patterns + other._patterns)

    def optional(self, other: "Bindings", where=None) -> "Bindings":
        """Left join; ``where`` is the OPTIONAL's own filter and may use outer variables."""
        out = []
        for a in self.branches:
            rights = [b for b in other.branches if br.may_join(a, b)]
            out += br.left_join(a, br.unite(rights), where) if rights else [a]
        return self._with(out, {**self.names, **{n: replace(i, nullable=True) for n, i in other.names.items()
                                                 if n not in self.names}}, self._patterns + other._patterns)

    def minus(self, other: "Bindings") -> "Bindings":
        """Drop solutions that agree with one of ``other`` on the bound variables they share."""
        return self._reject(other, None, needs_shared=True)

    def not_exists(self, other: "Bindings", where=None) -> "Bindings":
        return self._reject(other, where, needs_shared=False)

    def _reject(self, other: "Bindings", where, needs_shared: bool) -> "Bindings":
        out = []
        for a in self.branches:
            rights = _probe(a, other, where)
            if not rights:
                out.append(a)
                continue
            for b in rights:
                if needs_shared and loose.is_loose(a, b):  # what they share must be bound in both
                    a = loose.semi(a, b, "left_anti", where, needs_shared=True)
                elif br.shared_vars(a, b) or not needs_shared:
                    a = br.semi(a, b, "left_anti", where)
            out.append(a)
        return self._with(out, None, self._patterns + other._patterns)

    def exists(self, other: "Bindings", where=None) -> "Bindings":
        out = []
        for a in self.branches:
            rights = _probe(a, other, where)
            for i, b in enumerate(rights):
                out.append(br.semi(a, b, "left_semi", where))
                if i + 1 < len(rights):
                    a = br.semi(a, b, "left_anti", where)
        return self._with(out, None, self._patterns + other._patterns)

    def values(self, names, rows) -> "Bindings":
        """Join with inline data; None in a row leaves that variable open."""
        return self.join(inline(self.spark, names, rows, self.strict))

    # -- graph form ------------------------------------------------------------------------
    def construct(self, template) -> DataFrame:
        """CONSTRUCT: the template's triples for every solution, as a set.

        Template terms: ``"?v"``, ``"_:label"`` (a fresh blank node per solution), or constants.
        Unbound or ill-formed triples are left out.
        """
        frames = []
        for b in self.branches:
            triples = []
            for s, p, o in template:
                ts, tp, to = (_template_term(b, x) for x in (s, p, o))
                if tp.type.kind not in ("iri", "mixed") or ts.type.kind == "literal":
                    continue
                ok = ts.bound & tp.bound & to.bound
                if ts.type.kind == "mixed":
                    ok = ok & (ts.kind_column() != "literal")
                if tp.type.kind == "mixed":
                    ok = ok & (tp.kind_column() == "iri")
                triples.append(F.when(ok, triple_struct(ts, tp, to)))
            if triples:
                base = b.scan.source if b.scan else None
                df = b.df if base is None else _scan_rows(b)
                frames.append(df.select(F.explode(F.array(*triples)).alias("t")).where("t IS NOT NULL").select("t.*"))
        if not frames:
            return self.spark.createDataFrame([], TRIPLES_DDL)
        out = frames[0]
        for f in frames[1:]:
            out = out.union(f)
        return out.distinct()

    # -- serialisation ---------------------------------------------------------------------
    def to_sparql_json(self) -> DataFrame:
        """One SPARQL Results JSON binding object per solution."""
        from kgspark.sources.sparql_json import binding_json
        return binding_json(self)

    def write_sparql_json(self, path: str) -> None:
        from kgspark.sources.sparql_json import write_results
        write_results(self, path)

    def patterns(self, unit_id: str) -> DataFrame:
        """The triple patterns of this query, incl. optional and negated ones, as rows."""
        from kgspark.operators.check import pattern_rows
        return pattern_rows(self.spark, unit_id, self._patterns)


class Grouped:
    def __init__(self, bindings: Bindings, keys: list[str]):
        self.bindings, self.keys = bindings, keys

    def agg(self, **aggs: Agg) -> Bindings:
        b = self.bindings.merged()
        keys = [c for n in self.keys for c in b.vars[n].columns(n)]
        inputs: dict[str, Column] = {c: b.col(c) for c in keys}
        results, infos = [], {n: b.vars[n] for n in self.keys}
        for i, (name, a) in enumerate(aggs.items()):
            if a.kind == "count_solutions":
                cols = {c: b.col(c) for c in b.physical()}
                inputs[f"__a{i}"] = F.struct(*[e.alias(c) for c, e in cols.items()])
                results.append(F.count_distinct(F.col(f"__a{i}")).alias(name))
                infos[name] = Var(INTEGER_T)
                continue
            t = None if a.arg is None else _term_of(b, a.arg)
            cols = a.inputs(t)
            named = [f"__a{i}_{j}" for j in range(len(cols))]
            inputs.update(zip(named, cols))
            col, rdf_type = a.result(t, named)
            results.append(col.alias(name))
            infos[name] = Var(rdf_type, a.kind not in ("count", "sum", "avg"))
        df = _project(b, inputs) if inputs else b.df
        df = df.groupBy(*keys).agg(*results) if keys else df.agg(*results)
        out = Branch(b.spark, infos, df)
        return Bindings(b.spark, [out], infos, self.bindings.strict, self.bindings._patterns)


TRIPLES_DDL = "s string, s_kind string, p string, o string, o_kind string, o_dt string, o_lang string"


def triple_struct(s: Term, p: Term, o: Term) -> Column:
    nothing = F.lit(None).cast("string")
    if o.type.kind == "mixed":
        o_dt, o_lang = F.nullif(o.value["dt"], F.lit("")), F.nullif(o.value["lang"], F.lit(""))
    else:
        o_dt = F.lit(str(o.type.dt)) if o.type.dt else nothing
        o_lang = F.lit(o.type.lang) if o.type.lang else nothing
    return F.struct(s.text.alias("s"), s.kind_column().alias("s_kind"), p.text.alias("p"), o.text.alias("o"),
                    o.kind_column().alias("o_kind"), o_dt.alias("o_dt"), o_lang.alias("o_lang"))


def _spark_type(t: RdfType) -> str:
    if t.kind == "mixed":
        return tm.MIXED.simpleString()
    return tm.spark_type_of(t.dt) if t.kind == "literal" else "string"


def _slice(df: DataFrame, offset: int, limit: int | None) -> DataFrame:
    """The rows from ``offset`` on, in order, ``limit`` of them at most. Rows are written as they are sorted, numbered
    within their partitions; only one count per partition is collected."""
    rows = materialize(df.withColumn("__id", F.monotonically_increasing_id()))
    counts = rows.groupBy(F.shiftright("__id", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()

    def at(place: int) -> int | None:
        """The number of the row at a place, or None if there are fewer rows."""
        for part, n in counts:
            if place < n:
                return (part << 33) + place
            place -= n
        return None

    first, stop = at(offset), None if limit is None else at(offset + limit)
    if first is None:
        return df.limit(0)
    kept = rows.where(F.col("__id") >= first)
    if stop is not None:
        kept = kept.where(F.col("__id") < stop)
    return kept.orderBy("__id").drop("__id")


def _project(b: Branch, exprs: dict[str, Column]) -> DataFrame:
    """Evaluate expressions of a branch, over its scan's own columns when it is one."""
    if b.scan:
        return replace(b.scan, exprs=exprs).frame() if exprs else b.df
    return b.df.select(*[e.alias(n) for n, e in exprs.items()]) if exprs else b.df


def _scan_rows(b: Branch) -> DataFrame:
    df = b.scan.source
    if b.scan.semis:
        keep = {f"__c{i}": F.col(f"`{c}`") for i, c in enumerate(df.columns)}
        df = replace(b.scan, exprs=keep, conds=()).frame().toDF(*df.columns)
    return br._filtered(df, b.scan.conds)


def _bind(b: Branch, name: str, expr) -> Branch:
    t = _term_of(b, expr)
    nullable = t.const is None
    if isinstance(expr, str) and expr.lstrip("?") in b.vars:
        nullable = b.vars[expr.lstrip("?")].nullable
    if t.const is None and expr is not None and name in b.vars:
        raise ValueError(f"?{name} is already in use")
    return b.assign(name, t, nullable)


def _template_term(b: Branch, x) -> Term:
    if isinstance(x, str) and not isinstance(x, IRI):
        if x.startswith("?"):
            return b.term(x[1:])
        if x.startswith("_:"):
            parts = [F.coalesce(b.term(n).text, F.lit("")) for n in b.vars]
            kinds = [F.coalesce(b.term(n).kind_column(), F.lit("")) for n in b.vars]
            key = F.md5(F.to_json(F.array(F.lit(x), *parts, *kinds)))
            return Term(F.concat(F.lit("b"), key), tm.BNODE_T)
    return term(x)


def _components(lefts: list[Branch], rights: list[Branch]):
    """Groups of branches that may join with one another; every branch is in at most one."""
    todo = list(range(len(lefts)))
    done: set[int] = set()
    for i in todo:
        if i in done:
            continue
        ls, rs, grew = {i}, set(), True
        while grew:
            new_r = {j for j in range(len(rights)) for k in ls if br.may_join(lefts[k], rights[j])} - rs
            rs |= new_r
            new_l = {k for k in todo for j in rs if br.may_join(lefts[k], rights[j])} - ls
            ls |= new_l
            grew = bool(new_r or new_l)
        done |= ls
        if rs:
            yield [lefts[k] for k in sorted(ls)], [rights[j] for j in sorted(rs)]


def _probe(a: Branch, other: Bindings, where) -> list[Branch]:
    """The branches of an inner pattern that can meet ``a``, united on what the test needs."""
    rights = [b for b in other.branches if br.may_join(a, b)]
    if where is None:
        rights = [b.keep([n for n in b.vars if n in a.vars]) for b in rights]
    same = {}
    for b in rights:
        same.setdefault(tuple((n, b.vars[n].signature) for n in b.vars if n in a.vars), []).append(b)
    return [br.unite(group) for group in same.values()]


def inline(spark: SparkSession, names, rows, strict: bool = False) -> Bindings:
    """VALUES: rows of constants; rows are kept apart by their terms' types."""
    names = [names] if isinstance(names, str) else list(names)
    names = [n.lstrip("?") for n in names]
    groups: dict[tuple, list] = {}
    for row in rows:
        row = row if isinstance(row, (tuple, list)) else (row,)
        if len(row) != len(names):
            raise ValueError("a VALUES row must have one cell per variable")
        types, cells = [], []
        for cell in row:
            types.append(None if cell is None else tm.python_literal(cell)[1])
            cells.append(cell.value if isinstance(cell, tm.Lit) else (str(cell) if isinstance(cell, IRI) else cell))
        groups.setdefault(tuple(types), []).append(tuple(cells))
    branches = []
    for types, cells in groups.items():
        bound = [i for i, t in enumerate(types) if t is not None]
        infos = {names[i]: Var(types[i]) for i in bound}
        if bound:
            branches.append(br.inline_branch(spark, [names[i] for i in bound],
                                             [tuple(c[i] for i in bound) for c in cells], infos))
        else:
            branches.append(Branch(spark, {}, spark.createDataFrame([(1,)] * len(cells), "__row int")))
    declared = {n: Var(STRING_T, True) for n in names}
    for b in branches:
        declared.update(b.vars)
    return Bindings(spark, branches, declared, strict)


__all__ = ["Bindings", "Grouped", "desc", "inline", "Row", "BOOLEAN_T"]
