"""One homogeneous part of a solution set.

A :class:`Branch` is a DataFrame whose variables each have one representation. As long as it is a
projection of one mapped table it stays a :class:`Scan`, so that more properties of the same
subject are read from the same rows instead of being joined.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark import terms as tm
from kgspark.plans.expr import Row, Term, unbound
from kgspark.terms import IRI_T, MIXED_T, RdfType, Template


def qcol(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass(frozen=True)
class Var:
    """Static facts about a variable; a template IRI is held as its key columns."""

    type: RdfType
    nullable: bool = False
    template: Template | None = None
    families: tuple[str, ...] = ()

    def columns(self, name: str) -> list[str]:
        return [f"__k{i}_{name}" for i in range(len(self.families))] if self.template else [name]

    @property
    def signature(self):
        return (self.type, self.template.parts if self.template else None, self.families)

    def disjoint(self, other: "Var") -> bool:
        """No term can be a value of both."""
        a, b = self.type, other.type
        if "mixed" in (a.kind, b.kind):
            return False
        if a != b:
            return True
        return bool(self.template and other.template and not self.template.may_unify(other.template))


@dataclass(frozen=True)
class Scan:
    """Rows of one mapped table: conditions and expressions over its columns."""

    map_id: str
    source: DataFrame
    exprs: dict[str, Column]
    conds: tuple[Column, ...] = ()
    subjects: frozenset[str] = frozenset()  # variables that identify a row
    semis: tuple = ()  # (key, parent frame, pairs): rows kept only with a parent row

    def frame(self) -> DataFrame:
        df = self.source
        for _, parent, pairs in self.semis:
            right = parent.select(*[qcol(p).alias(f"__p{i}") for i, (_, p) in enumerate(pairs)])
            on = reduce(lambda x, y: x & y, [qcol(c) == F.col(f"__p{i}") for i, (c, _) in enumerate(pairs)])
            df = df.join(right, on, "left_semi")
        return _filtered(df, self.conds).select(*[e.alias(n) for n, e in self.exprs.items()])


def _filtered(df: DataFrame, conds) -> DataFrame:
    conds = list({id(c): c for c in conds}.values())
    return df.where(reduce(lambda x, y: x & y, conds)) if conds else df


@dataclass
class Branch:
    spark: SparkSession
    vars: dict[str, Var]
    frame: DataFrame | None = None
    scan: Scan | None = None
    consts: dict[str, str] = field(default_factory=dict)  # variables fixed to one IRI
    inline: tuple | None = None  # (names, rows) of inline data
    refs: dict[str, str] = field(default_factory=dict)  # variable -> map whose subjects hold all its values
    pairing: tuple | None = None  # two unconnected branches, whose product this is as long as it has no frame

    @property
    def df(self) -> DataFrame:
        if self.frame is None:
            self.frame = self.scan.frame() if self.scan else _every_pair(*self.pairing)
        return self.frame

    def col(self, physical: str) -> Column:
        return self.scan.exprs[physical] if self.scan else F.col(physical)

    def term(self, name: str) -> Term:
        info = self.vars.get(name)
        if info is None:
            return unbound()
        cols = [self.col(c) for c in info.columns(name)]
        if info.template:
            return Term(None, info.type, template=info.template, keys=cols, families=info.families, names={name})
        return Term(cols[0], info.type, const=self.consts.get(name), names={name})

    def row(self) -> Row:
        return Row(self.term)

    def physical(self, names=None) -> list[str]:
        return [c for n in (self.vars if names is None else names) for c in self.vars[n].columns(n)]

    # -- single-branch transforms ------------------------------------------------------------
    def where(self, cond: Column) -> "Branch":
        if self.scan:
            return replace(self, frame=None, inline=None, scan=replace(self.scan, conds=self.scan.conds + (cond,)))
        return replace(self, frame=self.df.where(cond), inline=None)

    def keep(self, names) -> "Branch":
        names = [n for n in names if n in self.vars]
        out_vars = {n: self.vars[n] for n in names}
        consts = {n: c for n, c in self.consts.items() if n in out_vars}
        if self.scan:
            exprs = {c: self.scan.exprs[c] for n in names for c in self.vars[n].columns(n)}
            scan = replace(self.scan, exprs=exprs, subjects=self.scan.subjects & set(names))
            if exprs:
                return Branch(self.spark, out_vars, scan=scan, consts=consts)
            return Branch(self.spark, {}, replace(scan, exprs={"__row": F.lit(1)}).frame(), consts=consts)
        cols = [c for n in names for c in self.vars[n].columns(n)]
        if not cols:
            return Branch(self.spark, {}, self.df.select(F.lit(1).alias("__row")), consts=consts)
        return Branch(self.spark, out_vars, self.df.select(*cols), consts=consts)

    def rename(self, renames: dict[str, str]) -> "Branch":
        out_vars, exprs = {}, {}
        for n, info in self.vars.items():
            new = renames.get(n, n)
            out_vars[new] = info
            for old_c, new_c in zip(info.columns(n), info.columns(new)):
                exprs[new_c] = self.col(old_c)
        consts = {renames.get(n, n): c for n, c in self.consts.items()}
        if self.scan:
            subjects = frozenset(renames.get(n, n) for n in self.scan.subjects)
            return Branch(self.spark, out_vars, scan=replace(self.scan, exprs=exprs, subjects=subjects), consts=consts)
        return Branch(self.spark, out_vars, self.df.select(*[e.alias(n) for n, e in exprs.items()]), consts=consts)

    def assign(self, name: str, value: Term, nullable: bool = True) -> "Branch":
        """Bind a variable to an expression."""
        if value.template and value.template.injective:
            info = Var(value.type, nullable, value.template, value.families)
            cols = dict(zip(info.columns(name), value.keys))
        else:
            info, cols = Var(value.type, nullable), {name: value.value}
        out_vars = {**self.vars, name: info}
        consts = dict(self.consts)
        if value.type == IRI_T and isinstance(value.const, str):
            consts[name] = value.const
        if self.scan and value.stable:
            return Branch(self.spark, out_vars, scan=replace(self.scan, exprs={**self.scan.exprs, **cols}), consts=consts)
        if self.scan:  # a fresh value per row must be evaluated once
            exprs = {**self.scan.exprs, **cols}
            return Branch(self.spark, out_vars, replace(self.scan, exprs=exprs).frame(), consts=consts)
        return Branch(self.spark, out_vars, self.df.withColumns(cols), consts=consts)

    def recast(self, name: str, how: str) -> "Branch":
        """Change a variable's representation to ``text`` (built IRI) or ``mixed``."""
        info, t = self.vars[name], self.term(name)
        if how == "text":
            if not info.template:
                return self
            new, col = Var(info.type, info.nullable), t.value
        else:
            if info.type.kind == "mixed":
                return self
            new, col = Var(MIXED_T, info.nullable), t.as_mixed()
        out_vars = {**self.vars, name: new}
        if self.scan:
            exprs = {c: e for c, e in self.scan.exprs.items() if c not in info.columns(name)}
            exprs[name] = col
            return Branch(self.spark, out_vars, scan=replace(self.scan, exprs=exprs), consts=self.consts)
        rest = [c for n in self.vars if n != name for c in self.vars[n].columns(n)]
        return Branch(self.spark, out_vars, self.df.select(*rest, col.alias(name)), consts=self.consts)

    def parse(self, name: str, info: Var) -> "Branch":
        """IRI text as keys of a template; rows whose IRI it cannot build are dropped."""
        keys = info.template.parse(self.term(name).value, info.families)
        new = replace(info, nullable=False)
        rest = {c: self.col(c) for n in self.vars if n != name for c in self.vars[n].columns(n)}
        cols = {**rest, **dict(zip(new.columns(name), keys))}
        out_vars = {**self.vars, name: new}
        found = keys[0].isNotNull()
        if self.scan:
            scan = replace(self.scan, exprs=cols, conds=self.scan.conds + (found,))
            return Branch(self.spark, out_vars, scan=scan, consts=self.consts)
        df = self.df.select(*[e.alias(n) for n, e in cols.items()]).where(F.col(new.columns(name)[0]).isNotNull())
        return Branch(self.spark, out_vars, df, consts=self.consts)

    def distinct(self) -> "Branch":
        if self.scan and self.scan.subjects & set(self.vars):
            return self  # rows are already told apart by a declared key
        return Branch(self.spark, self.vars, self.df.select(*self.physical()).distinct(), consts=self.consts)


# -- union ------------------------------------------------------------------------------------

def common_var(infos: list[Var | None]) -> Var:
    present = [i for i in infos if i is not None]
    nullable = len(present) < len(infos) or any(i.nullable for i in present)
    if len({i.signature for i in present}) == 1:
        return replace(present[0], nullable=nullable)
    if len({i.type for i in present}) == 1:
        return Var(present[0].type, nullable)
    return Var(MIXED_T, nullable)


def unite(branches: list[Branch]) -> Branch:
    """All branches as one (UNION ALL); a missing variable is unbound."""
    if len(branches) == 1:
        return branches[0]
    names = list(dict.fromkeys(n for b in branches for n in b.vars))
    target = {n: common_var([b.vars.get(n) for b in branches]) for n in names}
    frames = []
    for b in branches:
        for n in list(b.vars):
            if target[n].type.kind == "mixed":
                b = b.recast(n, "mixed")
            elif not target[n].template:
                b = b.recast(n, "text")
        cols = []
        for n in names:
            for c in target[n].columns(n):
                cols.append((F.col(c) if n in b.vars else F.lit(None)).alias(c))
        frames.append(b.df.select(*(cols or [F.lit(1).alias("__row")])))
    return Branch(branches[0].spark, target, reduce(DataFrame.union, frames))


# -- joins ------------------------------------------------------------------------------------

def shared_vars(a: Branch, b: Branch) -> list[str]:
    return [n for n in a.vars if n in b.vars]


def may_join(a: Branch, b: Branch) -> bool:
    for n in shared_vars(a, b):
        x, y = a.vars[n], b.vars[n]
        if x.disjoint(y) and not x.nullable and not y.nullable:
            return False
        if n in a.consts and n in b.consts and a.consts[n] != b.consts[n]:
            return False
    return True


def merge_scans(a: Branch, b: Branch) -> Branch | None:
    """Two scans of the same table that share a row-identifying variable are one scan."""
    x, y = a.scan, b.scan
    if not x or not y or x.map_id != y.map_id:
        return None
    shared = shared_vars(a, b)
    if not (x.subjects & y.subjects & set(shared)):
        return None
    conds = list(x.conds + y.conds)
    for n in shared:
        if a.vars[n].nullable or b.vars[n].nullable or a.vars[n].signature != b.vars[n].signature:
            return None
        if n not in x.subjects & y.subjects:
            conds += [x.exprs[c] == y.exprs[c] for c in a.vars[n].columns(n)]
    semis = x.semis + tuple(s for s in y.semis if s[0] not in {k[0] for k in x.semis})
    scan = replace(x, exprs={**y.exprs, **x.exprs}, conds=tuple(conds), semis=semis,
                   subjects=x.subjects | y.subjects)
    return Branch(a.spark, {**a.vars, **{n: i for n, i in b.vars.items() if n not in a.vars}}, scan=scan,
                  consts={**a.consts, **b.consts})


def align(a: Branch, b: Branch, drop_left: bool = False) -> tuple[Branch, Branch] | None:
    """Same representation of every shared variable, or None when no value can agree.

    IRI text on the right (on the left only with ``drop_left``) is parsed into the other side's
    keys, so that the mapped table is joined on its own columns.
    """
    for n in shared_vars(a, b):
        x, y = a.vars[n], b.vars[n]
        if x.signature == y.signature:
            continue
        if "mixed" in (x.type.kind, y.type.kind):
            a, b = a.recast(n, "mixed"), b.recast(n, "mixed")
        elif x.disjoint(y):
            return None
        else:
            a, b = _inline_as(a, n, y) or a, _inline_as(b, n, x) or b
            if x.template and not b.vars[n].template and x.type == IRI_T:
                b = b.parse(n, x)
            elif drop_left and y.template and not a.vars[n].template and y.type == IRI_T:
                a = a.parse(n, y)
            if a.vars[n].signature != b.vars[n].signature:
                a, b = a.recast(n, "text"), b.recast(n, "text")
    return a, b


def _inline_as(b: Branch, name: str, info: Var) -> Branch | None:
    """Inline IRIs as key values of the other side's template."""
    if not b.inline or not info.template or b.vars[name].template:
        return None
    names, rows = b.inline
    i = names.index(name)
    out = []
    for row in rows:
        keys = info.template.invert(row[i], info.families)
        if keys is not None:
            out.append(row[:i] + (keys,) + row[i + 1:])
    return inline_branch(b.spark, names, out, {**b.vars, name: replace(info, nullable=False)})


def inline_branch(spark: SparkSession, names, rows, infos: dict[str, Var]) -> Branch:
    """Inline rows as a frame; a template variable's cell is the tuple of its keys."""
    fields, flat = [], []
    for n in names:
        info = infos[n]
        if info.template:
            fields += [f"`{c}` {'bigint' if f == 'long' else 'string'}" for c, f in zip(info.columns(n), info.families)]
        else:
            fields.append(f"`{n}` {tm.spark_type_of(info.type.dt) if info.type.kind == 'literal' else 'string'}")
    for row in rows:
        flat.append(tuple(v for n, cell in zip(names, row) for v in (cell if infos[n].template else (cell,))))
    df = spark.createDataFrame(flat, ", ".join(fields))
    return Branch(spark, {n: infos[n] for n in names}, df, inline=(tuple(names), rows))


def _in_list(a: Branch, b: Branch) -> Branch | None:
    """A join with an inline list of different values of one variable is a pushed-down IN filter."""
    if not b.inline or len(b.inline[0]) != 1:
        return None
    name, rows = b.inline[0][0], b.inline[1]
    if name not in a.vars or a.vars[name].nullable or len(set(rows)) != len(rows):
        return None
    info = a.vars[name]
    if info.signature != b.vars[name].signature or len(info.columns(name)) != 1 or info.type.kind == "mixed":
        return None
    column = a.col(info.columns(name)[0])
    target = tm.spark_type_of(info.type.dt) if info.type.kind == "literal" else None
    values = [F.lit(r[0][0] if info.template else r[0]) for r in rows]
    return a.where(column.isin(*[v.cast(target) if target else v for v in values]))


def join(a: Branch, b: Branch) -> list[Branch]:
    """Natural join of compatible solutions; empty when there can be none."""
    shared = shared_vars(a, b)
    if any(a.vars[n].nullable or b.vars[n].nullable for n in shared):
        from kgspark.plans import loose
        return loose.join(a, b)
    if not shared:
        return [product(a, b)]
    merged = merge_scans(a, b)
    if merged:
        return [merged]
    pair = align(a, b, drop_left=True)
    if pair is None:
        return []
    a, b = pair
    filtered = _in_list(a, b) or _in_list(b, a)
    if filtered:
        return [filtered]
    df = a.df.join(b.df, on=a.physical(shared), how="inner")
    out = {**a.vars, **{n: i for n, i in b.vars.items() if n not in a.vars}}
    return [Branch(a.spark, out, df, consts={**a.consts, **b.consts})]


def product(a: Branch, b: Branch) -> Branch:
    """Every pairing of two unconnected solution sets. It is made when it is read: a filter that compares
    a value of one with a value of the other makes a join of ranges instead."""
    a, b = (Branch(x.spark, x.vars, x.df, consts=x.consts) for x in (a, b))
    return Branch(a.spark, {**a.vars, **b.vars}, consts={**a.consts, **b.consts}, pairing=(a, b))


def _every_pair(a: Branch, b: Branch) -> DataFrame:
    """The product, spread over all partitions.

    The smaller side, by the bytes that Spark knows, is copied once per slot and the other hashed over the slots, so this
    is an equi-join on the slot: no single task or broadcast holds a whole side.
    """
    warnings.warn("patterns share no variable: the result pairs all their solutions", stacklevel=2)
    ways = int(a.spark.conf.get("spark.sql.shuffle.partitions"))
    size = [int(str(x.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for x in (a, b)]
    large, small = (a, b) if size[0] >= size[1] else (b, a)
    columns = large.physical()
    left = large.df.withColumn("__slot", F.pmod(F.xxhash64(*(columns or [F.lit(1)])), F.lit(ways)))
    right = small.df.withColumn("__slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(ways - 1).cast("bigint"))))
    return left.join(right, "__slot").select(*(a.physical() + b.physical() or [F.lit(1).alias("__row")]))


def _on_side(df: DataFrame, column: Column) -> bool:
    """Whether an expression is made of columns of this frame, and of one at least."""
    try:
        df.select(column)
    except AnalysisException:
        return False
    return True


def paired(a: Branch, b: Branch, cond) -> Branch | None:
    """The pairs of two unconnected solution sets that a condition leaves, as a join of ranges; None if the condition
    orders no value of one by a value of the other."""
    whole = product(a, b)
    a, b = whole.pairing
    said = cond(Row(Branch(a.spark, whole.vars, a.df).term)) if callable(cond) else cond
    bounds: list[tuple[str, Column, Column]] = []  # (operator, value of a, value of b)
    for sign, x, y in said.orders:
        if any(_on_side(f.df, x) and _on_side(f.df, y) for f in (a, b)):
            continue  # of one side, or with a constant
        if _on_side(a.df, x) and _on_side(b.df, y):
            bounds.append((sign, x, y))
        elif _on_side(b.df, x) and _on_side(a.df, y):
            bounds.append(("<" if sign == ">" else ">", y, x))
    if not bounds:
        return None
    # The value that has both a lower and an upper bound is the point, if there is one.
    best = None
    for points, others, flip in ((a, b, False), (b, a, True)):
        ends: dict[str, tuple[str, Column, Column]] = {}
        for sign, x, y in bounds:
            point, end = (y, x) if flip else (x, y)
            above = (sign == ">") != flip  # the point is above the end
            text = point._jc.toString()
            ends.setdefault(text, {"point": point}).setdefault("low" if above else "high", end)
        for found in ends.values():
            if best is None or len(found) > len(best[2]):
                best = (points, others, found)
    points, others, found = best
    from kgspark.operators.ranges import range_join
    df = range_join(points.df, others.df, found["point"], said.truth(), found.get("low"), found.get("high"))
    return Branch(a.spark, whole.vars, df.select(*whole.physical()), consts=whole.consts)


def _theta(a: Branch, b: Branch, how: str, where) -> DataFrame:
    """Equi-join on the shared variables with an extra condition over both sides."""
    shared = shared_vars(a, b)
    cols = a.physical(shared)
    right = b.df.select(*[F.col(c).alias(f"__r_{c}") if c in cols else F.col(c) for c in b.physical()])
    cond = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"__r_{c}") for c in cols])
    both = Branch(a.spark, {**b.vars, **a.vars}, a.df)
    cond = cond & where(Row(both.term)).truth()
    return a.df.join(right, cond, how).drop(*[f"__r_{c}" for c in cols])


def semi(a: Branch, b: Branch, how: str, where=None) -> Branch:
    """``how``: left_semi or left_anti."""
    shared = shared_vars(a, b)
    if any(a.vars[n].nullable or b.vars[n].nullable for n in shared):
        from kgspark.plans import loose
        return loose.semi(a, b, how, where)
    if not shared:
        if where is not None:  # equal rows have equal partners, so the rows themselves are the key
            cols = a.physical()
            met = paired(a, b, where) or product(a, b)
            met = (met.where(where(met.row()).truth()) if met.pairing else met).df.select(*[F.col(c).alias(f"__r_{c}") for c in cols]).distinct()
            same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in cols])
            return Branch(a.spark, a.vars, a.df.join(met, same, how), consts=a.consts)
        some = b.df.limit(1).exists()
        return replace(a, frame=a.df.where(some if how == "left_semi" else ~some), scan=None, inline=None)
    pair = align(a, b)
    if pair is None:
        if how == "left_anti":
            return a
        return replace(a, frame=a.df.where(F.lit(False)), scan=None, inline=None)
    a, b = pair
    if where is not None:
        df = _theta(a, b, how, where)
    else:
        right = b.keep(shared).distinct()  # partial aggregation thins out hot keys before the shuffle
        df = a.df.join(right.df, on=a.physical(shared), how=how)
    return Branch(a.spark, a.vars, df, consts=a.consts)


def left_join(a: Branch, b: Branch, where=None) -> list[Branch]:
    """OPTIONAL: rows of ``a`` with their matches in ``b``, or alone."""
    shared = shared_vars(a, b)
    extra = [n for n in b.vars if n not in a.vars]
    if any(a.vars[n].nullable or b.vars[n].nullable for n in shared):
        from kgspark.plans import loose
        return loose.left_join(a, b, where)
    if not shared:
        matched = join(a, b)
        if where is not None:
            matched = [m.where(where(m.row()).truth()) for m in matched]
        return [*matched, semi(a, b, "left_anti", where)]
    optional = _nullable_columns(a, b, extra, where)
    if optional:
        return [optional]
    pair = align(a, b)
    if pair is None:
        return [a]
    a, b = pair
    out_vars = {**a.vars, **{n: replace(b.vars[n], nullable=True) for n in extra}}
    if where is None:
        df = a.df.join(b.df, on=a.physical(shared), how="left")
    else:
        df = _theta(a, b, "left", where)
    return [Branch(a.spark, out_vars, df, consts=a.consts)]


def _nullable_columns(a: Branch, b: Branch, extra, where) -> Branch | None:
    """OPTIONAL properties of the same row are nullable columns of the same scan."""
    merged = merge_scans(a, b)
    if merged is None or not extra or len(merged.scan.semis) != len(a.scan.semis):
        return None
    shared = shared_vars(a, b)
    if any(n not in a.scan.subjects & b.scan.subjects for n in shared):
        return None
    present = reduce(lambda x, y: x & y, b.scan.conds, F.lit(True))
    if where is not None:
        present = present & where(merged.row()).truth()
    exprs = dict(a.scan.exprs)
    for n in extra:
        for c in b.vars[n].columns(n):
            exprs[c] = F.when(present, b.scan.exprs[c])
    out_vars = {**a.vars, **{n: replace(b.vars[n], nullable=True) for n in extra}}
    return Branch(a.spark, out_vars, scan=replace(a.scan, exprs=exprs), consts=a.consts)
