"""Property paths: compositions of patterns, and closures where the length is open.

Sequence, alternative, inverse and fixed or bounded length keep duplicates; ``?``, ``+`` and
``*`` are sets.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import functions as F

from kgspark.operators.closure import closure, connected
from kgspark.plans import branch as br
from kgspark.plans.branch import Branch
from kgspark.terms import IRI


@dataclass(frozen=True)
class Path:
    kind: str
    args: tuple
    lo: int = 0
    hi: int | None = None
    distinct: bool = False


def seq(*steps) -> Path:
    return Path("seq", steps)


def alt(*steps) -> Path:
    return Path("alt", steps)


def inv(step) -> Path:
    return Path("inv", (step,))


def repeat(step, lo: int, hi: int, distinct: bool = False) -> Path:
    """Between ``lo`` and ``hi`` steps."""
    return Path("repeat", (step,), lo, hi, distinct)


def opt(step) -> Path:
    return Path("opt", (step,))


def neg(*predicates) -> Path:
    """Any predicate but these."""
    return Path("neg", predicates)


def plus(step) -> Path:
    return Path("plus", (step,))


def star(step) -> Path:
    return Path("star", (step,))


def match_path(kg, s, path: Path, o, graph):
    """Solutions of ``s path o`` over anything with ``match``."""
    from kgspark.plans.kg import hidden, is_var
    extra = {"graph": graph} if graph is not None else {}

    def one(a, p, b):
        return kg.match(a, p, b, **extra) if not isinstance(p, Path) else match_path(kg, a, p, b, graph)

    ends = [x[1:] for x in (s, o) if is_var(x)]

    def project(bindings):
        keep = list(dict.fromkeys(ends))
        return bindings._with([b.keep(keep) for b in bindings.branches],
                              {n: i for n, i in bindings.names.items() if n in keep})

    if path.kind == "inv":
        out = one(o, path.args[0], s)
    elif path.kind == "seq":
        stops = [s] + [hidden() for _ in path.args[1:]] + [o]
        out = one(stops[0], path.args[0], stops[1])
        for i, step in enumerate(path.args[1:], 1):
            out = out.join(one(stops[i], step, stops[i + 1]))
        out = project(out)
    elif path.kind == "alt":
        out = one(s, path.args[0], o)
        for step in path.args[1:]:
            out = out.union(one(s, step, o))
    elif path.kind == "neg":
        p = hidden()
        wanted = [x for x in kg.predicates() if x not in {str(a) for a in path.args}]
        out = project(kg.match(s, p, o, predicates=wanted, **extra))
    elif path.kind == "repeat":
        out = None
        for n in range(path.lo, path.hi + 1):
            part = _identity(kg, one, s, path.args[0], o) if n == 0 else match_path(kg, s, seq(*path.args * n), o, graph)
            out = part if out is None else out.union(part)
        if path.distinct:
            out = out.distinct()
    elif path.kind == "opt":
        out = one(s, path.args[0], o).union(_identity(kg, one, s, path.args[0], o)).distinct()
    else:
        out = _closure(kg, one, s, path.args[0], o, path.kind == "star")
    out._patterns = [(s, p, o) for p in _predicates(path)]
    out.names = {n: out.names[n] for n in dict.fromkeys(ends)}
    return out


def _predicates(path: Path):
    for a in path.args:
        yield from (_predicates(a) if isinstance(a, Path) else [a])


def _edges(one, step) -> Branch:
    """All (x, y) pairs of one step, both ends in one representation."""
    b = br.unite(one("?kgx", step, "?kgy").branches)
    x, y = b.vars["kgx"], b.vars["kgy"]
    if x.signature != y.signature:
        same = x.type == y.type
        for n in ("kgx", "kgy"):
            b = b.recast(n, "text" if same else "mixed")
    return b


def _pairs(b: Branch, names=("src", "dst")):
    """Pairs as two columns; a key tuple becomes a struct."""
    cols = []
    for n, out in zip(("kgx", "kgy"), names):
        phys = [b.col(c) for c in b.vars[n].columns(n)]
        col = phys[0] if len(phys) == 1 else F.struct(*[c.alias(f"k{i}") for i, c in enumerate(phys)])
        cols.append(col.alias(out))
    from kgspark.plans.bindings import _project
    return _project(b, dict(zip(names, cols)))


def _from_pairs(kg, b: Branch, pairs, s, o):
    """Bind (src, dst) to the pattern's ends."""
    from kgspark.plans.bindings import Bindings
    from kgspark.plans.kg import is_var
    info = replace(b.vars["kgx"], nullable=False)
    cols, infos = {}, {}
    for name, side in (("kgx", "src"), ("kgy", "dst")):
        phys = info.columns(name)
        for i, c in enumerate(phys):
            cols[c] = F.col(side) if len(phys) == 1 else F.col(side)[f"k{i}"]
        infos[name] = info
    out = Bindings(kg.spark, [Branch(kg.spark, infos, pairs.select(*[c.alias(n) for n, c in cols.items()]))],
                   infos, kg.strict)
    for end, name in ((s, "kgx"), (o, "kgy")):
        if not is_var(end):
            out = out.filter(lambda r, n=name, e=end: r[n] == e)
    if is_var(s) and s == o:
        out = out.filter(lambda r: r["kgx"] == r["kgy"])
        return out.select("kgx").rename(kgx=s[1:])
    renames = {n: e[1:] for n, e in (("kgx", s), ("kgy", o)) if is_var(e)}
    keep = list(renames)
    out = out._with([x.keep(keep) for x in out.branches], {n: infos[n] for n in keep})
    return out.rename(**renames)


def _nodes(pairs):
    both = F.explode(F.array("src", "dst"))
    return pairs.select(both.alias("src")).distinct()


def _identity(kg, one, s, step, o):
    """Zero steps: every node of the step's graph with itself; a bound end with itself."""
    from kgspark.plans.kg import is_var
    fixed = [x for x in (s, o) if isinstance(x, IRI)]
    if fixed:
        other = o if fixed[0] is s else s
        from kgspark.plans.bindings import inline
        if is_var(other):
            return inline(kg.spark, other, [(fixed[0],)], kg.strict)
        rows = [()] if all(x == fixed[0] for x in (s, o)) else []
        return inline(kg.spark, [], rows, kg.strict)
    b = _edges(one, step)
    pairs = _nodes(_pairs(b)).withColumn("dst", F.col("src"))
    return _from_pairs(kg, b, pairs, s, o)


def _closure(kg, one, s, step, o, reflexive: bool):
    from kgspark.plans.kg import is_var
    b = _edges(one, step)
    pairs = _pairs(b).distinct()
    start = None
    if not is_var(s) or not is_var(o):  # walk from the bound end only
        back = is_var(s)
        if back:
            pairs = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        end = o if back else s
        start = _constant_side(b, end)
        if start is None:
            found = pairs.limit(0)
        elif not is_var(s) and not is_var(o):  # from both ends towards each other
            to = _constant_side(b, o, "kgy")
            met = to is not None and connected(pairs, start, to)[0]
            found = pairs.limit(0)
            if met:  # one row of both ends
                is_s, is_o = start(F.col("src")), to(F.col("dst"))
                found = pairs.where(is_s | is_o).agg(F.max(F.when(is_s, F.col("src"))).alias("src"), F.max(F.when(is_o, F.col("dst"))).alias("dst"))
        else:
            found = closure(pairs, sources=pairs.select("src").where(start(F.col("src"))).distinct())
        if back:
            found = found.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        out = _from_pairs(kg, b, found, s, o)
        if reflexive:
            out = out.union(_identity(kg, one, s, step, o)).distinct()
        return out
    return _from_pairs(kg, b, closure(pairs, reflexive=reflexive), s, o)


def _constant_side(b: Branch, iri, side: str = "kgx"):
    """Condition for a pair column to be the constant."""
    info = b.vars[side]
    if info.template:
        keys = info.template.invert(str(iri), info.families)
        if keys is None:
            return None
        if len(keys) == 1:
            return lambda c: c == F.lit(keys[0])
        return lambda c: F.struct(*[c[f"k{i}"] for i in range(len(keys))]) == F.struct(*[F.lit(k) for k in keys])
    if info.type.kind == "mixed":
        return lambda c: (c["value"] == str(iri)) & (c["kind"] == "iri")
    return lambda c: c == F.lit(str(iri))
