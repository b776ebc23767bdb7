"""Joins on variables that may be unbound.

Two solutions are compatible if they agree wherever both are bound. Each kind of join is one equi-join over
one scan of each side, however many such variables there are:

* with a shared variable that is always bound, it is the key, and the others are a condition on the side;
* without one, both sides are tagged with what they have bound, as a bit mask. A row stands under every
  mask that occurs on the other side, and meets its partners on the two masks and on the values bound in both.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.plans import branch as br
from kgspark.plans.branch import Branch, Var
from kgspark.plans.expr import Row, Term
from kgspark.session import materialize
from kgspark.terms import INTEGER_T

ID, RIGHT = "__left_id", "__r_"
LOOK = 2  # variables that may be unbound, from which rows are looked at for the masks that occur


def is_loose(a: Branch, b: Branch) -> bool:
    return any(a.vars[n].nullable or b.vars[n].nullable for n in br.shared_vars(a, b))


def _aligned(a: Branch, b: Branch) -> tuple[Branch, Branch, list[str], list[str]] | None:
    """Both sides with the same form of each shared variable, the variables always bound, and the others;
    None when no two solutions can be compatible."""
    shared = br.shared_vars(a, b)
    firm = [n for n in shared if not a.vars[n].nullable and not b.vars[n].nullable]
    loose = [n for n in shared if n not in firm]
    for n in loose:
        x, y = a.vars[n], b.vars[n]
        if x.signature != y.signature:
            how = "text" if x.type == y.type and "mixed" not in (x.type.kind, y.type.kind) else "mixed"
            a, b = a.recast(n, how), b.recast(n, how)
    pair = br.align(a, b)
    return None if pair is None else (*pair, firm, loose)


def _bound(b: Branch, name: str, prefix: str = "") -> Column:
    return F.col(f"`{prefix}{b.vars[name].columns(name)[0]}`").isNotNull()


def _agree(a: Branch, name: str) -> Column:
    """Equal, or unbound on a side (the right one's columns carry the prefix)."""
    cols = a.vars[name].columns(name)
    same = reduce(lambda x, y: x & y, [F.col(f"`{c}`") == F.col(f"`{RIGHT}{c}`") for c in cols])
    return ~_bound(a, name) | ~_bound(a, name, RIGHT) | same


def _prefixed(b: Branch, names) -> DataFrame:
    cols = set(b.physical(names))
    return b.df.select(*[F.col(f"`{c}`").alias(RIGHT + c) if c in cols else F.col(f"`{c}`") for c in b.physical()] or [F.lit(1).alias("__row")])


def _either(a: Branch, name: str) -> dict[str, Column]:
    return {c: F.coalesce(F.col(f"`{c}`"), F.col(f"`{RIGHT}{c}`")) for c in a.vars[name].columns(name)}


def _row(a: Branch, b: Branch, loose) -> Row:
    """What a condition over both sides sees: of a loose variable the value of the side that has one."""
    both = Branch(a.spark, {**b.vars, **a.vars}, a.df)

    def look(name: str) -> Term:
        if name not in loose:
            return both.term(name)
        info, cols = a.vars[name], list(_either(a, name).values())
        if info.template:
            return Term(None, info.type, template=info.template, keys=cols, families=info.families)
        return Term(cols[0], info.type)
    return Row(look)


def _condition(a: Branch, b: Branch, firm, loose, where) -> Column:
    cols = a.physical(firm)
    parts = [F.col(f"`{c}`") == F.col(f"`{RIGHT}{c}`") for c in cols] + [_agree(a, n) for n in loose]
    if where is not None:
        parts.append(where(_row(a, b, loose)).truth())
    return reduce(lambda x, y: x & y, parts)


def _joined_vars(a: Branch, b: Branch, loose) -> dict[str, Var]:
    out = {**a.vars, **{n: i for n, i in b.vars.items() if n not in a.vars}}
    return out | {n: replace(a.vars[n], nullable=a.vars[n].nullable and b.vars[n].nullable) for n in loose}


def _finished(df: DataFrame, a: Branch, b: Branch, loose, extra=()) -> DataFrame:
    """The joined columns, each loose variable from the side that has it."""
    merged = {c: e for n in loose for c, e in _either(a, n).items()}
    mine = [merged[c].alias(c) if c in merged else F.col(f"`{c}`") for c in a.physical()]
    theirs = [F.col(f"`{c}`") for n in b.vars if n not in a.vars for c in b.vars[n].columns(n)]
    return df.select(*extra, *(mine + theirs or [F.lit(1).alias("__row")]))


def _mask(side: Branch, loose) -> Column:
    return reduce(lambda x, y: x + y, [F.when(_bound(side, n), F.lit(1 << i)).otherwise(F.lit(0)) for i, n in enumerate(loose)])


def _masks(side: Branch, loose) -> list[int]:
    """The masks that occur on a side: by what is always bound, and where that leaves many, by a look at the rows."""
    open_ = [1 << i for i, n in enumerate(loose) if side.vars[n].nullable]
    if len(open_) > LOOK:
        return sorted(r[0] for r in side.df.select(_mask(side, loose).alias("m")).distinct().collect())
    every = [sum(1 << i for i, n in enumerate(loose) if not side.vars[n].nullable)]
    for bit in open_:
        every += [m + bit for m in every]
    return sorted(every)


def _by_masks(a: Branch, b: Branch, loose, keep=(), needs_shared: bool = False) -> DataFrame:
    """Compatible pairs where no shared variable is always bound."""
    left, right, on = _masked(a, b, loose, keep, needs_shared)
    return left.join(right.hint("merge"), on)  # copies over slots are many more than Spark expects: never broadcast


def _masked(a: Branch, b: Branch, loose, keep=(), needs_shared: bool = False) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides, each row once for each mask that occurs on the other side, and what the two must have equal.

    Pairs that have nothing bound in common are a product; it is spread over slots.
    """
    ways = int(a.spark.conf.get("spark.sql.shuffle.partitions"))

    def others(side: Branch) -> Column:
        return F.explode(F.array(*[F.lit(m) for m in _masks(side, loose)]).cast("array<int>"))

    left = a.df.withColumn("__ma", _mask(a, loose)).withColumn("__mb", others(b))
    right = b.df.withColumn("__mb", _mask(b, loose)).withColumn("__ma", others(a))
    both = F.col("__ma").bitwiseAND(F.col("__mb"))
    if needs_shared:
        left, right = left.where(both != 0), right.where(both != 0)
    for side, name in ((a, "left"), (b, "right")):
        keys = {f"__key_{c}": F.when(both.bitwiseAND(F.lit(1 << i)) != 0, F.col(f"`{c}`"))
                for i, n in enumerate(loose) for c in side.vars[n].columns(n)}
        if name == "left":
            slot = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in (*a.physical(), *keep)]), F.lit(ways)).cast("int")
            left = left.withColumns({**keys, "__slot": F.when(both == 0, slot).otherwise(0)})
        else:
            slots = F.when(both == 0, F.sequence(F.lit(0), F.lit(ways - 1))).otherwise(F.array(F.lit(0)))
            right = right.withColumns(keys).withColumn("__slot", F.explode(slots))
    names = [f"__key_{c}" for c in a.physical(loose)]
    shared_cols = set(a.physical(loose))
    right = right.select("__ma", "__mb", "__slot", *[F.col(f"`{n}`").alias(f"__r{n}") for n in names],
                         *[F.col(f"`{c}`").alias(RIGHT + c) if c in shared_cols else F.col(f"`{c}`") for c in b.physical()])
    on = [left["__ma"] == right["__ma"], left["__mb"] == right["__mb"], left["__slot"] == right["__slot"]]
    on += [F.col(f"`{n}`").eqNullSafe(F.col(f"`__r{n}`")) for n in names]
    return left, right, reduce(lambda x, y: x & y, on)


def join(a: Branch, b: Branch) -> list[Branch]:
    """Natural join of compatible solutions."""
    ready = _aligned(a, b)
    if ready is None:
        return []
    a, b, firm, loose = ready
    df = (a.df.join(_prefixed(b, firm + loose), _condition(a, b, firm, loose, None)) if firm else _by_masks(a, b, loose))
    return [Branch(a.spark, _joined_vars(a, b, loose), _finished(df, a, b, loose), consts={**b.consts, **a.consts})]


def _numbered(a: Branch) -> Branch:
    """The solutions written once, each with a number of its own."""
    return replace(a, frame=materialize(a.df.withColumn(ID, F.monotonically_increasing_id())), scan=None, inline=None)


def _pairs(a: Branch, b: Branch, loose, where, needs_shared: bool = False) -> Branch:
    """Compatible pairs that satisfy the condition, with the number of the left solution."""
    df = _by_masks(a, b, loose, (ID,), needs_shared)
    out = Branch(a.spark, _joined_vars(a, b, loose), _finished(df, a, b, loose, (ID,)))
    return out if where is None else out.where(where(out.row()).truth())


def left_join(a: Branch, b: Branch, where=None) -> list[Branch]:
    """OPTIONAL on variables that may be unbound."""
    ready = _aligned(a, b)
    if ready is None:
        return [a]
    a, b, firm, loose = ready
    extra = {n: replace(i, nullable=True) for n, i in b.vars.items() if n not in a.vars}
    if firm:
        df = a.df.join(_prefixed(b, firm + loose), _condition(a, b, firm, loose, where), "left")
        return [Branch(a.spark, {**a.vars, **extra}, _finished(df, a, b, loose), consts=a.consts)]
    a = _numbered(a)
    met = _pairs(a, b, loose, where)
    met = replace(met, frame=materialize(met.df))
    rest = a.df.join(met.df.select(ID).distinct(), ID, "left_anti").drop(ID)
    return [replace(met, frame=met.df.drop(ID), consts={**b.consts, **a.consts}), Branch(a.spark, a.vars, rest, consts=a.consts)]


def semi(a: Branch, b: Branch, how: str, where=None, needs_shared: bool = False) -> Branch:
    """Solutions of ``a`` with (``left_semi``) or without (``left_anti``) a compatible one of ``b``; with
    ``needs_shared`` the two must have a variable bound in common."""
    ready = _aligned(a, b)
    if ready is None:
        return a if how == "left_anti" else replace(a, frame=a.df.where(F.lit(False)), scan=None, inline=None)
    a, b, firm, loose = ready
    if firm:
        right = b if where is not None else b.keep(firm + loose).distinct()
        df = a.df.join(_prefixed(right, firm + loose), _condition(a, right, firm, loose, where), how)
        return Branch(a.spark, a.vars, df, consts=a.consts)
    a = _numbered(a)
    right = b if where is not None else b.keep(loose).distinct()
    met = _pairs(a, right, loose, where, needs_shared).df.select(ID).distinct()
    return Branch(a.spark, a.vars, a.df.join(met, ID, how).drop(ID), consts=a.consts)


def _prefixes(a: DataFrame, b: DataFrame, mine: str, theirs: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column ``__node``: two rows share exactly one if ``theirs`` is less than ``mine``, else none.

    Nodes are those of a binary tree over the whole numbers that occur; the numbers below one are a node per bit.
    """
    a, b = a.where(F.col(f"`{mine}`").isNotNull()), b.where(F.col(f"`{theirs}`").isNotNull())
    ends = [df.agg(F.min(f"`{c}`"), F.max(f"`{c}`")).first() for df, c in ((a, mine), (b, theirs))]
    seen = [int(v) for r in ends for v in r if v is not None]
    low, bits = (min(seen), (max(seen) - min(seen)).bit_length()) if seen else (0, 0)
    if bits > 62:
        raise ValueError(f"?{mine} and ?{theirs} lie too far apart")

    def nodes(c: str, of) -> Column:
        at = (F.col(f"`{c}`") - F.lit(low)).cast("bigint")
        return F.explode(F.filter(F.array(*[of(F.shiftright(at, k), F.lit(k)) for k in range(bits + 1)]), lambda x: x.isNotNull()))

    left = nodes(mine, lambda at, k: F.when(at % 2 == 1, F.struct(k.alias("k"), (at - 1).alias("at"))))
    return a.withColumn("__node", left), b.withColumn("__node", nodes(theirs, lambda at, k: F.struct(k.alias("k"), at.alias("at"))))


def counted(a: Branch, b: Branch, count: str, keep, below: tuple[str, str] | None = None) -> list[Branch]:
    """Natural join in which solutions of ``b`` that show the same in ``keep`` are one, with their number."""
    ready = _aligned(a, b)
    if ready is None:
        return []
    a, b, firm, loose = ready
    shared, own = firm + loose, [n for n in b.vars if n in keep and n not in a.vars]
    left, right = a.df, b.df
    if below:
        mine, theirs = (side.vars[n].columns(n)[0] for side, n in ((a, below[1]), (b, below[0])))
        left, right = _prefixes(left, right, mine, theirs)

    def masks(side: Branch) -> Column:
        return F.explode(F.array(*[F.lit(m) for m in _masks(side, shared)]).cast("array<int>"))

    def keys(side: Branch) -> dict[str, Column]:
        both = F.col("__ma").bitwiseAND(F.col("__mb"))
        return {f"__key_{c}": F.when(both.bitwiseAND(F.lit(1 << i)) != 0, F.col(f"`{c}`"))
                for i, n in enumerate(shared) for c in side.vars[n].columns(n)}

    mask = lambda side: _mask(side, shared) if shared else F.lit(0)
    left = left.withColumn("__ma", mask(a)).withColumn("__mb", masks(b)).withColumns(keys(a))
    right = right.withColumn("__mb", mask(b)).withColumn("__ma", masks(a))
    adds = {RIGHT + c: F.when(F.col("__ma").bitwiseAND(F.lit(1 << i)) == 0, F.col(f"`{c}`"))
            for i, n in enumerate(shared) if n in keep for c in b.vars[n].columns(n)}
    on = ["__ma", "__mb", *keys(a), *(["__node"] if below else [])]
    right = right.withColumns({**keys(b), **adds})
    right = right.groupBy(*[F.col(f"`{c}`") for c in (*on, *adds, *b.physical(own))]).agg(F.count(F.lit(1)).alias(count))
    right = materialize(right.withColumnsRenamed({c: f"__r{c}" for c in on}))
    met = left.join(right.hint("merge") if below else right,
                    reduce(lambda x, y: x & y, [F.col(f"`{c}`").eqNullSafe(F.col(f"`__r{c}`")) for c in on]))
    infos = _joined_vars(a, b, loose)
    infos = {n: i for n, i in infos.items() if n in keep or n in a.vars and n not in shared}
    merged = {c: e for n in shared if n in keep for c, e in _either(a, n).items()}
    cols = [merged[c].alias(c) if c in merged else F.col(f"`{c}`") for n in infos for c in infos[n].columns(n)]
    return [Branch(a.spark, {**infos, count: Var(INTEGER_T)}, met.select(*cols, F.col(f"`{count}`")))]
