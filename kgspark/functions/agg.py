"""Aggregates over solution variables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from kgspark import terms as tm
from kgspark.plans.expr import Term
from kgspark.terms import INTEGER_T, STRING_T, XSD, RdfType


@dataclass(frozen=True)
class Agg:
    kind: str
    arg: object = None  # variable name or row -> Term
    distinct: bool = False
    sep: str = " "

    def inputs(self, t: Term | None) -> list[Column]:
        """The columns to aggregate; a counted template IRI is counted by its keys."""
        if t is None:
            return []
        if self.kind in ("count", "sample") and t.template:
            return list(t.keys) if self.kind == "count" else [t.value]
        if self.kind == "count":
            return [t.value]
        if self.kind in ("sum", "avg"):
            exact = "decimal(38,10)" if self.kind == "avg" else "decimal(38,0)"
            return [t.number().cast(exact) if t.is_integer else t.number()]
        if self.kind in ("min", "max") and t.type.kind == "mixed":
            return [t.value, F.when(t.bound, F.struct(*t.order_keys()))]
        return [t.text if self.kind == "group_concat" else t.value]

    def result(self, t: Term | None, cols: list[str]) -> tuple[Column, RdfType]:
        if self.kind == "count":
            if t is None:
                return F.count(F.lit(1)), INTEGER_T
            if self.distinct:
                return F.count_distinct(*[F.col(c) for c in cols]), INTEGER_T
            return F.count(F.col(cols[0])), INTEGER_T
        c, d = cols[0], "DISTINCT " if self.distinct else ""
        if self.kind == "sum":
            # Integers have no bound: they are summed, and stay, in 38 digits.
            return F.when(F.count(F.col(c)) == 0, F.lit(0)).otherwise(F.expr(f"try_sum({d}`{c}`)")), _numeric(t)
        if self.kind == "avg":
            out = tm.literal_type(XSD.decimal) if t.is_integer else _numeric(t)
            return F.when(F.count(F.col(c)) == 0, F.lit(0)).otherwise(F.expr(f"try_avg({d}`{c}`)")), out
        if self.kind == "group_concat":
            collected = F.collect_set(F.col(c)) if self.distinct else F.collect_list(F.col(c))
            return F.array_join(F.sort_array(collected), self.sep), STRING_T
        if self.kind == "sample":
            return F.any_value(F.col(c), F.lit(True)), t.type
        if len(cols) > 1:  # a mixed variable: the value that is ordered first or last
            return (F.min_by if self.kind == "min" else F.max_by)(F.col(c), F.col(cols[1])), t.type
        return (F.min if self.kind == "min" else F.max)(F.col(c)), t.type


def _numeric(t: Term) -> RdfType:
    return INTEGER_T if t.is_integer else (t.type if t.is_numeric else tm.literal_type(XSD.double))


def count(var=None, distinct: bool = False) -> Agg:
    """COUNT(*) without an argument; COUNT(?v) counts bound values only."""
    return Agg("count", var, distinct)


def count_distinct(var=None) -> Agg:
    """COUNT(DISTINCT ?v); without an argument COUNT(DISTINCT *)."""
    return Agg("count_solutions") if var is None else Agg("count", var, True)


def sum(var, distinct: bool = False) -> Agg:  # noqa: A001
    return Agg("sum", var, distinct)


def avg(var, distinct: bool = False) -> Agg:
    return Agg("avg", var, distinct)


def min(var) -> Agg:  # noqa: A001
    return Agg("min", var)


def max(var) -> Agg:  # noqa: A001
    return Agg("max", var)


def group_concat(var, sep: str = " ", distinct: bool = False) -> Agg:
    """Sorted, so the result is the same on every run. One cell holds the whole group's text."""
    return Agg("group_concat", var, distinct, sep)


def sample(var) -> Agg:
    return Agg("sample", var)
