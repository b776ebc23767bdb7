"""Typed expressions over solution variables.

A :class:`Term` is a Spark column with its static RDF type. Operators follow the SPARQL rules:
an error (bad cast, overflow, division by zero, incompatible types) is NULL, never an exception.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kgspark import terms as tm
from kgspark.terms import BOOLEAN_T, IRI, IRI_T, MIXED_T, XSD, RdfType, Template


class Term:
    """``value`` is the native column (a string for IRIs, a MIXED struct when mixed)."""

    def __init__(self, value: Column | None, type: RdfType, *, template: Template | None = None,
                 keys: list[Column] | None = None, families=(), const=None, stable: bool = True,
                 names=frozenset(), proves=frozenset()):
        self._value, self.type = value, type
        # names: variables that are bound whenever this term is; proves: whenever it is true.
        self.names, self.proves = frozenset(names), frozenset(proves)
        self.template, self.keys, self.families = template, keys or [], tuple(families)
        self.const, self.stable = const, stable
        self._present: list[Column] | None = None
        # Comparisons that hold whenever this term is true: (operator, one side, other side).
        self.orders: tuple[tuple[str, Column, Column], ...] = ()

    # -- columns ---------------------------------------------------------------------------
    @property
    def value(self) -> Column:
        if self._value is None:
            self._value = self.template.render(self.keys, self.families)
        return self._value

    @property
    def bound(self) -> Column:
        return (self.keys[0] if self.template else self.value).isNotNull()

    def present(self) -> list[Column]:
        """Conditions for a mapped term to exist, made once."""
        if self._present is None:
            self._present = [] if self.const is not None else [
                c.isNotNull() for c in (self.keys if self.template else [self.value])]
        return self._present

    @property
    def text(self) -> Column:
        """Lexical form."""
        if self.type.kind == "mixed":
            return self.value["value"]
        return tm.lexical(self.value, dt=self.type.dt) if self.type.kind == "literal" else self.value

    @property
    def is_numeric(self) -> bool:
        return self.type.kind == "literal" and self.type.dt in tm.NUMERIC_DTS

    @property
    def is_integer(self) -> bool:
        return self.type.kind == "literal" and self.type.dt in tm.INTEGER_DTS

    @property
    def is_string(self) -> bool:
        return self.type.kind == "literal" and (self.type.lang is not None or
                                                tm.spark_type_of(self.type.dt) == "string")

    def kind_column(self) -> Column:
        return self.value["kind"] if self.type.kind == "mixed" else F.when(self.bound, F.lit(self.type.kind))

    def dt_column(self) -> Column:
        """Datatype IRI, '' for non-literals and tagged strings; NULL when unbound."""
        if self.type.kind == "mixed":
            return self.value["dt"]
        return F.when(self.bound, F.lit(self.type.dt or ""))

    def lang_column(self) -> Column:
        if self.type.kind == "mixed":
            return self.value["lang"]
        return F.when(self.bound, F.lit(self.type.lang or ""))

    def as_mixed(self) -> Column:
        if self.type.kind == "mixed":
            return self.value
        struct = F.struct(
            F.lit(self.type.kind).alias("kind"), self.text.alias("value"),
            F.lit(self.type.dt or "").alias("dt"), F.lit(self.type.lang or "").alias("lang"))
        return F.when(self.bound, struct)

    def as_string(self) -> Column:
        """Text usable by string functions: NULL (an error) for IRIs and blank nodes."""
        if self.type.kind == "mixed":
            return F.when(self.value["kind"] == "literal", self.value["value"])
        return self.text if self.type.kind == "literal" else F.lit(None).cast("string")

    def number(self) -> Column:
        if self.type.kind == "mixed":
            return F.when(self.value["dt"].isin(sorted(tm.NUMERIC_DTS)), self.value["value"].try_cast("double"))
        return self.value if self.is_numeric else F.lit(None).cast("double")

    def order_keys(self) -> list[Column]:
        """What solutions are ordered by: for a mixed variable unbound, blank nodes, IRIs, then literals
        by value."""
        if self.type.kind != "mixed":
            return [self.value]
        rank = F.when(self.value["kind"] == "bnode", 1).when(self.value["kind"] == "iri", 2).otherwise(3)
        return [F.when(self.bound, rank), self.number(), self.value["value"]]

    def truth(self) -> Column:
        """Effective boolean value."""
        if self.type == BOOLEAN_T:
            return self.value
        if self.is_string:
            return F.length(self.value) > 0
        if self.is_numeric:
            number = self.value.cast("double")
            return (number != 0) & ~F.isnan(number)
        return F.lit(None).cast("boolean")

    # -- logic -----------------------------------------------------------------------------
    def __and__(self, other):
        other = term(other)
        if self.const is False or other.const is False:
            return boolean(F.lit(False), False)
        const = True if self.const is True and other.const is True else None
        both = boolean(self.truth() & other.truth(), const, proves=self.proves | other.proves)
        both.orders = self.orders + other.orders
        return both

    def __or__(self, other):
        other = term(other)
        if self.const is True or other.const is True:
            return boolean(F.lit(True), True)
        const = False if self.const is False and other.const is False else None
        return boolean(self.truth() | other.truth(), const, proves=self.proves & other.proves)

    def __invert__(self):
        return boolean(~self.truth(), None if self.const is None else not self.const, self.names, self.names)

    __rand__, __ror__ = __and__, __or__

    # -- comparison ------------------------------------------------------------------------
    def _comparable(self, other: "Term"):
        """Both sides in one Spark type, or None when comparing them is an error."""
        a, b = self, other
        if a.type.kind == "mixed" or b.type.kind == "mixed":
            if a.is_numeric or b.is_numeric:
                return a.number().cast("double"), b.number().cast("double")
            mixed, plain = (a, b) if a.type.kind == "mixed" else (b, a)
            same = (mixed.value["kind"] == plain.type.kind) & (mixed.value["dt"] == (plain.type.dt or ""))
            same = same & (mixed.value["lang"] == (plain.type.lang or ""))
            text = F.when(same, mixed.value["value"])
            if plain.type.kind == "literal" and not plain.is_string:
                text = text.try_cast(tm.spark_type_of(plain.type.dt))
                return (text, plain.value) if mixed is a else (plain.value, text)
            return (text, plain.text) if mixed is a else (plain.text, text)
        if a.is_numeric and b.is_numeric:
            if "double" in (_rank(a), _rank(b)):
                return a.value.cast("double"), b.value.cast("double")
            return a.value, b.value
        if a.is_string and b.is_string and a.type.lang == b.type.lang:
            return a.value, b.value
        if a.type.kind == b.type.kind == "literal" and a.type.dt == b.type.dt:
            return a.value, b.value
        times = {str(XSD.date), str(XSD.dateTime)}
        if a.type.dt in times and b.type.dt in times:
            return a.value.cast("timestamp"), b.value.cast("timestamp")
        return None

    def _compare(self, other, op: Callable, sign: str = "") -> "Term":
        other = term(other)
        if self.type.kind == other.type.kind == "mixed":
            names = self.names | other.names
            return boolean(_by_value(self, other, op), None, names, names)
        pair, names = self._comparable(other), self.names | other.names
        out = boolean(F.lit(None).cast("boolean") if pair is None else op(*pair), None, names, names)
        if pair is not None and sign:
            out.orders = ((sign, *pair),)
        return out

    def __lt__(self, other):
        return self._compare(other, lambda a, b: a < b, "<")

    def __le__(self, other):
        return self._compare(other, lambda a, b: a <= b, "<")

    def __gt__(self, other):
        return self._compare(other, lambda a, b: a > b, ">")

    def __ge__(self, other):
        return self._compare(other, lambda a, b: a >= b, ">")

    def __eq__(self, other):  # type: ignore[override]
        other = term(other)
        if self.const is not None and other.const is not None and self.type == other.type:
            return boolean(F.lit(self.const == other.const), self.const == other.const)
        same = _same_resource(self, other)
        names = self.names | other.names
        if same is not None:
            return boolean(same, None, names, names)
        if self.type.kind == "mixed" and other.type.kind == "mixed":
            # The same term, or equal values; two resources, or a resource and a literal, always compare.
            a, b = self.value, other.value
            resource = (a["kind"] != "literal") | (b["kind"] != "literal")
            equal = F.when(a == b, F.lit(True)).when(resource & self.bound & other.bound, F.lit(False))
            return boolean(equal.otherwise(_by_value(self, other, lambda x, y: x == y)), None, names, names)
        return self._compare(other, lambda a, b: a == b)

    def __ne__(self, other):  # type: ignore[override]
        return ~(self == other)

    __hash__ = None  # type: ignore[assignment]

    # -- arithmetic ------------------------------------------------------------------------
    def _arith(self, other, op: Callable, *, divide: bool = False, swap: bool = False) -> "Term":
        a, b = self, term(other)
        if swap:
            a, b = b, a
        if a.type.kind == "mixed" or b.type.kind == "mixed":
            rank = "double"
        elif a.is_numeric and b.is_numeric:
            rank = max(_rank(a), _rank(b), key=_RANKS.index)
        else:
            return Term(F.lit(None).cast("double"), tm.literal_type(XSD.double))
        x, y = a.number(), b.number()
        if rank == "integer" and divide:
            x, y, rank = x.try_cast("decimal(20,0)"), y.try_cast("decimal(20,0)"), "decimal"
        elif rank in ("float", "double"):
            x, y, rank = x.cast("double"), y.cast("double"), "double"
        elif rank == "integer":
            x, y = x.try_cast("bigint"), y.try_cast("bigint")  # a sum may be longer
        return Term(op(x, y), tm.literal_type(XSD[rank]), names=self.names | term(other).names)

    def __add__(self, other):
        return self._arith(other, F.try_add)

    def __sub__(self, other):
        return self._arith(other, F.try_subtract)

    def __mul__(self, other):
        return self._arith(other, F.try_multiply)

    def __truediv__(self, other):
        return self._arith(other, F.try_divide, divide=True)

    def __radd__(self, other):
        return self._arith(other, F.try_add, swap=True)

    def __rsub__(self, other):
        return self._arith(other, F.try_subtract, swap=True)

    def __rmul__(self, other):
        return self._arith(other, F.try_multiply, swap=True)

    def __rtruediv__(self, other):
        return self._arith(other, F.try_divide, divide=True, swap=True)

    def __neg__(self):
        return term(0) - self


_RANKS = ["integer", "decimal", "float", "double"]


def _rank(t: Term) -> str:
    if t.is_integer:
        return "integer"
    local = tm.xsd_local(t.type.dt)
    return local if local in _RANKS else "double"


_EXACT = sorted(tm.INTEGER_DTS | {str(XSD.decimal)})
_TIMES = [str(XSD.date), str(XSD.dateTime)]


def _by_value(a: Term, b: Term, op: Callable) -> Column:
    """Two mixed literals compared by value: numbers as numbers, times as times, others of one datatype
    and language by their text. NULL, an error, for anything else."""
    x, y = a.value, b.value

    def both(dts) -> Column:
        return x["dt"].isin(dts) & y["dt"].isin(dts)

    def cast(kind: str) -> Column:
        return op(x["value"].try_cast(kind), y["value"].try_cast(kind))

    alike = (x["kind"] == "literal") & (y["kind"] == "literal") & (x["dt"] == y["dt"]) & (x["lang"] == y["lang"])
    return (F.when(both(_EXACT), cast("decimal(38,10)")).when(both(sorted(tm.NUMERIC_DTS)), op(a.number(), b.number()))
            .when(both(_TIMES), cast("timestamp")).when(both([str(XSD.boolean)]), cast("boolean"))
            .when(alike, op(x["value"], y["value"])))


def _same_resource(a: Term, b: Term) -> Column | None:
    """Equality when a side is an IRI or blank node; keys are compared instead of built text."""
    kinds = {a.type.kind, b.type.kind}
    if "mixed" in kinds or not kinds & {"iri", "bnode"}:
        return None
    never = F.when(a.bound & b.bound, F.lit(False))
    if len(kinds) > 1:
        return never
    if a.template and b.template and a.template.injective and a.families == b.families:
        if a.template.parts == b.template.parts:
            same = F.lit(True)
            for x, y in zip(a.keys, b.keys):
                same = same & (x == y)
            return same
        if b.template.injective and not a.template.may_unify(b.template):
            return never
    for t, c in ((a, b), (b, a)):
        if t.template and t.template.injective and isinstance(c.const, str):
            keys = t.template.invert(c.const, t.families)
            if keys is None:
                return never
            same = F.lit(True)
            for x, y in zip(t.keys, keys):
                same = same & (x == F.lit(y))
            return same
    return a.value == b.value


def boolean(col: Column, const: bool | None = None, names=(), proves=()) -> Term:
    return Term(col, BOOLEAN_T, const=const, names=names, proves=proves)


def string(col: Column, lang: str | None = None) -> Term:
    return Term(col, tm.literal_type(lang=lang))


def term(value) -> Term:
    """A Term from a Term or a Python constant."""
    if isinstance(value, Term):
        return value
    if isinstance(value, Column):
        raise TypeError("wrap a raw Column with fn.raw(column, datatype)")
    col, rdf_type = tm.python_literal(value)
    const = value.value if isinstance(value, tm.Lit) else (str(value) if isinstance(value, IRI) else value)
    return Term(col, rdf_type, const=const)


class Row:
    """What an expression sees: ``r.name`` or ``r["name"]`` is the Term of a variable."""

    def __init__(self, lookup: Callable[[str], Term]):
        self._lookup = lookup

    def __getitem__(self, name: str) -> Term:
        return self._lookup(name.lstrip("?"))

    def __getattr__(self, name: str) -> Term:
        if name.startswith("__"):
            raise AttributeError(name)
        return self._lookup(name)


def unbound(rdf_type: RdfType = MIXED_T) -> Term:
    if rdf_type.kind == "mixed":
        return Term(F.lit(None).cast(tm.MIXED), MIXED_T)
    spark = tm.spark_type_of(rdf_type.dt) if rdf_type.kind == "literal" else "string"
    return Term(F.lit(None).cast(spark), rdf_type)


__all__ = ["Term", "Row", "term", "boolean", "string", "unbound", "IRI_T"]
