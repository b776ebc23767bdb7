"""SPARQL functions as Spark expressions.

Every function takes and returns Terms (or Python constants), runs inside Spark's generated code
and gives NULL where SPARQL raises an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kgspark import terms as tm
from kgspark.plans.expr import Term, boolean, string, term
from kgspark.terms import BNODE_T, INTEGER_T, IRI_T, MIXED_T, STRING_T, XSD


def raw(col: Column, dt: str = XSD.string) -> Term:
    """A Spark column as a literal of the given datatype."""
    return Term(col, tm.literal_type(dt))


def _integer(col: Column) -> Term:
    return Term(col.cast("bigint"), INTEGER_T)


def _like(t: Term, col: Column) -> Term:
    """String result that keeps the argument's language tag."""
    return string(col, t.type.lang)


# ---- terms ---------------------------------------------------------------------------------

def str(t) -> Term:  # noqa: A001
    t = term(t)
    return string(t.text)


def datatype(t) -> Term:
    t = term(t)
    if t.type.kind == "mixed":
        iri = F.when(t.value["lang"] != "", F.lit(tm.RDF.langString)).otherwise(t.value["dt"])
        return Term(F.when(t.value["kind"] == "literal", iri), IRI_T)
    if t.type.kind != "literal":
        return Term(F.lit(None).cast("string"), IRI_T, const="")
    dt = tm.RDF.langString if t.type.lang else t.type.dt
    return Term(F.when(t.bound, F.lit("" + dt)), IRI_T, const="" + dt)


def _kind_test(t, kind: str) -> Term:  # type: ignore[valid-type]
    t = term(t)
    if t.type.kind == "mixed":
        return boolean(t.value["kind"] == kind)
    same = t.type.kind == kind
    return boolean(F.when(t.bound, F.lit(same)), None if same else False)


def is_iri(t) -> Term:
    return _kind_test(t, "iri")


is_uri = is_iri


def is_literal(t) -> Term:
    return _kind_test(t, "literal")


def is_blank(t) -> Term:
    return _kind_test(t, "bnode")


def is_numeric(t) -> Term:
    t = term(t)
    if t.type.kind == "mixed":
        return boolean(t.value["dt"].isin(sorted(tm.NUMERIC_DTS)))
    return boolean(F.when(t.bound, F.lit(t.is_numeric)), None if t.is_numeric else False)


def lang(t) -> Term:
    t = term(t)
    if t.type.kind == "mixed":
        return string(F.when(t.value["kind"] == "literal", t.value["lang"]))
    if t.type.kind != "literal":
        return string(F.lit(None).cast("string"))
    return string(t.lang_column())


def lang_matches(tag, range_) -> Term:
    tag, range_ = term(tag).value, term(range_).value
    low, want = F.lower(tag), F.lower(range_)
    prefix = F.startswith(low, F.concat(want, F.lit("-")))
    return boolean(F.when(range_ == "*", F.length(tag) > 0).otherwise((low == want) | prefix))


def bound(t) -> Term:
    t = term(t)
    return boolean(t.bound, proves=t.names)


def same_term(a, b) -> Term:
    a, b = term(a), term(b)
    if a.type == b.type and a.type.kind != "mixed":
        return boolean((a == b).value)
    if "mixed" not in (a.type.kind, b.type.kind):
        return boolean(F.when(a.bound & b.bound, F.lit(False)))
    return boolean(a.as_mixed() == b.as_mixed())


def iri(t, base: "str | None" = None) -> Term:  # type: ignore[valid-type]
    """IRI from text; a relative one is put behind ``base``."""
    t = term(t)
    text = t.text
    if base:
        text = F.when(text.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), text).otherwise(F.concat(F.lit("" + base), text))
    return Term(text, IRI_T)


uri = iri


def bnode(label=None, row=()) -> Term:
    """A fresh blank node, or one fixed by a label and the terms that identify the row."""
    if label is None:
        return Term(F.concat(F.lit("b"), F.replace(F.uuid(), F.lit("-"), F.lit(""))), BNODE_T, stable=False)
    parts = [F.coalesce(term(x).text, F.lit("")) for x in (label, *row)]
    return Term(F.concat(F.lit("b"), F.md5(F.to_json(F.array(*parts)))), BNODE_T)


def strdt(t, dt: "str") -> Term:  # type: ignore[valid-type]
    text = term(t).as_string()
    target = tm.spark_type_of(dt)
    return Term(text if target == "string" else text.try_cast(target), tm.literal_type(dt))


def strlang(t, tag: "str") -> Term:  # type: ignore[valid-type]
    return string(term(t).as_string(), tag)


# ---- logic ---------------------------------------------------------------------------------

def is_in(t, *options) -> Term:
    t = term(t)
    out = t == options[0]
    for o in options[1:]:
        out = out | (t == o)
    return out


def not_in(t, *options) -> Term:
    return ~is_in(t, *options)


def _common(terms: list[Term]) -> tuple[list[Column], tm.RdfType]:
    kinds = {t.type for t in terms}
    if len(kinds) == 1:
        return [t.value for t in terms], terms[0].type
    return [t.as_mixed() for t in terms], MIXED_T


def if_(cond, then, otherwise) -> Term:
    cond, (cols, out) = term(cond).truth(), _common([term(then), term(otherwise)])
    return Term(F.when(cond, cols[0]).when(~cond, cols[1]), out)


def coalesce(*options) -> Term:
    cols, out = _common([term(t) for t in options])
    return Term(F.coalesce(*cols), out)


# ---- strings -------------------------------------------------------------------------------

def strlen(t) -> Term:
    return _integer(F.length(term(t).as_string()))


def substr(t, start, length=None) -> Term:
    """1-based. A start before 1 still counts towards the length."""
    t, start = term(t), term(start).value
    text = t.as_string()
    first = F.greatest(start, F.lit(1))
    if length is None:
        return _like(t, F.substr(text, first.cast("int")))
    end = start + term(length).value
    return _like(t, F.substr(text, first.cast("int"), F.greatest(end - first, F.lit(0)).cast("int")))


# Characters whose upper case is several, and the single ones that stand for them where there are such.
_SEVERAL = [c for c in map(chr, range(0x80, 0x10000)) if not 0xD800 <= ord(c) < 0xE000 and len(c.upper()) > 1]
_SINGLE = ["ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in _SEVERAL]


def ucase(t, *, simple: bool = False) -> Term:
    """Upper case, by Unicode's full mapping (ß: SS); ``simple`` gives each character one (ß: ẞ) and keeps those without."""
    s = term(t).as_string()
    full = F.upper(s)
    if not simple:
        return _like(term(t), full)

    def one(c: Column) -> Column:
        c = F.translate(c, "".join(_SEVERAL), "".join(_SINGLE))
        return F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)

    apart = F.array_join(F.transform(F.split(s, ""), one), "")
    return _like(term(t), F.when(F.length(full) == F.length(s), full).otherwise(apart))


def lcase(t, *, simple: bool = False) -> Term:
    """Lower case, by Unicode's full mapping (Σ at a word's end: ς); ``simple`` gives each character one by itself (Σ: σ, İ: i)."""
    s = term(t).as_string()
    return _like(term(t), F.lower(F.translate(s, "İΣ", "iσ") if simple else s))


def strstarts(t, prefix) -> Term:
    return boolean(F.startswith(term(t).as_string(), term(prefix).as_string()))


def strends(t, suffix) -> Term:
    return boolean(F.endswith(term(t).as_string(), term(suffix).as_string()))


def contains(t, part) -> Term:
    return boolean(F.contains(term(t).as_string(), term(part).as_string()))


def strbefore(t, part) -> Term:
    t = term(t)
    text, part = t.as_string(), term(part).as_string()
    at = F.instr(text, part)
    return _like(t, F.when(at > 0, F.substr(text, F.lit(1), at - 1)).when(at == 0, F.lit("")))


def strafter(t, part) -> Term:
    t = term(t)
    text, part = t.as_string(), term(part).as_string()
    at = F.instr(text, part)
    return _like(t, F.when(at > 0, F.substr(text, at + F.length(part))).when(at == 0, F.lit("")))


def encode_for_uri(t) -> Term:
    return string(tm.enc(term(t).as_string()))


def concat(*parts) -> Term:
    parts = [term(p) for p in parts]
    tags = {p.type.lang for p in parts}
    return string(F.concat(*[p.as_string() for p in parts]), tags.pop() if len(tags) == 1 else None)


def _pattern(pattern, flags: "str") -> Column:  # type: ignore[valid-type]
    """A pattern, constant or a term per row, with its flags, as Java reads it."""
    if set(flags) - set("ismxq"):
        raise ValueError(f"unknown regular-expression flags {flags!r}")
    java = "".join(f for f in flags if f in ("ismx" if "q" not in flags else "i"))
    mode = f"(?{java}{'u' if 'i' in java else ''})" if java else ""
    if not isinstance(pattern, Term):
        return F.lit(mode + (tm.java_quote(pattern) if "q" in flags else pattern))
    text = pattern.as_string()
    if "q" in flags:  # a quoted run ends at \\E, which is put outside of it
        text = F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.concat(F.lit(mode), text) if mode else text


def regex(t, pattern, flags: "str" = "") -> Term:  # type: ignore[valid-type]
    """``pattern`` is text, or a term: then it may differ from row to row. A malformed one fails the query."""
    return boolean(F.rlike(term(t).as_string(), _pattern(pattern, flags)))


def replace(t, pattern, replacement, flags: "str" = "") -> Term:  # type: ignore[valid-type]
    """``pattern`` and ``replacement`` are text or terms."""
    t = term(t)
    new = replacement.as_string() if isinstance(replacement, Term) else F.lit(replacement)
    if "q" in flags:
        new = F.replace(F.replace(new, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    return _like(t, F.regexp_replace(t.as_string(), _pattern(pattern, flags), new))


# ---- numbers -------------------------------------------------------------------------------

def abs(t) -> Term:  # noqa: A001
    t = term(t)
    x = t.number()
    return Term(F.when(x >= 0, x).otherwise(F.try_subtract(F.lit(0), x)), t.type if t.is_numeric else tm.literal_type(XSD.double))


def _whole(t: Term, col: Column) -> Term:
    if t.is_integer:
        return t
    if t.type.dt == XSD.decimal:
        return Term(col.cast("decimal(38,0)"), t.type)
    x = t.number()  # from 2^52 on every double is whole already
    return Term(F.when(F.abs(x) < 2.0**52, col.cast("double")).otherwise(x.cast("double")),
                t.type if t.is_numeric else tm.literal_type(XSD.double))


def round(t) -> Term:  # noqa: A001
    """Halves go up: -2.5 gives -2."""
    t = term(t)
    x = t.number()
    half = F.lit(0.5).cast("decimal(2,1)") if t.type.dt == XSD.decimal else F.lit(0.5)
    return _whole(t, F.floor(x + half))


def ceil(t) -> Term:
    t = term(t)
    return _whole(t, F.ceil(t.number()))


def floor(t) -> Term:
    t = term(t)
    return _whole(t, F.floor(t.number()))


def rand() -> Term:
    return Term(F.rand(), tm.literal_type(XSD.double), stable=False)


# ---- dates ---------------------------------------------------------------------------------

def now() -> Term:
    return Term(F.current_timestamp(), tm.literal_type(XSD.dateTime))


def _date_part(t, f: Callable, dts=("date", "dateTime")) -> Term:
    t = term(t)
    if tm.xsd_local(t.type.dt) not in dts:
        return _integer(F.lit(None))
    return _integer(f(t.value))


def year(t) -> Term:
    return _date_part(t, F.year)


def month(t) -> Term:
    return _date_part(t, F.month)


def day(t) -> Term:
    return _date_part(t, F.dayofmonth)


def hours(t) -> Term:
    return _date_part(t, F.hour, ("dateTime",))


def minutes(t) -> Term:
    return _date_part(t, F.minute, ("dateTime",))


def seconds(t) -> Term:
    """Seconds with their fraction."""
    t = term(t)
    if tm.xsd_local(t.type.dt) != "dateTime":
        return Term(F.lit(None).cast("decimal(8,6)"), tm.literal_type(XSD.decimal))
    return Term(F.extract(F.lit("SECOND"), t.value), tm.literal_type(XSD.decimal))


def tz(t, zoned: bool = True) -> Term:
    """Zone of an instant as text; instants are held in the session zone. Empty without a zone."""
    t = term(t)
    zone = F.date_format(t.value.cast("timestamp"), "XXX") if zoned else F.lit("")
    return string(F.when(t.bound, zone))


def timezone(t, zoned: bool = True) -> Term:
    """Zone of an instant as an xsd:dayTimeDuration."""
    text = tz(t, zoned).value
    hours_, minutes_ = F.substr(text, F.lit(2), F.lit(2)).cast("int"), F.substr(text, F.lit(5), F.lit(2)).cast("int")
    sign = F.when(F.startswith(text, F.lit("-")), F.lit("-PT")).otherwise(F.lit("PT"))
    span = F.concat(sign, F.when(hours_ > 0, F.concat(hours_.cast("string"), F.lit("H"))).otherwise(F.lit("")),
                    F.when(minutes_ > 0, F.concat(minutes_.cast("string"), F.lit("M"))).otherwise(F.lit("")))
    return Term(F.when(text == "Z", F.lit("PT0S")).when(text != "", span), tm.literal_type(XSD.dayTimeDuration))


# ---- hashes and identity -------------------------------------------------------------------

def md5(t) -> Term:
    return string(F.md5(term(t).as_string()))


def sha1(t) -> Term:
    return string(F.sha1(term(t).as_string()))


def sha256(t) -> Term:
    return string(F.sha2(term(t).as_string(), 256))


def sha384(t) -> Term:
    return string(F.sha2(term(t).as_string(), 384))


def sha512(t) -> Term:
    return string(F.sha2(term(t).as_string(), 512))


def uuid() -> Term:
    return Term(F.concat(F.lit("urn:uuid:"), F.uuid()), IRI_T, stable=False)


def struuid() -> Term:
    return Term(F.uuid(), STRING_T, stable=False)


# ---- casts ---------------------------------------------------------------------------------

def cast(t, dt: "str") -> Term:  # type: ignore[valid-type]
    """XSD constructor; a value that cannot be cast is unbound."""
    t = term(t)
    target = tm.spark_type_of(dt)
    out = tm.literal_type(dt)
    if target == "string":
        return Term(t.text, out)
    if t.type.kind == "mixed" or t.is_string:
        source = F.trim(t.as_string())
        if tm.xsd_local(dt) == "boolean":
            value = F.when(source.isin("true", "1"), F.lit(True)).when(source.isin("false", "0"), F.lit(False))
            return Term(value, out)
        if dt in tm.INTEGER_DTS:
            return Term(F.when(source.rlike(r"^[+-]?\d+$"), source.try_cast(target)), out)
        return Term(source.try_cast(target), out)
    if t.type.kind != "literal":
        return Term(F.lit(None).cast(target), out)
    if t.type.dt == XSD.dateTime and target == "date" or t.type.dt == XSD.date and target == "timestamp":
        return Term(t.value.cast(target), out)
    return Term(t.value.try_cast(target), out)


# ---- user functions ------------------------------------------------------------------------

_REGISTERED: dict = {}


def register(function_iri, build: Callable, dt=XSD.string) -> None:
    """Bind a function IRI to ``build(*columns) -> Column``."""
    _REGISTERED["" + function_iri] = (build, dt)


def call(function_iri, *args) -> Term:
    build, dt = _REGISTERED["" + function_iri]
    return Term(build(*[term(a).value for a in args]), tm.literal_type(dt))
