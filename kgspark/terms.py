"""RDF terms, their Spark types, and IRI templates.

An RDF variable is carried through a plan as one natively typed column (a number stays a
number, a date stays a date) or, for an IRI made by a template, as the template's key columns.
Text is built only where text is asked for.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from decimal import Decimal
from urllib.parse import quote, unquote

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class IRI(str):
    """An IRI constant."""

    def __repr__(self) -> str:
        return f"<{str(self)}>"


class Namespace(str):
    """``EX = Namespace("http://…/"); EX.name`` is ``IRI("http://…/name")``."""

    def __getattr__(self, name: str) -> IRI:
        if name.startswith("__"):
            raise AttributeError(name)
        return IRI(str(self) + name)

    def __getitem__(self, name) -> IRI:  # type: ignore[override]
        return IRI(str(self) + name) if isinstance(name, str) else str.__getitem__(self, name)


# Public W3C namespaces.
XSD = Namespace("http://www.w3.org/2001/XMLSchema#")
RDF_NS = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS_NS = "http://www.w3.org/2000/01/rdf-schema#"
OWL_NS = "http://www.w3.org/2002/07/owl#"
SKOS_NS = "http://www.w3.org/2004/02/skos/core#"
RR_NS = "http://www.w3.org/ns/r2rml#"
RDF, RDFS, OWL, SKOS, RR = (Namespace(n) for n in (RDF_NS, RDFS_NS, OWL_NS, SKOS_NS, RR_NS))

# A mixed variable (several RDF types) is one struct; '' stands for "no datatype / no tag" so
# that struct equality is term identity.
MIXED = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "value", "dt", "lang")])


@dataclass(frozen=True)
class RdfType:
    """Static type of a variable: kind is iri, bnode, literal or mixed."""

    kind: str
    dt: str | None = None
    lang: str | None = None

    def __str__(self) -> str:
        if self.kind != "literal":
            return self.kind
        if self.lang:
            return f"rdf:langString@{self.lang}"
        return self.dt.replace(str(XSD), "xsd:") if self.dt else "literal"


IRI_T = RdfType("iri")
BNODE_T = RdfType("bnode")
MIXED_T = RdfType("mixed")


def literal_type(dt: str = XSD.string, lang: str | None = None) -> RdfType:
    return RdfType("literal", None if lang else str(dt), lang)


STRING_T = literal_type()
BOOLEAN_T = literal_type(XSD.boolean)
INTEGER_T = literal_type(XSD.integer)


@dataclass(frozen=True)
class Lit:
    """A literal constant with an explicit datatype or language tag."""

    value: object
    dt: str | None = None
    lang: str | None = None


class NotUniquelyTyped(TypeError):
    """A projected variable may take several RDF types."""

    def __init__(self, var: str, types):
        self.var, self.types = var, sorted({str(t) for t in types})
        super().__init__(f"variable ?{var} is not uniquely typed: {', '.join(self.types)}")


# ---- XSD <-> Spark -------------------------------------------------------------------------

# The XML Schema datatypes and their Spark representation.
_SPARK_OF_XSD = {
    "string": "string", "normalizedString": "string", "token": "string", "language": "string",
    "anyURI": "string",
    "boolean": "boolean",
    "byte": "tinyint", "short": "smallint", "int": "int", "long": "bigint",
    "unsignedByte": "smallint", "unsignedShort": "int", "unsignedInt": "bigint",
    "unsignedLong": "decimal(20,0)",
    "integer": "bigint", "nonPositiveInteger": "bigint", "negativeInteger": "bigint",
    "nonNegativeInteger": "bigint", "positiveInteger": "bigint",
    "decimal": "decimal(38,10)",
    "float": "float", "double": "double",
    "date": "date", "dateTime": "timestamp",
    "time": "string", "gYear": "string", "gYearMonth": "string", "gMonthDay": "string",
    "gDay": "string", "gMonth": "string", "duration": "string",
    "hexBinary": "binary", "base64Binary": "binary",
}
# Lexical patterns of the XSD types that Spark holds as text.
_ZONE = r"(Z|[+-]\d{2}:\d{2})?"
_TEXT_PATTERNS = {
    "time": r"\d{2}:\d{2}:\d{2}(\.\d+)?" + _ZONE,
    "gYear": r"-?\d{4,}" + _ZONE,
    "gYearMonth": r"-?\d{4,}-\d{2}" + _ZONE,
    "gMonthDay": r"--\d{2}-\d{2}" + _ZONE,
    "gDay": r"---\d{2}" + _ZONE,
    "gMonth": r"--\d{2}" + _ZONE,
    "duration": r"-?P(?=.)(\d+Y)?(\d+M)?(\d+D)?(T(?=.)(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?",
}
_RANGES = {
    "nonPositiveInteger": lambda c: c <= 0,
    "negativeInteger": lambda c: c < 0,
    "nonNegativeInteger": lambda c: c >= 0,
    "positiveInteger": lambda c: c > 0,
    "unsignedByte": lambda c: c.between(0, 255),
    "unsignedShort": lambda c: c.between(0, 65535),
    "unsignedInt": lambda c: c.between(0, 4294967295),
    "unsignedLong": lambda c: c.between(0, 18446744073709551615),
}
INTEGER_LOCALS = {n for n, t in _SPARK_OF_XSD.items()
                  if t in ("tinyint", "smallint", "int", "bigint") or n == "unsignedLong"}
NUMERIC_DTS = frozenset(str(XSD) + n for n in INTEGER_LOCALS | {"decimal", "float", "double"})
INTEGER_DTS = frozenset(str(XSD) + n for n in INTEGER_LOCALS)


def xsd_local(dt: str | None) -> str | None:
    return dt[len(XSD):] if dt and dt.startswith(XSD) else None


def spark_type_of(dt: str | None) -> str:
    return _SPARK_OF_XSD.get(xsd_local(dt) or "", "string")


def xsd_of_spark(t: T.DataType) -> str:
    """Natural RDF datatype of a source column; anything untyped is a string."""
    if isinstance(t, T.BooleanType):
        return XSD.boolean
    if isinstance(t, T.IntegralType):
        return XSD.integer
    if isinstance(t, T.DecimalType):
        return XSD.decimal
    if isinstance(t, T.FloatType):
        return XSD.float
    if isinstance(t, T.DoubleType):
        return XSD.double
    if isinstance(t, T.DateType):
        return XSD.date
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return XSD.dateTime
    if isinstance(t, T.BinaryType):
        return XSD.hexBinary
    return XSD.string


def typed(col: Column, source: T.DataType, dt: str, decimal: str | None = None) -> Column:
    """Cast a source column to the Spark type of an XSD datatype; a bad value is NULL."""
    local = xsd_local(dt) or "string"
    target = spark_type_of(dt)
    if local == "decimal":
        if decimal:
            target = decimal
        elif isinstance(source, T.DecimalType):
            return col
    if local == "hexBinary":
        return col if isinstance(source, T.BinaryType) else F.unhex(col.cast("string"))
    if local == "base64Binary":
        return col if isinstance(source, T.BinaryType) else F.try_to_binary(col.cast("string"), F.lit("base64"))
    if local == "boolean" and isinstance(source, T.StringType):
        return F.when(col.isin("true", "1"), F.lit(True)).when(col.isin("false", "0"), F.lit(False))
    if source.simpleString() != target:
        col = lexical(col, source) if target == "string" else col.try_cast(target)
    if local in _RANGES:
        col = F.when(_RANGES[local](col), col)
    if local in _TEXT_PATTERNS:
        col = F.when(col.rlike("^" + _TEXT_PATTERNS[local] + "$"), col)
    return col


def lexical(col: Column, t: T.DataType | None = None, dt: str | None = None) -> Column:
    """Lexical form of a native value (timestamps with ``T``, booleans in lower case)."""
    local = xsd_local(dt)
    if local == "dateTime" or isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return F.translate(col.cast("string"), " ", "T")
    if local == "base64Binary":
        return F.base64(col)
    if local == "hexBinary" or isinstance(t, T.BinaryType):
        return F.hex(col)
    return col.cast("string")


def python_literal(value) -> tuple[Column, RdfType]:
    """Column and RDF type of a Python constant."""
    if isinstance(value, IRI):
        return F.lit(str(value)), IRI_T
    if isinstance(value, Lit):
        if value.lang:
            return F.lit(str(value.value)), literal_type(lang=value.lang)
        if value.dt is None:
            return python_literal(value.value)
        target = spark_type_of(value.dt)
        raw = value.value
        col = F.lit(raw if isinstance(raw, (bool, int, float, Decimal, dt.date)) else str(raw))
        return (col if target == "string" and isinstance(raw, str) else col.cast(target)), literal_type(value.dt)
    if isinstance(value, bool):
        return F.lit(value), BOOLEAN_T
    if isinstance(value, int):
        return F.lit(value).cast("bigint"), INTEGER_T
    if isinstance(value, float):
        return F.lit(value), literal_type(XSD.double)
    if isinstance(value, Decimal):
        return F.lit(value), literal_type(XSD.decimal)
    if isinstance(value, dt.datetime):
        return F.lit(value), literal_type(XSD.dateTime)
    if isinstance(value, dt.date):
        return F.lit(value), literal_type(XSD.date)
    if isinstance(value, str):
        return F.lit(value), STRING_T
    raise TypeError(f"no RDF term for {value!r}")


# ---- IRI templates -------------------------------------------------------------------------

def enc(col: Column) -> Column:
    """IRI-safe percent encoding: UTF-8, upper-case hex, RFC 3986 unreserved kept."""
    out = F.url_encode(col.cast("string"))
    for java, rfc in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(java), F.lit(rfc))
    return out


_SLOT = re.compile(r"\{((?:[^{}\\]|\\.)+)\}")
_SAFE = r"((?:[A-Za-z0-9\-._~]|%[0-9A-Fa-f]{2})+)"
_UNRESERVED = re.compile(r"^[A-Za-z0-9\-._~%]*$")


@dataclass(frozen=True)
class Template:
    """``http://…/order/{o_orderkey}``: literal parts around column slots."""

    text: str

    @property
    def parts(self) -> tuple[str, ...]:
        """The literal parts; two templates with the same parts build the same IRIs."""
        return tuple(re.sub(r"\\(.)", r"\1", p) for p in _SLOT.split(self.text)[::2])

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(re.sub(r"\\(.)", r"\1", c) for c in _SLOT.findall(self.text))

    @property
    def injective(self) -> bool:
        """Every inner separator holds a character no encoded value can hold."""
        inner = self.parts[1:-1]
        return bool(self.columns) and all(p and not _UNRESERVED.match(p) for p in inner)

    def render(self, keys: list[Column], families) -> Column:
        pieces: list[Column] = []
        for i, literal in enumerate(self.parts):
            if literal:
                pieces.append(F.lit(literal))
            if i < len(keys):
                pieces.append(keys[i].cast("string") if families[i] == "long" else enc(keys[i]))
        return F.concat(*pieces)

    def render_text(self, keys: list[Column]) -> Column:
        """The template as a plain string (a literal object): values are not encoded."""
        pieces: list[Column] = []
        for i, literal in enumerate(self.parts):
            if literal:
                pieces.append(F.lit(literal))
            if i < len(keys):
                pieces.append(keys[i])
        return F.concat(*pieces)

    def invert(self, iri: str, families) -> tuple | None:
        """Key values that build ``iri``, or None when no key can."""
        pattern = _SAFE.join(re.escape(p) for p in self.parts)
        m = re.fullmatch(pattern, iri)
        if not m:
            return None
        keys = []
        for text, family in zip(m.groups(), families):
            value = unquote(text)
            if quote(value, safe="") != text:
                return None
            if family == "long":
                if not re.fullmatch(r"-?\d{1,19}", value) or str(int(value)) != value:
                    return None
                keys.append(int(value))
            else:
                keys.append(value)
        return tuple(keys)

    def parse(self, iri: Column, families) -> list[Column]:
        """Key columns of IRI text; NULL keys where no key builds the IRI."""
        pattern = "^" + _SAFE.join(java_quote(p) for p in self.parts) + "$"
        keys = []
        for i, family in enumerate(families, 1):
            text = F.url_decode(F.regexp_extract(iri, pattern, i))
            keys.append(text.try_cast("bigint") if family == "long" else text)
        same = iri.rlike(pattern) & (self.render(keys, families) == iri)
        return [F.when(same, k) for k in keys]

    def may_unify(self, other: "Template") -> bool:
        """False only when no IRI can be built by both templates."""
        if self.parts == other.parts:
            return True
        # Encoded values hold no reserved character, so the reserved skeletons must agree.
        if _reserved(self.parts) != _reserved(other.parts):
            return False
        a, b = self.parts[0], other.parts[0]
        if not (a.startswith(b) or b.startswith(a)):
            return False
        a, b = self.parts[-1], other.parts[-1]
        return a.endswith(b) or b.endswith(a)


def java_quote(text: str) -> str:
    """Text as a pattern that matches itself."""
    return re.sub(r"([\\.\[\]{}()*+?^$|#\s-])", r"\\\1", text)


def _reserved(parts: tuple[str, ...]) -> str:
    return "".join(ch for ch in "".join(parts) if not _UNRESERVED.match(ch))


def key_family(t: T.DataType) -> str:
    return "long" if isinstance(t, T.IntegralType) else "string"


def key_column(col: Column, t: T.DataType) -> Column:
    """A key column in join form: whole numbers as BIGINT, anything else as text."""
    if isinstance(t, T.IntegralType):
        return col.cast("bigint") if not isinstance(t, T.LongType) else col
    return col if isinstance(t, T.StringType) else lexical(col, t)
