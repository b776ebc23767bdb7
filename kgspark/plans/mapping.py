"""Mapping specification: how the rows of a table become triples."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from kgspark.terms import IRI, Template


@dataclass(frozen=True)
class Source:
    """A logical table: a named table, or the result of a SQL query over named tables."""

    kind: str
    text: str
    uses: tuple[str, ...] = ()

    @classmethod
    def table(cls, name: str) -> "Source":
        return cls("table", name, (name,))

    @classmethod
    def sql(cls, text: str, uses=()) -> "Source":
        return cls("sql", text, tuple(uses))


class Tables:
    """Name → DataFrame: a dict of DataFrames, a Parquet folder, or the session catalog.

    A table is resolved once, so its files are listed and its schema read once.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | str | None = None):
        self.spark, self.tables = spark, tables
        self._loaded: dict[Source, DataFrame] = {}

    def frame(self, name: str) -> DataFrame:
        return self.load(Source.table(name))

    def load(self, source: Source) -> DataFrame:
        if source not in self._loaded:
            self._loaded[source] = self._query(source) if source.kind == "sql" else self._table(source.text)
        return self._loaded[source]

    def _table(self, name: str) -> DataFrame:
        if isinstance(self.tables, dict):
            return self.tables[name]
        if isinstance(self.tables, str):
            return self.spark.read.parquet(f"{self.tables}/{name}.parquet")
        return self.spark.table(name)

    def _query(self, source: Source) -> DataFrame:
        if self.tables is not None:
            for name in source.uses:  # the query is analysed at once, so views may be replaced later
                self.frame(name).createOrReplaceTempView(name)
        return self.spark.sql(source.text)


@dataclass(frozen=True)
class IriColumn:
    """A subject (or object) IRI held in a column."""

    column: str


@dataclass(frozen=True)
class ColumnObj:
    column: str
    dt: str | None = None
    lang: str | None = None
    decimal: str | None = None  # Spark type of an xsd:decimal, when not the source's own
    lang_column: str | None = None  # the column that holds each row's language; without one a plain string


@dataclass(frozen=True)
class TemplateObj:
    """An IRI; a literal where a datatype or a language is given."""

    template: Template
    dt: str | None = None
    lang: str | None = None

    def __init__(self, template: str | Template, dt: str | None = None, lang: str | None = None):
        object.__setattr__(self, "template", template if isinstance(template, Template) else Template(template))
        object.__setattr__(self, "dt", dt)
        object.__setattr__(self, "lang", lang)


@dataclass(frozen=True)
class ConstObj:
    value: object
    is_iri: bool = False
    dt: str | None = None
    lang: str | None = None


@dataclass(frozen=True)
class RefObj:
    """The subject of a parent map, reached by ``join`` pairs (child column, parent column).

    ``trusted``: every non-null child key is known to have a parent row, so no parent scan is
    needed when the parent's IRI is made of the join columns alone.
    """

    parent: str
    join: tuple[tuple[str, str], ...] = ()
    trusted: bool = False

    def __init__(self, parent: str, join=(), trusted: bool = False):
        object.__setattr__(self, "parent", parent)
        object.__setattr__(self, "join", tuple(
            (c.strip(), p.strip()) for c, p in join if c and p and c.strip() and p.strip()))
        object.__setattr__(self, "trusted", trusted)


ObjectMap = ColumnObj | TemplateObj | ConstObj | RefObj | IriColumn


@dataclass(frozen=True)
class TriplesMap:
    """One subject per row of ``source``; ``unique_key`` declares columns no two rows share.

    ``graph`` is the IRI of the named graph, or a template that makes it from the row.
    """

    id: str
    source: Source
    subject: Template | IriColumn
    classes: tuple[str, ...] = ()
    properties: tuple[tuple[str, ObjectMap], ...] = ()
    unique_key: tuple[str, ...] = ()
    graph: str | Template | None = None

    def __init__(self, id, source, subject, classes=(), properties=(), unique_key=(), graph=None):
        set_ = object.__setattr__
        set_(self, "id", id)
        set_(self, "source", Source.table(source) if isinstance(source, str) else source)
        set_(self, "subject", Template(subject) if isinstance(subject, str) else subject)
        set_(self, "classes", tuple(IRI(c) for c in classes))
        pairs = properties.items() if isinstance(properties, dict) else properties
        flat = [(IRI(p), o) for p, objs in pairs for o in (objs if isinstance(objs, (list, tuple)) else [objs])]
        set_(self, "properties", tuple(flat))
        set_(self, "unique_key", tuple(unique_key))
        set_(self, "graph", Template(graph) if isinstance(graph, str) and "{" in graph else graph)

    @property
    def key_proved(self) -> bool:
        """No two rows have the same subject."""
        if not self.unique_key:
            return False
        if isinstance(self.subject, IriColumn):
            return self.unique_key == (self.subject.column,)
        return self.subject.injective and set(self.unique_key) <= set(self.subject.columns)


@dataclass(frozen=True)
class Mapping:
    maps: tuple[TriplesMap, ...] = field(default_factory=tuple)

    def __init__(self, maps):
        object.__setattr__(self, "maps", tuple(maps))
        ids = [m.id for m in self.maps]
        if len(set(ids)) != len(ids):
            raise ValueError("two triples maps share an id")

    def by_id(self, map_id: str) -> TriplesMap:
        for m in self.maps:
            if m.id == map_id:
                return m
        raise KeyError(f"no triples map {map_id!r}")
