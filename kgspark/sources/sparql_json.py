"""SPARQL Results JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.terms import XSD


def binding_json(bindings) -> DataFrame:
    """One binding object per solution; an unbound variable is left out."""
    from kgspark.plans.bindings import _project
    b = bindings.merged()
    fields = []
    for n in bindings.names:
        t = b.term(n)
        if t.type.kind == "mixed":
            kind = t.value["kind"]
            term_type = F.when(kind == "iri", F.lit("uri")).otherwise(kind)
            dt, tag = F.nullif(t.value["dt"], F.lit("")), F.nullif(t.value["lang"], F.lit(""))
        else:
            term_type = F.lit("uri" if t.type.kind == "iri" else t.type.kind)
            dt = F.lit(str(t.type.dt)) if t.type.dt else F.lit(None).cast("string")
            tag = F.lit(t.type.lang) if t.type.lang else F.lit(None).cast("string")
        cell = F.struct(term_type.alias("type"), t.text.alias("value"), dt.alias("datatype"), tag.alias("xml:lang"))
        fields.append(F.when(t.bound, cell).alias(n))
    return _project(b, {"json": F.to_json(F.struct(*fields))})


def write_results(bindings, path: str) -> None:
    """``path/head``: the head object; ``path/bindings``: one binding object per line."""
    head = json.dumps({"vars": list(bindings.names)})
    bindings.spark.createDataFrame([(head,)], "value string").coalesce(1).write.text(f"{path}/head")
    binding_json(bindings).write.text(f"{path}/bindings")


def untyped_binding_json(rows: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Binding objects of any table; a column without a type is a plain literal.

    ``types``: column -> ``IRI``, ``xsd:…`` or a datatype IRI.
    """
    fields = []
    for n in rows.columns:
        kind = (types or {}).get(n, "")
        dt = str(XSD) + kind[4:] if kind.startswith("xsd:") else (kind if kind.startswith("http") else None)
        cell = F.struct(F.lit("uri" if kind.upper() == "IRI" else "literal").alias("type"),
                        F.col(f"`{n}`").cast("string").alias("value"), F.lit(dt).cast("string").alias("datatype"))
        fields.append(F.when(F.col(f"`{n}`").isNotNull(), cell).alias(n))
    return rows.select(F.to_json(F.struct(*fields)).alias("json"))
