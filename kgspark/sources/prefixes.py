"""Prefix declarations in text, and prefixed names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.terms import enc

# A declaration as the Turtle and SPARQL grammars have it, at the start of a line: a keyword, with or without
# at-sign; for a prefix its name, which may hold - and . inside, and a colon; the IRI; and a full stop.
_NAME = r"[\p{L}\p{N}_](?:[\p{L}\p{M}\p{N}_.·-]*[\p{L}\p{M}\p{N}_·-])?"
_IRI = r"<([^\x00-\x20<>\"{}|^`\\]*)>"
_DECLARED = rf"(?imu)^[ \t]*(@?)(?:prefix\s+((?:{_NAME})?)\s*:|base)\s*{_IRI}[ \t]*(\.?)"


def extract_prefixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, prefix, iri) of every document, under ``base`` for a base IRI.

    Of declarations of one name those with an at-sign, which need a full stop, come before those
    without; among the first the last counts, among the others the first.
    """
    found = F.regexp_extract_all(F.col(text_col), F.lit(_DECLARED), F.lit(0))

    def part(whole: Column, group: int) -> Column:
        return F.regexp_extract(whole, _DECLARED, group)

    def entry(whole: Column, at: Column) -> Column:
        marked = part(whole, 1) == "@"
        is_base = F.rlike(whole, F.lit(r"(?i)^[ \t]*@?base"))
        rank = F.struct(F.when(marked, 0).otherwise(1).alias("form"), F.when(marked, -at).otherwise(at).alias("at"))
        return F.when(~marked | (part(whole, 4) == "."), F.struct(
            F.when(is_base, F.lit("base")).otherwise(part(whole, 2)).alias("prefix"), part(whole, 3).alias("iri"), rank.alias("rank")))

    return (docs.select(F.col(id_col), F.explode(F.transform(found, entry)).alias("e")).where("e IS NOT NULL")
            .groupBy(id_col, F.col("e.prefix").alias("prefix"))
            .agg(F.min_by("e.iri", "e.rank").alias("iri")))


def compact_iri(col: Column, prefixes: dict[str, str]) -> Column:
    """First matching prefix, else ``<#fragment>``, else the IRI itself."""
    out = None
    for prefix, ns in prefixes.items():
        short = F.concat(F.lit(f"{prefix}:"), F.substr(col, F.lit(len(ns) + 1)))
        hit = F.startswith(col, F.lit(ns))
        out = F.when(hit, short) if out is None else out.when(hit, short)
    fragment = F.concat(F.lit("<#"), F.substring_index(col, "#", -1), F.lit(">"))
    has = F.contains(col, F.lit("#"))
    out = F.when(has, fragment) if out is None else out.when(has, fragment)
    return F.when(col == "", col).otherwise(out.otherwise(col))


def expand_curie(col: Column, prefixes: dict[str, str]) -> Column:
    """``<iri>`` or ``prefix:local`` as a full IRI; anything else stays."""
    prefix = F.substring_index(col, ":", 1)
    local = F.substr(col, F.length(prefix) + 2)
    out = F.when(col.rlike("(?s)^<.*>$"), F.substr(col, F.lit(2), F.length(col) - 2))
    for name, ns in prefixes.items():
        if name:
            out = out.when(F.contains(col, F.lit(":")) & (prefix == name), F.concat(F.lit(ns), local))
    return out.otherwise(col)


def map_id(col: Column) -> Column:
    """Fragment of a table's triples map: ``#`` and the percent-encoded full name."""
    return F.when(F.coalesce(col, F.lit("")) == "", F.lit("#Map")).otherwise(F.concat(F.lit("#"), enc(col)))
