"""Registration of queries with their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.plans.mapping import Tables
from kgspark.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# The prefix of the sample graph's IRIs, for use in SQL checks.
X = "http://example.org/tpch/"
XSD = "http://www.w3.org/2001/XMLSchema#"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def finish(df: DataFrame) -> DataFrame:
    """Column types both sides agree on: whole numbers BIGINT, other decimals DOUBLE, times text."""
    casts = {}
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        whole = isinstance(f.dataType, T.DecimalType) and f.dataType.scale == 0
        if whole or isinstance(f.dataType, T.IntegralType) and not isinstance(f.dataType, T.LongType):
            casts[f.name] = c.cast("bigint")
        elif isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            casts[f.name] = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            casts[f.name] = c.cast("string")
        elif isinstance(f.dataType, T.TimestampType):
            casts[f.name] = F.translate(c.cast("string"), " ", "T")
    return df.withColumns(casts) if casts else df


def query(name: str, sql: str | None = None):
    def wrap(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            out = build(spark, sf_dir)
            return finish(out if isinstance(out, DataFrame) else out.df)
        run.__name__, run.__doc__ = name, build.__doc__
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build
    return wrap


_TABLES: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The tables of a folder, resolved once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _TABLES:
        _TABLES[key] = Tables(spark, sf_dir)
    return _TABLES[key]


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables(spark, sf_dir).frame(name)
