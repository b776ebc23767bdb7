"""Helpers the corpus operators share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import kgspark
from kgspark.session import configure, materialize, scratch_dir

__all__ = ["WORDS", "columns", "let", "materialize", "prepare", "rows_of", "scratch_dir", "text_map", "unused", "words"]

# What separates words: space and \t \n \v \f \r.
SEPARATORS = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"

# Rows go to Python in batches bounded by rows and by bytes, so that long texts do not pile up.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}

_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings, and the package itself on every executor (once per application)."""
    configure(spark)
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = os.path.dirname(os.path.abspath(kgspark.__file__))
        made = os.path.join(tempfile.mkdtemp(prefix="run-"), "kgspark_package.zip")
        with zipfile.ZipFile(made, "w") as z:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.join("kgspark", os.path.relpath(full, root)))
        sc.addPyFile(made)
        _SHIPPED.add(sc.applicationId)
    return spark


def columns(df: DataFrame, **named: str) -> DataFrame:
    """Only the named columns, under new names: ``columns(docs, id="doc_id", text="text")``."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in named.items()])


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text as an array; null and empty texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), SEPARATORS)
    return F.filter(parts, lambda w: w != "")


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """The rows of a batch as tuples of the named columns."""
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names))


def text_map(df: DataFrame, schema: str, make: Callable[[], Callable[[object, str], tuple | None]]) -> DataFrame:
    """One result row per row of ``df(id, text)``: ``make()`` gives, once per task, a function of (id, text).

    A null text is passed as the empty text. A result of None gives no row.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        each = make()
        for batch in batches:
            out = [r for i, t in rows_of(batch, "id", "text") if (r := each(i, "" if t is None else t)) is not None]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return df.mapInArrow(run, schema)
