"""Connected components of a large graph by stars, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import materialize


def _least(pairs: DataFrame) -> DataFrame:
    """Every pair (u, v) with the least of u and all its partners; a hot u is one row on the right side."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _state(pairs: DataFrame) -> tuple[int, int]:
    n, check = pairs.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    return n, int(check)


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for every node of an edge but the roots.

    ``edges`` has two bigint columns. Each round links the larger partners of every node to its least
    partner, and then the smaller ones; the rounds end when the links no longer change. Their number grows
    with the logarithm of the component size. Each round is written to the shared folder, so that a lost
    executor costs one round. Loops, repeats and both directions of an edge do no harm; edges with a null
    end are left out.
    """
    a, b = edges.columns
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        f"`{a}` IS NOT NULL AND `{b}` IS NOT NULL AND u <> v").distinct()
    pairs = materialize(pairs)
    state = _state(pairs)
    while state[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        starred = _least(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        small = (starred.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(starred.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        pairs, before = materialize(small), state
        state = _state(pairs)
        if state == before:
            break
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
