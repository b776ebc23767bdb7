"""Joins of points with intervals, where no column need be equal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.session import materialize

LEAF_ROWS = 2_048  # rows of both sides for each range of values
MOST_BITS = 14  # of the number of a range
_LEVEL = 1 << 32


def _leaf(value: Column, bounds: list, bits: int) -> Column:
    """How many of the sorted bounds are at most the value, by halving."""
    if not bounds:
        return F.lit(0).cast("bigint")
    held = F.array(*[F.lit(b) for b in bounds])
    steps = F.array(*[F.lit(1 << k).cast("bigint") for k in reversed(range(bits))])
    return F.aggregate(steps, F.lit(0).cast("bigint"), lambda at, step: F.when(
        F.get(held, (at + step - 1).cast("int")) <= value, at + step).otherwise(at))


def _shift(value: Column, by: Column) -> Column:
    return F.call_function("shiftright", value, by)


def _above(leaf: Column, bits: int) -> Column:
    """The nodes of the tree over all ranges that hold a leaf, one on each level."""
    return F.transform(F.sequence(F.lit(0), F.lit(bits)), lambda level: level.cast("bigint") * _LEVEL + _shift(leaf, level))


def _cover(first: Column, last: Column, bits: int) -> Column:
    """The fewest nodes that hold exactly the leaves from first to last; no leaf is below two of them."""
    def step(acc: Column, level: Column) -> Column:
        number = level.cast("bigint") * _LEVEL
        none = F.array().cast("array<bigint>")
        i, j = acc["i"], acc["j"]
        left = (i <= j) & (i % 2 == 1)
        i2 = F.when(left, i + 1).otherwise(i)
        right = (i2 <= j) & (j % 2 == 0)
        j2 = F.when(right, j - 1).otherwise(j)
        nodes = F.concat(acc["nodes"], F.when(left, F.array(number + i)).otherwise(none), F.when(right, F.array(number + j)).otherwise(none))
        done = i2 > j2
        return F.struct(F.when(done, F.lit(_LEVEL)).otherwise(F.shiftright(i2, 1)).alias("i"),
                        F.when(done, F.lit(-1).cast("bigint")).otherwise(F.shiftright(j2, 1)).alias("j"), nodes.alias("nodes"))

    start = F.struct(first.cast("bigint").alias("i"), last.cast("bigint").alias("j"), F.array().cast("array<bigint>").alias("nodes"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(bits)), start, step)["nodes"]


def sides(points: DataFrame, intervals: DataFrame, point: Column, low: Column | None, high: Column | None) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column ``__node``: a point and an interval that may hold it share exactly one.

    Values are cut into ranges by the quantiles of a sample of at most 2^16 values; ranges are the leaves of a binary
    tree. A point goes to the nodes above its leaf, an interval to the few nodes that make it up, so that rows are
    copied as often as the logarithm of the number of ranges, however wide intervals are.
    """
    ends = {"__low": low, "__high": high}
    ends = {n: c for n, c in ends.items() if c is not None}
    left = materialize(points.withColumn("__point", point).where("__point IS NOT NULL"))
    right = materialize(intervals.withColumns(ends).where(" AND ".join(f"{n} IS NOT NULL" for n in ends)))
    rows = left.count() + right.count()
    bits = min(MOST_BITS, max(0, (rows // LEAF_ROWS).bit_length()))
    seen = left.select(F.col("__point").alias("v"))
    for n in ends:
        seen = seen.union(right.select(F.col(n).alias("v")))
    some = seen.orderBy(F.rand(1)).limit(4 << bits).agg(F.sort_array(F.collect_list("v")).alias("v")).first()["v"] if bits else []
    wanted = sorted({k * len(some) >> bits for k in range(1, 1 << bits)}) if some else []
    bounds = [some[k] for k in wanted]
    bounds = [b for k, b in enumerate(bounds) if k == 0 or b != bounds[k - 1]]
    first = _leaf(F.col("__low"), bounds, bits) if low is not None else F.lit(0)
    last = _leaf(F.col("__high"), bounds, bits) if high is not None else F.lit(len(bounds))
    return (left.withColumn("__node", F.explode(_above(_leaf(F.col("__point"), bounds, bits), bits))).drop("__point"),
            right.withColumn("__node", F.explode(_cover(first, last, bits))).drop(*ends))


def range_join(points: DataFrame, intervals: DataFrame, point: Column, on: Column, low: Column | None = None,
               high: Column | None = None) -> DataFrame:
    """Rows of both sides for which ``on`` is true, where it implies ``low <= point <= high`` (one end may be open).

    The columns of the two sides have different names. A null end or point meets nothing. One equi-join: a
    hot node is split by Spark like any other hot key.
    """
    left, right = sides(points, intervals, point, low, high)
    return left.join(right, "__node").where(on).drop("__node")
