"""Transitive closure as rounds of joins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.operators.cycles import strong_components
from kgspark.session import materialize

GROWTH = 32  # pairs per edge from which cycles are looked for


def closure(edges: DataFrame, reflexive: bool = False, max_depth: int | None = None,
            sources: DataFrame | None = None) -> DataFrame:
    """All (src, dst) pairs joined by one or more edges; cycles are allowed.

    Each round's new pairs are written to the session's shared folder, so a lost executor repeats
    one round at most and the plan does not grow. ``sources`` (column ``src``) limits the start
    nodes; ``max_depth`` the number of steps; ``reflexive`` adds every node with itself.
    """
    edges = materialize(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    known = _every(edges, max_depth) if sources is None else _walk(edges, sources, max_depth)
    if reflexive:
        if sources is None:
            nodes = edges.select(F.explode(F.array("src", "dst")).alias("src")).distinct()
        else:
            nodes = sources.select("src").distinct()
        known = known.where(F.col("src") != F.col("dst")).union(nodes.select("src", F.col("src").alias("dst")))
    return known


def _every(edges: DataFrame, max_depth: int | None) -> DataFrame:
    """All pairs. Few pairs are found as they are; where they become many, cycles are made one node each
    first, and each pair of components stands for the pairs of their nodes, which are made last."""
    known, reach = edges.withColumn("d", F.lit(1).cast("bigint")), 1
    most = None if max_depth is not None else GROWTH * edges.count()
    known, reach, whole = _doubling(known, reach, max_depth, most)
    if not whole:
        parts = strong_components(edges)
        if parts.isEmpty():
            known, reach, _ = _doubling(known, reach, None, None)
        else:
            pairs, _ = _condensed(edges, parts)
            first = parts.select(F.col("root").alias("src"), F.col("node").alias("a"))
            last = parts.select(F.col("root").alias("dst"), F.col("node").alias("b"))
            return pairs.join(first, "src", "left").join(last, "dst", "left").select(
                F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst"))
    return known.select("src", "dst")


def _condensed(edges: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs of the graph whose nodes are the roots of components and the nodes on no cycle; and its edges."""
    first = parts.select(F.col("node").alias("src"), F.col("root").alias("a"))
    last = parts.select(F.col("node").alias("dst"), F.col("root").alias("b"))
    links = materialize(edges.join(first, "src", "left").join(last, "dst", "left").select(
        F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst")).distinct())
    known, _, _ = _doubling(links.where("src <> dst").withColumn("d", F.lit(1).cast("bigint")), 1, None, None)
    return materialize(known.select("src", "dst").union(links.where("src = dst"))), links


def reach_counts(edges: DataFrame) -> DataFrame:
    """(node, reached): how many nodes one or more edges lead to, for every node of an edge.

    Counts come from the sizes of components, so that the pairs of the nodes of a cycle are never made: the rows that
    are written are the pairs of the condensed graph. Repeated edges count once; edges with a null end are left out.
    """
    edges = materialize(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    parts = strong_components(edges)
    pairs, _ = _condensed(edges, parts)
    size = parts.groupBy("root").agg(F.count("*").alias("size"))
    to = pairs.join(size.withColumnRenamed("root", "dst"), "dst", "left").fillna(1, ["size"])
    reached = to.groupBy("src").agg(F.sum("size").alias("reached"))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(parts, "node", "left")
    return (nodes.select("node", F.coalesce("root", "node").alias("src")).join(reached, "src", "left")
            .select("node", F.coalesce("reached", F.lit(0)).cast("bigint").alias("reached")))


def connected(edges: DataFrame, source: Callable[[Column], Column], target: Callable[[Column], Column]) -> tuple[bool, int]:
    """Whether one or more edges lead from a source to a target, and how many edges were followed.

    ``source`` and ``target`` are conditions on an end. Two frontiers walk towards each other, that with
    fewer new nodes first, and stop when a new node of one is known to the other, or when one has no new nodes.
    """
    edges = materialize(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())

    def hop(found: DataFrame, backward: bool) -> DataFrame:
        here, there = ("dst", "src") if backward else ("src", "dst")
        return edges.join(found.select(F.col("node").alias(here)), here, "left_semi").select(F.col(there).alias("node"))

    ahead = materialize(edges.where(source(F.col("src"))).select(F.col("dst").alias("node")))
    back = materialize(edges.where(target(F.col("dst"))).select(F.col("dst").alias("node")).distinct())
    followed = ahead.count()
    sides = [[ahead.distinct()], [back]]
    new = [materialize(ahead.distinct()), back]
    size = [new[0].count(), back.count()]
    if new[0].join(back, "node", "left_semi").limit(1).count():
        return True, followed
    while all(size):
        k = 0 if size[0] <= size[1] else 1
        step = materialize(hop(new[k], bool(k)))
        followed += step.count()
        seen = reduce(DataFrame.union, sides[k])
        new[k] = materialize(step.distinct().join(seen, "node", "left_anti"))
        size[k] = new[k].count()
        if size[k] and new[k].join(reduce(DataFrame.union, sides[1 - k]), "node", "left_semi").limit(1).count():
            return True, followed
        sides[k].append(new[k])
        if len(sides[k]) > 8:
            sides[k] = [materialize(reduce(DataFrame.union, sides[k]))]
    return False, followed


def _doubling(known: DataFrame, reach: int, max_depth: int | None, most: int | None) -> tuple[DataFrame, int, bool]:
    """All pairs, in a number of rounds that grows with the logarithm of the longest path; the reached distance; and
    whether that is all, or ``most`` pairs were passed.

    Pairs carry their distance. A pair up to twice as far apart as any known one is a pair at
    exactly the reached distance followed by a known pair, so it is met once per such middle node.
    """
    total = None
    while max_depth is None or reach < max_depth:
        first = known.where(F.col("d") == reach).select("src", F.col("dst").alias("mid"))
        second = known.select(F.col("src").alias("mid"), "dst", (F.col("d") + reach).alias("d"))
        if max_depth is not None:
            second = second.where(F.col("d") <= max_depth)
        step = first.join(second, "mid").groupBy("src", "dst").agg(F.min("d").alias("d"))
        delta = materialize(step.join(known, ["src", "dst"], "left_anti"))
        known, reach = known.union(delta), reach * 2
        if delta.where(F.col("d") == reach).isEmpty():
            break
        if most is not None:
            total = (known.count() if total is None else total + delta.count())
            if total > most:
                return known, reach, False
    return known, reach, True


def _walk(edges: DataFrame, sources: DataFrame, max_depth: int | None) -> DataFrame:
    """Pairs from some start nodes: one more edge per round, from the newest pairs only.

    What is known is kept in parts that are merged two by two, like digits that carry: there are as many as
    the logarithm of the rounds, and a pair is rewritten as often.
    """
    hop = edges.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    delta = materialize(edges.join(sources.select("src").distinct(), "src", "left_semi"))
    parts, depth = [(0, delta)], 1
    while max_depth is None or depth < max_depth:
        step = delta.join(hop, "dst").select("src", F.col("next").alias("dst")).distinct()
        delta = materialize(step.join(reduce(DataFrame.union, [p for _, p in parts]), ["src", "dst"], "left_anti"))
        if delta.isEmpty():
            break
        parts, depth = [*parts, (0, delta)], depth + 1
        while len(parts) > 1 and parts[-1][0] == parts[-2][0]:
            (rank, a), (_, b) = parts.pop(), parts.pop()
            parts.append((rank + 1, materialize(a.union(b))))
    return reduce(DataFrame.union, [p for _, p in parts])
