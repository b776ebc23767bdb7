"""Strongly connected components, so that a closure need not pair the nodes of its cycles.

Nodes that no cycle can pass are trimmed: those without an edge in or out. Chains, nodes with one edge in and one
out, are skipped by doubling, in rounds of the logarithm of their length; a cycle that is all chain is found
by that. In what is left, pairs of nodes not far apart are made by doubling. Where many are near each other both ways,
these short cycles are made one node each, and it starts again. Otherwise each node learns the greatest node that
reaches it and the greatest that it reaches, along those pairs and by jumping to what that node has learned. Nodes for
which both are the same node are its component. Then it goes on without the components found, and without edges
between nodes that learned different ones: these lead from one component to another. The order of nodes is that of
their hashes, so that cycles in a row or a tree fall into small parts, however they are numbered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.session import materialize

GROWTH = 32  # pairs per edge up to which the pairs of near nodes are made


def _trimmed(edges: DataFrame) -> DataFrame:
    """Without the edges of nodes that have no edge in or none out."""
    heads, tails = edges.select(F.col("src").alias("dst")).distinct(), edges.select(F.col("dst").alias("src")).distinct()
    return edges.join(heads, "dst", "left_semi").join(tails, "src", "left_semi").select("src", "dst")


def _chains(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(src, dst) with chains skipped; (node, start, end) of the nodes of chains between others; (node, root) of
    cycles that are all chain."""
    one_in = edges.groupBy("dst").agg(F.count("*").alias("n"), F.first("src").alias("before")).where("n = 1").select(F.col("dst").alias("node"), "before")
    one_out = edges.groupBy("src").agg(F.count("*").alias("n"), F.first("dst").alias("next")).where("n = 1").select(F.col("src").alias("node"), "next")
    chain = materialize(one_in.join(one_out, "node"))
    inside = chain.select(F.col("node").alias("next"), F.lit(True).alias("on"))
    # ``last``: the chain node reached so far; ``next``: what follows it; ``on``: whether that is of the chain.
    state = materialize(chain.select("node", "before", F.col("node").alias("last"), "next", F.col("node").alias("least"))
                        .join(inside, "next", "left").fillna(False, ["on"]))
    length, reach = state.where("on").count(), 1
    while reach <= length:
        ahead = state.select(F.col("node").alias("next"), F.col("last").alias("last2"), F.col("next").alias("next2"),
                             F.col("least").alias("least2"), F.col("on").alias("on2"))
        moving = state.where("on").join(ahead, "next").select(
            "node", "before", F.col("last2").alias("last"), F.col("next2").alias("next"), F.least("least", "least2").alias("least"), F.col("on2").alias("on"))
        state = materialize(state.where("NOT on").select("node", "before", "last", "next", "least", "on").union(moving))
        reach *= 2
        if state.where("on").isEmpty():
            break
    round_ = state.where("on").select("node", F.col("least").alias("root"))
    open_ = state.where("NOT on")
    first = open_.join(chain.select(F.col("node").alias("before")), "before", "left_anti").select("last", F.col("before").alias("start"))
    skipped = materialize(open_.join(first, "last").select("node", "start", F.col("next").alias("end")))
    gone = chain.select("node")
    rest = (edges.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
            .select("src", "dst").union(skipped.select(F.col("start").alias("src"), F.col("end").alias("dst"))))
    return rest.where("src <> dst").distinct(), skipped, materialize(round_)


def _coloured(edges: DataFrame) -> DataFrame:
    """(node, colour): the greatest node that reaches each node, itself included. Nodes are ordered by their hashes."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    colour = materialize(nodes.select("node", F.struct(F.xxhash64("node").alias("hash"), "node").alias("colour")))
    while True:
        along = edges.join(colour.withColumnRenamed("node", "src"), "src").select(
            F.col("dst").alias("node"), "colour", F.lit(None).cast(colour.schema["colour"].dataType).alias("before"))
        further = colour.select(F.col("node").alias("via"), F.col("colour").alias("further"))
        jump = colour.withColumn("via", F.col("colour.node")).join(further, "via").select(
            "node", F.col("further").alias("colour"), F.col("colour").alias("before"))
        after = materialize(jump.union(along).groupBy("node").agg(F.max("colour").alias("colour"), F.max("before").alias("before")))
        colour = after.select("node", "colour")
        if after.where("colour <> before").isEmpty():
            return colour.select("node", "colour.node").toDF("node", "colour")


def _near(edges: DataFrame, nodes: int) -> tuple[DataFrame, DataFrame, bool]:
    """Pairs of nodes not far apart, found by doubling; (node, root) of nodes that are near each other both ways, the
    greatest of them as root; and whether the pairs are all there are.

    Ends when an eighth of the nodes is on such cycles, or when a round would make more than ``GROWTH`` pairs an edge.
    """
    known, reach, most = materialize(edges.withColumn("d", F.lit(1).cast("bigint"))), 1, GROWTH * edges.count()
    whole = False
    while True:
        back = known.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        short = materialize(known.where("src <> dst").join(back, ["src", "dst"]).groupBy(F.col("src").alias("node"))
                            .agg(F.max("dst").alias("root")).withColumn("root", F.greatest("node", "root")))
        first = known.where(F.col("d") == reach).select("src", F.col("dst").alias("mid"))
        second = known.select(F.col("src").alias("mid"), "dst", (F.col("d") + reach).alias("d"))
        if whole or 8 * short.count() >= nodes:
            break
        made = (first.groupBy("mid").agg(F.count("*").alias("a")).join(second.groupBy("mid").agg(F.count("*").alias("b")), "mid")
                .agg(F.sum(F.col("a").cast("double") * F.col("b"))).first()[0] or 0)
        if made > most:
            break
        step = first.join(second, "mid").groupBy("src", "dst").agg(F.min("d").alias("d"))
        known, reach = materialize(known.union(step).groupBy("src", "dst").agg(F.min("d").alias("d"))), reach * 2
        whole = known.where(F.col("d") == reach).isEmpty()
    return known.where("src <> dst").select("src", "dst"), short, whole


def _merged(edges: DataFrame, short: DataFrame) -> DataFrame:
    """The edges with the nodes of short cycles replaced by their roots."""
    first = short.select(F.col("node").alias("src"), F.col("root").alias("a"))
    last = short.select(F.col("node").alias("dst"), F.col("root").alias("b"))
    return edges.join(first, "src", "left").join(last, "dst", "left").select(
        F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst")).where("src <> dst").distinct()


def _split(edges: DataFrame, near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, root) of the components whose greatest node is the greatest that reaches them and that they reach; and
    the edges left between nodes that agree on both. ``near``: pairs that shorten the ways along the edges."""
    before = _coloured(near).withColumnRenamed("colour", "a")
    after = _coloured(near.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumnRenamed("colour", "b")
    both = materialize(before.join(after, "node"))
    open_ = both.where("a <> b")
    within = (edges.join(open_.withColumnRenamed("node", "src"), "src").join(open_.withColumnRenamed("node", "dst"), ["dst", "a", "b"])
              .select("src", "dst"))
    return both.where("a = b").select("node", F.col("a").alias("root")), within


def _with_chains(known: DataFrame, chains: DataFrame) -> DataFrame:
    """With the nodes of chains: a chain is on a cycle if both of its ends are on the same one."""
    start = known.select(F.col("node").alias("start"), F.col("root").alias("a"))
    end = known.select(F.col("node").alias("end"), F.col("root").alias("b"))
    both = (chains.join(start, "start", "left").join(end, "end", "left")
            .select("node", F.coalesce("a", "start").alias("a"), F.coalesce("b", "end").alias("b")).where("a = b"))
    back = both.select(F.col("a").alias("node"), F.col("a").alias("root"))  # the node where a chain ends that began there
    return known.union(both.select("node", F.col("a").alias("root"))).union(back)


def _with_short(known: DataFrame, short: DataFrame) -> DataFrame:
    """With the nodes of short cycles, in the component of the node that stood for them."""
    stood = known.select(F.col("node").alias("root"), F.col("root").alias("a"))
    return known.union(short.join(stood, "root", "left").select("node", F.coalesce("a", "root").alias("root")))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes on cycles of two and more nodes; all nodes of a component have the same root, one of
    them. ``edges``: ``src`` and ``dst`` of an ordered type. Loops, repeated edges and null ends do not count.

    The rounds are the logarithm of the longest chain, and, where long branching cycles are left, their
    diameter less what near pairs and jumps save, a few times over. Each round is written to the shared folder.
    """
    left = materialize(_trimmed(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct()))
    found, undo = [left.select(F.col("src").alias("node"), F.col("src").alias("root")).limit(0)], []
    while not left.isEmpty():
        rest, chains, rounds = _chains(left)
        found.append(rounds)
        undo.append((_with_chains, chains))
        left = rest = materialize(_trimmed(rest))
        nodes = rest.select(F.explode(F.array("src", "dst")).alias("node")).distinct().count()
        if not nodes:
            break
        near, short, whole = _near(rest, nodes)
        if whole:
            found.append(short)
            break
        if 8 * short.count() >= nodes:
            undo.append((_with_short, short))
            left = materialize(_trimmed(materialize(_merged(rest, short))))
        else:
            roots, within = _split(rest, near)
            found.append(roots)
            left = materialize(_trimmed(materialize(within)))
    known = materialize(reduce(DataFrame.union, found))
    for add, nodes in reversed(undo):
        known = materialize(add(known, nodes).distinct())
    alone = known.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root")
    return materialize(known.join(alone, "root", "left_semi").select("node", "root"))
