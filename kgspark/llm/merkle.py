"""A Merkle tree over the rows of a dataset, kept as tables, and folding of changed rows up to its root.

A leaf is the hash of a row's fields. The leaves of each tree stand in order; every 8 that follow each other
have a parent, up to one; the tops of all trees, in order of their names, have parents likewise, up to the root.
A parent keeps a copy of its hash state before each child: to fold a changed child it resumes the state
of that place, and takes in the replacement and what stands to its right only.

On Spark a tree is built in rounds. Blocks of 512 nodes that follow each other, whole subtrees of three levels,
are built each in one group, and their tops are the nodes of the next round, so there are as many rounds as the
logarithm of the rows to the base 512, and no group is larger. On the way down each block learns the way from
its top to the root once, for all its members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.llm.common import columns, materialize, prepare

FAN, DEPTH = 8, 3  # children of a parent; levels of a block
BLOCK = FAN ** DEPTH
ALL = ""  # the name of the tree of trees

NODES = "tree string, block bigint, level int, place bigint, digest string, children string"
_NODES = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("level", pa.int32()), ("place", pa.int64()),
                    ("digest", pa.string()), ("children", pa.string())])
WAYS = "tree string, block bigint, subroot string, lefts array<binary>, rights array<binary>"
_WAYS = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("subroot", pa.string()),
                   ("lefts", pa.list_(pa.binary())), ("rights", pa.list_(pa.binary()))])
PROVED = "id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
_PROVED = pa.schema([("id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
                     ("proof_sha256", pa.string()), ("folded_root", pa.string())])


class Parent:
    """The children's digests, as hex text; the state before each of them; the digest of all."""
    __slots__ = ("children", "states", "digest")

    def __init__(self, children: list[bytes]):
        state = hashlib.sha256()
        self.children, self.states = children, []
        for child in children:
            self.states.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest().encode()

    def fold(self, place: int, digest: bytes) -> bytes:
        """This parent's digest with another child at a place."""
        state = self.states[place].copy()
        state.update(b"".join((digest, *self.children[place + 1:])))
        return state.hexdigest().encode()

    def siblings(self, place: int) -> tuple[bytes, bytes]:
        return b"".join(self.children[:place]), b"".join(self.children[place + 1:])


def levels(digests: list[bytes], depth: int | None = None) -> list[list[Parent]]:
    """The parents of each level: so many levels, or as many as it takes to have one."""
    out = []
    while len(out) < depth if depth is not None else len(digests) > 1:
        out.append([Parent(digests[k:k + FAN]) for k in range(0, len(digests), FAN)])
        digests = [p.digest for p in out[-1]]
    return out


def _block(table: pa.Table) -> tuple[list[int], list[list[Parent]]]:
    """The order of a block's members, and its levels. A tree with several blocks has whole ones."""
    place = table.column("pos").to_pylist()
    order = sorted(range(len(place)), key=place.__getitem__)
    digest = table.column("digest").to_pylist()
    deep = DEPTH if table.column("n")[0].as_py() > BLOCK else None
    return order, levels([digest[k].encode() for k in order], deep)


def _build(table: pa.Table) -> pa.Table:
    """The nodes above the members of a block; a single member of a tree is its own top, on level 0."""
    _, above = _block(table)
    tree, block = table.column("tree")[0].as_py(), table.column("block")[0].as_py()
    rows = [(tree, block, k + 1, block * FAN ** (DEPTH - k - 1) + i, p.digest.decode(), b"".join(p.children).decode())
            for k, level in enumerate(above) for i, p in enumerate(level)]
    if not rows:
        rows = [(tree, block, 0, block, table.column("digest")[0].as_py(), None)]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _NODES)], schema=_NODES)


def leaf(*fields: Column) -> Column:
    """The hash of a row: each field as its number of bytes, a colon and its text, or ``-`` if null."""
    def coded(c: Column) -> Column:
        c = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[coded(c) for c in fields]).cast("binary"), 256)


def placed(nodes: DataFrame, *order: str) -> DataFrame:
    """The nodes with ``pos``, the place of each in its ``tree``, ``n``, the tree's number of nodes, and ``block``.

    Nodes are sorted by ranges and numbered within them; what each range holds of a tree gives the places
    where it begins, so that a tree that has most of the rows is sorted by all tasks. Rows equal in all columns of
    ``order`` are told apart by ``row``, which must be fixed: nodes are read from a written table.
    """
    keys = ["tree", *order, "row"]
    spread = nodes.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    spread = materialize(spread).withColumn("range", F.shiftright("at", 33))
    held = spread.groupBy("tree", "range").agg(F.min("at").alias("first"), F.count("*").alias("here"))
    by_tree = Window.partitionBy("tree")
    before = F.sum("here").over(by_tree.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    held = held.select("tree", "range", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("here").over(by_tree).alias("n"))
    pos = F.col("before") + F.col("at") - F.col("first")
    out = spread.join(held, ["tree", "range"]).withColumn("pos", pos).drop("at", "range", "first", "before", "row")
    return out.withColumn("block", F.floor(F.col("pos") / BLOCK))


@dataclass
class Trees:
    """Rounds of nodes, from the lowest to the one where each tree has a single block: (members, nodes above them)."""
    rounds: list[tuple[DataFrame, DataFrame]]
    tops: DataFrame  # tree, digest


def build(members: DataFrame) -> Trees:
    """The trees over ``members``, that have ``tree``, ``pos``, ``n``, ``block`` and ``digest``."""
    rounds = []
    while True:
        nodes = materialize(members.select("tree", "pos", "n", "block", "digest").groupBy("tree", "block").applyInArrow(_build, NODES))
        rounds.append((members, nodes))
        sizes = members.select("tree", F.ceil(F.col("n") / BLOCK).alias("n")).distinct()
        largest = members.agg(F.max("n")).first()[0] or 0
        highest = nodes.groupBy("tree", "block").agg(F.max("level").alias("highest"))
        tops = (nodes.join(highest, ["tree", "block"]).where(F.col("level") == F.col("highest"))
                .select("tree", F.col("block").alias("pos"), "digest"))
        if largest <= BLOCK:
            return Trees(rounds, tops.select("tree", "digest"))
        members = tops.join(sizes, "tree").withColumn("block", F.floor(F.col("pos") / BLOCK))


def _descend(members: DataFrame, ways: DataFrame) -> DataFrame:
    """The way of each member, from the ways of the tops of their blocks; a member is the top of block ``pos``."""
    def follow(mine: pa.Table, way: pa.Table) -> pa.Table:
        order, above = _block(mine)
        rows = []
        for up in way.to_pylist():
            for place in range(len(order)):
                steps, k = [], place
                for level in above:
                    steps.append(level[k // FAN].siblings(k % FAN))
                    k //= FAN
                pos = mine.column("pos")[order[place]].as_py()
                rows.append((up["tree"], pos, up["subroot"], [s[0] for s in steps] + up["lefts"], [s[1] for s in steps] + up["rights"]))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _WAYS)] if rows
                                    else [pa.array([], f.type) for f in _WAYS], schema=_WAYS)

    mine = members.select("tree", "pos", "n", "block", "digest")
    return mine.groupBy("tree", "block").cogroup(ways.groupBy("tree", "block")).applyInArrow(follow, WAYS)


def prove(docs: DataFrame, fields: Sequence[str], *, tree_col: str = "lang", id_col: str = "doc_id",
          changed: dict[str, Column] | None = None, where: Column | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """One row per row: id, ``leaf``, ``subroot`` and ``root`` of the rows as they are; ``proof_sha256``, the hash
    of the siblings on the way from the leaf to the root; ``folded_root``, the root that follows from that way and the
    leaf of the row with the columns in ``changed`` where ``where`` holds; ``verified``, whether it is the root. And the
    manifest: tables of nodes (``tree``, ``block``, ``level``, ``place``, ``digest``, ``children``), one a round.

    The trees are those of the values of ``tree_col``, null being one; names are null first, then by their bytes,
    and have a letter before them in the manifest (``-`` if null, else ``:``). Rows stand by id, null first, equal
    ids by their leaves; repeated rows are leaves of their own. Any field may be null; texts are hashed whole,
    by Spark. Other columns are ignored. An empty table has no root and gives no rows.
    """
    spark = prepare(docs.sparkSession)
    changed = changed or {}
    name = F.col(f"`{tree_col}`").cast("string")
    original = leaf(*[F.col(f"`{f}`") for f in fields])
    other = leaf(*[changed.get(f, F.col(f"`{f}`")) for f in fields])
    if where is not None:
        other = F.when(F.coalesce(where, F.lit(False)), other).otherwise(original)
    rows = materialize(docs.select(
        F.coalesce(F.concat(F.lit(":"), name), F.lit("-")).alias("tree"), F.col(f"`{id_col}`").cast("bigint").alias("id"),
        original.alias("digest"), other.alias("other"), F.monotonically_increasing_id().alias("row")))
    members = materialize(placed(rows, "id", "digest"))
    trees = build(members)
    named = materialize(trees.tops.select(F.lit(ALL).alias("tree"), F.col("tree").alias("name"), "digest",
                                          F.lit(0).cast("bigint").alias("row")))
    top = materialize(placed(named, "name"))
    forest = build(top)
    found = forest.tops.first()
    manifest = [nodes for _, nodes in (*trees.rounds, *forest.rounds)]
    if found is None:
        return spark.createDataFrame([], f"`{id_col}` bigint, {PROVED[len('id bigint, '):]}, verified boolean"), manifest
    root = found.digest
    nothing = F.array().cast("array<binary>")
    ways = forest.tops.select("tree", F.lit(0).cast("bigint").alias("block"), F.lit(None).cast("string").alias("subroot"),
                              nothing.alias("lefts"), nothing.alias("rights"))
    for nodes, _ in reversed(forest.rounds):
        ways = materialize(_descend(nodes, ways))
    # The members of the lowest round are the tops of the trees: each is the way of its tree's last block.
    ways = (top.select(F.col("pos").alias("block"), "name", "digest").join(ways.drop("subroot"), "block")
            .select(F.col("name").alias("tree"), F.lit(0).cast("bigint").alias("block"), F.col("digest").alias("subroot"), "lefts", "rights"))
    for nodes, _ in reversed(trees.rounds[1:]):
        ways = materialize(_descend(nodes, ways))

    def fold(mine: pa.Table, way: pa.Table) -> pa.Table:
        order, above = _block(mine)
        ids, leaves, others = (mine.column(c).to_pylist() for c in ("id", "digest", "other"))
        rows = []
        for up in way.to_pylist():
            # Above the block the state before the way's place is the same for all members.
            steps = [(hashlib.sha256(a), b) for a, b in zip(up["lefts"], up["rights"])]
            rest = b"".join(x for pair in zip(up["lefts"], up["rights"]) for x in pair)
            for place, row in enumerate(order):
                proof, digest, k = hashlib.sha256(), others[row].encode(), place
                for level in above:
                    parent, slot = level[k // FAN], k % FAN
                    proof.update(b"".join(parent.siblings(slot)))
                    digest = parent.fold(slot, digest)
                    k //= FAN
                proof.update(rest)
                for state, right in steps:
                    state = state.copy()
                    state.update(digest + right)
                    digest = state.hexdigest().encode()
                rows.append((ids[row], leaves[row], up["subroot"], root, proof.hexdigest(), digest.decode()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PROVED)] if rows
                                    else [pa.array([], f.type) for f in _PROVED], schema=_PROVED)

    out = members.groupBy("tree", "block").cogroup(ways.groupBy("tree", "block")).applyInArrow(fold, PROVED)
    return out.withColumn("verified", F.col("folded_root") == F.col("root")).withColumnRenamed("id", id_col), manifest
