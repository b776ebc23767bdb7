"""Operations on whole graphs held as triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.operators.closure import closure
from kgspark.session import materialize

_KEY = ["s", "p", "o"]
HOT_SPLITS = 256  # parts a hot label group is ranked in


def merge_triples(a: DataFrame, b: DataFrame) -> DataFrame:
    """All of ``a``, and of ``b`` the triples whose (s, p, o) text ``a`` does not have.

    Terms are compared by text alone; of several new triples with equal text one is kept.
    """
    cols = a.columns
    rest = [c for c in cols if c not in _KEY]
    new = b.select(*cols).groupBy(*_KEY).agg(F.min(F.struct(*rest)).alias("__t")) if rest else b.select(*cols).distinct()
    new = new.join(a.select(*_KEY).distinct(), _KEY, "left_anti")
    if rest:
        new = new.select(*[F.col(c) if c in _KEY else F.col(f"__t.{c}").alias(c) for c in cols])
    return a.union(new.select(*cols))


def rename_terms(triples: DataFrame, renames: DataFrame, object_predicates=None) -> DataFrame:
    """Rename nodes (``renames``: old, new) as subjects, and as objects of the given predicates.

    Only statements that can hold a renamed object are joined on the object.
    """
    cols = triples.columns
    table = renames.select("old", "new").where("old <> new").distinct()
    by_s = triples.join(table.withColumnRenamed("old", "s"), "s", "left")
    by_s = by_s.withColumn("s", F.coalesce("new", "s")).select(*cols)
    eligible = F.col("o_kind") != "literal"
    if object_predicates is not None:
        eligible = eligible & F.col("p").isin([str(p) for p in object_predicates])
    linked = by_s.where(eligible).join(table.withColumnRenamed("old", "o"), "o", "left")
    linked = linked.withColumn("o", F.coalesce("new", "o")).select(*cols)
    return linked.union(by_s.where(~eligible)).distinct()


def drop_nodes(triples: DataFrame, roots: DataFrame, links: bool = False) -> DataFrame:
    """Remove the statements of the root nodes (column ``node``) and of the blank nodes below them.

    ``links`` also removes the statements that point at a root.
    """
    roots = roots.select(F.col("node").alias("s")).distinct()
    below = triples.where("o_kind = 'bnode'").select(F.col("s").alias("src"), F.col("o").alias("dst"), "s_kind")
    start = below.join(roots.withColumnRenamed("s", "src"), "src", "left_semi")
    walk = start.union(below.where("s_kind = 'bnode'")).select("src", "dst").distinct()
    reached = closure(walk, sources=roots.withColumnRenamed("s", "src")).select(F.col("dst").alias("s"))
    dead = roots.union(reached).distinct()
    out = triples.join(dead, "s", "left_anti").select(*triples.columns)
    if links:
        out = out.join(roots.withColumnRenamed("s", "o"), "o", "left_anti").select(*triples.columns)
    return out


def normalize_bnodes(triples: DataFrame) -> DataFrame:
    """Strip chained ``b<n>_`` prefixes from blank-node labels; distinct nodes stay distinct.

    A label in use keeps its node. The other nodes that strip to it are numbered after the
    highest number already in use with it; a label with very many nodes is numbered in parts.
    """
    sides = F.array(F.struct(F.col("s_kind").alias("k"), F.col("s").alias("label")),
                    F.struct(F.col("o_kind").alias("k"), F.col("o").alias("label")))
    labels = (triples.select(F.explode(sides).alias("n")).where("n.k = 'bnode'")
              .select("n.label").distinct()
              .withColumn("base", F.regexp_replace("label", r"^(?:b\d+_)+", "")))
    labels = materialize(labels)
    numbered = F.regexp_extract("base", r"^(.*)_(\d{1,18})$", 1), F.regexp_extract("base", r"^(.*)_(\d{1,18})$", 2)
    taken = (labels.select(numbered[0].alias("base"), numbered[1].try_cast("bigint").alias("n"))
             .where("n IS NOT NULL").groupBy("base").agg(F.max("n").alias("highest")))
    natural = labels.where("label = base").select("base", F.lit(True).alias("used"))
    part = F.pmod(F.xxhash64("label"), F.lit(HOT_SPLITS)).cast("int")
    moved = labels.where("label <> base").withColumn("part", part)
    sizes = moved.groupBy("base", "part").agg(F.count("*").alias("size"))
    before = Window.partitionBy("base").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("base", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("base", "part").orderBy("label"))
    ranked = moved.withColumn("rank", within).join(offsets, ["base", "part"])
    ranked = ranked.join(natural, "base", "left").join(taken, "base", "left")
    at = F.col("rank") + F.col("offset") - F.when(F.col("used"), F.lit(0)).otherwise(F.lit(1))
    fresh = F.when(at == 0, F.col("base")).otherwise(
        F.concat_ws("_", "base", (at + F.coalesce("highest", F.lit(0))).cast("string")))
    names = ranked.select("label", fresh.alias("fresh"))
    cols, out = triples.columns, triples
    for side in ("s", "o"):
        is_node = F.col(f"{side}_kind") == "bnode"
        nodes = out.where(is_node).join(names.withColumnRenamed("label", side), side, "left")
        out = nodes.withColumn(side, F.coalesce("fresh", side)).select(*cols).union(out.where(~is_node).select(*cols))
    return out


def type_profile(triples: DataFrame, by: str = "p") -> DataFrame:
    """How many objects of each kind and datatype a predicate (or other column) has."""
    return triples.groupBy(by, "o_kind", "o_dt").agg(F.count("*").alias("n"))
