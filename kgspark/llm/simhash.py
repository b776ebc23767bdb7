"""Near-duplicates by SimHash fingerprints, compared bit plane by bit plane.

* **Fingerprints.** A bit is set if it is set in over half of the hashes of the text's word shingles.
* **Candidates.** Different fingerprints meet in tables keyed by some of their bits. With ``radius + 2``
  blocks of bits and a table for each two blocks, two fingerprints within the radius agree in all bits
  of some table, so that no link is lost. For wide radii, where no such set of tables is small, tables of
  sampled bits are used instead, and the chance to meet grows with their number.
* **Comparison.** The fingerprints of a table's groups stand in lanes, 64 to a machine word, one array of
  words for each bit position. Lane i meets lane i + d by shifting these planes by d. Differences are added
  to bitwise counters by carry-save steps, many planes and lanes at once; the counters start so high that
  they overflow just beyond the radius, and words in which all lanes have overflowed are abandoned.
* **Groups.** Equal fingerprints are one node. A table group above ``block`` nodes is cut into parts, and
  every two parts meet in a cell of their own, so that no task holds or compares an unbounded group. A cell
  reports the links of a spanning forest, not all its pairs.

Where a similarity of texts is asked for, the fingerprints only propose. A pair is reported by the first table
in which it meets. The nearest earlier nodes of each node are checked by their sets of shingles, then all
other pairs whose ends are not in one component by then. A cell with too many pairs reports the nearest ones
and marks its nodes; marked nodes meet once more, and pairs of different components are reported without a limit.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import partial
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import columns, materialize, prepare, text_map, unused
from kgspark.llm.components import components

WORD = 64
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE_AT = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: str, shingle: int = 4, words: int = 1, distinct: bool = False) -> np.ndarray:
    """The fingerprint of a whole text as ``words`` unsigned 64-bit words; zero if it has no word.

    Letters A to Z are lower-cased; words are separated by space, tab, newline, and \\v \\f \\r; a text of
    fewer words than a shingle is one shingle. The first word is made of XXH64 (seed 42) itself, further
    ones of numbers mixed from it. With ``distinct`` a shingle counts once, however often the text repeats it.
    """
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(words, np.uint64)
    if len(tokens) <= shingle:
        shingles, total = iter((b" ".join(tokens),)), 1
    else:
        shingles, total = map(b" ".join, zip(*(islice(tokens, k, None) for k in range(shingle)))), len(tokens) - shingle + 1
    counts = np.zeros((words, 2048), np.int64)
    hashed = map(partial(xxhash.xxh64_intdigest, seed=42), shingles)
    if distinct:
        once = np.unique(np.fromiter(hashed, np.uint64))
        hashed, total = iter(once.tolist()), len(once)
    while len(h := np.fromiter(islice(hashed, 1 << 16), np.uint64)):
        for w in range(words):
            mixed = h if w == 0 else _mix(h, w)
            counts[w] += np.bincount((mixed.view(np.uint8).reshape(-1, 8) + _BYTE_AT).ravel(), minlength=2048)
    ones = (counts.reshape(words, 8, 256) @ _BITS).reshape(words, WORD)
    return np.packbits(2 * ones > total, axis=1, bitorder="little").view(np.uint64).ravel()


def _mix(h: np.ndarray, w: int) -> np.ndarray:
    """Another well-mixed number for each hash (the finishing steps of splitmix64)."""
    with np.errstate(over="ignore"):
        z = h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(w)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprints(docs: DataFrame, *, shingle: int = 4, words: int = 1, distinct: bool = False, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``id`` and the fingerprint as bigint columns ``f0``, ``f1``, ..., one row per document."""
    prepare(docs.sparkSession)
    id_type = docs.select(f"`{id_col}`").schema[0].dataType.simpleString()

    def make():
        return lambda i, text: (i, *fingerprint(text, shingle, words, distinct).view(np.int64).tolist())

    return text_map(columns(docs, id=id_col, text=text_col),
                    f"id {id_type}, " + ", ".join(f"f{w} bigint" for w in range(words)), make)


def exact_masks(radius: int) -> list[tuple[int, ...]]:
    """One mask for each two of ``radius + 2`` blocks of a 64-bit fingerprint."""
    edges = [round(k * WORD / (radius + 2)) for k in range(radius + 3)]
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    return [(a | b,) for a, b in combinations(blocks, 2)]


def sampled_masks(words: int, tables: int, key_bits: int, seed: int = 7) -> list[tuple[int, ...]]:
    """Masks of ``key_bits`` bits drawn at random from the whole fingerprint."""
    draw, out = random.Random(seed), []
    for _ in range(tables):
        mask = [0] * words
        for b in draw.sample(range(words * WORD), key_bits):
            mask[b // WORD] |= 1 << (b % WORD)
        out.append(tuple(mask))
    return out


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints (one a row): a row of words for each bit, a lane for each fingerprint."""
    lanes = -(-len(fps) // WORD) * WORD
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1, bitorder="little")
    bits = np.pad(bits, ((0, lanes - len(fps)), (0, 0)))
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def near_pairs(fps: np.ndarray, group: np.ndarray, radius: int, step: int = 8) -> Iterator[tuple[np.ndarray, ...]]:
    """Index pairs i < j of fingerprints of one group that differ in at most ``radius`` bits, and in how many.

    Equal groups stand together, larger groups first. One result for each run of 64 distances of lanes.
    """
    n = len(fps)
    if n < 2:
        return
    plane = planes(fps)
    plane = np.pad(plane, ((0, 0), (0, 2)))  # words beyond the end, for shifts
    ends = np.flatnonzero(np.diff(group)) + 1
    bounds = np.concatenate(([0], ends, [n]))
    last = np.repeat(bounds[1:], np.diff(bounds))  # of each lane: where its group ends
    depth = radius.bit_length()
    start = (1 << depth) - 1 - radius  # overflows at radius + 1
    one = np.uint64(1)
    largest = int(np.diff(bounds).max())
    for base in range(0, largest, WORD):
        reach = np.arange(max(base, 1), min(base + WORD, largest))
        valid = np.arange(n) + reach[:, None] < last
        width = -(-n // WORD)
        valid = np.packbits(np.pad(valid, ((0, 0), (0, width * WORD - n))), axis=1, bitorder="little").view(np.uint64)
        row, word = np.nonzero(valid)
        if not len(row):
            return
        valid, far = valid[row, word], reach[row]
        jump, shift = word + far // WORD, (far % WORD).astype(np.uint64)
        back = np.uint64(63) - shift
        counter = [np.full(len(row), ~np.uint64(0) if start >> k & 1 else 0, np.uint64) for k in range(depth)]
        over = np.zeros(len(row), np.uint64)

        def differs(b):
            p = plane[b]
            return p[word] ^ ((p[jump] >> shift) | ((p[jump + 1] << one) << back))

        for b in range(0, len(plane), 2):
            x, y = differs(b), differs(b + 1)
            # Two planes and the lowest counter bit make one sum bit and one carry.
            if depth:
                low = counter[0]
                half = x ^ y
                counter[0], carry = low ^ half, (x & y) | (low & half)
                for k in range(1, depth):
                    counter[k], carry = counter[k] ^ carry, counter[k] & carry
            else:
                carry = x | y
            over |= carry
            if b % step == step - 2:
                live = np.flatnonzero(valid & ~over)
                if not len(live):
                    break
                if len(live) < 0.75 * len(row):
                    row, word, far, jump, shift, back, valid, over = (
                        v[live] for v in (row, word, far, jump, shift, back, valid, over))
                    counter = [c[live] for c in counter]
        near = valid & ~over
        live = np.flatnonzero(near)
        if len(live):
            at, lane = np.nonzero(np.unpackbits(near[live].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            i = word[live][at] * WORD + lane
            bits = np.zeros(len(lane), np.int64)
            for k, c in enumerate(counter):
                bits += ((c[live][at] >> lane.astype(np.uint64)) & one).astype(np.int64) << k
            yield i, i + far[live][at], bits - start


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, ...]]) -> np.ndarray:
    """The least index that each of n items is linked with, over any number of links."""
    label = np.arange(n)
    for i, j, _ in pairs:
        a, b = label[i], label[j]
        while (a != b).any():
            a, b = a[a != b], b[a != b]
            low = np.minimum(a, b)
            np.minimum.at(label, np.maximum(a, b), low)  # roots only point to lesser roots
            while (label != label[label]).any():
                label = label[label]
            a, b = label[a], label[b]
    return label


def _first_met(x: np.ndarray, y: np.ndarray, table: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Which pairs of fingerprints do not agree in a table before the one in which they met."""
    differ, out = x ^ y, np.zeros(len(x), bool)
    left = np.arange(len(x))
    for t, mask in enumerate(masks):
        here = table[left] == t
        out[left[here]] = True
        left = left[~here]
        left = left[(differ[left] & mask != 0).any(axis=1)]
        if not len(left):
            break
    return out


def _some_pairs(part: np.ndarray, pairs, masks: np.ndarray, dense: int):
    """Rows (a, b, distance) of the pairs of a part that did not meet in a table before.

    Of more than ``dense`` pairs a node, the nearest one of each node, and each node as (a, -1, 0). Parts with
    a column of roots give all pairs whose roots differ, however many.
    """
    words, n = masks.shape[1], len(part)
    fps, table = part[:, 4:4 + words].copy().view(np.uint64), part[:, 0] & 0xFFFF
    root = part[:, 4 + words] if part.shape[1] > 4 + words else None
    none = np.iinfo(np.int64).max
    held, size, best, met = [], 0, None, np.zeros(n, bool)
    for i, j, d in pairs:
        if root is not None:
            differ = root[i] != root[j]
            i, j, d = i[differ], j[differ], d[differ]
        first = _first_met(fps[i], fps[j], table[j], masks)
        i, j, d = i[first], j[first], d[first]
        if root is not None:
            yield part[j, 3], part[i, 3], d
            continue
        held.append((i, j, d))
        size += len(i)
        if best is None and size > dense * n:
            best = np.full(n, none)
        if best is not None:
            for i, j, d in held:
                np.minimum.at(best, j, (d << 32) + i)
                met[i] = met[j] = True
            held = []
    for i, j, d in held:
        yield part[j, 3], part[i, 3], d
    if best is not None:
        j = np.flatnonzero(best != none)
        yield part[j, 3], part[best[j] & 0xFFFFFFFF, 3], best[j] >> 32
        yield part[met, 3], np.full(met.sum(), -1), np.zeros(met.sum(), np.int64)


def _links(batches, names: list[str], words: int, radius: int, lanes: int, masks: np.ndarray | None, dense: int):
    """Links (a, b) within the cells of sorted batches, b the earlier node, with their distance.

    They are a spanning forest of each cell (distance 0), or those of ``_some_pairs`` if there are masks.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("distance", pa.int64())])

    def forest(part: np.ndarray, pairs):
        to = spanning(len(part), pairs)
        linked = to != np.arange(len(part))
        yield part[linked, 3], part[to[linked], 3], np.zeros(linked.sum(), np.int64)

    def compare(rows: np.ndarray):
        cell = np.cumsum(np.concatenate(([0], (np.diff(rows[:, :3], axis=0) != 0).any(axis=1))))
        size = np.bincount(cell)
        rows, cell = rows[size[cell] > 1], cell[size[cell] > 1]
        order = np.lexsort((cell, -size[cell]))
        rows, cell, start = rows[order], cell[order], 0
        while start < len(rows):
            # Cells of like sizes, up to a number of lanes, are compared together.
            top = size[cell[start]]
            stop = np.searchsorted(-size[cell], -(top // 2), side="left") if top > 4 else len(rows)
            stop = min(stop, max(start + lanes, start + top))
            while stop < len(rows) and cell[stop] == cell[stop - 1]:
                stop += 1
            part, group = rows[start:stop], cell[start:stop]
            pairs = near_pairs(part[:, 4:4 + words].copy().view(np.uint64), group, radius)
            for found in forest(part, pairs) if masks is None else _some_pairs(part, pairs, masks, dense):
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], schema=schema)
            start = stop

    held = np.zeros((0, len(names)), np.int64)
    for batch in batches:
        rows = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names], axis=1)
        held = np.concatenate((held, rows))
        if len(held) >= 4 * lanes:
            changes = np.flatnonzero((np.diff(held[:, :3], axis=0) != 0).any(axis=1)) + 1
            if len(changes):
                yield from compare(held[:changes[-1]])
                held = held[changes[-1]:]
    if len(held):
        yield from compare(held)


def links(nodes: DataFrame, masks: list[tuple[int, ...]], radius: int, *, forest: bool = True, block: int = 2048,
          lanes: int = 8192, dense: int = 32) -> DataFrame:
    """Links (a, b, distance) between nodes within the radius that meet in a table, b < a.

    A forest joins all such nodes, over one or more steps. Otherwise all pairs are links, but where there are
    more than ``dense`` a node in what a task compares at once: there each node has a link to the nearest lesser
    one, and all nodes of left out pairs are marked by a row with b = -1. With a column ``root`` only pairs
    with different roots are links, and none is left out. Cells of a divided group may repeat a link.
    ``nodes``: ``node`` (bigint, unique) and the words ``f0``, ``f1``, ... of different fingerprints.
    """
    words = len(masks[0])
    shown = [f"f{w}" for w in range(words)]
    carried = shown + [c for c in ("root",) if c in nodes.columns]

    def signed(mask):
        return F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask).cast("bigint")

    def key(t, mask):
        hashed = F.xxhash64(F.lit(t), *[F.col(f).bitwiseAND(signed(m)) for f, m in zip(shown, mask)])
        return hashed if forest else F.shiftleft(hashed, 16).bitwiseOR(F.lit(t).cast("bigint"))  # the table in 16 bits

    keys = F.array(*[key(t, mask) for t, mask in enumerate(masks)])
    keyed = nodes.select("node", *carried, F.explode(keys).alias("cell"))
    # Few groups are above the block size; nodes that are alone in a group are left out by the comparison.
    hot = (nodes.select(F.explode(keys).alias("cell")).groupBy("cell").count().where(F.col("count") > block)
           .select("cell", F.ceil(F.col("count") / block).cast("bigint").alias("parts")))
    keyed = keyed.join(hot, "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("bigint")))
    keyed = keyed.withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))
    cells = (keyed.select("cell", "node", *carried, "part", other.alias("other"))
             .select("cell", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "node", *carried))
    how = partial(_links, names=["cell", "i", "j", "node", *carried], words=words, radius=radius, lanes=lanes, dense=dense,
                  masks=None if forest else np.array(masks, np.uint64))
    return (cells.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "node")
            .mapInArrow(how, "a bigint, b bigint, distance bigint"))


def near_duplicates(docs: DataFrame, *, shingle: int = 4, words: int = 1, radius: int = 4,
                    masks: list[tuple[int, ...]] | None = None, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``fingerprint`` (lowercase hex) and ``component_id``, the least id of
    the documents that it is linked with over any number of links (itself included).

    Documents are linked if their fingerprints differ in at most ``radius`` bits. Without ``masks`` the
    tables lose no link (64-bit fingerprints). Null and empty texts have fingerprint zero and are linked
    like any other. A null id counts as no id: its row gets the least id of its component, or null. Repeated
    rows are kept and are linked. Other columns are ignored; an empty table gives an empty one.
    """
    prepare(docs.sparkSession)
    masks = masks or exact_masks(radius)
    shown = [f"f{w}" for w in range(words)]
    prints = materialize(fingerprints(docs, shingle=shingle, words=words, id_col=id_col, text_col=text_col))
    nodes = materialize(prints.groupBy(*shown).agg(F.min("id").alias("least"))
                        .withColumn("node", F.monotonically_increasing_id()))
    roots = components(links(nodes.select("node", *shown), masks, radius).select("a", "b"))
    placed = materialize(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(least, "root").select(*shown, "component_id")
    hexed = F.concat(*[F.lower(F.lpad(F.hex(f), 16, "0")) for f in shown])
    return prints.join(named, shown).select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def shingle_set(text: str, shingle: int) -> set:
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    n = min(shingle, len(tokens))
    return set(zip(*(islice(tokens, k, None) for k in range(n)))) if n else set()


def jaccard(x: set, y: set) -> float:
    common = len(x & y)
    return common / (len(x) + len(y) - common) if x or y else 1.0


def similar(a: str, b: str, shingle: int) -> float:
    """The Jaccard similarity of the sets of word shingles of two texts (1 for two texts without words)."""
    return jaccard(shingle_set(a, shingle), shingle_set(b, shingle))


def similar_pairs(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, *, shingle: int, similarity: float, block: int = 32) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose texts are similar enough. ``nodes`` has the ``id`` and ``hash``
    of each ``node``, ``docs`` the ``text`` of these.

    Nodes are dealt into blocks of about ``block``; a text goes once to each two blocks with a pair of it.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    blocks = F.lit(max(1, -(-ends.count() // block))).cast("bigint")
    dealt = pairs.select(F.pmod(F.xxhash64("a"), blocks).alias("i"), F.pmod(F.xxhash64("b"), blocks).alias("j"), "a", "b").distinct()
    needed = dealt.select("i", "j", F.explode(F.array("a", "b")).alias("node")).distinct()
    named = needed.join(nodes, "node").join(docs, ["id", "hash"])
    # Of a cell, texts (without b) come before pairs.
    rows = (named.select("i", "j", F.col("node").alias("a"), F.lit(-1).cast("bigint").alias("b"), "text")
            .unionByName(dealt.withColumn("text", F.lit(None).cast("string"))))

    def check(batches):
        cell, sets = None, {}
        for batch in batches:
            out = []
            for i, j, a, b, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (i, j) != cell:
                    cell, sets = (i, j), {}
                if b < 0:
                    sets[a] = shingle_set(text or "", shingle)
                elif jaccard(sets[a], sets[b]) >= similarity:
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    return (rows.repartition("i", "j").sortWithinPartitions("i", "j", F.col("b") >= 0)
            .mapInArrow(check, "a bigint, b bigint"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents under a key that tells rows apart by id and text; a null id comes after all others."""
    d = columns(docs, id=id_col, text=text_col)
    return d.select(F.coalesce(F.col("id").cast("bigint"), F.lit((1 << 63) - 1)).alias("id"), F.xxhash64("text").alias("hash"), "text")


def similar_groups(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, words: int = 4, radius: int = 52,
                   tables: int = 64, key_bits: int = 18, partners: int = 3, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Groups of texts that are linked by a Jaccard similarity of at least ``similarity`` of their shingles.

    One row per different (id, hash of the text) with that of its group's least document: ``id``, ``hash``,
    ``least_id``, ``least_hash``. Each text is compared with all those that its fingerprint met within ``radius``
    bits in some table, but those it is linked with over others by then; the ``partners`` nearest earlier ones
    come first, to find most links from few pairs. Fingerprints are those of the distinct shingles, as the
    similarity is. With the default of 256 bits, and 64
    tables of 18 sampled bits, a pair at a similarity of 0.8 is met with a probability of 0.96, at 0.85 of
    0.99, at 0.9 of more than 0.999. Ids are whole numbers; a null id counts as the greatest. Texts without
    words are similar to each other alone.
    """
    prepare(docs.sparkSession)
    shown, d = [f"f{w}" for w in range(words)], _keyed(docs, id_col, text_col)
    keyed = d.select(F.struct("id", "hash").alias("key"), "text")
    prints = materialize(fingerprints(keyed, shingle=shingle, words=words, distinct=True, id_col="key").distinct())
    nodes = prints.groupBy(*shown).agg(F.min("id").alias("least")).orderBy("least")
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()))
    masks = sampled_masks(words, tables, key_bits)
    met = materialize(links(nodes.select("node", *shown), masks, radius, forest=False))
    pairs, marked = met.where("b >= 0"), met.where("b < 0").select(F.col("a").alias("node")).distinct()
    named = nodes.select("node", F.col("least.id").alias("id"), F.col("least.hash").alias("hash"))

    def checked(these):
        return materialize(similar_pairs(materialize(these), named, d, shingle=shingle, similarity=similarity))

    # First the nearest ones of each node, then whatever is still between different components.
    near = (pairs.groupBy("a").agg(F.array_sort(F.collect_set(F.struct("distance", "b"))).alias("near"))
            .select("a", F.explode(F.slice("near", 1, partners)).alias("x")).select("a", F.col("x.b").alias("b")))
    near = materialize(near)
    same = checked(near)
    roots = components(same)
    placed = materialize(nodes.join(roots, "node", "left").select("node", *shown, F.coalesce("root", "node").alias("root")))
    more = links(placed.join(marked, "node", "left_semi"), masks, radius, forest=False).select("a", "b")
    ends = [placed.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in ("a", "b")]
    apart = pairs.select("a", "b").join(ends[0], "a").join(ends[1], "b").where("root_a <> root_b").select("a", "b")
    rest = apart.unionByName(more).join(near, ["a", "b"], "left_anti").distinct()
    roots = components(same.unionByName(checked(rest)))
    # The least node of a component holds its least document, as nodes are in that order.
    placed = (nodes.join(roots, "node", "left").select(*shown, F.coalesce("root", "node").alias("root"))
              .join(nodes.select(F.col("node").alias("root"), "least"), "root"))
    return (prints.join(placed.select(*shown, "least"), shown)
            .select("id.id", "id.hash", F.col("least.id").alias("least_id"), F.col("least.hash").alias("least_hash")))


def one_per_group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents, with all their columns, of which one of each group of ``similar_groups`` stays: the one
    with the least id. Of rows with equal id and text one stays; a null id counts as the greatest. Null and empty texts
    have no shingles and form one group; an empty table gives an empty one."""
    prepare(docs.sparkSession)
    groups = similar_groups(docs, id_col=id_col, text_col=text_col, **how)
    kept = groups.where("id = least_id AND hash = least_hash").select(F.col("id").alias("k0"), F.col("hash").alias("k1")).distinct()
    a, b = unused(docs, "key_id"), unused(docs, "key_hash")
    keyed = docs.withColumns({a: F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit((1 << 63) - 1)), b: F.xxhash64(F.col(f"`{text_col}`"))})
    same = keyed.join(kept, (F.col(a) == F.col("k0")) & (F.col(b) == F.col("k1")), "left_semi")
    return same.dropDuplicates([a, b]).drop(a, b)
