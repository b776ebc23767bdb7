"""Benchmark items inside documents: BM25 retrieval with block-max pruning, then a check of word runs.

The test items are the indexed side. Every document is cut into passages that overlap by half, and each
passage is a query that retrieves all items whose score reaches a share of the item's own full score.

* **Index.** An inverted index with BM25 weights, each divided by the sum of its item's weights, so that a
  passage that holds all of an item's terms scores 1. Items stand in blocks of a few; every term
  knows its greatest weight in each block.
* **Block-max WAND.** The block maxima of a passage's terms are summed for all blocks at once; blocks below
  the threshold cannot hold a hit and are never opened. In the others, the lists of the terms are walked
  side by side: the pivot is the first item at which the bounds of the lists up to there reach the
  threshold, and lists that stand before it jump to it. Only full candidates are scored.
* **Check.** A hit counts if enough word runs of the item's question, and of its answer, stand in the passage.

The index of up to ``shard_items`` items is sent to all tasks; a longer benchmark is searched in shards,
one pass over the documents each. Its terms' statistics are those of all items in any case.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from kgspark.llm.common import columns, prepare

TERM = re.compile(r"\w+")
SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
K1, B = 1.2, 0.75
CHUNK = 1 << 16  # words of a document that are held at once


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


def question_and_answer(text: str, run: int = 5) -> tuple[list[str], list[str]]:
    """The words of both halves of an item: up to the last question mark and after it; without one, all
    sentences but the last and the last; a single sentence is cut after two thirds of its words.

    A last sentence of one run of words or less is joined by those before it up to two runs, so that the answer
    does not hang on few words; if too few words come before, the item is cut like a single sentence."""
    head, mark, tail = text.rpartition("?")
    if mark and terms(head) and terms(tail):
        return terms(head), terms(tail)
    sentences = [s for s in SENTENCE_END.split(text.strip()) if terms(s)]
    least = 2 * run if sentences and len(terms(sentences[-1])) <= run else 1
    answer: list[str] = []
    while len(sentences) > 1 and len(answer) < least:
        answer = terms(sentences.pop()) + answer
    if len(answer) >= least:
        return [w for s in sentences for w in terms(s)], answer
    all_words = terms(text)
    cut = max(1, math.ceil(len(all_words) * 2 / 3))
    return all_words[:cut], all_words[cut:]


def runs(words: list[str], n: int) -> set[tuple[str, ...]]:
    """The runs of n words, or of all words if there are fewer."""
    n = min(n, len(words))
    return set(zip(*(words[k:] for k in range(n)))) if n else set()


@dataclass
class Item:
    id: object
    length: int
    question: set
    answer: set


class Index:
    """Inverted index of items. ``frequencies``: in how many of all ``total`` items a term is."""

    def __init__(self, items: list[tuple[object, str]], frequencies: dict[str, int], total: int, mean_length: float,
                 run: int = 5, block: int = 8):
        self.run, self.block = run, block
        self.items: list[Item] = []
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for k, (i, text) in enumerate(items):
            words = terms(text)
            q, a = question_and_answer(text, run)
            self.items.append(Item(i, len(words), runs(q, run), runs(a, run)))
            weights = {}
            for t, tf in Counter(words).items():
                idf = math.log(1 + (total - frequencies[t] + 0.5) / (frequencies[t] + 0.5))
                weights[t] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_length))
            full = sum(weights.values())
            for t, w in weights.items():
                postings[t].append((k, w / full))
        self.vocabulary = {t: n for n, t in enumerate(postings)}
        self.docs = [[k for k, _ in p] for p in postings.values()]
        self.weights = [[w for _, w in p] for p in postings.values()]
        self.bounds = np.zeros((len(postings), max(1, -(-len(items) // block))), np.float32)
        for n, p in enumerate(postings.values()):
            for k, w in p:
                self.bounds[n, k // block] = max(self.bounds[n, k // block], w)
        self.stride = max((x.length for x in self.items), default=1)

    def open_blocks(self, windows: np.ndarray, ids: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted (window, term) pairs: the windows and blocks whose summed maxima reach the threshold."""
        starts = np.flatnonzero(np.concatenate(([True], np.diff(windows) != 0)))
        at, block = np.nonzero(np.add.reduceat(self.bounds[ids], starts, axis=0) >= threshold * 0.9999)
        return windows[starts][at], block

    def walk(self, ids: Iterable[int], block: int, threshold: float) -> Iterator[tuple[int, float]]:
        """Items of one block that reach the threshold for a set of terms, with their scores."""
        lo, hi = block * self.block, min((block + 1) * self.block, len(self.items))
        lists = []  # [current item, position, term, bound in this block]
        for t in ids:
            p = bisect_left(self.docs[t], lo)
            if p < len(self.docs[t]) and self.docs[t][p] < hi:
                lists.append([self.docs[t][p], p, t, float(self.bounds[t, block])])

        def forward(entry, to):
            p = bisect_left(self.docs[entry[2]], to, entry[1])
            entry[1], entry[0] = p, self.docs[entry[2]][p] if p < len(self.docs[entry[2]]) else hi
            return entry[0] < hi

        while lists:
            lists.sort(key=lambda x: x[0])
            bound, pivot = 0.0, None
            for entry in lists:
                bound += entry[3]
                if bound >= threshold * 0.9999:
                    pivot = entry[0]
                    break
            if pivot is None:
                return
            if lists[0][0] == pivot:
                score = sum(self.weights[t][p] for d, p, t, _ in lists if d == pivot)
                if score >= threshold - 1e-9:
                    yield pivot, score
                lists = [x for x in lists if x[0] != pivot or forward(x, pivot + 1)]
            else:
                lists = [x for x in lists if x[0] >= pivot or forward(x, pivot)]

    def search(self, parts: list[list[str]], threshold: float, overlap: float) -> dict[int, dict[int, tuple]]:
        """For each of many lists of words that has a hit: items with the best (score, question, answer)."""
        found: dict[int, dict[int, tuple]] = defaultdict(dict)
        get, stride, size = self.vocabulary.get, self.stride, max(1, len(self.vocabulary))
        known, first, owner = [], [], []
        base = 0
        for k, words in enumerate(parts):
            ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
            at = np.flatnonzero(ids >= 0)
            # A passage is two strides long; window w of a part covers strides w and w + 1.
            known.append((base + at // stride) * size + ids[at])
            windows = len(words) // stride + 2
            owner.append(np.full(windows, k))
            first.append(np.arange(windows) * stride)
            base += windows
        if not base:
            return found
        own = np.concatenate(known)
        # The window before also covers a stride; the spare window of each part keeps parts apart.
        pairs = np.unique(np.concatenate((own, own[own >= size] - size)))
        owner, first = np.concatenate(owner), np.concatenate(first)
        if not len(pairs):
            return found
        windows, ids = pairs // size, pairs % size
        for w, block in zip(*self.open_blocks(windows, ids, threshold)):
            lo, hi = np.searchsorted(windows, (w, w + 1))
            words, grams = parts[owner[w]], None
            if first[w] >= len(words):
                continue  # the spare window, which also holds the start of the next part
            for item, score in self.walk(ids[lo:hi].tolist(), int(block), threshold):
                x = self.items[item]
                grams = grams if grams is not None else {}
                passage = words[first[w]:first[w] + 2 * stride]

                def share(wanted):
                    if not wanted:
                        return 1.0
                    n = len(next(iter(wanted)))
                    if n not in grams:
                        grams[n] = set(zip(*(passage[k:] for k in range(n))))
                    return len(wanted & grams[n]) / len(wanted)

                q, a = share(x.question), share(x.answer)
                if q >= overlap and a >= overlap:
                    best = found[int(owner[w])]
                    best[item] = max(best.get(item, (0.0, 0.0, 0.0)), (score, q, a))
        return found


def _chunks(text: str, overlap: int) -> Iterator[list[str]]:
    """The words of a text, in chunks that repeat the last ``overlap`` words."""
    if len(text) <= 4 * CHUNK:
        yield terms(text)
        return
    found, kept = (m.group() for m in TERM.finditer(text.lower())), []
    while part := list(islice(found, CHUNK)):
        yield kept + part
        kept = part[-overlap:]


def _hits(texts: list[str | None], index: Index, threshold: float, overlap: float) -> list[dict[int, tuple]]:
    """For each text, its items with (score, question, answer)."""
    out: list[dict[int, tuple]] = [{} for _ in texts]
    parts, owners, held = [], [], 0

    def flush():
        for k, items in index.search(parts, threshold, overlap).items():
            mine = out[owners[k]]
            for item, best in items.items():
                mine[item] = max(mine.get(item, best), best)

    for n, text in enumerate(texts):
        for words in _chunks(text or "", 2 * index.stride):
            parts.append(words)
            owners.append(n)
            held += len(words)
            if held > 4 * CHUNK:
                flush()
                parts, owners, held = [], [], 0
    flush()
    return out


def shards(items: DataFrame, id_col: str, text_col: str, *, run: int, shard_items: int,
           shard_bytes: int = 8 << 20) -> Iterator[Broadcast]:
    """Indexes of parts of the items, each bounded by a number of items and of bytes, sent to the tasks."""
    spark = items.sparkSession
    d = columns(items, id=id_col, text=text_col).withColumn("words", F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)(\w+)"), 1))
    d = d.where(F.size("words") > 0)
    total, mean, size = d.agg(F.count("*"), F.avg(F.size("words")), F.sum(F.octet_length("text"))).first()
    if not total:
        return
    parts = max(-(-total // shard_items), -(-size // shard_bytes))
    frequencies = d.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").count()
    for part in range(parts):
        mine = d.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part)
        rows = [(r.id, r.text) for r in mine.select("id", "text").orderBy("id", "text").toLocalIterator()]
        terms_here = mine.select(F.explode("words").alias("term")).distinct()
        counted = {r.term: r["count"] for r in frequencies.join(terms_here, "term", "left_semi").toLocalIterator()}
        here = {t for _, text in rows for t in terms(text)}
        # Lower-casing differs between the two sides for a few letters; such a term counts as rare.
        yield spark.sparkContext.broadcast(Index(rows, {t: counted.get(t, 1) for t in here}, total, mean, run))


def find_leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
               item_id_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.6,
               overlap: float = 0.5, run: int = 5, shard_items: int = 1024) -> DataFrame:
    """One row per document and item that it holds: both ids, ``score``, ``question_overlap``,
    ``answer_overlap`` (shares of the item's runs of ``run`` words that stand in the passage).

    Null and empty texts hold nothing; items without words are in no document. Null ids are kept; a
    document or item that is given twice is reported twice. Other columns are ignored; empty tables give
    an empty result.
    """
    spark = prepare(docs.sparkSession)
    kinds = (docs.select(f"`{id_col}`").schema[0].dataType.simpleString(),
             items.select(f"`{item_id_col}`").schema[0].dataType.simpleString())
    schema = (f"`{id_col}` {kinds[0]}, `{item_id_col}` {kinds[1]}, score double, question_overlap double, "
              "answer_overlap double")
    d, out = columns(docs, id=id_col, text=text_col), spark.createDataFrame([], schema)
    arrow = to_arrow_schema(out.schema)
    for shard in shards(items, item_id_col, item_text_col, run=run, shard_items=shard_items):
        def search(batches, sent=shard):
            index = sent.value
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                rows = [(i, index.items[k].id, *best) for i, hits in zip(ids, _hits(texts, index, threshold, overlap))
                        for k, best in hits.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
        out = out.unionByName(d.mapInArrow(search, schema))
    return out


def without_leaks(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id",
                  item_text_col: str = "text", threshold: float = 0.6, overlap: float = 0.5, run: int = 5,
                  shard_items: int = 1024) -> DataFrame:
    """The documents, with all their columns, that hold no item. Rows without a text are kept; ids are not looked at, so
    null ids do no harm, and repeated rows stay or go together. Without items, or without documents, nothing changes."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)
    for shard in shards(items, item_id_col, item_text_col, run=run, shard_items=shard_items):
        def clean(batches, sent=shard):
            for batch in batches:
                hits = _hits(batch.column(at).to_pylist(), sent.value, threshold, overlap)
                yield batch.filter(pa.array([not h for h in hits]))
        docs = docs.mapInArrow(clean, docs.schema)
    return docs
