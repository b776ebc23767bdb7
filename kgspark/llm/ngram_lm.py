"""Stupid-backoff language model scores, with counts over all documents.

``lm_scores`` does not join relations of n-grams: each block of documents sends its distinct hashed n-grams with
its own counts, cut into ranges of hashes; the parts of a range are summed, and each block gets the sums for
its n-grams back in their order. ``relational_scores`` gives the same by count tables joined to exploded n-grams,
but shuffles every n-gram as a row.
"""

from __future__ import annotations

from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.llm.blocks import (NO_ID, Block, ask, cuts, pack, pack_keys, pack_numbers, ranges, told, unpack, unpack_keys,
                                unpack_numbers)
from kgspark.llm.common import columns, materialize, prepare, words

PART_BYTES = 4 << 20  # text per range of hashes
_SCORE = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("log_score", pa.float64())])


class _Hashes(dict):
    """Hashes of words, kept for the words met last."""

    def __missing__(self, word):
        if len(self) >= 300_000:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


_HASHES = _Hashes()


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return z ^ (z >> np.uint64(32))


def ngrams(block: Block, order: int, bits: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The document of each word; for each order, the hash of the n-gram that ends at each word; and how
    many words of the document stand before each word.

    Words are separated by space, tab, newline, \\v, \\f and \\r, with A to Z lower-cased.
    """
    hashed, counts, values = _HASHES.__getitem__, [], []
    for text in block.texts():
        words = text.lower().split()
        counts.append(len(words))
        values.append(np.fromiter(map(hashed, words), np.uint64, len(words)))
    doc = np.repeat(np.arange(len(counts)), counts)
    word = np.concatenate(values) if values else np.zeros(0, np.uint64)
    first = np.concatenate(([0], np.cumsum(counts)[:-1])) if counts else np.zeros(0, np.int64)
    before = np.arange(len(word)) - first[doc]
    out, gram = [], word
    with np.errstate(over="ignore"):
        for n in range(1, order + 1):
            if n > 1:
                gram = _mix(np.concatenate((gram[:1], gram[:-1])) * np.uint64(0x9E3779B97F4A7C15) + word)
            out.append(_mix(gram + np.uint64(n)) >> np.uint64(64 - bits))
    return doc, out, before


def _sums(kind: int, parts: list[tuple[bytes, bytes]], min_count: int) -> list[bytes]:
    """For each part, the counts of its n-grams in all parts; 0 for longer n-grams below ``min_count``."""
    keys = [unpack_keys(k) for k, _ in parts]
    counts = np.concatenate([unpack_numbers(m, np.int64) for _, m in parts])
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")
    starts = np.flatnonzero(np.concatenate(([True], np.diff(every[order]) != 0)))
    totals = np.add.reduceat(counts[order], starts)
    if kind > 1:
        totals[totals < min_count] = 0
    out = np.empty(len(every), np.int64)
    out[order] = np.repeat(totals, np.diff(np.concatenate((starts, [len(every)]))))
    return [pack_numbers(a) for a in np.split(out, np.cumsum([len(k) for k in keys])[:-1])]


def _counts(gram: np.ndarray, use: np.ndarray, answers: list[bytes]) -> np.ndarray:
    """The counts of the n-grams in use; 0 elsewhere. The answers are in the order of the distinct n-grams."""
    out = np.zeros(len(gram))
    at = np.flatnonzero(use)
    if len(at):
        order = np.argsort(gram[at])
        at = at[order]
        new = np.diff(gram[at], prepend=gram[at[0]]) != 0
        out[at] = np.concatenate([unpack_numbers(a, np.int64) for a in answers])[np.cumsum(new)]
    return out


def lm_scores(docs: DataFrame, *, order: int = 3, backoff: float = 0.4, min_count: int = 2, hash_bits: int = 52,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``n_words``, ``log_score`` (the sum of the natural logarithms of its words'
    scores) and ``mean_log_score`` (per word; null without words).

    The score of a word after its last n - 1 words is count(n-gram) / count(those words) if the corpus has
    the n-gram at least ``min_count`` times, else ``backoff`` times its score after one word less; alone it is
    its share of all words. The first words of a document have as much context as there is. Counts are
    those of all given documents, the scored one included.

    A null or empty text has no words and ``log_score`` 0. Ids are whole numbers, null ids stay null; repeated
    rows count and are scored each; other columns are ignored; an empty table gives an empty one. N-grams
    are told apart by ``hash_bits`` bits: of d different ones, a share of about d / 2**hash_bits shares a count.
    """
    prepare(docs.sparkSession)
    blocks = pack(docs, id_col, text_col)
    size, total = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    edges = cuts(max(1, -(-size // PART_BYTES)), hash_bits)

    def questions(block, row):
        _, grams, before = ngrams(block, order, hash_bits)
        for n, gram in enumerate(grams, 1):
            keys, counts = np.unique(gram[before >= n - 1], return_counts=True)
            for part, here in ranges(keys, edges):
                yield part, n, pack_keys(keys[here]), pack_numbers(counts[here])

    def score(batches):
        for block, row in unpack(batches):
            doc, grams, before = ngrams(block, order, hash_bits)
            value = logs = None
            with np.errstate(divide="ignore", invalid="ignore"):
                for n in range(1, order + 1):
                    counts = _counts(grams[n - 1], before >= n - 1, told(row, n))
                    grams[n - 1] = None
                    if n == 1:
                        logs = np.log(counts)
                        value = logs - log(total or 1)
                        continue
                    lower = np.concatenate(([0.0], logs))[:len(logs)]  # the count of the words before
                    logs = np.log(counts)
                    longer = np.where(counts > 0, logs - lower, log(backoff) + value)
                    value = np.where(before < n - 1, value, longer)
            n_docs = len(block.ids)
            sums = np.bincount(doc, value, n_docs) if len(doc) else np.zeros(n_docs)
            words = np.bincount(doc, minlength=n_docs)
            yield pa.RecordBatch.from_arrays([
                pa.array(block.ids, mask=block.ids == NO_ID), pa.array(words), pa.array(sums)], schema=_SCORE)

    asked = ask(blocks, questions, lambda kind, parts: _sums(kind, parts, min_count))
    out = blocks.join(asked, "block", "left").mapInArrow(score, "id bigint, n_words bigint, log_score double")
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return out.select(F.col("id").alias(id_col), "n_words", "log_score", mean.alias("mean_log_score"))


def relational_scores(docs: DataFrame, *, order: int = 3, backoff: float = 0.4, min_count: int = 2, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """What ``lm_scores`` gives, with relations throughout: n-grams are exploded and hashed (64 bits), count tables are
    grouped by hash and joined back to the n-grams on it, and scores are summed per document.

    Each n-gram of each word is a row that is shuffled three times: to be counted, to meet its count, and
    to meet the other n-grams of its word.
    """
    prepare(docs.sparkSession)
    rows = materialize(columns(docs, id=id_col, text=text_col).select(
        F.monotonically_increasing_id().alias("row"), "id",
        words(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).alias("w")))

    def grams(n: int) -> Column:
        return F.transform("w", lambda a, i: F.when(i >= n - 1, F.struct(
            i.alias("i"), F.lit(n).alias("n"), F.xxhash64(F.lit(n), *[F.get("w", i - k) for k in range(n)]).alias("h"))))

    exploded = rows.select("row", F.explode(F.concat(*[F.filter(grams(n), lambda g: g.isNotNull()) for n in range(1, order + 1)])).alias("g"))
    exploded = exploded.select("row", "g.i", "g.n", "g.h")
    counts = exploded.groupBy("n", "h").agg(F.count("*").alias("c")).where((F.col("n") == 1) | (F.col("c") >= min_count))
    counts = materialize(counts)
    total = counts.where("n = 1").agg(F.sum("c")).first()[0] or 1
    found = exploded.join(counts, ["n", "h"])
    logs = found.groupBy("row", "i").agg(*[F.max(F.when(F.col("n") == n, F.log(F.col("c").cast("double")))).alias(f"l{n}") for n in range(1, order + 1)])
    before = Window.partitionBy("row").orderBy("i")
    logs = logs.withColumns({f"b{n}": F.lag(f"l{n}").over(before) for n in range(1, order)})
    value = F.col("l1") - log(total)
    for n in range(2, order + 1):
        longer = F.when(F.col(f"l{n}").isNotNull(), F.col(f"l{n}") - F.col(f"b{n - 1}")).otherwise(F.lit(log(backoff)) + value)
        value = F.when(F.col("i") < n - 1, value).otherwise(longer)
    sums = logs.groupBy("row").agg(F.sum(value).alias("log_score"))
    out = rows.select("row", "id", F.size("w").cast("bigint").alias("n_words")).join(sums, "row", "left").fillna(0.0, ["log_score"])
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return out.select(F.col("id").alias(id_col), "n_words", "log_score", mean.alias("mean_log_score"))
