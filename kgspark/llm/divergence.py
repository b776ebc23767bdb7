"""How far the sources of a language are from each other in the words they use.

* **Inversion in one pass.** Each task goes through its documents once and keeps, for each source, how often and in
  how many documents each term occurs, until so many entries are held. Then they leave as a run, sorted by
  term within each source, and the task begins anew. Runs are written once.
* **Merge.** Entries meet in shards by a hash of source and term. In a shard the runs of a source are merged by a
  heap into frequencies. There are as many shards as keep each small, and a term that every run has is a row a run.
* **Corrections.** Nearly all terms are absent from nearly all sources, where their share is the least of that
  source. The distance of two sources is that of their least shares, times the number of terms, and corrections: for the
  terms that one of them has, found from the distribution of its counts; and for the terms that both have,
  summed up in one stream over the postings of the terms. No term is looked at for sources without it.

All arithmetic is on whole numbers.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.llm.common import columns, materialize, prepare, rows_of

RUN_ENTRIES = 800_000  # entries (source, term) a task holds before they leave as a run
SHARD_BYTES = 4 << 20  # of the documents, as Spark knows them, for each shard
SENT_ROWS, SENT_BYTES = 50_000, 4 << 20
PAIRS = 1 << 20  # pairs of sources whose corrections are summed up together

# Bytes of terms, A to Z lower-cased; all others become blanks. In UTF-8 what is not ASCII has bytes from 0x80 on.
_TERMS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

# A piece of a run: the terms of a source in a shard, in order and with blanks between, and two numbers of each.
_RUNS = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("source", pa.string()), ("terms", pa.binary()), ("counts", pa.binary())])
RUNS = "shard bigint, lang string, source string, terms binary, counts binary"
_FREQUENCIES = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])
FREQUENCIES = "lang string, source string, term binary, n bigint, docs bigint"
_FIXES = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())])
FIXES = "lang string, a string, b string, value bigint"


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and of characters beyond ASCII, A to Z lower-cased."""
    return text.translate(_TERMS).split()


def _spill(counts: dict, docs: dict, shards: int) -> Iterator[pa.RecordBatch]:
    """A run, source by source: pieces for the shards, each sorted by term."""
    rows, size = [], 0
    for lang, source in sorted(counts):
        n, d, pieces = counts[lang, source], docs[lang, source], {}
        for term in sorted(n):
            pieces.setdefault(crc32(term) % shards, []).append(term)
        for shard, some in pieces.items():
            numbers = np.array([[n[t] for t in some], [d[t] for t in some]], np.int64)
            rows.append((shard, lang, source, b" ".join(some), numbers.tobytes()))
            size += len(rows[-1][3]) + len(rows[-1][4])
            if size > SENT_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RUNS)], schema=_RUNS)
                rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RUNS)], schema=_RUNS)


def _invert(batches, shards: int) -> Iterator[pa.RecordBatch]:
    """Runs of the documents that go by."""
    counts, docs, held = {}, {}, 0
    for batch in batches:
        for lang, source, text in rows_of(batch, "lang", "source", "text"):
            found = terms(text)
            n = counts.get((lang, source))
            if n is None:
                n, docs[lang, source] = counts.setdefault((lang, source), Counter()), Counter()
            held -= len(n)
            n.update(found)
            held += len(n)
            docs[lang, source].update(set(found))
            if held >= RUN_ENTRIES:
                yield from _spill(counts, docs, shards)
                counts, docs, held = {}, {}, 0
    yield from _spill(counts, docs, shards)


def _merge(batches) -> Iterator[pa.RecordBatch]:
    """Frequencies of a shard: the pieces of each source are merged by a heap, equal terms added."""
    pieces: dict[tuple, list] = {}
    for batch in batches:
        for shard, lang, source, some, numbers in rows_of(batch, "shard", "lang", "source", "terms", "counts"):
            pieces.setdefault((shard, lang, source), []).append((some, numbers))
    for key in sorted(pieces):
        runs = [zip(some.split(b" "), *np.frombuffer(numbers, np.int64).reshape(2, -1).tolist()) for some, numbers in pieces.pop(key)]
        found, n, docs, last = [], [], [], None
        for term, a, b in heapq.merge(*runs) if len(runs) > 1 else runs[0]:
            if term == last:
                n[-1] += a
                docs[-1] += b
                continue
            if len(found) >= SENT_ROWS:
                yield _counted(key, found, n, docs)
                found, n, docs = [], [], []
            found.append(term)
            n.append(a)
            docs.append(b)
            last = term
        yield _counted(key, found, n, docs)


def _counted(key: tuple, found: list, n: list, docs: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.repeat(pa.scalar(key[1], pa.string()), len(found)), pa.repeat(pa.scalar(key[2], pa.string()), len(found)),
         pa.array(found, pa.binary()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], schema=_FREQUENCIES)


def frequencies(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang``, ``source``, ``term`` (UTF-8 bytes), ``n`` occurrences, ``docs`` documents: the counts of a corpus, from
    runs that are merged. Null languages, sources and texts are empty ones. Each row is a document. Written once."""
    prepare(docs.sparkSession)
    d = columns(docs, lang=lang_col, source=source_col, text=text_col).select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")],
        F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    # The size as Spark knows it decides how many shards there are; where it knows none, texts are measured.
    known = int(str(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if known >= 1 << 60:
        known = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-known // SHARD_BYTES))
    runs = materialize(d.mapInArrow(lambda batches: _invert(batches, shards), RUNS))
    return materialize(runs.repartition(shards, "shard").mapInArrow(_merge, FREQUENCIES))


def _share(n: str, total: str, kept: str) -> Column:
    """The smoothed share of a term, in parts of a thousand million, exactly."""
    whole = "CAST({} AS DECIMAL(20,0))"
    return F.expr(f"1 + (1000000000BD * ({whole.format(n)} + 5BD)) DIV ({whole.format(total)} + 5BD * {whole.format(kept)})")


class Corrections:
    """For each two sources of a language: by how much the terms that both have change the sum of the others."""

    def __init__(self):
        self.codes: dict[tuple[str, str], int] = {}
        self.names: list[tuple[str, str]] = []
        self.keys, self.sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.pending = 0

    def code(self, lang: str, source: str) -> int:
        code = self.codes.setdefault((lang, source), len(self.names))
        if code == len(self.names):
            self.names.append((lang, source))
        return code

    def add(self, term: np.ndarray, code: np.ndarray, share: np.ndarray, least: np.ndarray) -> None:
        """Postings, those of a term one after the other in the order of their sources."""
        for step in range(1, len(term)):
            met = np.flatnonzero(term[step:] == term[:-step])
            if not len(met):
                break
            p, q, p0, q0 = share[met], share[met + step], least[met], least[met + step]
            value = abs(p - q) - abs(p - q0) - abs(p0 - q) + abs(p0 - q0)
            self.new.append((code[met] << 32 | code[met + step], value))
            self.pending += len(met)
            if self.pending >= PAIRS:
                self._settle()

    def _settle(self) -> None:
        keys = np.concatenate([self.keys, *[k for k, _ in self.new]])
        sums = np.concatenate([self.sums, *[v for _, v in self.new]])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.sums = keys[starts], np.add.reduceat(sums[order], starts) if len(keys) else sums
        self.new, self.pending = [], 0

    def rows(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        """What is summed up, if it is for so many pairs at least; it then begins anew."""
        if least and len(self.keys) + self.pending < least:
            return
        self._settle()
        if len(self.keys) < max(1, least):
            return
        a, b = self.keys >> 32, self.keys & 0xFFFFFFFF
        yield pa.RecordBatch.from_arrays(
            [pa.array([self.names[k][0] for k in a]), pa.array([self.names[k][1] for k in a]), pa.array([self.names[k][1] for k in b]),
             pa.array(self.sums, pa.int64())], schema=_FIXES)
        self.keys, self.sums = self.keys[:0], self.sums[:0]


def _correct(batches) -> Iterator[pa.RecordBatch]:
    """Postings by term go by; pairs of the sources of each term are summed up over all terms of the task."""
    sums, held, rows, last, number = Corrections(), [], 0, None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lang, source, term = (batch.column(batch.schema.get_field_index(c)).dictionary_encode() for c in ("lang", "source", "term"))
        shares = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("p", "p0")]
        langs, sources = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
        at, of, which = (x.indices.to_numpy() for x in (lang, source, term))
        codes = {k: sums.code(langs[k >> 32], sources[k & 0xFFFFFFFF]) for k in np.unique(at.astype(np.int64) << 32 | of).tolist()}
        code = np.array([codes[k] for k in (at.astype(np.int64) << 32 | of).tolist()], np.int64)
        new = np.concatenate(([False], (np.diff(at) != 0) | (np.diff(which) != 0)))
        first = (langs[at[0]], term.dictionary[int(which[0])].as_py())
        new[0] = first != last
        last = (langs[at[-1]], term.dictionary[int(which[-1])].as_py())
        numbers = number + np.cumsum(new)
        number = int(numbers[-1])
        held.append((numbers, code, *shares))
        rows += len(numbers)
        if rows >= SENT_ROWS:
            term_of, code, p, p0 = (np.concatenate(c) for c in zip(*held))
            whole = int(np.searchsorted(term_of, number))  # the last term may go on
            sums.add(term_of[:whole], code[:whole], p[:whole], p0[:whole])
            yield from sums.rows(PAIRS)
            held, rows = [(term_of[whole:], code[whole:], p[whole:], p0[whole:])], len(term_of) - whole
    if held:
        sums.add(*(np.concatenate(c) for c in zip(*held)))
    yield from sums.rows()


def audit(docs: DataFrame, *, min_docs: int = 30, top: int = 50, lang_col: str = "lang", source_col: str = "source",
          text_col: str = "text") -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``: how each source of a language differs.

    Terms in at least ``min_docs`` documents of a language count. A source or language that has a term n times, and
    all terms N times, gives it the share 1 + floor(10^9 (n + 5) / (N + 5 V)) of V terms. Part ``pair``: for each
    other source of the language the sum over all terms of the difference of both shares. Part ``term``: the
    ``top`` terms whose share in the source is most above that in the language. Ranks count from 1 by value,
    largest first, then by the bytes of the item.

    Null languages, sources and texts are empty ones; a source whose texts have no term is listed as well, and without
    terms all its values are 0. Each row is a document, repeated rows too; ids are not looked at. Other columns are
    ignored. An empty table gives an empty one. Part ``pair`` has a row for each two sources of a language.
    """
    prepare(docs.sparkSession)
    counts = frequencies(docs, lang_col=lang_col, source_col=source_col, text_col=text_col)
    by_term = Window.partitionBy("lang", "term")
    kept = materialize(
        counts.withColumns({"in_docs": F.sum("docs").over(by_term), "all": F.sum("n").over(by_term),
                            "first": F.row_number().over(by_term.orderBy("source")) == 1})
        .where(F.col("in_docs") >= min_docs).drop("docs", "in_docs"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("first").cast("bigint")).alias("kept"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = (columns(docs, lang=lang_col, source=source_col)
              .select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
              .join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
              .fillna(0, ["total", "lang_total", "kept"])
              .withColumn("p0", F.when(F.col("kept") > 0, _share("0", "total", "kept")).otherwise(0)))
    groups = materialize(groups)
    shares = materialize(
        kept.join(groups, ["lang", "source"])
        .select("lang", "source", "term", "p0", _share("n", "total", "kept").alias("p"), _share("all", "lang_total", "kept").alias("q")))

    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = groups.select("lang", "source", "p0", "kept").join(others, "lang").where("source <> item")
    base = pairs.select("lang", "source", "item", (F.col("kept") * F.abs(F.col("p0") - F.col("q0"))).alias("value"))

    # For a source's terms against the least share x of another: the sum of |p - x| from running sums over the shares.
    spread = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("n"))
    points = (spread.select("lang", "source", F.lit(None).cast("string").alias("item"), F.col("p").alias("x"), "n",
                            F.lit(0).cast("bigint").alias("p0"))
              .unionByName(pairs.select("lang", "source", "item", F.col("q0").alias("x"), F.lit(0).cast("bigint").alias("n"), "p0")))
    group = Window.partitionBy("lang", "source")
    upto = group.orderBy("x").rangeBetween(Window.unboundedPreceding, 0)
    points = points.withColumns({
        "below": F.sum("n").over(upto), "sum_below": F.sum(F.col("n") * F.col("x")).over(upto),
        "every": F.sum("n").over(group), "sum_every": F.sum(F.col("n") * F.col("x")).over(group)}).where("item IS NOT NULL")
    x = F.col("x")
    one = points.select("lang", "source", "item", (
        F.col("sum_every") - 2 * F.col("sum_below") + x * (2 * F.col("below") - F.col("every"))
        - F.col("every") * F.abs(F.col("p0") - x)).alias("value"))

    postings = shares.select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    both = postings.mapInArrow(_correct, FIXES).select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")

    def turned(df: DataFrame) -> DataFrame:
        return df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")

    distance = (base.unionByName(one).unionByName(turned(one)).unionByName(both).unionByName(turned(both))
                .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    above = (shares.where("p > q").select("lang", "source", F.col("term").cast("string").alias("item"), (F.col("p") - F.col("q")).alias("value")))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))

    def ranked(df: DataFrame, part: str) -> DataFrame:
        return df.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))

    return ranked(distance, "pair").unionByName(ranked(above, "term").where(F.col("rank") <= top))
