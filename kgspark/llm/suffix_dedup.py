"""Removal of byte strings that already stand in an earlier document, by sparse suffix arrays.

A byte goes if it lies in a string of ``length`` bytes that also starts in a document with a smaller id.

* **Anchors.** Each window of ``length`` bytes is owned by the least, by 32 bits of a hash, of its strings of
  ``length // 2`` bytes. Equal windows have equal owners at equal places, so that only suffixes near equal anchors need to
  meet. Blocks of documents first ask which of their anchors stand in more than one document; only windows
  of those are looked at further.
* **Index family.** The windows of a range of anchors arrive in batches. A batch becomes a suffix array: its
  window starts, sorted by their first eight bytes and then by a fingerprint of the others. Levels of like
  size are merged, so that there are a logarithmic number of them and each window is moved as often; in
  a merge, equal windows of both sides meet and take on the least id.
* **Hot anchors.** A string that very many documents hold may stand in as many surroundings. Its windows are
  dealt one by one, by their own hash. Within a block, equal spans are sent once, for their least id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.blocks import (NO_ID, Block, ask, cuts, grow, pack, pack_keys, pack_numbers, ranges, shrink, told, unpack,
                                unpack_keys, unpack_numbers)
from kgspark.llm.common import materialize, prepare

PART_BYTES = 4 << 20  # text per range of anchors
PIECE = 1 << 16  # bytes whose anchors are found together
BATCH = 1 << 20  # windows of a suffix array when it enters the index family
HOT = 4096  # documents with an anchor, from which its windows are dealt one by one
_FACTORS = [np.uint64(f | 1) for f in (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
    0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_OUT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                  ("kept_sha256", pa.string())])


def _words(data: bytes, dtype: str = "<u8") -> np.ndarray:
    """The eight bytes from each position on, as one number each; the data must end with eight spare bytes."""
    return np.ndarray((len(data) - 7,), dtype, data, strides=(1,))


def _hash(words: np.ndarray, size: int, at, skip: int = 0) -> np.ndarray:
    """Hashes of the ``size`` bytes from positions or a slice on, without the first ``skip``."""
    places = [*range(skip, size - 7, 8)]
    if places[-1] + 8 < size:
        places.append(size - 8)
    total = None
    for k, p in enumerate(places):
        part = words[at.start + p:at.stop + p] if isinstance(at, slice) else words[at + p]
        part = part * _FACTORS[k % 8]
        if k >= 8:
            part = part * _FACTORS[k // 8 % 8]
        total = part if total is None else total + part
    total = (total ^ (total >> np.uint64(32))) * _FACTORS[3]
    return total ^ (total >> np.uint64(29))


def _fingerprint(words: np.ndarray, size: int, at: np.ndarray, skip: int = 0) -> np.ndarray:
    """Like ``_hash``, for comparing windows: each word is mixed by itself before it is added, and
    what was added before is multiplied again, so that differences in two words do not cancel."""
    places = [*range(skip, size - 7, 8)]
    if places[-1] + 8 < size:
        places.append(size - 8)
    total = np.zeros(len(at), np.uint64)
    for k, p in enumerate(places):
        part = words[at + p] * _FACTORS[k % 8]
        part ^= part >> np.uint64(32)
        part *= _FACTORS[(k + 3) % 8]
        part ^= part >> np.uint64(29)
        part *= _FACTORS[(k + 5) % 8]
        part ^= part >> np.uint64(32)
        total = total * _FACTORS[5] + part
    total = (total ^ (total >> np.uint64(32))) * _FACTORS[3]
    return total ^ (total >> np.uint64(29))


def _spread(hashes: np.ndarray) -> np.ndarray:
    """Hashes of anchors, which are the least of many, spread over all numbers again, one to one."""
    hashes = (hashes ^ (hashes >> np.uint64(31))) * _FACTORS[4]
    return hashes ^ (hashes >> np.uint64(32))


@dataclass
class Runs:
    """Runs of consecutive windows of a document that one anchor owns: first window, how many, the
    anchor's hash, the document."""
    first: np.ndarray
    size: np.ndarray
    anchor: np.ndarray
    doc: np.ndarray


def runs(block: Block, length: int) -> Runs:
    """The runs of a block, in order. They depend on the bytes of each document alone."""
    gram, data = length // 2, block.data + bytes(64)
    wide, words, found = length - gram + 1, _words(data), []
    n_bytes = len(block.data)
    doc_of = block.starts[1:]
    for lo in range(0, max(0, n_bytes - length + 1), PIECE):
        hi = min(lo + PIECE, n_bytes - length + 1)  # windows lo to hi
        hashes = _hash(words, gram, slice(lo, hi + wide - 1))
        least, where = (hashes >> np.uint64(32)).astype(np.uint32), np.arange(len(hashes), dtype=np.int32)
        reach = 1
        while reach < wide:  # the least, or the first of equal ones, of twice as many until a whole window is seen
            step = min(reach, wide - reach)
            left, right = least[:-step], least[step:]
            where = np.where(right < left, where[step:], where[:-step])
            least = np.minimum(left, right)
            reach += step
        from_doc, to_doc = np.searchsorted(doc_of, (lo, hi - 1), side="right")
        doc = np.repeat(np.arange(from_doc, to_doc + 1), np.diff(np.clip(block.starts[from_doc:to_doc + 2], lo, hi)))
        inside = np.flatnonzero(np.arange(lo, hi) + length <= doc_of[doc])
        if not len(inside):
            continue
        own = where[inside]
        start = np.flatnonzero(np.concatenate(([True], (np.diff(own) != 0) | (np.diff(inside) != 1))))
        size = np.diff(np.concatenate((start, [len(inside)])))
        found.append((inside[start] + lo, size, _spread(hashes[own[start]]), doc[inside[start]]))
    if not found:
        return Runs(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return Runs(*(np.concatenate(c) for c in zip(*found)))


def _distinct(r: Runs, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of a block in order, in how many documents each is, and the rank of each run's anchor."""
    order = np.lexsort((ids[r.doc], r.anchor))
    anchor, doc = r.anchor[order], ids[r.doc][order]
    new = np.concatenate(([True], np.diff(anchor) != 0)) if len(anchor) else np.zeros(0, bool)
    other = new | np.concatenate(([True], np.diff(doc) != 0)) if len(anchor) else new
    rank = np.cumsum(new) - 1
    back = np.empty(len(order), np.int64)
    back[order] = rank
    return anchor[new], np.bincount(rank, other).astype(np.int64) if len(rank) else np.zeros(0, np.int64), back


def _anchor_answers(parts: list[tuple[bytes, bytes]]) -> list[bytes]:
    """For each anchor: 0 if one document has it, 1 if several, 2 if very many."""
    keys = [unpack_keys(k) for k, _ in parts]
    every, docs = np.concatenate(keys), np.concatenate([unpack_numbers(m, np.int64) for _, m in parts])
    order = np.argsort(every)
    starts = np.flatnonzero(np.concatenate(([True], np.diff(every[order]) != 0)))
    total = np.add.reduceat(docs[order], starts)
    said = np.empty(len(every), np.uint8)
    said[order] = np.repeat((total > 1).astype(np.uint8) + (total > HOT), np.diff(np.concatenate((starts, [len(every)]))))
    return [shrink(a.tobytes()) for a in np.split(said, np.cumsum([len(k) for k in keys])[:-1])]


class Family:
    """Levels of suffix arrays. A level holds windows in order: first bytes, fingerprint, id, and where
    each one came from."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    @staticmethod
    def _sorted(columns: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        order = np.lexsort((columns[1], columns[0]))
        head, rest, ids, came = (c[order] for c in columns)
        starts = np.flatnonzero(np.concatenate(([True], (np.diff(head) != 0) | (np.diff(rest) != 0))))
        least = np.minimum.reduceat(ids, starts)
        return head, rest, np.repeat(least, np.diff(np.concatenate((starts, [len(head)])))), came

    def add(self, head: np.ndarray, rest: np.ndarray, ids: np.ndarray) -> None:
        """A batch becomes a level; levels of like size are merged."""
        if not len(head):
            return
        self.levels.append(self._sorted((head, rest, ids, np.arange(self.size, self.size + len(head)))))
        self.size += len(head)
        while len(self.levels) > 1 and 2 * len(self.levels[-1][0]) >= len(self.levels[-2][0]):
            self._merge()

    def _merge(self) -> None:
        a, b = self.levels.pop(), self.levels.pop()
        self.levels.append(self._sorted(tuple(np.concatenate(c) for c in zip(a, b))))

    def least(self) -> np.ndarray:
        """The least id of each window, in the order they were added."""
        while len(self.levels) > 1:
            self._merge()
        out = np.empty(self.size, np.int64)
        for _, _, ids, came in self.levels:
            out[came] = ids
        return out


def _starts(size: np.ndarray, length: int) -> np.ndarray:
    """Where the windows of spans stand that follow each other, spans of ``size`` windows each."""
    span = np.cumsum(size + length - 1) - (size + length - 1)
    first = np.cumsum(size) - size
    return np.repeat(span - first, size) + np.arange(size.sum())


def _window_answers(parts: list[tuple[bytes, bytes]], length: int) -> list[bytes]:
    """For each span: which of its windows also stand in a document with a smaller id, as bits."""
    family, owners, counts, held, n = Family(), [], [], [], 0

    def flush():
        nonlocal held, n
        if held:
            family.add(*(np.concatenate(c) for c in zip(*held)))
        held, n = [], 0

    for meta, data in parts:
        m = unpack_numbers(meta, np.int64).reshape(2, -1)
        size, ids = m[0], np.repeat(m[1], m[0])
        at, padded = _starts(size, length), grow(data) + bytes(64)
        held.append((_words(padded, ">u8")[at].astype(np.uint64), _fingerprint(_words(padded), length, at, 8), ids))
        owners.append(ids)
        counts.append(len(ids))
        n += len(ids)
        if n >= BATCH:
            flush()
    flush()
    earlier = family.least() < np.concatenate(owners)
    return [shrink(np.packbits(e).tobytes()) for e in np.split(earlier, np.cumsum(counts)[:-1])]


@dataclass
class Spans:
    """What a block asks about windows: spans in the order of their ranges, and what each run has of them."""
    part: np.ndarray
    first: np.ndarray
    size: np.ndarray
    id: np.ndarray
    window: np.ndarray  # index of the window among the block's candidate windows
    asked: np.ndarray  # of each candidate window: its place among the windows asked about
    settled: np.ndarray  # of each candidate window: whether a smaller id of the same block has its span


def _spans(block: Block, r: Runs, codes: np.ndarray, length: int, edges: np.ndarray) -> Spans:
    words = _words(block.data + bytes(64))
    many, hot = codes == 1, np.flatnonzero(codes == 2)
    single = np.repeat(r.first[hot] - (np.cumsum(r.size[hot]) - r.size[hot]), r.size[hot]) + np.arange(r.size[hot].sum())
    first = np.concatenate((r.first[many], single))
    size = np.concatenate((r.size[many], np.ones(len(single), np.int64)))
    ids = block.ids[np.concatenate((r.doc[many], np.repeat(r.doc[hot], r.size[hot])))]
    head, tail = _fingerprint(words, length, first), _fingerprint(words, length, first + size - 1)
    with np.errstate(over="ignore"):
        content = head * _FACTORS[1] + tail * _FACTORS[2] + size.astype(np.uint64)
    key = np.concatenate((r.anchor[many], head[len(r.first[many]):]))
    # Equal spans are asked about once, for their least id.
    order = np.lexsort((ids, content, key))
    new = np.concatenate(([True], (np.diff(content[order]) != 0) | (np.diff(key[order]) != 0))) if len(order) else np.zeros(0, bool)
    chosen = order[new]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    begin = np.cumsum(size[chosen]) - size[chosen]
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return Spans(np.searchsorted(edges, key[chosen], side="right"), first[chosen], size[chosen], ids[chosen],
                 np.repeat(first, size) + within, np.repeat(begin[rank], size) + within,
                 np.repeat(ids > ids[chosen][rank], size))


def _cut(data: bytes, first: np.ndarray, size: np.ndarray, length: int) -> bytes:
    """The bytes of spans, one after the other."""
    n = size + length - 1
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.frombuffer(data, np.uint8)[at].tobytes()


def _judged(docs: DataFrame, length: int, id_col: str, text_col: str) -> tuple[DataFrame, np.ndarray]:
    """Blocks of documents with the answers about their anchors and windows, and the ranges of anchors."""
    blocks = pack(docs, id_col, text_col)
    size = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    edges = cuts(max(1, -(-size // PART_BYTES)), 64)

    def ask_anchors(block, row):
        anchors, docs_with, _ = _distinct(runs(block, length), block.ids)
        for part, here in ranges(anchors, edges):
            yield part, 1, pack_keys(anchors[here]), pack_numbers(docs_with[here])

    def ask_windows(block, row):
        s = _spans(block, *_coded(block, row, length), length, edges)
        for part in np.unique(s.part):
            here = s.part == part
            yield int(part), 2, pack_numbers(np.concatenate((s.size[here], s.id[here]))), shrink(_cut(block.data, s.first[here], s.size[here], length))

    # Which anchors are repeated is needed twice; it is written, as asking again would cost more.
    anchors = materialize(ask(blocks, ask_anchors, lambda kind, parts: _anchor_answers(parts)))
    first = blocks.join(anchors, "block", "left")
    second = ask(first, ask_windows, lambda kind, parts: _window_answers(parts, length))
    return first.join(second.withColumnRenamed("answers", "windows"), "block", "left"), edges


def _coded(block: Block, row: dict, length: int) -> tuple[Runs, np.ndarray]:
    r = runs(block, length)
    codes = np.frombuffer(b"".join(map(grow, told(row, 1))), np.uint8)
    return r, codes[_distinct(r, block.ids)[2]] if len(codes) else np.zeros(0, np.uint8)


def _found(block: Block, row: dict, length: int, edges: np.ndarray) -> np.ndarray:
    """Which bytes of a block go."""
    s = _spans(block, *_coded(block, row, length), length, edges)
    bits = []
    answers = told({"answers": row["windows"]}, 2)
    per_part = np.bincount(s.part, s.size).astype(np.int64)
    for answer, n in zip(answers, per_part[per_part > 0]):
        bits.append(np.unpackbits(np.frombuffer(grow(answer), np.uint8), count=n))
    earlier = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
    gone = s.window[s.settled | earlier[s.asked]] if len(s.window) else s.window
    steps = np.bincount(gone, minlength=len(block.data) + 1) - np.bincount(gone + length, minlength=len(block.data) + 1)
    return np.cumsum(steps[:len(block.data)]) > 0


def dedup(docs: DataFrame, *, length: int = 50, texts: bool = False, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and
    ``kept_sha256`` (of the remaining bytes); with ``texts`` also ``kept``, the remaining bytes.

    Every whole text counts as UTF-8 bytes; strings are judged on the input and never cross documents. A
    null or empty text has no bytes. Ids are whole numbers; a null id counts as greater than all others and
    stays null; rows with equal ids do not remove each other's bytes. Other columns are ignored; an
    empty table gives an empty one. ``length`` is at least 16.
    """
    prepare(docs.sparkSession)
    found, edges = _judged(docs, length, id_col, text_col)
    schema = _OUT.append(pa.field("kept", pa.binary())) if texts else _OUT

    def judge(batches) -> Iterator[pa.RecordBatch]:
        for block, row in unpack(batches):
            gone = _found(block, row, length, edges)
            data, rows = np.frombuffer(block.data, np.uint8), []
            for i, a, b in zip(block.ids.tolist(), block.starts, block.starts[1:]):
                mask = gone[a:b]
                kept = data[a:b][~mask].tobytes() if mask.any() else block.data[a:b]
                spans = int(np.count_nonzero(mask[1:] & ~mask[:-1]) + mask[:1].sum())
                rows.append((None if i == NO_ID else i, int(b - a), int(mask.sum()), spans,
                             hashlib.sha256(kept).hexdigest(), *([kept] if texts else [])))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    out = found.mapInArrow(judge, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
                           + (", kept binary" if texts else ""))
    return out.withColumnRenamed("id", id_col)
