"""Byte-level BPE by prefix dynamic programming, and decoding.

Of all ways to end the encoding of a byte prefix, exactly one token is right: the last token of that
prefix's own encoding. The table of these last tokens, one entry per prefix, is the whole state of the
encoder. The entry of a prefix is the token ``t`` that ends there and fits the entry before it, where
two tokens fit if byte pair encoding would leave their joined bytes as these two tokens. Walking the
table back from the end gives the encoding.

As an entry depends on nothing to its right, appending bytes only adds entries, and after an edit the
entries are made anew only until they agree again with the old ones for the length of the longest token.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable
from itertools import chain, islice

import regex
from pyspark.sql import DataFrame

from kgspark.llm.common import columns, prepare, text_map


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with one ``base64-token rank`` pair a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Tokens by rank, which of them merging can reach, and which fit side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.halves: dict[int, tuple[int, int]] = {}
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1 and (two := self._last_merge(token, i)):
                self.halves[i] = two
        reachable = {t: i for t, i in ranks.items() if len(t) == 1 or i in self.halves}
        # Every end of a token, with its own rank if it is a token, else -1.
        self.tails = {t[k:]: -1 for t in reachable for k in range(len(t))} | reachable
        self.fitting: dict[tuple[int, int], bool] = {}

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None if merging its bytes never gives it."""
        parts = [token[k:k + 1] for k in range(len(token))]
        while len(parts) > 2:
            best, at = rank, -1
            for k in range(len(parts) - 1):
                r = self.ranks.get(parts[k] + parts[k + 1])
                if r is not None and r < best:
                    best, at = r, k
            if at < 0:
                return None
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        a, b = self.ranks.get(parts[0]), self.ranks.get(parts[1])
        return None if a is None or b is None else (a, b)

    def endings(self, data: bytes, end: int) -> list[tuple[int, int]]:
        """The tokens that end there, as (start, token), shorter ones first."""
        tail, found, start = self.tails.get, [], end - 1
        while start >= 0 and (token := tail(data[start:end])) is not None:
            if token >= 0:
                found.append((start, token))
            start -= 1
        return found

    def fit(self, left: int, right: int) -> bool:
        """Whether the bytes of two tokens, encoded together, stay these two tokens.

        Both merges are undone step by step, the later one first. At each step the pair that then meets
        at the border must not have a merge that would have come before the merge just undone.
        """
        known = self.fitting.get((left, right))
        if known is None:
            if len(self.fitting) > 1_000_000:
                self.fitting.clear()
            known = self.fitting[left, right] = self._fit(left, right)
        return known

    def _fit(self, left: int, right: int) -> bool:
        tokens, halves, before = self.tokens, self.halves, float("inf")
        while True:
            joined = self.ranks.get(tokens[left] + tokens[right])
            if joined is not None and joined < before:
                return False
            # The token made later is taken apart; of two equal ones, the left was made first.
            a, b = left if left in halves else -1, right if right in halves else -1
            if a < 0 and b < 0:
                return True
            if a > b:
                before, left = a, halves[left][1]
            else:
                before, right = b + 1, halves[right][0]


class PrefixTable:
    """The last tokens of all prefixes of a byte string, kept through appends and edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _entry(self, end: int) -> int:
        voc, last = self.vocabulary, self.last
        for start, token in reversed(voc.endings(self.data, end)):  # the longest is the most likely
            if start == 0 or voc.fit(last[start - 1], token):
                return token
        raise ValueError("the ranks lack a single byte")

    def append(self, more: bytes) -> PrefixTable:
        start, self.data = len(self.data), self.data + more
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(self._entry(end))
        return self

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of bytes ``start`` to ``stop``; the number of entries that were made anew."""
        old, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last, same, made = old[:start], 0, 0
        for end in range(start + 1, len(self.data) + 1):
            if same >= self.vocabulary.longest:
                self.last += old[end - 1 - shift:]
                break
            self.last.append(self._entry(end))
            made += 1
            was = end - 1 - shift
            same = same + 1 if end > start + len(new) and old[was] == self.last[-1] else 0
        return made

    def tokens(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.tokens[out[-1]])
        return out[::-1]


class _Last(dict):
    """The last token of a prefix, by its bytes: an entry that all pieces with this prefix share.

    Only the entries that the walk back from a piece's end asks for are made.
    """

    def __init__(self, vocabulary: Vocabulary, limit: int):
        super().__init__()
        self.vocabulary, self.limit = vocabulary, limit

    def __missing__(self, data):
        voc = self.vocabulary
        for start, token in reversed(voc.endings(data, len(data))):
            if start == 0 or voc.fit(self[data[:start]], token):
                if len(self) >= self.limit:
                    self.clear()
                self[data] = token
                return token
        raise ValueError("the ranks lack a single byte")


class _Pieces(dict):
    """Tokens of a piece of text; merged pieces are kept up to a limit."""

    def __init__(self, vocabulary: Vocabulary, limit: int):
        super().__init__()
        self.vocabulary, self.limit, self.last = vocabulary, limit, _Last(vocabulary, limit)

    def _walk(self, data: bytes) -> tuple[int, ...]:
        out, last, tokens = [], self.last, self.vocabulary.tokens
        while data:
            out.append(last[data])
            data = data[:-len(tokens[out[-1]])]
        return tuple(out[::-1])

    def __missing__(self, piece):
        data = piece.encode()
        whole = self.vocabulary.ranks.get(data)  # a piece that is itself a token is that token
        if whole is not None:
            ids = (whole,)
        else:
            ids = self._walk(data) if len(data) <= 64 else tuple(PrefixTable(self.vocabulary, data).tokens())
        if len(piece) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = ids
        return ids


class ByteBPE:
    """Encodes and decodes text. ``remembered``: how many encoded pieces, and prefixes, are kept in memory."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = 800_000):
        self.vocabulary, self.pattern = Vocabulary(ranks), regex.compile(pattern)
        self.pieces = _Pieces(self.vocabulary, remembered)

    def runs(self, text: str, size: int = 1 << 16) -> Iterable[list[int]]:
        """The ids of a text, in runs of ``size`` pieces."""
        found = (m.group() for m in self.pattern.finditer(text)) if len(text) > 1 << 20 else iter(self.pattern.findall(text))
        while part := list(islice(found, size)):
            yield list(chain.from_iterable(map(self.pieces.__getitem__, part)))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.runs(text)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids))

    def append(self, text: str, ids: list[int], more: str) -> list[int]:
        """The ids of ``text + more`` from those of ``text``: all but its last two pieces are kept."""
        starts = [0]
        for m in self.pattern.finditer(text):
            starts.append(m.start())
        at = starts[-2] if len(starts) > 2 else 0
        kept, n = len(text[:at].encode()), 0
        while kept > 0:
            kept -= len(self.vocabulary.tokens[ids[n]])
            n += 1
        return ids[:n] + self.encode(text[at:] + more)


_ENCODERS: dict[tuple, ByteBPE] = {}


def _encoder(key, ranks, pattern) -> ByteBPE:
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = ByteBPE(ranks, pattern)
    return _ENCODERS[key]


def _sent(spark, rank_file, pattern):
    """The ranks, read on the driver and sent to the tasks; they are bounded by the vocabulary."""
    ranks = read_ranks(rank_file)
    return spark.sparkContext.broadcast(((len(ranks), hash(frozenset(ranks.items())), pattern), ranks, pattern))


def encode(docs: DataFrame, rank_file: str, pattern: str, *, decoded: bool = False, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``n_tokens`` and ``ids``, the token ids of the whole text, without special
    tokens; with ``decoded`` also ``decoded_sha256``, of the bytes that the ids decode to.

    A null or empty text has no ids; null ids and repeated rows are kept; other columns are ignored; an empty table
    gives an empty one.
    """
    spark = prepare(docs.sparkSession)
    id_type = docs.select(f"`{id_col}`").schema[0].dataType.simpleString()
    sent = _sent(spark, rank_file, pattern)

    def make():
        bpe = _encoder(*sent.value)

        def each(i, text):
            ids = bpe.encode(text)
            return (i, len(ids), ids, *([hashlib.sha256(bpe.decode(ids)).hexdigest()] if decoded else []))
        return each

    return text_map(columns(docs, id=id_col, text=text_col), f"`{id_col}` {id_type}, n_tokens bigint, ids array<int>"
                    + (", decoded_sha256 string" if decoded else ""), make)


def decode(encoded: DataFrame, rank_file: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``encoded``: its id and ``decoded``, the bytes of its ids: none for a null or empty list, null
    where an id is null or not in the vocabulary. Repeated rows and null row ids are kept; an empty table gives an empty one."""
    spark = prepare(encoded.sparkSession)
    id_type = encoded.select(f"`{id_col}`").schema[0].dataType.simpleString()
    sent = _sent(spark, rank_file, "")

    def make():
        tokens = {i: t for t, i in sent.value[1].items()}

        def each(i, ids):
            parts = [tokens.get(t) for t in ids or ()]
            return i, None if None in parts else b"".join(parts)

        return each

    return text_map(columns(encoded, id=id_col, text=ids_col), f"`{id_col}` {id_type}, decoded binary", make)


def round_trip(docs: DataFrame, rank_file: str, pattern: str, *, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Encodes every whole text and decodes the ids: id, ``n_tokens``, ``ids_sha256`` (of the decimal ids
    joined by commas), ``decoded_sha256`` (of the decoded bytes).

    Texts are encoded and hashed in runs of pieces, so that a very long text needs no list of all its
    ids. A null or empty text has no tokens and the hashes of the empty string; null ids and repeated rows
    are kept; other columns are ignored; an empty table gives an empty one.
    """
    spark = prepare(docs.sparkSession)
    id_type = docs.select(f"`{id_col}`").schema[0].dataType.simpleString()
    sent = _sent(spark, rank_file, pattern)

    def make():
        bpe = _encoder(*sent.value)
        shown = {i: str(i) for i in bpe.vocabulary.tokens}

        def each(i, text):
            n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
            for ids in bpe.runs(text):
                if n:
                    ids_hash.update(b",")
                n += len(ids)
                ids_hash.update(",".join(map(shown.__getitem__, ids)).encode())
                text_hash.update(bpe.decode(ids))
            return i, n, ids_hash.hexdigest(), text_hash.hexdigest()
        return each

    return text_map(columns(docs, id=id_col, text=text_col),
                    f"`{id_col}` {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", make)
