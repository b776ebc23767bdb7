"""Token counts of whole texts under a sentencepiece BPE model, by a whole-token shortcut.

Two facts are proven once, from the model alone, before any text is read:

* **Cuts.** If the model leaves characters as they are, puts one space mark before the text, and has
  no piece in which a space mark follows another character, then no merge ever crosses from a
  character to a following space mark. The text can be cut there and the counts of the parts added.
* **Whole tokens.** Every vocabulary string that starts with a space mark is encoded alone; those that
  come out as one token are counted as one wherever they are a whole part.

Parts that are whole tokens are counted by a set lookup; only the rest goes through the merges. A
model for which the first fact does not hold has its texts encoded whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import sentencepiece
from pyspark.sql import DataFrame

from kgspark.llm.common import columns, prepare, text_map

MARK = "▁"


@dataclass(frozen=True)
class Proof:
    """``whole``: parts, without their first space mark, that are one token; ``cuts``: whether texts may be cut."""
    cuts: bool
    whole: frozenset[str]


def prove(model: bytes) -> Proof:
    """What holds for this model, found by reading it and by encoding each vocabulary string alone."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    parsed = pb.ModelProto()
    parsed.ParseFromString(model)
    norm, train = parsed.normalizer_spec, parsed.trainer_spec
    normal, user = 1, 4
    pieces = [p.piece for p in parsed.pieces if p.type == normal]
    cuts = (train.model_type == train.BPE and not norm.precompiled_charsmap and norm.add_dummy_prefix
            and not norm.remove_extra_whitespaces and norm.escape_whitespaces
            and not train.treat_whitespace_as_suffix
            and not any(p.type == user for p in parsed.pieces) and MARK in pieces
            and not any(MARK in p.lstrip(MARK) for p in pieces))
    if not cuts:
        return Proof(False, frozenset())
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    alone = [p[1:] for p in pieces if p.startswith(MARK) and p != MARK]
    ids = sp.encode([p.replace(MARK, " ") for p in alone])
    # A part that is only the space mark is that one vocabulary string.
    return Proof(True, frozenset([p for p, got in zip(alone, ids) if len(got) == 1] + [""]))


class _Counts(dict):
    """Tokens of a part, by the part without its first space mark."""

    def __init__(self, sp, whole, limit):
        super().__init__()
        self.sp, self.whole, self.limit = sp, whole, limit
        self.reset()

    def reset(self):
        self.clear()
        self.update(dict.fromkeys(self.whole, 1))

    def __missing__(self, part):
        n = len(self.sp.encode(part.replace(MARK, " ")))
        if len(part) <= 64:
            if len(self) >= self.limit:
                self.reset()
            self[part] = n
        return n


class TokenCounter:
    """Counts the tokens of a text. ``remembered``: how many merged parts are kept in memory."""

    def __init__(self, model: bytes, proof: Proof | None = None, remembered: int = 400_000):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.proof = proof or prove(model)
        self.counts = _Counts(self.sp, self.proof.whole, remembered)
        self.runs = re.compile(f"{MARK}({MARK}*[^{MARK}]*)")

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.proof.cuts:
            return len(self.sp.encode(text))
        marked = text.replace(" ", MARK)
        parts = marked.split(MARK)
        if "" in parts:  # runs of spaces belong to the part after them
            parts = self.runs.findall(MARK + marked)
        return sum(map(self.counts.__getitem__, parts))


_COUNTERS: dict[int, TokenCounter] = {}


def token_counts(docs: DataFrame, model_file: str, *, limit: int = 4096, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (n_tokens > limit).

    Tokens are those of the library's plain ``encode``: no begin or end tokens, no truncation, strings
    that look like special tokens are text. A null or empty text has 0 bytes and 0 tokens; null ids and
    repeated rows are kept as they are; other columns are ignored; an empty table gives an empty one.
    The model file is read on the driver and sent to the tasks; it is bounded by its vocabulary.
    """
    spark = prepare(docs.sparkSession)
    id_type = docs.select(f"`{id_col}`").schema[0].dataType.simpleString()
    with open(model_file, "rb") as f:
        model = f.read()
    sent = spark.sparkContext.broadcast((hash(model), model, prove(model)))

    def make():
        key, data, proof = sent.value
        if key not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[key] = TokenCounter(data, proof)
        count = _COUNTERS[key].count

        def each(i, text):
            n = count(text)
            return i, len(text.encode()), n, n > limit
        return each

    return text_map(columns(docs, id=id_col, text=text_col),
                    f"`{id_col}` {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean", make)
