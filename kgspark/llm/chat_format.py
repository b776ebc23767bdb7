r"""Conversations as training texts, in a grammar that is read back before anything is kept.

    text    :=  turn*
    turn    :=  "### " role ":\n" body "\n</turn>\n"
    control :=  backslashes ( "### " role ":"  |  "</turn>" )

Controls without a backslash are marks of the grammar. A control after n backslashes is text, and stands for
itself after n - 1. So a text needs no change unless it holds a control, and every text can be written. In
roles, blanks, control characters and ``: < # \ %`` are written as ``%`` and two hex digits.

Each turn is rendered as it is, parsed again and compared with its source; as long as the two differ, the controls
in it take one more backslash. A rendered turn parses by itself, whatever stands around it, so the turns of a
conversation are checked in any order and then put together.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import columns, prepare, rows_of

END = "</turn>"
_ROLE = r"[^\x00-\x20:<#\\]*"
_CONTROL = re.compile(rf"(\\*)(### {_ROLE}:|{END})")
_HEADER = re.compile(rf"### ({_ROLE}):\n")
_SENT = 4 << 20  # characters of rows that are sent on together

PIECES = "conv bigint, turn bigint, role string, piece string, start bigint, size bigint"
_PIECES = pa.schema([("conv", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("piece", pa.string()),
                     ("start", pa.int64()), ("size", pa.int64())])
FORMATTED = "conv bigint, part int, n_turns bigint, formatted string, mask array<struct<start:bigint,size:bigint>>"
_FORMATTED = pa.schema([("conv", pa.int64()), ("part", pa.int32()), ("n_turns", pa.int64()), ("formatted", pa.string()),
                        ("mask", pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())])))])
_TURNS = pa.schema([("conv", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()),
                    ("loss", pa.bool_())])
_DIGESTS = pa.schema([("conv", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                      ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def unescape(body: str) -> str:
    """What a body, or a span of one that cuts no control, stands for."""
    return _CONTROL.sub(lambda m: m[0][1:], body)


def escape(body: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], body)


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """The turns of a formatted text: role, text, and from where to where the body stands in it.

    Reads from left to right without going back; what the grammar does not know is a ValueError.
    """
    turns, at = [], 0
    while at < len(text):
        head = _HEADER.match(text, at)
        if head is None:
            raise ValueError(f"no turn begins at character {at}")
        begin = at = head.end()
        parts = []
        for m in _CONTROL.finditer(text, begin):
            if not m[1]:
                break
            parts.append(text[at:m.start()] + m[0][1:])
            at = m.end()
        else:
            raise ValueError(f"the turn that begins at character {head.start()} does not end")
        stop = m.start() - 1
        if m[2] != END or stop < at or text[stop] != "\n" or text[m.end():m.end() + 1] != "\n":
            raise ValueError(f"a mark out of place at character {m.start()}")
        parts.append(text[at:stop])
        turns.append((_read_role(head[1]), "".join(parts), begin, stop))
        at = m.end() + 1
    return turns


def _write_role(role: str) -> str:
    return re.sub(r"[\x00-\x20:<#\\%]", lambda m: f"%{ord(m[0]):02x}", role)


def _read_role(role: str) -> str:
    return re.sub(r"%([0-9a-f]{2})", lambda m: chr(int(m[1], 16)), role)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the grammar, and from where to where its body stands in it."""
    head, body, read = f"### {_write_role(role)}:\n", text, None
    while True:
        piece = f"{head}{body}\n{END}\n"
        try:
            read = parse(piece)
        except ValueError:
            read = None
        if read is not None and [t[:2] for t in read] == [(role, text)]:
            return piece, read[0][2], read[0][3]
        harder = escape(body)
        if harder == body:
            raise ValueError(f"a turn of {role!r} cannot be written")
        body = harder


def _batches(rows: Iterator[tuple], schema: pa.Schema, width) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size; ``width`` gives the characters of a row."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += width(row) + 64
        if size > _SENT:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def format_chats(conversations: DataFrame, *, trained: str = "assistant", max_chars: int = 4 << 20, id_col: str = "conv_id",
                 turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id``, ``part``, ``n_turns``, ``formatted`` and ``mask``: conversations as texts, with the spans (code
    points of ``formatted``, bodies as they are written) that a loss counts, those of role ``trained``.

    Turns stand in ascending order, rows with equal turns by role and then by their rendered text; all rows are
    kept, repeated ones too. Conversations are put together row by row in order; one longer than ``max_chars``
    comes in parts, cut between turns and numbered from 0, so that no cell and no task holds more than that and
    one turn. Rows with a null id are one conversation; a null turn stands first; null roles and texts are
    empty ones. Other columns are ignored, and an empty table gives an empty one. The rows of a partition are
    in order, the parts of a conversation one after the other.
    """
    prepare(conversations.sparkSession)
    turns = columns(conversations, conv=id_col, turn=turn_col, role=role_col, text=text_col).select(
        F.col("conv").cast("bigint"), F.col("turn").cast("bigint"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))

    def write(batches):
        def rows():
            for batch in batches:
                for conv, turn, role, text in rows_of(batch, "conv", "turn", "role", "text"):
                    piece, begin, stop = render(role, text)
                    yield conv, turn, role, piece, *((begin, stop - begin) if role == trained else (None, None))
        yield from _batches(rows(), _PIECES, lambda r: len(r[3]))

    def join(batches):
        def rows():
            now, part, pieces, mask, size = None, 0, [], [], 0
            for batch in batches:
                for conv, piece, start, length in rows_of(batch, "conv", "piece", "start", "size"):
                    if pieces and (conv != now or size + len(piece) > max_chars):
                        yield now, part, len(pieces), "".join(pieces), mask
                        part = part + 1 if conv == now else 0
                        pieces, mask, size = [], [], 0
                    now = conv
                    if start is not None:
                        mask.append({"start": size + start, "size": length})
                    pieces.append(piece)
                    size += len(piece)
            if pieces:
                yield now, part, len(pieces), "".join(pieces), mask
        yield from _batches(rows(), _FORMATTED, lambda r: len(r[3]))

    pieces = turns.mapInArrow(write, PIECES).repartition("conv").sortWithinPartitions("conv", "turn", "role", "piece")
    return pieces.mapInArrow(join, FORMATTED).withColumnRenamed("conv", id_col)


def _arranged(formatted: DataFrame, id_col: str, in_order: bool) -> DataFrame:
    out = columns(formatted, conv=id_col, part="part", formatted="formatted", mask="mask")
    return out if in_order else out.repartition("conv").sortWithinPartitions("conv", "part")


def turns_of(formatted: DataFrame, *, id_col: str = "conv_id", in_order: bool = False) -> DataFrame:
    """``conv_id``, ``place`` (from 0), ``role``, ``text``, ``loss``: the turns that a reader finds in formatted
    texts, and whether the loss counts them. ``in_order``: as ``format_chats`` gave the rows, and not dealt anew."""
    def read(batches):
        def rows():
            now, place = object(), 0
            for batch in batches:
                for conv, text, mask in rows_of(batch, "conv", "formatted", "mask"):
                    if conv != now:
                        now, place = conv, 0
                    spans = {(m["start"], m["start"] + m["size"]) for m in mask}
                    for role, said, begin, stop in parse(text):
                        yield conv, place, role, said, (begin, stop) in spans
                        place += 1
        yield from _batches(rows(), _TURNS, lambda r: len(r[3]))

    prepare(formatted.sparkSession)
    return (_arranged(formatted, id_col, in_order)
            .mapInArrow(read, "conv bigint, place bigint, role string, text string, loss boolean").withColumnRenamed("conv", id_col))


def digests(formatted: DataFrame, *, id_col: str = "conv_id", in_order: bool = False) -> DataFrame:
    """One row per conversation, from its formatted text alone: ``n_turns``, ``turns_sha256`` (role, line break, text
    and line break of each turn), ``loss_chars`` and ``loss_sha256`` (what stands under the mask, unescaped), and
    ``formatted_chars``. Texts are hashed as they pass by."""
    def read(batches):
        def rows():
            now, state = None, None
            for batch in batches:
                for conv, text, mask in rows_of(batch, "conv", "formatted", "mask"):
                    if state is None or conv != now:
                        if state is not None:
                            yield done(now, state)
                        now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    for role, said, _, _ in parse(text):
                        state[0] += 1
                        state[1].update(f"{role}\n{said}\n".encode())
                    for m in mask:
                        counted = unescape(text[m["start"]:m["start"] + m["size"]])
                        state[2] += len(counted)
                        state[3].update(counted.encode())
                    state[4] += len(text)
            if state is not None:
                yield done(now, state)
        yield from _batches(rows(), _DIGESTS, lambda r: 256)

    def done(conv, state):
        n, turns, chars, loss, size = state
        return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size

    prepare(formatted.sparkSession)
    return _arranged(formatted, id_col, in_order).mapInArrow(
        read, "conv bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
              "formatted_chars bigint").withColumnRenamed("conv", id_col)
