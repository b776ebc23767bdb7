"""Blocks of documents that ask questions about keys, and get answers about all documents.

Operators that compare every position of a corpus with every other cannot afford a row per position. Here
documents are packed into blocks of some megabytes, written once and compressed. Each block sends the
sorted, distinct keys it asks about, cut into ranges of keys; the parts of one range meet in a group, which
knows everything about its keys; each part's answers go back in the order of its keys, so that they need
no keys of their own. The block is then read again together with its answers.

A key is sent once per block, however often the block has it, so that a hot key has one entry for some
megabytes of text. Ranges are as many as keep a group small. Blocks are stored in buckets by their
number, so that joining them with answers moves only the answers.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import columns, prepare, scratch_dir

BLOCK_BYTES = 8 << 20
SENT_BYTES = 4 << 20  # of questions that are sent on together
NO_ID = np.iinfo(np.int64).max  # stands for a null id, after all others

_BLOCK = pa.schema([("block", pa.int64()), ("n_bytes", pa.int64()), ("n_words", pa.int64()), ("ids", pa.binary()),
                    ("sizes", pa.binary()), ("data", pa.binary())])
_ASKED = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()),
                    ("more", pa.binary())])
_TOLD = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("part", pa.int64()), ("answer", pa.binary())])
ASKED = "part bigint, block bigint, kind int, keys binary, more binary"
TOLD = "block bigint, kind int, part bigint, answer binary"


@dataclass
class Block:
    """Some documents: their ids, and their texts as one run of bytes, text k from starts[k] to starts[k + 1]."""
    number: int
    ids: np.ndarray
    starts: np.ndarray
    data: bytes

    def texts(self) -> Iterator[bytes]:
        for a, b in zip(self.starts, self.starts[1:]):
            yield self.data[a:b]


def _pack(batches, block_bytes: int):
    part, count, ids, texts, held = TaskContext.get().partitionId(), 0, [], [], 0

    def row():
        data = b"".join(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        words = sum(len(t.split()) for t in texts)
        values = [(part << 32) + count, len(data), words, np.array(ids, np.int64).tobytes(), sizes.tobytes(),
                  zstandard.ZstdCompressor(level=3).compress(data)]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _BLOCK)], schema=_BLOCK)

    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = (t or "").encode()
            if texts and held + len(text) > block_bytes:
                yield row()
                count, ids, texts, held = count + 1, [], [], 0
            ids.append(NO_ID if i is None else i)
            texts.append(text)
            held += len(text)
    if texts:
        yield row()


def pack(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents as a table of blocks in the shared folder. Ids are whole numbers; null texts are empty.

    The table is registered under a name of its own, as buckets need one. Results read it when they are read, so
    it stays until ``forget`` is called, or until the program ends if its session is still there.
    """
    spark = prepare(docs.sparkSession)
    d = columns(docs, id=id_col, text=text_col).select(F.col("id").cast("bigint").alias("id"), "text")
    rows = d.mapInArrow(lambda batches: _pack(batches, block_bytes),
                        "block bigint, n_bytes bigint, n_words bigint, ids binary, sizes binary, data binary")
    name = f"kg_blocks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (rows.write.format("parquet").option("path", f"{scratch_dir(spark)}/{name}").option("compression", "none")
     .bucketBy(buckets, "block").saveAsTable(name))
    _MADE.append((spark, name))
    return spark.table(name)


_MADE: list[tuple] = []


def forget() -> None:
    """Drop the tables of blocks that this program made, and their files."""
    while _MADE:
        spark, name = _MADE.pop()
        with contextlib.suppress(Exception):  # the session may have ended before
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/{name}")
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


atexit.register(forget)


def unpack(batches) -> Iterator[tuple[Block, dict]]:
    """The blocks of Arrow batches, with the other columns of their rows."""
    for batch in batches:
        for row in batch.to_pylist():
            sizes = np.frombuffer(row["sizes"], np.int64)
            data = zstandard.ZstdDecompressor().decompress(row["data"], max_output_size=max(1, row["n_bytes"]))
            yield Block(row["block"], np.frombuffer(row["ids"], np.int64), np.concatenate(([0], np.cumsum(sizes))), data), row


def shrink(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def grow(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_numbers(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed: planes of small numbers shrink to nothing."""
    return shrink(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes())


def unpack_numbers(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(grow(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return pack_numbers(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_numbers(data, np.uint64), dtype=np.uint64)


def cuts(parts: int, bits: int) -> np.ndarray:
    """Where ranges of keys of so many bits begin, but for the first."""
    return np.array([(k << bits) // parts for k in range(1, parts)], np.uint64)


def ranges(keys: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The ranges that sorted keys fall into, with their slices."""
    at = np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))
    for k in np.flatnonzero(np.diff(at)):
        yield int(k), slice(int(at[k]), int(at[k + 1]))


def ask(blocks: DataFrame, questions: Callable[[Block, dict], Iterable[tuple[int, int, bytes, bytes]]],
        answers: Callable[[int, list[tuple[bytes, bytes]]], list[bytes]]) -> DataFrame:
    """``answers``, the list of a block's answers, one row per block that asked.

    ``questions`` gives (range, kind, keys, more) for a block and its row; ``answers`` gets the kind and
    all (keys, more) of one range and kind, and gives an answer to each.
    """
    def put(batches):
        for block, row in unpack(batches):
            rows, held = [], 0
            for part, kind, keys, more in questions(block, row):
                rows.append((part, block.number, kind, keys, more))
                held += len(keys) + len(more)
                if held > SENT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ASKED)], schema=_ASKED)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ASKED)], schema=_ASKED)

    def settle(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = []
        for kind in sorted({r["kind"] for r in rows}):
            mine = [r for r in rows if r["kind"] == kind]
            told = answers(kind, [(r["keys"], r["more"]) for r in mine])
            out += [{"block": r["block"], "kind": kind, "part": r["part"], "answer": a} for r, a in zip(mine, told)]
        return pa.Table.from_pylist(out, schema=_TOLD)

    told = blocks.mapInArrow(put, ASKED).groupBy("part").applyInArrow(settle, TOLD)
    return told.groupBy("block").agg(F.collect_list(F.struct("kind", "part", "answer")).alias("answers"))


def told(row: dict, kind: int) -> list[bytes]:
    """A block's answers of a kind, in the order of its ranges."""
    return [a["answer"] for a in sorted(row["answers"] or (), key=lambda a: a["part"]) if a["kind"] == kind]
