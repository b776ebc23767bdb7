"""A supervised text classifier on hashed word and character n-gram vectors.

Every word, each of its character n-grams, and the event that a word is repeated at once, has a learned
vector, found by hashing. A document is the average of its vectors; a softmax layer over it gives the
probabilities of two classes. All of it is trained by stochastic gradient descent in numpy, on a bounded
sample of labelled documents. For scoring, each vector is reduced to the one number that it adds to the
difference of the two classes.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import columns, prepare, text_map

CHUNK = 1 << 16  # words that are looked at together


@dataclass(frozen=True)
class Shape:
    """``buckets``: hash values (a power of two); the last one stands for a word repeated at once."""
    buckets: int = 1 << 18
    dim: int = 10
    shortest: int = 3
    longest: int = 5


def features(word: bytes, shape: Shape) -> np.ndarray:
    """The buckets of a word: of itself and of its character n-grams, with marks at both ends."""
    marked, mod = b"<" + word + b">", shape.buckets - 1
    grams = [marked[i:i + n] for n in range(shape.shortest, shape.longest + 1) for i in range(len(marked) - n + 1)]
    return np.fromiter((zlib.crc32(g) % mod for g in [marked, *grams]), np.int64, len(grams) + 1)


def counts(text: str, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a whole text, and how often each occurs."""
    words = text.encode("utf-8", "surrogatepass").split()
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    parts = [features(w, shape) for w in seen]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0)
    every = np.concatenate([*parts, [shape.buckets - 1]])
    weight = np.concatenate([np.repeat(list(seen.values()), [len(p) for p in parts]), [repeats]]).astype(float)
    ids, where = np.unique(every, return_inverse=True)
    total = np.bincount(where, weight)
    return ids[total > 0], total[total > 0]


@dataclass
class Model:
    """What scoring needs: the part of each bucket in the difference of the classes, and its constant."""
    shape: Shape
    parts: np.ndarray
    constant: float


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], shape: Shape, *, epochs: int = 8, rate: float = 0.5,
          seed: int = 0) -> Model:
    """The model of rows of (label, buckets, counts), by one step per document and epoch.

    With documents of one class only, the model says how likely the class is; without any, one half.
    """
    rng = np.random.default_rng(seed)
    labels = np.array([r[0] for r in rows], np.int64)
    vectors = rng.uniform(-1 / shape.dim, 1 / shape.dim, (shape.buckets, shape.dim))
    layer = np.zeros((shape.dim + 1, 2))
    ones = labels.sum()
    if ones == 0 or ones == len(labels):
        share = (ones + 1) / (len(labels) + 2)
        return Model(shape, np.zeros(shape.buckets), float(np.log(share / (1 - share))))
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            label, ids, n = rows[k]
            now = rate * (1 - done / steps)
            done += 1
            weight = n / n.sum() if len(n) else n
            mean = np.append(weight @ vectors[ids], 1.0)
            out = mean @ layer
            p = np.exp(out - out.max())
            p /= p.sum()
            p[label] -= 1.0
            back = layer[:-1] @ p
            layer -= now * np.outer(mean, p)
            # The average spreads the step over many vectors; it is scaled up so that each of them moves.
            vectors[ids] -= now * len(ids) ** 0.5 * np.outer(weight, back)
    difference = layer[:, 1] - layer[:, 0]
    return Model(shape, vectors @ difference[:-1], float(difference[-1]))


class Scorer:
    """Scores texts. ``remembered``: how many words are kept in memory with what they add."""

    def __init__(self, model: Model, remembered: int = 600_000):
        self.model, self.limit = model, max(remembered, 2 * CHUNK)
        self.slots: dict[bytes, int] = {}
        self.sums, self.sizes = np.zeros(self.limit), np.zeros(self.limit)

    def _slot(self, word: bytes) -> int:
        parts = self.model.parts[features(word, self.model.shape)]
        slot = self.slots[word] = len(self.slots)
        self.sums[slot], self.sizes[slot] = parts.sum(), len(parts)
        return slot

    def score(self, text: str) -> float:
        """The probability of class 1. A text without words has the model's constant alone."""
        words = text.encode("utf-8", "surrogatepass").split()
        total = size = 0.0
        before = None
        for at in range(0, len(words), CHUNK):
            part = words[at:at + CHUNK]
            if len(self.slots) + len(part) > self.limit:
                self.slots.clear()
            get, slot = self.slots.get, self._slot
            ids = np.fromiter((s if (s := get(w)) is not None else slot(w) for w in part), np.int64, len(part))
            repeats = int((ids[1:] == ids[:-1]).sum()) + (part[0] == before)
            total += self.sums[ids].sum() + repeats * self.model.parts[-1]
            size += self.sizes[ids].sum() + repeats
            before = part[-1]
        value = self.model.constant + (total / size if size else 0.0)
        return float(1 / (1 + np.exp(-np.clip(value, -500, 500))))


def held_out(id_col: str):
    """Whether a document is kept from training: the CRC-32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
        label_id_col: str = "doc_id", label_col: str = "quality", sample: int = 4000,
        shape: Shape = Shape()) -> Model:
    """A model learned from at most ``sample`` labelled documents that are not held out.

    The sample is the labelled ids that come first by a hash of the id; a document with several labels
    has the least of them; rows without an id, a label, or a text are not used. Documents become counts
    of buckets in the tasks, so that what a document sends is bounded by the number of buckets.
    """
    prepare(docs.sparkSession)
    chosen = (labels.select(F.col(f"`{label_id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
              .where("id IS NOT NULL AND label IN (0, 1)").where(~held_out("id"))
              .groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample))
    texts = (columns(docs, id=id_col, text=text_col).where("text IS NOT NULL").join(F.broadcast(chosen), "id")
             .groupBy("id", "label").agg(F.min("text").alias("text")))

    def make():
        def each(key, text):
            ids, n = counts(text, shape)
            return key["id"], key["label"], ids.tolist(), n.tolist()
        return each

    id_type = chosen.schema["id"].dataType.simpleString()
    found = text_map(texts.select(F.struct("id", "label").alias("id"), "text"),
                     f"id {id_type}, label int, buckets array<int>, n array<float>", make)
    rows = [(r.label, np.array(r.buckets, np.int64), np.array(r.n)) for r in found.orderBy("id").toLocalIterator()]
    return train(rows, shape)


def classify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``held_out``, ``score`` (0 to 1, higher where label 1 is likelier) and
    ``predicted`` (1 if the score is at least one half, else 0).

    Only the text makes the score. A null or empty text gets the model's constant; a null id is not held
    out; repeated rows are kept; other columns are ignored; an empty table gives an empty one.
    """
    spark = prepare(docs.sparkSession)
    id_type = docs.select(f"`{id_col}`").schema[0].dataType.simpleString()
    sent = spark.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(sent.value)

        def each(i, text):
            s = scorer.score(text)
            return i, s, int(s >= 0.5)
        return each

    scored = text_map(columns(docs, id=id_col, text=text_col), f"id {id_type}, score double, predicted int", make)
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", "predicted")
