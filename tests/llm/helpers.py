"""Documents with every awkward case, and plain versions of what the operators do."""

import hashlib

import numpy as np

from pyspark.sql import types as T

# Columns whose names operators use inside.
CLASHING = ("id", "row", "node", "f0", "key", "hash", "cell", "n_tokens", "fingerprint", "kept", "score", "block",
            "ids", "spans", "row_key", "verdict", "key_id", "removed_words", "n_words", "host", "lines")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType())] + [T.StructField(c, T.StringType()) for c in CLASHING])


def prose(seed, n):
    rng = np.random.default_rng(seed)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "é", "ß"]
    return " ".join("".join(rng.choice(parts, rng.integers(1, 5))) + ("." if k % 9 == 8 else "") for k in range(n))


def awkward():
    """(doc_id, text, lang, source) with nulls, empty and long texts, ties, repeated rows."""
    a, b = prose(1, 80), prose(2, 120)
    return [
        (1, a, "en", "s"), (2, a, "en", "s"), (2, a, "en", "s"), (3, b, None, None), (4, None, "en", "s"), (5, "", "en", "s"),
        (6, " \n\t ", "en", "s"), (None, a + " more", "en", "s"), (None, None, None, None), (7, prose(3, 30000), "en", "s"),
        (8, "x", "en", "s"), (9, b.replace("th", "zz", 1), "en", "s"), (9, prose(4, 60), "en", "s"), (10, "A\x00b ▁ 日本 😀  end ", "en", "s"),
        (11, "a" * 5000, "en", "s"),
    ]


def frame(spark, rows):
    full = [(i, t, lang, s, None if t is None else len(t), *[f"{c} {k}" for c in CLASHING]) for k, (i, t, lang, s) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def collected(df, *names):
    """Rows as sorted tuples of the named columns."""
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def components(n, links):
    """The least member of each item's group."""
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


def without_repeats(rows, length=50):
    """id and what suffix dedup gives, from all windows in a dictionary."""
    big, first = 1 << 62, {}
    data = [(big if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for k in range(len(b) - length + 1):
            first[b[k:k + length]] = min(i, first.get(b[k:k + length], big))
    out = []
    for (i, b), (shown, _) in zip(data, rows):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if first[b[k:k + length]] < i:
                gone[k:k + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        out.append((shown, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out
