"""Quality rules from counts within a text and from lines that many documents of a host share.

Lines are normalised and hashed. A line is boilerplate of a host if more than ``max_docs`` documents of the host
hold it, wherever it stands; documents whose normal lines are all the same, such as exact copies, count as one. Boilerplate
lines are taken out, and a document that loses more than half of its words is rejected.

All of it is DataFrame functions; texts are read once, and what follows works on hashes of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import SEPARATORS, columns, let, materialize, prepare, unused, words

# Fixed values.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal_line(line: Column) -> Column:
    """A to Z lower-cased, runs of digits as 0, runs of blanks as one space, no blanks at the ends."""
    line = F.regexp_replace(F.translate(line, UPPER, LOWER), "[0-9]+", "0")
    return F.trim(F.regexp_replace(line, SEPARATORS, " "))


def repeated_words(w: Column) -> Column:
    """How many words of the array lie in a window of three words that occurs twice or more in it."""
    def repeats(grams: Column) -> Column:
        def covered(starts: Column) -> Column:
            steps = F.transform(starts, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(starts, j + 1) - p, F.lit(3))))
            return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, b: a + b)

        twice = F.filter(grams, lambda g, j: F.coalesce(F.get(grams, j - 1)["h"] == g["h"], F.lit(False))
                         | F.coalesce(F.get(grams, j + 1)["h"] == g["h"], F.lit(False)))
        return let(F.array_sort(F.transform(twice, lambda g: g["i"])), covered)

    def counted(hashes: Column) -> Column:
        # Only texts that repeat a window have their windows sorted.
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(pairs, repeats)).otherwise(0)

    windows = F.transform(w, lambda a, i: F.xxhash64(a, F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 3, F.lit(0).cast("bigint")).otherwise(
        let(F.slice(windows, 1, F.greatest(F.size(w) - 2, F.lit(0))), counted))


def text_counts(text: Column) -> dict[str, Column]:
    """The counts of a text. ``n_words``; ``word_chars``: code points in words; ``n_symbols``: characters of
    ``[#*$%&|<>]``; ``n_dup_lines``: lines with a word that equal an earlier line; ``n_repeat_words``."""
    text = F.coalesce(text, F.lit(""))
    both = let(words(text), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), repeated_words(w).alias("r")))
    lines = let(F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANKS, "") != ""),
                lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))
    return {
        "both": both,
        "word_chars": F.length(F.translate(text, BLANKS, "")).cast("bigint"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint"),
        "n_dup_lines": lines,
    }


def _lines(text: Column) -> Column:
    """The word-bearing lines of a text: the hash of each in its normal form, and its number of words."""
    normal = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), normal_line), lambda x: x != "")
    return F.transform(normal, lambda x: F.struct(
        F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.translate(x, " ", "")) + 1).alias("n")))


def _measure(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """One small row per document, written once: its counts, and its lines as hashes."""
    d = columns(docs, id=id_col, text=text_col, host=host_col)
    d = d.select(F.monotonically_increasing_id().alias("row"), "id", "host",
                 _lines(F.col("text")).alias("lines"), *[c.alias(n) for n, c in text_counts(F.col("text")).items()])
    return materialize(d.select("row", "id", "host", "lines", F.col("both.n").alias("n_words"),
                                "word_chars", "n_symbols", "n_dup_lines", F.col("both.r").alias("n_repeat_words")))


def boilerplate(measured: DataFrame, max_docs: int) -> DataFrame:
    """The boilerplate lines: ``host`` and ``h``, one row each.

    Lines are counted over rows first, which combines on the map side; only those above the limit are counted
    again, over different documents.
    """
    hashes = F.transform("lines", lambda x: x["h"])
    held = measured.select("host", F.xxhash64(hashes).alias("document"), F.explode(F.array_distinct(hashes)).alias("h"))
    often = held.groupBy("host", "h").count().where(F.col("count") > max_docs).select("host", "h")
    again = held.alias("s").join(often.alias("o"), F.col("s.host").eqNullSafe(F.col("o.host")) & (F.col("s.h") == F.col("o.h")), "left_semi")
    return (again.groupBy("host", "h", "document").agg(F.lit(1).alias("one")).groupBy("host", "h").count()
            .where(F.col("count") > max_docs).select("host", "h"))


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          max_docs: int = 10, min_words: int = 50, max_repeated: float = 0.5,
          max_removed: float = 0.5) -> DataFrame:
    """One row per document: its id, the counts, ``base_failed``, ``kept``, ``removed_words`` and
    ``removed_lines`` (hashes of the boilerplate lines in it, or null).

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeated`` of them in repeated
    windows. A document is kept if it has not failed and boilerplate takes at most ``max_removed`` of its
    words. A null or empty text has no words and fails. Documents without a host form one host; null ids
    and repeated rows are kept as rows (copies count as one document); texts are read whole, however long; other
    columns are ignored, and an empty table gives an empty one.
    """
    prepare(docs.sparkSession)
    m = _measure(docs, id_col, text_col, host_col)
    bad = materialize(boilerplate(m, max_docs))
    gone = (m.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.*").alias("l")
            .join(bad.alias("b"), F.col("l.host").eqNullSafe(F.col("b.host")) & (F.col("l.h") == F.col("b.h")), "left_semi")
            .groupBy("row").agg(F.sum("n").alias("removed_words"), F.collect_set("h").alias("removed_lines")))
    out = m.drop("lines", "host").join(gone, "row", "left").withColumn(
        "removed_words", F.coalesce("removed_words", F.lit(0)))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > max_repeated * F.col("n_words"))
    kept = ~failed & (F.col("removed_words") <= max_removed * F.col("n_words"))
    return (out.withColumns({"base_failed": failed, "kept": kept})
            .select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "kept", "removed_words", "removed_lines"))


def clean(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns, and without their boilerplate lines.

    Verdicts are joined by id, text and host, so that rows with equal ids are told apart; repeated rows are
    kept or rejected together. Null and empty texts are rejected; an empty table gives an empty one.
    """
    prepare(docs.sparkSession)
    key, said = unused(docs, "row_key"), unused(docs, "verdict")
    names = [f"`{c}`" for c in (id_col, text_col, host_col)]
    # Null ids and hosts have hashes of their own, so that this is one plain equality.
    row_key = F.xxhash64(*names, *[F.col(n).isNull() for n in names])
    keyed = docs.withColumn(key, row_key)
    judged = judge(keyed, id_col=key, text_col=text_col, host_col=host_col, **limits)
    verdicts = (judged.where("NOT kept OR removed_lines IS NOT NULL")
                .select(F.col(key).alias("k"), F.struct("kept", "removed_lines").alias(said)).dropDuplicates(["k"]))
    out = keyed.join(verdicts, F.col(key) == F.col("k"), "left").where(F.coalesce(F.col(said)["kept"], F.lit(True)))
    text = without_lines(F.col(f"`{text_col}`"), F.col(said)["removed_lines"])
    return out.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def without_lines(text: Column, hashes: Column) -> Column:
    """The text without the lines whose hashes are in the array (null: as it is); empty lines stay."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(hashes, F.xxhash64(normal_line(x))))
    return F.when(hashes.isNull(), text).otherwise(F.array_join(lines, "\n"))
