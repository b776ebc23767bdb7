"""URL verdicts: host and path rules first, then a list of canonical URLs.

The list is tested in two steps. A blocked Bloom filter, built by aggregation and bounded in size, says
which URLs may be listed: a key sets one bit in each of the eight 64-bit words of one block, so a test
reads one block. Only what passes goes to the join with the list itself, which removes the false hits.
Everything is built from DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import columns, materialize, prepare

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Query parameters that only track where a visitor came from.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"

WORDS_PER_BLOCK = 8
KEYS_PER_BLOCK = 32  # 16 bits a key


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null if there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z lower-cased; else empty."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From after the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """One form per page: no scheme, fragment, ``www.`` or ``m.``, default port, tracking parameters or
    last slash; other parameters sorted. Null where the URL has no ``://`` or no host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^(www|m)\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    asked = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(asked, "&"), lambda p: (p != "") & ~F.rlike(p, F.lit(TRACKING))))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, path, query))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none fits.

    ``rules`` are pairs of a verdict and a host with a path, like ``("block", "net/")``. A rule fits its
    host and all subdomains where the path starts with the rule's. A few rules, as they become one expression.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    """One bit for each word of the block, from a second hash."""
    h = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("bigint"),
                            F.shiftrightunsigned(h, 6 * w).bitwiseAND(F.lit(63)).cast("int"))
            for w in range(WORDS_PER_BLOCK)]


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter of a one-column frame: a row for each block in use, ``block`` and its words ``w0`` to ``w7``."""
    key = F.col(keys.columns[0])
    masks = [m.alias(f"w{i}") for i, m in enumerate(_masks(key))]
    return (keys.select(_block(key, blocks).alias("block"), *masks).groupBy("block")
            .agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS_PER_BLOCK)]))


def maybe_listed(key: Column) -> Column:
    """Whether the words ``w0`` to ``w7`` of the key's block hold all its bits (null words: no)."""
    test = F.lit(True)
    for i, m in enumerate(_masks(key)):
        test = test & (F.col(f"w{i}").bitwiseAND(m) == m)
    return F.coalesce(test, F.lit(False))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], listed: DataFrame, *, id_col: str = "page_id",
               url_col: str = "url", max_blocks: int = 1 << 18) -> DataFrame:
    """One row per page: its id, ``host``, ``path``, ``rule`` (null if none fits), ``verdict``.

    ``listed`` has one column of canonical URLs to block; repeats and nulls in it do no harm. A page is
    blocked if its rule says so or, without a rule, if its canonical URL is listed. A null URL, or one
    without ``://``, has an empty host and path, no rule, and is allowed. Null ids and repeated rows are
    kept; other columns are ignored; empty tables give empty results.

    The filter has a block for every 32 listed URLs, but never more than ``max_blocks`` (72 bytes each,
    19 MB by default), so it can be broadcast whatever the length of the list. Beyond that it lets more
    through, and the join decides the same. Repeated URLs meet one row of the list, so that hot keys of
    this join can be split.
    """
    prepare(pages.sparkSession)
    known = materialize(listed.select(F.col(f"`{listed.columns[0]}`").alias("key")).where("key IS NOT NULL").distinct())
    blocks = max(1, min(max_blocks, -(-known.count() // KEYS_PER_BLOCK)))
    bloom = bloom_filter(known, blocks)
    p = columns(pages, id=id_col, url=url_col)
    p = p.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical(F.col("url")).alias("key"))
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    p = p.withColumns({"rule": rule, "said": said})
    tested = (p.withColumn("block", _block(F.col("key"), blocks)).join(F.broadcast(bloom), "block", "left")
              .withColumn("maybe", F.col("rule").isNull() & F.col("key").isNotNull() & maybe_listed(F.col("key"))))
    shape = ["id", "host", "path", "rule"]
    free = tested.where(~F.col("maybe")).select(*shape, F.coalesce("said", F.lit("allow")).alias("verdict"))
    hits = (tested.where("maybe").select(*shape, "key").join(known.withColumn("found", F.lit(True)), "key", "left")
            .select(*shape, F.when(F.col("found"), "block").otherwise("allow").alias("verdict")))
    return free.unionByName(hits).withColumnRenamed("id", id_col)


def repeated_addresses(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The canonical URLs that two or more different pages carry, as a list for ``judge_urls``. Null and odd addresses
    have no canonical URL; repeated rows, and pages without an id, do not count as different; an empty table gives an empty list."""
    p = columns(pages, id=id_col, url=url_col).select("id", canonical(F.col("url")).alias("key"))
    return (p.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"))
            .where("a <> b").select("key"))
