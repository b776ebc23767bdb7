"""The corpus operators as registered queries, with SQL checks where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kgspark.llm.common import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(prepare(spark), lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        run.__name__, run.__doc__ = name, build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build
    return wrap


def tokenizer(name: str) -> str:
    """The file of a public tokenizer's vocabulary."""
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op4_token_counts")
def op4(spark, table):
    """Tokens of every document under a sentencepiece BPE vocabulary."""
    from kgspark.llm.token_count import token_counts
    return token_counts(table("documents"), tokenizer("piece_bpe_32k.model"), limit=4096)


@query("op6_byte_bpe")
def op6(spark, table):
    """Byte-level BPE ids of every document and their decoding, as hashes."""
    from public_tokenizers import PATTERN

    from kgspark.llm.byte_bpe import round_trip
    return round_trip(table("documents"), tokenizer("byte_bpe_multi_50k.tiktoken"), PATTERN)


# The rules of the URL query.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

OP9_SQL = r"""
WITH rest AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS r FROM pages),
parts AS (
  SELECT page_id, r, coalesce(translate(regexp_extract(r, '^[^/?#]*'),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest),
forms AS (
  SELECT page_id, host, path, CASE WHEN regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)$', '') <> '' THEN
           regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '') ||
           CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS form
  FROM (SELECT *, list_sort(list_filter(string_split(coalesce(regexp_extract(r, '^[^?#]*\?([^#]*)', 1), ''), '&'),
          lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS q FROM parts)),
listed AS (SELECT form FROM forms WHERE form IS NOT NULL GROUP BY form HAVING count(DISTINCT page_id) > 1),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM forms)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
    WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
    WHEN form IN (SELECT form FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


@query("op9_url_filter", OP9_SQL)
def op9(spark, table):
    """Verdicts on every page address, by four rules and the list of addresses that several pages carry."""
    from kgspark.llm.url_filter import judge_urls, repeated_addresses
    pages = table("pages")
    return judge_urls(pages, URL_RULES, repeated_addresses(pages))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, row_number() OVER () AS row,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
raw_lines AS (SELECT row, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM d),
dups AS (SELECT row, count(*) - count(DISTINCT line) AS n_dup_lines FROM raw_lines
         WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row),
grams AS (SELECT row, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
          FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT row, i FROM (SELECT *, count(*) OVER (PARTITION BY row, g) AS n FROM grams) WHERE n > 1),
reps AS (SELECT row, count(DISTINCT p) AS n_repeat_words
         FROM (SELECT row, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY row),
base AS (
  SELECT d.row, doc_id, source, len(w) AS n_words,
         length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN dups USING (row) LEFT JOIN reps USING (row)),
normal AS (
  SELECT row, source, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x:
           trim(regexp_replace(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')), lambda x: x <> '') AS lines FROM d),
cut AS (SELECT row, source, lines, unnest(lines) AS line FROM normal),
bad AS (SELECT source, line FROM cut GROUP BY source, line HAVING count(DISTINCT lines) > 10),
gone AS (
  SELECT row, sum(length(a.line) - length(replace(a.line, ' ', '')) + 1) AS removed_words
  FROM cut a JOIN bad b ON a.source IS NOT DISTINCT FROM b.source AND a.line = b.line GROUP BY row)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND coalesce(removed_words, 0) <= 0.5 * n_words AS kept
FROM base LEFT JOIN gone USING (row)
"""


@query("op7_quality_rules", OP7_SQL)
def op7(spark, table):
    """Counts of every document, and whether it is kept once the boilerplate of its host is taken out."""
    from kgspark.llm.quality_rules import judge
    return judge(table("documents"), max_docs=10, min_words=50, max_repeated=0.5).drop("removed_words", "removed_lines")


@query("op8_pii")
def op8(spark, table):
    """Spans of personal data in every document, found from anchors."""
    from kgspark.llm.pii import find
    return find(table("documents"))


@query("op1_simhash")
def op1(spark, table):
    """Fingerprints of all documents, and the components of those that differ in at most 4 bits."""
    from kgspark.llm.simhash import near_duplicates
    return near_duplicates(table("documents"), shingle=4, words=1, radius=4)


@query("op3_decontamination")
def op3(spark, table):
    """Benchmark items that stand in documents."""
    from kgspark.llm.decontaminate import find_leaks
    return find_leaks(table("documents"), table("benchmark"))


@query("op5_quality_classifier")
def op5(spark, table):
    """Quality scores of all documents, learned from the labels that are not held out."""
    from kgspark.llm.quality_classifier import classify, fit
    docs = table("documents")
    return classify(docs, fit(docs, table("labels"), sample=4000))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
t AS (SELECT row, i, words[i] AS c, CASE WHEN i > 1 THEN words[i - 1] END AS b, CASE WHEN i > 2 THEN words[i - 2] END AS a
      FROM (SELECT row, words, unnest(range(1, len(words) + 1)) AS i FROM d)),
one AS (SELECT c, count(*) AS n FROM t GROUP BY c),
two AS (SELECT b, c, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY b, c),
three AS (SELECT a, b, c, count(*) AS n FROM t WHERE a IS NOT NULL GROUP BY a, b, c HAVING count(*) >= 2),
s AS (
  SELECT t.row, CASE
    WHEN t.b IS NULL THEN ln(one.n / (SELECT count(*) FROM t))
    WHEN three.n IS NOT NULL THEN ln(three.n) - ln(ctx2.n)
    ELSE CASE WHEN t.a IS NULL THEN 0 ELSE ln(0.4) END + CASE
      WHEN two.n >= 2 THEN ln(two.n) - ln(ctx1.n) ELSE ln(0.4) + ln(one.n / (SELECT count(*) FROM t)) END END AS v
  FROM t JOIN one ON one.c = t.c LEFT JOIN two ON two.b = t.b AND two.c = t.c
  LEFT JOIN three ON three.a = t.a AND three.b = t.b AND three.c = t.c
  LEFT JOIN one ctx1 ON ctx1.c = t.b LEFT JOIN two ctx2 ON ctx2.b = t.a AND ctx2.c = t.b)
SELECT doc_id, len(words) AS n_words, round(coalesce(v, 0), 4) AS log_score,
       CASE WHEN len(words) > 0 THEN round(v / len(words), 6) END AS mean_log_score
FROM d LEFT JOIN (SELECT row, sum(v) AS v FROM s GROUP BY row) USING (row)
"""


@query("op10_lm_scores", OP10_SQL)
def op10(spark, table):
    """Trigram stupid-backoff scores of all documents under the counts of all documents."""
    from pyspark.sql import functions as F

    from kgspark.llm.ngram_lm import lm_scores
    scores = lm_scores(table("documents"), order=3, backoff=0.4, min_count=2)
    return scores.withColumns({"log_score": F.round("log_score", 4), "mean_log_score": F.round("mean_log_score", 6)})


@query("op2_suffix_dedup")
def op2(spark, table):
    """What is left of every document without 50-byte strings that a document with a smaller id has."""
    from kgspark.llm.suffix_dedup import dedup
    return dedup(table("documents"), length=50)


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
every AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total,
         sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, k.term) AS all_n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang) AS lang_total, v
  FROM g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // (total + 5 * v) AS p,
             1 + (1000000000 * (all_n::HUGEINT + 5)) // (lang_total + 5 * v) AS q FROM every),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(pa.p - pb.p)), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p pa ON pa.lang = a.lang AND pa.source = a.source
  LEFT JOIN p pb ON pb.lang = b.lang AND pb.source = b.source AND pb.term = pa.term GROUP BY 1, 2, 3),
term AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pair
UNION ALL
SELECT lang, source, 'term' AS part, item, value, rank FROM (
  SELECT *, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM term) WHERE rank <= 50
"""


@query("op11_source_divergence", OP11_SQL)
def op11(spark, table):
    """How far the sources of each language are from each other, and which terms set each one apart."""
    from kgspark.llm.divergence import audit
    return audit(table("documents"), min_docs=30, top=50)


OP12_SQL = r"""
WITH RECURSIVE
bits AS (
  SELECT doc_id, source, lang, n_chars, text, (SELECT 4294967295 - list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b:
      list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda x, y: xor(x // 2, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END)))) AS crc
  FROM documents),
fields AS (
  SELECT doc_id, lang, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text,
         CASE WHEN crc % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other
  FROM bits),
leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS changed FROM fields),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY lang) AS n FROM leaves),
trees AS (
  SELECT lang, 0 AS level, pos, leaf AS digest, n FROM placed
  UNION ALL
  SELECT lang, level, pos, digest, count(*) OVER (PARTITION BY lang) AS n FROM (
    SELECT lang, level + 1 AS level, pos // 8 AS pos, sha256(string_agg(digest, '' ORDER BY pos)) AS digest
    FROM trees WHERE n > 1 GROUP BY lang, level, pos // 8)),
subroots AS (
  SELECT lang, level AS levels, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM trees WHERE n = 1),
forest AS (
  SELECT 0 AS level, pos, digest, n FROM subroots
  UNION ALL
  SELECT level, pos, digest, count(*) OVER () AS n FROM (
    SELECT level + 1 AS level, pos // 8 AS pos, sha256(string_agg(digest, '' ORDER BY pos)) AS digest
    FROM forest WHERE n > 1 GROUP BY level, pos // 8)),
runs AS (
  SELECT lang, level, pos // 8 AS run, list(digest ORDER BY pos) AS digests FROM trees WHERE n > 1 GROUP BY lang, level, pos // 8),
top_runs AS (
  SELECT level, pos // 8 AS run, list(digest ORDER BY pos) AS digests FROM forest WHERE n > 1 GROUP BY level, pos // 8),
depth AS (SELECT coalesce(max(level), 0) AS top FROM forest),
-- One row per document and level: all levels of its tree, then those of the tree of trees.
way AS (
  SELECT p.doc_id, p.lang, p.pos, p.leaf, p.changed, s.digest AS subroot, s.levels, s.pos AS tree_pos, 0 AS step,
         p.changed AS digest, '' AS proof
  FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang
  UNION ALL
  SELECT w.doc_id, w.lang, w.pos, w.leaf, w.changed, w.subroot, w.levels, w.tree_pos, w.step + 1,
         sha256(array_to_string(list_concat(list_concat(r.digests[:w.at], [w.digest]), r.digests[w.at + 2:]), '')),
         w.proof || array_to_string(list_concat(r.digests[:w.at], r.digests[w.at + 2:]), '')
  FROM (SELECT *, CASE WHEN step < levels THEN pos // (8 ** step)::BIGINT ELSE tree_pos // (8 ** (step - levels))::BIGINT END % 8 AS at FROM way) w
  JOIN (SELECT lang, level, run, digests, true AS low FROM runs UNION ALL SELECT NULL, level, run, digests, false FROM top_runs) r
    ON (r.low AND w.step < w.levels AND r.lang IS NOT DISTINCT FROM w.lang AND r.level = w.step AND r.run = w.pos // (8 ** (w.step + 1))::BIGINT)
    OR (NOT r.low AND w.step >= w.levels AND r.level = w.step - w.levels AND r.run = w.tree_pos // (8 ** (w.step - w.levels + 1))::BIGINT))
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, digest AS folded_root, digest = root AS verified
FROM way, depth, (SELECT digest AS root FROM forest WHERE n = 1) WHERE step = levels + top
"""


@query("op12_merkle_manifest", OP12_SQL)
def op12(spark, table):
    """The manifest of all documents, with a third of their texts changed to lower case and folded up to the root."""
    from pyspark.sql import functions as F

    from kgspark.llm.merkle import prove
    from kgspark.llm.quality_rules import LOWER, UPPER
    return prove(table("documents"), ["doc_id", "source", "lang", "n_chars", "text"], tree_col="lang",
                 changed={"text": F.translate("text", UPPER, LOWER)}, where=F.crc32(F.col("doc_id").cast("string")) % 3 == 0)[0]


# A conversation whose texts hold what templates mark turns with.
CONFLICT = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]

OP13_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('### ') + length(regexp_replace(role, '[\x00-\x20:<#\\%]', '%..', 'g')) + length(':' || chr(10))
         + length(regexp_replace(text, '\\*(?:### [^\x00-\x20:<#\\]*:|</turn>)', '\\\0', 'g')) + length(chr(10) || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


@query("op13_chat_format", OP13_SQL)
def op13(spark, table):
    """All conversations as training texts, and what a reader of those texts finds in them."""
    from kgspark.llm.chat_format import digests, format_chats
    more = spark.createDataFrame(CONFLICT, "conv_id bigint, turn bigint, role string, text string")
    talks = table("conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return digests(format_chats(talks, trained="assistant"), in_order=True)
