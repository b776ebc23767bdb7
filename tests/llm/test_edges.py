"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib

import public_tokenizers as P
import pytest

import corpus_pipeline
from kgspark.llm import (byte_bpe, decontaminate, divergence, merkle, ngram_lm, pii, quality_classifier, quality_rules, simhash,
                         suffix_dedup, token_count, url_filter)
from tests.conftest import SMALL
from tests.llm.helpers import awkward, collected, frame

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
NO_TEXT = hashlib.sha256(b"").hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, awkward()).cache()


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "the one question here? and its answer there", "x"), (None, None, "y"), (3, "", "z")],
                                 "item_id bigint, text string, score string")


@pytest.fixture(scope="module")
def operators(spark, items):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1), (7, None), (9, 0), (3, 1)], "doc_id bigint, quality int")
    return {
        "simhash": lambda d: simhash.near_duplicates(d),
        "groups": lambda d: simhash.similar_groups(d),
        "suffix": lambda d: suffix_dedup.dedup(d),
        "leaks": lambda d: decontaminate.find_leaks(d, items),
        "tokens": lambda d: token_count.token_counts(d, P.path("piece_bpe_32k.model")),
        "classifier": lambda d: quality_classifier.classify(d, quality_classifier.fit(d, labels)),
        "bpe": lambda d: byte_bpe.round_trip(d, RANKS, P.PATTERN),
        "rules": lambda d: quality_rules.judge(d),
        "pii": lambda d: pii.find(d),
        "lm": lambda d: ngram_lm.lm_scores(d),
        "audit": lambda d: divergence.audit(d, min_docs=2),
        "manifest": lambda d: merkle.prove(d, ["doc_id", "source", "lang", "n_chars", "text"])[0],
    }


NAMES = ["simhash", "groups", "suffix", "leaks", "tokens", "classifier", "bpe", "rules", "pii", "lm", "audit", "manifest"]
EVERY_ROW = [n for n in NAMES if n not in ("groups", "leaks", "audit")]


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(operators, docs, name):
    assert operators[name](docs.limit(0)).collect() == []


@pytest.mark.parametrize("name", EVERY_ROW)
def test_one_row_for_each(operators, docs, name):
    got = sorted((r[0] for r in operators[name](docs).select("doc_id").collect()), key=repr)
    assert got == sorted((i for i, *_ in awkward()), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_in_any_partitions(operators, docs, name):
    one = operators[name](docs.coalesce(1))
    many = operators[name](docs.repartition(7))
    keep = [c for c in one.columns if c != "removed_lines"]
    assert collected(one, *keep) == collected(many, *keep)


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, docs, stage):
    name, function = corpus_pipeline.STAGES[stage]
    out = function(spark, docs, SMALL)
    if stage < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == docs.columns and out.schema == docs.schema
    rows = out.collect()
    assert rows and function(spark, docs.limit(0), SMALL).collect() == []
    if stage == 1:
        left = [(r.doc_id, r.text) for r in rows]
        assert len(left) == len(set(left)) and (2, awkward()[1][1]) not in left and (1, awkward()[0][1]) in left
    if stage in (2, 3):
        assert len(rows) == len(awkward())


def test_defined_results(operators, docs):
    got = {r.doc_id: r for r in operators["simhash"](docs).collect()}
    assert got[4].fingerprint == "0" * 16 and {got[k].component_id for k in (4, 5, 6)} == {4}
    assert got[2].component_id == 1
    got = {r.doc_id: r for r in operators["bpe"](docs).collect()}
    assert (got[4].n_tokens, got[4].ids_sha256, got[4].decoded_sha256) == (0, NO_TEXT, NO_TEXT)
    got = {r.doc_id: r for r in operators["tokens"](docs).collect()}
    assert (got[5].n_bytes, got[5].n_tokens, got[5].over_limit) == (0, 0, False) and got[7].over_limit
    got = {r.doc_id: r for r in operators["lm"](docs).collect()}
    assert (got[6].n_words, got[6].log_score, got[6].mean_log_score) == (0, 0.0, None)
    got = {r.doc_id: r for r in operators["pii"](docs).collect()}
    assert (got[4].n_email, got[4].base_sha256, got[4].spans) == (0, NO_TEXT, "")
    got = {r.doc_id: r for r in operators["rules"](docs).collect()}
    assert got[4].base_failed and not got[4].kept and got[7].kept
    got = {r.doc_id: r for r in operators["classifier"](docs).collect()}
    assert got[4].score == got[5].score == got[6].score and 0 <= got[4].score <= 1


def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, None, "a"), (2, "", "b"), (None, "http://a.net/x", "c"), (3, "no scheme", "d"), (4, "HTTP://WWW.B.com:80/p/?b=1&a=2&utm_x=3#f", "e"),
         (5, "https://b.com/p?a=2&b=1", "f"), (5, "https://b.com/p?a=2&b=1", "f"), (6, "http://x.example.net/en/1", "g"), (7, "http://b.net", "h")],
        "page_id bigint, url string, key string")
    rules = [("block", "net/"), ("allow", "example.net/en/")]
    listed = url_filter.repeated_addresses(pages)
    got = collected(url_filter.judge_urls(pages, rules, listed), "page_id", "host", "path", "rule", "verdict")
    assert got == sorted([
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (None, "a.net", "/x", "net/", "block"), (3, "", "", None, "allow"),
        (4, "www.b.com:80", "/p/", None, "block"), (5, "b.com", "/p", None, "block"), (5, "b.com", "/p", None, "block"),
        (6, "x.example.net", "/en/1", "example.net/en/", "allow"), (7, "b.net", "", None, "allow")], key=repr)
    assert url_filter.judge_urls(pages.limit(0), rules, listed).collect() == []
    assert len(url_filter.judge_urls(pages, rules, listed.limit(0)).collect()) == 9


def test_decoding_odd_ids(spark):
    rows = [(1, [72, 70]), (None, []), (2, None), (3, [10**9]), (4, [72, None]), (1, [72, 70])]
    ids = spark.createDataFrame(rows, "doc_id bigint, ids array<int>")
    got = collected(byte_bpe.decode(ids, RANKS), "doc_id", "decoded")
    one = bytes(byte_bpe.decode(ids.where("doc_id = 1"), RANKS).first().decoded)
    assert got == sorted([(1, one), (1, one), (None, b""), (2, b""), (3, None), (4, None)], key=repr) and len(one) >= 2
    assert byte_bpe.decode(ids.limit(0), RANKS).collect() == []


def test_stages_on_odd_rows(spark, docs, items):
    """What stays of null and empty texts and of repeated rows, by the operators that keep whole documents."""
    n = len(awkward())
    assert decontaminate.without_leaks(docs, items).count() == decontaminate.without_leaks(docs, items.limit(0)).count() == n
    masked = pii.mask(docs)
    assert [r.text for r in masked.where("doc_id IN (4, 5)").orderBy("doc_id").collect()] == [None, ""] and masked.count() == n
    kept = [(r.doc_id, r.text) for r in simhash.one_per_group(docs).collect()]
    assert len(kept) == len(set(kept)) and (4, None) in kept and not {5, 6} & {i for i, _ in kept}
    pages = spark.createDataFrame([(1, "http://a.b/x"), (1, "http://a.b/x"), (None, "http://a.b/x"), (2, "http://c.d"), (3, "http://c.d"), (4, None), (5, "")], "page_id bigint, url string")
    assert collected(url_filter.repeated_addresses(pages), "key") == [("c.d",)]
    assert url_filter.repeated_addresses(pages.limit(0)).collect() == []


def test_tables_of_blocks_are_dropped(spark, docs):
    from kgspark.llm import blocks
    made = blocks.pack(docs, "doc_id", "text")
    name = blocks._MADE[-1][1]
    assert made.count() and spark.catalog.tableExists(name)
    blocks.forget()
    assert not spark.catalog.tableExists(name) and blocks._MADE == []
