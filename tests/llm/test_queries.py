"""The registered corpus queries against their SQL, their plans, and the pipeline against a plain version."""

import re

import duckdb
import public_tokenizers as P
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from kgspark.llm import byte_bpe, decontaminate, pii, simhash
from kgspark.llm.queries import ORACLES, QUERIES
from tests.conftest import SMALL
from tests.llm.helpers import components

TABLES = ("documents", "pages", "benchmark", "labels", "conversations")


def test_names():
    assert [sum(n.startswith(f"op{k}_") for n in entry.queries()) for k in range(1, 14)] == [1] * 13
    assert "pipeline" in entry.queries() and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    ref = con.execute(ORACLES[name])
    names = [d[0] for d in ref.description]
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in ref.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == want


def test_rules_run_no_python(spark):
    plan = QUERIES["op7_quality_rules"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    plan = QUERIES["op9_url_filter"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_pipeline(spark):
    """The stages of the pipeline in plain Python, over all rows."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    cols = [d[0] for d in con.execute(ORACLES["op7_quality_rules"]).description]
    kept = {r[cols.index("doc_id")] for r in con.execute(ORACLES["op7_quality_rules"]).fetchall() if r[cols.index("kept")]}
    docs = [(i, t) for i, t in con.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall() if i in kept]
    # No line is common enough at this size to be boilerplate, so texts stay as they are.
    links = [(a, b) for a in range(len(docs)) for b in range(a) if simhash.similar(docs[a][1], docs[b][1], 5) >= 0.8]
    docs = [d for k, d in enumerate(docs) if components(len(docs), links)[k] == k]
    items = [" ".join(decontaminate.terms(t)) for t, in con.execute("SELECT text FROM benchmark").fetchall()]
    docs = [(i, t) for i, t in docs if not any(f" {q} " in f" {' '.join(decontaminate.terms(t))} " for q in items)]
    finder = pii.Finder()
    bpe = byte_bpe.ByteBPE(byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
    want = {i: bpe.encode(pii.masked(t, finder.spans(t))) for i, t in docs}
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id: list(r.ids) for r in rows} == want and len(rows) == len(want)
