"""A pipeline from raw documents to token ids, in stages that are each written and read again.

A stage gets what its predecessor kept, as a table like ``documents``, and returns what it keeps:

1. quality rules: documents that fail go, and boilerplate lines of a host are taken out;
2. SimHash near-dedup: of each group of similar texts the one with the least id stays;
3. benchmark decontamination: documents that hold a benchmark item go;
4. personal data: spans are replaced by the names of their kinds;
5. byte-level BPE: texts become token ids, which must decode to the text again.

Rows with null ids, and repeated rows, pass through like others, but that of rows with equal id and text
one stays. Further columns are kept up to the last stage. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm import byte_bpe, decontaminate, pii, quality_rules, simhash
from kgspark.llm.common import materialize, prepare


def _measured(docs: DataFrame) -> DataFrame:
    """The same documents with ``n_chars`` as their texts now are, if there is such a column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return _measured(quality_rules.clean(docs, max_docs=10, min_words=50, max_repeated=0.5, max_removed=0.5))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return simhash.one_per_group(docs, shingle=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return _measured(pii.mask(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids``, and ``decoded_sha256``, the hash of the decoded bytes."""
    import public_tokenizers

    prepare(spark)
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN,
                           decoded=True)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("pii", personal_data),
    ("byte_bpe", tokens),
]

# Fingerprints, BM25 and merges have no SQL; tests/llm compares the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of a folder; each stage before it is written and read again."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
