"""Corpus pipeline: quality rules, exact dedup, SimHash near-dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept;
all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm import bpe, exact_dedup, mixing, quality, simhash
from opinara.llm.queries import tokenizer_spec
from opinara.session import cut

#: Rows that a Python worker is handed at once.  Texts may be long, and each task of an executor
#: holds a batch of them twice, beside its heap.
ROWS_AT_ONCE = 500
#: Token shares after filtering; the domain that quality rules remove is not asked for.  Toxic
#: text shall be rarer than it is, so that clean documents have rates of one and more.
MIX = {"clean": 0.99, "toxic": 0.01}


@contextmanager
def _narrow_batches(spark: SparkSession) -> Iterator[None]:
    """Within it, Python workers are handed ROWS_AT_ONCE rows at most; after it, what was set before."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    told = spark.conf.get(name)
    if int(told) <= 0 or int(told) > ROWS_AT_ONCE:
        spark.conf.set(name, ROWS_AT_ONCE)
    try:
        yield
    finally:
        spark.conf.set(name, told)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the threshold table.  Null and empty texts go; repeated
    rows fare alike; other columns, of any name, stay; an empty table stays empty."""
    return quality.kept_rows(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised text, the one with the smallest id.  Null counts as empty; a
    null id comes last; of repeated rows one stays; columns stay; an empty table stays empty."""
    return exact_dedup.kept_rows(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8 or more), the document with the
    smallest id.  Texts without shingles stay; columns stay; an empty table stays empty."""
    with _narrow_batches(spark):
        # what Python does here is done before it returns: the rows that go are a written table
        return simhash.kept_rows(docs)


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the rates fitted to the target weights say.  Null and empty texts stay once;
    repeated rows fare alike; columns stay; an empty table stays empty."""
    return mixing.mixed_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), MIX)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document: doc_id, n_tokens, ids.  Null and empty texts have none; repeated rows
    give repeated rows; an empty table gives no rows."""
    with _narrow_batches(spark):
        return cut(bpe.encode(docs.select("doc_id", "text"), tokenizer_spec()).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("mixing", target_mix),
    ("bpe", token_ids),
]

#: The fingerprints, rates and token ids are not expressible in SQL; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
