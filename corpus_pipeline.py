"""A training corpus in stages over ``documents``.

Each stage is a function of (spark, docs, sf_dir) whose result is written as Parquet and
reread as the next one's ``docs``.  All but the last return the columns of ``documents``;
columns of other names pass through.

1. language ID: documents without a letter, or whose language is not clear, go;
2. SimHash near-dedup: of each group of near copies the document with the smallest id stays;
3. benchmark decontamination: documents that hold a benchmark window go;
4. secret scan: secrets in the text are replaced, and ``n_chars`` follows;
5. BPE encoding: doc_id, n_tokens and ids of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import bpe, decontaminate, language_id, secret_scan, simhash
from shelfmark.llm.common import free_name
from shelfmark.llm.queries import table, word_bpe
from shelfmark.session import new_shared_path, remove

# Below this confidence a language counts as not clear.
LEAST_CONFIDENCE = 0.35


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; a NULL text goes."""
    model = language_id.fit(docs, ~language_id.held_out(F.col("doc_id"), 4, 2))
    name = free_name(docs, "_language_found")
    found = F.col(name)
    sure = (found["lang_pred"] != language_id.UNDETERMINED) & (found["score"] >= LEAST_CONFIDENCE)
    return docs.withColumn(name, language_id.language(docs, model)).filter(sure).drop(name)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs, secret_scan.fit_on(docs), path="source")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, word_bpe())


STAGES = [
    ("language_id", known_language),
    ("simhash_near_dedup", without_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("secret_scan", without_secrets),
    ("bpe_encoding", encoded),
]

# Neither the models nor XXH64 nor BPE can be said in SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # nothing reads it any more
            remove(spark, before)
        before = path
    return docs
