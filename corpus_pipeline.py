"""Corpus pipeline: toxicity, near duplicates, benchmark decontamination, secrets, packing.

Each stage works on what its predecessor kept, and calls one operator of ``tessera.llm``;
``run`` writes every stage's result as Parquet in the shared checkpoint folder and rereads
it as the next stage's documents. All stages but the last return the columns of ``documents``:

* toxicity: documents that score at least 0.5 go; the model is fitted to labelled rows
  outside the held-out fold;
* simhash: one document of each near-duplicate group stays (the least id);
* decontaminate: documents that contain a benchmark item go;
* secrets: secrets in a text are replaced by ``[SECRET]``, ``n_chars`` follows;
* pack: one row per sequence of at most 4096 ids, with the ids (little-endian unsigned 32-bit), the
  document and the place in it they come from, and ``bucket``, log2 of the length.

What a stage does with nulls, repeated rows and empty tables is its operator's contract.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, packing_pow2, secret_trigrams, simhash_golay, toxicity_fst
from tessera.llm.common import table
from tessera.session import materialize, release, ship_package


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return toxicity_fst.remove_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return simhash_golay.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return secret_trigrams.redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packing_pow2.pack(docs, packing_pow2.tokenizer_file()).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("simhash", near_duplicates),
    ("decontaminate", decontamination),
    ("secrets", secrets),
    ("pack", packing),
]

#: SQL cannot express the classifier, the fingerprints or the tokenizer; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
            if before:
                release(spark, *before)  # what this stage read is written anew
            before = [docs]
    return docs
