"""Documents to packed training sequences, in five stages; each is written as Parquet and read by the next."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.common import table
from palimpsest.llm.decontaminate import keep_clean
from palimpsest.llm.exact_dedup import keep_first
from palimpsest.llm.packing import pack_documents
from palimpsest.llm.quality_pu import keep_good
from palimpsest.llm.simhash_dedup import keep_one
from palimpsest.sources.scratch import shared_folder

#: Near copies: a Jaccard similarity of 0.8 or more of the sets of five-word shingles, compared exactly.
NEAR = {"shingle": 5, "similarity": 0.8}
#: Words whose ids a packing worker remembers; workers hold them while they serve the other stages.
REMEMBERED = 80_000


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; see keep_good() for null, empty and repeated rows."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays; see keep_first() for null and repeated ids."""
    return keep_first(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest id stays; see keep_one() for null and repeated ids."""
    return keep_one(docs, **NEAR)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in whose text a window of a benchmark item stands go, whatever their ids; see keep_clean()."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece, see pack_documents(): where it stands in which sequence of at most 4096 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, digest=True, remembered=REMEMBERED)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_duplicates),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier, the fingerprints and the tokenizer have no SQL; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents of a data directory to packed pieces."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
