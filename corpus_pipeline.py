"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; each
is written as Parquet and read again as the next one's docs. All but the last return the
columns of documents, whatever else they have.

Defined cases: those of the operators. A document that loses all its lines to line dedup
goes; documents without text pass the first three stages if the classifier keeps them, and
give nothing to the mix; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import lines, minhash, mixing, packing, quality
from driftline.llm.common import read
from driftline.storage import materialize, release, scope


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.classify(docs, quality.fit(docs)).where("kept").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go, and documents that are nothing else."""
    left = lines.line_dedup(docs).where("n_removed = 0 or n_removed < n_lines")
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id."""
    return minhash.one_per_group(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: whole copies, and texts cut to the blocks taken."""
    return mixing.mix_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces and their places in sequences."""
    return packing.pack_sequences(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("mix_sources", mixing_stage),
    ("best_fit_packing", packing_stage),
]
#: The classifier and the tokenizer are not expressible in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents; a stage's own tables go as soon as its result is written, and that when the next one is."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scope(name):
            docs = materialize(stage(spark, docs, sf_dir), name)
        release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
