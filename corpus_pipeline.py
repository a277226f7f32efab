"""From documents to a training mix in five stages, each an operator of ``kinweave.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes it as parquet below the shared folder
and the next stage reads that, so a lost executor costs a stage at most. All stages but the last return the columns of
documents. Models are learnt from the labelled rows of ``documents`` in ``sf_dir`` whatever reached the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import decontaminate, jaccard_join, mixing, quality_classifier, quality_rules
from kinweave.sources.shared import materialise


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the line labels let pass."""
    crf = quality_rules.fit_lines(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return quality_rules.keep(docs, crf)


def keep_by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good."""
    crf = quality_classifier.fit_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return quality_classifier.keep(docs, crf)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the smallest id."""
    return jaccard_join.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the benchmark's passages; ``n_chars``, if there, counts what is left of a changed text."""
    out = decontaminate.remove_hits(docs, _table(spark, sf_dir, "benchmark"))
    if "n_chars" not in docs.columns:
        return out
    left = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(left))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken, with ``repetition`` from 1."""
    return mixing.repeated(docs)


STAGES = [
    ("quality_rules", keep_by_rules),
    ("quality_classifier", keep_by_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", remove_benchmark),
    ("source_mix", mix_sources),
]

#: Learnt models and near-duplicate classes have no form in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result lies below the shared folder."""
    before, docs = None, _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        after = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            before.drop()
        before, docs = after, after.df
    return docs
