"""From raw documents to a mixed training corpus, in five stages that each read what the one before wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import pii
from tidemark.llm.common import stored
from tidemark.llm.decontaminate import decontaminated
from tidemark.llm.mixing import mix
from tidemark.llm.quality import fit, score
from tidemark.llm.simhash import deduplicated


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose statistics the classifier scores one half or more. Its labels are those of ids that aren't held out."""
    trees = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(score(trees, F.col("text")) >= 0.5)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id."""
    return deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark, whatever numbers, names and units stand in it."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a placeholder for each piece of personal data; `n_chars` counts the new text."""
    return pii.mask(docs, pii.fit(docs)).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of which the mix takes any words, with `size`, `source_size`, `target` and `taken`."""
    mixed, _ = mix(docs, keep=[c for c in docs.columns if c not in ("doc_id", "source")])
    return mixed.filter("taken > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("simhash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("pii", personal_data),
    ("source mixing", source_mixing),
]

#: A trained classifier and a SimHash can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder. Each result but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
