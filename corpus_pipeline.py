"""A training corpus from raw documents, in five stages, each written and read again.

Language ID drops documents without a told language; line dedup takes repeated lines out of the
texts; the n-gram Jaccard join (five words, similarity 0.8) keeps the smallest doc_id of each group
of near copies; decontamination drops documents that hold a benchmark item; the mix takes documents
to the sources' target weights and adds mix_size and mix_taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from groundtrack.llm import decontaminate, jaccard_join, language_id, line_dedup, source_mix
from groundtrack.llm.common import cut, drop_cut


def tell_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep(docs, language_id.train(docs, in_task=True))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.take(docs)


STAGES = [
    ("language_id", tell_language),
    ("line_dedup", drop_lines),
    ("jaccard_join", drop_copies),
    ("decontaminate", drop_leaks),
    ("source_mix", mix_sources),
]

#: The first stage's support vector machines have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
            if i:
                drop_cut(before)  # nothing reads the stage before any more
    return docs
