"""A training corpus from raw documents: five stages, each a Spark job over all that the one before kept.

Every stage takes (spark, docs, sf_dir), decides over its whole input and returns the rows that stay; all but the last with the columns of
``documents``. ``run`` writes each stage as Parquet to the folder that the cluster shares and reads it again as the next one's input.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from lifethread.llm.decontaminate import drop_contaminated
from lifethread.llm.jaccard import one_of_each
from lifethread.llm.line_dedup import line_dedup
from lifethread.llm.mixing import mix_documents
from lifethread.llm.queries import table
from lifethread.llm.toxicity import drop_toxic
from lifethread.runtime import materialize


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from the labelled documents of the input."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.3, max_rows=20_000)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more in five documents or more stay in the last document only; every document stays."""
    return line_dedup(docs, min_chars=40, min_docs=5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 of five-word shingles: that of the smallest id."""
    return one_of_each(docs, size=5, least=Fraction(4, 5))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: a row per copy, with its output shard and place."""
    return mix_documents(docs, share=1.5, weights=(3, 1, 2), most=2.0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity), ("line_dedup", lines), ("jaccard_join", near_duplicates), ("decontaminate", benchmark), ("mixing", mixture),
]
#: No SQL: the first stage is a trained model.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
