"""Queries over the driver's tables, one per operator, and their SQL where it can express them over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from lifethread.llm import decontaminate, jaccard, language_id, language_model, line_dedup, mixing, periodic, pii, quality, resample, substring, token_counts, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_digest(table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(table(spark, sf_dir, "documents"), share=1.5, weights=(3, 1, 2), most=2.0)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_digest(table(spark, sf_dir, "documents"), size=20)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.pii(docs, pii.train(pii.small_table(docs, max_rows=1_500)))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"), size=3, least=Fraction(9, 10)).select("doc_id", "n_shingles", "component_id", "links")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_counts(table(spark, sf_dir, "documents"), token_counts.vocabulary())


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality(docs, quality.train(docs, table(spark, sf_dir, "labels"), max_rows=6_000), threshold=0.5)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), max_rows=20_000), threshold=0.3)


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.languages(docs, language_id.train(docs, max_rows=2_000))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, min_words=20, n=2, buckets=10_000, seed=7)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.runs_digest(periodic.repeat_some(table(spark, sf_dir, "documents")), least=12)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing, "op2_decontaminate": op2_decontaminate, "op3_substring_dedup": op3_substring_dedup, "op4_lm_score": op4_lm_score, "op5_pii": op5_pii, "op6_jaccard_join": op6_jaccard_join, "op7_token_counts": op7_token_counts, "op8_quality": op8_quality, "op9_toxicity": op9_toxicity, "op10_line_dedup": op10_line_dedup,
    "op11_language_id": op11_language_id, "op12_resample": op12_resample, "op13_periodic_runs": op13_periodic_runs,
}
SQL: dict[str, str] = {"op10_line_dedup": line_dedup.ORACLE, "op12_resample": resample.ORACLE}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(SQL)
