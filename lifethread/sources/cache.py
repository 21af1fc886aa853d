"""Vector cache."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifethread.plans.embedding import DIMENSIONS, Embedder, embed


def cached_vectors(spark, path: str, id_type: str) -> DataFrame:
    """The cache as a table (id, vec); empty when nothing was stored yet."""
    schema = f"id {id_type}, vec array<float>"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def embed_with_cache(df: DataFrame, id_col: str, text: str, path: str, embedder: Embedder | None = None, **how) -> DataFrame:
    """Vectors of ``df`` from the cache; those not there are computed and appended first.

    Texts of failed batches are zero vectors in the result and are not stored, so that the next run tries them again.
    """
    kind = df.schema[id_col].dataType.simpleString()
    spark = df.sparkSession
    wanted = df.select(F.col(id_col).alias("id"), F.col(text).alias("_text"))
    missing = wanted.join(cached_vectors(spark, path, kind).select("id"), "id", "left_anti").dropDuplicates(["id"])
    embed(missing, "id", "_text", embedder, failed="null", **how).where("vec IS NOT NULL").write.mode("append").parquet(path)
    zero = F.array_repeat(F.lit(0.0).cast("float"), how.get("dimensions", DIMENSIONS))
    found = wanted.select("id").join(cached_vectors(spark, path, kind), "id", "left")
    return found.select(F.col("id").alias(id_col), F.coalesce("vec", zero).alias("vec"))
