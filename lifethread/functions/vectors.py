"""Vector columns: algebra in double precision, means and medoids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def normalized(v: Column) -> Column:
    """Unit length; the zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(as_double(v), lambda x: x / n)).otherwise(as_double(v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 when either side is the zero vector."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).when(scale == 0, F.lit(0.0))


def normalize_vectors(df: DataFrame, col: str = "vec", out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, normalized(F.col(col)))


def pair_cosine(pairs: DataFrame, a: str = "vec_a", b: str = "vec_b", out: str = "cosine") -> DataFrame:
    return pairs.withColumn(out, cosine(F.col(a), F.col(b)))


def _vector(col: str) -> Column:
    return array_to_vector(as_double(F.col(col)))


def vec_mean(df: DataFrame, by: Sequence[str], col: str = "vec", out: str = "vec") -> DataFrame:
    """A3: element-wise mean per group, combined map-side before the shuffle."""
    mean = vector_to_array(Summarizer.mean(_vector(col)))
    return df.groupBy(*by).agg(mean.alias(out), F.count(F.lit(1)).alias("members"))


def vec_sum(df: DataFrame, by: Sequence[str], col: str = "vec", out: str = "vec_sum") -> DataFrame:
    """Element-wise sum and member count per group."""
    total = vector_to_array(Summarizer.sum(_vector(col)))
    return df.groupBy(*by).agg(total.alias(out), F.count(F.lit(1)).alias("members"))


def medoid(df: DataFrame, by: Sequence[str], id_col: str, col: str = "vec") -> DataFrame:
    """A4: the member nearest to the group mean by cosine distance; the lowest id wins ties."""
    centre = vec_mean(df, by, col, out="_centre").drop("members")
    near = df.join(centre, list(by)).withColumn(
        "_distance", F.round(F.lit(1.0) - cosine(F.col(col), F.col("_centre")), 9)
    )
    best = F.min(F.struct("_distance", F.col(id_col).alias("_id"), F.col(col).alias("_vec")))
    return (
        near.groupBy(*by)
        .agg(best.alias("_best"))
        .select(*by, F.col("_best._id").alias(id_col), F.col("_best._vec").alias(col), F.col("_best._distance").alias("distance"))
    )
