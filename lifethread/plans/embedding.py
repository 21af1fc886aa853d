"""Text to vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifethread.runtime import ship, spread

BATCH_TEXTS = 32
DIMENSIONS = 256

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def _grams(text: Column) -> Column:
    """Words and pairs of neighbouring words, lower case."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    pairs = F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    return F.concat(words, pairs)


def embed(
    df: DataFrame, id_col: str, text: str, embedder: Embedder | None = None, batch: int = BATCH_TEXTS,
    dimensions: int = DIMENSIONS, out: str = "vec", failed: str = "zero",
) -> DataFrame:
    """Unit vectors of texts, as (id, vec). Empty text, and text whose batch fails, is the zero vector; with ``failed="null"`` the latter
    has none. An embedder must give ``dimensions`` numbers, so that all vectors have one width; the job fails if it gives others.

    Without an embedder a hashed word and word-pair count is used, which stays inside the JVM. An embedder
    maps a list of texts to vectors; it is called in batches inside the tasks and may build its model once
    per task on first use.
    """
    rows = spread(df.select(id_col, text))
    if embedder is None:
        grams = rows.withColumn("_grams", F.coalesce(_grams(F.col(text)), F.array().cast("array<string>")))
        counted = HashingTF(inputCol="_grams", outputCol="_tf", numFeatures=dimensions).transform(grams)
        unit = Normalizer(inputCol="_tf", outputCol="_unit", p=2.0).transform(counted)
        return unit.select(id_col, vector_to_array("_unit", dtype="float32").alias(out))

    kind = df.schema[id_col].dataType.simpleString()

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            texts = [t if isinstance(t, str) else "" for t in page[text]]
            vectors: list[np.ndarray] = []
            for lo in range(0, len(texts), batch):
                vectors.extend(_embed_batch(texts[lo : lo + batch], embedder, dimensions))
            yield pd.DataFrame({id_col: page[id_col], out: vectors})

    ship(df.sparkSession)
    made = rows.mapInPandas(run, f"{id_col} {kind}, {out} array<float>")
    zero = F.array_repeat(F.lit(0.0).cast("float"), dimensions)
    return made if failed == "null" else made.withColumn(out, F.coalesce(out, zero))


def _embed_batch(texts: list[str], embedder: Embedder, dimensions: int) -> list[np.ndarray | None]:
    """Unit vectors; zeros for blank texts, nothing for the others of a failed batch."""
    full = [i for i, t in enumerate(texts) if t.strip()]
    rows = [np.zeros(dimensions, dtype=np.float32) for _ in texts]
    if not full:
        return rows
    try:
        made = np.asarray(embedder([texts[i] for i in full]), dtype=np.float64)
    except Exception:  # the job goes on without the batch
        return [None if t.strip() else r for t, r in zip(texts, rows)]
    if made.shape != (len(full), dimensions):
        raise ValueError(f"the embedder gave {made.shape} for {len(full)} texts of {dimensions} dimensions")
    length = np.linalg.norm(made, axis=1, keepdims=True)
    made = (made / np.where(length > 0, length, 1.0)).astype(np.float32)
    for i, v in zip(full, made):
        rows[i] = v
    return rows
