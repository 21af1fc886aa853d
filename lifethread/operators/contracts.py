"""Table contracts: unique keys, no NaN, valid values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def has_nan(vec: str) -> Column:
    return F.exists(vec, lambda x: F.isnan(x) | x.isNull())


def violations(
    df: DataFrame, unique: Sequence[Sequence[str]] = (), no_nan: Sequence[str] = (), valid: Mapping[str, Column] | None = None
) -> DataFrame:
    """Rows that break each rule: surplus rows per duplicated key, NaN vectors, false conditions."""
    per_row = {f"nan:{c}": has_nan(c) for c in no_nan} | {f"valid:{n}": ~c for n, c in (valid or {}).items()}
    parts = []
    if per_row:
        counted = df.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(f"r{i}") for i, c in enumerate(per_row.values())])
        pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("violations")) for i, n in enumerate(per_row)])
        parts.append(counted.select(F.inline(pairs)))
    for key in unique:
        surplus = df.groupBy(*key).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("violations"))
        parts.append(surplus.select(F.lit("unique:" + ",".join(key)).alias("rule"), "violations"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def expect(df: DataFrame, **rules) -> DataFrame:
    """``df`` itself when it keeps the rules; otherwise the job fails and says which rule broke."""
    broken = violations(df, **rules).where("violations > 0").limit(20).collect()
    if broken:
        raise ValueError("contract broken: " + ", ".join(f"{r['rule']} ({r['violations']})" for r in broken))
    return df
