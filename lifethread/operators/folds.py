"""Ordered folds: rows of a key pass through one task in order, in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

from lifethread.runtime import ship


def fold_sorted(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], fresh: Callable[[], object],
    step: Callable[[object, pd.DataFrame], Iterable[tuple]], schema: str,
    finish: Callable[[object], Iterable[tuple]] | None = None,
) -> DataFrame:
    """Run ``step(state, rows)`` over the ordered rows of each key, with a new state per key.

    For decisions that need the decision before them. Spark shuffles and sorts; a task then streams its
    keys batch by batch, so memory holds one batch and one state, not a key.
    """
    columns = [part.strip().split(" ")[0] for part in _fields(schema)]
    key_list = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: tuple | None = None
        state: object = None
        for batch in batches:
            if batch.empty:
                continue
            out: list[tuple] = []
            here, before = batch[key_list], batch[key_list].shift()
            change = ((here != before) & ~(here.isna() & before.isna())).any(axis=1).to_numpy(copy=True)
            change[0] = True  # a null key equals the null key before it
            starts = [i for i, c in enumerate(change) if c] + [len(batch)]
            for lo, hi in zip(starts[:-1], starts[1:]):
                key = tuple(None if pd.isna(v) else v for v in batch[key_list].iloc[lo])
                if key != current:
                    if current is not None and finish is not None:
                        out.extend(finish(state))
                    current, state = key, fresh()
                out.extend(step(state, batch.iloc[lo:hi]))
            yield pd.DataFrame(out, columns=columns)
        if current is not None and finish is not None:
            yield pd.DataFrame(list(finish(state)), columns=columns)

    ship(df.sparkSession)
    return df.repartition(*key_list).sortWithinPartitions(*key_list, *order).mapInPandas(run, schema)


def _fields(schema: str) -> list[str]:
    """Top-level fields of a DDL string; commas inside <> do not count."""
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(schema):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append(schema[start:i])
            start = i + 1
    return [*parts, schema[start:]]
