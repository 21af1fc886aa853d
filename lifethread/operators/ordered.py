"""Ordered scans that do not depend on how rows spread over keys.

A window over a key puts the whole key into one task. When one key may hold a large share of the
rows, the scan here cuts the ordered table into ranges of (key, order), scans every range by itself,
and carries totals over range borders. Only the keys that touch a border need a carry, at most two per
range, so the carried table is bounded by the number of partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lifethread.runtime import materialize

# Largest key that may still be scanned by a plain window.
WINDOW_ROWS = 2_000_000

_BEFORE = (Window.unboundedPreceding, -1)
_UPTO = (Window.unboundedPreceding, 0)
_AFTER = (0, Window.unboundedFollowing)


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest key; counted map-side first."""
    if not keys:
        return df.count()
    top = df.groupBy(*keys).count().agg(F.max("count").alias("m")).first()
    return int(top["m"] or 0)


class OrderedScan:
    """Running values over rows ordered inside keys.

    ``split=None`` looks at the largest key and takes plain windows when it is small; ``split=True``
    forces the range-cut scan, ``split=False`` the plain one (for keys bounded by the data model).
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], split: bool | None = None):
        self.keys, self.order = list(keys), list(order)
        if split is None:
            split = largest_group(df, self.keys) > WINDOW_ROWS
        self.split = split
        if split:
            ranged = df.repartitionByRange(*self.keys, *self.order).withColumn("_range", F.spark_partition_id())
            df = materialize(ranged, "ordered")
        self.df = df

    def _window(self, frame: tuple[int, int] | None = None):
        by = (["_range"] if self.split else []) + self.keys
        w = Window.partitionBy(*by).orderBy(*self.order)
        return w if frame is None else w.rowsBetween(*frame)

    def _border(self, totals: dict[str, Column]) -> DataFrame:
        """Totals of the keys at range borders: the first and the last key of every range."""
        key = F.struct(*[F.col(k) for k in self.keys]) if self.keys else F.struct(F.lit(0).alias("k"))
        local = self.df.groupBy("_range", *self.keys).agg(*[c.alias(n) for n, c in totals.items()])
        ends = self.df.groupBy("_range").agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
        at_end = key.eqNullSafe(F.col("_lo")) | key.eqNullSafe(F.col("_hi"))
        return local.join(F.broadcast(ends), "_range").where(at_end).drop("_lo", "_hi")

    def _carried(self, values: dict[str, tuple[Column, Column, tuple[int, int], Column, object]]) -> "OrderedScan":
        local = {f"_l_{n}": v[0].over(self._window(v[2])) for n, v in values.items()}
        df = self.df.withColumns(local)
        if self.split:
            border = self._border({f"_t_{n}": v[1] for n, v in values.items()})
            backward = {n for n, v in values.items() if v[2] == _AFTER}
            over = Window.partitionBy(*self.keys).orderBy("_range")
            carry = border.select(
                "_range", *self.keys,
                *[
                    v[3].over(over.rowsBetween(1, Window.unboundedFollowing) if n in backward else over.rowsBetween(*_BEFORE)).alias(f"_c_{n}")
                    for n, v in values.items()
                ],
            )
            same = F.col("d._range") == F.col("c._range")
            for k in self.keys:
                same = same & F.col(f"d.{k}").eqNullSafe(F.col(f"c.{k}"))
            df = (
                df.alias("d").join(F.broadcast(carry.alias("c")), same, "left")
                .select("d.*", *[f"c._c_{n}" for n in values])
            )
            merged = {n: v[4](F.col(f"_l_{n}"), F.col(f"_c_{n}")) for n, v in values.items()}
        else:
            merged = {n: v[4](F.col(f"_l_{n}"), F.lit(None)) for n, v in values.items()}
        df = df.withColumns(merged).drop(*[f"_l_{n}" for n in values], *[f"_c_{n}" for n in values])
        done = object.__new__(OrderedScan)
        done.keys, done.order, done.split, done.df = self.keys, self.order, self.split, df
        return done

    def running_sum(self, *, inclusive: bool = True, **cols: Column) -> "OrderedScan":
        """Running sums; ``inclusive=False`` leaves the row itself out (0 on the first row)."""
        frame = _UPTO if inclusive else _BEFORE

        def add(a: Column, b: Column) -> Column:
            zero = F.lit(0)
            return F.coalesce(a, zero) + F.coalesce(b, zero)

        return self._carried(
            {n: (F.sum(c), F.sum(c), frame, F.sum(f"_t_{n}"), add) for n, c in cols.items()}
        )

    def running_max(self, *, inclusive: bool = True, **cols: Column) -> "OrderedScan":
        frame = _UPTO if inclusive else _BEFORE
        return self._carried(
            {n: (F.max(c), F.max(c), frame, F.max(f"_t_{n}"), _larger) for n, c in cols.items()}
        )

    def following_max(self, **cols: Column) -> "OrderedScan":
        """Largest value from this row to the end of the key."""
        return self._carried(
            {n: (F.max(c), F.max(c), _AFTER, F.max(f"_t_{n}"), _larger) for n, c in cols.items()}
        )

    def previous(self, **cols: Column) -> "OrderedScan":
        """Value on the row before, null on the first row of a key."""
        at = F.struct(*[F.col(o) for o in self.order])
        boxed = {n: F.struct(c.alias("v")) for n, c in cols.items()}
        step = self._carried(
            {
                n: (
                    F.last(b), F.max_by(b, at), (-1, -1), F.last(f"_t_{n}", ignorenulls=True),
                    F.coalesce,
                )
                for n, b in boxed.items()
            }
            if self.split
            else {n: (F.last(b), b, (-1, -1), b, lambda a, c: a) for n, b in boxed.items()}
        )
        step.df = step.df.withColumns({n: F.col(f"{n}.v") for n in cols})
        return step

    def position(self, out: str = "pos_in_key") -> "OrderedScan":
        """1, 2, 3 ... inside each key."""
        if not self.split:
            done = object.__new__(OrderedScan)
            done.keys, done.order, done.split = self.keys, self.order, False
            done.df = self.df.withColumn(out, F.row_number().over(self._window()).cast("long"))
            return done
        return self.running_sum(**{out: F.lit(1).cast("long")})

    def with_columns(self, **cols: Column) -> "OrderedScan":
        done = object.__new__(OrderedScan)
        done.keys, done.order, done.split = self.keys, self.order, self.split
        done.df = self.df.withColumns(cols)
        return done

    def result(self) -> DataFrame:
        return self.df.drop("_range")


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def number_rows(df: DataFrame, order: Sequence[str], out: str = "meta_id", split: bool = True) -> DataFrame:
    """1, 2, 3 ... over the whole table; always range-cut, no single-task window."""
    return OrderedScan(df, [], order, split=split).position(out).result()
