"""Vector blocks: every query row against every corpus row, without emitting the pairs.

Three physical ways, chosen by counted sizes:

* corpus small: it is sent to the tasks once and the queries stream past it; nothing is shuffled;
* queries small: they are sent to the tasks and the corpus streams past them; each task keeps the best rows;
* neither: both are cut into blocks of bounded size, a task sees one block of each, and only a block's
  best rows leave it. Large groups are cut into more blocks, so no group is ever one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lifethread.operators.history import best_rows
from lifethread.runtime import materialize_seen, ship

# A side may be sent to all tasks when it has at most this many vector elements (64 MB as doubles).
SENT_ELEMENTS = 8_000_000
SENT_ROWS = 200_000
BLOCK_ROWS = 8192
RANK_DIGITS = 9
# So many partial lists of one question are merged at once.
FAN = 32
# A kernel sees at most so many pairs at a time (16 MB a matrix of doubles), and so many corpus rows where its lists can be merged.
TILE_CELLS = 1 << 21
TILE_ROWS = 8192
# A block of questions gives at most so many rows where each of them may have many.
RESULT_ROWS = 1 << 20


@dataclass
class Side:
    """Unit vectors of one block with the columns that travel with them."""

    ids: np.ndarray
    unit: np.ndarray
    cols: dict[str, np.ndarray]

    def take(self, rows: np.ndarray | slice) -> "Side":
        return Side(self.ids[rows], self.unit[rows], {n: c[rows] for n, c in self.cols.items()})


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit_rows(m: np.ndarray) -> np.ndarray:
    if m.size == 0:
        return m
    length = np.sqrt(np.einsum("ij,ij->i", m, m))
    return m / np.where(length > 0, length, 1.0)[:, None]


def side(table: pa.Table, id_col: str, vec_col: str, extra: Sequence[str]) -> Side:
    plain = lambda c: np.asarray(table.column(c).to_pandas())
    return Side(plain(id_col), unit_rows(matrix(table.column(vec_col))), {c: plain(c) for c in extra})


def similarity(q: Side, c: Side) -> np.ndarray:
    if len(q.ids) == 0 or len(c.ids) == 0:
        return np.zeros((len(q.ids), len(c.ids)))
    return np.round(q.unit @ c.unit.T, RANK_DIGITS)


def best_per_row(scores: np.ndarray, tie: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` highest scores of each row, low ``tie`` first; -inf is never taken."""
    if scores.size == 0:
        return np.zeros(0, dtype=int), np.zeros(0, dtype=int)
    if scores.shape[1] > k:
        cut = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        row, col = np.nonzero((scores >= cut[:, None]) & (scores > -np.inf))
    else:
        row, col = np.nonzero(scores > -np.inf)
    order = np.lexsort((tie[col], -scores[row, col], row))
    row, col = row[order], col[order]
    first = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, dtype=bool)
    place = np.arange(len(row)) - np.maximum.accumulate(np.where(first, np.arange(len(row)), 0)) if len(row) else row
    kept = place < k
    return row[kept], col[kept]


def tie_codes(ids: np.ndarray) -> np.ndarray:
    return np.unique(ids, return_inverse=True)[1]


Kernel = Callable[[Side, Side], dict[str, np.ndarray]]


def may_be_sent(df: DataFrame, vec: str) -> bool:
    """Whether the vectors of ``df`` are few and short enough to go to every task; looks no further than needed."""
    probe = df.select(F.size(vec).alias("n")).limit(SENT_ROWS + 1).agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("width")).first()
    return probe["rows"] <= SENT_ROWS and probe["rows"] * (probe["width"] or 0) <= SENT_ELEMENTS


def block_apply(
    queries: DataFrame, corpus: DataFrame, kernel: Kernel, out_schema: str, *, qid: str, cid: str, vec: str,
    q_extra: Sequence[str] = (), c_extra: Sequence[str] = (), by: Sequence[str] = (), unit: str | None = None,
    combine: Kernel | None = None, block_rows: int = BLOCK_ROWS, way: str | None = None,
) -> DataFrame:
    """Apply ``kernel`` to blocks of queries and corpus and return its rows.

    Rows of one ``unit`` value of the corpus (default: its id) stay in one block. With ``by`` only rows of
    equal ``by`` meet. The result holds each query once per corpus block; the caller picks the best.
    """
    return _apply(queries, corpus, kernel, out_schema, qid, cid, vec, q_extra, c_extra, by, unit, combine, block_rows, way, block_rows)[0]


def block_best(
    queries: DataFrame, corpus: DataFrame, kernel: Kernel, out_schema: str, keys: Sequence[str], order: Sequence[Column], k: int, *,
    qid: str, cid: str, vec: str, q_extra: Sequence[str] = (), c_extra: Sequence[str] = (), by: Sequence[str] = (), unit: str | None = None,
    combine: Kernel | None = None, block_rows: int = BLOCK_ROWS, way: str | None = None, rank: str | None = None, fan: int = FAN,
) -> DataFrame:
    """The first ``k`` rows per ``keys`` of ``block_apply``, the partial lists merged as a tree.

    A task that reads the corpus hands on at most ``k`` rows per question. ``fan`` lists of a question are merged at a time, so a
    merging task meets at most ``fan * k`` rows of one question however many tasks read the corpus, and rounds grow by their logarithm.
    """
    # Long lists come from few questions and wide blocks of the corpus, so that a block's lists are bounded and mostly final.
    found, way, blocks = _apply(
        queries, corpus, kernel, out_schema, qid, cid, vec, q_extra, c_extra, by, unit, combine, max(block_rows, 8 * k), way, max(1, min(block_rows, RESULT_ROWS // max(k, 1))),
    )
    if way == "corpus":  # a question met the whole corpus in one task
        return best_rows(found, keys, order, k, rank=rank)
    tagged = found.withColumn("_list", F.spark_partition_id())
    if way == "queries":  # how many tasks read the corpus is known once they ran
        tagged, lists = materialize_seen(tagged, "partial-lists", F.max("_list") + 1)
    else:
        lists = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        if lists > fan and (blocks.agg(F.max("_blocks")).first()[0] or 0) <= fan:  # a question has at most one list per corpus block
            lists = 1
    return merged_lists(tagged, keys, order, k, lists, fan, rank)


def merged_lists(tagged: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, lists: int, fan: int = FAN, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows per ``keys`` of at most ``lists`` lists, numbered from 0 in ``_list``."""
    while lists > fan:
        lists = -(-lists // fan)
        tagged = best_rows(tagged.withColumn("_list", F.floor(F.col("_list") / fan).cast("int")), [*keys, "_list"], order, k)
    return best_rows(tagged.drop("_list"), keys, order, k, rank=rank)


def _apply(
    queries: DataFrame, corpus: DataFrame, kernel: Kernel, out_schema: str, qid: str, cid: str, vec: str, q_extra: Sequence[str],
    c_extra: Sequence[str], by: Sequence[str], unit: str | None, combine: Kernel | None, block_rows: int, way: str | None, question_rows: int,
) -> tuple[DataFrame, str, DataFrame | None]:
    """The rows of ``block_apply``, the way that was taken, and the number of corpus blocks per ``by`` if it was cut."""
    ship(queries.sparkSession)
    schema = to_arrow_schema(T.StructType.fromDDL(out_schema))
    names = schema.names
    q = queries.select(*dict.fromkeys([qid, vec, *q_extra, *by]))
    c = corpus.select(*dict.fromkeys([cid, vec, *c_extra, *by, *([unit] if unit else [])])).where(F.col(vec).isNotNull())
    q = q.where(F.col(vec).isNotNull())
    q_more = list(dict.fromkeys([*q_extra, *by]))
    c_more = list(dict.fromkeys([*c_extra, *by, *([unit] if unit else [])]))

    def rows(found: dict[str, np.ndarray]) -> pa.Table:
        return pa.table([pa.array(found[f.name], type=f.type) for f in schema], schema=schema)

    def meet(a: Side, b: Side) -> pa.Table:
        """The kernel's rows, tile by tile: what is held grows with the two sides and the result, not with their product."""
        wide = max(len(b.ids), 1) if combine is None else min(max(len(b.ids), 1), TILE_ROWS)
        high = max(1, TILE_CELLS // wide)
        tiles = [b.take(slice(at, at + wide)) for at in range(0, len(b.ids), wide)]
        out = [schema.empty_table()]
        for lo in range(0, len(a.ids), high):
            part, held = a.take(slice(lo, lo + high)), []
            for tile in tiles:
                held.append(rows(kernel(part, tile)))
                if len(held) > 1:
                    held = [_recombine(held, combine, names)]
            out += held
        return pa.concat_tables(out)

    if way is None and not by:
        if may_be_sent(c, vec):
            way = "corpus"
        elif unit is None and may_be_sent(q, vec):
            way = "queries"
    if way == "corpus" and not by:
        sent = q.sparkSession.sparkContext.broadcast(side(c.toArrow(), cid, vec, c_more))

        def past_corpus(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from meet(side(pa.Table.from_batches([batch]), qid, vec, q_more), sent.value).to_batches()

        return q.mapInArrow(past_corpus, out_schema), way, None
    if way == "queries" and not by and unit is None:
        sent = q.sparkSession.sparkContext.broadcast(side(q.toArrow(), qid, vec, q_more))

        def past_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.Table] = []
            for batch in batches:
                held.append(meet(sent.value, side(pa.Table.from_batches([batch]), cid, vec, c_more)))
                if sum(t.num_rows for t in held) > 4 * block_rows and combine is not None:
                    held = [_recombine(held, combine, names)]
            if held:
                yield from _recombine(held, combine, names).to_batches()

        return c.mapInArrow(past_queries, out_schema), way, None

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return schema.empty_table()
        return meet(side(left, qid, vec, q_more), side(right, cid, vec, c_more))

    cells, sizes = block_cells(q, c, cell, out_schema, qid=qid, unit=unit or cid, by=by, question_rows=question_rows, block_rows=block_rows)
    return cells, "blocks", sizes


def block_cells(
    q: DataFrame, c: DataFrame, cell: Callable[[pa.Table, pa.Table], pa.Table], out_schema: str, *, qid: str, unit: str, by: Sequence[str] = (),
    question_rows: int = BLOCK_ROWS, block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """The rows of ``cell`` for every block of ``q`` and block of ``c`` of equal ``by``, and the number of blocks of ``c`` per ``by``.

    Rows of one ``qid`` and of one ``unit`` stay in one block. A cell's tables have all columns of their sides.
    """
    q_sized, c_sized = _blocked(q, qid, by, question_rows), _blocked(c, unit, by, block_rows)
    keys = [*by, "_qb", "_cb"]
    q_cells = q_sized["rows"].withColumnRenamed("_block", "_qb")
    c_cells = c_sized["rows"].withColumnRenamed("_block", "_cb")
    q_cells = _against(q_cells, c_sized["sizes"], by, "_cb")
    c_cells = _against(c_cells, q_sized["sizes"], by, "_qb")
    c_cells = c_cells.select(*[F.col(n).alias(n) for n in c_cells.columns])  # both sides may stem from one table
    return q_cells.groupBy(*keys).cogroup(c_cells.groupBy(*keys)).applyInArrow(cell, out_schema), c_sized["sizes"]


def _recombine(held: list[pa.Table], combine: Kernel | None, names: list[str]) -> pa.Table:
    whole = pa.concat_tables(held)
    return whole if combine is None else combine(whole)


def _blocked(df: DataFrame, unit: str, by: Sequence[str], block_rows: int) -> dict[str, DataFrame]:
    """Rows with a block number, and the number of blocks per ``by`` value."""
    sizes = df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_blocks"))
    sizes = sizes.where("_blocks > 0")
    if by:
        rows = df.join(sizes, list(by))
    else:
        first = sizes.first()
        rows = df.withColumn("_blocks", F.lit(first["_blocks"] if first else 1))
    block = F.pmod(F.xxhash64(unit), F.col("_blocks").cast("long")).cast("int")
    return {"rows": rows.withColumn("_block", block).drop("_blocks"), "sizes": sizes}


def _against(rows: DataFrame, sizes: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Copy rows once per block of the other side."""
    spread = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias(name)
    if by:
        return rows.join(sizes, list(by)).select(*rows.columns, spread)
    first = sizes.first()
    return rows.withColumn("_blocks", F.lit(first["_blocks"] if first else 1)).select(*rows.columns, spread)
