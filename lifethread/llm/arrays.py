"""Words of Arrow text columns as NumPy arrays: positions, 64-bit hashes, hashes of word windows.

A word is a maximal run of bytes other than space and 0x09-0x0D, so positions never cut a UTF-8 character. Texts are cut between documents into
pieces of about ``PIECE`` bytes, which bounds the memory of a task whatever the batch; one longer document is a piece by itself. Every
function covers whole texts; null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lifethread.runtime import ship

PIECE = 1 << 21
#: The bytes that separate words.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The same class as a pattern, and the characters for trim().
WORD = "[^\\x20\\x09-\\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
#: Bytes below 0x80 that are neither letters nor digits.
MARK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_BASE = 0x9E3779B97F4A7C55
_UNBASE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW: list[np.ndarray] = [_powers(_BASE, 2), _powers(_UNBASE, 2)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        n = max(n, PIECE + 1)
        _POW[:] = [_powers(_BASE, n), _powers(_UNBASE, n)]
    return _POW[0], _POW[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h.astype(np.uint64)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Rolling:
    """Rabin-Karp hashes (modulo 2^64) of slices of ``values``; equal slices have equal hashes wherever they stand."""

    def __init__(self, values: np.ndarray) -> None:
        power, self.inverse = _tables(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[: len(values)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return Rolling(values)(start, end)


@dataclass
class Words:
    """Words of the documents of one piece. ``bounds[d]:bounds[d + 1]`` are the words of document ``d``."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        return span_hashes(LOWER[self.data] if lower else self.data, self.start, self.end)

    def cores(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words without marks at both ends; a word of marks only stays as it is."""
        start, end = self.start.copy(), self.end.copy()
        live = np.flatnonzero(MARK[self.data[end - 1]]) if len(end) else end
        while len(live):
            end[live] -= 1
            live = live[end[live] > start[live]]
            live = live[MARK[self.data[end[live] - 1]]]
        none = end == start
        end[none] = self.end[none]
        live = np.flatnonzero(MARK[self.data[start]] & ~none) if len(start) else start
        while len(live):  # ends at the latest at the solid byte that the word has
            start[live] += 1
            live = live[MARK[self.data[start[live]]]]
        return start, end

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of ``size`` words of one document, and the number of windows of each document."""
        n = np.maximum(self.counts - size + 1, 0)
        total = int(n.sum())
        first = np.repeat(self.bounds[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(total)
        return first, n


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string array."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]: offsets[-1]] if raw is not None and len(texts) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0] if len(texts) else np.zeros(1, np.int64)


def split_words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> Words:
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside[1:-1] & (edge[:-1] | ~inside[:-2]))
    end = np.flatnonzero(inside[1:-1] & (edge[1:] | ~inside[2:])) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def pieces(batch: pa.RecordBatch, text: str = "text", limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, bytes and offsets of the pieces of a batch."""
    data, offsets = text_buffers(batch.column(text))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo]
        lo = hi


def as_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    """A batch with the columns, order and types of ``schema``."""

    def column(v, kind: pa.DataType) -> pa.Array:
        v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v if isinstance(v, pa.Array) else pa.array(v) if isinstance(v, np.ndarray) else pa.array(v, kind)
        return v if v.type == kind else v.cast(kind)

    return pa.RecordBatch.from_arrays([column(columns[f.name], f.type) for f in schema], schema=schema)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], ddl: str) -> DataFrame:
    """``mapInArrow`` for functions that give dicts of columns."""
    ship(df.sparkSession)
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in f(batches):
            yield as_batch(x, schema)

    return df.mapInArrow(run, ddl)


def map_pieces(df: DataFrame, f: Callable, ddl: str, text: str = "text") -> DataFrame:
    """``f(rows, words)`` for every piece; gives a dict of columns or an iterator of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch, text):
                out = f(batch.slice(lo, hi - lo), split_words(data, offsets))
                yield from [out] if isinstance(out, dict) else out

    return map_arrow(df, run, ddl)


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin, with the length at the end."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]))


def sum_by_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of a value per word over each document."""
    sums = np.concatenate(([0], np.cumsum(values)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores behind it as it takes to be no column of ``df``."""
    used, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        out.append(name)
    return out


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id has none."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus
