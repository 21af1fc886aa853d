"""Removal of repeated word windows by Rabin-Karp hashes counted in Spark.

Every window of ``size`` words is judged by a 96-bit rolling hash. Windows are first counted under a representative: the smallest hash of the
``gram``-word slices inside. Equal windows have equal representatives and neighbours mostly share one, so a text has about 2 / (size - gram) of them
per word. A window whose representative stands at one place only stands there only; the hashes of all other windows are counted themselves,
once per document. A window goes if an equal one is in a document of smaller id or starts earlier in its own; windows that overlap or touch
merge to maximal removal intervals. A document whose whole text a smaller id has goes as a whole, so its windows are not counted again.

The text is shuffled once: the joins that need it have the same exchange. So are the windows, whose groups are bounded: under representatives with
about ``1 / FREQUENT`` of all places or more (at most ``FREQUENT`` of them) windows are first counted, combined before their shuffle, and the
hot ones, with such a share of them, go to all tasks with their smallest place (at most ``FREQUENT``) and are no rows at all.

Defined results: null and empty texts have no words; ids that are null come before all others and count as one document; rows that repeat an id have
the same place in the order, so they do not remove each other's windows; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lifethread.llm.arrays import Rolling, Words, map_pieces, mix, runs
from lifethread.runtime import materialize

FREQUENT = 4096
#: Stands for a null id in the order.
_FIRST = -(1 << 63)


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:  # noqa: ANN001
    """``pick`` (minimum or maximum) over ``width`` values from each place on; shorter by ``width - 1``."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def _windows(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, first words, window hashes and document of every window."""
    h = words.hashes()
    first, n = words.windows(size)
    return h, first, Rolling(h)(first, first + size), np.repeat(np.arange(len(n)), n)


def representatives(words: Words, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(slice hash, document) of every place that represents a window, and (first word, representative) of every window."""
    h = words.hashes()
    first, n = words.windows(size)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), first, np.zeros(0, np.uint64)
    slices = Rolling(h)(np.arange(len(h) - gram + 1), np.arange(gram, len(h) + 1))
    wide = size - gram + 1
    least = _slide(slices, wide, np.minimum)
    chosen = np.zeros(len(slices) + 2 * (wide - 1), np.uint64)  # of the windows that lie in one document, at their first slice
    chosen[wide - 1 + first] = least[first]
    most = _slide(chosen, wide, np.maximum)[: len(slices)]
    at = np.flatnonzero((most == slices) & (most > 0))
    return slices[at], np.searchsorted(words.bounds, at, side="right") - 1, first, least[first]


def _removed(words: Words, size: int, hot: Hot, doomed: list[np.ndarray], copy: np.ndarray, place: np.ndarray) -> np.ndarray:
    """True for every word inside a window that goes. ``doomed``: window hashes that smaller ids hold, by document; ``copy``: a smaller id has the text."""
    h, first, value, doc = _windows(words, size)
    marks = np.zeros(len(words.start) + 1, np.int64)
    if len(first):
        key = mix(value + mix(doc.astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        gone = copy[doc] | (place[doc] > _hot_places(h, first, value, size, hot))
        gone[order[1:]] |= key[order[1:]] == key[order[:-1]]
        edge = np.searchsorted(doc, np.arange(len(words.counts) + 1))
        for d, list_of in enumerate(doomed):
            if len(list_of):
                gone[edge[d]: edge[d + 1]] |= np.isin(value[edge[d]: edge[d + 1]], list_of)
        np.add.at(marks, first[gone], 1)
        np.add.at(marks, first[gone] + size, -1)
    return np.cumsum(marks)[:-1] > 0


def _doomed_lists(batch: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    copy = np.array([bool(x) for x in batch.column("copy").to_pylist()], bool)
    return [np.array(x, np.int64).view(np.uint64) if x else np.zeros(0, np.uint64) for x in batch.column("doomed").to_pylist()], copy, batch.column("place").to_numpy()


Hot = tuple[np.ndarray, np.ndarray, np.ndarray]


def _hot_windows(windows: DataFrame) -> Hot:
    """Sorted hashes, second hashes and smallest places of the windows that make about ``1 / FREQUENT`` of ``windows`` or more (at most FREQUENT)."""
    counts = materialize(windows.groupBy("h", "g").agg(F.min("place").alias("least"), F.count("*").alias("n")).filter("n > 1"), "substring-hot")
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.filter(F.col("n") * FREQUENT >= total).orderBy("h", "g").toPandas()
    h = found["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h, kind="stable")
    return h[order], found["g"].to_numpy(np.int32)[order], found["least"].to_numpy(np.int64)[order]


def _hot_places(words: np.ndarray, first: np.ndarray, value: np.ndarray, size: int, hot: Hot) -> np.ndarray:
    """The smallest place of every window that is hot; the highest number for others."""
    least = np.full(len(value), np.iinfo(np.int64).max)
    known = np.flatnonzero(np.isin(value, hot[0])) if len(hot[0]) else np.zeros(0, np.int64)
    if len(known):
        at = np.searchsorted(hot[0], value[known])
        same = _second(words, first[known], size) == hot[1][at]
        least[known[same]] = hot[2][at[same]]
    return least


def _second(words: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    return (Rolling(mix(words))(first, first + size) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def mark_repeats(docs: DataFrame, size: int = 20, gram: int = 6) -> tuple[DataFrame, Hot]:
    """The rows of ``docs`` with ``place`` (their id in the order), ``doomed`` (hashes of the windows that a smaller id holds, but for the hot
    ones) and ``copy``; and the hot windows with their smallest places."""
    rows = docs.withColumn("place", F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)))
    texts = rows.select("place", F.col("text").cast("string").alias("text"))

    def stand_for(batch: pa.RecordBatch, words: Words) -> dict:
        value, doc, _, _ = representatives(words, size, gram)
        return {"slice": value.view(np.int64), "place": batch.column("place").take(pa.array(doc))}

    def counted(batch: pa.RecordBatch, words: Words) -> dict:
        value, n = np.unique(representatives(words, size, gram)[0], return_counts=True)
        return {"slice": value.view(np.int64), "n": n}

    shared = map_pieces(texts, counted, "slice long, n long").groupBy("slice").agg(F.sum("n").alias("n")).filter("n > 1")
    shared = materialize(shared, "substring-slices")
    places = shared.agg(F.sum("n")).first()[0] or 0
    frequent = np.sort(shared.filter(F.col("n") * FREQUENT >= places).select("slice").toPandas()["slice"].to_numpy(np.int64).view(np.uint64))  # at most FREQUENT
    shared = shared.select("slice")
    # Later copies of whole texts, of ids that have one row.
    named = materialize(texts.select("place", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("name")), "substring-names")
    least = materialize(named.groupBy("name").agg(F.min("place").alias("least"), F.max("place").alias("most")).filter("least < most").select("name", "least"), "substring-texts")
    single = named.groupBy("place").agg(F.count("*").alias("rows")).filter("rows = 1").select("place")
    copies = materialize(named.join(least, "name").filter("place > least").select("place").join(single, "place"), "substring-copies")
    held = map_pieces(texts, stand_for, "slice long, place long").join(shared, "slice").groupBy("place").agg(F.collect_set("slice").alias("slices"))
    held = held.join(copies, "place", "left_anti")

    def hashes(often: bool, hot: Hot):
        """Window hashes, once per document: of those with frequent representatives only, or of all that are not ``hot``."""

        def found(batch: pa.RecordBatch, words: Words) -> dict:
            _, _, first, least = representatives(words, size, gram)
            h = words.hashes()
            doc = np.searchsorted(words.bounds, first, side="right") - 1
            edge = np.searchsorted(doc, np.arange(len(words.counts) + 1))
            keep = np.zeros(len(first), bool)
            for d, slices in enumerate(batch.column("slices")):
                keep[edge[d]: edge[d + 1]] = np.isin(least[edge[d]: edge[d + 1]], slices.values.to_numpy().view(np.uint64))
            if often:
                keep &= np.isin(least, frequent)
            first, doc = first[keep], doc[keep]
            value = Rolling(h)(first, first + size)
            cool = _hot_places(h, first, value, size, hot) == np.iinfo(np.int64).max
            first, doc, value = first[cool], doc[cool], value[cool]
            order = np.lexsort((value, doc))
            value, second, doc = value[order], _second(h, first, size)[order], doc[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
            return {"h": value[new].view(np.int64), "g": second[new], "place": batch.column("place").take(pa.array(doc[new]))}

        return found

    told, none = "h long, g int, place long", (np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64))
    texts_held = texts.join(held, "place")
    hot = _hot_windows(map_pieces(texts_held, hashes(True, none), told)) if len(frequent) else none
    windows = map_pieces(texts_held, hashes(False, hot), told)
    least_place = F.min("place").over(Window.partitionBy("h", "g"))
    later = windows.withColumn("least", least_place).filter("place > least").select("place", "h", F.lit(False).alias("copy"))
    marks = later.unionByName(copies.select("place", F.lit(None).cast("long").alias("h"), F.lit(True).alias("copy")))
    doomed = marks.groupBy("place").agg(F.collect_list("h").alias("doomed"), F.max("copy").alias("copy"))
    return rows.join(doomed, "place", "left"), hot


def substring_digest(docs: DataFrame, size: int = 20, gram: int = 6) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space)."""

    def digest(batch: pa.RecordBatch, words: Words) -> dict:
        kept = ~_removed(words, size, hot, *_doomed_lists(batch))
        data, offsets = _joined(words, kept)
        sums = np.concatenate(([0], np.cumsum(~kept)))
        return {
            "doc_id": batch.column("doc_id"), "n_words": words.counts, "n_removed": sums[words.bounds[1:]] - sums[words.bounds[:-1]],
            "kept_sha256": [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())],
        }

    rows, hot = mark_repeats(docs.select("doc_id", "text"), size, gram)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "place", "doomed", "copy")
    return map_pieces(rows, digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _joined(words: Words, kept: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The kept words of each document joined by one space, as bytes and offsets."""
    data = words.data.copy()
    steps = np.zeros(len(data) + 2, np.int64)
    np.add.at(steps, words.start[kept], 1)
    np.add.at(steps, words.end[kept], -1)
    mask = np.cumsum(steps[:-1]) > 0
    at = np.flatnonzero(kept)
    doc = np.searchsorted(words.bounds, at, side="right")
    gap = words.end[at[:-1][doc[1:] == doc[:-1]]]  # the byte after a word that is not its document's last
    data[gap] = 32
    mask[gap] = True
    return memoryview(data[mask[: len(data)]].tobytes()), np.concatenate(([0], np.cumsum(mask[: len(data)])))[words.offsets]


def removal_spans(docs: DataFrame, size: int = 20, gram: int = 6) -> DataFrame:
    """(doc_id, first_word, last_word): the maximal removal intervals, words counted from 0."""

    def spans(batch: pa.RecordBatch, words: Words) -> dict:
        gone = _removed(words, size, hot, *_doomed_lists(batch))
        state = gone * (words.doc + 1)
        edge = runs(state)
        lo, hi = edge[:-1], edge[1:]
        take = np.flatnonzero(state[lo] > 0) if len(state) else np.zeros(0, np.int64)
        doc = words.doc[lo[take]] if len(state) else take
        return {"doc_id": batch.column("doc_id").take(pa.array(doc)), "first_word": lo[take] - words.bounds[doc], "last_word": hi[take] - 1 - words.bounds[doc]}

    rows, hot = mark_repeats(docs.select("doc_id", "text"), size, gram)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "place", "doomed", "copy")
    return map_pieces(rows, spans, "doc_id long, first_word long, last_word long")
