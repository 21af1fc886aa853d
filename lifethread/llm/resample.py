"""Importance resampling towards a target: rows drawn without replacement by the likeness of their hashed n-grams to the target's.

Runs of one to ``n`` words are hashed into buckets (crc32 modulo ``buckets``); a bucket's gain is the log ratio of its smoothed shares in target
and corpus, counted over all rows of both. A row's weight is the mean gain of its features; its score adds Gumbel noise from a hash of the id, so
that the highest scores are a draw without replacement, the same in every run. Weights are summed over arrays, a piece of texts at a time.

The cutoff is found by weighted median-of-medians: every chunk of at most ``CHUNK`` stored keys gives the median of its remaining keys, the median
of these, weighted by remaining rows, becomes the pivot, and one pass counts both sides and takes the next medians. At least a quarter of the
remaining keys goes in every round, mostly half; a smaller table is written when an eighth is left. What reaches the driver is a key per
chunk and round, and at the end at most ``LAST`` keys. Only the winners are sorted, by ranges.

Order: score down, then doc_id up (null last), then a hash of the text, then the place in the scored table. So null and repeated ids, ties and repeated
rows each have a rank of their own; rows equal in id and text are interchangeable. Null texts have no words; rows with fewer than
``min_words`` are never drawn. A null id enters the noise as an empty text. Empty tables give an empty result; an empty target has equal shares.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifethread.llm.arrays import LOWER, Words, map_arrow, pieces, split_words, sum_by_doc
from lifethread.operators.ordered import number_rows
from lifethread.runtime import materialize

CHUNK = 1 << 18
LAST = 1_000
#: Bytes that are no part of a word after A-Z became lower case: all of ASCII but digits and letters.
BREAK = np.array([b < 128 and not (48 <= b <= 57 or 97 <= b <= 122) for b in range(256)])
KEY = ("k_score", "k_null", "k_id", "k_text", "k_place")


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = _crc_table()


def crc_onward(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, steps: int = 48) -> np.ndarray:
    """States of crc32 after the bytes ``start`` to ``end``; the first ``steps`` bytes of all words at once, the rest of long words each."""
    state, live = state.copy(), np.flatnonzero(end > start)
    for k in range(steps):
        if not len(live):
            return state
        at = state[live]
        state[live] = CRC[(at ^ data[start[live] + k]) & 255] ^ (at >> 8)
        live = live[end[live] > start[live] + k + 1]
    for i in live.tolist():
        state[i] = zlib.crc32(data[start[i] + steps: end[i]].tobytes(), int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return state


def feature_buckets(words: Words, n: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every length up to ``n``: buckets of the runs of so many words, and the bounds of documents in them."""
    data = words.data
    state = np.full(len(words.start), 0xFFFFFFFF, np.uint32)
    at = np.arange(len(words.start))
    for size in range(1, n + 1):
        first, count = words.windows(size)
        state = state[np.searchsorted(at, first)] if size > 1 else state
        if size > 1:
            state = CRC[(state ^ 32) & 255] ^ (state >> 8)
        last = first + size - 1
        state, at = crc_onward(state, data, words.start[last], words.end[last]), first
        yield ((state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype(np.int64), np.concatenate(([0], np.cumsum(count)))


def _texts(df: DataFrame) -> DataFrame:
    return df.select(F.col("text").cast("string").alias("text"))


def _split(data: np.ndarray, offsets: np.ndarray) -> Words:
    return split_words(LOWER[data], offsets, BREAK)


def bucket_counts(df: DataFrame, n: int = 2, buckets: int = 10_000) -> np.ndarray:
    """Features of all rows by bucket; a task sends at most one row per bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offsets in pieces(batch):
                for place, _ in feature_buckets(_split(data, offsets), n, buckets):
                    seen += np.bincount(place, minlength=buckets)
        at = np.flatnonzero(seen)
        yield {"bucket": at, "n": seen[at]}

    rows = map_arrow(_texts(df), count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down."""
    s_all, t_all, n = float(corpus.sum()), float(target.sum()), len(corpus)
    ratio = lambda s, t: ((t + 1.0) * (s_all + n)) / ((s + 1.0) * (t_all + n))
    return np.array([math.floor(1000 * math.log(ratio(float(s), float(t)))) for s, t in zip(corpus, target)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Thousandths of Gumbel noise from the id, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def importance_scores(docs: DataFrame, target: DataFrame, n: int = 2, buckets: int = 10_000, seed: int = 7, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, and the columns ``keep`` as ``keep_<name>``, for every row."""
    gains = bucket_gains(bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets))
    kinds = dict(docs.dtypes)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch):
                rows, words = batch.slice(lo, hi - lo), _split(data, offsets)
                total, count = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
                for place, bounds in feature_buckets(words, n, buckets):
                    total += sum_by_doc(gains[place], bounds)
                    count += np.diff(bounds)
                weight = np.where(count > 0, total // np.maximum(count, 1), 0)
                noises = np.array([noise(d, seed) for d in rows.column("doc_id").to_pylist()], np.int64)
                out = {"doc_id": rows.column("doc_id"), "n_words": words.counts, "n_features": count, "weight": weight, "score": weight + noises}
                yield out | {"text_hash": rows.column("text_hash")} | {f"keep_{k}": rows.column(f"keep_{k}") for k in keep}

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"),
        *(F.col(f"`{k}`").alias(f"keep_{k}") for k in keep),
    )
    ddl = ["doc_id long, n_words long, n_features long, weight long, score long, text_hash long", *(f"`keep_{k}` {kinds[k]}" for k in keep)]
    return map_arrow(rows, score, ", ".join(ddl))


def _before(key: tuple[int, ...]) -> Column:
    """Whether a row's key is ``key`` or comes before it."""
    out = F.lit(True)
    for name, value in reversed(list(zip(KEY, key))):
        out = (F.col(name) < value) | ((F.col(name) == value) & out)
    return out


def _at_most(columns: np.ndarray, key: tuple[int, ...]) -> np.ndarray:
    out = np.ones(columns.shape[1], bool)
    for column, value in reversed(list(zip(columns, key))):
        out = (column < value) | ((column == value) & out)
    return out


def _lower_median(columns: np.ndarray) -> tuple[int, ...]:
    order = np.lexsort(columns[::-1])
    return tuple(int(x) for x in columns[:, order[(len(order) - 1) // 2]])


def _halves(keys: DataFrame, pivot: tuple[int, ...] | None, chunk: int) -> list:
    """Per chunk and side of the pivot: rows and their median key."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[np.ndarray] = []

        def give() -> Iterator[dict]:
            columns = np.concatenate(held, axis=1)
            low = _at_most(columns, pivot) if pivot is not None else np.zeros(columns.shape[1], bool)
            for side, part in ((0, columns[:, low]), (1, columns[:, ~low])):
                if part.shape[1]:
                    yield {"side": [side], "n": [part.shape[1]], **{k: [v] for k, v in zip(KEY, _lower_median(part))}}

        for batch in batches:
            for lo in range(0, batch.num_rows, chunk):
                held.append(np.array([batch.column(k).slice(lo, chunk).to_numpy(zero_copy_only=False) for k in KEY], np.int64))
                if sum(x.shape[1] for x in held) >= chunk:
                    yield from give()
                    held.clear()
        if held:
            yield from give()

    return map_arrow(keys.select(*KEY), split, "side int, n long, " + ", ".join(f"{k} long" for k in KEY)).collect()


def _weighted_median(medians: list) -> tuple[int, ...]:
    rows = sorted((tuple(r[k] for k in KEY), r["n"]) for r in medians)
    half, seen = sum(n for _, n in rows) / 2, 0
    for key, n in rows:
        seen += n
        if seen >= half:
            return key
    raise ValueError("no rows")


def cutoff_key(keys: DataFrame, k: int, chunk: int = CHUNK, last: int = LAST) -> tuple[int, ...]:
    """The ``k``-th smallest of the stored keys, which all differ; ``k`` counts from 1 and is at most the number of rows."""
    low = high = None  # the remaining keys come after ``low`` and not after ``high``
    rest, medians, stored = keys, _halves(keys, None, chunk), None
    while True:
        n = sum(r["n"] for r in medians)
        if n <= last:
            return sorted(tuple(r[c] for c in KEY) for r in rest.select(*KEY).collect())[k - 1]
        if stored is None or n * 8 <= stored:
            keys = keys if stored is None else materialize(rest.select(*KEY), "resample-rest")
            rest, low, high, stored = keys, None, None, n
        pivot = _weighted_median(medians)
        halves = _halves(rest, pivot, chunk)
        before = sum(r["n"] for r in halves if r["side"] == 0)
        if k <= before:
            high, medians = pivot, [r for r in halves if r["side"] == 0]
        else:
            low, medians, k = pivot, [r for r in halves if r["side"] == 1], k - before
        rest = keys if low is None else keys.filter(~_before(low))
        rest = rest if high is None else rest.filter(_before(high))


def importance_resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, n: int = 2, buckets: int = 10_000, seed: int = 7,
    keep: tuple[str, ...] = (), chunk: int = CHUNK, last: int = LAST,
) -> DataFrame:
    """The scores of every row and ``rank`` (1, 2, 3 ... of the drawn, null for others): of the rows with ``min_words`` words or more,
    ``percent`` of a hundred are drawn, rounded down."""
    scored = importance_scores(docs, target, n, buckets, seed, keep)
    may = F.col("n_words") >= min_words
    scored = scored.select("*", may.alias("may"), (-F.col("score")).alias("k_score"), F.col("doc_id").isNull().cast("long").alias("k_null"),
                           F.coalesce("doc_id", F.lit(0)).alias("k_id"), F.col("text_hash").alias("k_text"), F.monotonically_increasing_id().alias("k_place"))
    scored = materialize(scored, "resample-scored")
    out = ["doc_id", "n_words", "n_features", "weight", "score", "rank", *(f"`keep_{c}`" for c in keep)]
    draw = scored.filter("may").count() * percent // 100
    if not draw:
        return scored.withColumn("rank", F.lit(None).cast("long")).select(*out)
    won = F.col("may") & _before(cutoff_key(scored.filter("may").select(*KEY), draw, chunk, last))
    ranked = number_rows(scored.filter(won), KEY, "rank")
    return ranked.select(*out).unionByName(scored.filter(~won).withColumn("rank", F.lit(None).cast("long")).select(*out))


def draw_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """The drawn rows, with the columns they came with."""
    keep = tuple(docs.columns)
    drawn = importance_resample(docs, target, keep=keep, **options).filter("rank IS NOT NULL")
    return drawn.select(*(F.col(f"`keep_{k}`").alias(k) for k in keep))


#: The query with the parameters of op12. A feature's bucket is computed once per different feature, byte by byte.
ORACLE = """
WITH crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
  FROM range(256) r(i)
), texts AS (
  SELECT 'd' AS kind, row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents
  UNION ALL
  SELECT 'b', row_number() OVER (), NULL, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), split AS (
  SELECT kind, r, doc_id, regexp_extract_all(x, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts
), held AS (
  SELECT kind, r, doc_id, len(w) AS n_words, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM split
), counted AS (
  SELECT kind, r, feature, count(*) AS n FROM (SELECT kind, r, unnest(f) AS feature FROM held) GROUP BY ALL
), known AS (
  SELECT feature, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(feature)), lambda i: ('0x' || substr(hex(encode(feature)), 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT feature FROM counted), crc
), placed AS (
  SELECT kind, r, bucket, sum(n) AS n FROM counted JOIN known USING (feature) GROUP BY ALL
), totals AS (
  SELECT coalesce(sum(n) FILTER (kind = 'd'), 0)::DOUBLE AS s_all, coalesce(sum(n) FILTER (kind = 'b'), 0)::DOUBLE AS t_all FROM placed
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain
  FROM (SELECT bucket, coalesce(sum(n) FILTER (kind = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (kind = 'b'), 0)::DOUBLE AS t FROM placed GROUP BY bucket), totals
), weights AS (
  SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM placed JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY r
), scored AS (
  SELECT doc_id, r, n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM held LEFT JOIN weights USING (r) WHERE kind = 'd'
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, r) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * n // 100 THEN place END AS rank FROM ordered
"""
