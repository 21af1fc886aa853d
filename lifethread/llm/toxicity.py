"""Toxic passages by maximum-scoring segments.

Training: words (A-Z lower-cased, marks at the ends cut) of a bounded labelled sample, equal texts once, are counted by class; the log-odds of a
word, and of the first 4, 5 and 6 bytes of longer words, get a Dirichlet prior that pulls them to the share of all. Those far from zero in standard
deviations, and in at least ``support`` of the documents of their class, keep them; a word takes those of its longest form that has any, others
cost ``drift``. Scoring:
one linear scan over a text finds every maximal segment of positive total (Ruzzo and Tompa). A segment of score s in a text of n words is
expected K n exp(-lambda s) times in clean text; lambda solves sum p exp(lambda s) = 1 over the words of clean texts, K is the maximum-likelihood
value of the extreme-value distribution of their best segments. The excesses lambda s - ln(K n) of all significant segments are summed, and a
logistic curve fitted on the sample makes the sum a probability.

Defined results: null and empty texts have no segment; with no labelled rows, or one class, the score is the smoothed share of the label; rows
that repeat an id are scored by themselves; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifethread.llm.arrays import LOWER, Rolling, Words, map_pieces, remainder, runs
from lifethread.llm.labelled import fit_line, labelled_sample, sigmoid
from lifethread.runtime import materialize

_BLOOM = 1 << 20
#: Lengths in bytes of the beginnings that count beside whole words, longest first.
STEMS = (6, 5, 4)


def forms(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, words that have the form) of whole words and of their beginnings."""
    start, end = words.cores()
    roll, everyone = Rolling(LOWER[words.data]), np.arange(len(start))
    out = [(roll(start, end), everyone)]
    for k in STEMS:
        long = everyone[end - start > k]
        out.append((roll(start[long], start[long] + k) ^ np.uint64(k), long))
    return out


@dataclass
class ToxicModel:
    words: np.ndarray  # sorted hashes of the words that count
    odds: np.ndarray  # their log-odds
    drift: float
    rate: float = 1.0  # lambda
    factor: float = 1.0  # K
    slope: float = 0.0
    intercept: float = 0.0

    def __post_init__(self) -> None:
        self.mask = np.zeros(_BLOOM, bool)
        self.mask[(self.words % np.uint64(_BLOOM)).astype(np.int64)] = True

    def excess(self, n: float, scores: np.ndarray) -> np.ndarray:
        return self.rate * scores - np.log(max(self.factor * n, 1e-300))

    def probability(self, sums: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * sums + self.intercept)


def maximal_segments(at: np.ndarray, score: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score) of a text whose words ``at`` score ``score`` and whose others cost ``drift``."""
    stack: list[tuple[int, int, float, float]] = []  # first, last, total before, total after
    total, past = 0.0, 0
    for k, s in zip(at.tolist(), score.tolist()):
        total -= drift * (k - past)
        past = k + 1
        s -= drift
        if s <= 0:
            total += s
            continue
        first, before = k, total
        total += s
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= before:
                j -= 1
            if j < 0 or stack[j][3] >= total:
                break
            first, before = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((first, k, before, total))
    return [(a, b, y - x) for a, b, x, y in stack]


def word_odds(words: Words, model: ToxicModel) -> np.ndarray:
    """The log-odds of every word, 0 for those that have none."""
    value = np.zeros(len(words.start))
    for h, who in forms(words) if len(model.words) else ():
        maybe = np.flatnonzero(model.mask[(h % np.uint64(_BLOOM)).astype(np.int64)] & (value[who] == 0))
        if len(maybe):
            slot = np.minimum(np.searchsorted(model.words, h[maybe]), len(model.words) - 1)
            found = model.words[slot] == h[maybe]
            value[who[maybe[found]]] = model.odds[slot[found]]
    return value


def scan(words: Words, model: ToxicModel) -> Iterator[tuple[int, int, list[tuple[int, int, float]]]]:
    """(document, number of words, segments) of the documents that have a positive word."""
    value = word_odds(words, model)
    at = np.flatnonzero(value)
    cut = np.searchsorted(at, words.bounds)
    score = value[at]
    for d in np.flatnonzero(np.diff(cut)).tolist():
        lo, hi = cut[d], cut[d + 1]
        if (segments := maximal_segments(at[lo:hi] - words.bounds[d], score[lo:hi], model.drift)):
            yield d, int(words.counts[d]), segments


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, held: tuple[int, int] = (4, 2), strength: float = 2.0, z: float = 3.3, support: float = 0.02, drift: float = 0.1) -> ToxicModel:
    """Learn from at most ``max_rows`` labelled ids whose crc32 modulo ``held[0]`` is not ``held[1]``."""
    sample = labelled_sample(docs, labels, "toxic", max_rows, remainder("doc_id", held[0]) != held[1])
    distinct = sample.groupBy(F.md5(F.coalesce("text", F.lit("")))).agg(F.first("text").alias("text"), F.max("y").alias("y"))

    def count(rows, words: Words) -> dict:
        is_toxic, of = np.repeat(rows.column("y").to_numpy(zero_copy_only=False) > 0, words.counts), words.doc
        all_forms = forms(words)
        who = np.concatenate([w for _, w in all_forms])
        h, y, doc = np.concatenate([h for h, _ in all_forms]), is_toxic[who], of[who]
        order = np.lexsort((doc, h))
        h, y, doc = h[order], y[order], doc[order]
        edge = runs(h)
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))[: len(h)]

        def total(v: np.ndarray) -> np.ndarray:
            sums = np.concatenate(([0], np.cumsum(v)))
            return sums[edge[1:]] - sums[edge[:-1]]

        return {"h": h[edge[:-1]].view(np.int64), "c0": total(~y), "c1": total(y), "d0": total(new & ~y), "d1": total(new & y)}

    cells = ("c0", "c1", "d0", "d1")
    table = map_pieces(distinct, count, "h long, c0 long, c1 long, d0 long, d1 long").groupBy("h").agg(*(F.sum(c).alias(c) for c in cells))
    table = materialize(table, "toxic-words")
    n0, n1 = (int(x or 0) for x in table.agg(F.sum("c0"), F.sum("c1")).first())  # of all forms, as a share of each other
    docs0, docs1 = (int(x or 0) for x in distinct.agg(F.count_if(F.col("y") <= 0), F.count_if(F.col("y") > 0)).first())
    share = (n1 + 1) / (n0 + n1 + 2)
    a, b = F.col("c1") + strength * share, F.col("c0") + strength * (1 - share)
    odds = F.log(a / b) - float(np.log(share / (1 - share)))
    held_by = F.when(odds > 0, F.col("d1") >= max(4, support * docs1)).otherwise(F.col("d0") >= max(4, support * docs0))
    strong = table.filter(held_by & (F.abs(odds) >= z * F.sqrt(1 / a + 1 / b))).select("h", odds.alias("odds")) if n0 and n1 else None
    found = strong.toPandas() if strong is not None else None  # at most 2 / support times the words of a document
    if found is None or found.empty:
        h, o = np.zeros(0, np.uint64), np.zeros(0)
    else:
        h, o = found["h"].to_numpy().view(np.uint64), found["odds"].to_numpy(float)
    order = np.argsort(h)
    model = ToxicModel(h[order], o[order], drift)

    def segments(rows, words: Words) -> dict:
        best = {d: s for d, _, s in scan(words, model)}
        y = rows.column("y").to_pylist()
        return {"y": y, "n": words.counts, "scores": [[x[2] for x in best.get(d, [])] for d in range(len(y))]}

    seen = map_pieces(sample, segments, "y int, n long, scores array<double>").toPandas()  # a row of each sampled document
    calibrate(model, sample, seen, n0)
    return model


def calibrate(model: ToxicModel, sample: DataFrame, seen: pd.DataFrame, n0: int) -> None:
    """Set lambda and K on the clean rows, then the curve on all."""
    y, n = (seen["y"].to_numpy() > 0).astype(float), np.maximum(seen["n"].to_numpy(float), 1)
    scores = [np.asarray(s, float) for s in seen["scores"]]

    def hits(rows, words: Words) -> dict:
        keep, value = np.repeat(rows.column("y").to_numpy(zero_copy_only=False) == 0, words.counts), word_odds(words, model)
        odds, c = np.unique(value[keep], return_counts=True)
        return {"odds": odds, "c": c}

    if len(model.words) and n0:
        got = map_pieces(sample, hits, "odds double, c long").groupBy("odds").agg(F.sum("c").alias("c")).toPandas()  # a row of each word that counts
        got = got.merge(pd.DataFrame({"odds": np.unique(model.odds)}), "outer", "odds").fillna(0)
        odds, p = got["odds"].to_numpy(float), got["c"].to_numpy(float) + 0.5 * (got["odds"].to_numpy(float) > 0)
        p, step = p / p.sum(), odds - model.drift
        f = lambda x: float(p @ np.exp(np.minimum(x * step, 700))) - 1
        lo, hi = 1e-4, 1e-4
        while f(hi) < 0 and hi < 50:
            hi *= 1.5
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
        model.rate = hi
        clean = y == 0
        best = np.array([s.max() if len(s) else 0.0 for s in scores])
        if clean.any():
            model.factor = clean.sum() / max(float((n[clean] * np.exp(-model.rate * best[clean])).sum()), 1e-12)
    sums = np.array([np.maximum(model.excess(k, s), 0).sum() if len(s) else 0.0 for k, s in zip(n, scores)])
    model.slope, model.intercept = fit_line(sums, y)


def toxic_passages(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """(doc_id, first_word, last_word, score, excess): every significant passage, word positions counted from 0."""

    def find(rows, words: Words) -> dict:
        out = [(d, a, b, s, e) for d, n, segments in scan(words, model) for a, b, s in segments if (e := float(model.excess(max(n, 1), s))) > 0]
        ids = rows.column("doc_id").take(pa.array([x[0] for x in out], pa.int64()))
        return {"doc_id": ids, **{k: [x[i] for x in out] for i, k in enumerate(("first_word", "last_word", "score", "excess"), 1)}}

    return map_pieces(_narrow(docs), find, "doc_id long, first_word long, last_word long, score double, excess double")


def toxicity(docs: DataFrame, model: ToxicModel, threshold: float = 0.3, held: tuple[int, int] = (4, 2), keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted, and the columns ``keep``, for every row."""
    rows = _narrow(docs, keep)

    def score(batch, words: Words):
        sums = np.zeros(batch.num_rows)
        for d, n, segments in scan(words, model):
            sums[d] = np.maximum(model.excess(max(n, 1), np.array([s[2] for s in segments])), 0).sum()
        p = model.probability(sums)
        out = {"doc_id": batch.column("doc_id"), "score": p, "predicted": (p >= threshold).astype(np.int32)}
        return out | {f"keep_{k}": batch.column(f"keep_{k}") for k in keep}

    kinds = dict(docs.dtypes)
    scored = map_pieces(rows, score, ", ".join(["doc_id long, score double, predicted int", *(f"`keep_{k}` {kinds[k]}" for k in keep)]))
    held_out = F.coalesce(remainder("doc_id", held[0]) == held[1], F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", *(F.col(f"`keep_{k}`") for k in keep))


def _narrow(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(f"`{k}`").alias(f"keep_{k}") for k in keep))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The rows below ``threshold``, with the columns they came with."""
    model = train(docs, labels, **options)
    keep = tuple(docs.columns)
    clean = toxicity(docs, model, threshold, keep=keep).filter("predicted = 0")
    return clean.select(*(F.col(f"`keep_{k}`").alias(k) for k in keep))
