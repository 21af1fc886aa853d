"""Quality rules: text measures, and a calibrated logistic regression on hashed word and character n-grams.

The classifier is fitted on a bounded sample of labelled documents (whole texts): each is a vector of the shares of its words, word pairs and
character 4-grams in ``2 ** bits`` hashed places each. A fifth of the sample is kept from the fit and sets a logistic curve (Platt scaling), so the
score is a probability. Documents are scored in Arrow batches; no text leaves its task.

Defined results: null and empty texts have no words and fail the base rules; without labelled rows of both classes the classifier lets all pass that
the base rules pass; repeated ids give a row each; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifethread.llm.arrays import LOWER, Rolling, Words, map_pieces, mix, runs, sum_by_doc
from lifethread.llm.labelled import fit_line, labelled_sample, sigmoid

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_NEWLINE, _GRAM = 10, 4


@dataclass
class QualityModel:
    bits: int
    weights: np.ndarray | None = None  # words, word pairs, character 4-grams: 2 ** bits places each
    slope: float = 0.0
    intercept: float = 40.0

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * logit + self.intercept)


def _places(words: Words, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, bounds by document) of words, word pairs and character 4-grams (bytes, across blanks)."""
    h, down = words.hashes(lower=True), np.uint64(64 - bits)
    first, n = words.windows(2)
    pair = mix(h[first] * np.uint64(0x9E3779B97F4A7C15) + h[first + 1]) if len(first) else np.zeros(0, np.uint64)
    raw = LOWER[words.data].astype(np.uint32)
    if len(raw) >= _GRAM:
        gram = raw[:-3] | raw[1:-2] << np.uint32(8) | raw[2:-1] << np.uint32(16) | raw[3:] << np.uint32(24)
        gram = (gram * np.uint32(2654435761)) >> np.uint32(32 - bits)
    else:
        gram = np.zeros(0, np.uint32)
    kept = np.ones(len(gram), bool)  # those inside one document
    for back in range(1, _GRAM):
        cut = words.offsets[1:-1] - back
        kept[cut[(cut >= 0) & (cut < len(gram))]] = False
    bounds = np.searchsorted(np.flatnonzero(kept), words.offsets)
    return [((h >> down).astype(np.int64), words.bounds), ((pair >> down).astype(np.int64), np.concatenate(([0], np.cumsum(n)))), (gram[kept].astype(np.int64), bounds)]


def _logits(words: Words, model: QualityModel) -> np.ndarray:
    out = np.zeros(len(words.counts))
    for k, (place, bounds) in enumerate(_places(words, model.bits)):
        out += sum_by_doc(model.weights[k][place], bounds) / np.maximum(np.diff(bounds), 1)
    return out


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6_000, bits: int = 14, rounds: int = 300) -> QualityModel:
    """Fit on at most ``max_rows`` labelled ids; a row reaches the driver as its non-zero places only."""
    sample = labelled_sample(docs, labels, "quality", max_rows)

    def vectors(rows, words: Words):
        ys, ids = rows.column("y").to_pylist(), rows.column("doc_id").to_pylist()
        found = _places(words, bits)
        for d in range(rows.num_rows):
            at, share = [], []
            for k, (place, bounds) in enumerate(found):
                p, c = np.unique(place[bounds[d]: bounds[d + 1]], return_counts=True)
                at.append((p + (k << bits)).astype(np.int32))
                share.append((c / max(c.sum(), 1)).astype(np.float32))
            yield {"doc_id": [ids[d]], "y": [ys[d]], "at": [np.concatenate(at).tobytes()], "share": [np.concatenate(share).tobytes()]}

    rows = map_pieces(sample, vectors, "doc_id long, y int, at binary, share binary").toPandas().sort_values(["doc_id", "at"], kind="stable", ignore_index=True)
    y = (rows["y"].to_numpy() > 0).astype(np.float32)
    model = QualityModel(bits)
    if len(np.unique(y)) < 2:
        return model
    at = [np.frombuffer(b, np.int32) for b in rows["at"]]
    share = [np.frombuffer(b, np.float32) for b in rows["share"]]
    test = np.arange(len(y)) % 5 == 4
    fit = np.flatnonzero(~test) if len(np.unique(y[~test])) == 2 else np.arange(len(y))
    w, b = _fit([at[i] for i in fit], [share[i] for i in fit], y[fit], 3 << bits, rounds)
    model.weights = (w + b / 3).reshape(3, 1 << bits)
    logit = np.array([float(share[i] @ w[at[i]]) + b for i in range(len(y))])
    use = test if len(np.unique(y[test])) == 2 else np.ones(len(y), bool)
    model.slope, model.intercept = fit_line(logit[use], y[use])
    return model


def _fit(at: list[np.ndarray], share: list[np.ndarray], y: np.ndarray, width: int, rounds: int) -> tuple[np.ndarray, float]:
    """Logistic regression by Adagrad over all rows at once, classes weighed alike."""
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    square = np.zeros(width)
    for a, v in zip(at, share):
        square[a] += v * v
    scale = 1 / np.sqrt(square / len(y) + 1e-9)  # places of like spread
    chunks = []  # of 500 rows, which bounds what a round holds beside the rows
    for lo in range(0, len(y), 500):
        size = np.array([len(a) for a in at[lo: lo + 500]])
        col = np.concatenate(at[lo: lo + 500])
        chunks.append((lo, col, (np.concatenate(share[lo: lo + 500]) * scale[col]).astype(np.float32), np.concatenate(([0], np.cumsum(size)[:-1])), size))
    w, b, seen, seen_b = np.zeros(width), 0.0, np.full(width, 1e-8), 1e-8
    for _ in range(rounds):
        g, gb = 1e-4 * w, 0.0
        for lo, col, val, cut, size in chunks:
            p = sigmoid(np.add.reduceat(val * w[col], cut) + b)
            err = (p - y[lo: lo + 500]) * weight[lo: lo + 500]
            g += np.bincount(col, val * np.repeat(err, size), width)
            gb += err.sum()
        seen += g * g
        seen_b += gb**2
        w -= 0.1 * g / np.sqrt(seen)
        b -= 0.1 * gb / np.sqrt(seen_b)
    return w * scale, float(b)


def measures(words: Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each document."""
    data, offsets = words.data, words.offsets
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # code points before each byte
    chars = sum_by_doc(heads[words.end] - heads[words.start], words.bounds)
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[data])))
    # Lines: from a document's start or a newline to the next newline or the document's end.
    cut = np.flatnonzero(data == _NEWLINE)
    of_cut, each = np.searchsorted(offsets[1:-1], cut, side="right"), np.arange(len(offsets) - 1)
    start, end, doc = np.concatenate((offsets[:-1], cut + 1)), np.concatenate((cut, offsets[1:])), np.concatenate((each, of_cut))
    start, end, doc = start[(order := np.lexsort((doc, start)))], end[np.lexsort((np.concatenate((of_cut, each)), end))], doc[order]
    full = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    h = mix(Rolling(data)(start[full], end[full]) + mix(doc[full].astype(np.uint64)))
    again = len(h) and _repeats(h)
    lines = np.bincount(doc[full][again], minlength=len(offsets) - 1) if len(h) else np.zeros(len(offsets) - 1, np.int64)
    # Windows of three words found twice or more in their document.
    first, n = words.windows(3)
    covered = np.zeros(len(words.start) + 3, np.int64)
    if len(first):
        w = words.hashes()
        of = np.repeat(np.arange(len(n)), n).astype(np.uint64)
        key = mix(mix(w[first] + np.uint64(1)) * np.uint64(3) + mix(w[first + 1] + np.uint64(2)) * np.uint64(5) + w[first + 2] + mix(of))
        order = np.argsort(key, kind="stable")
        edge = runs(key[order])
        often = first[order[np.repeat(np.diff(edge) > 1, np.diff(edge))]]
        for k in range(3):
            covered[often + k] = 1
    return {
        "n_words": words.counts, "word_chars": chars, "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]], "n_dup_lines": lines,
        "n_repeat_words": sum_by_doc(covered[: len(words.start)], words.bounds),
    }


def _repeats(h: np.ndarray) -> np.ndarray:
    """True for every value that stands earlier in ``h`` too."""
    order = np.argsort(h, kind="stable")
    same = np.zeros(len(h), bool)
    same[order[1:]] = h[order[1:]] == h[order[:-1]]
    return same


def quality(docs: DataFrame, model: QualityModel, threshold: float = 0.5, min_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """The measures, base_failed, p_good (the classifier's probability) and kept, for every row."""

    def score(batch: pa.RecordBatch, words: Words) -> dict:
        m = measures(words)
        failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > most_repeated * m["n_words"])
        p = model.probability(_logits(words, model) if model.weights is not None else np.zeros(batch.num_rows))
        return {"doc_id": batch.column("doc_id"), **m, "base_failed": failed, "p_good": p, "kept": ~failed & (p >= threshold)}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_pieces(rows, score, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, p_good double, kept boolean")
