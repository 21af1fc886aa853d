"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds spans the patterns miss.

The field runs over segments of words around each word with a digit, ``@`` or ``+`` (two words on either side; elsewhere there is nothing to
find). Features are the shapes of a word and its neighbours, and checks of its digits. It is trained by gradient ascent on the likelihood from a
small labelled table of texts with spans; ``pattern_labels`` makes one from at most ``max_rows`` documents by the patterns, any other with the
same columns will do. Segments are decoded by Viterbi in NumPy batches of like length. A decoded span is added if it fits its kind (digits,
checksum, parts) and does not touch a pattern's span.

Defined results: null and empty texts have no span; without labelled rows only the patterns count; repeated ids give a row each; an empty table gives
an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifethread.llm.arrays import Words, map_pieces, runs
from lifethread.runtime import materialize

#: Kinds in the order of the output.
KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9.]+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CALLS = np.zeros(256, bool)
_CALLS[[ord(c) for c in "0123456789@+"]] = True


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def fits(kind: str, s: str) -> bool:
    """What a match of a kind must hold besides its form."""
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    d = _digits(s)
    return 12 <= len(d) <= 19 and luhn(d) if kind == "card" else 9 <= len(d) <= 15 if kind == "phone" else True


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every match begins with the longest run of local characters before an ``@``, so the search goes from ``@`` to ``@``."""
    past, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > past and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            past = m.end()
            yield start, past
        at = text.find("@", past if m else at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns, leftmost and non-overlapping for each kind, sorted; failing matches are dropped."""
    found = [(a, 0, b) for a, b in _emails(text)]
    for run in _DOTTED.finditer(text):
        if run[0].count(".") >= 3:
            found += [(m.start(), 1, m.end()) for m in _IP.finditer(text, run.start(), run.end()) if fits("ip", m[0])]
    found += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 12 and fits("card", m[0])]
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if fits("phone", m[0])]
    return sorted(found)


@lru_cache(100_000)
def shape(word: str) -> str:
    """Letters as a or A, runs of them once; runs of digits as their length."""
    out = re.sub(r"[0-9]+", lambda m: f"<{len(m[0])}>", re.sub(r"[^\W\d_]+", lambda m: "A" if m[0][0].isupper() else "a", word))
    return out if len(out) <= 40 else out[:20] + "~" + out[-19:]


@lru_cache(100_000)
def word_features(word: str) -> tuple[str, ...]:
    d = _digits(word)
    if not d and "@" not in word and "+" not in word:
        return ("plain",)
    bare = word.strip(".,;:!?()[]\"'")
    parts = bare.split(".")
    return (
        "s=" + shape(word), "b=" + shape(bare), f"n={min(len(d), 20)}", f"at={'@' in word}", f"plus={word.startswith('+')}",
        f"luhn={12 <= len(d) <= 19 and luhn(d)}", f"ip={len(parts) == 4 and all(p.isdigit() and p.isascii() and len(p) < 9 and int(p) <= 255 for p in parts)}",
        f"mail={_DOMAIN.search(bare) is not None}")


def features(words: list[str]) -> list[list[str]]:
    own = [word_features(w) for w in words]
    edge = ("edge",)
    return [
        ["bias", *f, *("p" + x for x in (own[k - 1] if k else edge)[:3]), *("q" + x for x in (own[k + 1] if k + 1 < len(own) else edge)[:3])]
        for k, f in enumerate(own)
    ]


@dataclass
class Field:
    """Weights by feature and label, and by neighbouring labels."""

    index: dict[str, int] = field(default_factory=dict)
    emit: np.ndarray = field(default_factory=lambda: np.zeros((0, len(LABELS))))
    move: np.ndarray = field(default_factory=lambda: np.zeros((len(LABELS), len(LABELS))))

    def scores(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(LABELS)))
        for k, f in enumerate(features(words)):
            at = [self.index[x] for x in f if x in self.index]
            if at:
                out[k] = self.emit[at].sum(0)
        return out


def _allowed() -> np.ndarray:
    """0 where a label may follow another; an inside label only follows its own kind."""
    out = np.zeros((len(LABELS), len(LABELS)))
    for j, b in enumerate(LABELS):
        if b[0] == "I":
            for i, a in enumerate(LABELS):
                if a[1:] != b[1:]:
                    out[i, j] = -1e4
    return out


_ALLOWED, _START = _allowed(), np.array([-1e4 if x[0] == "I" else 0.0 for x in LABELS])


def _pad(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(p) for p in parts])
    out = np.zeros((len(parts), size.max(), len(LABELS)))
    for k, p in enumerate(parts):
        out[k, : len(p)] = p
    return out, size


def viterbi(parts: list[np.ndarray], move: np.ndarray) -> list[np.ndarray]:
    """The best labels of each segment, from its scores."""
    e, size = _pad(parts)
    step = move + _ALLOWED
    best, back = e[:, 0] + _START, np.zeros(e.shape, np.int8)
    last = best.copy()
    for t in range(1, e.shape[1]):
        way = best[:, :, None] + step
        back[:, t] = way.argmax(1)
        best = way.max(1) + e[:, t]
        last[size == t + 1] = best[size == t + 1]
    at = last.argmax(1)
    out = np.zeros(e.shape[:2], np.int8)
    for t in range(e.shape[1] - 1, -1, -1):
        begin = size == t + 1
        if t + 1 < e.shape[1]:
            going = size > t + 1
            at = np.where(going, back[np.arange(len(parts)), t + 1, at], at)
        out[begin | (size > t + 1), t] = at[begin | (size > t + 1)]
    return [out[k, :n] for k, n in enumerate(size)]


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + np.squeeze(top, axis)


def fit(segments: list[list[str]], labels: list[list[int]], rounds: int = 120, rate: float = 0.3, prior: float = 1e-2) -> Field:
    """Maximum likelihood with a Gaussian prior, by Adagrad over all segments at once (forward-backward over a padded batch)."""
    model = Field()
    if not segments:
        return model
    feats = [features(s) for s in segments]
    for f in feats:
        for x in f:
            for name in x:
                model.index.setdefault(name, len(model.index))
    n, width, k = len(segments), max(map(len, segments)), len(LABELS)
    place = np.concatenate([np.full(len(x), i * width + t) for i, f in enumerate(feats) for t, x in enumerate(f)])
    name = np.array([model.index[y] for f in feats for x in f for y in x])
    size = np.array([len(s) for s in segments])
    mask = np.arange(width) < size[:, None]
    gold = np.zeros((n, width), int)
    for i, y in enumerate(labels):
        gold[i, : len(y)] = y
    gold_hot = np.eye(k)[gold] * mask[:, :, None]
    pair_gold = np.zeros((k, k))
    both = mask[:, 1:]
    np.add.at(pair_gold, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    model.emit = np.zeros((len(model.index), k))
    seen_e, seen_m = np.full(model.emit.shape, 1e-6), np.full((k, k), 1e-6)
    order = np.argsort(name, kind="stable")
    place_by, edge = place[order], runs(name[order])[:-1]
    by_place = runs(place)[:-1]
    for _ in range(rounds):
        e = np.zeros((n * width, k))
        e[place[by_place]] = np.add.reduceat(model.emit[name], by_place, axis=0)
        e = e.reshape(n, width, k)
        step = model.move + _ALLOWED
        ahead, behind = np.zeros((n, width, k)), np.zeros((n, width, k))
        ahead[:, 0] = e[:, 0] + _START
        for t in range(1, width):
            ahead[:, t] = _sum(ahead[:, t - 1][:, :, None] + step, 1) + e[:, t]
        for t in range(width - 2, -1, -1):
            behind[:, t] = np.where(mask[:, t + 1, None], _sum(step + (e[:, t + 1] + behind[:, t + 1])[:, None, :], 2), 0)
        total = _sum(ahead[np.arange(n), size - 1], 1)
        p = np.exp(np.minimum(ahead + behind - total[:, None, None], 0)) * mask[:, :, None]
        pair = np.zeros((k, k))
        for t in range(width - 1):
            rows = mask[:, t + 1]
            x = ahead[rows, t][:, :, None] + step + (e[rows, t + 1] + behind[rows, t + 1])[:, None, :] - total[rows, None, None]
            pair += np.exp(np.minimum(x, 0)).sum(0)
        g = (gold_hot - p).reshape(n * width, k)
        ge = np.add.reduceat(g[place_by], edge, axis=0) - prior * model.emit
        gm = pair_gold - pair - prior * model.move
        seen_e += ge * ge
        seen_m += gm * gm
        model.emit += rate * ge / np.sqrt(seen_e)
        model.move += rate * gm / np.sqrt(seen_m)
    return model


def _segments(words: Words) -> list[tuple[int, int]]:
    """Word ranges around the words that hold a digit, @ or +, two words on either side, inside one document."""
    calls = np.concatenate(([0], np.cumsum(_CALLS[words.data])))
    at = np.flatnonzero(calls[words.end] > calls[words.start])
    if not len(at):
        return []
    doc = np.searchsorted(words.bounds, at, side="right") - 1
    lo, hi = np.maximum(at - 2, words.bounds[doc]), np.minimum(at + 3, words.bounds[doc + 1])
    new = np.ones(len(at), bool)
    new[1:] = (lo[1:] >= hi[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return list(zip(lo[first].tolist(), hi[np.concatenate((first[1:], [len(at)])) - 1].tolist()))


def _text(words: Words, k: int) -> str:
    return words.data[words.start[k]: words.end[k]].tobytes().decode("utf-8", "replace")


def pattern_labels(docs: DataFrame, max_rows: int = 1_500) -> DataFrame:
    """(text, spans) of at most ``max_rows`` documents with a digit, @ or +, the first by a hash of the id; spans by the patterns."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").rlike("[0-9@+]"))
    ids = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    picked = rows.join(F.broadcast(ids), "doc_id")

    def label(batch: pa.RecordBatch, words: Words) -> dict:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        return {"text": texts, "spans": [_write(base_spans(t)) for t in texts]}

    return map_pieces(picked, label, "text string, spans string")


def _write(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def train(labelled: DataFrame, most_words: int = 40) -> Field:
    """Fit on (text, spans); a row of segments, words and labels reaches the driver. Segments over ``most_words`` are cut for training."""

    def gather(batch: pa.RecordBatch, words: Words) -> dict:
        heads = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))
        spans = [[(KINDS.index(k), int(a), int(b)) for k, a, b in (s.split(":") for s in x.split(",") if s)] for x in batch.column("spans").to_pylist()]
        out_w, out_y = [], []
        for lo, hi in _segments(words):
            d = int(np.searchsorted(words.bounds, lo, side="right")) - 1
            zero, y = heads[words.offsets[d]], []
            for w in range(lo, hi):
                a, b = heads[words.start[w]] - zero, heads[words.end[w]] - zero
                hit = next(((k, s) for k, s, e in spans[d] if s < b and a < e), None)
                y.append(0 if hit is None else 1 + 2 * hit[0] + (hit[1] < a))
            for c in range(0, hi - lo, most_words):
                part = y[c: c + most_words]
                if part[0] and part[0] % 2 == 0:
                    part[0] -= 1
                out_w.append([_text(words, w) for w in range(lo + c, min(hi, lo + c + most_words))])
                out_y.append(part)
        return {"words": out_w, "labels": out_y}

    rows = map_pieces(labelled, gather, "words array<string>, labels array<int>").toPandas()
    rows = rows.assign(k=[" ".join(w) for w in rows["words"]]).sort_values("k", kind="stable")
    return fit([list(w) for w in rows["words"]], [list(y) for y in rows["labels"]])


def find(words: Words, model: Field) -> tuple[list[list[tuple[int, int, int]]], list[list[tuple[int, int, int]]]]:
    """(pattern spans, added spans) of every document, in code points."""
    n = len(words.counts)
    base: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    added: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    calls = np.concatenate(([0], np.cumsum(_CALLS[words.data])))
    texts: dict[int, str] = {}
    for d in np.flatnonzero(calls[words.offsets[1:]] > calls[words.offsets[:-1]]).tolist():
        texts[d] = words.data[words.offsets[d]: words.offsets[d + 1]].tobytes().decode("utf-8", "replace")
        base[d] = base_spans(texts[d])
    if not texts or not model.index:
        return base, added
    heads = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))
    segments = sorted(_segments(words), key=lambda s: s[1] - s[0])
    for lo in range(0, len(segments), 512):
        batch = segments[lo: lo + 512]
        part = [model.scores([_text(words, w) for w in range(a, b)]) for a, b in batch]
        for (a, _), y in zip(batch, viterbi(part, model.move)):
            d = int(np.searchsorted(words.bounds, a, side="right")) - 1
            zero, k = heads[words.offsets[d]], 0
            while k < len(y):
                if y[k] == 0:
                    k += 1
                    continue
                end = k + 1
                while end < len(y) and y[end] and LABELS[y[end]][0] == "I":
                    end += 1
                kind = (int(y[k]) - 1) // 2
                s, e = int(heads[words.start[a + k]] - zero), int(heads[words.end[a + end - 1]] - zero)
                while s < e and not (texts[d][s].isalnum() or texts[d][s] in "+("):
                    s += 1
                while e > s and not texts[d][e - 1].isalnum():
                    e -= 1
                if s < e and _plausible(KINDS[kind], texts[d][s:e]) and not any(p < e and s < q for p, _, q in base[d]):
                    added[d].append((s, kind, e))
                k = end
    return base, added


def _plausible(kind: str, s: str) -> bool:
    if kind == "ip":
        parts = s.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 9 for p in parts) and fits("ip", s)
    return "@" in s if kind == "email" else fits(kind, s)


def pii(docs: DataFrame, model: Field) -> DataFrame:
    """doc_id, counts of the patterns' spans by kind, base_sha256, spans (all, with those the field adds), n_added, for every row."""

    def scan(batch: pa.RecordBatch, words: Words) -> dict:
        base, added = find(words, model)
        out = {"doc_id": batch.column("doc_id")}
        out |= {f"n_{name}": [sum(s[1] == k for s in b) for b in base] for k, name in enumerate(KINDS)}
        return out | {"base_sha256": [hashlib.sha256(_write(b).encode()).hexdigest() for b in base],
                      "spans": [_write(sorted(b + a)) for b, a in zip(base, added)], "n_added": [len(a) for a in added]}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_pieces(rows, scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def small_table(docs: DataFrame, max_rows: int = 1_500) -> DataFrame:
    return materialize(pattern_labels(docs, max_rows), "pii-labels")
