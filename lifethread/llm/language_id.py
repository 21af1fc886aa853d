"""Language identification in two steps: the family first, then one-versus-one linear support vector machines inside it.

A text is seen as its lower-cased letters with one blank between words, and as the shares of its runs of one to four bytes, hashed into buckets;
blanks are part of the runs, so that beginnings and ends of words count. Languages whose mean shares are alike form families (average
linkage, until ``families`` are left). One machine per family tells it from the others; the family with the highest margin wins. Inside, one
machine per pair of languages votes; equal votes are decided by the sum of margins. All are linear in the shares, so a text of any length is read once, in
blocks, and a model is a table of weights, bounded by the numbers of languages and buckets.

Machines are fitted on at most ``max_rows`` rows, dealt alike to the languages (the first by a hash of id and text, each with its whole text); a text counts
once as a whole and once by its first words, so that short texts have their like in the training. The score is the probability of the family
times the mean probability of the winning pairs, both calibrated on rows kept out of the fit.

Null texts, and texts without a letter, are ``und`` with score 0, as is everything if no language was learned. Rows with a null id are neither
held out nor learned from. Empty tables give an empty result. A language is any non-null value of ``lang``, the empty one too; ties of margins go
to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lifethread.llm.arrays import map_arrow, mix, pieces, remainder
from lifethread.llm.labelled import fit_line, sigmoid
from lifethread.runtime import materialize

UNKNOWN = "und"
GRAMS = 4
#: Bytes hashed at once.
BLOCK = 1 << 18
_STEP = 0x9E3779B97F4A7C55


@dataclass
class LanguageModel:
    """``family[k]``: languages of family k; ``weights``: a row per machine, the families' first, then one per pair of ``pairs``."""

    bits: int
    languages: list[str] = field(default_factory=list)
    family: list[list[int]] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None
    lines: np.ndarray | None = None  # slope and intercept of every machine's probability

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of every row of margins."""
        n = len(margins)
        if not self.languages:
            return np.full(n, -1), np.zeros(n)
        p = sigmoid(margins * self.lines[:, 0] + self.lines[:, 1])
        k = len(self.family)
        chosen = margins[:, :k].argmax(1)
        share = p[np.arange(n), chosen] / np.maximum(p[:, :k].sum(1), 1e-12)
        votes, sums, sure = (np.full((n, len(self.languages)), -np.inf if k == 0 else 0.0) for k in (0, 0, 1))
        for members in enumerate(self.family):
            votes[np.ix_(chosen == members[0], members[1])] = 0
            sums[np.ix_(chosen == members[0], members[1])] = 0
        for j, (a, b) in enumerate(self.pairs, k):
            first = margins[:, j] >= 0
            votes[:, a] += first
            votes[:, b] += ~first
            sums[:, a] += margins[:, j]
            sums[:, b] -= margins[:, j]
            sure[:, a] += p[:, j]
            sure[:, b] += 1 - p[:, j]
        best = (votes == votes.max(1, keepdims=True)) * 1.0
        pick = np.where(best > 0, sums, -np.inf).argmax(1)
        rivals = np.array([len(self.family[c]) - 1 for c in chosen])
        return pick, share * np.where(rivals > 0, sure[np.arange(n), pick] / np.maximum(rivals, 1), 1.0)


def _letters(texts: pa.Array) -> pa.Array:
    """Lower case, everything but letters and marks as one blank, a blank at both ends; null and letterless texts are null."""
    texts = pc.utf8_lower(texts.cast(pa.large_string()))
    texts = pc.if_else(pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False), texts, None)
    words = pc.utf8_trim(pc.replace_substring_regex(texts, r"[^\pL\pM]+", " "), " ")
    edge, blank = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    return pc.binary_join_element_wise(edge, words, edge, blank)


def _places(data: np.ndarray, lo: int, hi: int, bits: int) -> Iterator[np.ndarray]:
    """Buckets of the runs of 1 to GRAMS bytes that begin at lo to hi; runs that would pass the data's end are left out at the end."""
    h = np.zeros(hi - lo, np.uint64)
    for size in range(1, GRAMS + 1):
        n = min(hi, len(data) - size + 1) - lo
        if n <= 0:
            return
        h = h[:n] * np.uint64(_STEP) + data[lo + size - 1: lo + size - 1 + n].astype(np.uint64) + np.uint64(size)
        yield (mix(h) >> np.uint64(64 - bits)).astype(np.int64)


def _margins(data: np.ndarray, offsets: np.ndarray, model: LanguageModel) -> np.ndarray:
    """A row of margins per text, from the runs that lie inside it."""
    sums, count = np.zeros((len(offsets) - 1, len(model.weights))), np.zeros(len(offsets) - 1)
    for lo in range(0, len(data), BLOCK):
        hi = min(lo + BLOCK, len(data))
        some = np.flatnonzero((offsets[1:] > lo) & (offsets[:-1] < hi))
        start = np.maximum(offsets[some], lo) - lo
        for size, place in enumerate(_places(data, lo, hi, model.bits)):
            end = np.maximum(np.minimum(offsets[some + 1] - size, hi) - lo, start)
            count[some] += end - start
            for k, w in enumerate(model.weights):
                total = np.concatenate(([0.0], np.cumsum(w[place])))
                sums[some, k] += total[np.minimum(end, len(place))] - total[np.minimum(start, len(place))]
    return sums / np.maximum(count, 1)[:, None] + model.bias


def sample_languages(docs: DataFrame, max_rows: int, held: tuple[int, int]) -> tuple[list[str], DataFrame]:
    """The languages of the rows to learn from, and (text, lang, same) of at most ``max_rows`` of them, alike from all languages, as a stored table.

    Rows are drawn by ``same``, a hash of id and text: of a language with n rows first those below a share of all hashes that holds about three
    times as many as are wanted, so that what is ranked per language is bounded, whatever n.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(remainder("doc_id", held[0]) != held[1]).filter("lang IS NOT NULL").filter(F.col("text").rlike("\\p{L}"))
    rows = rows.withColumn("same", F.xxhash64("doc_id", "text"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    each = max(max_rows // max(len(counts), 1), 1)
    shares = [(lang, min(1.0, (3 * each + 30) / n)) for lang, n in sorted(counts.items())]
    shares = rows.sparkSession.createDataFrame(shares, "lang string, share double")  # a row per language
    drawn = rows.join(F.broadcast(shares), "lang").filter(F.col("same") / 2.0**64 + 0.5 <= F.col("share")).select("lang", "same").distinct()
    first = Window.partitionBy("lang").orderBy("same")
    picked = materialize(drawn.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= each).select("lang", "same"), "languages-drawn")
    none = sorted(set(counts) - {r["lang"] for r in picked.select("lang").distinct().collect()})
    if none:  # few different rows, all of them beyond the share
        picked = picked.unionByName(rows.filter(F.col("lang").isin(none)).groupBy("lang").agg(F.min("same").alias("same")))
    return sorted(counts), materialize(rows.join(F.broadcast(picked), ["lang", "same"]).dropDuplicates(["lang", "same"]).select("text", "lang", "same"), "languages")


def _profiles(sample: DataFrame, bits: int, short: int) -> DataFrame:
    """Shares of the sampled texts and of their first ``short`` letters, as float32 bytes."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for d, text in enumerate(_letters(batch.column("text")).to_pylist()):
                whole = np.frombuffer(text.encode(), np.uint8)
                head = np.frombuffer((text[:short].rstrip(" ") + " ").encode(), np.uint8)
                for form, data in enumerate((whole, head)):
                    seen, n = np.zeros(1 << bits), 0
                    for lo in range(0, len(data), BLOCK):
                        for place in _places(data, lo, min(lo + BLOCK, len(data)), bits):
                            seen += np.bincount(place, minlength=1 << bits)
                            n += len(place)
                    at = np.flatnonzero(seen)
                    yield {"lang": [batch.column("lang")[d].as_py()], "same": [batch.column("same")[d].as_py()], "form": [form], "at": [at.astype(np.int32).tobytes()], "share": [(seen[at] / n).astype(np.float32).tobytes()]}

    return map_arrow(sample, profile, "lang string, same long, form int, at binary, share binary")


def language_families(means: np.ndarray, families: int) -> list[list[int]]:
    """Languages joined by average linkage of the cosine of their mean shares until ``families`` groups are left."""
    unit = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    alike = np.round(unit @ unit.T, 9)
    groups = [[k] for k in range(len(means))]
    while len(groups) > max(families, 1):
        a, b = max(combinations(range(len(groups)), 2), key=lambda p: alike[np.ix_(groups[p[0]], groups[p[1]])].mean())
        groups[a] = sorted(groups[a] + groups.pop(b))
    return sorted(groups)


def support_vectors(x: np.ndarray, y: np.ndarray, rows: np.ndarray, cost: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, classes weighed alike, by dual coordinate descent over ``rows``; ``y`` is -1 or 1."""
    share = np.where(y > 0, (y[rows] > 0).mean(), (y[rows] < 0).mean())
    slack = share / cost
    alpha, w = np.zeros(len(y)), np.zeros(x.shape[1])
    square = np.einsum("ij,ij->i", x, x) + slack
    order, r = rows.copy(), np.random.default_rng(1)
    for _ in range(rounds):
        r.shuffle(order)
        moved = 0.0
        for i in order:
            step = max(alpha[i] - (y[i] * (x[i] @ w) - 1 + slack[i] * alpha[i]) / square[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w += (step * y[i]) * x[i]
                moved = max(moved, abs(step) * square[i])
        if moved < 1e-3:
            break
    return w


def train(docs: DataFrame, max_rows: int = 2_000, bits: int = 13, families: int | None = None, short: int = 60, held: tuple[int, int] = (4, 2)) -> LanguageModel:
    """Fit on at most ``max_rows`` rows, twice ``max_rows * 2 ** bits`` float32 numbers on the driver; ``families``: the root of the number of languages."""
    languages, sample = sample_languages(docs, max_rows, held)
    model = LanguageModel(bits, languages)
    if not languages:
        return model
    rows = sorted(_profiles(sample, bits, short).collect(), key=lambda r: (r["lang"], r["same"], r["form"]))
    x = np.zeros((len(rows), (1 << bits) + 1), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["share"], np.float32)
    y = np.searchsorted(languages, [r["lang"] for r in rows])
    del rows
    means = np.stack([x[y == k].mean(0) for k in range(len(languages))])
    model.family = language_families(means, round(len(languages) ** 0.5) if families is None else families)
    spread = np.sqrt(np.einsum("ij,ij->j", x, x) / len(x)) + 1e-4  # buckets of like spread
    x /= spread
    middle = np.median(np.sqrt(np.einsum("ij,ij->i", x, x))) / 4
    x /= middle
    x[:, -1] = 1.0
    of = np.empty(len(languages), int)
    for k, members in enumerate(model.family):
        of[members] = k
    model.pairs = [p for members in model.family for p in combinations(members, 2)]
    machines = [(np.ones(len(y), bool), of[y] == k) for k in range(len(model.family))] + [((y == a) | (y == b), y == a) for a, b in model.pairs]
    test, weights, lines = np.arange(len(y)) // 2 % 5 == 4, [], []  # both forms of a text on one side
    for inside, positive in machines:
        fit, use = inside & ~test, inside & test
        fit = fit if len(np.unique(positive[fit])) == 2 else inside
        use = use if len(np.unique(positive[use])) == 2 else fit
        sign, at = np.where(positive, 1.0, -1.0), np.flatnonzero(fit)
        w = support_vectors(x, sign, at) if len(np.unique(sign[at])) == 2 else np.r_[np.zeros(1 << bits), sign[at].mean()]
        lines.append(fit_line(np.array([x[i] @ w for i in np.flatnonzero(use)]), positive[use].astype(float)))
        weights.append(w)
    weights = np.stack(weights)
    model.weights, model.bias, model.lines = weights[:, :-1] / (spread[:-1] * middle), weights[:, -1], np.array(lines)
    return model


def languages(docs: DataFrame, model: LanguageModel, held: tuple[int, int] = (4, 2)) -> DataFrame:
    """doc_id, held_out, lang_pred, score, for every row."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            letters = _letters(batch.column("text"))
            known = letters.is_valid().to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in pieces(pa.RecordBatch.from_arrays([letters], ["text"])):
                pick, score = model.decide(_margins(data, offsets, model)) if model.languages else model.decide(np.zeros((hi - lo, 0)))
                named = known[lo:hi] & (pick >= 0)
                names = [model.languages[k] if ok else UNKNOWN for k, ok in zip(pick.tolist(), named.tolist())]
                yield {"doc_id": batch.column("doc_id").slice(lo, hi - lo), "lang_pred": names, "score": np.where(named, score, 0.0)}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = map_arrow(rows, predict, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(remainder("doc_id", held[0]) == held[1], F.lit(False)).alias("held_out"), "lang_pred", "score")
