"""Benchmark decontamination by latent semantic retrieval, for passages that are copied or paraphrased.

1. Passages are ``2 * STEP`` words, one every ``STEP`` words, over whole texts; terms are the words of the benchmark items (lower-cased, marks at the
   ends cut), without those that many items have.
2. One pass over all passages gives the document frequencies and W = T'T R, T the passage-by-term counts and R a random matrix: a distributed
   randomised SVD. With the inverse document frequencies as a diagonal D, D W is the sketch of (T D)'(T D) for the test matrix R / D, and
   its Nystroem form gives the leading right singular vectors. The items' own rows are added with the weight of the corpus, so that the
   space keeps what tells items apart.
3. A second pass projects every passage and takes items of a cosine of at least ``least_cosine``, and besides, whatever the cosine, every item enough of
   whose answer stands near the passage, found by the places of its rarest words. A candidate's neighbourhood must then hold a longest
   common subsequence of at least ``least_share`` of the item's words, and of its answer (the words of the item that are rarest in the corpus,
   of equally rare ones those that the fewest items have) at least ``answer_share``.

Only the benchmark goes to all tasks, in blocks of ``block_items`` items, each with passes of its own; a task returns sums of fixed size, or hits. Which
terms tell, how many items share a term, its frequency in the corpus and so the answers come from the whole benchmark and corpus, and the cosine
alone loses nothing, so the hits are the same in any number of blocks (only the reported cosine is of the block's own space).

Defined results: null and empty texts and items have no passage and no hit; items of equal text are reported each; rows that repeat an id are scanned
by themselves and reported once per (id, item); null ids are reported as null; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lifethread.llm.arrays import LOWER, Rolling, Words, free_names, map_arrow, map_pieces, pieces, runs, split_words, text_buffers
from lifethread.runtime import materialize

STEP = 16
#: Terms in up to so many steps, or in this share of them, are equally rare: below, copies of the item itself decide the count.
RARE_STEPS, RARE_SHARE = 8, 1e-4
_SLICE = 1 << 11
_PAIRS = 1 << 18
_TEXT_HASH = "xxhash64(CAST(text AS STRING))"
_HIT = "doc_id long, item_id long, first_word long, lcs long, share double, cosine double, text_hash long"


@dataclass
class Items:
    """A block of benchmark items. ``terms``: sorted hashes; ``tokens``: the term numbers of each item in order."""

    ids: list[int]
    terms: np.ndarray
    tokens: list[np.ndarray]
    tells: np.ndarray  # terms that few items have; the others take no part in the search, only in the checks
    shared: np.ndarray  # number of items of the whole benchmark that have the term


@dataclass
class Space:
    items: Items
    basis: np.ndarray  # terms x rank, with the inverse document frequencies
    vectors: np.ndarray  # items x rank, of length 1
    rare: list[np.ndarray]  # the answer: numbers of the terms that are rarest in the corpus, of equally rare ones those of the fewest items


def core_hashes(words: Words) -> np.ndarray:
    return Rolling(LOWER[words.data])(*words.cores())


@dataclass
class Shares:
    """What the whole benchmark says of terms. ``shared``: (hash, number of items) of terms that several items have, sorted; ``common``: sorted hashes
    of those that do not tell items apart."""

    terms: np.ndarray
    shared: np.ndarray
    common: np.ndarray


def read_shares(shared: list, common: np.ndarray) -> Shares:
    h = np.array([r.h for r in shared], np.int64).view(np.uint64)
    order = np.argsort(h)
    return Shares(h[order], np.array([r.n for r in shared], np.int64)[order], common)


def benchmark_terms(items: DataFrame, most_share: float = 0.04) -> tuple[DataFrame, np.ndarray]:
    """(block, h, n) of terms that n > 1 items of the whole benchmark have, for every block with one, and the hashes of common terms: in more than ``most_share``
    of all items and in more than three; but those of an item of common words only tell, else nothing would search it."""

    def each(rows: pa.RecordBatch, words: Words) -> dict:
        key = np.unique(np.stack([words.doc.astype(np.uint64), core_hashes(words)], 1), axis=0)
        return {"block": rows.column("block").take(pa.array(key[:, 0].astype(np.int64))), "h": key[:, 1].view(np.int64), "lead": np.diff(key[:, 0], prepend=np.uint64(1 << 63)) != 0}

    of = materialize(map_pieces(items.select("block", "text"), each, "block int, h long, lead boolean"), "benchmark-terms")
    many = of.filter("lead").count()
    counts = materialize(of.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "benchmark-counts")
    common = np.sort(np.array([r.h for r in counts.filter(F.col("n") > max(3, most_share * many)).collect()], np.int64).view(np.uint64))

    def lone(rows: pa.RecordBatch, words: Words) -> dict:
        h = core_hashes(words)
        other = np.bincount(words.doc[~np.isin(h, common)], minlength=len(words.counts))
        return {"h": np.unique(h[other[words.doc] == 0]).view(np.int64)}

    alone = [r.h for r in map_pieces(items.select("text"), lone, "h long").distinct().collect()] if len(common) else []
    return of.select("block", "h").distinct().join(counts, "h"), np.setdiff1d(common, np.array(alone, np.int64).view(np.uint64))


def read_items(rows: list, shares: Shares) -> Items:
    rows = [r for r in rows if r.text]
    data, offsets = text_buffers(pa.array([r.text for r in rows], pa.string()))
    words = split_words(data, offsets)
    h = core_hashes(words)
    terms, at = np.unique(h, return_inverse=True)
    tokens = np.split(at, words.bounds[1:-1]) if rows else []
    keep = [k for k, t in enumerate(tokens) if len(t)]
    often = np.ones(len(terms), np.int64)
    _, mine, its = np.intersect1d(terms, shares.terms, assume_unique=True, return_indices=True)
    often[mine] = shares.shared[its]
    return Items([rows[k].item_id for k in keep], terms, [tokens[k] for k in keep], ~np.isin(terms, shares.common), often)


class Lookup:
    """Term numbers of words, through a small table of hash bits first."""

    def __init__(self, terms: np.ndarray) -> None:
        self.terms = terms
        self.mask = np.zeros(1 << 20, bool)
        self.mask[(terms >> np.uint64(44)).astype(np.int64)] = True

    def __call__(self, words: Words) -> np.ndarray:
        """-1 for words that no item has."""
        h = core_hashes(words)
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.mask[(h >> np.uint64(44)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.terms, h[maybe]), len(self.terms) - 1)
        found = self.terms[slot] == h[maybe]
        out[maybe[found]] = slot[found]
        return out


def _steps(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(number of the step of every word, first step of every document): ``STEP`` words each, none over a document's end."""
    n = -(-words.counts // STEP)
    first = np.concatenate(([0], np.cumsum(n)))
    inside = np.arange(len(words.start)) - np.repeat(words.bounds[:-1], words.counts)
    return np.repeat(first[:-1], words.counts) + inside // STEP, first


def _row_sums(table: np.ndarray, at: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Sums of ``table[at]`` by ``row`` (ascending), a slice at a time."""
    out = np.zeros((rows, table.shape[1]), np.float32)
    for lo in range(0, len(at), _SLICE):
        r = row[lo: lo + _SLICE]
        edge = runs(r)[:-1]
        out[r[edge]] += np.add.reduceat(table[at[lo: lo + _SLICE]], edge, axis=0)
    return out


def _random(terms: int, rank: int) -> np.ndarray:
    return np.random.default_rng(29).standard_normal((terms, rank)).astype(np.float32)


def sketch(docs: DataFrame, items: Items, rank: int, stripe: int = 256) -> tuple[np.ndarray, np.ndarray, int]:
    """T'T R of the telling terms, the document frequencies of all terms and the number of steps, over all texts. A row that is moved holds ``stripe`` terms' sums of a task."""
    lookup, width = Lookup(items.terms), len(items.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        table = _random(width, rank)
        total, often, steps = np.zeros((width, rank), np.float64), np.zeros(width, np.float64), 0
        for batch in batches:
            for _, _, data, offsets in pieces(batch):
                words = split_words(data, offsets)
                term = lookup(words)
                step, first = _steps(words)
                has = np.flatnonzero(term >= 0)
                term, row = term[has], step[has]
                steps += int(first[-1])
                if not len(term):
                    continue
                tells = items.tells[term]
                sums = _row_sums(table, term[tells], row[tells], int(first[-1]))
                order = np.argsort(term.astype(np.uint16) if width < 1 << 16 else term, kind="stable")
                term, row = term[order], row[order]
                new = np.ones(len(term), bool)
                new[1:] = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
                often += np.bincount(term[new], minlength=width)
                tells = items.tells[term]
                total += _row_sums(sums, row[tells], term[tells], width)
        if steps:
            for lo in range(0, width, stripe):
                yield {"stripe": [lo], "sums": [total[lo: lo + stripe].tobytes()], "often": [often[lo: lo + stripe].tobytes()], "steps": [steps]}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: dict[int, list] = {}
        for batch in batches:
            for k, s, o, n in zip(*(batch.column(c).to_pylist() for c in ("stripe", "sums", "often", "steps"))):
                s, o = np.frombuffer(s), np.frombuffer(o)
                held[k] = [held[k][0] + s, held[k][1] + o, held[k][2] + n] if k in held else [s, o, n]
        for k, (s, o, n) in held.items():
            yield {"stripe": [k], "sums": [s.tobytes()], "often": [o.tobytes()], "steps": [n]}

    ddl = "stripe int, sums binary, often binary, steps long"
    total, often, steps = np.zeros((width, rank)), np.zeros(width), 0
    parts = map_arrow(docs.select(F.lower(F.col("text").cast("string")).alias("text")), run, ddl).repartition(max(1, min(64, width // stripe)), "stripe")
    for r in map_arrow(parts, add, ddl).toLocalIterator():
        k = len(r.often) // 8
        total[r.stripe: r.stripe + k], often[r.stripe: r.stripe + k], steps = np.frombuffer(r.sums).reshape(k, rank), np.frombuffer(r.often), r.steps
    return total, often, steps


def build_space(docs: DataFrame, items: Items, rank: int = 96, answer: int = 5) -> Space:
    rank = min(rank, len(items.terms))
    sums, often, steps = sketch(docs, items, rank)
    idf = np.log((steps + 1) / (often + 1)) + 0.05
    own = np.zeros((len(items.ids), len(items.terms)))
    for k, t in enumerate(items.tokens):
        np.add.at(own[k], t[items.tells[t]], 1)
    test = _random(len(items.terms), rank).astype(np.float64)
    mine = own.T @ (own @ test)
    energy = float(np.abs(idf[:, None] * sums).sum()) / max(float(np.abs(idf[:, None] * mine).sum()), 1e-9)
    z, omega = idf[:, None] * (sums + energy * mine), test / idf[:, None]
    # Nystroem: M ~ Z (omega' Z)^-1 Z'
    core = omega.T @ z
    value, vector = np.linalg.eigh((core + core.T) / 2)
    value = np.maximum(value, max(value.max() * 1e-9, 1e-12))
    left, _, _ = np.linalg.svd(z @ (vector / np.sqrt(value)), full_matrices=False)
    basis = idf[:, None] * left
    vectors = own @ basis
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    level = np.maximum(often, max(RARE_STEPS, RARE_SHARE * steps))
    rare = [(u := np.unique(t))[np.lexsort((items.shared[u], level[u]))][:answer] for t in items.tokens]
    return Space(items, basis.astype(np.float32), vectors.astype(np.float32), rare)


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bits of one integer per item."""
    place: dict[int, int] = {}
    for k, t in enumerate(a.tolist()):
        place[t] = place.get(t, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for t in b.tolist():
        m = place.get(t)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def answer_places(term: np.ndarray, words: Words, first: np.ndarray, space: Space, answer_share: float) -> np.ndarray:
    """(passage, item) as passage * items + item: every passage whose neighbourhood can hold ``answer_share`` of the item's answer, whatever its cosine."""
    items, tokens = space.items, space.items.tokens
    need = [max(1, math.ceil(answer_share * len(r) - 1e-9)) for r in space.rare]
    # So many of the answer's terms stand there only if one of the first len - need + 1 does.
    heads = [r[: max(1, len(r) - n + 1)] for r, n in zip(space.rare, need)]
    head, owner = np.concatenate(heads), np.repeat(np.arange(len(heads)), [len(x) for x in heads])
    order = np.argsort(head, kind="stable")
    head, owner = head[order], owner[order]
    fan = np.bincount(head, minlength=len(items.terms))
    begin = np.cumsum(fan) - fan
    lead = np.flatnonzero((term >= 0) & (fan[term] > 0))
    if not len(lead):
        return np.zeros(0, np.int64)
    has = np.flatnonzero(term >= 0)
    size = len(term) + 1
    key = np.sort(term[has] * size + has)  # places of every term, in order
    most = max(len(r) for r in space.rare)
    table = np.full((len(tokens), most), -1, np.int64)
    for k, r in enumerate(space.rare):
        table[k, : len(r)] = r
    needs, length = np.array(need), np.array([len(t) for t in tokens])
    doc = words.doc
    out = []
    for part in np.split(lead, np.flatnonzero(np.diff(np.cumsum(fan[term[lead]]) // _PAIRS)) + 1):
        f = fan[term[part]]
        at = np.repeat(part, f)
        item = owner[np.repeat(begin[term[part]] - np.cumsum(f) + f, f) + np.arange(len(at))]
        d, reach = doc[at], length[item]
        lo, hi = np.maximum(words.bounds[d], at - 2 * (STEP + reach)), np.minimum(words.bounds[d + 1], at + 2 * (STEP + reach) + 1)
        there = np.zeros(len(at), np.int64)
        for c in range(most):
            t = table[item, c]
            there += (t >= 0) & (np.searchsorted(key, t * size + lo) < np.searchsorted(key, t * size + hi))
        ok = there >= needs[item]
        at, item, d, reach = at[ok], item[ok], d[ok], reach[ok]
        inside = at - words.bounds[d]
        low = np.maximum((inside - 2 * STEP - reach) // STEP + 1, 0)  # passages with start - reach <= place < start + 2 * STEP + reach
        high = np.minimum((inside + reach) // STEP, np.diff(first)[d] - 1)
        n = np.maximum(high - low + 1, 0)
        p = np.repeat(first[d] + low - np.cumsum(n) + n, n) + np.arange(n.sum())
        out.append(np.unique(p * len(tokens) + np.repeat(item, n)))
    return np.unique(np.concatenate(out))


def search(docs: DataFrame, space: Space, least_cosine: float, least_share: float, answer_share: float) -> DataFrame:
    """(doc_id, item_id, first_word, lcs, share, cosine, text_hash): the best place of every item in every row that has it."""
    items, lookup = space.items, Lookup(space.items.terms)
    has_term = np.zeros((len(items.ids), len(items.terms)), bool)
    for k, t in enumerate(items.tokens):
        has_term[k, t] = True

    def find(batch: pa.RecordBatch, words: Words) -> dict:
        term = lookup(words)
        step, first = _steps(words)
        has = np.flatnonzero((term >= 0) & items.tells[term])
        single = _row_sums(space.basis, term[has], step[has], int(first[-1]))
        doc = np.repeat(np.arange(len(words.counts)), np.diff(first))
        double = single.copy()  # a passage is a step and the next one of its document
        more = np.flatnonzero(doc[1:] == doc[:-1])
        double[more] += single[more + 1]
        best: dict[tuple[int, int], tuple[int, float, int]] = {}
        length = np.maximum(np.linalg.norm(double, axis=1), 1e-9)
        found = [answer_places(term, words, first, space, answer_share)]
        for lo in range(0, len(double), 4096):
            at, item = np.nonzero(double[lo: lo + 4096] @ space.vectors.T >= least_cosine * length[lo: lo + 4096, None])
            found.append((lo + at) * len(items.ids) + item)
        for p, k in zip(*(x.tolist() for x in np.divmod(np.unique(np.concatenate(found)), len(items.ids)))):
            d, t = int(doc[p]), items.tokens[k]
            start = words.bounds[d] + (p - first[d]) * STEP
            a, b = max(words.bounds[d], start - len(t)), min(words.bounds[d + 1], start + 2 * STEP + len(t))
            near = term[a:b]
            need = max(-(-least_share * len(t) // 1), min(len(t), 5))
            near = near[near >= 0]
            near = near[has_term[k, near]]  # a common subsequence has no other words
            if len(near) < need or (near[:, None] == space.rare[k]).any(0).sum() < answer_share * len(space.rare[k]):
                continue
            common = lcs(t, near)
            if common >= need and common > best.get((d, k), (0,))[0]:
                best[d, k] = (common, float(double[p] @ space.vectors[k] / length[p]), int(start - words.bounds[d]))
        keys = list(best)
        return {
            "doc_id": batch.column("doc_id").take(pa.array([d for d, _ in keys], pa.int64())), "item_id": [items.ids[k] for _, k in keys], "first_word": [best[x][2] for x in keys],
            "lcs": [best[x][0] for x in keys], "share": [best[x][0] / len(items.tokens[x[1]]) for x in keys], "cosine": [best[x][1] for x in keys],
            "text_hash": batch.column("text_hash").take(pa.array([d for d, _ in keys], pa.int64())),
        }

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"), F.expr(_TEXT_HASH).alias("text_hash"))
    return map_pieces(rows, find, _HIT)


def row_hits(docs: DataFrame, benchmark: DataFrame, rank: int = 96, least_cosine: float = 0.4, least_share: float = 0.6, answer_share: float = 0.6, block_items: int = 5_000) -> DataFrame:
    """Hits of all items, those of every row; ``block_items`` bounds what is sent to the tasks at a time."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.col("text").cast("string")).alias("text"))
    blocks = -(-items.count() // block_items)
    parts = 2 * blocks if blocks > 1 else blocks
    items = materialize(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(parts, 1))).cast("int")), "benchmark")
    shared, common = benchmark_terms(items)
    shared = materialize(shared, "benchmark-shared") if parts > 1 else shared
    found = []
    for b in range(parts):
        block = read_items(items.filter(F.col("block") == b).collect(), read_shares(shared.filter(F.col("block") == b).collect(), common))
        if block.ids:
            found.append(search(docs, build_space(docs, block, rank), least_cosine, least_share, answer_share))
    if not found:
        return spark.createDataFrame([], _HIT)
    hits = found[0]
    for f in found[1:]:
        hits = hits.unionByName(f)
    return hits


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Hits of all items, once per (id, item)."""
    order = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("lcs"), "first_word")
    hits = row_hits(docs, benchmark, **options).drop("text_hash")
    return hits.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without any hit of their own; rows are told apart by id and a 64-bit hash of the text."""
    of, of_text = free_names(docs, "of", "of_text")
    bad = row_hits(docs, benchmark, **options).select(F.col("doc_id").alias(of), F.col("text_hash").alias(of_text)).distinct()
    bad = materialize(bad, "contaminated")
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & (F.expr(_TEXT_HASH) == F.col(of_text)), "left_anti")
