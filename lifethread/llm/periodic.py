"""Periodic runs: stretches of words that repeat with a period, found by last occurrences along the links of a suffix automaton.

A run is a stretch with smallest period q that no neighbouring word extends, at least ``max(least, 2 * q)`` words long. Words are taken one after
the other; the suffixes of what was read so far are a path of the automaton's links, from the state of the prefix to the root. Every part
of that path with one colour holds the suffixes that last ended at the same place, and a link-cut access, which walks the parts and gives the
whole path the new colour, meets O(log n) of them a word on average. A part whose longest suffix has L words and last ended d words ago is a
square if L >= d; it starts at the first word of that suffix and only its end is looked for. Such a d is always the smallest period: were the
suffix of d words a power, it would have ended less than d words ago. So every run is found once, where its first square ends.

The automaton only reads parts of a document where a run can be: in a run all words lie in windows of ``least / 2`` words that stand twice or
more in the document. A run lies in one such part as a whole, so nothing is lost; hashes choose the parts, the automaton compares words.

Null and empty texts have no words and no runs; null, negative and repeated ids are kept as they are, since every row stands for itself. Memory
grows with the longest document (about 1 KB for each word of its longest part, in one task).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifethread.llm.arrays import WORD, Rolling, Words, map_pieces, mix
from lifethread.llm.substring import _joined


def suffix_links(ids: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(link, length, state of every prefix) of the suffix automaton; state 1 is the root, 0 stands for none."""
    moves: list[dict[int, int]] = [{}, {}]
    link, length, ends = [0, 0], [0, 0], []
    last = 1
    for n, c in enumerate(ids, 1):
        now = len(moves)
        moves.append({})
        length.append(n)
        link.append(1)
        p = last
        while p and c not in moves[p]:
            moves[p][c] = now
            p = link[p]
        if p:
            q = moves[p][c]
            if length[p] + 1 != length[q]:
                copy = len(moves)
                moves.append(moves[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = copy
                while p and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                q = copy
            link[now] = q
        ends.append(now)
        last = now
    return link, length, ends


class LinkCut:
    """Paths from nodes to the root of a fixed forest, kept in splay trees by depth; one tree holds the nodes of one colour of a path.

    ``up`` of a tree's top is the node above the path. Colours are -1 until a node's path was accessed.
    """

    def __init__(self, parents: list[int]) -> None:
        self.up = list(parents)
        self.left, self.right, self.colour = [0] * len(parents), [0] * len(parents), [-1] * len(parents)

    def access(self, node: int, colour: int) -> list[tuple[int, int]]:
        """(deepest node, colour) of the parts of the path from ``node`` to the root; then the whole path has ``colour``."""
        up, left, right, colours = self.up, self.left, self.right, self.colour
        parts, below, x = [], 0, node
        while x:
            while True:  # splay x to the top of its tree
                y = up[x]
                if not y or (left[y] != x and right[y] != x):
                    break
                z = up[y]
                first = (x,)
                if z and (left[z] == y or right[z] == y):
                    first = (y, x) if (left[y] == x) == (left[z] == y) else (x, x)
                for v in first:
                    w = up[v]
                    if left[w] == v:
                        inner = left[w] = right[v]
                        right[v] = w
                    else:
                        inner = right[w] = left[v]
                        left[v] = w
                    if inner:
                        up[inner] = w
                    t = up[v] = up[w]
                    up[w] = v
                    if t and left[t] == w:
                        left[t] = v
                    elif t and right[t] == w:
                        right[t] = v
                    else:
                        colours[v] = colours[w]
            held = colours[x]
            parts.append((x, held))
            if right[x]:
                colours[right[x]] = held  # the part below keeps its colour in a tree of its own
            right[x] = below
            below, x = x, up[x]
        colours[below] = colour
        return parts


def word_runs(ids: list[int], least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the sequence, by start, then period."""
    link, length, ends = suffix_links(ids)
    tree, reach, found = LinkCut(link), {}, []
    for i, state in enumerate(ends):
        for node, before in tree.access(state, i):
            period, common = i - before, length[node]
            if before < 0 or common < period or reach.get(period, -1) >= i:
                continue
            end = i + 1
            while end < len(ids) and ids[end] == ids[end - period]:
                end += 1
            reach[period] = end - 1
            start = before - common + 1
            if end - start >= least:
                found.append((start, end - start, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _parts(words: Words, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and ends of the parts covered by windows of ``least / 2`` words that stand twice or more in their document."""
    size = max((least + 1) // 2, 1)
    first, n = words.windows(size)
    if not len(first):
        return first, first
    of = np.repeat(np.arange(len(n)), n)
    key = mix(Rolling(words.hashes())(first, first + size) + mix(of.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    equal = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(first), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    marks = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(marks, first[twice], 1)
    np.add.at(marks, first[twice] + size, -1)
    inside = np.cumsum(marks)[:-1] > 0
    edge = np.zeros(len(inside) + 1, bool)
    edge[words.bounds] = True
    start = inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1])))
    end = inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def _document_runs(words: Words, least: int) -> list[tuple[int, int, int, int]]:
    """(document, start, length, period) of all runs of a piece; starts count from the document's first word."""
    out, raw = [], words.data.tobytes()
    start, end = _parts(words, least)
    doc = np.searchsorted(words.bounds, start, side="right") - 1
    for d, a, b in zip(doc.tolist(), start.tolist(), end.tolist()):
        if b - a >= least:
            known: dict[bytes, int] = {}
            ids = [known.setdefault(raw[s:e], len(known)) for s, e in zip(words.start[a:b].tolist(), words.end[a:b].tolist())]
            at = a - int(words.bounds[d])
            out += [(d, at + s, n, p) for s, n, p in word_runs(ids, least)]
    return out


RUNS = "array<struct<start:long,length:long,period:long>>"


def periodic_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start, then period), collapsed (the text's words without those that a run
    holds after its first period, joined by one space), for every row. Null texts have no words; a null id stays null."""

    def find(batch: pa.RecordBatch, words: Words) -> dict:
        runs = _document_runs(words, least)
        of = np.array([r[0] for r in runs], np.int64)
        marks = np.zeros(len(words.start) + 1, np.int64)
        for d, start, n, period in runs:
            at = int(words.bounds[d]) + start
            marks[at + period] += 1
            marks[at + n] -= 1
        data, offsets = _joined(words, np.cumsum(marks)[:-1] == 0)
        fields = [pa.array([r[k] for r in runs], pa.int64()) for k in (1, 2, 3)]
        held = pa.StructArray.from_arrays(fields, ["start", "length", "period"])
        ends = pa.array(np.searchsorted(of, np.arange(batch.num_rows + 1)).astype(np.int32))
        text = [bytes(data[a:b]).decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return {"doc_id": batch.column("doc_id"), "n_words": words.counts, "runs": pa.ListArray.from_arrays(ends, held), "collapsed": text}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_pieces(rows, find, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def repeat_some(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the words of every tenth document by h = crc32 of the id repeated from the word a on with the period p.

    With g = h / 10 and n words, a = g % n and p = 1 + (n - a) / (3 + g % 8). Ids that are null and texts without words stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    chosen = (h % 10 == 0) & F.col("text").rlike(WORD)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.when(chosen, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("w"))
    n, g = F.size("w"), F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    copies = F.flatten(F.array_repeat(F.slice("w", a + 1, p), F.ceil((n - a) / p).cast("int")))
    repeated = F.array_join(F.concat(F.slice("w", F.lit(1), a), F.slice(copies, F.lit(1), n - a)), " ")
    return rows.select("doc_id", F.when(F.col("w").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


def runs_digest(docs: DataFrame, least: int = 12) -> DataFrame:
    """Per row the number of runs, the longest one (ties: the first, then that of the smallest period), and hashes of all runs and of the text left."""
    best = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return periodic_runs(docs, least).withColumn("best", best).select(
        "doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
