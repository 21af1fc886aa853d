"""Jaccard join of word shingles: rare-first prefixes, length, positional and suffix filters, one verification per pair.

1. A document's set is its distinct shingles as 64-bit hashes. Equal sets are one node (their hash), however many copies there are.
2. Shingles are ordered rare first by counts over all documents in a table of ``2 ** SKETCH`` hashed places; the order only has to be the same
   everywhere, so hashed counts give exact results. Two sets that reach the similarity share a shingle of their prefixes in this order.
3. Nodes that share a prefix shingle are compared by the length, positional and suffix filters (the last bounds the overlap by counts of hashed
   parts of the sets, a fixed number for each set). Pairs that pass chain nodes to clusters; sets of different clusters cannot be linked.
4. Each clustered node's set is sent to its cluster once. Large clusters are cut into bands of set size, so that only the same or adjacent bands can
   be linked, and bands into blocks of about ``BLOCK`` nodes; each pair of blocks is a unit of work of its own. So are those of a shingle that many
   prefixes hold.
5. In a unit, pairs that share a prefix shingle pass the same filters, and those left are verified by their whole sets, once. A unit returns links to
   its components' smallest nodes and the number of links of every node, never the list of pairs.

Defined results: null and empty texts and texts without words have size 0 and no link; texts with fewer words than a shingle are one shingle; rows
with the same set are linked at any similarity; rows that repeat an id are rows of their own and share a component only if linked; null ids never
name a component unless all its ids are null; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifethread.llm.arrays import Rolling, Words, free_names, map_arrow, map_pieces, mix, runs
from lifethread.llm.graph import components
from lifethread.runtime import forget, materialize

SKETCH = 20
BLOCK = 200
#: Sets, and what is compared before them, are sent in rounds of so many bytes, or of half a set of every document if that is more.
ROUND_BYTES = 1 << 28
_PARTS = 128
_STRIPES = 64


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    h = words.hashes(lower=True)
    roll, bounds, n = Rolling(h), words.bounds, words.counts
    first, many = words.windows(size)
    short = np.flatnonzero((n > 0) & (n < size))
    doc = np.concatenate((np.repeat(np.arange(len(n)), many), short))
    value = np.concatenate((roll(first, first + size), roll(bounds[short], bounds[short + 1])))
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[new], value[new]
    return np.split(value, np.searchsorted(doc, np.arange(1, len(n))))


def _node(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    parts = np.array([[np.bitwise_xor.reduce(mix(s)), np.sum(s * np.uint64(0x9E3779B97F4A7C15)), len(s)]], np.uint64)
    return int(mix(parts.sum(1))[0].view(np.int64))


def _place(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH)).astype(np.int64)


def hashed_counts(docs: DataFrame, size: int) -> np.ndarray:
    """How many sets hold a shingle of each hashed place: an array of fixed length, whatever the input."""
    width = (1 << SKETCH) // _STRIPES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from lifethread.llm.arrays import pieces, split_words

        total = np.zeros(1 << SKETCH, np.int64)
        for batch in batches:
            for _, _, data, offsets in pieces(batch):
                sets = shingle_sets(split_words(data, offsets), size)
                total += np.bincount(_place(np.concatenate(sets)), minlength=1 << SKETCH)
        parts = total.reshape(_STRIPES, width)
        if total.any():
            yield {"stripe": np.arange(_STRIPES, dtype=np.int32), "counts": [np.ascontiguousarray(p).tobytes() for p in parts]}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column("stripe").to_pylist(), batch.column("counts")):
                part = np.frombuffer(c.as_buffer(), np.int64)
                sums[k] = sums[k] + part if k in sums else part
        yield {"stripe": list(sums), "counts": [c.tobytes() for c in sums.values()]}

    schema = "stripe int, counts binary"
    added = map_arrow(map_arrow(docs.select("text"), count, schema).repartition(_STRIPES, "stripe"), add, schema)
    out = np.zeros((_STRIPES, width), np.int64)
    for r in added.toLocalIterator():
        out[r.stripe] = np.frombuffer(r.counts, np.int64)
    return np.minimum(out.ravel(), np.iinfo(np.uint32).max).astype(np.uint32)


class Similarity:
    """The least similarity ``p / q`` in whole numbers."""

    def __init__(self, least: Fraction) -> None:
        self.p, self.q = least.numerator, least.denominator

    def overlap(self, n, m):
        """The least overlap of linked sets of n and m shingles: p (n + m) / (p + q), rounded up."""
        return -(-self.p * (n + m) // (self.p + self.q))

    def prefix(self, n):
        return n - -(-self.p * n // self.q) + 1

    def fits(self, small, large):
        return self.q * small >= self.p * large


def _rare_first(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return s[np.lexsort((s, counts[_place(s)]))]


def _parts(s: np.ndarray) -> np.ndarray:
    """Counts of the hashed parts of a set: the sum of the smaller counts of two sets bounds their overlap."""
    return np.bincount((s >> np.uint64(20)).astype(np.int64) % _PARTS, minlength=_PARTS).astype(np.int32)


def _packed(parts: np.ndarray) -> bytes:
    """One byte for each part where that is enough."""
    return parts.astype(np.uint8 if parts.max() < 256 else np.int32).tobytes()


def _unpacked(raw: list[bytes]) -> np.ndarray:
    if all(len(r) == _PARTS for r in raw):
        return np.frombuffer(b"".join(raw), np.uint8).reshape(-1, _PARTS)
    return np.stack([np.frombuffer(r, np.uint8 if len(r) == _PARTS else np.int32).astype(np.int32) for r in raw])


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> list[int]:
    """The smallest member of each one's component."""
    head = list(range(n))

    def find(k: int) -> int:
        while head[k] != k:
            head[k] = head[head[k]]
            k = head[k]
        return k

    for a, b in zip(i.tolist(), j.tolist()):
        a, b = find(a), find(b)
        head[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def _candidates(sim: Similarity):
    """Edges between nodes of a unit (sharing one prefix shingle) that pass the filters; rows come sorted by unit."""

    def passes(n, m, pi, pj, a, b):  # noqa: ANN001
        small = np.minimum(n, m)
        keep = sim.fits(small, np.maximum(n, m)) & (np.minimum(pi, pj) + 1 + np.minimum(n - pi - 1, m - pj - 1) >= sim.overlap(n, m))
        out = np.flatnonzero(keep)
        return out[np.minimum(a[out], b[out]).sum(1) >= sim.overlap(n[out], m[out])]

    def edges(t: pa.Table) -> dict:
        unit, node, n, at = (t.column(c).to_numpy() for c in ("unit", "node", "n", "at"))
        pair, side = t.column("pair").to_numpy(zero_copy_only=False), t.column("side").to_numpy(zero_copy_only=False)
        parts = _unpacked(t.column("parts").to_pylist())
        edge = runs(unit)
        lo, size = edge[:-1], np.diff(edge)
        two = lo[(size == 2)]
        two = two[(node[two] != node[two + 1]) & (~pair[two] | (side[two] != side[two + 1]))]
        good = two[passes(n[two], n[two + 1], at[two], at[two + 1], parts[two], parts[two + 1])]
        a, b = [node[good]], [node[good + 1]]
        for k, m in zip(lo[size > 2].tolist(), size[size > 2].tolist()):
            i, j = np.triu_indices(m, 1)
            if pair[k]:
                cross = side[k + i] != side[k + j]
                i, j = i[cross], j[cross]
            ok = np.concatenate([x + passes(n[k + i[x: x + 4096]], n[k + j[x: x + 4096]], at[k + i[x: x + 4096]], at[k + j[x: x + 4096]], parts[k + i[x: x + 4096]], parts[k + j[x: x + 4096]]) for x in range(0, len(i), 4096)] or [np.zeros(0, np.int64)])
            if len(ok):
                root = np.array(_roots(m, i[ok], j[ok]))
                linked = np.flatnonzero(root != np.arange(m))
                a.append(node[k + linked])
                b.append(node[k + root[linked]])
        return {"a": np.concatenate(a), "b": np.concatenate(b)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        rest: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            unit = t.column("unit").to_numpy()
            other = np.flatnonzero(unit != unit[-1])  # the last unit may go on in the next batch
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield edges(t.slice(0, cut))
            rest = t.slice(cut).combine_chunks()
        if rest is not None and rest.num_rows:
            yield edges(rest)

    return run


def _unit_links(sets: list[np.ndarray], counts: np.ndarray, sim: Similarity, cross: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (i, j) of the unit; with ``cross`` (side of each set) only pairs of different sides."""
    size = np.array([len(s) for s in sets])
    order = [_rare_first(s, counts) for s in sets]
    length = np.array([sim.prefix(int(n)) for n in size])
    token = np.concatenate([o[:k] for o, k in zip(order, length)])
    who = np.repeat(np.arange(len(sets)), length)
    at = np.concatenate([np.arange(k) for k in length])
    by = np.argsort(token, kind="stable")
    token, who, at = token[by], who[by], at[by]
    edge = runs(token)
    upper = np.triu(np.ones((len(sets), len(sets)), bool), 1)
    found = np.zeros((len(sets), len(sets)), bool)
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
        if hi - lo < 2:
            continue
        held = who[lo:hi]  # ascending
        a, b = np.nonzero(upper[: hi - lo, : hi - lo] & ~found[np.ix_(held, held)])
        if not len(a):
            continue
        i, j, pi, pj = held[a], held[b], at[lo + a], at[lo + b]
        n, m = size[i], size[j]
        keep = sim.fits(np.minimum(n, m), np.maximum(n, m))  # length
        keep &= np.minimum(np.minimum(pi, pj) + 1 + np.minimum(n - pi - 1, m - pj - 1), np.minimum(n, m)) >= sim.overlap(n, m)  # position
        if cross is not None:
            keep &= cross[i] != cross[j]
        found[i[keep], j[keep]] = True
    i, j = np.nonzero(found)
    parts = np.stack([_parts(s) for s in sets])
    good = np.zeros(len(i), bool)
    for lo in range(0, len(i), 4096):
        a, b = i[lo: lo + 4096], j[lo: lo + 4096]
        maybe = np.flatnonzero(np.minimum(parts[a], parts[b]).sum(1) >= sim.overlap(size[a], size[b]))  # suffix
        for k in maybe.tolist():
            x, y = sets[a[k]], sets[b[k]]
            slot = np.searchsorted(y, x)
            slot[slot == len(y)] = 0
            good[lo + k] = int((y[slot] == x).sum()) >= sim.overlap(len(x), len(y))
    return i[good], j[good]


def _units(counts: np.ndarray, sim: Similarity):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """Rows come sorted by unit; a unit is held at a time."""

        def close(unit: list[tuple[int, bool, bytes]], pair: bool) -> dict:
            unit = sorted({x[0]: x for x in unit}.values(), key=lambda x: x[:2])  # rows that repeat an id send their set again
            nodes, side = [x[0] for x in unit], np.array([x[1] for x in unit])
            sets = [np.frombuffer(x[2], np.uint64) for x in unit]
            i, j = _unit_links(sets, counts, sim, side if pair else None)
            root = _roots(len(nodes), i, j)
            n = np.bincount(i, minlength=len(nodes)) + np.bincount(j, minlength=len(nodes))
            some = np.flatnonzero(n).tolist()
            return {"node": [nodes[k] for k in some], "head": [nodes[root[k]] for k in some], "links": n[some]}

        held: list[tuple[int, bool, bytes]] = []
        last = None
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("unit", "pair", "node", "side", "shingles")]
            for unit, pair, node, side, shingles in zip(*cols):
                if last is not None and unit != last[0]:
                    yield close(held, last[1])
                    held = []
                last = (unit, pair)
                held.append((node, side, shingles))
        if held:
            yield close(held, last[1])

    return link


def _cut(rows: DataFrame, key: str, band: Column, many: Column, below: Column, own: Column, above: Column, most: int) -> DataFrame:
    """``rows`` with ``units``: where a row is compared. A key of up to ``most`` rows is one unit; else every pair of blocks of the same band (``own``
    blocks, the row is in block ``mine``) or of adjacent bands (``below``, ``above``) is one."""

    def entry(name: Column, pair: Column, side: Column) -> Column:
        return F.struct(name.alias("unit"), pair.alias("pair"), side.alias("side"))

    def unit(b1: Column, i: Column, b2: Column, j: Column) -> Column:
        return F.xxhash64(key, b1, i, b2, j)

    span = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    i, yes, no = F.col("mine"), F.lit(True), F.lit(False)
    same = F.transform(span(own), lambda j: entry(unit(band, F.least(i, j), band, F.greatest(i, j)), i != j, i > j))
    up = F.transform(span(above), lambda j: entry(unit(band, i, band + 1, j), yes, no))
    down = F.transform(span(below), lambda j: entry(unit(band - 1, j, band, i), yes, yes))
    return rows.withColumn("units", F.when(many <= most, F.array(entry(F.col(key), no, no))).otherwise(F.concat(same, up, down)))


def _rounds(rows: DataFrame, bytes_sent: Column, most: int) -> Iterator[DataFrame]:
    """``rows`` with a part of their ``units`` at a time, so that about ``most`` bytes are sent at once; a unit is whole in its round."""
    rounds = max(1, -(-int(rows.agg(F.sum(bytes_sent)).first()[0] or 0) // most))
    for k in range(rounds):
        some = rows if rounds == 1 else rows.withColumn("units", F.filter("units", lambda u: F.pmod(u["unit"], F.lit(rounds)) == k))
        yield some if rounds == 1 else some.filter(F.size("units") > 0)


def _classed(docs: DataFrame, size: int, least: Fraction, block: int) -> DataFrame:
    """doc_id, n, node (name of the set, null if empty), root (name of its component), links, and ``key`` (a hash of the text) of every row."""
    sim = Similarity(least)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("key"))

    def name(batch: pa.RecordBatch, words: Words) -> dict:
        sets = shingle_sets(words, size)
        return {"doc_id": batch.column("doc_id"), "n": [len(s) for s in sets], "node": [_node(s) if len(s) else None for s in sets],
                "parts": [_packed(_parts(s)) if len(s) else None for s in sets], "key": batch.column("key")}

    stored = materialize(map_pieces(rows, name, "doc_id long, n long, node long, parts binary, key long"), "jaccard-named")
    named = stored.select("doc_id", "n", "node", "key")
    counts = rows.sparkSession.sparkContext.broadcast(hashed_counts(rows, size))  # 4 bytes times 2 ** SKETCH

    def prefixes(batch: pa.RecordBatch, words: Words) -> dict:
        sets = [s for s in shingle_sets(words, size) if len(s)]
        top = [_rare_first(s, counts.value)[: sim.prefix(len(s))] for s in sets]
        many = [len(t) for t in top]
        return {"shingle": (np.concatenate(top) if top else np.zeros(0, np.uint64)).view(np.int64), "node": np.repeat(np.array([_node(s) for s in sets], np.int64), many),
                "at": np.concatenate([np.arange(k) for k in many] or [np.zeros(0, int)])}

    prefix = map_pieces(rows, prefixes, "shingle long, node long, at int")
    shared = prefix.groupBy("shingle").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("many")).filter("low <> high")
    shared = materialize(shared.select("shingle", "many"), "jaccard-shared")
    held = prefix.join(shared, "shingle").dropDuplicates(["shingle", "node"])
    held = materialize(held.withColumn("blocks", F.ceil(F.col("many") / block).cast("int")), "jaccard-held")
    info = stored.filter("node IS NOT NULL").groupBy(F.col("node").alias("of_node")).agg(F.first("n").alias("n"), F.first("parts").alias("parts"))
    info = info.join(held.select(F.col("node").alias("of_node")).distinct(), "of_node", "left_semi")
    compared = _cut(held.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "shingle", F.lit(0), F.col("many"), F.lit(0), F.col("blocks"), F.lit(0), block)
    compared = materialize(compared.join(info, F.col("node") == F.col("of_node")).select("node", "at", "n", "parts", "units"), "jaccard-compared")
    half = max(ROUND_BYTES, 4 * (stored.agg(F.sum("n")).first()[0] or 0))
    size_of = (F.octet_length("parts") + 48) * F.size("units")
    edges = None
    for some in _rounds(compared, size_of, half):
        ready = some.select("node", "at", "n", "parts", F.explode("units").alias("u")).select("u.unit", "u.pair", "u.side", "node", "at", "n", "parts")
        ready = ready.repartition(F.col("unit")).sortWithinPartitions("unit", "node")
        found = materialize(map_arrow(ready, _candidates(sim), "a long, b long").distinct(), "jaccard-edges")
        edges = found if edges is None else edges.unionByName(found)
    clusters = materialize(components(edges, "jaccard-clusters").withColumnRenamed("root", "cluster"), "jaccard-cluster")

    # One row of documents stands for each clustered set, found again by its id and text; if possible one that no other row equals in both.
    chosen = named.join(clusters, "node").groupBy("cluster", "node", "doc_id", "key").agg(F.first("n").alias("n"), F.count("*").alias("rows"))
    best = F.struct((F.col("rows") > 1).alias("again"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "n")
    chosen = chosen.groupBy("cluster", "node").agg(F.min(best).alias("x")).select("cluster", "node", "x.n", F.col("x.doc_id").alias("of"), F.col("x.key").alias("of_key"), "x.again")
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(sim.q / sim.p)) + 1e-9).cast("int") if sim.p < sim.q else F.col("n").cast("int")
    chosen = materialize(chosen.withColumn("band", band), "jaccard-chosen")
    bands = chosen.groupBy("cluster", "band").agg(F.count("*").alias("in_band"))
    total = bands.groupBy("cluster").agg(F.sum("in_band").alias("in_cluster"), F.map_from_entries(F.collect_list(F.struct("band", "in_band"))).alias("bands"))
    total = materialize(total.withColumnRenamed("cluster", "at"), "jaccard-bands")
    cut = chosen.join(total, F.col("cluster") == F.col("at")).select("of", "of_key", "again", "node", "cluster", "band", "in_cluster", "n", *(
        F.ceil(F.coalesce(F.try_element_at("bands", F.col("band") + k), F.lit(0)) / block).cast("int").alias(f"blocks{k + 1}") for k in (-1, 0, 1)))
    mine = F.pmod(F.xxhash64("node"), F.greatest("blocks1", F.lit(1))).cast("int")
    cut_rows = materialize(cut.withColumn("mine", mine), "jaccard-cut")

    cut = _cut(cut_rows, "cluster", F.col("band"), F.col("in_cluster"), F.col("blocks0"), F.col("blocks1"), F.col("blocks2"), 2 * block)
    wanted = cut.select("of", "of_key", "again", F.col("node").alias("node_of"), F.col("n").alias("in_set"), "units")

    def resets(batch: pa.RecordBatch, words: Words) -> dict:
        sets, nodes = shingle_sets(words, size), batch.column("node_of").to_pylist()
        keep = [k for k, s in enumerate(sets) if len(s) and _node(s) == nodes[k]]  # texts of equal hash may differ
        return {"node": [nodes[k] for k in keep], "shingles": [sets[k].tobytes() for k in keep], "units": batch.column("units").take(pa.array(keep, pa.int64()))}

    kind = "array<struct<unit:bigint,pair:boolean,side:boolean>>"
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key"))
    found = rows.join(wanted.filter("NOT again"), same).select("text", "node_of", "in_set", "units")
    repeated = wanted.filter("again").drop("again")
    if not repeated.isEmpty():  # equal rows: one of each
        found = found.unionByName(rows.join(repeated, same).dropDuplicates(["node_of"]).select("text", "node_of", "in_set", "units"))
    texts = materialize(found, "jaccard-texts")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        return _units(counts.value, sim)(batches)

    linked = None
    for some in _rounds(texts, 8 * F.col("in_set") * F.size("units"), half):
        full = map_pieces(some, resets, f"node long, shingles binary, units {kind}")
        sent = full.select("node", "shingles", F.explode("units").alias("u")).select("node", "shingles", "u.unit", "u.pair", "u.side")
        ready = sent.repartition(F.col("unit")).sortWithinPartitions("unit", "node")
        found = materialize(map_arrow(ready, once, "node long, head long, links long"), "jaccard-linked")
        linked = found if linked is None else linked.unionByName(found)
    groups = components(linked.select(F.col("node").alias("a"), F.col("head").alias("b")), "jaccard-groups")
    degree = linked.groupBy("node").agg(F.sum("links").alias("links"))
    known = materialize(groups.join(degree, "node", "left").select(F.col("node").alias("node_of"), "root", "links"), "jaccard-known")
    classed = named.join(known, F.col("node") == F.col("node_of"), "left").select("doc_id", "n", "node", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"), "key")
    classed = materialize(classed, "jaccard-classed")
    for table in (stored, shared, held, compared, edges, clusters, chosen, total, cut_rows, texts, linked, known):
        forget(table)
    return classed


def jaccard_join(docs: DataFrame, size: int = 5, least: Fraction = Fraction(4, 5), block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked doc_id), node (name of the set, null if empty), links (other sets that reach ``least``)."""
    classed = _classed(docs, size, least, block)
    least_id = materialize(classed.filter("root IS NOT NULL").groupBy(F.col("root").alias("of_root")).agg(F.min("doc_id").alias("component_id")), "jaccard-least")
    return classed.join(least_id, F.col("root") == F.col("of_root"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "node", "links")


def one_of_each(docs: DataFrame, size: int = 5, least: Fraction = Fraction(4, 5)) -> DataFrame:
    """One row of each group of linked rows, that of the smallest id (null last, then by a hash of the text); rows without words all stay.

    Rows are told apart by id and a 64-bit hash of the text, so rows that share an id, or have none, are decided each by itself."""
    key = F.xxhash64(F.col("text").cast("string"))
    of, of_key = free_names(docs, "of", "of_key")
    classed = _classed(docs, size, least, BLOCK).filter("root IS NOT NULL")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    first = classed.groupBy(F.col("root").alias("of_root")).agg(F.min(rank).alias("first"))
    places = classed.groupBy("root", "doc_id", "key").agg(F.count("*").alias("many"))
    placed = places.join(first, F.col("root") == F.col("of_root")).select(F.col("doc_id").alias(of), F.col("key").alias(of_key), (rank == F.col("first")).alias("stays"), "many")
    placed = materialize(placed.filter("NOT stays OR many > 1"), "jaccard-places")
    again, placed = placed.filter("stays").select(of, of_key), placed.select(of, of_key)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & (key == F.col(of_key))
    if again.isEmpty():
        return docs.join(placed, same, "left_anti")
    once = docs.join(again, same, "left_semi").withColumn(of, F.col("doc_id").cast("long")).withColumn(of_key, key).dropDuplicates([of, of_key])
    return docs.join(placed, same, "left_anti").unionByName(once.drop(of, of_key))
