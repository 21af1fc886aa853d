"""Density clustering of event vectors (C1): HDBSCAN with cosine distance and excess-of-mass selection.

Distances are rounded to nine decimals and edges are ordered by (weight, lower id, higher id), so the
result does not depend on how rows are spread. Groups up to ``TASK_ROWS`` events are clustered inside a task, a bounded block; larger ones by
joins over the whole table (``condensed``), with the same order of edges and the same labels.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifethread.operators.blocks import RANK_DIGITS, Side, best_per_row, block_apply, similarity, tie_codes
from lifethread.operators.condensed import EQUAL, LEAST, Rounds, cluster_points, tops
from lifethread.operators.ordered import number_rows
from lifethread.operators.similarity import cosine_topk
from lifethread.runtime import materialize, ship

NOISE = -1
# Groups up to this many events are clustered inside one task.
TASK_ROWS = 3000


def mutual_reachability(x: np.ndarray, min_samples: int) -> np.ndarray:
    """Distances no smaller than the distance of either point to its ``min_samples``-th neighbour."""
    length = np.linalg.norm(x, axis=1, keepdims=True)
    unit = x / np.where(length > 0, length, 1.0)
    d = np.round(1.0 - np.round(unit @ unit.T, RANK_DIGITS), RANK_DIGITS)
    np.fill_diagonal(d, 0.0)
    core = np.sort(d, axis=1)[:, min(len(d) - 1, min_samples)]
    return np.maximum(d, np.maximum(core[:, None], core[None, :]))


def spanning_tree(w: np.ndarray) -> np.ndarray:
    """Edges (u, v, weight) of the lightest tree over a dense weight matrix, edges in order of (weight, lower point, higher point)."""
    n = len(w)
    inside, points = np.zeros(n, dtype=bool), np.arange(n)
    best, code = np.full(n, np.inf), np.full(n, np.iinfo(np.int64).max)
    at, edges = 0, []
    for _ in range(n - 1):
        inside[at] = True
        here = np.minimum(points, at) * n + np.maximum(points, at)
        nearer = ~inside & ((w[at] < best) | ((w[at] == best) & (here < code)))
        best[nearer], code[nearer] = w[at][nearer], here[nearer]
        open_ = np.where(inside, np.inf, best)
        ties = np.flatnonzero(open_ == open_.min())
        at = int(ties[np.argmin(code[ties])])
        edges.append((code[at] // n, code[at] % n, best[at]))
    return np.array(edges, dtype=float).reshape(-1, 3)


def tree_labels(edges: np.ndarray, n: int, min_cluster_size: int) -> np.ndarray:
    """Cluster of each of ``n`` points from their spanning tree; -1 is noise, numbers follow the lowest point."""
    edges = edges[np.lexsort((edges[:, 1], edges[:, 0], edges[:, 2]))]
    left, right, size = np.zeros(n - 1, dtype=int), np.zeros(n - 1, dtype=int), np.ones(2 * n - 1, dtype=int)
    link, top = np.arange(n), np.arange(n)

    def root(i: int) -> int:
        while link[i] != i:
            link[i] = link[link[i]]
            i = link[i]
        return i

    for i, (u, v, _) in enumerate(edges):
        a, b = root(int(u)), root(int(v))
        left[i], right[i] = top[a], top[b]
        size[n + i] = size[top[a]] + size[top[b]]
        link[b] = a
        top[a] = n + i

    density = 1.0 / np.maximum(edges[:, 2], LEAST)
    cluster_of = np.zeros(2 * n - 1, dtype=int)  # of every merge and point, the cluster it is or falls out of
    parent, born, mass = [-1], [0.0], [0.0]
    for i in range(n - 2, -1, -1):
        mine, pair = cluster_of[n + i], (left[i], right[i])
        if size[n + i] < min_cluster_size:  # inside a side that already fell out
            cluster_of[list(pair)] = mine
            continue
        splits = size[pair[0]] >= min_cluster_size and size[pair[1]] >= min_cluster_size
        for c in pair:
            leaves = splits or size[c] < min_cluster_size
            if leaves:
                mass[mine] += size[c] * (density[i] - born[mine])
            cluster_of[c] = mine
            if splits:
                cluster_of[c] = len(parent)
                parent.append(mine)
                born.append(density[i])
                mass.append(0.0)

    below, chosen = np.zeros(len(parent)), np.zeros(len(parent), dtype=bool)
    for c in range(len(parent) - 1, 0, -1):
        chosen[c] = mass[c] >= below[c] * (1 - EQUAL)
        below[parent[c]] += max(mass[c], below[c])
    owner = np.full(len(parent), NOISE)
    for c in range(1, len(parent)):
        above = owner[parent[c]]
        owner[c] = above if above != NOISE else (c if chosen[c] else NOISE)
    found = owner[cluster_of[:n]]
    numbers = {c: k for k, c in enumerate(dict.fromkeys(int(c) for c in found if c != NOISE))}
    return np.array([numbers.get(int(c), NOISE) for c in found], dtype=np.int32)


def _schema(df: DataFrame, by: Sequence[str], id_col: str) -> str:
    cols = [f"{c} {df.schema[c].dataType.simpleString()}" for c in (*by, id_col)]
    return ", ".join([*cols, "label int"])


def hdbscan(
    df: DataFrame, id_col: str = "id", vec: str = "vec", min_cluster_size: int = 5, min_samples: int | None = None,
    by: Sequence[str] = (), task_rows: int = TASK_ROWS, **blocks: int,
) -> DataFrame:
    """(by..., id, label); -1 is noise. Groups with fewer events than a cluster are noise as a whole.

    An id may occur in several groups; rows of one group with the same id are different events. Rows without a vector are left out.
    """
    ship(df.sparkSession)
    ms = max(2, min_cluster_size - 1) if min_samples is None else min_samples
    keys = list(by) or ["_all"]
    rows = df.where(F.col(vec).isNotNull())
    rows = rows.select(*by, id_col, vec) if by else rows.select(id_col, vec).withColumn("_all", F.lit(0))
    sizes = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "density")
    n = F.col("_n")
    few = rows.join(sizes.where(n < min_cluster_size), keys, "left_semi").select(*keys, id_col, F.lit(NOISE).alias("label"))
    small = rows.join(sizes.where((n >= min_cluster_size) & (n <= task_rows)), keys, "left_semi")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col)
        w = mutual_reachability(np.stack([np.asarray(v, dtype=np.float64) for v in pdf[vec]]), ms)
        return pdf[[*keys, id_col]].assign(label=tree_labels(spanning_tree(w), len(pdf), min_cluster_size))

    done = few.unionByName(small.groupBy(*keys).applyInPandas(one, _schema(rows, keys, id_col)))
    large = sizes.where((n >= min_cluster_size) & (n > task_rows))
    if not large.isEmpty():
        many = rows.join(large, keys, "left_semi").select(*keys, F.col(id_col).alias("_id"), F.col(vec).alias("vec"))
        many = materialize(number_rows(many, [*keys, "_id"], "id"), "density")
        tree, rounds = reachability_tree(many, keys, "id", "vec", ms, **blocks)
        labels = cluster_points(many.select(*keys, "id"), tree, rounds, keys, min_cluster_size, NOISE).select("id", "label")
        done = done.unionByName(many.drop("vec").join(labels, "id").select(*keys, F.col("_id"), "label").toDF(*keys, id_col, "label"))
    return done.select(*by, id_col, "label")


def _edge(a: Column, b: Column, w: Column) -> Column:
    return F.struct(w.alias("w"), F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))


def reachability_tree(
    rows: DataFrame, keys: list[str], id_col: str, vec: str, min_samples: int, neighbours: int | None = None, **blocks: int
) -> tuple[DataFrame, Rounds]:
    """Lightest spanning tree of the mutual reachability graphs of all groups, (u, v, w), and the rounds that found it.

    Each round every component takes its lightest edge to another one. A point first looks among its
    nearest neighbours; an edge it does not list weighs at least the distance of the last one listed, so only
    points for which that could still win over the best of their component are compared with all others,
    block by block, and one row per point and block leaves a task.
    """
    k = max(2 * min_samples, 16) if neighbours is None else neighbours
    ids = rows.select(*keys, F.col(id_col).alias("id"), F.col(vec).alias("vec"))
    near = cosine_topk(ids, ids, k, qid="id", cid="id", vec="vec", by=keys, exclude_self=True, way="blocks", **blocks)
    near = materialize(
        near.select(F.col("qid").alias("a"), F.col("id").alias("b"), F.round(1.0 - F.col("sim"), RANK_DIGITS).alias("d"), "rank"), "density"
    )
    reach = near.groupBy(F.col("a").alias("id")).agg(
        F.max_by("d", F.when(F.col("rank") <= min_samples, F.col("rank"))).alias("core"), F.max("d").alias("last"), F.count(F.lit(1)).alias("listed")
    )
    sizes = ids.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("others"))
    points = materialize(ids.join(reach, "id").join(sizes, keys), "density")
    core = points.select("id", "core")
    listed = materialize(
        near.join(core.toDF("a", "core_a"), "a").join(core.toDF("b", "core_b"), "b").select("a", "b", F.greatest("d", "core_a", "core_b").alias("w")), "density"
    )
    comp = points.select("id", F.col("id").alias("comp"))
    tree = points.select(F.col("id").alias("u"), F.col("id").alias("v"), F.lit(0.0).alias("w")).limit(0)
    rounds: Rounds = []
    while True:
        here = comp.select(F.col("id").alias("a"), F.col("comp").alias("ca"))
        there = comp.select(F.col("id").alias("b"), F.col("comp").alias("cb"))
        outside = listed.join(here, "a").join(there, "b").where("ca <> cb")
        first = outside.groupBy("ca").agg(F.min(_edge(F.col("a"), F.col("b"), F.col("w"))).alias("e"))
        first = materialize(first, "density")
        floor = F.greatest("last", "core")
        member = points.join(comp, "id")
        open_groups = member.groupBy(*keys).agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo <> _hi").select(*keys)
        placed = member.join(open_groups, keys, "left_semi").join(first.select(F.col("ca").alias("comp"), F.col("e.w").alias("best")), "comp", "left")
        unsure = placed.where((F.col("listed") < F.col("others")) & (F.col("best").isNull() | (floor <= F.col("best"))))
        scanned = _scan(unsure, member, keys, **blocks)
        picked = first.unionByName(scanned).groupBy("ca").agg(F.min("e").alias("e")) if scanned is not None else first
        picked = materialize(picked.select(F.col("ca").alias("comp"), "e.u", "e.v", "e.w"), "density")
        if picked.isEmpty():
            return tree, rounds
        tree = materialize(tree.unionByName(picked.select("u", "v", "w").distinct()), "density")
        hook = _contract(comp, picked)
        rounds.append((picked.select("comp", "u", "v"), hook))
        comp = materialize(comp.join(hook, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")), "density")


def _scan(unsure: DataFrame, everyone: DataFrame, keys: list[str], **blocks: int) -> DataFrame | None:
    """Lightest edge of each component of ``unsure`` to any point of another component."""
    queries = materialize(unsure.select(*keys, "id", "vec", "core", "comp"), "density")
    if queries.isEmpty():
        return None
    kind = queries.schema["id"].dataType.simpleString()

    def kernel(q: Side, c: Side) -> dict[str, np.ndarray]:
        d = np.round(1.0 - similarity(q, c), RANK_DIGITS)
        w = np.maximum(d, np.maximum(q.cols["core"][:, None], c.cols["core"][None, :]))
        w = np.where(q.cols["comp"][:, None] == c.cols["comp"][None, :], np.inf, w)
        row, col = best_per_row(-w, tie_codes(c.ids), 1)
        return {"ca": q.cols["comp"][row], "a": q.ids[row], "b": c.ids[col], "w": w[row, col]}

    found = block_apply(
        queries, everyone.select(*keys, "id", "vec", "core", "comp"), kernel, f"ca {kind}, a {kind}, b {kind}, w double",
        qid="id", cid="id", vec="vec", q_extra=["core", "comp"], c_extra=["core", "comp"], by=keys, **blocks,
    )
    return found.groupBy("ca").agg(F.min(_edge(F.col("a"), F.col("b"), F.col("w"))).alias("e"))


def _contract(comp: DataFrame, picked: DataFrame) -> DataFrame:
    """Join the components along the picked edges: (comp, to); a joined component is named by one of its own."""
    at = comp.select(F.col("id").alias("_p"), F.col("comp").alias("_c"))
    ends = picked.join(at.toDF("u", "cu"), "u").join(at.toDF("v", "cv"), "v")
    other = ends.select("comp", F.when(F.col("cu") == F.col("comp"), F.col("cv")).otherwise(F.col("cu")).alias("to"))
    # Edges are totally ordered, so picks form trees whose only cycles are two components picking each other.
    mutual = other.select(F.col("to").alias("comp"), F.col("comp").alias("to")).withColumn("_back", F.lit(True))
    hook = other.join(mutual, ["comp", "to"], "left").select(
        F.col("comp").alias("node"), F.when(F.col("_back") & (F.col("comp") < F.col("to")), F.col("comp")).otherwise(F.col("to")).alias("to")
    )
    return tops(hook, "density").withColumnRenamed("node", "comp")
