"""From a lightest spanning tree to density clusters, by joins and grouped sums; no step holds a group in one task.

The tree comes with the rounds that found it: in each round every component picked its lightest edge and was joined along it. An edge joined in
round k climbs the components that later held it, up to the first whose pick is heavier. The edges that stop at one component, in order of weight,
are consecutive merges of the single-linkage hierarchy, and the last of them is followed by the pick of that component; so all parents are
found in as many joins as there were rounds, and sizes are running sums over these stretches. Clusters, their stabilities and the points
that belong to them follow by pointer jumping; the selection of stable clusters contracts leaves and stretches without branches until nothing is left.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifethread.operators.ordered import OrderedScan, number_rows
from lifethread.runtime import materialize, materialize_seen

#: Points of no distance are this far apart when densities are compared.
LEAST = 1e-10
#: Stabilities that differ by less than this share count as equal, whatever the order they were summed in.
EQUAL = 1e-9

Rounds = list[tuple[DataFrame, DataFrame]]


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def tops(links: DataFrame, tag: str = "tops") -> DataFrame:
    """Follow ``to`` until it leads to itself: (node, to) with the last node of every path."""
    now = materialize(links.select("node", "to"), tag)
    while True:
        onward = now.select(F.col("node").alias("to"), F.col("to").alias("_next"))
        jumped = now.join(onward, "to").select("node", F.col("_next").alias("to"), (F.col("_next") != F.col("to")).alias("_moved"))
        jumped, moved = materialize_seen(jumped, tag, F.count_if("_moved"))
        now = jumped.drop("_moved")
        if not moved:
            return now


def merges(points: DataFrame, tree: DataFrame, rounds: Rounds) -> DataFrame:
    """The hierarchy: (node, parent, size, w) of every merge and point.

    ``points`` has id (1, 2, ...); ``tree`` u, v, w; ``rounds`` per round the picks (comp, u, v) and where components went (comp, to). Merges are
    numbered in order of (w, u, v); a point's node is its negative id. The last merge of a group has no parent.
    """
    edges = materialize(number_rows(tree.select("u", "v", "w"), ["w", "u", "v"], "r"), "merges")
    named = [(materialize(p.join(edges, ["u", "v"]).select("comp", "r"), "picks"), hook) for p, hook in rounds]
    stretches, climbing = [], None
    for k in range(len(named) + 1):
        if k:
            picks, hook = named[k - 1]
            joined = picks.join(hook, "comp").select("r", F.col("to").alias("comp")).distinct()
            climbing = joined if climbing is None else climbing.unionByName(joined)
        if climbing is None:
            continue
        if k == len(named):
            here = climbing.withColumn("above", F.lit(None).cast("long"))
            stretches.append(here.select("r", F.lit(k).alias("level"), "comp", "above"))
            break
        picks, hook = named[k]
        met = materialize(climbing.join(picks.withColumnRenamed("r", "above"), "comp", "left"), "climbing")
        stays = F.col("above").isNull() | (F.col("above") > F.col("r"))
        stretches.append(met.where(stays).select("r", F.lit(k).alias("level"), "comp", "above"))
        climbing = met.where(~stays).join(hook, "comp").select("r", F.col("to").alias("comp"))
    if not stretches:
        return points.select((-F.col("id")).alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(1).cast("long").alias("size"), F.lit(None).cast("double").alias("w"))
    placed = materialize(_union(stretches), "stretches")
    first = named[0][0].select((-F.col("comp")).alias("node"), F.col("r").alias("parent"))
    gains = [first.groupBy(F.col("parent").alias("r")).agg(F.count(F.lit(1)).alias("gain"))]
    for level in range(1, len(named)):
        here = placed.where((F.col("level") == level) & F.col("above").isNotNull()).join(_union(gains), "r")
        gains.append(materialize(here.groupBy("comp", "above").agg(F.sum("gain").alias("gain")).select(F.col("above").alias("r"), "gain"), "gains"))
    gained = _union(gains).groupBy("r").agg(F.sum("gain").alias("gain"))
    scan = OrderedScan(placed.join(gained, "r").withColumn("_down", -F.col("r")), ["level", "comp"], ["_down"])
    scan = scan.previous(_next=F.col("r"))
    scan = OrderedScan(scan.result().drop("_down"), ["level", "comp"], ["r"], scan.split).running_sum(size=F.col("gain"))
    inner = scan.result().join(edges.select("r", "w"), "r").select(F.col("r").alias("node"), F.coalesce("_next", "above").alias("parent"), "size", "w")
    leaves = points.select((-F.col("id")).alias("node")).join(first, "node", "left").select("node", "parent", F.lit(1).cast("long").alias("size"), F.lit(None).cast("double").alias("w"))
    return materialize(inner.unionByName(leaves), "merges")


def _density(w: Column) -> Column:
    return F.lit(1.0) / F.greatest(w, F.lit(LEAST))


def _stable(clusters: DataFrame) -> DataFrame:
    """(c, mass, below): ``below`` is the best total that the clusters under c can have.

    The best of c is max(mass, sum of the children's best). Leaves are settled first; then stretches of clusters with one open child are
    drawn together, since x -> max(a, b + x) is closed under composition. Each round settles or draws together more than half of what is open.
    """
    lowest = F.lit(float("-inf"))
    now = materialize(clusters.select("c", "up", "mass", F.lit(0.0).alias("got"), lowest.alias("a"), F.lit(0.0).alias("b")), "stable")
    settled: list[DataFrame] = []
    waiting: list[DataFrame] = []
    while not now.isEmpty():
        inner = now.select(F.col("up").alias("c")).where("c IS NOT NULL").distinct()
        leaves = materialize(now.join(inner, "c", "left_anti"), "stable")
        settled.append(leaves.select("c", "mass", F.col("got").alias("below")))
        gave = F.greatest("a", F.col("b") + F.greatest("mass", "got"))
        given = leaves.where("up IS NOT NULL").groupBy(F.col("up").alias("c")).agg(F.sum(gave).alias("_given"))
        rest = now.join(inner, "c", "left_semi").join(given, "c", "left")
        rest = materialize(rest.select("c", "up", "mass", (F.col("got") + F.coalesce("_given", F.lit(0.0))).alias("got"), "a", "b"), "stable")
        only = rest.where("up IS NOT NULL").groupBy(F.col("up").alias("c")).agg(F.count(F.lit(1)).alias("_n"), F.min("c").alias("d"), F.min("a").alias("da"), F.min("b").alias("db"))
        line = rest.join(only.where("_n = 1"), "c").select(
            "c", "up", "mass", "a", "b", "d", (F.col("got") + F.col("da")).alias("p"), (F.col("got") + F.col("db")).alias("q"))
        line = materialize(line, "stable")  # below = max(p, q + best(d))
        if line.isEmpty():
            now = rest
            continue
        while True:
            ends = line.select(F.col("c").alias("d"), F.col("d").alias("d2"), F.greatest("mass", "p").alias("p2"), F.col("q").alias("q2"), F.lit(True).alias("more"))
            met = line.join(ends, "d", "left")
            p = F.when(F.col("more"), F.greatest("p", F.col("q") + F.col("p2"))).otherwise(F.col("p"))
            q = F.when(F.col("more"), F.col("q") + F.col("q2")).otherwise(F.col("q"))
            met = met.select("c", "up", "mass", "a", "b", F.coalesce("d2", "d").alias("d"), p.alias("p"), q.alias("q"), "more")
            met, moved = materialize_seen(met, "stable", F.count_if("more"))
            line = met.drop("more")
            if not moved:
                break
        waiting.append(line.select("c", "mass", "d", "p", "q"))
        heads = line.join(line.select(F.col("c").alias("up")), "up", "left_anti")  # the highest of each stretch stands for it
        passed = heads.select(F.col("d").alias("c"), F.col("up").alias("_up"), F.greatest("a", F.col("b") + F.greatest("mass", "p")).alias("_a"), (F.col("b") + F.col("q")).alias("_b"))
        kept = rest.join(line.select("c"), "c", "left_anti").join(passed.withColumn("_new", F.lit(True)), "c", "left")
        new = lambda fresh, old: F.when(F.col("_new"), F.col(fresh)).otherwise(F.col(old)).alias(old)
        now = materialize(kept.select("c", new("_up", "up"), "mass", "got", new("_a", "a"), new("_b", "b")), "stable")
    known = _union(settled)
    for line in reversed(waiting):
        best = known.select(F.col("c").alias("d"), F.greatest("mass", "below").alias("best"))
        known = materialize(known.unionByName(line.join(best, "d").select("c", "mass", F.greatest("p", F.col("q") + F.col("best")).alias("below"))), "stable")
    return known


def _owners(clusters: DataFrame) -> DataFrame:
    """(c, owner): the highest chosen cluster on the way from c to the root, null if there is none. ``clusters``: c, up, chosen."""
    now = materialize(clusters.select("c", F.col("up").alias("to"), F.when(F.col("chosen"), F.col("c")).alias("owner")), "owners")
    more = 1
    while more:
        onward = now.select(F.col("c").alias("to"), F.col("to").alias("_to"), F.col("owner").alias("_owner"))
        onward = now.join(onward, "to", "left").select("c", F.col("_to").alias("to"), F.coalesce("_owner", "owner").alias("owner"))
        now, more = materialize_seen(onward, "owners", F.count("to"))
    return now.select("c", "owner")


def cluster_points(points: DataFrame, tree: DataFrame, rounds: Rounds, keys: Sequence[str], min_cluster_size: int, noise: int = -1) -> DataFrame:
    """(keys..., id, label) of every point; clusters of a group are numbered from 0 by their lowest point."""
    nodes = merges(points, tree, rounds)
    big = F.col("size") >= min_cluster_size
    kids = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(
        F.count_if(big).alias("_big"), F.coalesce(F.sum(F.when(big, F.col("size"))), F.lit(0)).alias("_stay"))
    large = materialize(nodes.where(big).join(kids, "node").select(
        "node", "parent", _density(F.col("w")).alias("density"), (F.col("_big") == 2).alias("splits"),
        (F.col("size") - F.when(F.col("_big") == 1, F.col("_stay")).otherwise(0)).alias("leave")), "large")
    above = large.select(F.col("node").alias("parent"), F.col("splits").alias("_split"), F.col("density").alias("_born"))
    begun = materialize(large.join(above, "parent", "left").withColumn("_starts", F.col("parent").isNull() | F.col("_split")), "begun")
    of = tops(begun.select("node", F.when(F.col("_starts"), F.col("node")).otherwise(F.col("parent")).alias("to")))
    of = of.select("node", F.col("to").alias("c"))
    heads = begun.where("_starts").select(F.col("node").alias("c"), "parent", F.coalesce("_born", F.lit(0.0)).alias("born"))
    heads = heads.join(of.select(F.col("node").alias("parent"), F.col("c").alias("up")), "parent", "left").select("c", "up", "born")
    left = large.join(of, "node").join(heads.select("c", "born"), "c")
    mass = left.groupBy("c").agg(F.sum(F.col("leave") * (F.col("density") - F.col("born"))).alias("mass"))
    clusters = materialize(heads.join(mass, "c").select("c", "up", "mass"), "clusters")
    stable = _stable(clusters).select("c", "below")
    chosen = F.col("up").isNotNull() & (F.col("mass") >= F.col("below") * (1 - EQUAL))
    owners = _owners(clusters.join(stable, "c").select("c", "up", chosen.alias("chosen")))
    up = tops(nodes.select("node", F.when(big, F.col("node")).otherwise(F.coalesce("parent", "node")).alias("to"))).where("node < 0")
    found = up.select((-F.col("node")).alias("id"), F.col("to").alias("node")).join(of, "node", "left").join(owners, "c", "left").select("id", "owner")
    found = materialize(points.select(*keys, "id").join(found, "id"), "found")
    firsts = found.where("owner IS NOT NULL").groupBy(*keys, "owner").agg(F.min("id").alias("_first"))
    numbered = OrderedScan(firsts, keys, ["_first"]).position("_n").result().select("owner", (F.col("_n") - 1).cast("int").alias("label"))
    return found.join(numbered, "owner", "left").select(*keys, "id", F.coalesce("label", F.lit(noise)).alias("label"))
