"""Event graph: chains, expansion, look-ups and summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lifethread.operators.folds import fold_sorted
from lifethread.operators.history import best_rows
from lifethread.operators.ordered import OrderedScan
from lifethread.runtime import materialize


class ChainTails:
    """Open chain ends of one participant, newest last; shared by the batch fold and the stream."""

    def __init__(self, predicate: Callable[[dict, dict], bool] | None):
        self.predicate = predicate
        self.tails: list[dict] = []

    def add(self, event: dict) -> dict | None:
        """Link ``event`` to the newest tail that fits; without one it starts a chain."""
        for at in range(len(self.tails) - 1, -1, -1):
            if self.predicate is None or self.predicate(event, self.tails[at]):
                tail = self.tails.pop(at)
                self.tails.append(event)
                return tail
        self.tails.append(event)
        return None


def build_chains(
    events: DataFrame, predicate: Callable[[dict, dict], bool] | None = None, participant: str = "participant",
    event: str = "event_id", t: str = "t_sec", split: bool | None = None,
) -> DataFrame:
    """G1: NEXT_EVENT edges. By default every event follows the one before it.

    A predicate ``f(new, tail)`` makes each link depend on the links before it, so the events of one
    participant pass one after the other through one task, in batches; what stays in memory is the tails.
    """
    if predicate is None:
        linked = OrderedScan(events, [participant], (t, event), split).previous(src=F.col(event)).result()
        return linked.where("src IS NOT NULL").select(participant, "src", F.col(event).alias("dst"), F.lit("NEXT_EVENT").alias("type"))
    id_type = events.schema[event].dataType.simpleString()
    key_type = events.schema[participant].dataType.simpleString()

    def step(state: ChainTails, rows: pd.DataFrame) -> Iterator[tuple]:
        for row in rows.to_dict("records"):
            tail = state.add(row)
            if tail is not None:
                yield row[participant], tail[event], row[event], "NEXT_EVENT"

    return fold_sorted(
        events, [participant], [t, event], lambda: ChainTails(predicate), step,
        f"{participant} {key_type}, src {id_type}, dst {id_type}, type string",
    )


def tails(nodes: DataFrame, edges: DataFrame, head: bool = False) -> DataFrame:
    """Events nothing follows (or, with ``head``, that follow nothing), newest first."""
    used = edges.where(F.col("type") == "NEXT_EVENT").select(F.col("dst" if head else "src").alias("event_id"))
    return nodes.join(used, "event_id", "left_anti").orderBy(F.col("t_sec").desc(), F.col("event_id").desc())


def all_chains(nodes: DataFrame, edges: DataFrame, event: str = "event_id") -> DataFrame:
    """Every event with its chain (the head's id) and its position, for chains that do not branch.

    Pointer jumping: each round doubles the distance an event looks back, and only events that have not
    reached a head take part, so the look-back keys stay distinct. Events on a cycle have no head and are
    not part of any chain. Branching input goes through ``all_paths``.
    """
    nxt = edges.where(F.col("type") == "NEXT_EVENT").select(F.col("dst").alias(event), F.col("src").alias("_at"))
    linked = nodes.select(event).join(nxt, event, "left")
    state = materialize(
        linked.select(event, F.coalesce("_at", event).alias("_at"), F.when(F.col("_at").isNull(), 0).otherwise(1).cast("long").alias("pos")),
        "chains",
    )
    heads = state.where("pos = 0")
    open_rows, finished = state.where("pos > 0"), [heads]
    size, reach = None, 1
    while not open_rows.isEmpty():
        if size is None:
            size = state.count()
        if reach > size:
            break  # only cycles are left
        known = state.select(F.col(event).alias("_at"), F.col("_at").alias("_next"), F.col("pos").alias("_more"))
        far = materialize(
            open_rows.join(known, "_at").select(
                event, F.col("_next").alias("_at"), (F.col("pos") + F.col("_more")).alias("pos"), (F.col("_more") == 0).alias("_done")
            ),
            "chains",
        )
        finished.append(far.where("_done").drop("_done"))
        open_rows = far.where("NOT _done").drop("_done")
        state = _union([open_rows, *finished])
        reach *= 2
    done = _union(finished)
    return done.select(F.col("_at").alias("chain"), "pos", event)


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def all_paths(nodes: DataFrame, edges: DataFrame, event: str = "event_id", explode: bool = True) -> DataFrame:
    """G3 on branching input: every head-to-tail path as (path, pos, event); without ``explode`` one row per path, to be joined before its events are.

    Paths of any length are followed, one job per hop; a path that comes back to one of its own events raises an error.
    """
    nxt = materialize(edges.where(F.col("type") == "NEXT_EVENT").select(F.col("src").alias("_at"), F.col("dst").alias("_to")), "paths")
    front = nodes.select(event).join(nxt.select(F.col("_to").alias(event)), event, "left_anti").select(
        F.array(event).alias("path"), F.col(event).alias("_at")
    )
    closed = []
    while True:
        front = materialize(front.join(nxt, "_at", "left"), "paths")
        if not front.where(F.array_contains("path", F.col("_to"))).isEmpty():
            raise ValueError("NEXT_EVENT edges form a cycle")
        closed.append(front.where("_to IS NULL").select("path"))
        front = front.where("_to IS NOT NULL").select(F.concat("path", F.array("_to")).alias("path"), F.col("_to").alias("_at"))
        if front.isEmpty():
            break
    paths = _union(closed)
    return paths.select(F.col("path"), F.posexplode("path").alias("pos", event)) if explode else paths


def chain_summary(chains: DataFrame, event: str = "event_id") -> DataFrame:
    """Length, head and tail of every chain."""
    return chains.groupBy("chain").agg(
        F.count(F.lit(1)).alias("length"), F.min_by(event, "pos").alias("head"), F.max_by(event, "pos").alias("tail")
    )


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A1: nodes per label, edges per type, and the entities that any event involves."""
    line = lambda df, kind, col: df.groupBy(F.col(col).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    linked = edges.where(F.col("type") == "INVOLVES").agg(F.count_distinct("dst").alias("n")).select(
        F.lit("linked").alias("kind"), F.lit("entities").alias("name"), "n"
    )
    return line(nodes, "node", "label").unionByName(line(edges, "edge", "type")).unionByName(linked)


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges as they are walked without direction: (edge_id?, src, dst, type)."""
    cols = [c for c in edges.columns if c not in ("src", "dst")]
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *cols)
    return edges.select("src", "dst", *cols).unionByName(back)


def expand(
    core: DataFrame, events: DataFrame, edges: DataFrame, hops: int = 2, limit: int = 10, limit_scope: str = "per_core",
) -> DataFrame:
    """Events within ``hops`` undirected steps of core events, over any edge and node kind.

    One row per (question, core, neighbour, type of the first edge), newest neighbours first, at most
    ``limit`` per core event or, with ``limit_scope="global"``, per question. A neighbour has another
    time than its core. No edge is used twice on a path.

    Before the last step each node offers only the events that can still make the limit: with S = L + hops for L results
    wanted and at most ``hops`` neighbours lost to used edges, and one time excluded (the core's), the first S events of a
    time, of these the first 2 S, and no more than S + 1 times. With three hops the nodes next to the cores offer what is two
    steps away, each event with the lowest and the highest edge that leads to it: the one edge used before takes away at most
    one neighbour's offers, 2 S events and S of a time, so the first 2 S of a time and of these the first 5 S are enough. So a
    popular entity is looked at once for all questions and offers a bounded list, whatever its degree, and the result is the
    same as after walking all pairs. Only nodes that a question reaches offer anything. More than three hops are walked.

    A limit per question is applied before its cores are: after two hops a question first meets the offers of every node once,
    whichever cores led there, and only the best ``limit`` (neighbour, type) of these are joined with the cores (``_best_offers``).

    ``core`` has qid, event_id; ``events`` has event_id, t_sec; ``edges`` has src, dst, type (ids of one kind).
    """
    if limit_scope not in ("per_core", "global"):
        raise ValueError("limit_scope is 'per_core' or 'global'")
    walk = edges.select("src", "dst", "type")
    trail = hops > 2
    if trail:
        walk = walk.withColumn("_edge", F.monotonically_increasing_id())
        walk = materialize(walk, "edges")
    walk = both_ways(walk)
    time = events.select(F.col("event_id").alias("dst"), F.col("t_sec").alias("dst_t"))
    ending = walk.join(time, "dst")
    spare = limit + hops

    start = core.select("qid", F.col("event_id").alias("core")).distinct()
    start = start.join(events.select(F.col("event_id").alias("core"), F.col("t_sec").alias("core_t")), "core")
    used = [F.array("_edge").alias("_used")] if trail else []
    first = start.join(walk.withColumnRenamed("src", "core"), "core").select(
        "qid", "core", "core_t", F.col("dst").alias("node"), F.col("type").alias("relation_type"), *used
    ).distinct()
    if trail:
        first = materialize(first, "first")
    asked = first.select(F.col("node").alias("src")).distinct() if hops < 4 else None
    offers = _offers(ending, asked, spare, ["_edge"] if trail else [])

    keep = ["qid", "core", "core_t", "relation_type"]
    near = first.join(time.select(F.col("dst").alias("node"), "dst_t"), "node").select(*keep, F.col("node").alias("neighbour"), "dst_t")
    found, front = [near], first
    for hop in range(2, hops + 1):
        fresh = ~F.array_contains("_used", F.col("_edge")) if trail else F.lit(True)
        if hops == hop == 3:
            two = _offers_of_two(walk.join(asked, "src", "left_semi"), ending, spare)
            last = first.withColumn("_e", F.get("_used", F.lit(0))).join(two, "node").where("_low <> _e OR _high <> _e")
        elif limit_scope == "global" and hops == 2:
            last = _best_offers(first, offers.withColumnRenamed("src", "node"), limit)
        elif hops == 2:
            last = _first_offers(first, offers, limit)
        else:
            last = front.join(offers.withColumnRenamed("src", "node"), "node").where(fresh)
        found.append(last.select(*keep, F.col("dst").alias("neighbour"), "dst_t"))
        if hop < hops and hops > 3:
            onward = walk.select(F.col("src").alias("node"), F.col("dst").alias("_to"), "_edge")
            front = (
                front.join(onward, "node").where(~F.array_contains("_used", F.col("_edge")))
                .select(*keep, F.col("_to").alias("node"), F.concat("_used", F.array("_edge")).alias("_used")).distinct()
            )
    reached = _union(found).where(F.col("dst_t") != F.col("core_t"))
    if limit_scope == "per_core":  # one move serves both: rows of a core are made distinct where they are ranked
        reached = reached.repartition("qid", "core")
    reached = reached.distinct()
    scope = ["qid", "core"] if limit_scope == "per_core" else ["qid"]
    order = [F.col("dst_t").desc(), F.col("neighbour"), F.col("relation_type"), F.col("core")]
    return best_rows(reached, scope, order, limit, rank="rank").drop("core_t").withColumnRenamed("dst_t", "t_sec")


def _offers(ending: DataFrame, nodes: DataFrame | None, spare: int, more: Sequence[str] = ()) -> DataFrame:
    """(src, dst, dst_t): the events next to a node, ``spare`` of a time, the first ``2 * spare`` and of at most ``spare + 1`` times; ``nodes`` (src) are those asked for."""
    rows = (ending if nodes is None else ending.join(nodes, "src", "left_semi")).select("src", "dst", "dst_t", *more).distinct()
    rows = best_rows(rows, ["src", "dst_t"], [F.col("dst")], spare)
    rows = best_rows(rows, ["src"], [F.col("dst_t").desc(), F.col("dst")], 2 * spare)
    by_time = F.dense_rank().over(Window.partitionBy("src").orderBy(F.col("dst_t").desc()))
    return rows.withColumn("_time", by_time).where(F.col("_time") <= spare + 1).drop("_time")


def _first_offers(first: DataFrame, offers: DataFrame, limit: int) -> DataFrame:
    """(qid, core, core_t, relation_type, dst, dst_t): the first ``limit`` offers of another time than the core's, by each node and type next to a core.

    They are neighbours that differ, so the ones behind them cannot be among the first ``limit`` of the core; only these become rows.
    """
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.col("dst_t").desc(), F.col("dst")))
    lists = offers.withColumn("_place", place).groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_list(F.struct("_place", "dst", "dst_t"))).alias("_offers"))
    other = F.filter("_offers", lambda o: o["dst_t"] != F.col("core_t"))
    met = first.join(lists, "node").select("qid", "core", "core_t", "relation_type", F.explode(F.slice(other, 1, limit)).alias("o"))
    return met.select("qid", "core", "core_t", "relation_type", "o.dst", "o.dst_t")


def _best_offers(first: DataFrame, offers: DataFrame, limit: int) -> DataFrame:
    """(qid, core, core_t, relation_type, dst, dst_t): two steps from the cores of a question, with all rows that its first ``limit`` can hold.

    A (neighbour, type) that any core of another time reaches is at least one row, so the first ``limit`` of them are enough. Of the cores that
    reach a node by a type the first ``limit`` of a time and of these the first ``2 * limit`` are enough, since a neighbour excludes one time.
    """
    ways = ["qid", "relation_type", "node"]
    cores = best_rows(first.where("core_t IS NOT NULL"), [*ways, "core_t"], [F.col("core")], limit)
    cores = best_rows(cores, ways, [F.col("core"), F.col("core_t")], 2 * limit)
    met = cores.groupBy(*ways).agg(F.min("core_t").alias("_lo"), F.max("core_t").alias("_hi")).join(offers, "node")
    met = met.where((F.col("_lo") != F.col("dst_t")) | (F.col("_hi") != F.col("dst_t"))).drop("_lo", "_hi")
    place = F.dense_rank().over(Window.partitionBy("qid").orderBy(F.col("dst_t").desc(), F.col("dst"), F.col("relation_type")))
    best = met.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")
    best = best.select(*[F.col(c).alias(f"_{c}") for c in ways], "dst", "dst_t")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ways]
    return cores.join(best, same).select("qid", "core", "core_t", "relation_type", "dst", "dst_t")


def _offers_of_two(steps: DataFrame, ending: DataFrame, spare: int) -> DataFrame:
    """(node, dst, dst_t, _low, _high): events two steps from the nodes that ``steps`` start from, with the lowest and highest edge of the first step.

    A second step back along the first leads to the node itself, which it is no event of its own to; a second step along the edge that led to
    the node leads to the core or the node. So only the first step has to differ from the edge used before.
    """
    steps = steps.select(F.col("src").alias("node"), F.col("dst").alias("_via"), "_edge")
    via = _offers(ending, steps.select(F.col("_via").alias("src")).distinct(), spare).withColumnRenamed("src", "_via")
    met = steps.join(via, "_via").where("dst <> node").groupBy("node", "dst", "dst_t").agg(F.min("_edge").alias("_low"), F.max("_edge").alias("_high"))
    met = best_rows(met, ["node", "dst_t"], [F.col("dst")], 2 * spare)
    met = best_rows(met, ["node"], [F.col("dst_t").desc(), F.col("dst")], 5 * spare)
    by_time = F.dense_rank().over(Window.partitionBy("node").orderBy(F.col("dst_t").desc()))
    return met.withColumn("_time", by_time).where(F.col("_time") <= 2 * (spare + 1)).drop("_time")


def node_by_id(nodes: DataFrame, node_id: str) -> DataFrame:
    """One node."""
    return nodes.where(F.col("id") == node_id)


def clusters(nodes: DataFrame) -> DataFrame:
    """All clusters in order of their number."""
    return nodes.where(F.col("label") == "Cluster").orderBy("id")


def cluster_events(members: DataFrame, events: DataFrame, asof: float | None = None, by: Sequence[str] = ("cluster_id",)) -> DataFrame:
    """Events of clusters, newest first, on request only up to a time."""
    rows = members.join(events, "event_id")
    rows = rows if asof is None else rows.where(F.col("t_sec") <= asof)
    return rows.orderBy(*by, F.col("t_sec").desc(), F.col("event_id").desc())


def events_with_vectors(events: DataFrame, vecs: DataFrame, participant: object | None = None) -> DataFrame:
    """Events that have a vector, in time order, on request of one participant."""
    rows = events if participant is None else events.where(F.col("participant") == participant)
    return rows.join(vecs, "event_id").orderBy("t_sec", "event_id")
