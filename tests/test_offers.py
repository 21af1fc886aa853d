"""Graph expansion: a node's offers are cut before they move, with the rows of a walk over all pairs."""

from __future__ import annotations

import random

from lifethread.operators import graph


def made(spark):
    r = random.Random(4)
    times = {f"e{k}": float(r.randrange(12)) for k in range(60)} | {"e60": None}
    edges = sorted({(f"e{r.randrange(61)}", f"n{r.randrange(6)}", r.choice("AB")) for _ in range(220)} | {(f"e{k}", f"e{k + 1}", "NEXT") for k in range(0, 59, 3)})
    core = [(k % 4, f"e{k}") for k in range(0, 61, 2)]
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    return times, edges, core, frame(core, "qid int, event_id string"), frame([*times.items()], "event_id string, t_sec double"), frame(edges, "src string, dst string, type string")


def walked(times, edges, core, limit):
    steps = {}
    for n, (a, b, kind) in enumerate(edges):
        steps.setdefault(a, []).append((b, kind, n))
        steps.setdefault(b, []).append((a, kind, n))
    out = set()
    for q, c in core:
        seen = set()
        for n, kind, e in steps.get(c, []):
            seen |= {(n, kind)} | {(m, kind) for m, _, f in steps[n] if f != e}
        rows = sorted((-times[m], m, kind) for m, kind in seen if times.get(m) is not None and times[c] is not None and times[m] != times[c])
        out |= {(q, c, m, kind, -t, k + 1) for k, (t, m, kind) in enumerate(rows[:limit])}
    return out


def test_two_hops_are_those_of_a_walk(spark):
    times, edges, core, core_df, events, edge_df = made(spark)
    for limit in (1, 3, 7):
        got = graph.expand(core_df, events, edge_df, hops=2, limit=limit).select("qid", "core", "neighbour", "relation_type", "t_sec", "rank").collect()
        assert {tuple(r) for r in got} == walked(times, edges, core, limit) and len(got) == len(set(got))


def test_rows_of_a_core_move_once(spark):
    *_, core, events, edges = made(spark)
    plan = graph.expand(core, events, edges, hops=2, limit=3)._jdf.queryExecution().toString()
    moves = [x for x in plan.split("== Physical Plan ==")[1].splitlines() if "Exchange hashpartitioning(qid" in x and "neighbour" in x]
    assert not moves
