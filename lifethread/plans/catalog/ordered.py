"""Windows, runs and top-n."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifethread.operators import history, intervals, ordered
from lifethread.plans.bindings import Tables
from lifethread.plans.catalog.registry import query, r6
from lifethread.plans.catalog.scalar import HISTORY_SQL


def _events(t: Tables) -> DataFrame:
    return t.event.select("participant", "day", "event_id", "t_sec")


@query("W1_history", f"WITH {HISTORY_SQL} SELECT event_id, past_pos, past_event_id, round(past_t_sec, 2) AS past_t FROM h5")
def _(t: Tables) -> DataFrame:
    return history.history(_events(t)).select("event_id", "past_pos", "past_event_id", F.round("past_t_sec", 2).alias("past_t"))


@query("W2_temporal_edges", f"""
    WITH {HISTORY_SQL}, r AS (SELECT *, round(t_sec - past_t_sec, 6) AS gap FROM h5)
    SELECT r.event_id, past_event_id AS related_event_id, 'temporal_after' AS type, gap AS time_diff_seconds,
      concat(strftime(p.ts, '%Y-%m-%d %H:%M:%S'), '.', right(p.clip_ts, 2), ' -> ', strftime(e.ts, '%Y-%m-%d %H:%M:%S'), '.', right(e.clip_ts, 2)) AS reason
    FROM r JOIN m_event e ON e.event_id = r.event_id JOIN m_event p ON p.event_id = r.past_event_id WHERE gap > 0 AND gap <= 3600""")
def _(t: Tables) -> DataFrame:
    got = history.with_reason(history.temporal_edges(_events(t), max_s=3600.0))
    return got.select("event_id", "related_event_id", "type", "time_diff_seconds", "reason")


@query("W3_number_rows", "SELECT event_id, row_number() OVER (ORDER BY t_sec, event_id) AS meta_id FROM m_event")
def _(t: Tables) -> DataFrame:
    return ordered.number_rows(t.event.select("event_id", "t_sec"), ["t_sec", "event_id"]).select("event_id", "meta_id")


def _mentions(t: Tables) -> DataFrame:
    return t.object.join(t.event.select("event_id", "t_sec"), "event_id").select("global_name", "event_id", "pos", "t_sec")


_RANKED = """SELECT o.global_name, o.event_id, o.pos, row_number() OVER (PARTITION BY o.global_name ORDER BY e.t_sec {way}, o.event_id {way}, o.pos {way}) AS rn
      FROM m_object o JOIN m_event e ON e.event_id = o.event_id"""


@query("W4_last_n", f"SELECT global_name, event_id, pos FROM ({_RANKED.format(way='DESC')}) WHERE rn <= 5")
def _(t: Tables) -> DataFrame:
    return history.last_n(_mentions(t), 5, ["global_name"], ["t_sec", "event_id", "pos"]).drop("t_sec")


@query("W5_first_k", f"SELECT global_name, event_id, pos FROM ({_RANKED.format(way='ASC')}) WHERE rn <= 10")
def _(t: Tables) -> DataFrame:
    return history.first_k(_mentions(t), 10, ["global_name"], ["t_sec", "event_id", "pos"]).drop("t_sec")


@query("W6_prune_history", """
    WITH h AS (SELECT participant AS voice_id, event_id AS pos, value / 10.0 AS duration, k / 100.0 AS match_score, count(*) OVER (PARTITION BY participant) AS n FROM m_event),
    b AS (SELECT *, row_number() OVER (PARTITION BY voice_id ORDER BY match_score DESC, pos) AS rn FROM h WHERE n > 20 AND duration >= 1.5 AND match_score >= 0.5)
    SELECT voice_id, pos FROM h WHERE n <= 20 UNION ALL SELECT voice_id, pos FROM b WHERE rn <= 20""")
def _(t: Tables) -> DataFrame:
    rows = t.event.select(
        F.col("participant").alias("voice_id"), F.col("event_id").alias("pos"), (F.col("value") / F.lit(10.0)).alias("duration"), (F.col("k") / F.lit(100.0)).alias("match_score")
    )
    return history.prune_history(rows).select("voice_id", "pos")


@query("W7_merge_segments", """
    WITH s AS (SELECT *, lag("end") OVER w AS pe, lag(label) OVER w AS pl FROM m_turn WINDOW w AS (PARTITION BY recording_id ORDER BY start, "end")),
    c AS (SELECT *, CASE WHEN label <> pl AND start < pe THEN (start + pe) / 2 END AS cut, CASE WHEN pe IS NULL OR label <> pl OR start > pe THEN 1 ELSE 0 END AS new FROM s),
    i AS (SELECT *, sum(new) OVER (PARTITION BY recording_id ORDER BY start, "end") AS island FROM c),
    g AS (SELECT recording_id, island, first(coalesce(cut, start) ORDER BY start, "end") AS start, last("end" ORDER BY start, "end") AS e, first(label) AS label, first(cut ORDER BY start, "end") AS cut FROM i GROUP BY 1, 2),
    n AS (SELECT *, lead(cut) OVER (PARTITION BY recording_id ORDER BY island) AS next_cut FROM g)
    SELECT recording_id, round(start, 6) AS start, round(coalesce(next_cut, e), 6) AS "end", label FROM n""")
def _(t: Tables) -> DataFrame:
    got = intervals.merge_segments(t.turn)
    return got.select("recording_id", r6("start").alias("start"), r6("end").alias("end"), "label")


@query("W8_union_intervals", """
    WITH u AS (SELECT recording_id, start, "end" FROM m_turn WHERE label <> 'none' UNION ALL SELECT recording_id, start, "end" FROM m_face),
    r AS (SELECT *, max("end") OVER (PARTITION BY recording_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM u),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR reach < start THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM r)
    SELECT recording_id, round(min(start), 6) AS start, round(max("end"), 6) AS "end" FROM i GROUP BY recording_id, island""")
def _(t: Tables) -> DataFrame:
    got = intervals.union_intervals(t.turn.where("label <> 'none'"), t.face)
    return got.select("recording_id", r6("start").alias("start"), r6("end").alias("end"))


_RUNS = """
    st AS (SELECT *, coalesce(lag(is_on) OVER (PARTITION BY r ORDER BY t), false) AS was FROM fr),
    ed AS (SELECT r, t, is_on AND NOT was AS o, was AND NOT is_on AS c, sum(CASE WHEN is_on AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY t ROWS UNBOUNDED PRECEDING) AS island FROM st)
"""


@query("W9_active_runs", f"""
    WITH fr AS (SELECT participant AS r, t_sec AS t, k % 3 <> 0 AND t_sec < max(t_sec) OVER (PARTITION BY participant) AS is_on FROM m_event), {_RUNS}
    SELECT r AS participant, round(min(t) FILTER (o), 2) AS start, round(max(t) FILTER (c), 2) AS "end" FROM ed WHERE o OR c GROUP BY r, island""")
def _(t: Tables) -> DataFrame:
    frames = t.event.select("participant", F.col("t_sec").alias("t"), (F.col("k") % 3).alias("active_count"))
    got = intervals.active_runs(frames, ["participant"])
    return got.select("participant", F.round("start", 2).alias("start"), F.round("end", 2).alias("end"))


@query("W10_score_runs", f"""
    WITH f0 AS (SELECT participant AS r, t_sec AS t, CASE WHEN k % 11 / 10.0 > 0.5 THEN 1 WHEN k % 11 / 10.0 < 0.5 THEN 0 END AS says FROM m_event),
    fr AS (SELECT r, t, coalesce(last_value(says IGNORE NULLS) OVER (PARTITION BY r ORDER BY t ROWS UNBOUNDED PRECEDING), 0) = 1 AS is_on FROM f0), {_RUNS}
    SELECT r AS participant, round(min(t) FILTER (o), 3) AS start, round(coalesce(min(t) FILTER (c), max(t)), 3) AS "end" FROM ed WHERE island > 0 GROUP BY r, island""")
def _(t: Tables) -> DataFrame:
    frames = t.event.select("participant", F.col("t_sec").alias("t"), (F.col("k") % 11 / F.lit(10.0)).alias("score"))
    return intervals.score_runs(frames, keys=["participant"])


@query("W11_label_runs", """
    WITH s AS (SELECT participant, t_sec, event_type, lag(t_sec) OVER w AS pt, lag(event_type) OVER w AS pl FROM m_event WINDOW w AS (PARTITION BY participant ORDER BY t_sec)),
    i AS (SELECT *, sum(CASE WHEN pt IS NULL OR pl <> event_type OR t_sec - pt > 50000 THEN 1 ELSE 0 END) OVER (PARTITION BY participant ORDER BY t_sec ROWS UNBOUNDED PRECEDING) AS island FROM s),
    g AS (SELECT participant, island, min(t_sec) AS a, max(t_sec) AS b, min(event_type) AS label FROM i GROUP BY 1, 2),
    l AS (SELECT *, max(island) OVER (PARTITION BY participant) AS last FROM g)
    SELECT participant, round(a, 2) AS start, round(b, 2) AS "end", label FROM l WHERE b - a >= 0.0001 OR island = last""")
def _(t: Tables) -> DataFrame:
    frames = t.event.select("participant", F.col("t_sec").alias("t"), F.col("event_type").alias("label"))
    got = intervals.label_runs(frames, keys=["participant"], gap=50000.0)
    return got.select("participant", F.round("start", 2).alias("start"), F.round("end", 2).alias("end"), "label")


@query("W12_collapse_runs", """
    WITH s AS (SELECT *, lag("end") OVER (PARTITION BY recording_id, label ORDER BY start, "end") AS pe FROM (SELECT recording_id, label, start, "end" + 12.0 AS "end" FROM m_face)),
    i AS (SELECT *, sum(CASE WHEN pe IS NULL OR pe < start THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id, label ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM s)
    SELECT recording_id, label, round(min(start), 6) AS start, round(last("end" ORDER BY start, "end"), 6) AS "end" FROM i GROUP BY recording_id, label, island""")
def _(t: Tables) -> DataFrame:
    got = intervals.collapse_runs(t.face.withColumn("end", F.col("end") + 12.0))
    return got.select("recording_id", "label", r6("start").alias("start"), r6("end").alias("end"))


@query("W13_relabel", """
    WITH f AS (SELECT recording_id, label, row_number() OVER (PARTITION BY recording_id ORDER BY min(pos), label) - 1 AS new_label FROM m_turn GROUP BY recording_id, label)
    SELECT t.recording_id, t.pos, t.label, f.new_label FROM m_turn t JOIN f ON f.recording_id = t.recording_id AND f.label = t.label""")
def _(t: Tables) -> DataFrame:
    return intervals.relabel(t.turn, order=("pos",)).select("recording_id", "pos", "label", "new_label")


@query("W14_chunk_intervals", """
    WITH n AS (SELECT *, CAST(ceil(("end" - start + (0.75 - 1.5)) / 0.75) AS BIGINT) AS n FROM m_turn),
    c AS (SELECT *, unnest(range(n)) AS chunk FROM n WHERE n > 0)
    SELECT recording_id, pos, chunk, round(start + chunk * 0.75, 6) AS chunk_start, round(least(start + chunk * 0.75 + 1.5, "end"), 6) AS chunk_end FROM c""")
def _(t: Tables) -> DataFrame:
    got = intervals.chunk_intervals(t.turn)
    return got.select("recording_id", "pos", "chunk", r6("chunk_start").alias("chunk_start"), r6("chunk_end").alias("chunk_end"))


def _placed(t: Tables) -> DataFrame:
    rows = ordered.OrderedScan(t.event.select("participant", "event_id", "t_sec"), ["participant"], ["t_sec", "event_id"]).position("p").result()
    return rows.select("participant", "event_id", (F.col("p") - 1).alias("pos"))


@query("W15_sample_uniform", """
    WITH p AS (SELECT participant, event_id, row_number() OVER (PARTITION BY participant ORDER BY t_sec, event_id) - 1 AS pos, count(*) OVER (PARTITION BY participant) AS n FROM m_event),
    s AS (SELECT *, greatest(1, n // 5) AS step FROM p) SELECT participant, event_id, pos FROM s WHERE pos % step = 0 AND pos // step < 5""")
def _(t: Tables) -> DataFrame:
    return history.sample_uniform(_placed(t), 5, ["participant"]).select("participant", "event_id", "pos")


@query("W16_best_detection", """
    WITH d AS (SELECT participant, day, event_id, value - 5.0 AS score, row_number() OVER (PARTITION BY participant, day ORDER BY value DESC, event_id) AS rn FROM m_event WHERE value - 5.0 > 0)
    SELECT participant, day, event_id AS frame, round(score, 6) AS score FROM d WHERE rn = 1""")
def _(t: Tables) -> DataFrame:
    rows = t.event.select("participant", "day", F.col("event_id").alias("frame"), (F.col("value") - 5.0).alias("score"))
    return history.best_detection(rows, ["participant", "day"]).withColumn("score", r6("score"))


@query("W17_topk_crops", """
    WITH d AS (SELECT participant, day, k AS t, value AS score, event_id, false AS from_tracking FROM m_event WHERE event_type IN ('click', 'view')),
    f AS (SELECT participant, day, k AS t, value AS score, event_id, true AS from_tracking FROM m_event WHERE event_type NOT IN ('click', 'view')),
    u AS (SELECT * FROM d UNION ALL SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.participant = f.participant AND d.day = f.day AND d.t = f.t)),
    r AS (SELECT *, row_number() OVER (PARTITION BY participant, day ORDER BY from_tracking, score DESC, t, event_id) AS crop_rank FROM u)
    SELECT participant, day, t, event_id, from_tracking, crop_rank FROM r WHERE crop_rank <= 3""")
def _(t: Tables) -> DataFrame:
    rows = t.event.select("participant", "day", F.col("k").alias("t"), F.col("value").alias("score"), "event_id", "event_type")
    got = history.topk_crops(
        rows.where("event_type IN ('click', 'view')"), rows.where("event_type NOT IN ('click', 'view')"), keys=["participant", "day"], order=["event_id"]
    )
    return got.select("participant", "day", "t", "event_id", "from_tracking", "crop_rank")


@query("W18_frames_in_segment", """
    SELECT s.event_id AS segment_id, f.event_id FROM m_event f JOIN m_event s ON s.participant = f.participant AND s.event_type = 'purchase' AND f.t_sec BETWEEN s.t_sec AND s.t_sec + 7200""")
def _(t: Tables) -> DataFrame:
    frames = t.event.select("participant", "event_id", F.col("t_sec").alias("t"))
    segments = t.event.where("event_type = 'purchase'").select(
        "participant", F.col("event_id").alias("segment_id"), F.col("t_sec").alias("start"), (F.col("t_sec") + 7200).alias("end")
    )
    return intervals.frames_in_segment(frames, segments, ["participant"], width=3600.0).select("segment_id", "event_id")


@query("T4_latest", """
    WITH r AS (SELECT participant, event_id, row_number() OVER (PARTITION BY participant ORDER BY t_sec DESC, event_id DESC) AS a, row_number() OVER (ORDER BY t_sec DESC, event_id DESC) AS b FROM m_event)
    SELECT participant, event_id, 'each' AS kind FROM r WHERE a <= 5 UNION ALL SELECT participant, event_id, 'all' FROM r WHERE b <= 20""")
def _(t: Tables) -> DataFrame:
    rows = t.event.select("participant", "event_id", "t_sec")
    each, top = history.latest(rows, 5, ["t_sec", "event_id"], ["participant"]), history.latest(rows, 20, ["t_sec", "event_id"])
    return each.select("participant", "event_id", F.lit("each").alias("kind")).unionByName(top.select("participant", "event_id", F.lit("all").alias("kind")))


@query("T5_cap_per_query", """
    WITH r AS (SELECT o.global_name AS qid, o.event_id, row_number() OVER (PARTITION BY o.global_name ORDER BY e.t_sec DESC, e.event_id DESC) AS rn
      FROM (SELECT DISTINCT global_name, event_id FROM m_object) o JOIN m_event e ON e.event_id = o.event_id WHERE e.t_sec <= 1500000) SELECT qid, event_id FROM r WHERE rn <= 10""")
def _(t: Tables) -> DataFrame:
    hits = t.object.select(F.col("global_name").alias("qid"), "event_id").distinct().join(t.event.select("event_id", "t_sec"), "event_id")
    return history.cap_per_query(hits.where("t_sec <= 1500000"), 10).select("qid", "event_id")


@query("J9_asof_last", """
    WITH q AS (SELECT event_id AS qid, participant, t_sec AS query_t FROM m_event WHERE event_type = 'error'),
    r AS (SELECT q.qid, q.participant, e.event_id, row_number() OVER (PARTITION BY q.qid ORDER BY e.t_sec DESC, e.event_id DESC) AS rn FROM q JOIN m_event e ON e.participant = q.participant AND e.t_sec <= q.query_t)
    SELECT qid, participant, event_id FROM r WHERE rn <= 3""")
def _(t: Tables) -> DataFrame:
    probes = t.event.where("event_type = 'error'").select("participant", F.col("event_id").alias("qid"), F.col("t_sec").alias("query_t"))
    return history.asof_last(probes, t.event.select("participant", "event_id", "t_sec"), ["participant"], 3).select("qid", "participant", "event_id")
