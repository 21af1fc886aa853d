"""Aggregations and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifethread.functions import vectors
from lifethread.operators import metrics, similarity
from lifethread.plans import pipelines
from lifethread.plans.bindings import Tables
from lifethread.plans.catalog.joins import CENTRE_SQL
from lifethread.plans.catalog.registry import query, r6


def scored(t: Tables) -> DataFrame:
    return similarity.score_trials(t.trial, t.vectors, t.vectors).withColumn("score", F.round("score", 9))


@query("A2_cluster_profile", """
    WITH a AS (SELECT v.event_id, CASE WHEN v.label = 0 THEN -1 ELSE v.label END AS label, e.t_sec, e.clip_ts FROM m_vec v JOIN m_event e ON e.event_id = v.event_id)
    SELECT label, count(*) AS event_count, concat(first(clip_ts ORDER BY t_sec, clip_ts), ' - ', last(clip_ts ORDER BY t_sec, clip_ts)) AS time_span,
      (SELECT count(*) FROM a) AS total_events, (SELECT count(*) FROM a WHERE label = -1) AS noise_events FROM a WHERE label <> -1 GROUP BY label""")
def _(t: Tables) -> DataFrame:
    assigned = t.vec.select("event_id", F.when(F.col("label") == 0, -1).otherwise(F.col("label")).alias("label")).join(
        t.event.select("event_id", "t_sec", F.col("clip_ts").alias("timestamp")), "event_id"
    )
    return metrics.cluster_profile(assigned)


@query("A3_vec_mean", f"WITH {CENTRE_SQL} SELECT label, CAST(i - 1 AS INT) AS pos, round(m, 6) AS x FROM means")
def _(t: Tables) -> DataFrame:
    return vectors.vec_mean(t.vectors, ["label"]).select("label", F.posexplode("vec").alias("pos", "x")).withColumn("x", r6("x"))


MEDOID_SQL = f"""{CENTRE_SQL},
    near AS (SELECT v.label, v.vec_id, round(1.0 - list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), c.c), 9) AS d FROM embeddings v JOIN centre c ON c.label = v.label),
    med AS (SELECT label, first(vec_id ORDER BY d, vec_id) AS id, min(d) AS d FROM near GROUP BY 1)"""


@query("A4_medoid", f"WITH {MEDOID_SQL} SELECT label, id, round(d, 6) AS distance FROM med")
def _(t: Tables) -> DataFrame:
    return vectors.medoid(t.vectors, ["label"], "id").select("label", "id", r6("distance").alias("distance"))


@query("A5_recall_report", """
    WITH r AS (SELECT event_type AS type, CAST(k % 2 = 0 AS VARCHAR) AS need_name, CAST(k % 3 = 0 AS VARCHAR) AS need_audio, value > 20 AS hit, value > 40 AS core_hit, value > 20 AND value <= 60 AS expanded_hit, round(value * 7, 2) AS d FROM m_event WHERE k % 10 <> 9),
    g AS (SELECT 'type' AS dimension, type AS value, * FROM r UNION ALL SELECT 'need_name', need_name, * FROM r UNION ALL SELECT 'need_audio', need_audio, * FROM r UNION ALL SELECT 'overall', NULL, * FROM r),
    a AS (SELECT dimension, value, count(*) AS evaluated, CASE WHEN dimension = 'overall' THEN (SELECT count(*) FROM m_event) ELSE count(*) END AS questions, count_if(hit) AS hits, count_if(core_hit) AS core_hits, count_if(expanded_hit) AS expanded_hits, avg(d) FILTER (hit) AS t FROM g GROUP BY 1, 2)
    SELECT dimension, value, CAST(questions AS BIGINT) AS questions, evaluated, CAST(hits AS BIGINT) AS hits, CAST(core_hits AS BIGINT) AS core_hits, CAST(expanded_hits AS BIGINT) AS expanded_hits, round(100.0 * hits / questions, 4) AS recall,
      round(100.0 * core_hits / questions, 4) AS core_recall, round(100.0 * expanded_hits / questions, 4) AS expanded_recall, round(t, 4) AS avg_time_diff FROM a""")
def _(t: Tables) -> DataFrame:
    v = F.col("value")
    results = t.event.where("k % 10 <> 9").select(
        F.col("event_type").alias("type"), (F.col("k") % 2 == 0).alias("need_name"), (F.col("k") % 3 == 0).alias("need_audio"), (v > 20).alias("hit"),
        (v > 40).alias("core_hit"), ((v > 20) & (v <= 60)).alias("expanded_hit"), F.round(v * 7, 2).alias("closest_time_diff"),
    )
    got = metrics.recall_report(results, t.event)
    return got.withColumns({c: F.round(c, 4) for c in ("recall", "core_recall", "expanded_recall", "avg_time_diff")})


@query("A9_judgment_summary", """
    SELECT participant, count(*) AS total_judgments, CAST(count_if(type IN ('causal', 'causal_same_strong')) AS BIGINT) AS causal, CAST(count_if(type = 'same_activity_non_causal') AS BIGINT) AS same_activity_non_causal,
      CAST(count_if(type = 'no_relationship') AS BIGINT) AS no_relationship FROM m_rel GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return metrics.judgment_summary(t.rel, ["participant"])


_CURVE = """
    curve AS (SELECT id, score, row_number() OVER w AS pos, sum(CASE WHEN target = 1 THEN 1.0::DOUBLE ELSE 0 END) OVER w / (SELECT count(*) FROM sc WHERE target = 1) AS fnr,
      1 - sum(CASE WHEN target = 0 THEN 1.0::DOUBLE ELSE 0 END) OVER w / (SELECT count(*) FROM sc WHERE target = 0) AS fpr FROM sc WINDOW w AS (ORDER BY score, id ROWS UNBOUNDED PRECEDING))
"""


@query("A12_det_curve", f"WITH sc AS (SELECT * FROM m_score), {_CURVE} SELECT id, pos, score, round(fnr, 6) AS fnr, round(fpr, 6) AS fpr FROM curve")
def _(t: Tables) -> DataFrame:
    return metrics.det_curve(t.score).select("id", "pos", "score", r6("fnr").alias("fnr"), r6("fpr").alias("fpr"))


_WEIGHTS = """
    s AS (SELECT source, count_if(target = 1) AS t, count_if(target <> 1) AS i FROM m_score GROUP BY 1),
    w AS (SELECT m.id, m.score, m.target, m.source, CASE WHEN m.target = 1 THEN (SELECT max(t) FROM s) / s.t ELSE (SELECT max(i) FROM s) / s.i END AS weight FROM m_score m JOIN s ON s.source = m.source)
"""


@query("A12_det_curve_weighted", f"""
    WITH {_WEIGHTS} SELECT id, row_number() OVER o AS pos, round(sum(CASE WHEN target = 1 THEN weight ELSE 0 END) OVER o / (SELECT sum(weight) FROM w WHERE target = 1), 6) AS fnr FROM w WINDOW o AS (ORDER BY score, id ROWS UNBOUNDED PRECEDING)""")
def _(t: Tables) -> DataFrame:
    return metrics.det_curve(metrics.equalize_weights(t.score, "source"), weight="weight").select("id", "pos", r6("fnr").alias("fnr"))


@query("A13_det_curve_binned", """
    WITH b AS (SELECT min(score) AS lo, max(score) AS hi FROM m_score),
    c AS (SELECT CAST(least(floor((score - lo) / (hi - lo) * 100), 99) AS BIGINT) AS bin, target FROM m_score, b),
    g AS (SELECT bin, CAST(count_if(target = 1) AS DOUBLE) AS t, CAST(count_if(target = 0) AS DOUBLE) AS i FROM c GROUP BY 1)
    SELECT bin, round(sum(t) OVER o / (SELECT sum(t) FROM g), 6) AS fnr, round(1 - sum(i) OVER o / (SELECT sum(i) FROM g), 6) AS fpr FROM g WINDOW o AS (ORDER BY bin ROWS UNBOUNDED PRECEDING)""")
def _(t: Tables) -> DataFrame:
    return metrics.det_curve_binned(t.score, bins=100).select("bin", r6("fnr").alias("fnr"), r6("fpr").alias("fpr"))


_EER = """
    x1 AS (SELECT * FROM curve WHERE fnr - fpr >= 0 ORDER BY pos LIMIT 1), x2 AS (SELECT * FROM curve WHERE fnr - fpr < 0 ORDER BY pos DESC LIMIT 1),
    eer AS (SELECT x1.fnr + (x1.fnr - x1.fpr) / (x2.fpr - x1.fpr - (x2.fnr - x1.fnr)) * (x2.fnr - x1.fnr) AS eer, x1.score AS threshold FROM x1, x2)
"""


@query("A14_eer", f"WITH sc AS (SELECT * FROM m_score), {_CURVE}, {_EER} SELECT round(eer, 6) AS eer, threshold FROM eer")
def _(t: Tables) -> DataFrame:
    return metrics.eer(metrics.det_curve(t.score)).select(r6("eer").alias("eer"), "threshold")


@query("A15_min_dcf", f"""
    WITH sc AS (SELECT * FROM m_score), {_CURVE} SELECT round(min(0.1 * fnr + 0.9 * fpr), 6) AS min_dcf, round(min(0.1 * fnr + 0.9 * fpr) / 0.1, 6) AS norm_min_dcf FROM curve""")
def _(t: Tables) -> DataFrame:
    return metrics.min_dcf(metrics.det_curve(t.score), p_target=0.1).select(r6("min_dcf").alias("min_dcf"), r6("norm_min_dcf").alias("norm_min_dcf"))


@query("A16_equalize_weights", f"WITH {_WEIGHTS} SELECT id, source, target, round(weight, 6) AS weight FROM w")
def _(t: Tables) -> DataFrame:
    return metrics.equalize_weights(t.score, "source").select("id", "source", "target", r6("weight").alias("weight"))


@query("A17_average_precision", """
    WITH r AS (SELECT target, row_number() OVER w AS n, sum(target) OVER w AS tp FROM m_score WINDOW w AS (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING)),
    e AS (SELECT target, max(tp / n) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM r)
    SELECT round(sum(env) FILTER (target = 1) / count_if(target = 1), 6) AS average_precision, CAST(count_if(target = 1) AS BIGINT) AS targets FROM e""")
def _(t: Tables) -> DataFrame:
    return metrics.average_precision(t.score).select(r6("average_precision").alias("average_precision"), "targets")


@query("A18_top1_accuracy", "SELECT round(100.0 * avg(CASE WHEN list_position(embedding, list_max(embedding)) - 1 = label THEN 1.0 ELSE 0 END), 6) AS accuracy, count(*) AS rows FROM embeddings")
def _(t: Tables) -> DataFrame:
    return metrics.top1_accuracy(t.vectors, "vec", "label").select(r6("accuracy").alias("accuracy"), "rows")


@query("A19_run_stats", "SELECT event_type AS step, count(*) AS runs, round(avg(value), 6) AS avg_seconds, round(sum(value), 4) AS total_seconds FROM m_event GROUP BY 1")
def _(t: Tables) -> DataFrame:
    got = metrics.run_stats(t.event, "event_type", "value")
    return got.select(F.col("event_type").alias("step"), "runs", r6("avg_seconds").alias("avg_seconds"), F.round("total_seconds", 4).alias("total_seconds"))


@query("A20_track_stats", """
    WITH o AS (SELECT event_id, candidate AS object_name, count(*) AS num_frames FROM m_box GROUP BY 1, 2) SELECT event_id, object_name, num_frames, count(*) OVER (PARTITION BY event_id) AS num_objects FROM o""")
def _(t: Tables) -> DataFrame:
    return metrics.track_stats(t.box.select("event_id", F.col("candidate").alias("object_name")))


@query("R11_verify", f"""
    WITH sc AS (SELECT (enrol, test) AS id, score, target FROM m_scored), {_CURVE}, {_EER},
    cost AS (SELECT min(0.01 * fnr + 0.99 * fpr) AS c FROM curve)
    SELECT round(eer, 6) AS eer, round(threshold, 6) AS threshold, round(c, 6) AS min_dcf, round(c / 0.01, 6) AS norm_min_dcf FROM eer, cost""")
def _(t: Tables) -> DataFrame:
    got = pipelines.verify(t.trial, t.vectors, t.vectors)
    return got.select(*[r6(c).alias(c) for c in ("eer", "threshold", "min_dcf", "norm_min_dcf")])
