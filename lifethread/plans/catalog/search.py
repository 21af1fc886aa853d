"""Vector search, matching, clustering parts and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifethread.functions import boxes, vectors
from lifethread.operators import clustering, history, ordered, similarity, vector_index
from lifethread.plans import embedding, pipelines, retrieval
from lifethread.plans.bindings import Tables
from lifethread.plans.catalog.groups import MEDOID_SQL, scored
from lifethread.plans.catalog.registry import query, r6
from lifethread.plans.catalog.scalar import HISTORY_SQL, IOU_SQL
from lifethread.runtime import scratch_path


_TOPK = """
    WITH s AS (SELECT a.event_id AS qid, b.event_id AS id, round(list_cosine_similarity(a.vec, b.vec), 9) AS sim FROM m_vec a JOIN m_vec b ON true),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rank FROM s WHERE sim >= 0) SELECT qid, id, rank, round(sim, 6) AS sim FROM r WHERE rank <= 6"""


@query("T1_cosine_topk", _TOPK)
def _(t: Tables) -> DataFrame:
    corpus = t.vec.select(F.col("event_id").alias("id"), "vec")
    got = similarity.cosine_topk(corpus.withColumnRenamed("id", "qid"), corpus, 6, 0.0)
    return got.select("qid", "id", "rank", r6("sim").alias("sim"))


@query("T1_index_topk", _TOPK)
def _(t: Tables) -> DataFrame:
    """The same rows through a stored inverted file: eight cells first, then those that could still hold a better row."""
    corpus = t.vec.select(F.col("event_id").alias("id"), "vec")
    index = vector_index.build_index(corpus, scratch_path(t.spark, "index"))
    got = vector_index.index_topk(corpus.withColumnRenamed("id", "qid"), index, 6, 0.0, probes=8, exact=True)
    return got.select("qid", "id", "rank", r6("sim").alias("sim"))


@query("T1_cosine_topk_asof", """
    WITH v AS (SELECT v.*, e.t_sec FROM m_vec v JOIN m_event e ON e.event_id = v.event_id),
    s AS (SELECT a.event_id AS qid, b.event_id AS id, round(list_cosine_similarity(a.vec, b.vec), 9) AS sim FROM v a JOIN v b ON b.t_sec <= a.t_sec),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rank FROM s WHERE qid <> id) SELECT qid, id, rank, round(sim, 6) AS sim FROM r WHERE rank <= 4""")
def _(t: Tables) -> DataFrame:
    timed = t.vec.join(t.event.select("event_id", "t_sec"), "event_id")
    queries = timed.select(F.col("event_id").alias("qid"), "vec", F.col("t_sec").alias("query_t"))
    corpus = timed.select(F.col("event_id").alias("id"), "vec", "t_sec")
    got = similarity.cosine_topk(queries, corpus, 4, exclude_self=True, query_t="query_t", corpus_t="t_sec")
    return got.select("qid", "id", "rank", r6("sim").alias("sim"))


@query("T2_knn_prune", """
    WITH n AS (SELECT label, CAST(count(*) - least(floor((1.0 - 0.2) * count(*)), count(*) - 6) AS INT) AS keep FROM embeddings GROUP BY 1),
    s AS (SELECT a.label, a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label),
    r AS (SELECT s.*, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS rn FROM s),
    h AS (SELECT r.label, i, j, sim / 2 AS a FROM r JOIN n ON n.label = r.label WHERE rn <= keep AND i <> j)
    SELECT label, i, j, round(sum(a), 6) AS affinity FROM (SELECT * FROM h UNION ALL SELECT label, j, i, a FROM h) GROUP BY 1, 2, 3""")
def _(t: Tables) -> DataFrame:
    return similarity.knn_prune(t.vectors, ["label"], p=0.2).withColumn("affinity", r6("affinity"))


_RECENT = """
    recent AS (SELECT entity, t_sec, pos, vec FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY t_sec DESC, pos DESC) AS rn FROM m_mention) WHERE rn <= 5)
"""


@query("T3_text_candidates", f"""
    WITH {_RECENT},
    s AS (SELECT v.event_id AS qid, r.entity, max(round(list_cosine_similarity(v.vec, r.vec), 9)) AS sim FROM m_vec v JOIN recent r ON true GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, entity) AS candidate_rank FROM s WHERE sim > 0.1) SELECT qid, entity, candidate_rank, round(sim, 6) AS text_similarity FROM k WHERE candidate_rank <= 3""")
def _(t: Tables) -> DataFrame:
    got = similarity.text_candidates(t.vec.select(F.col("event_id").alias("qid"), "vec"), t.mention, threshold=0.1)
    return got.select("qid", "entity", "candidate_rank", r6("text_similarity").alias("text_similarity"))


@query("A6_entity_text_sim", f"""
    WITH {_RECENT} SELECT v.event_id AS qid, r.entity, round(max(list_cosine_similarity(v.vec, r.vec)), 6) AS text_similarity
    FROM (SELECT DISTINCT event_id, global_name FROM m_object) o JOIN m_vec v ON v.event_id = o.event_id JOIN recent r ON r.entity = o.global_name GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    pairs = t.object.select("event_id", F.col("global_name").alias("entity")).distinct().join(t.vec.select("event_id", "vec"), "event_id")
    got = similarity.entity_text_sim(pairs.withColumnRenamed("event_id", "qid"), t.mention)
    return got.withColumn("text_similarity", r6("text_similarity"))


@query("A7_mean_positive_iou", f"WITH i AS (SELECT event_id, candidate, {IOU_SQL} AS iou FROM m_box) SELECT event_id AS qid, candidate, round(coalesce(avg(iou) FILTER (iou > 0), 0), 6) AS vision_similarity FROM i GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    made = lambda names: boxes.box(boxes.XYWH, [F.col(c) for c in names])
    frames = t.box.select(F.col("event_id").alias("qid"), "candidate", boxes.iou(made(("x", "y", "w", "h")), made(("dx", "dy", "w", "h"))).alias("max_iou"))
    return similarity.mean_positive_iou(frames).withColumn("vision_similarity", r6("vision_similarity"))


@query("A8_topk_mean", """
    WITH r AS (SELECT enrol, test_label, score, row_number() OVER (PARTITION BY enrol, test_label ORDER BY score DESC) AS rn FROM m_scored)
    SELECT enrol AS qid, test_label AS voice_id, round(avg(score), 6) AS score FROM r WHERE rn <= 3 GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    sims = scored(t).select(F.col("enrol").alias("qid"), F.col("test_label").alias("voice_id"), F.col("score").alias("sim"))
    return similarity.topk_mean(sims, 3).withColumn("score", r6("score"))


@query("C2_cluster_vector", f"""
    WITH {MEDOID_SQL} SELECT 'mean' AS method, label, CAST(i - 1 AS INT) AS pos, round(m, 6) AS x FROM means
    UNION ALL SELECT 'medoid', m.label, CAST(i - 1 AS INT), round(x, 6) FROM (SELECT med.label, unnest(CAST(v.embedding AS DOUBLE[])) AS x, generate_subscripts(v.embedding, 1) AS i FROM med JOIN embeddings v ON v.vec_id = med.id) m""")
def _(t: Tables) -> DataFrame:
    flat = lambda m: clustering.cluster_vector(t.vectors, m, id_col="id").select(
        F.lit(m).alias("method"), "label", F.posexplode(vectors.as_double(F.col("vec"))).alias("pos", "x")
    )
    return flat("mean").unionByName(flat("medoid")).withColumn("x", r6("x"))


@query("C6_absorb_minor", """
    WITH a AS (SELECT vec_id AS id, label AS rec, CAST(CASE WHEN vec_id % 17 < 3 THEN 0 ELSE vec_id % 17 END AS INT) AS c, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
    n AS (SELECT rec, c, count(*) AS n FROM a GROUP BY 1, 2),
    x AS (SELECT a.rec, a.c, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM a JOIN n ON n.rec = a.rec AND n.c = a.c WHERE n.n > 4),
    m AS (SELECT rec, c, list(m ORDER BY i) AS v FROM (SELECT rec, c, i, avg(x) AS m FROM x GROUP BY 1, 2, 3) GROUP BY 1, 2),
    s AS (SELECT a.id, first(m.c ORDER BY round(list_cosine_similarity(a.vec, m.v), 9) DESC, m.c) AS best FROM a JOIN n ON n.rec = a.rec AND n.c = a.c AND n.n <= 4 JOIN m ON m.rec = a.rec GROUP BY 1)
    SELECT a.id, a.rec, CAST(CASE WHEN a.rec NOT IN (SELECT rec FROM n WHERE n > 4) THEN 0 ELSE coalesce(s.best, a.c) END AS INT) AS label FROM a LEFT JOIN s ON s.id = a.id""")
def _(t: Tables) -> DataFrame:
    given = t.vectors.select("id", F.col("label").alias("rec"), F.when(F.col("id") % 17 < 3, 0).otherwise(F.col("id") % 17).cast("int").alias("label"), "vec")
    return clustering.absorb_minor(given, ["rec"]).select("id", "rec", "label")


@query("C7_merge_close", """
    WITH RECURSIVE src AS (SELECT label AS rec, vec_id AS id, CAST(vec_id % 7 AS INT) AS label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
    sums AS (SELECT rec, label, list(s ORDER BY i) AS total FROM (SELECT rec, label, i, sum(vec[i]) AS s FROM (SELECT *, unnest(range(1, len(vec) + 1)) AS i FROM src) GROUP BY ALL) GROUP BY ALL),
    merge AS (
      SELECT rec, list({'label': label, 'now': label, 'total': total} ORDER BY label) AS cs FROM sums GROUP BY rec
      UNION ALL
      SELECT rec, list_transform(cs, lambda c: {'label': c.label, 'now': CASE WHEN c.now = best.b THEN best.a ELSE c.now END,
        'total': CASE WHEN c.now IN (best.a, best.b) THEN list_transform(list_zip(list_filter(cs, lambda d: d.now = best.a)[1].total, list_filter(cs, lambda d: d.now = best.b)[1].total), lambda z: z[1] + z[2]) ELSE c.total END})
      FROM (SELECT rec, cs, list_reverse_sort(flatten(list_transform(cs, lambda x: list_transform(list_filter(cs, lambda y: x.now < y.now),
          lambda y: {'sim': list_cosine_similarity(x.total, y.total), 'oa': -x.now, 'ob': -y.now, 'a': x.now, 'b': y.now}))))[1] AS best FROM merge)
      WHERE best.sim >= 0.85),
    done AS (SELECT rec, unnest(cs) AS c FROM (SELECT rec, arg_min(cs, list_unique(list_transform(cs, lambda c: c.now))) AS cs FROM merge GROUP BY rec))
    SELECT src.id, src.rec, done.c.now AS label FROM src JOIN done ON done.rec = src.rec AND done.c.label = src.label""")
def _(t: Tables) -> DataFrame:
    given = t.vectors.select("id", F.col("label").alias("rec"), (F.col("id") % 7).cast("int").alias("label"), "vec")
    return clustering.merge_close(given, ["rec"], 0.85).select("id", "rec", "label")


@query("C11_match_voices", f"""
    WITH h AS (SELECT label, vec, rn FROM (SELECT label, CAST(embedding AS DOUBLE[]) AS vec, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS rn FROM embeddings) WHERE rn <= 20),
    s AS (SELECT v.vec_id, h.label, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), h.vec), 9) AS sim FROM embeddings v JOIN h ON true),
    k AS (SELECT vec_id, label, round(avg(sim), 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, label ORDER BY sim DESC) AS rn FROM s) WHERE rn <= 5 GROUP BY 1, 2),
    b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS rn FROM k WHERE score >= 0.3)
    SELECT vec_id AS qid, label AS voice_no, concat('voice_', label) AS voice_id, round(score, 6) AS score FROM b WHERE rn = 1""")
def _(t: Tables) -> DataFrame:
    kept = history.last_n(t.vectors, 20, ["label"], ["id"]).select(
        F.concat(F.lit("voice_"), F.col("label").cast("string")).alias("voice_id"), F.col("label").cast("long").alias("voice_no"), "vec"
    )
    got = similarity.match_voices(t.vectors.select(F.col("id").alias("qid"), "vec"), kept, 5, 0.3)
    return got.select("qid", "voice_no", "voice_id", r6("score").alias("score"))


@query("C9_match_entities", f"""
    WITH {_RECENT}, obj AS (SELECT v.event_id AS qid, v.vec, e.k % 6 <> 5 AS has_crops FROM m_vec v JOIN m_event e ON e.event_id = v.event_id),
    s AS (SELECT o.qid, r.entity, max(round(list_cosine_similarity(o.vec, r.vec), 9)) AS sim FROM obj o JOIN recent r ON true WHERE o.has_crops GROUP BY 1, 2),
    cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, entity) AS cr FROM s WHERE sim > 0.1) WHERE cr <= 3),
    latest AS (SELECT entity, first(description ORDER BY t_sec DESC, pos DESC) AS d FROM m_mention GROUP BY 1),
    tr AS (SELECT l_orderkey AS qid, l_linenumber AS t, l_quantity AS x, l_discount * 100 AS y, 10 + l_tax * 100 AS w, CAST(12.0 AS DOUBLE) AS h, l_quantity + l_suppkey % 5 AS dx, l_discount * 100 + l_partkey % 4 AS dy,
      concat(CASE l_partkey % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'signup' WHEN 3 THEN 'error' ELSE 'purchase' END, ' ', l_suppkey % 100) AS d,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax) - 1 AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
    samp AS (SELECT * FROM tr WHERE pos % greatest(1, n // 5) = 0 AND pos // greatest(1, n // 5) < 5),
    fr AS (SELECT c.qid, c.entity, a.t, max({IOU_SQL.replace('dx', 'd.dx').replace('dy', 'd.dy').replace('x+w', 'a.x+a.w').replace('d.da.x+a.w', 'd.dx+d.w').replace('y+h', 'a.y+a.h').replace('d.da.y+a.h', 'd.dy+d.h').replace('w*h + w*h', 'a.w*a.h + d.w*d.h').replace('(x,', '(a.x,').replace('(y,', '(a.y,')}) AS iou
      FROM cand c JOIN latest l ON l.entity = c.entity JOIN samp a ON a.qid = c.qid JOIN tr d ON d.qid = a.qid AND d.t = a.t AND d.d = l.d GROUP BY 1, 2, 3),
    vis AS (SELECT qid, entity, coalesce(avg(iou) FILTER (iou > 0), 0) AS v FROM fr GROUP BY 1, 2),
    sc AS (SELECT c.*, coalesce(v.v, 0) AS v, row_number() OVER (PARTITION BY c.qid ORDER BY coalesce(v.v, 0) DESC, cr) AS br FROM cand c LEFT JOIN vis v ON v.qid = c.qid AND v.entity = c.entity)
    SELECT o.qid, CASE WHEN b.v >= 0.5 THEN b.entity END AS global_name, CASE WHEN o.has_crops THEN coalesce(b.v, 0) < 0.5 END AS is_new, CASE WHEN o.has_crops THEN round(coalesce(b.v, 0), 6) END AS final_score,
      CASE WHEN o.has_crops THEN round(coalesce(b.sim, 0), 6) END AS text_similarity, CASE WHEN NOT o.has_crops THEN 'no_crops' END AS error,
      (SELECT count(*) FROM sc WHERE sc.qid = o.qid AND NOT (sc.br = 1 AND sc.v >= 0.5)) AS lost
    FROM obj o LEFT JOIN sc b ON b.qid = o.qid AND b.br = 1 AND b.v > 0""")
def _(t: Tables) -> DataFrame:
    objects = t.vec.join(t.event.select("event_id", "k"), "event_id").select(F.col("event_id").alias("qid"), "event_id", "vec", (F.col("k") % 6 != 5).alias("has_crops"))
    lines = t.read("lineitem")
    word = F.element_at(F.array(*[F.lit(w) for w in ("click", "view", "signup", "error", "purchase")]), (F.col("l_partkey") % 5 + 1).cast("int"))
    frames = lines.select(
        F.col("l_orderkey").alias("qid"), F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("t"), "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax",
        boxes.box(boxes.XYWH, [F.col("l_quantity"), F.col("l_discount") * 100, 10 + F.col("l_tax") * 100, F.lit(12.0)]).alias("box"),
        boxes.to_xyxy(boxes.box(boxes.XYWH, [F.col("l_quantity") + F.col("l_suppkey") % 5, F.col("l_discount") * 100 + F.col("l_partkey") % 4, 10 + F.col("l_tax") * 100, F.lit(12.0)])).alias("box_xyxy"),
        F.concat(word, F.lit(" "), (F.col("l_suppkey") % 100).cast("string")).alias("desc_text"),
    )
    placed = ordered.OrderedScan(frames, ["qid"], ["t", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax"]).position("p").result()
    tracks = placed.select("qid", "event_id", (F.col("p") - 1).alias("pos"), "t", "box")
    descriptions = t.mention.withColumnRenamed("description", "text")
    found = frames.select("event_id", "t", "desc_text", "box_xyxy")
    decided, lost = similarity.match_entities(objects, descriptions, tracks, found, text_threshold=0.1)
    losers = lost.groupBy("qid").agg(F.count(F.lit(1)).alias("lost"))
    return decided.join(losers, "qid", "left").select(
        "qid", "global_name", "is_new", r6("final_score").alias("final_score"), r6("text_similarity").alias("text_similarity"), "error",
        F.coalesce("lost", F.lit(0)).alias("lost"),
    )


@query("E1_embed", """
    SELECT doc_id, 256 AS dimensions, CASE WHEN NOT regexp_matches(text, '[\\p{L}\\p{N}]') THEN 0.0::DOUBLE ELSE 1.0 END AS norm FROM documents
    UNION ALL SELECT -1 - doc_id, 256, 0.0::DOUBLE FROM documents WHERE lang = 'es'""")
def _(t: Tables) -> DataFrame:
    """All documents, and blank rows beside them."""
    docs = t.read("documents").select("doc_id", "text", "lang")
    blank = docs.where("lang = 'es'").select((-1 - F.col("doc_id")).alias("doc_id"), F.lit(" \n").alias("text"))
    got = embedding.embed(docs.select("doc_id", "text").unionByName(blank), "doc_id", "text")
    return got.select("doc_id", F.size("vec").alias("dimensions"), F.round(vectors.norm(F.col("vec")), 4).alias("norm"))


CFG = retrieval.Config()


@query("R1_retrieve_core", "SELECT qid, event_id, round(t_sec, 2) AS t_sec, round(similarity, 6) AS similarity FROM m_core")
def _(t: Tables) -> DataFrame:
    got = retrieval.retrieve_core(t.question, t.graph, CFG)
    return got.select("qid", "event_id", F.round("t_sec", 2).alias("t_sec"), r6("similarity").alias("similarity"))


@query("R2_retrieve", "SELECT qid, event_id, timestamp, is_core, round(similarity, 6) AS similarity FROM m_hits")
def _(t: Tables) -> DataFrame:
    got = retrieval.retrieve(t.question, t.graph, CFG)
    return got.select("qid", "event_id", "timestamp", "is_core", r6("similarity").alias("similarity"))


@query("R3_snippets", """
    WITH h AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY t_sec DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY qid) AS n FROM m_hits),
    names AS (SELECT t.src, string_agg(CASE WHEN n.label = 'Object' THEN t.dst END, ', ' ORDER BY t.dst) AS o, string_agg(CASE WHEN n.label = 'Person' THEN t.dst END, ', ' ORDER BY t.dst) AS p FROM m_ties t JOIN m_entity n ON n.global_name = t.dst GROUP BY 1),
    b AS (SELECT h.qid, h.rn, h.n, concat('[', h.rn, ']', chr(10), 'Event: ', h.caption, chr(10), 'Similarity: ', CASE WHEN h.similarity IS NULL THEN 'N/A (expanded)' ELSE printf('%.4f', h.similarity) END, chr(10),
      CASE WHEN q.want_object AND coalesce(n.o, '') <> '' THEN concat('Object: ', n.o, chr(10)) ELSE '' END, CASE WHEN q.want_person AND coalesce(n.p, '') <> '' THEN concat('Human: ', n.p, chr(10)) ELSE '' END, 'Timestamp: ', h.timestamp, chr(10)) AS txt
      FROM h JOIN m_question q ON q.qid = h.qid LEFT JOIN names n ON n.src = h.event_id WHERE h.rn <= 5)
    SELECT qid, concat(repeat('=', 60), chr(10), 'Relevant Memory Snippets:', chr(10), repeat('=', 60), chr(10), chr(10), string_agg(txt, chr(10) ORDER BY rn), chr(10),
      CASE WHEN max(n) > 5 THEN concat('... and ', max(n) - 5, ' more memory snippets', chr(10), chr(10)) ELSE '' END, repeat('=', 60)) AS snippet_text FROM b GROUP BY qid""")
def _(t: Tables) -> DataFrame:
    hits = retrieval.retrieve(t.question, t.graph, CFG)
    return retrieval.snippets(hits, t.question, t.graph, 5)


_EVAL = """
    tg AS (SELECT qid, query_t - 200 AS target_t FROM m_question WHERE k % 7 <> 0),
    n AS (SELECT h.qid, h.is_core, abs(floor(h.t_sec) - floor(tg.target_t)) AS d FROM m_hits h JOIN tg ON tg.qid = h.qid WHERE abs(floor(h.t_sec) - floor(tg.target_t)) <= 3600),
    b AS (SELECT qid, max(is_core) AS core_hit, max(NOT is_core) AS expanded_hit, min(d) AS d FROM n GROUP BY 1),
    c AS (SELECT qid, count_if(is_core) AS core_events, count_if(NOT is_core) AS expanded_events FROM m_hits GROUP BY 1),
    res AS (SELECT q.qid, q.event_type AS type, coalesce(core_hit, false) AS core_hit, coalesce(expanded_hit, false) AS expanded_hit, b.d AS closest_time_diff, c.core_events, c.expanded_events
      FROM m_question q JOIN tg ON tg.qid = q.qid LEFT JOIN b ON b.qid = q.qid LEFT JOIN c ON c.qid = q.qid)
"""


def _evaluate(t: Tables):
    qa = t.question.select("qid", F.col("event_type").alias("type"), (F.col("k") % 2 == 0).alias("need_name"), (F.col("k") % 3 == 0).alias("need_audio"))
    targets = t.question.where("k % 7 <> 0").select("qid", (F.col("query_t") - 200).alias("target_t"))
    return retrieval.evaluate(qa, targets, t.question, t.graph, retrieval.Config(time_window=3600.0))


@query("R4_evaluate_questions", f"""
    WITH {_EVAL} SELECT qid, type, core_hit OR expanded_hit AS hit, core_hit, expanded_hit, CAST(closest_time_diff AS BIGINT) AS closest_time_diff, CAST(core_events AS BIGINT) AS core_events, CAST(expanded_events AS BIGINT) AS expanded_events FROM res""")
def _(t: Tables) -> DataFrame:
    return _evaluate(t)[0].select("qid", "type", "hit", "core_hit", "expanded_hit", "closest_time_diff", "core_events", "expanded_events")


@query("R4_evaluate_report", f"""
    WITH {_EVAL} SELECT (SELECT count(*) FROM m_question) AS questions, count(*) AS evaluated, CAST(count_if(core_hit OR expanded_hit) AS BIGINT) AS hits, round(100.0 * count_if(core_hit OR expanded_hit) / (SELECT count(*) FROM m_question), 4) AS recall,
      round(avg(closest_time_diff) FILTER (core_hit OR expanded_hit), 4) AS avg_time_diff FROM res""")
def _(t: Tables) -> DataFrame:
    report = _evaluate(t)[1].where("dimension = 'overall'")
    return report.select("questions", "evaluated", "hits", F.round("recall", 4).alias("recall"), F.round("avg_time_diff", 4).alias("avg_time_diff"))


@query("R7_cluster_digest", """
    WITH m AS (SELECT v.label, e.clip_ts, e.caption, row_number() OVER (PARTITION BY v.label ORDER BY e.t_sec, e.event_id) AS rn, count(*) OVER (PARTITION BY v.label) AS n FROM m_vec v JOIN m_event e ON e.event_id = v.event_id)
    SELECT label, concat(string_agg(concat('- [', clip_ts, '] ', caption), chr(10) ORDER BY rn), CASE WHEN max(n) > 10 THEN concat(chr(10), '... and ', max(n) - 10, ' more similar events') ELSE '' END) AS digest,
      first(caption ORDER BY rn) AS summary FROM m WHERE rn <= 10 GROUP BY label""")
def _(t: Tables) -> DataFrame:
    members = t.vec.select("event_id", "label").join(t.event.select("event_id", "t_sec", F.col("clip_ts").alias("timestamp"), "caption"), "event_id")
    return pipelines.cluster_digest(members)


@query("R9_relation_pipeline", f"""
    WITH {HISTORY_SQL}, tm AS (SELECT h5.event_id, past_event_id, round(h5.t_sec - past_t_sec, 6) AS gap FROM h5)
    SELECT eid AS event_id, related_eid AS related_event_id, type, NULL::DOUBLE AS time_diff_seconds FROM m_rel WHERE type <> 'no_relationship'
    UNION ALL SELECT event_id, past_event_id, 'temporal_after', gap FROM tm WHERE gap > 0 AND gap <= 60""")
def _(t: Tables) -> DataFrame:
    judged = t.rel.select(F.col("eid").alias("event_id"), F.col("related_eid").alias("related_event_id"), "type", "reason")
    got, _ = pipelines.relation_pipeline(t.event.select("participant", "day", "event_id", "t_sec"), judged)
    return got.select("event_id", "related_event_id", "type", "time_diff_seconds")
