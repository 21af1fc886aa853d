"""Clustering, order-dependent folds, pipelines on them, and streams (C1, C3-C5, C8, C10, C12, C13, R5, R6, R8, R10, ST1-ST4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifethread.functions import boxes
from lifethread.operators import clustering, density, intervals, resolve
from lifethread.plans import pipelines
from lifethread.plans.bindings import Tables
from lifethread.plans.catalog.joins import speech_objects, voiced_turns
from lifethread.plans.catalog.registry import query, r6
from lifethread.plans.catalog.scalar import HISTORY_SQL
from lifethread.runtime import scratch_path
from lifethread.streaming import streams


def density_sql(src: str, least: int, samples: int) -> str:
    """Common tables that end in ``dens`` (g, id, label): density clusters of ``src`` (g, id, x), a point, a merge and a cluster at a time."""
    return f"""
    pt AS MATERIALIZED (SELECT g, id, x, row_number() OVER (PARTITION BY g ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM ({src})),
    dd AS (SELECT a.g, a.n, a.i, b.i AS j, round(1.0 - round(list_cosine_similarity(a.x, b.x), 9), 9) AS d FROM pt a JOIN pt b ON b.g = a.g),
    core AS (SELECT g, i, d AS core FROM (SELECT *, row_number() OVER (PARTITION BY g, i ORDER BY d) AS rn FROM dd WHERE i <> j) WHERE rn = {samples}),
    ww AS MATERIALIZED (SELECT d.g, d.n, d.i, list(greatest(d.d, a.core, b.core) ORDER BY d.j) AS w FROM dd d JOIN core a ON a.g = d.g AND a.i = d.i JOIN core b ON b.g = d.g AND b.i = d.j GROUP BY ALL),
    prim AS MATERIALIZED (
      SELECT g, n, 0 AS step, 0::BIGINT AS here, list_transform(range(n), lambda j: {{'w': 1e300::DOUBLE, 'c': 0::BIGINT, 'j': j}}) AS best, {{'w': NULL::DOUBLE, 'c': NULL::BIGINT, 'j': NULL::BIGINT}} AS edge FROM (SELECT DISTINCT g, n FROM pt)
      UNION ALL
      SELECT g, n, step + 1, list_min(best).j, best, list_min(best) FROM (
        SELECT p.g, p.n, p.step, list_transform(p.best, lambda o: CASE WHEN o.j = p.here THEN {{'w': 1e301::DOUBLE, 'c': 0::BIGINT, 'j': o.j}} WHEN o.w > 1e300 THEN o
          WHEN {{'w': ww.w[o.j + 1], 'c': least(p.here, o.j) * p.n + greatest(p.here, o.j), 'j': o.j}} < o THEN {{'w': ww.w[o.j + 1], 'c': least(p.here, o.j) * p.n + greatest(p.here, o.j), 'j': o.j}} ELSE o END) AS best
        FROM prim p JOIN ww ON ww.g = p.g AND ww.i = p.here WHERE p.step < p.n - 1)),
    mst AS MATERIALIZED (SELECT g, n, row_number() OVER (PARTITION BY g ORDER BY edge.w, edge.c) AS k, edge.c // n AS u, edge.c % n AS v, edge.w AS w FROM prim WHERE step > 0),
    krus AS MATERIALIZED (
      SELECT g, n, 0::BIGINT AS k, range(n) AS top, NULL::BIGINT AS a, NULL::BIGINT AS b, 0::BIGINT AS sa, 0::BIGINT AS sb, 0::DOUBLE AS w FROM (SELECT DISTINCT g, n FROM pt)
      UNION ALL
      SELECT s.g, s.n, m.k, list_transform(s.top, lambda t: CASE WHEN t = s.top[m.u + 1] OR t = s.top[m.v + 1] THEN s.n + m.k - 1 ELSE t END), s.top[m.u + 1], s.top[m.v + 1],
        len(list_filter(s.top, lambda t: t = s.top[m.u + 1])), len(list_filter(s.top, lambda t: t = s.top[m.v + 1])), m.w FROM krus s JOIN mst m ON m.g = s.g AND m.k = s.k + 1),
    mg AS MATERIALIZED (SELECT g, n, n + k - 1 AS node, a, b, sa, sb, sa + sb AS size, 1.0 / greatest(w, 1e-10) AS den FROM krus WHERE k > 0),
    cl AS MATERIALIZED (
      SELECT g, node, node AS c, 0::DOUBLE AS born, NULL::BIGINT AS up FROM mg WHERE node = 2 * n - 2 AND size >= {least}
      UNION ALL
      SELECT m.g, kid.node, CASE WHEN least(m.sa, m.sb) >= {least} THEN kid.node ELSE cl.c END, CASE WHEN least(m.sa, m.sb) >= {least} THEN m.den ELSE cl.born END,
        CASE WHEN least(m.sa, m.sb) >= {least} THEN cl.c ELSE cl.up END
      FROM cl JOIN mg m ON m.g = cl.g AND m.node = cl.node JOIN mg kid ON kid.g = m.g AND (kid.node = m.a OR kid.node = m.b) WHERE kid.size >= {least}),
    ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY c) AS k FROM (
      SELECT cl.g, cl.c, max(cl.up) AS up, sum((m.den - cl.born) * CASE WHEN least(m.sa, m.sb) >= {least} THEN m.size WHEN m.sa >= {least} THEN m.sb WHEN m.sb >= {least} THEN m.sa ELSE m.size END) AS mass
      FROM cl JOIN mg m ON m.g = cl.g AND m.node = cl.node GROUP BY 1, 2)),
    eom AS MATERIALIZED (
      SELECT DISTINCT g, 0::BIGINT AS k, CAST([] AS STRUCT(up BIGINT, best DOUBLE)[]) AS done, NULL::BIGINT AS c, NULL::BIGINT AS up, false AS chosen FROM pt
      UNION ALL
      SELECT g, k, list_append(done, {{'up': up, 'best': greatest(mass, below)}}), c, up, up IS NOT NULL AND mass >= below * (1 - 1e-9) FROM (
        SELECT r.*, s.done, coalesce(list_sum(list_transform(list_filter(s.done, lambda x: x.up = r.c), lambda x: x.best)), 0) AS below FROM eom s JOIN ranked r ON r.g = s.g AND r.k = s.k + 1)),
    own AS MATERIALIZED (
      SELECT g, c, NULL::BIGINT AS owner FROM eom WHERE k > 0 AND up IS NULL
      UNION ALL SELECT e.g, e.c, coalesce(o.owner, CASE WHEN e.chosen THEN e.c END) FROM own o JOIN eom e ON e.g = o.g AND e.up = o.c),
    climb AS (
      SELECT g, i, i AS node, 1::BIGINT AS size FROM pt
      UNION ALL SELECT c.g, c.i, m.node, m.size FROM climb c JOIN mg m ON m.g = c.g AND (m.a = c.node OR m.b = c.node) WHERE c.size < {least}),
    lab AS MATERIALIZED (SELECT k.g, k.i, o.owner FROM climb k JOIN cl ON cl.g = k.g AND cl.node = k.node JOIN own o ON o.g = cl.g AND o.c = cl.c WHERE k.size >= {least}),
    num AS MATERIALIZED (SELECT g, owner, CAST(row_number() OVER (PARTITION BY g ORDER BY min(i)) - 1 AS INT) AS label FROM lab WHERE owner IS NOT NULL GROUP BY g, owner),
    dens AS (SELECT pt.g, pt.id, coalesce(num.label, -1) AS label FROM pt LEFT JOIN lab ON lab.g = pt.g AND lab.i = pt.i LEFT JOIN num ON num.g = lab.g AND num.owner = lab.owner)"""


_ALL = "SELECT 0 AS g, vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings"
_BY = "SELECT vec_id % 3 AS g, vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings"


@query("C1_hdbscan", f"WITH RECURSIVE {density_sql(_ALL, 4, 2)} SELECT id, label FROM dens")
def _(t: Tables) -> DataFrame:
    return density.hdbscan(t.vectors, min_cluster_size=4, min_samples=2)


@query("C1_hdbscan_by", f"WITH RECURSIVE {density_sql(_BY, 3, 2)} SELECT g, id, label FROM dens")
def _(t: Tables) -> DataFrame:
    """Groups of more than a block of 100 events: the tree is found and cut by joins."""
    given = t.vectors.select("id", "vec", (F.col("id") % 3).alias("g"))
    return density.hdbscan(given, min_cluster_size=3, min_samples=2, by=["g"], task_rows=100)


@query("C3_ahc")
def _(t: Tables) -> DataFrame:
    return clustering.ahc(t.vectors.withColumnRenamed("label", "rec"), ["rec"])


@query("C4_spectral")
def _(t: Tables) -> DataFrame:
    return clustering.spectral(t.vectors.withColumnRenamed("label", "rec"), ["rec"], p=0.1)


@query("C5_cluster_speakers")
def _(t: Tables) -> DataFrame:
    given = t.vectors.withColumn("rec", F.when(F.col("id") % 3 == 0, F.col("label") + 100).otherwise(F.col("label")))
    return clustering.cluster_speakers(given.drop("label"), ["rec"], merge_cos=0.8, p=0.1).select("rec", "id", "label")


@query("C8_assign_global_ids", """
    WITH n AS (SELECT event_id, pos, CASE WHEN name LIKE '%human%' THEN 'person' ELSE 'object' END AS p FROM m_object),
    t AS (SELECT split_part(global_name, '_', 1) AS p, max(CAST(split_part(global_name, '_', 2) AS BIGINT)) AS top FROM m_entity GROUP BY 1),
    r AS (SELECT n.event_id, n.pos, n.p, CAST(row_number() OVER (PARTITION BY n.p ORDER BY event_id, pos) + coalesce(t.top, 0) AS VARCHAR) AS k FROM n LEFT JOIN t ON t.p = n.p)
    SELECT event_id, pos, concat(p, '_', CASE WHEN length(k) < 3 THEN lpad(k, 3, '0') ELSE k END) AS global_name FROM r""")
def _(t: Tables) -> DataFrame:
    return resolve.assign_global_ids(t.object.select("event_id", "pos", "name"), t.entity, ["event_id", "pos"]).select("event_id", "pos", "global_name")


def seen_objects(t: Tables) -> DataFrame:
    """Objects with their description vectors, sampled boxes and the boxes found in the same event."""
    word = F.element_at(F.array(*[F.lit(w) for w in ("click", "view", "signup", "error", "purchase")]), (F.col("l_partkey") % 5 + 1).cast("int"))
    lines = t.read("lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").cast("double").alias("t"), "l_quantity", "l_discount", "l_tax", "l_suppkey", word.alias("desc_text"))
    x, y, w = F.col("l_quantity"), F.col("l_discount") * 100, 10 + F.col("l_tax") * 100
    dx = x + F.col("l_suppkey") % 5
    per_event = lines.groupBy("event_id").agg(
        F.sort_array(F.collect_list(F.struct("t", x.alias("x"), y.alias("y"), w.alias("w"), F.lit(12.0).alias("h")))).alias("frames"),
        F.sort_array(F.collect_list(F.struct("desc_text", "t", dx.alias("x1"), y.alias("y1"), (dx + w).alias("x2"), (y + 12.0).alias("y2")))).alias("detections"),
    )
    e = t.event.select("event_id", (F.col("participant") % 12).alias("participant"), "t_sec", F.col("event_type").alias("description"), (F.col("k") % 9 != 8).alias("has_crops"))
    return t.object.select("event_id", "pos", "name").join(e, "event_id").join(t.vec.select("event_id", "vec"), "event_id").join(per_event, "event_id", "left")


ENTITY_RULES = resolve.EntityRules(text_threshold=0.05)
VOICE_RULES = resolve.VoiceRules(threshold=0.25, ema_from=0.3)


def entity_sql(participant: str) -> str:
    """The entity fold as SQL, one row of every participant a step; ``vis`` is how well an event's boxes fit those found for a text."""
    return f"""
    WITH RECURSIVE li AS (
      SELECT l_orderkey AS event_id, l_linenumber AS t, CAST(l_quantity AS DOUBLE) AS x, CAST(l_discount * 100 AS DOUBLE) AS y, CAST(10 + l_tax * 100 AS DOUBLE) AS w, CAST(l_quantity + l_suppkey % 5 AS DOUBLE) AS dx,
        list_extract(['click', 'view', 'signup', 'error', 'purchase'], CAST(l_partkey % 5 + 1 AS INT)) AS word, row_number() OVER () AS n FROM lineitem),
    lap AS (SELECT f.event_id, f.n, d.word, d.w * 12 AS a, f.w * 12 AS b, least(d.dx + d.w, f.x + f.w) - greatest(d.dx, f.x) AS across, least(d.y, f.y) + 12 - greatest(d.y, f.y) AS down
      FROM li f JOIN li d ON d.event_id = f.event_id AND d.t = f.t),
    fit AS (SELECT event_id, n, word, max(CASE WHEN across < 0 OR down < 0 THEN 0 ELSE across * down / (a + b - across * down) END) AS best FROM lap GROUP BY ALL),
    vis AS (SELECT event_id, map(list(word), list(v)) AS vis FROM (SELECT event_id, word, avg(best) AS v FROM fit WHERE best > 0 GROUP BY ALL) GROUP BY 1),
    all_rows AS MATERIALIZED (
      SELECT {participant} AS p, e.event_id, o.pos, e.t_sec, CASE WHEN lower(o.name) LIKE '%human%' OR lower(o.name) LIKE '%person%' THEN 'person' ELSE 'object' END AS kind,
        e.event_type AS word, list_transform(v.vec, lambda q: q / sqrt(list_dot_product(v.vec, v.vec))) AS u, vis.vis, e.k % 9 <> 8 AS crops
      FROM m_object o JOIN m_event e ON e.event_id = o.event_id JOIN m_vec v ON v.event_id = o.event_id LEFT JOIN vis ON vis.event_id = o.event_id),
    src AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY p ORDER BY t_sec, event_id, pos) AS k FROM all_rows WHERE crops),
    fold AS (
      SELECT p, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS INT) AS pos, CAST([] AS STRUCT(name VARCHAR, kind VARCHAR, word VARCHAR, us DOUBLE[][])[]) AS known,
        CAST(NULL AS VARCHAR) AS name, CAST(NULL AS BOOLEAN) AS fresh, CAST(NULL AS DOUBLE) AS score FROM src WHERE k = 1
      UNION ALL
      SELECT p, k, event_id, pos, CASE WHEN fresh THEN list_append(known, {{'name': name, 'kind': kind, 'word': word, 'us': [u]}})
        ELSE list_transform(known, lambda e: CASE WHEN e.name <> name THEN e ELSE {{'name': e.name, 'kind': e.kind, 'word': word, 'us': list_append(e.us, u)[-5:]}} END) END, name, fresh, score
      FROM (SELECT *, CASE WHEN fresh THEN concat(kind, '_', CASE WHEN num < 100 THEN lpad(CAST(num AS VARCHAR), 3, '0') ELSE CAST(num AS VARCHAR) END) ELSE known[near[list_position(seen, score)].i].name END AS name
      FROM (SELECT *, coalesce(list_max(seen), 0) AS score, coalesce(list_max(seen), 0) < 0.5 AS fresh, len(list_filter(known, lambda e: e.kind = kind)) + 1 AS num
      FROM (SELECT *, list_transform(near, lambda c: coalesce(vis[known[c.i].word], 0)) AS seen
      FROM (SELECT f.known, s.*, list_reverse_sort(list_filter(list_transform(f.known, lambda e, i: {{'sim': round(list_max(list_transform(e.us, lambda q: list_dot_product(q, s.u))), 9), 'o': -i, 'i': i}}), lambda c: c.sim > 0.05))[1:3] AS near
      FROM fold f JOIN src s ON s.p = f.p AND s.k = f.k + 1)))))
    SELECT p AS participant, event_id, pos, name AS global_name, fresh AS is_new, round(score, 6) AS final_score, CAST(NULL AS VARCHAR) AS error FROM fold WHERE k > 0
    UNION ALL SELECT p, event_id, pos, NULL, NULL, NULL, 'no_crops' FROM all_rows WHERE NOT crops"""


def _entities(got: DataFrame) -> DataFrame:
    return got.select("participant", "event_id", "pos", "global_name", "is_new", r6("final_score").alias("final_score"), "error")


@query("C10_resolve_entities", entity_sql("e.participant % 12"))
def _(t: Tables) -> DataFrame:
    return _entities(resolve.resolve_entities(seen_objects(t), ENTITY_RULES))


@query("C10_hot_participant", entity_sql("CASE WHEN e.event_id % 3 = 0 THEN 0 ELSE e.participant % 12 + 1 END"))
def _(t: Tables) -> DataFrame:
    """A third of the rows are one participant's, folded by ranges of 128."""
    who = F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("participant") + 1)
    return _entities(resolve.resolve_entities(seen_objects(t).withColumn("participant", who.cast("bigint")), ENTITY_RULES, range_rows=128))


def spoken(t: Tables) -> DataFrame:
    """Speaker segments with a voice vector each, a dozen participants."""
    e = t.event.select("event_id", (F.col("participant") % 12).alias("participant"), "t_sec", (F.col("value") / F.lit(10.0)).alias("duration"))
    return t.vec.select("event_id", "vec").join(e, "event_id").select("*", F.lit("person1").alias("speaker"), F.lit(0).alias("pos"))


def voice_sql(participant: str) -> str:
    """The voice fold as SQL, one row of every participant a step: ``h`` holds a voice's vectors, ``mean`` its running mean."""
    unit = lambda v: f"list_transform({v}, lambda q: q / sqrt(list_dot_product({v}, {v})))"
    return f"""
    WITH RECURSIVE src AS MATERIALIZED (
      SELECT p, row_number() OVER (PARTITION BY p ORDER BY t_sec, event_id) AS k, event_id, d, vec, {unit("vec")} AS u
      FROM (SELECT {participant} AS p, e.t_sec, e.event_id, e.value / 10.0 AS d, v.vec FROM m_vec v JOIN m_event e ON e.event_id = v.event_id)),
    fold AS (
      SELECT p, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, CAST([] AS STRUCT(mean DOUBLE[], h STRUCT(s DOUBLE, d DOUBLE, u DOUBLE[])[])[]) AS voices,
        CAST(NULL AS BIGINT) AS number, CAST(NULL AS DOUBLE) AS best, 0 AS known FROM src WHERE k = 1
      UNION ALL
      SELECT p, k, event_id, CASE WHEN best IS NULL THEN list_append(voices, {{'mean': vec, 'h': [{{'s': CAST(1.0 AS DOUBLE), 'd': d, 'u': u}}]}})
        ELSE list_transform(voices, lambda v, i: CASE WHEN i <> number THEN v ELSE {{
          'mean': CASE WHEN best >= 0.3 THEN {unit("list_transform(list_zip(vec, v.mean), lambda z: 0.7 * z[1] + (1 - 0.7) * z[2])")} ELSE v.mean END,
          'h': CASE WHEN len(v.h) < 20 THEN list_append(v.h, {{'s': best, 'd': d, 'u': u}})
            ELSE list_reverse_sort(list_filter(list_append(v.h, {{'s': best, 'd': d, 'u': u}}), lambda x: x.d >= 1.5 AND x.s >= 0.5))[1:20] END}} END) END,
        CASE WHEN best IS NULL THEN len(voices) + 1 ELSE number END, best, CASE WHEN best IS NULL THEN len(voices) ELSE 0 END
      FROM (SELECT *, list_max(fit) AS best, list_position(fit, list_max(fit)) AS number FROM (SELECT *, list_transform(sc, lambda x: CASE WHEN x >= 0.25 THEN x END) AS fit FROM (
        SELECT f.voices, s.*, list_transform(f.voices, lambda v: CASE WHEN len(v.h) = 0 THEN list_dot_product({unit("v.mean")}, s.u)
          ELSE list_avg(list_reverse_sort(list_transform(v.h, lambda x: list_dot_product(x.u, s.u)))[1:5]) END) AS sc
        FROM fold f JOIN src s ON s.p = f.p AND s.k = f.k + 1))))
    SELECT p AS participant, event_id, concat('voice_', number) AS voice_id, best IS NULL AS is_new, round(coalesce(best, 1.0), 6) AS match_score,
      coalesce(best >= 0.3, false) AS mean_updated, known FROM fold WHERE k > 0"""


def _voices(got: DataFrame) -> DataFrame:
    return got.select("participant", "event_id", "voice_id", "is_new", r6("match_score").alias("match_score"), "mean_updated", F.size("register_score").alias("known"))


@query("C12_resolve_voices", voice_sql("e.participant % 12"))
def _(t: Tables) -> DataFrame:
    return _voices(resolve.resolve_voices(spoken(t), VOICE_RULES))


@query("C12_hot_participant", voice_sql("CASE WHEN e.event_id % 3 = 0 THEN 0 ELSE e.participant % 12 + 1 END"))
def _(t: Tables) -> DataFrame:
    """A third of the rows are one participant's, folded by ranges of 64."""
    who = F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("participant") + 1)
    return _voices(resolve.resolve_voices(spoken(t).withColumn("participant", who.cast("bigint")), VOICE_RULES, range_rows=64))


@query("C13_joint_labels")
def _(t: Tables) -> DataFrame:
    audio = voiced_turns(t).select("recording_id", "id", "start", "end", "vec", "label")
    seconds = F.filter(F.sequence(F.ceil("start"), F.ceil("end")), lambda s: s <= F.col("end"))
    frames = t.face.select("recording_id", "label", F.explode(seconds).alias("s"))
    faces = frames.groupBy("recording_id", F.col("s").cast("double").alias("t")).agg(F.min("label").alias("label"))
    return clustering.joint_labels(audio, faces, stride=30.0).select("recording_id", "id", "speaker")


def _pair_relations(t: Tables) -> DataFrame:
    return t.rel.select("event_id", "related_event_id", "type", "reason")


@query("R5_build_graph", """
    WITH r AS (SELECT *, CASE type WHEN 'causal' THEN 'CAUSAL' WHEN 'same_activity_non_causal' THEN 'SAME_ACTIVITY' WHEN 'related_to' THEN 'RELATED_TO' ELSE upper(type) END AS et FROM m_rel),
    p AS (SELECT voice_id, first(related_name ORDER BY ordinal) FILTER (related_name LIKE 'person%') AS person FROM m_voice GROUP BY 1),
    edges AS (SELECT DISTINCT CAST(o.event_id AS VARCHAR) AS src, o.global_name AS dst, 'INVOLVES' AS type FROM m_object o JOIN m_entity n ON n.global_name = o.global_name
      UNION ALL SELECT CAST(s.event_id AS VARCHAR), p.person, 'SPEAKS' FROM m_speech s JOIN p ON p.voice_id = s.global_voice JOIN m_entity n ON n.global_name = p.person
      UNION ALL SELECT CAST(a.event_id AS VARCHAR), CAST(b.event_id AS VARCHAR), et FROM r JOIN m_event a ON concat(a.clip_ts, '_evt') = r.event_id JOIN m_event b ON concat(b.clip_ts, '_evt') = r.related_event_id)
    SELECT src, dst, type, count(*) AS n FROM edges GROUP BY ALL
    UNION ALL SELECT CAST(event_id AS VARCHAR), NULL, 'Event', row_number() OVER (ORDER BY t_sec, event_id) FROM m_event
    UNION ALL SELECT global_name, NULL, label, NULL FROM m_entity""")
def _(t: Tables) -> DataFrame:
    events = t.event.select("event_id", F.col("clip_ts").alias("timestamp"), "t_sec", "caption")
    nodes, edges, _ = pipelines.build_graph(events, t.object, t.entity, t.speech, t.voice, _pair_relations(t))
    return edges.groupBy("src", "dst", "type").agg(F.count(F.lit(1)).alias("n")).unionByName(
        nodes.select(F.col("id").alias("src"), F.lit(None).cast("string").alias("dst"), F.col("label").alias("type"), F.col("meta_id").alias("n"))
    )


@query("R6_build_clusters", f"""
    WITH RECURSIVE {density_sql("SELECT 0 AS g, event_id AS id, vec AS x FROM m_vec", 4, 2)},
    m AS (SELECT d.label, e.clip_ts, e.caption, e.t_sec, e.event_id FROM dens d JOIN m_event e ON e.event_id = d.id WHERE d.label >= 0),
    a AS (SELECT label, count(*) AS event_count, concat(first(clip_ts ORDER BY t_sec, clip_ts), ' - ', last(clip_ts ORDER BY t_sec, clip_ts)) AS time_span, first(caption ORDER BY t_sec, event_id) AS summary FROM m GROUP BY label)
    SELECT label, event_count, time_span, CASE WHEN length(split_part(summary, '。', 1)) > 50 THEN concat(substr(split_part(summary, '。', 1), 1, 47), '...') ELSE split_part(summary, '。', 1) END AS title, summary, 64 AS width FROM a""")
def _(t: Tables) -> DataFrame:
    events = t.event.select("event_id", "participant", F.col("clip_ts").alias("timestamp"), "t_sec", "caption").join(t.vec.select("event_id", "vec"), "event_id")
    profile, _ = pipelines.build_clusters(events, min_cluster_size=4, min_samples=2)
    return profile.select("label", "event_count", "time_span", "title", "summary", F.size("vec").alias("width"))


@query("R8_voice_pipeline")
def _(t: Tables) -> DataFrame:
    media = t.speech.groupBy("event_id").agg(F.max("end_time").alias("media_duration"))
    events = media.select("event_id", (F.col("event_id") % 12).alias("participant"), F.col("event_id").cast("double").alias("t_sec"), "media_duration")
    seeds = t.speech.select("event_id", F.coalesce("speaker", F.lit("null_0")).alias("speaker"), "pos").groupBy("event_id", "speaker").agg(F.min("pos").alias("pos"))
    known = t.vectors.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    dealt = seeds.withColumn("id", F.pmod(F.col("event_id") * 5 + F.col("pos"), known))
    vecs = dealt.join(t.vectors.select("id", "vec"), "id").select("event_id", "speaker", "vec")
    speech, _ = pipelines.voice_pipeline(t.speech, speech_objects(t), vecs, events, rules=VOICE_RULES)
    return speech.select("event_id", "pos", "speaker", "global_voice")


@query("R10_diarize")
def _(t: Tables) -> DataFrame:
    activity = t.turn.select("recording_id", "start", "end")
    chunks = intervals.chunk_intervals(intervals.union_intervals(activity)).select("recording_id", "chunk_start", "chunk")
    known = t.vectors.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    chosen = F.pmod(F.col("recording_id") * 7 + F.floor(F.col("chunk") / 12) * 10 + F.col("chunk") % 3, known)
    vecs = chunks.withColumn("id", chosen).join(t.vectors.select("id", "vec"), "id").select("recording_id", "chunk_start", "vec")
    got = pipelines.diarize(activity, vecs, p=0.1)
    return got.select("recording_id", r6("start").alias("start"), r6("end").alias("end"), "label")


def _stream(t: Tables):
    """The driver's event file as a stream, by its own schema."""
    return _live(t, t.dir, t.read("events").schema, pathGlobFilter="events.parquet")


def _live(t: Tables, path: str, schema, **options: str) -> DataFrame:
    raw = streams.stream_events(t.spark, path, schema=schema, fmt="parquet", event_time=F.col("ts").cast("timestamp"), **options)
    ts = F.col("ts")
    day = (F.datediff(ts.cast("date"), F.lit("2024-01-01").cast("date")) + 1).cast("int")
    second = F.expr("CAST(floor(extract(SECOND FROM ts) * 100) / 100.0 AS DOUBLE)")
    return raw.select(
        "event_id", F.col("user_id").alias("participant"), day.alias("day"), "value",
        ((F.hour(ts) * 3600 + F.minute(ts) * 60).cast("double") + second + (day - 1) * F.lit(86400.0)).alias("t_sec"),
    )


def _run(t: Tables, df: DataFrame, tag: str) -> DataFrame:
    streams.use_rocksdb(t.spark)
    path = scratch_path(t.spark, tag)
    streams.run_to_table(df, f"{path}/table", f"{path}/checkpoint")
    return t.spark.read.schema(df.schema).parquet(f"{path}/table")


@query("ST1_stream_events", "SELECT event_id, participant, day, round(t_sec, 2) AS t_sec FROM m_event")
def _(t: Tables) -> DataFrame:
    return _run(t, _stream(t), "st1").select("event_id", "participant", "day", F.round("t_sec", 2).alias("t_sec"))


ARRIVALS = 4
# When a file brings an event: quarters of the days; every tenth event comes two quarters after its own.
_DAY_SQL = "CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) AS BIGINT)"
ARRIVAL_SQL = f"(SELECT *, least(3, {_DAY_SQL} * 4 // (max({_DAY_SQL}) OVER () + 1) + CASE WHEN event_id % 10 = 0 THEN 2 ELSE 0 END) AS file FROM events)"


def _arrivals(t: Tables, tag: str, late: bool, job) -> tuple[DataFrame, DataFrame]:
    """The events come in four lots; each is a run of its own that goes on from the checkpoint of the run before.

    Returns the table written and the account of all micro-batches with the number of their ``run``.
    """
    streams.use_rocksdb(t.spark)
    path = scratch_path(t.spark, tag)
    raw = t.read("events")
    days = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    last = raw.select(days.alias("d")).agg(F.max("d").alias("last")).first()["last"] or 0
    file = F.floor(days * ARRIVALS / (last + 1)) + (F.when(F.col("event_id") % 10 == 0, 2).otherwise(0) if late else 0)
    dealt = raw.withColumn("file", F.least(F.lit(ARRIVALS - 1), file).cast("int"))
    runs = None
    for run in range(ARRIVALS):
        dealt.where(F.col("file") == run).drop("file").write.mode("append").parquet(f"{path}/in")
        df = job(_live(t, f"{path}/in", raw.schema))
        seen = streams.run_to_table(df, f"{path}/table", f"{path}/checkpoint").withColumn("run", F.lit(run))
        runs = seen if runs is None else runs.unionByName(seen)
    return t.spark.read.schema(df.schema).parquet(f"{path}/table"), runs


@query("ST1_stream_late", f"""
    WITH e AS {ARRIVAL_SQL}, f AS (SELECT file, count(*) AS n, epoch_ms(max(ts)) AS top FROM e GROUP BY 1),
    w AS (SELECT file, n, max(top) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 86400000 AS mark FROM f),
    m AS (SELECT e.event_id, e.file, w.mark IS NOT NULL AND epoch_us(e.ts) <= w.mark * 1000 AS late FROM e JOIN w ON w.file = e.file),
    c AS (SELECT file, count(*) AS came, count(*) FILTER (late) AS late FROM m GROUP BY 1)
    SELECT m.event_id, CAST(m.file AS INT) AS run, c.came AS rows_in, c.late AS rows_late FROM m JOIN c ON c.file = m.file WHERE NOT m.late""")
def _(t: Tables) -> DataFrame:
    """Four lots with a restart after each: the events kept, and how many of their lot came behind the watermark."""
    table, runs = _arrivals(t, "st1l", True, lambda df: df.select("event_id", F.lit(0).alias("one")))
    account = runs.groupBy("run").agg(F.sum("rows_in").alias("rows_in"), F.sum("rows_late").alias("rows_late"))
    raw = t.read("events").select("event_id", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long").alias("d"))
    last = raw.agg(F.max("d").alias("last")).first()["last"] or 0
    lot = F.floor(F.col("d") * ARRIVALS / (last + 1)) + F.when(F.col("event_id") % 10 == 0, 2).otherwise(0)
    came = raw.select("event_id", F.least(F.lit(ARRIVALS - 1), lot).cast("int").alias("run"))
    return table.select("event_id").join(came, "event_id").join(account, "run").select("event_id", "run", "rows_in", "rows_late")


def near_value(new: dict, tail: dict) -> bool:
    """An event goes on from one of the same half of the values, up to twenty days before."""
    return (new["value"] < 50) == (tail["value"] < 50) and (new["at"] - tail["at"]).total_seconds() <= 20 * 86400


def _chain_events(df: DataFrame) -> DataFrame:
    return df.select("participant", "event_id", "t_sec", "value", F.col("t_sec").cast("timestamp").alias("at"))


_HALVES = """
    WITH h AS (SELECT participant, event_id, t_sec, lag(event_id) OVER w AS src, lag(t_sec) OVER w AS before FROM m_event
      WINDOW w AS (PARTITION BY participant, value < 50 ORDER BY t_sec, event_id))
    SELECT participant, src, event_id AS dst, 'NEXT_EVENT' AS type FROM h WHERE t_sec - before <= 20 * 86400"""


@query("ST2_stream_chains_restarts", _HALVES)
def _(t: Tables) -> DataFrame:
    """Four lots with a restart after each; the predicate reads a time and a number of the stored chain ends."""
    return _arrivals(t, "st2r", False, lambda df: streams.stream_chains(_chain_events(df), near_value))[0]


@query("ST4_stream_temporal_restarts", f"""
    WITH {HISTORY_SQL} SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(past_event_id AS VARCHAR) AS related_event_id, round(t_sec - past_t_sec, 2) AS time_diff_seconds FROM h5 WHERE round(t_sec - past_t_sec, 6) BETWEEN 0.000001 AND 3600""")
def _(t: Tables) -> DataFrame:
    """Four lots with a restart after each."""
    job = lambda df: streams.stream_temporal_edges(df.select("participant", "day", "event_id", "t_sec"), max_s=3600.0)
    got = _arrivals(t, "st4r", False, job)[0]
    return got.select("event_id", "related_event_id", F.round("time_diff_seconds", 2).alias("time_diff_seconds"))


@query("ST2_stream_chains", "SELECT e.participant, n.src, n.dst, n.type FROM m_next n JOIN m_event e ON e.event_id = n.dst")
def _(t: Tables) -> DataFrame:
    return _run(t, streams.stream_chains(_stream(t).select("participant", "event_id", "t_sec")), "st2")


@query("ST3_stream_resolve", voice_sql("e.participant % 12"))
def _(t: Tables) -> DataFrame:
    live = _stream(t).join(t.read("embeddings").select(F.col("vec_id").alias("event_id"), F.col("embedding").alias("vec")), "event_id").select(
        (F.col("participant") % 12).alias("participant"), "event_id", F.lit("person1").alias("speaker"), "t_sec", F.lit(0).alias("pos"),
        (F.col("value") / F.lit(10.0)).alias("duration"), "vec",
    )
    got = _run(t, streams.stream_resolve(live, VOICE_RULES), "st3")
    return _voices(got)


@query("ST3_stream_entities", entity_sql("e.participant % 12"))
def _(t: Tables) -> DataFrame:
    static = seen_objects(t).drop("participant", "t_sec")
    live = _stream(t).select("event_id", (F.col("participant") % 12).alias("participant"), "t_sec").join(static, "event_id")
    got = _run(t, streams.stream_entities(live, ENTITY_RULES), "st3e")
    return _entities(got)


@query("ST4_stream_temporal_edges", f"""
    WITH {HISTORY_SQL} SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(past_event_id AS VARCHAR) AS related_event_id, round(t_sec - past_t_sec, 2) AS time_diff_seconds FROM h5 WHERE round(t_sec - past_t_sec, 6) BETWEEN 0.000001 AND 3600""")
def _(t: Tables) -> DataFrame:
    got = _run(t, streams.stream_temporal_edges(_stream(t).select("participant", "day", "event_id", "t_sec"), max_s=3600.0), "st4")
    return got.select("event_id", "related_event_id", F.round("time_diff_seconds", 2).alias("time_diff_seconds"))
