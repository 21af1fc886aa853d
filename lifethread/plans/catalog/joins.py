"""Joins, links and graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifethread.functions import boxes, vectors
from lifethread.operators import graph, intervals, links, ordered, similarity, speech
from lifethread.plans.bindings import Tables
from lifethread.plans.catalog.registry import query, r6
from lifethread.plans.catalog.scalar import IOU_SQL


def entity_edges(t: Tables) -> DataFrame:
    """Distinct (event, entity) pairs with entities that exist."""
    return t.object.join(t.entity, "global_name", "left_semi").select(
        F.col("event_id").alias("src"), F.col("global_name").alias("dst")
    ).distinct()


TIES = "ties AS (SELECT DISTINCT o.event_id AS src, o.global_name AS dst FROM m_object o JOIN m_entity n ON n.global_name = o.global_name)"


@query("J1_involves", """
    WITH f AS (SELECT event_id, global_name, min(pos) AS pos FROM m_object GROUP BY ALL)
    SELECT f.event_id, f.global_name, f.pos, o.name AS local_name, n.global_name IS NOT NULL AS known FROM f
    JOIN m_object o ON o.event_id = f.event_id AND o.pos = f.pos LEFT JOIN m_entity n ON n.global_name = f.global_name""")
def _(t: Tables) -> DataFrame:
    edges, missed = links.involves_edges(t.object, t.entity)
    cols = ["event_id", "global_name", "pos", "local_name"]
    return edges.select(*cols, F.lit(True).alias("known")).unionByName(missed.select(*cols, F.lit(False).alias("known")))


_SPEAKER = "CASE speaker WHEN 'user' THEN 'person1' WHEN 'assistant' THEN 'SPEAKER_01' END"


@query("J2_speaks", f"""
    WITH p AS (SELECT voice_id, first(related_name ORDER BY ordinal) FILTER (related_name LIKE 'person%') AS person, max(CASE WHEN related_name = 'I' THEN 1 ELSE 0 END) AS has_i FROM m_voice GROUP BY 1)
    SELECT s.event_id, s.pos, {_SPEAKER} AS speaker, p.person, p.voice_id, round(end_time - start_time, 6) AS duration FROM m_speech s
    JOIN p ON p.voice_id = s.global_voice JOIN m_entity n ON n.global_name = p.person
    WHERE NOT (coalesce({_SPEAKER} IN ('I', 'person1'), false) AND has_i = 1)""")
def _(t: Tables) -> DataFrame:
    named = F.when(F.col("speaker") == "user", "person1").when(F.col("speaker") == "assistant", "SPEAKER_01")
    edges = links.speaks_edges(t.speech.withColumn("speaker", named), t.voice, t.entity)
    return edges.select("event_id", "pos", "speaker", "person", "voice_id", r6("duration").alias("duration"))


@query("J3_relation_edges", """
    WITH r AS (SELECT *, CASE type WHEN 'causal' THEN 'CAUSAL' WHEN 'same_activity_non_causal' THEN 'SAME_ACTIVITY' WHEN 'related_to' THEN 'RELATED_TO' ELSE upper(type) END AS edge_type FROM m_rel)
    SELECT a.event_id AS src, b.event_id AS dst, r.edge_type, r.eid, true AS found FROM r JOIN m_event a ON concat(a.clip_ts, '_evt') = r.event_id JOIN m_event b ON concat(b.clip_ts, '_evt') = r.related_event_id
    UNION ALL SELECT NULL, NULL, r.edge_type, r.eid, false FROM r WHERE r.related_event_id NOT IN (SELECT concat(clip_ts, '_evt') FROM m_event)""")
def _(t: Tables) -> DataFrame:
    events = t.event.select("event_id", F.col("clip_ts").alias("timestamp"))
    found, lost = links.relation_edges(events, t.rel)
    return found.select("src", "dst", "edge_type", "eid", F.lit(True).alias("found")).unionByName(
        lost.select("edge_type", "eid", F.lit(False).alias("found")), allowMissingColumns=True
    )


@query("J4_events_of_entities", f"""
    WITH {TIES} SELECT DISTINCT n.label AS qid, e.event_id, round(e.t_sec, 2) AS t_sec FROM ties JOIN m_entity n ON n.global_name = ties.dst JOIN m_event e ON e.event_id = ties.src""")
def _(t: Tables) -> DataFrame:
    asked = t.entity.select(F.col("label").alias("qid"), F.col("global_name").alias("entity"))
    got = links.events_of_entities(entity_edges(t), asked, t.event.select("event_id", "t_sec"), ["qid"])
    return got.select("qid", "event_id", F.round("t_sec", 2).alias("t_sec"))


@query("J5_entities_of_events", f"""
    WITH {TIES} SELECT DISTINCT e.participant AS qid, e.event_id, ties.dst AS global_name, n.label FROM ties JOIN m_entity n ON n.global_name = ties.dst JOIN m_event e ON e.event_id = ties.src""")
def _(t: Tables) -> DataFrame:
    asked = t.event.select(F.col("participant").alias("qid"), "event_id")
    return links.entities_of_events(entity_edges(t), asked, t.entity, ["qid"]).select("qid", "event_id", "global_name", "label")


@query("J6_same_activity", """
    WITH s AS (SELECT related_eid AS a, eid AS b FROM m_rel WHERE type = 'same_activity_non_causal')
    SELECT a AS event_id, b AS neighbour FROM s UNION SELECT b, a FROM s""")
def _(t: Tables) -> DataFrame:
    kind = F.when(F.col("type") == "same_activity_non_causal", "SAME_ACTIVITY").otherwise(F.upper("type"))
    edges = t.rel.select(F.col("related_eid").alias("src"), F.col("eid").alias("dst"), kind.alias("type"))
    return links.same_activity(edges, t.event.select("event_id"))


@query("J7_validate_connected", f"""
    WITH {TIES}, hits AS (SELECT participant AS qid, event_id FROM m_event WHERE event_type = 'purchase'),
    found AS (SELECT DISTINCT participant AS qid, concat('object_', lpad(CAST(participant % 25 + 1 AS VARCHAR), 3, '0')) AS entity FROM m_event
      UNION SELECT DISTINCT participant, concat('person_', lpad(CAST(participant * 7 % 10 + 1 AS VARCHAR), 3, '0')) FROM m_event WHERE participant % 3 = 0),
    touch AS (SELECT h.qid, h.event_id, f.entity FROM hits h JOIN ties ON ties.src = h.event_id JOIN found f ON f.qid = h.qid AND f.entity = ties.dst)
    SELECT qid, event_id, NULL AS entity, (qid, event_id) IN (SELECT (qid, event_id) FROM touch) AS connected FROM hits
      WHERE (qid, event_id) IN (SELECT (qid, event_id) FROM touch) OR qid NOT IN (SELECT qid FROM touch)
    UNION ALL SELECT qid, NULL, entity, NULL FROM found WHERE (qid, entity) IN (SELECT (qid, entity) FROM touch) OR qid NOT IN (SELECT qid FROM hits)""")
def _(t: Tables) -> DataFrame:
    hits = t.event.where("event_type = 'purchase'").select(F.col("participant").alias("qid"), "event_id")
    who = t.event.select(F.col("participant").alias("qid")).distinct()
    number = lambda c: F.lpad(c.cast("string"), 3, "0")
    found = who.select("qid", F.concat(F.lit("object_"), number(F.col("qid") % 25 + 1)).alias("entity")).unionByName(
        who.where("qid % 3 = 0").select("qid", F.concat(F.lit("person_"), number(F.col("qid") * 7 % 10 + 1)).alias("entity"))
    )
    events, entities = links.validate_connected(hits, found, entity_edges(t))
    return events.select("qid", "event_id", "connected").unionByName(entities.select("qid", "entity"), allowMissingColumns=True)


@query("J8_time_hits", """
    SELECT h.participant AS qid, h.event_id, g.event_id AS target_id, round(abs(h.t_sec - g.t_sec), 2) AS time_diff FROM m_event h
    JOIN m_event g ON g.participant = h.participant AND g.event_type = 'signup' AND abs(h.t_sec - g.t_sec) <= 3600""")
def _(t: Tables) -> DataFrame:
    hits = t.event.select(F.col("participant").alias("qid"), "event_id", F.col("t_sec").alias("t"))
    targets = t.event.where("event_type = 'signup'").select(
        F.col("participant").alias("qid"), F.col("event_id").alias("target_id"), F.col("t_sec").alias("target_t")
    )
    return intervals.time_hits(hits, targets, 3600).select("qid", "event_id", "target_id", F.round("time_diff", 2).alias("time_diff"))


@query("J9_asof_filter", """
    WITH q AS (SELECT participant AS qid, max(t_sec) FILTER (event_type = 'error') AS query_t FROM m_event GROUP BY 1)
    SELECT q.qid, e.event_id FROM m_event e JOIN q ON q.qid = e.participant WHERE e.t_sec <= q.query_t""")
def _(t: Tables) -> DataFrame:
    hits = t.event.select(F.col("participant").alias("qid"), "event_id", "t_sec")
    asked = t.event.groupBy(F.col("participant").alias("qid")).agg(F.max(F.when(F.col("event_type") == "error", F.col("t_sec"))).alias("query_t"))
    return links.asof_filter(hits, asked).select("qid", "event_id")


_LAP = 'least(a."end", b."end") - greatest(a.start, b.start)'
_MEET = 'a.recording_id = b.recording_id AND a."end" > b.start AND b."end" > a.start'


@query("J10_overlap_join", f"""
    WITH o AS (SELECT a.recording_id, a.label AS a_label, b.label AS v_label, sum({_LAP}) AS overlap FROM m_turn a JOIN m_face b ON {_MEET} GROUP BY 1, 2, 3),
    d AS (SELECT recording_id, label, sum("end" - start) AS spent FROM m_face GROUP BY 1, 2)
    SELECT o.recording_id, o.a_label, o.v_label, round(overlap, 6) AS overlap, 'fixed' AS rule FROM o WHERE overlap > 0.5
    UNION ALL SELECT o.recording_id, o.a_label, o.v_label, round(overlap, 6), 'label' FROM o JOIN d ON d.recording_id = o.recording_id AND d.label = o.v_label WHERE overlap > least(spent * 0.5, 0.5)""")
def _(t: Tables) -> DataFrame:
    parts = [
        intervals.overlap_join(t.turn, t.face, label_time=by_label).withColumn("rule", F.lit("label" if by_label else "fixed"))
        for by_label in (False, True)
    ]
    return parts[0].unionByName(parts[1]).select("recording_id", "a_label", "v_label", r6("overlap").alias("overlap"), "rule")


@query("J11_score_trials", """
    SELECT t.enrol, t.test, t.target, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score
    FROM m_trial t JOIN embeddings a ON a.vec_id = t.enrol JOIN embeddings b ON b.vec_id = t.test""")
def _(t: Tables) -> DataFrame:
    return similarity.score_trials(t.trial, t.vectors, t.vectors).select("enrol", "test", "target", r6("score").alias("score"))


CENTRE_SQL = """
    parts AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    means AS (SELECT label, i, avg(x) AS m FROM parts GROUP BY 1, 2),
    centre AS (SELECT label, list(m ORDER BY i) AS c FROM means GROUP BY 1)
"""


@query("J12_assign_nearest", f"""
    WITH {CENTRE_SQL},
    s AS (SELECT v.vec_id, c.label, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), c.c), 9) AS sim FROM embeddings v JOIN centre c ON true)
    SELECT vec_id AS qid, first(label ORDER BY sim DESC, label) AS id, round(max(sim), 6) AS sim FROM s GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    centres = vectors.vec_mean(t.vectors, ["label"]).select(F.col("label").alias("id"), "vec")
    got = similarity.assign_nearest(t.vectors.select(F.col("id").alias("qid"), "vec"), centres)
    return got.select("qid", "id", r6("sim").alias("sim"))


SPEECH_OBJECTS_SQL = """
    objs AS (SELECT event_id, pos, concat('desc', CAST(event_id % 5 AS VARCHAR)) AS description, concat(CASE WHEN pos % 2 = 0 THEN 'person_' ELSE 'object_' END, lpad(CAST((event_id + pos) % 10 + 1 AS VARCHAR), 3, '0')) AS global_name,
      CASE WHEN length(text) % 4 = 0 THEN '' ELSE concat('a', CAST(length(text) % 4 AS VARCHAR)) END AS action FROM m_speech WHERE event_id % 4 <> 3)
"""


def speech_objects(t: Tables) -> DataFrame:
    number = F.lpad(((F.col("event_id") + F.col("pos")) % 10 + 1).cast("string"), 3, "0")
    chars = F.length("text") % 4
    return t.speech.where("event_id % 4 <> 3").select(
        "event_id", "pos", F.concat(F.lit("desc"), (F.col("event_id") % 5).cast("string")).alias("description"),
        F.concat(F.when(F.col("pos") % 2 == 0, "person_").otherwise("object_"), number).alias("global_name"),
        F.when(chars == 0, "").otherwise(F.concat(F.lit("a"), chars.cast("string"))).alias("action"),
    )


@query("J13_speaker_person", f"""
    WITH {SPEECH_OBJECTS_SQL},
    m AS (SELECT DISTINCT s.event_id, s.speaker, o.global_name FROM m_speech s JOIN objs o ON o.event_id = s.event_id AND o.description = s.description
      WHERE s.speaker IS NOT NULL AND s.description NOT IN ('', 'I') AND o.global_name LIKE 'person%')
    SELECT DISTINCT s.event_id, s.speaker, coalesce(m.global_name, s.speaker) AS person_key FROM m_speech s LEFT JOIN m ON m.event_id = s.event_id AND m.speaker = s.speaker WHERE s.speaker IS NOT NULL""")
def _(t: Tables) -> DataFrame:
    return speech.speaker_person(t.speech, speech_objects(t))


@query("J14_iou_candidates", f"""
    SELECT b.event_id AS qid, d.candidate, b.event_id, b.frame AS t, round(max({IOU_SQL.replace('dx', 'd.dx').replace('dy', 'd.dy').replace('x+w', 'b.x+b.w').replace('d.db.x+b.w', 'd.dx+d.w').replace('y+h', 'b.y+b.h').replace('d.db.y+b.h', 'd.dy+d.h').replace('w*h + w*h', 'b.w*b.h + d.w*d.h').replace('(x,', '(b.x,').replace('(y,', '(b.y,')}), 6) AS max_iou
    FROM m_box b JOIN m_box d ON d.event_id = b.event_id AND d.frame = b.frame GROUP BY 1, 2, 3, 4""")
def _(t: Tables) -> DataFrame:
    tracks = t.box.select(F.col("event_id").alias("qid"), "event_id", F.col("frame").alias("t"), boxes.box(boxes.XYWH, [F.col(c) for c in boxes.XYWH]).alias("box"))
    found = t.box.select(
        "event_id", F.col("frame").alias("t"), "candidate",
        boxes.box(boxes.XYXY, [F.col("dx"), F.col("dy"), F.col("dx") + F.col("w"), F.col("dy") + F.col("h")]).alias("box_xyxy"),
    )
    return similarity.iou_candidates(tracks, found).select("qid", "candidate", "event_id", "t", r6("max_iou").alias("max_iou"))


@query("J15_pending", """
    SELECT event_id, 'events' AS step FROM m_event WHERE event_type <> 'view'
    UNION ALL SELECT DISTINCT s.event_id, 'voices' FROM m_speech s WHERE s.global_voice IS NULL OR s.global_voice NOT IN (SELECT voice_id FROM m_voice WHERE related_name LIKE 'person%')""")
def _(t: Tables) -> DataFrame:
    done = t.event.where("event_type = 'view'").select("event_id")
    store = t.voice.where("related_name LIKE 'person%'").select("voice_id")
    events = links.pending(t.event, done).select("event_id", F.lit("events").alias("step"))
    return events.unionByName(links.voice_pending(t.speech, store).select("event_id", F.lit("voices").alias("step")))


_CHUNK_VECS = "chunk AS (SELECT t.*, CAST(v.embedding AS DOUBLE[]) AS vec FROM m_turn t JOIN embeddings v ON v.vec_id = (t.recording_id * 5 + t.pos) % (SELECT count(*) FROM embeddings))"


def voiced_turns(t: Tables) -> DataFrame:
    """All turns with a vector each; the vectors, numbered from 0, are dealt round."""
    known = t.vectors.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    turns = t.turn.withColumns({"id": F.col("recording_id") * 100 + F.col("pos"), "_at": F.pmod(F.col("recording_id") * 5 + F.col("pos"), known)})
    return turns.join(t.vectors.select(F.col("id").alias("_at"), "vec"), "_at").drop("_at")


@query("J16_visual_speaker_vectors", f"""
    WITH {_CHUNK_VECS}, pairs AS (SELECT a.recording_id, b.label, a.vec FROM chunk a JOIN m_face b ON {_MEET} WHERE {_LAP} > 1.0),
    x AS (SELECT recording_id, label, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS pos FROM pairs)
    SELECT recording_id, label, CAST(pos AS INT) AS pos, round(avg(x), 6) AS x FROM x GROUP BY 1, 2, 3""")
def _(t: Tables) -> DataFrame:
    got = intervals.visual_speaker_vectors(voiced_turns(t).select("recording_id", "start", "end", "vec"), t.face)
    return got.select("recording_id", "label", F.posexplode("vec").alias("pos", "x")).withColumn("x", r6("x"))


@query("J17_with_vectors", """
    SELECT e.event_id, v.label % 3 = 0 AND v.label IS NOT NULL AS has_caption, coalesce(v.label % 3 = 1, false) AS has_vision, coalesce(v.label % 3 = 2, false) AS has_audio
    FROM m_event e LEFT JOIN m_vec v ON v.event_id = e.event_id""")
def _(t: Tables) -> DataFrame:
    kind = F.when(F.col("label") % 3 == 0, "caption").when(F.col("label") % 3 == 1, "vision").otherwise("audio")
    wide = links.with_vectors(t.event.select("event_id"), t.vec.select("event_id", kind.alias("kind"), "vec"))
    return wide.select("event_id", *[F.col(f"{k}_vec").isNotNull().alias(f"has_{k}") for k in ("caption", "vision", "audio")])


@query("U1_merge_hits", """
    WITH core AS (SELECT participant AS qid, event_id, clip_ts AS timestamp FROM m_event WHERE event_type IN ('click', 'view')),
    more AS (SELECT participant AS qid, event_id, clip_ts AS timestamp FROM m_event WHERE event_type <> 'click')
    SELECT qid, event_id, timestamp, true AS is_core FROM core UNION ALL
    SELECT qid, event_id, timestamp, false FROM more WHERE (qid, timestamp) NOT IN (SELECT (qid, timestamp) FROM core)""")
def _(t: Tables) -> DataFrame:
    rows = t.event.select(F.col("participant").alias("qid"), "event_id", F.col("clip_ts").alias("timestamp"), "event_type")
    core, more = rows.where("event_type IN ('click', 'view')").drop("event_type"), rows.where("event_type <> 'click'").drop("event_type")
    return links.merge_hits(core, more.unionByName(more))


@query("U2_common_events", f"""
    WITH {TIES} SELECT src AS event_id FROM ties WHERE dst LIKE 'person%' INTERSECT SELECT src FROM ties WHERE dst IN ('object_001', 'object_003', 'object_005')""")
def _(t: Tables) -> DataFrame:
    ties = entity_edges(t)
    people = ties.where(F.startswith("dst", F.lit("person"))).select(F.col("src").alias("event_id"))
    return people.intersect(ties.where(F.col("dst").isin("object_001", "object_003", "object_005")).select("src"))


@query("U3_missing_ids", "SELECT DISTINCT global_name FROM m_object WHERE global_name NOT IN (SELECT global_name FROM m_entity)")
def _(t: Tables) -> DataFrame:
    return links.missing_ids(t.object, t.entity, "global_name")


@query("G1_chains", "SELECT e.participant, n.src, n.dst, n.type FROM m_next n JOIN m_event e ON e.event_id = n.dst")
def _(t: Tables) -> DataFrame:
    return graph.build_chains(t.event.select("participant", "event_id", "t_sec"))


@query("G2_tails", """
    SELECT event_id, 'tail' AS kind FROM m_event WHERE event_id NOT IN (SELECT src FROM m_next)
    UNION ALL SELECT event_id, 'head' FROM m_event WHERE event_id NOT IN (SELECT dst FROM m_next)""")
def _(t: Tables) -> DataFrame:
    nodes = t.event.select("event_id", "t_sec")
    both = [graph.tails(nodes, t.next, head).select("event_id", F.lit("head" if head else "tail").alias("kind")) for head in (False, True)]
    return both[0].unionByName(both[1])


_CHAINS = """
    chains AS (SELECT first_value(event_id) OVER (PARTITION BY participant ORDER BY t_sec, event_id) AS chain, row_number() OVER (PARTITION BY participant ORDER BY t_sec, event_id) - 1 AS pos, event_id FROM m_event)
"""


@query("G3_all_chains", f"WITH {_CHAINS} SELECT * FROM chains")
def _(t: Tables) -> DataFrame:
    return graph.all_chains(t.event.select("event_id"), t.next)


@query("G3_all_paths", """
    WITH RECURSIVE n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS r FROM m_event),
    up AS (SELECT r AS leaf, r FROM n WHERE 2 * r > (SELECT count(*) FROM n) UNION ALL SELECT leaf, r // 2 FROM up WHERE r > 1)
    SELECT leaf, CAST(row_number() OVER (PARTITION BY leaf ORDER BY up.r) - 1 AS INT) AS pos, n.event_id FROM up JOIN n ON n.r = up.r""")
def _(t: Tables) -> DataFrame:
    """Every event is followed by two others: all ways from the first event to those nothing follows."""
    numbered = t.event.select("event_id").withColumn("event_id", F.col("event_id"))
    ranked = ordered.number_rows(numbered, ["event_id"], "r")
    above = ranked.select(F.col("event_id").alias("src"), F.col("r").alias("_up"))
    edges = ranked.withColumn("_up", F.floor(F.col("r") / 2)).join(above, "_up").select("src", F.col("event_id").alias("dst"), F.lit("NEXT_EVENT").alias("type"))
    paths = graph.all_paths(t.event.select("event_id"), edges, explode=False)
    leaf = ranked.select(F.col("event_id").alias("_last"), F.col("r").alias("leaf"))
    return paths.join(leaf, F.element_at("path", -1) == F.col("_last")).select("leaf", F.posexplode("path").alias("pos", "event_id"))


@query("A21_chain_summary", f"""
    WITH {_CHAINS} SELECT chain, count(*) AS length, arg_min(event_id, pos) AS head, arg_max(event_id, pos) AS tail FROM chains GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return graph.chain_summary(graph.all_chains(t.event.select("event_id"), t.next))


def expand_sql(scope: str, qid: str, limit: int = 10) -> str:
    part = "qid, core" if scope == "per_core" else "qid"
    return f"""
    WITH ev AS (SELECT concat('e', CAST(event_id AS VARCHAR)) AS id, t_sec, {qid} AS qid FROM m_event),
    adj AS (SELECT src AS a, dst AS b, type FROM m_edge UNION ALL SELECT dst, src, type FROM m_edge),
    one AS (SELECT e.qid, e.id AS core, e.t_sec AS core_t, a.b AS node, a.type AS relation_type FROM ev e JOIN adj a ON a.a = e.id),
    reach AS (SELECT qid, core, core_t, relation_type, node AS neighbour FROM one
      UNION SELECT o.qid, o.core, o.core_t, o.relation_type, a.b FROM one o JOIN adj a ON a.a = o.node),
    hits AS (SELECT r.*, e.t_sec FROM reach r JOIN ev e ON e.id = r.neighbour WHERE e.t_sec <> r.core_t),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY t_sec DESC, neighbour, relation_type, core) AS rank FROM hits)
    SELECT qid, core, neighbour, relation_type, round(t_sec, 2) AS t_sec, rank FROM ranked WHERE rank <= {limit}"""


def graph_events(t: Tables, *cols) -> DataFrame:
    return t.event.select(t.eid("event_id").alias("event_id"), "t_sec", *cols)


@query("G4_expand", expand_sql("per_core", "participant"))
def _(t: Tables) -> DataFrame:
    core = t.event.select(F.col("participant").alias("qid"), t.eid("event_id").alias("event_id"))
    got = graph.expand(core, graph_events(t), t.edge, hops=2, limit=10, limit_scope="per_core")
    return got.select("qid", "core", "neighbour", "relation_type", F.round("t_sec", 2).alias("t_sec"), "rank")


@query("G4_expand_global", expand_sql("global", "participant", 25))
def _(t: Tables) -> DataFrame:
    core = t.event.select(F.col("participant").alias("qid"), t.eid("event_id").alias("event_id"))
    got = graph.expand(core, graph_events(t), t.edge, hops=2, limit=25, limit_scope="global")
    return got.select("qid", "core", "neighbour", "relation_type", F.round("t_sec", 2).alias("t_sec"), "rank")


@query("G4_expand_three", """
    WITH ev AS (SELECT concat('e', CAST(event_id AS VARCHAR)) AS id, t_sec FROM m_event),
    core AS (SELECT concat('e', CAST(v.event_id AS VARCHAR)) AS core, e.t_sec AS core_t, e.participant AS qid FROM m_vec v JOIN m_event e ON e.event_id = v.event_id),
    ed AS (SELECT src, dst, type, row_number() OVER (ORDER BY src, dst, type) AS e FROM m_edge),
    adj AS MATERIALIZED (SELECT src AS a, dst AS b, type, e FROM ed UNION ALL SELECT dst, src, type, e FROM ed),
    one AS (SELECT c.*, a.b AS n, a.type AS relation_type, a.e AS e1 FROM core c JOIN adj a ON a.a = c.core),
    two AS (SELECT DISTINCT o.qid, o.core, o.core_t, o.relation_type, o.e1, a.e AS e2, a.b AS n FROM one o JOIN adj a ON a.a = o.n WHERE a.e <> o.e1),
    three AS (SELECT DISTINCT o.qid, o.core, o.core_t, o.relation_type, a.b AS n FROM two o JOIN adj a ON a.a = o.n WHERE a.e <> o.e1 AND a.e <> o.e2),
    reach AS (SELECT qid, core, core_t, relation_type, n FROM one UNION SELECT qid, core, core_t, relation_type, n FROM two UNION SELECT * FROM three),
    hits AS (SELECT r.*, e.t_sec FROM reach r JOIN ev e ON e.id = r.n WHERE e.t_sec <> r.core_t),
    ranked AS (SELECT qid, core, n AS neighbour, relation_type, t_sec, row_number() OVER (PARTITION BY qid, core ORDER BY t_sec DESC, n, relation_type) AS rank FROM hits)
    SELECT qid, core, neighbour, relation_type, round(t_sec, 2) AS t_sec, rank FROM ranked WHERE rank <= 10""")
def _(t: Tables) -> DataFrame:
    """Three steps from every event with a vector; entities have a twentieth to a tenth of all events each."""
    named = t.event.join(t.vec.select("event_id"), "event_id", "left_semi").select(F.col("participant").alias("qid"), t.eid("event_id").alias("event_id"))
    got = graph.expand(named, graph_events(t), t.edge, hops=3, limit=10)
    return got.select("qid", "core", "neighbour", "relation_type", F.round("t_sec", 2).alias("t_sec"), "rank")


@query("G5_lookups", """
    SELECT v.label AS cluster_id, e.event_id, round(e.t_sec, 2) AS t_sec, 'member' AS kind FROM m_vec v JOIN m_event e ON e.event_id = v.event_id WHERE e.t_sec <= 1500000
    UNION ALL SELECT NULL, e.event_id, round(e.t_sec, 2), 'embedded' FROM m_vec v JOIN m_event e ON e.event_id = v.event_id
    UNION ALL SELECT DISTINCT label, NULL, NULL, 'cluster' FROM m_vec""")
def _(t: Tables) -> DataFrame:
    members = t.vec.select(F.col("label").alias("cluster_id"), "event_id")
    inside = graph.cluster_events(members, t.event.select("event_id", "t_sec"), asof=1500000.0)
    embedded = graph.events_with_vectors(t.event.select("event_id", "participant", "t_sec"), t.vec.select("event_id", "vec"))
    nodes = t.vec.select(F.col("label").alias("id")).distinct().withColumn("label", F.lit("Cluster"))
    at = F.round("t_sec", 2).alias("t_sec")
    return (
        inside.select("cluster_id", "event_id", at, F.lit("member").alias("kind"))
        .unionByName(embedded.select("event_id", at, F.lit("embedded").alias("kind")), allowMissingColumns=True)
        .unionByName(graph.clusters(nodes).select(F.col("id").alias("cluster_id"), F.lit("cluster").alias("kind")), allowMissingColumns=True)
    )


@query("A1_graph_summary", """
    SELECT 'node' AS kind, label AS name, count(*) AS n FROM m_entity GROUP BY 2 UNION ALL SELECT 'node', 'Event', count(*) FROM m_event
    UNION ALL SELECT 'edge', type, count(*) FROM m_edge GROUP BY 2 UNION ALL SELECT 'linked', 'entities', count(DISTINCT dst) FROM m_edge WHERE type = 'INVOLVES'""")
def _(t: Tables) -> DataFrame:
    nodes = t.entity.select("label").unionByName(t.event.select(F.lit("Event").alias("label")))
    return graph.graph_summary(nodes, t.edge)


@query("A10_related_person", f"""
    WITH {SPEECH_OBJECTS_SQL}
    SELECT s.global_voice, o.global_name AS person_key, count(DISTINCT s.event_id) AS events FROM m_speech s JOIN objs o ON o.event_id = s.event_id AND o.description = s.description
    WHERE s.speaker IS NOT NULL AND o.global_name LIKE 'person%' AND s.global_voice IS NOT NULL GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    persons = speech_objects(t).where(F.startswith("global_name", F.lit("person_"))).select("event_id", "description", F.col("global_name").alias("person_key"))
    return links.related_person(t.speech.where("speaker IS NOT NULL").join(persons, ["event_id", "description"]))


@query("A22_entity_rollup", """
    WITH m AS (SELECT o.global_name, o.event_id, o.pos, e.t_sec, e.caption FROM m_object o JOIN m_event e ON e.event_id = o.event_id)
    SELECT global_name, count(*) AS match_count, round(min(t_sec), 2) AS first_t, round(max(t_sec), 2) AS last_t, last(caption ORDER BY t_sec, event_id, pos) AS latest_description, count(DISTINCT caption) AS descriptions FROM m GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    mentions = t.object.join(t.event.select("event_id", "t_sec", F.col("caption").alias("description")), "event_id")
    got = links.entity_rollup(mentions)
    return got.withColumns({"first_t": F.round("first_t", 2), "last_t": F.round("last_t", 2)})


@query("A11_speaker_rollup", f"""
    WITH {SPEECH_OBJECTS_SQL},
    spent AS (SELECT event_id, speaker, sum(end_time - start_time) AS d FROM m_speech WHERE speaker IS NOT NULL AND end_time - start_time >= 2.0 GROUP BY 1, 2),
    said AS (SELECT event_id, speaker, string_agg(text, '' ORDER BY pos) AS txt FROM m_speech WHERE speaker IS NOT NULL GROUP BY 1, 2),
    d1 AS (SELECT event_id, speaker, description, min(pos) AS p FROM m_speech WHERE speaker IS NOT NULL AND coalesce(description, '') <> '' GROUP BY 1, 2, 3),
    d2 AS (SELECT event_id, speaker, string_agg(description, '|' ORDER BY p) AS descs FROM d1 GROUP BY 1, 2),
    a1 AS (SELECT event_id, action, min(pos) AS p FROM objs WHERE action <> '' GROUP BY 1, 2),
    a2 AS (SELECT event_id, string_agg(action, '|' ORDER BY p) AS acts FROM a1 GROUP BY 1)
    SELECT spent.event_id, spent.speaker, round(d, 6) AS total_duration, md5(txt) AS text_md5, coalesce(descs, '') AS descriptions, coalesce(acts, '') AS actions
    FROM spent JOIN said USING (event_id, speaker) LEFT JOIN d2 USING (event_id, speaker) LEFT JOIN a2 USING (event_id)""")
def _(t: Tables) -> DataFrame:
    segments = speech.speaker_segments(t.speech, 2.0, keep_null=False, duration=None)
    got = speech.speaker_rollup(segments, t.speech, speech_objects(t))
    return got.select(
        "event_id", "speaker", r6("total_duration").alias("total_duration"), F.md5("language_text").alias("text_md5"),
        F.array_join("descriptions", "|").alias("descriptions"), F.array_join("actions", "|").alias("actions"),
    )
