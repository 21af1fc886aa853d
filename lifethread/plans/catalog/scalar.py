"""Projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifethread.functions import boxes, clip_time, text, vectors
from lifethread.operators import annotation, contracts, history, speech
from lifethread.plans.bindings import Tables
from lifethread.plans.catalog.registry import query, r6

_CLOCK = "substr(clip_ts, length(clip_ts) - 7)"


@query("P1_parse_clips", f"""
    WITH n AS (SELECT *, {_CLOCK} AS c, event_type <> 'error' AS ok FROM m_event)
    SELECT event_id, ok, CASE WHEN ok THEN day END AS day, CASE WHEN ok THEN concat('P', participant) END AS person,
      CASE WHEN ok THEN CAST(substr(c,1,2) AS INT) END AS hour, CASE WHEN ok THEN CAST(substr(c,3,2) AS INT) END AS minute,
      CASE WHEN ok THEN CAST(substr(c,5,2) AS INT) END AS second, CASE WHEN ok THEN CAST(substr(c,7,2) AS INT) END AS centisecond,
      CASE WHEN ok THEN clip_ts END AS stamp FROM n""")
def _(t: Tables) -> DataFrame:
    clock = F.split_part("clip_ts", F.lit("_"), F.lit(2))
    good = F.concat(F.lit("DAY"), F.col("day").cast("string"), F.lit("_P"), F.col("participant").cast("string"), F.lit("_"), clock, F.lit(".mp4"))
    name = F.when(F.col("event_type") == "error", F.concat(F.lit("clip_"), "clip_ts", F.lit(".mp4"))).otherwise(good)
    ok, rejects = clip_time.parse_clips(t.event.select("event_id", name.alias("clip_name")))
    cols = ["day", "person", "hour", "minute", "second", "centisecond", "timestamp"]
    both = ok.select("event_id", F.lit(True).alias("ok"), *cols).unionByName(
        rejects.select("event_id", F.lit(False).alias("ok")), allowMissingColumns=True
    )
    return both.withColumnRenamed("timestamp", "stamp")


@query("P2_event_id", "SELECT event_id AS id, concat(clip_ts, '_evt') AS plain, concat(clip_ts, '_evt_', lpad(CAST(k AS VARCHAR), 4, '0')) AS numbered FROM m_event")
def _(t: Tables) -> DataFrame:
    e = t.event.select(F.col("event_id").alias("id"), F.col("clip_ts").alias("timestamp"), "k")
    e = clip_time.with_event_id(clip_time.with_event_id(e, out="plain"), "k", out="numbered")
    return e.select("id", "plain", "numbered")


@query("P3_datetime", "SELECT event_id, concat(strftime(ts, '%Y-%m-%d %H:%M:%S'), '.', right(clip_ts, 2)) AS event_time FROM m_event")
def _(t: Tables) -> DataFrame:
    e = clip_time.with_datetime(t.event, stamp="clip_ts")
    return e.select("event_id", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SS").alias("event_time"))


@query("P4_seconds", "SELECT event_id, round(t_sec, 2) AS seconds FROM m_event")
def _(t: Tables) -> DataFrame:
    return clip_time.with_seconds(t.event, "clip_ts", "s").select("event_id", F.round("s", 2).alias("seconds"))


@query("P5_seconds_safe", "SELECT event_id, CASE WHEN k % 5 IN (0, 4) THEN CAST(floor(t_sec) AS BIGINT) END AS t_whole FROM m_event")
def _(t: Tables) -> DataFrame:
    c = F.col("clip_ts")
    damaged = (
        F.when(F.col("k") % 5 == 1, F.concat(F.split_part(c, F.lit("_"), F.lit(1)), F.lit("_11")))
        .when(F.col("k") % 5 == 2, "xx").when(F.col("k") % 5 == 3, F.replace(c, F.lit("_"), F.lit("-"))).otherwise(c)
    )
    return clip_time.with_seconds_safe(t.event.select("event_id", damaged.alias("timestamp"))).select("event_id", "t_whole")


@query("P6_day", "SELECT event_id AS id, concat('DAY', day) AS day_prefix, concat('audios/DAY', day, '/', clip_ts, '.wav') AS audio_path FROM m_event")
def _(t: Tables) -> DataFrame:
    e = t.event.select(F.col("event_id").alias("id"), clip_time.event_id(F.col("clip_ts")).alias("event_id"))
    return clip_time.with_day(e).select("id", "day_prefix", "audio_path")


_KEPT = """
    WITH kept AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY pos) - 1 AS kept_pos
      FROM m_target WHERE (seg1 - 0.0) + (seg2 - 1.0) >= 4.0)
"""


@query("P7_normalize_annotation", _KEPT + """
    , first AS (SELECT event_id, coalesce(nullif(action, ''), 'unknown') AS act FROM kept WHERE kept_pos = 0)
    SELECT k.event_id, k.kept_pos AS pos, k.name, k.action,
      CASE WHEN o.o_orderstatus = 'F' THEN o.o_orderpriority ELSE f.act END AS interaction_action,
      CASE WHEN o.o_orderstatus = 'F' THEN 'kitchen' ELSE 'street' END AS interaction_location,
      CASE WHEN o.o_orderstatus = 'F' THEN 'calm' ELSE '' END AS interaction_state
    FROM kept k JOIN orders o ON o.o_orderkey = k.event_id JOIN first f ON f.event_id = k.event_id""")
def _(t: Tables) -> DataFrame:
    raw = t.target.join(t.read("orders").select(F.col("o_orderkey").alias("event_id"), "o_orderstatus", "o_orderpriority"), "event_id")
    speech_type = "array<struct<text string, description string>>"
    first = F.when(
        F.col("o_orderstatus") == "F",
        F.struct(
            "interaction_object", F.col("o_orderpriority").alias("interaction_action"), F.lit("kitchen").alias("interaction_location"),
            F.lit("calm").alias("interaction_state"), F.lit(None).cast(speech_type).alias("interaction_language"),
        ),
    )
    layouts = raw.select(
        "event_id", first.alias("attributes"), F.when(F.col("o_orderstatus") != "F", F.col("interaction_object")).alias("interaction_target"),
        F.lit("street").alias("interaction_location"), F.lit(None).cast(speech_type).alias("interaction_language"),
    )
    one = annotation.normalize_annotation(layouts)
    return one.select(
        "event_id", F.posexplode("interaction_object").alias("pos", "o"), "interaction_action", "interaction_location", "interaction_state"
    ).select("event_id", "pos", "o.name", "o.action", "interaction_action", "interaction_location", "interaction_state")


@query("P8_short_targets", _KEPT + "SELECT event_id, kept_pos AS pos, name, round((seg1 - 0.0) + (seg2 - 1.0), 6) AS seconds FROM kept")
def _(t: Tables) -> DataFrame:
    kept = annotation.filter_short_targets(t.target).select("event_id", F.posexplode("interaction_object").alias("pos", "o"))
    return kept.select("event_id", "pos", "o.name", r6(annotation.segment_seconds(F.col("o.interaction_segments"))).alias("seconds"))


@query("P9_primary_action", _KEPT + """
    SELECT o.event_id, coalesce(nullif(k.action, ''), 'unknown') AS interaction_action
    FROM (SELECT DISTINCT event_id FROM m_target) o LEFT JOIN kept k ON k.event_id = o.event_id AND k.kept_pos = 0""")
def _(t: Tables) -> DataFrame:
    return annotation.primary_action(annotation.filter_short_targets(t.target)).select("event_id", "interaction_action")


@query("P10_empty_speech", """
    WITH s AS (SELECT event_id, pos, CASE WHEN speaker IS NULL THEN '  ' ELSE text END AS text, CASE WHEN pos % 2 = 0 THEN NULL ELSE description END AS description FROM m_speech)
    SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY pos) - 1 AS kept_pos, pos AS turn FROM s
    WHERE regexp_matches(coalesce(text,''), '\\S') OR regexp_matches(coalesce(description,''), '\\S')""")
def _(t: Tables) -> DataFrame:
    said = F.when(F.col("speaker").isNull(), "  ").otherwise(F.col("text"))
    told = F.when(F.col("pos") % 2 != 0, F.col("description"))
    clips = t.speech.groupBy("event_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", said.alias("text"), told.alias("description")))).alias("interaction_language")
    )
    kept = annotation.drop_empty_speech(clips).select("event_id", F.posexplode("interaction_language").alias("kept_pos", "s"))
    return kept.select("event_id", "kept_pos", F.col("s.pos").alias("turn"))


@query("P11_filter_asr", """
    WITH s AS (SELECT event_id, end_time - start_time AS d, (end_time - start_time >= 5.0) AND speaker IS NOT NULL AS keep FROM m_speech)
    SELECT event_id, CAST(count(*) - count_if(keep) AS INT) AS removed, CAST(count_if(keep) AS INT) AS kept, round(coalesce(sum(d) FILTER (keep), 0), 6) AS seconds
    FROM s GROUP BY event_id""")
def _(t: Tables) -> DataFrame:
    said = F.when(F.col("speaker").isNotNull(), F.col("text")).otherwise("")
    clips = t.speech.groupBy("event_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "start_time", "end_time", said.alias("text")))).alias("speech_segments")
    )
    kept = speech.filter_asr(clips, 5.0)
    total = F.aggregate("speech_segments", F.lit(0.0), lambda a, s: a + (s["end_time"] - s["start_time"]))
    return kept.select("event_id", "removed", F.size("speech_segments").alias("kept"), r6(total).alias("seconds"))


@query("P12_speaker_segments", """
    WITH m AS (SELECT event_id, max(end_time) * 0.75 AS media FROM m_speech GROUP BY event_id),
    c AS (SELECT s.event_id, s.pos, s.speaker, greatest(0.0, least(start_time, media)) AS a, greatest(0.0, least(end_time, media)) AS b FROM m_speech s JOIN m ON m.event_id = s.event_id),
    k AS (SELECT * FROM c WHERE b - a >= 2.0)
    SELECT event_id, pos, coalesce(speaker, concat('null_', row_number() OVER (PARTITION BY event_id, speaker IS NULL ORDER BY pos) - 1)) AS speaker_key,
      round(a, 6) AS start_time, round(b, 6) AS end_time FROM k""")
def _(t: Tables) -> DataFrame:
    media = t.speech.groupBy("event_id").agg((F.max("end_time") * F.lit(0.75)).alias("media_duration"))
    got = speech.speaker_segments(t.speech.join(media, "event_id"), 2.0)
    return got.select("event_id", "pos", "speaker_key", r6("start_time").alias("start_time"), r6("end_time").alias("end_time"))


@query("P13_edge_type", """
    SELECT event_id, type, CASE type WHEN 'causal' THEN 'CAUSAL' WHEN 'temporal_after' THEN 'TEMPORAL_AFTER'
      WHEN 'same_activity_non_causal' THEN 'SAME_ACTIVITY' WHEN 'related_to' THEN 'RELATED_TO' ELSE upper(type) END AS edge_type, eid FROM m_rel""")
def _(t: Tables) -> DataFrame:
    return text.with_edge_type(t.rel).select("event_id", "type", "edge_type", "eid")


@query("P14_valid_judgments", "SELECT eid, type FROM m_rel WHERE type NOT IN ('no_relationship','no_causal','no_temporal')")
def _(t: Tables) -> DataFrame:
    return text.valid_judgments(t.rel).select("eid", "type")


@query("P15_contracts", """
    SELECT 'events unique:event_id' AS rule, CAST(count(*) - count(DISTINCT event_id) AS BIGINT) AS violations FROM events
    UNION ALL SELECT 'events valid:value', count_if(NOT coalesce(value < 100, false)) FROM events
    UNION ALL SELECT 'embeddings nan:embedding', count_if(len([x for x in embedding if isnan(x)]) > 0) FROM embeddings
    UNION ALL SELECT 'lineitem unique:l_orderkey,l_linenumber', count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem""")
def _(t: Tables) -> DataFrame:
    name = lambda table, df: df.select(F.concat(F.lit(table + " "), "rule").alias("rule"), F.col("violations").cast("long").alias("violations"))
    events = contracts.violations(t.read("events"), unique=[["event_id"]], valid={"value": F.col("value") < 100})
    vecs = contracts.violations(t.read("embeddings"), no_nan=["embedding"])
    lines = contracts.violations(t.read("lineitem"), unique=[["l_orderkey", "l_linenumber"]])
    return name("events", events).unionByName(name("embeddings", vecs)).unionByName(name("lineitem", lines))


@query("P16_boxes", """
    SELECT event_id, frame, round(x + w, 6) AS x2, round(y + h, 6) AS y2, round((x + w) - x, 6) AS back_w, round(x * 0.5, 6) AS half_x,
      round(greatest(0, least(x, 29)), 6) AS clip_x, round(least(w, 30 - greatest(0, least(x, 29))), 6) AS clip_w,
      round(greatest(0, least(y, 9)), 6) AS clip_y, (least(w, 30 - greatest(0, least(x, 29))) > 0 AND least(h, 10 - greatest(0, least(y, 9))) > 0) AS valid FROM m_box""")
def _(t: Tables) -> DataFrame:
    b = t.box.withColumn("box", boxes.box(boxes.XYWH, [F.col(c) for c in boxes.XYWH]))
    b = boxes.convert_boxes(b, "to_xyxy", out="corner")
    b = boxes.convert_boxes(b, "to_xywh", "corner", "back")
    b = boxes.convert_boxes(b, "scale", out="half", factor=0.5)
    b = boxes.convert_boxes(b, "clip", out="cut", width=30, height=10)
    b = boxes.convert_boxes(b, "valid", "cut", "valid")
    return b.select(
        "event_id", "frame", r6("corner.x2").alias("x2"), r6("corner.y2").alias("y2"), r6("back.w").alias("back_w"), r6("half.x").alias("half_x"),
        r6("cut.x").alias("clip_x"), r6("cut.w").alias("clip_w"), r6("cut.y").alias("clip_y"), "valid",
    )


IOU_SQL = """CASE WHEN least(x+w, dx+w) < greatest(x, dx) OR least(y+h, dy+h) < greatest(y, dy) THEN 0.0
      ELSE (least(x+w, dx+w) - greatest(x, dx)) * (least(y+h, dy+h) - greatest(y, dy))
        / (w*h + w*h - (least(x+w, dx+w) - greatest(x, dx)) * (least(y+h, dy+h) - greatest(y, dy))) END"""


@query("P17_iou", f"SELECT event_id, frame, x, dx, y, dy, round({IOU_SQL}, 6) AS iou FROM m_box")
def _(t: Tables) -> DataFrame:
    pairs = t.box.withColumns(
        {
            "box_a": boxes.box(boxes.XYWH, [F.col(c) for c in boxes.XYWH]),
            "box_b": boxes.box(boxes.XYWH, [F.col(c) for c in ("dx", "dy", "w", "h")]),
        }
    )
    return boxes.pair_iou(pairs).select("event_id", "frame", "x", "dx", "y", "dy", r6("iou").alias("iou"))


@query("P18_vectors", """
    WITH v AS (SELECT vec_id, [x * 3.0 for x in CAST(embedding AS DOUBLE[])] AS v FROM embeddings),
    u AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM v)
    SELECT a.vec_id, round(a.n, 6) AS norm, 1.0::DOUBLE AS unit_norm, round(list_dot_product(a.v, b.v), 6) AS dot,
      round(list_dot_product(a.v, b.v) / (a.n * b.n), 6) AS cosine FROM u a JOIN u b ON b.vec_id = a.vec_id + 1""")
def _(t: Tables) -> DataFrame:
    v = t.read("embeddings").select("vec_id", F.transform(vectors.as_double(F.col("embedding")), lambda x: x * 3.0).alias("vec"))
    pairs = v.withColumnRenamed("vec", "vec_a").join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec").alias("vec_b")), "vec_id")
    pairs = vectors.pair_cosine(vectors.normalize_vectors(pairs, "vec_a", "unit"))
    return pairs.select(
        "vec_id", r6(vectors.norm(F.col("vec_a"))).alias("norm"), r6(vectors.norm(F.col("unit"))).alias("unit_norm"),
        r6(vectors.dot(F.col("vec_a"), F.col("vec_b"))).alias("dot"), r6("cosine").alias("cosine"),
    )


def _responses(t: Tables, body) -> DataFrame:
    k = F.col("k")
    fenced = (
        F.when(k % 11 == 0, "oops {").when(k % 3 == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\n")))
        .when(k % 3 == 2, F.concat(F.lit("```\n"), body, F.lit("\n```"))).otherwise(body)
    )
    return t.event.select("event_id", "k", fenced.alias("response"))


@query("P19_responses", "SELECT event_id, k % 11 <> 0 AS ok, CASE WHEN k % 11 <> 0 THEN k END AS parsed_k FROM m_event")
def _(t: Tables) -> DataFrame:
    good, bad = text.parse_responses(_responses(t, F.format_string('{"k": %d}', "k")), "k INT")
    return good.select("event_id", F.lit(True).alias("ok"), F.col("parsed.k").alias("parsed_k")).unionByName(
        bad.select("event_id", F.lit(False).alias("ok"), F.lit(None).cast("int").alias("parsed_k"))
    )


@query("P20_intent_flags", """
    SELECT event_id, CASE WHEN k % 11 = 0 THEN true WHEN k % 2 = 0 THEN false ELSE true END AS want_event,
      CASE WHEN k % 11 = 0 THEN true WHEN k % 2 = 0 THEN true ELSE false END AS want_object, k % 11 = 0 AS want_person FROM m_event""")
def _(t: Tables) -> DataFrame:
    body = F.when(F.col("k") % 2 == 0, '{"event": false, "object": true}').otherwise('{"person": false}')
    return text.intent_flags(_responses(t, body)).select("event_id", "want_event", "want_object", "want_person")


_RULE = {kind: rule.replace("'", "''") for kind, rule in text.INTENT_RULES.items()}


@query("P21_classify_intent", f"""
    WITH q AS (SELECT doc_id, regexp_matches(text, '{_RULE["event"]}') AS e, regexp_matches(text, '{_RULE["object"]}') AS o, regexp_matches(text, '{_RULE["person"]}') AS p FROM documents)
    SELECT doc_id, e OR NOT (o OR p) AS want_event, o AS want_object, p AS want_person FROM q""")
def _(t: Tables) -> DataFrame:
    return text.classify_intent(t.read("documents").withColumnRenamed("text", "question")).select("doc_id", "want_event", "want_object", "want_person")


@query("P22_cluster_label", """
    WITH s AS (SELECT doc_id, split_part(replace(text, '. ', '。'), '。', 1) AS f FROM documents)
    SELECT doc_id, CASE WHEN length(f) > 50 THEN concat(substr(f, 1, 47), '...') ELSE f END AS label FROM s""")
def _(t: Tables) -> DataFrame:
    docs = t.read("documents").select("doc_id", F.replace("text", F.lit(". "), F.lit("。")).alias("summary"))
    return text.label_clusters(docs).select("doc_id", "label")


HISTORY_SQL = """
    h AS (SELECT e.event_id, e.t_sec, p.event_id AS past_event_id, p.t_sec AS past_t_sec, e.participant, e.day, p.clip_ts AS past_ts, p.caption AS past_caption,
        row_number() OVER (PARTITION BY e.event_id ORDER BY p.t_sec DESC, p.event_id DESC) AS back
      FROM m_event e JOIN m_event p ON p.participant = e.participant AND p.day = e.day AND p.t_sec < e.t_sec),
    h5 AS (SELECT *, CAST(row_number() OVER (PARTITION BY event_id ORDER BY back DESC) AS INT) AS past_pos FROM h WHERE back <= 5)
"""


@query("P23_relation_prompt", f"""
    WITH {HISTORY_SQL},
    b AS (SELECT event_id, string_agg(concat('### Event ', past_pos, chr(10), '**Event ID**: ', past_event_id, chr(10), '**Time**: ', past_ts, chr(10),
      '**Caption**: ', past_caption, chr(10), '**Location**: home'), concat(chr(10), chr(10)) ORDER BY past_pos) AS blocks FROM h5 GROUP BY event_id)
    SELECT e.event_id, concat('Now ', e.event_id, ' ', e.clip_ts, ' ', e.caption, chr(10), b.blocks) AS prompt FROM m_event e JOIN b ON b.event_id = e.event_id""")
def _(t: Tables) -> DataFrame:
    info = t.event.select(F.col("event_id").alias("past_event_id"), F.col("clip_ts").alias("event_time"), "caption")
    past = history.history(t.event.select("participant", "day", "event_id", "t_sec")).join(info, "past_event_id")
    listed = past.groupBy("event_id").agg(
        F.sort_array(F.collect_list(F.struct("past_pos", F.col("past_event_id").alias("event_id"), "event_time", "caption", F.lit("home").alias("location")))).alias("history")
    )
    now = t.event.select("event_id", F.col("clip_ts").alias("event_time"), "caption", F.lit("home").alias("location"))
    template = "Now {current_event_id} {current_time} {current_caption}\n{historical_events}"
    return text.relation_prompt(now.join(listed, "event_id"), template=template).select("event_id", "prompt")


@query("P24_target_times", f"""
    WITH c AS (SELECT event_id, k, day, {_CLOCK} AS c FROM m_event)
    SELECT event_id, 0 AS target_pos, concat('DAY', day, '_', c) AS target_ts FROM c WHERE k % 4 <> 3
    UNION ALL SELECT event_id, 1, concat('DAY', day + 1, '_', c) FROM c WHERE k % 4 = 1
    UNION ALL SELECT event_id, 1, concat('DAY', day, '_00000000') FROM c WHERE k % 4 = 2
    UNION ALL SELECT event_id, -1, 'skipped' FROM c WHERE k % 4 = 3""")
def _(t: Tables) -> DataFrame:
    clock, k = F.split_part("clip_ts", F.lit("_"), F.lit(2)), F.col("k")
    chained = F.concat(clock, F.lit("DAY"), (F.col("day") + 1).cast("string"), F.lit("_"), clock, F.lit("DAY7"))
    qa = t.event.select(
        "event_id", F.concat(F.lit("DAY"), F.col("day").cast("string")).alias("date"),
        F.when(k % 4 == 0, clock).when(k % 4 == 1, chained).alias("time"), F.when(k % 4 == 2, F.array(clock, F.lit("00000000"))).alias("time_list"),
    )
    found, skipped = text.target_times(qa)
    return found.select("event_id", "target_pos", "target_ts").unionByName(
        skipped.select("event_id", F.lit(-1).alias("target_pos"), F.lit("skipped").alias("target_ts"))
    )


@query("P25_name_entities", """
    SELECT event_id, pos, concat(CASE WHEN name LIKE '%human%' THEN 'person' ELSE 'object' END, '_',
      CASE WHEN event_id < 1000 THEN lpad(CAST(event_id AS VARCHAR), 3, '0') ELSE CAST(event_id AS VARCHAR) END) AS global_name FROM m_object""")
def _(t: Tables) -> DataFrame:
    return text.name_entities(t.object.drop("global_name"), number="event_id").select("event_id", "pos", "global_name")
