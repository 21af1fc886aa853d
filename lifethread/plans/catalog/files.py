"""Sources and sinks (S1-S17): the driver's rows written in the record formats and read back."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lifethread.functions import clip_time
from lifethread.plans import pipelines
from lifethread.plans.bindings import Tables
from lifethread.plans.catalog.registry import query, r6
from lifethread.runtime import scratch_path
from lifethread.sources import cache, readers, writers


def event_records(t: Tables) -> DataFrame:
    """Events as nested records, objects and relations inside."""
    objects = t.object.groupBy("event_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("pos", "name", "global_name"))), lambda o: F.struct(o["name"].alias("name"), o["global_name"].alias("global_name"))
        ).alias("interaction_object")
    )
    rel = t.rel.groupBy(F.col("eid").alias("event_id")).agg(F.collect_list(F.struct("related_event_id", "type", "reason")).alias("relations"))
    rows = t.event.join(objects, "event_id").join(rel, "event_id", "left")
    return rows.select(
        F.concat(F.lit("E"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("event_id"), F.col("clip_ts").alias("timestamp"), "caption",
        F.struct("interaction_object", F.date_format(clip_time.clip_datetime(F.col("clip_ts")), "yyyy-MM-dd HH:mm:ss.SS").alias("interaction_time")).alias("attributes"),
        F.coalesce("relations", F.array().cast("array<struct<related_event_id:string,type:string,reason:string>>")).alias("relations"),
        F.struct(F.concat(F.lit("P"), F.col("participant").cast("string")).alias("person_name"), "day").alias("metadata"),
    )


_EID = "concat('E', lpad(CAST({0} AS VARCHAR), 8, '0'))"


@query("S1_read_events", f"""
    SELECT {_EID.format('e.event_id')} AS event_id, e.clip_ts AS stamp, e.caption, 'P' || e.participant AS person, o.pos, o.name, o.global_name,
      (SELECT count(*) FROM m_rel r WHERE r.eid = e.event_id) AS relations FROM m_event e
    JOIN (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY pos) - 1 AS p FROM m_object) o ON o.event_id = e.event_id""".replace("o.pos,", "o.p AS pos,"))
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "s1")
    event_records(t).write.json(path)
    back = readers.read_events(t.spark, path, multiline=False)
    objects = readers.event_objects(back).select("event_id", "pos", "name", "global_name")
    info = back.select("event_id", F.col("timestamp").alias("stamp"), "caption", F.col("metadata.person_name").alias("person"), F.size("relations").alias("relations"))
    return info.join(objects, "event_id")


@query("S2_read_entities", """
    WITH m AS (SELECT o.global_name, o.event_id, o.pos, e.t_sec, e.caption FROM m_object o JOIN m_event e ON e.event_id = o.event_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY global_name ORDER BY t_sec DESC, event_id DESC, pos DESC) AS rn FROM m)
    SELECT global_name, CASE WHEN global_name LIKE 'person%' THEN 'Person' ELSE 'Object' END AS label, count(*) FILTER (rn <= 5) AS descriptions, first(caption ORDER BY rn) AS description, count(*) AS match_count FROM r GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    from lifethread.operators.history import last_n
    from lifethread.operators.links import entity_rollup

    mentions = t.object.join(t.event.select("event_id", "t_sec", F.col("caption").alias("description")), "event_id")
    recent = last_n(mentions, 5, ["global_name"], ["t_sec", "event_id", "pos"])
    described = recent.groupBy("global_name").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("t_sec", "event_id", "pos", "description"))),
            lambda d: F.struct(d["description"].alias("text"), d["event_id"].cast("string").alias("source_event")),
        ).alias("descriptions")
    )
    records = described.join(entity_rollup(mentions).select("global_name", "match_count"), "global_name").select(
        F.col("global_name").alias("key"), F.struct("global_name", "descriptions", F.struct(F.col("match_count").cast("int").alias("match_count")).alias("metadata")).alias("e")
    )
    path = scratch_path(t.spark, "s2")
    # One entity per file line keeps the import parallel; a single keyed object is read the same way.
    records.select(F.to_json(F.create_map("key", "e")).alias("value")).write.text(path)
    parts = t.spark.read.text(path)
    got = readers.entities_from_text(parts)
    return got.select("global_name", "label", F.size("descriptions").cast("long").alias("descriptions"), "description", F.col("metadata.match_count").cast("long").alias("match_count"))


@query("S3_read_voices", "SELECT voice_id, row_number() OVER (PARTITION BY voice_id ORDER BY ordinal) - 1 AS ordinal, related_name FROM m_voice")
def _(t: Tables) -> DataFrame:
    entry = F.struct("related_name", F.struct(F.array(F.lit("x")).alias("event_ids"), F.lit(1).alias("count")).alias("v"))
    kept = t.voice.groupBy("voice_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", entry.alias("e")))).alias("_l"))
    path = scratch_path(t.spark, "s3")
    kept.select("voice_id", F.map_from_entries(F.transform("_l", lambda x: x["e"])).alias("related_person")).write.json(path)
    return readers.voice_names(readers.read_voices(t.spark, path, multiline=False))


@query("S4_read_asr", "SELECT CAST(event_id AS VARCHAR) AS event_id, row_number() OVER (PARTITION BY event_id ORDER BY pos) - 1 AS pos, speaker, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time, md5(text) AS text_md5 FROM m_speech")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "s4")
    t.speech.groupBy(F.col("event_id").cast("string").alias("event_id")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "start_time", "end_time", "speaker", "text"))).alias("speech_segments")
    ).write.json(path)
    got = readers.asr_segments(readers.read_asr(t.spark, path, multiline=False))
    return got.select("event_id", "pos", "speaker", r6("start_time").alias("start_time"), r6("end_time").alias("end_time"), F.md5("text").alias("text_md5"))


@query("S5_read_tracks", """
    SELECT CAST(event_id AS VARCHAR) AS event_id, candidate AS object_name, row_number() OVER (PARTITION BY event_id, candidate ORDER BY frame, x, y, w, h) - 1 AS frame_pos, CAST(frame AS DOUBLE) AS t, round(x, 6) AS x, round(w, 6) AS w FROM m_box""")
def _(t: Tables) -> DataFrame:
    frame = F.struct(F.col("frame").cast("double").alias("t"), "x", "y", "w", "h")
    objects = t.box.groupBy("event_id", "candidate").agg(F.sort_array(F.collect_list(frame)).alias("_f"))
    one = F.struct(
        F.col("candidate").alias("object_name"), F.transform("_f", lambda f: f["t"]).alias("timestep"),
        F.transform("_f", lambda f: F.array(f["x"], f["y"], f["w"], f["h"])).alias("bbox"), F.transform("_f", lambda f: F.lit(0.9)).alias("score"),
    )
    path = scratch_path(t.spark, "s5")
    objects.groupBy(F.col("event_id").cast("string").alias("event_id")).agg(F.collect_list(one).alias("objects")).write.json(path)
    got = readers.track_frames(readers.read_tracks(t.spark, path, multiline=False))
    return got.select("event_id", "object_name", "frame_pos", "t", r6("box.x").alias("x"), r6("box.w").alias("w"))


@query("S6_read_qa", """
    SELECT CAST(event_id AS VARCHAR) AS qid, event_type AS type, k % 2 = 0 AS need_name, false AS need_audio, clip_ts AS query_ts, concat('DAY', day) AS date, CASE WHEN k % 3 = 0 THEN split_part(clip_ts, '_', 2) END AS time, CASE WHEN k % 3 = 1 THEN 2 END AS times FROM m_event""")
def _(t: Tables) -> DataFrame:
    day, clock = F.split_part("clip_ts", F.lit("_"), F.lit(1)), F.split_part("clip_ts", F.lit("_"), F.lit(2))
    path = scratch_path(t.spark, "s6")
    t.event.select(
        F.col("event_id").cast("string").alias("ID"), F.col("caption").alias("question"), F.col("event_type").alias("type"), (F.col("k") % 2 == 0).alias("need_name"),
        F.struct(day.alias("date"), clock.alias("time")).alias("query_time"),
        F.struct(day.alias("date"), F.when(F.col("k") % 3 == 0, clock).alias("time"), F.when(F.col("k") % 3 == 1, F.array(clock, clock)).alias("time_list")).alias("target_time"),
    ).write.json(path)
    got = readers.read_qa(t.spark, path, multiline=False)
    return got.select("qid", "type", "need_name", "need_audio", "query_ts", "date", "time", F.when(F.col("time_list").isNotNull(), F.size("time_list")).alias("times"))


@query("S7_read_manifest", """
    SELECT 'trial' AS kind, CAST(enrol AS VARCHAR) AS a, CAST(test AS VARCHAR) AS b, target AS n FROM m_trial WHERE enrol % 10 <> 9
    UNION ALL SELECT 'reject', NULL, NULL, CAST(count(*) AS INT) FROM m_trial WHERE enrol % 10 = 9
    UNION ALL SELECT 'text', CAST(event_id AS VARCHAR), md5(trim(text)), pos FROM m_speech""")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "s7")
    label = F.when(F.col("enrol") % 2 == 0, F.col("target").cast("string")).otherwise(F.when(F.col("target") == 1, "target").otherwise("nontarget"))
    line = F.concat_ws(" ", F.col("enrol").cast("string"), F.col("test").cast("string"), F.when(F.col("enrol") % 10 != 9, label))
    t.trial.select(line.alias("value")).write.text(f"{path}/trials")
    good, bad = readers.read_manifest(t.spark, f"{path}/trials", "trials")
    said = t.speech.select(F.concat_ws(" ", F.col("event_id").cast("string"), F.col("pos").cast("string"), F.lit("1.5"), F.replace("text", F.lit("\n"), F.lit(" "))).alias("value"))
    said.write.text(f"{path}/text")
    timed, _ = readers.read_manifest(t.spark, f"{path}/text", "timed_text")
    return (
        good.select(F.lit("trial").alias("kind"), F.col("enrol").alias("a"), F.col("test").alias("b"), F.col("target").cast("long").alias("n"))
        .unionByName(bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit("reject").alias("kind"), F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"), "n"))
        .unionByName(timed.select(F.lit("text").alias("kind"), F.col("spk").alias("a"), F.md5(F.trim(F.replace("text", F.lit(" "), F.lit("\n")))).alias("b"), F.col("start").cast("long").alias("n")))
    )


@query("S7_read_lists", """
    SELECT 'key_value' AS kind, CAST(event_id AS VARCHAR) AS a, concat(caption, ' ', event_type) AS b FROM m_event
    UNION ALL SELECT 'utt_spk', concat('utt', CAST(event_id AS VARCHAR)), CAST(participant AS VARCHAR) FROM m_event WHERE k % 4 <> 3
    UNION ALL SELECT 'reject', NULL, CAST(count(*) AS VARCHAR) FROM m_event WHERE k % 4 = 3""")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "s7")
    t.event.select(F.concat_ws("  ", F.col("event_id").cast("string"), F.concat_ws(" ", "caption", "event_type")).alias("value")).write.text(f"{path}/wav")
    speaker = F.concat_ws(" ", F.col("participant").cast("string"), F.when(F.col("k") % 4 == 3, "more"))
    t.event.select(F.concat_ws("\t", F.concat(F.lit("utt"), F.col("event_id").cast("string")), speaker).alias("value")).write.text(f"{path}/utt")
    pairs, _ = readers.read_manifest(t.spark, f"{path}/wav", "key_value")
    spoken, bad = readers.read_manifest(t.spark, f"{path}/utt", "utt_spk")
    named = lambda df, kind: df.toDF("a", "b").select(F.lit(kind).alias("kind"), "a", "b")
    lost = bad.agg(F.count(F.lit(1)).cast("string").alias("b")).select(F.lit("reject").alias("kind"), F.lit(None).cast("string").alias("a"), "b")
    return named(pairs, "key_value").unionByName(named(spoken, "utt_spk")).unionByName(lost)


@query("S8_read_id_csv", "SELECT CAST(o_orderkey AS VARCHAR) AS ID, o_orderpriority AS priority, round(o_totalprice, 2) AS price FROM orders")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "s8")
    t.read("orders").select(F.col("o_orderkey").alias("ID"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price")).write.option("header", True).csv(path)
    return readers.read_id_csv(t.spark, path, "ID string, priority string, price double").withColumn("price", F.round("price", 2))


def _write_clips(counts: DataFrame, path: str) -> None:
    """A file ``participant=P/clips=N/part-*.txt`` a row, as a partitioned text table has them; in a mounted folder tasks open the files themselves,
    since Hadoop's local file system starts a process for the rights of every file and folder."""
    if re.match(r"(?!file:)\w+://", path):
        writer = counts.select(F.lit("x").alias("value"), "participant", "clips").write.partitionBy("participant", "clips")
        writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)  # tasks put their files in place, not the driver
        return
    folder = path.removeprefix("file:")

    def write(rows: Iterator[Row]) -> None:
        task = TaskContext.get().partitionId()
        for row in rows:
            who = "__HIVE_DEFAULT_PARTITION__" if row["participant"] is None else row["participant"]
            at = f"{folder}/participant={who}/clips={row['clips']}"
            os.makedirs(at, exist_ok=True)
            with open(f"{at}/part-{task:05d}.txt", "w") as clip:
                clip.write("x\n")

    os.makedirs(folder)
    counts.select("participant", "clips").foreachPartition(write)


@query("S9_scan_clips", "SELECT participant, count(*) AS clips FROM m_event GROUP BY 1")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "s9")
    # A clip file per participant stands for its clips; names carry the count.
    counts = t.event.groupBy("participant").agg(F.count(F.lit(1)).alias("clips"))
    _write_clips(counts.repartition(4 * t.spark.sparkContext.defaultParallelism, "participant"), path)  # few bytes, but a file a row: all cores write
    found = readers.scan_clips(t.spark, path, endings=(".txt",))
    part = lambda name: F.regexp_extract("path", rf"{name}=(\d+)", 1).cast("long").alias(name)
    return found.select(part("participant"), part("clips"))


@query("S10_vector_cache", "SELECT doc_id, 256 AS dimensions, false AS lost FROM documents")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "s10")
    docs = t.read("documents").select("doc_id", "text")
    cache.embed_with_cache(docs.where("doc_id % 2 = 0"), "doc_id", "text", path)
    got = cache.embed_with_cache(docs, "doc_id", "text", path)
    stored = cache.cached_vectors(t.spark, path, "bigint").groupBy("id").count().where("count > 1").select(F.col("id").alias("doc_id"), F.lit(True).alias("_twice"))
    return got.join(stored, "doc_id", "left").select("doc_id", F.size("vec").alias("dimensions"), F.coalesce("_twice", F.lit(False)).alias("lost"))


def _graph(t: Tables, path: str) -> None:
    events = t.event.select("event_id", F.col("clip_ts").alias("timestamp"), "t_sec", "caption")
    nodes, edges, _ = pipelines.build_graph(events, t.object, t.entity)
    writers.write_graph(nodes, edges, path)


@query("S11_write_graph", """
    SELECT 'INVOLVES' AS kind, count(*) AS n FROM (SELECT DISTINCT o.event_id, o.global_name FROM m_object o JOIN m_entity e ON e.global_name = o.global_name)
    UNION ALL SELECT label, count(*) FROM m_entity GROUP BY 1 UNION ALL SELECT 'Event', count(*) FROM m_event""")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "s11")
    _graph(t, path)
    count = lambda df, c: df.groupBy(F.col(c).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return count(writers.read_nodes(t.spark, path), "label").unionByName(count(writers.read_edges(t.spark, path), "type"))


@query("S12_merge_membership", "SELECT CAST(event_id AS VARCHAR) AS src, CAST(label AS VARCHAR) AS dst, 'BELONGS_TO' AS type FROM m_vec UNION ALL SELECT CAST(label AS VARCHAR), CAST(event_id AS VARCHAR), 'CONTAINS' FROM m_vec")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "s12")
    _graph(t, path)
    members = t.vec.select(F.col("event_id").alias("src"), F.col("label").alias("dst"))
    writers.merge_membership(members, path)
    writers.merge_membership(members, path)
    return writers.read_edges(t.spark, path).where("type IN ('BELONGS_TO', 'CONTAINS')").select("src", "dst", "type")


@query("S13_reset_graph", """
    SELECT label AS kind, count(*) AS n FROM m_entity GROUP BY 1
    UNION ALL SELECT CASE WHEN label = 'Person' THEN 'INVOLVES' ELSE 'NEAR' END, count(*) FROM m_entity GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    """Edges between entities stay, also those of a type that events have."""
    path = scratch_path(t.spark, "s13")
    _graph(t, path)
    kind = F.when(F.col("label") == "Person", "INVOLVES").otherwise("NEAR")
    tied = t.entity.select(F.col("global_name").alias("src"), F.lit("object_001").alias("dst"), kind.alias("type"), F.create_map().cast("map<string, string>").alias("props"))
    writers.write_graph(writers.read_nodes(t.spark, path).limit(0), tied, path)
    writers.reset_graph(t.spark, path, "events")
    nodes, edges = writers.read_nodes(t.spark, path), writers.read_edges(t.spark, path)
    both = nodes.select(F.col("label").alias("kind")).unionByName(edges.select(F.col("type").alias("kind")))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("S14_write_events", f"""
    SELECT {_EID.format('o.event_id')} AS event_id, row_number() OVER (PARTITION BY o.event_id ORDER BY o.pos) - 1 AS pos, concat('person_', lpad(CAST(o.pos + 1 AS VARCHAR), 3, '0')) AS global_name,
      (SELECT count(*) FROM m_rel r WHERE r.eid = o.event_id) AS relations FROM m_object o""")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "s14")
    event_records(t).write.json(f"{path}/in")
    events = readers.read_events(t.spark, f"{path}/in", multiline=False).drop("file_order")
    placed = readers.event_objects(events).select("event_id", "pos", "name")
    slot = F.when(F.col("name") == "object1", 1).when(F.col("name") == "human1", 2).otherwise(3)
    names = placed.select("event_id", "pos", F.concat(F.lit("person_"), F.lpad(slot.cast("string"), 3, "0")).alias("global_name"))
    writers.write_events(writers.enrich_events(events, names=names, relations=readers.event_relations(events)), f"{path}/out", partitions=("day",))
    back = t.spark.read.parquet(f"{path}/out")
    return readers.event_objects(back).select("event_id", "pos", "global_name").join(back.select("event_id", F.size("relations").alias("relations")), "event_id")


@query("S15_write_rttm", """
    SELECT printf('SPEAKER %s 0 %.3f %.3f <NA> <NA> %d <NA> <NA>', CAST(recording_id AS VARCHAR), start, "end" - start, pos) AS line, count(*) AS n FROM m_turn GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "s15")
    writers.write_rttm(t.turn.withColumn("label", F.col("pos")), path)
    return t.spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("S15_write_segments_json", """
    SELECT concat(CAST(recording_id AS VARCHAR), '/', CAST(pos AS VARCHAR)) AS id, round(start, 6) AS start, round("end", 6) AS stop, label AS speaker, true AS named FROM m_turn""")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "s15")
    turns = t.turn.withColumn("name", F.concat_ws("/", F.col("recording_id").cast("string"), F.col("pos").cast("string")))
    writers.write_segments_json(turns, path, recording="name")
    back = t.spark.read.json(path)
    name = F.regexp_extract("id", r"^(.*)_[^_]*_[^_]*$", 1)
    return back.select(name.alias("id"), F.round("start", 6).alias("start"), F.round("stop", 6).alias("stop"), "speaker", F.col("id").rlike(r"_-?\d+\.\d+_\d+\.\d+$").alias("named"))


@query("S16_write_scores", "SELECT concat(enrol, ' ', test, ' ', target, ' ', printf('%.5f', score)) AS line FROM m_scored")
def _(t: Tables) -> DataFrame:
    from lifethread.plans.catalog.groups import scored

    path = scratch_path(t.spark, "s16")
    writers.write_scores(scored(t), path)
    return t.spark.read.text(path).select(F.col("value").alias("line"))


@query("S17_write_cluster_stats", "SELECT CAST(label AS BIGINT) AS label, count(*) AS event_count, 0 AS vectors FROM m_vec GROUP BY 1")
def _(t: Tables) -> DataFrame:
    from lifethread.operators.metrics import cluster_profile

    path = scratch_path(t.spark, "s17")
    assigned = t.vec.select("event_id", "label").join(t.event.select("event_id", "t_sec", F.col("clip_ts").alias("timestamp")), "event_id")
    writers.write_cluster_stats(cluster_profile(assigned).withColumn("vec", F.array(F.lit(0.0))), path)
    back = t.spark.read.json(path)
    return back.select("label", "event_count", F.lit(int("vec" in back.columns)).alias("vectors"))
