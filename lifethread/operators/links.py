"""Edges between events and entities, and joins along them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifethread.functions.clip_time import event_stem
from lifethread.functions.text import with_edge_type
from lifethread.runtime import materialize

CAMERA_WEARER = ("I", "person1")


def involves_edges(objects: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Event -> entity edges, the first mention in an event wins; and the mentions of unknown names.

    ``objects`` has event_id, pos, name, global_name and any further columns, which become edge properties.
    """
    props = [c for c in objects.columns if c not in ("event_id", "global_name")]
    named = objects.where(F.coalesce("global_name", F.lit("")) != "")
    first = named.groupBy("event_id", "global_name").agg(F.min_by(F.struct(*props), F.col("pos")).alias("_p"))
    edges = first.select("event_id", "global_name", *[F.col(f"_p.{c}").alias(c) for c in props])
    edges = edges.withColumnRenamed("name", "local_name").withColumn("type", F.lit("INVOLVES"))
    known = entities.select("global_name")
    return edges.join(known, "global_name", "left_semi"), edges.join(known, "global_name", "left_anti")


def voice_persons(voices: DataFrame) -> DataFrame:
    """One row per voice: its first person in file order, and whether the camera wearer is among its names.

    ``voices`` holds voice_id, ordinal, related_name.
    """
    person = F.startswith("related_name", F.lit("person_"))
    return voices.groupBy("voice_id").agg(
        F.min_by(F.when(person, F.col("related_name")), F.when(person, F.col("ordinal"))).alias("person"),
        F.max(F.col("related_name") == "I").alias("has_wearer"),
    )


def speaks_edges(speech: DataFrame, voices: DataFrame, entities: DataFrame) -> DataFrame:
    """Event -> person edges, one per speech segment; the camera wearer is nobody's entity."""
    spoken = speech.where(F.coalesce("global_voice", F.lit("")) != "")
    wearer = F.coalesce(F.col("speaker").isin(*CAMERA_WEARER), F.lit(False)) & F.col("has_wearer")
    linked = (
        spoken.join(voice_persons(voices), spoken["global_voice"] == F.col("voice_id"))
        .where(~wearer & F.col("person").isNotNull())
        .join(entities.select(F.col("global_name").alias("person")), "person", "left_semi")
    )
    return linked.drop("has_wearer").withColumns(
        {"duration": F.col("end_time") - F.col("start_time"), "type": F.lit("SPEAKS")}
    )


def relation_edges(events: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Event -> event edges and the relations whose events are not there.

    Both ends are found by clip time, that is the id without its ``_evt`` mark; events of equal clip
    time all match. ``events`` has event_id and timestamp, ``relations`` event_id, related_event_id, type.
    """
    rel = with_edge_type(relations.where(F.coalesce("related_event_id", F.lit("")) != "")).withColumns(
        {"_from": event_stem(F.col("event_id")), "_to": event_stem(F.col("related_event_id"))}
    )
    at = events.select(F.col("timestamp").alias("_ts"), F.col("event_id").alias("_id"))
    source, target = at.toDF("_from", "src"), at.toDF("_to", "dst")
    found = rel.join(source, "_from").join(target, "_to").drop("_from", "_to")
    stamps = events.select("timestamp").distinct()
    lost = rel.join(stamps.toDF("_from"), "_from", "left_anti").unionByName(
        rel.join(stamps.toDF("_from"), "_from", "left_semi").join(stamps.toDF("_to"), "_to", "left_anti")
    )
    return found, lost.drop("_from", "_to")


def events_of_entities(edges: DataFrame, entities: DataFrame, events: DataFrame, qid: Sequence[str] = ()) -> DataFrame:
    """Distinct events that involve any given entity, newest first."""
    hit = edges.join(entities.select(*qid, F.col("entity").alias("dst")), "dst").select(*qid, F.col("src").alias("event_id")).distinct()
    return hit.join(events, "event_id").orderBy(F.col("t_sec").desc(), F.col("event_id").desc())


def entities_of_events(edges: DataFrame, events: DataFrame, entities: DataFrame, qid: Sequence[str] = ()) -> DataFrame:
    """Distinct entities of given events with their label, Object or Person."""
    near = edges.join(events.select(*qid, F.col("event_id").alias("src")), "src").select(
        *qid, F.col("src").alias("event_id"), F.col("dst").alias("global_name")
    ).distinct()
    return near.join(entities.select("global_name", "label"), "global_name")


def same_activity(edges: DataFrame, events: DataFrame) -> DataFrame:
    """Events linked to a given one by SAME_ACTIVITY in either direction."""
    same = edges.where(F.col("type") == "SAME_ACTIVITY")
    both = same.select("src", "dst").unionByName(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.join(events.select(F.col("event_id").alias("src")), "src").select(
        F.col("src").alias("event_id"), F.col("dst").alias("neighbour")
    ).distinct()


def validate_connected(hits: DataFrame, found: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per question keep events that touch a found entity and entities that touch a found event.

    A question without any such event keeps all its events; one without events keeps all its entities.
    The join runs from the events, whose degree is small, never from a popular entity.
    ``hits`` has qid, event_id; ``found`` has qid, entity; ``edges`` has src (event), dst (entity).
    """
    met = (
        hits.select("qid", F.col("event_id").alias("src")).join(edges.select("src", "dst"), "src")
        .join(found.select("qid", F.col("entity").alias("dst")).distinct(), ["qid", "dst"], "left_semi")
    )
    touch = materialize(met, "connected")  # read three times below
    tied = touch.select("qid", F.col("src").alias("event_id")).distinct().withColumn("_tied", F.lit(True))
    alive = tied.select("qid").distinct().withColumn("_alive", F.lit(True))
    events = (
        hits.join(tied, ["qid", "event_id"], "left").join(alive, "qid", "left")
        .where(F.col("_tied").isNotNull() | F.col("_alive").isNull())
        .withColumn("connected", F.col("_tied").isNotNull()).drop("_tied", "_alive")
    )
    near = touch.select("qid", F.col("dst").alias("entity")).distinct().withColumn("_near", F.lit(True))
    with_hits = hits.select("qid").distinct().withColumn("_some", F.lit(True))
    entities = (
        found.join(near, ["qid", "entity"], "left").join(with_hits, "qid", "left")
        .where(F.col("_near").isNotNull() | F.col("_some").isNull()).drop("_near", "_some")
    )
    return events, entities


def asof_filter(hits: DataFrame, queries: DataFrame, t: str = "t_sec", query_t: str = "query_t") -> DataFrame:
    """Hits at or before the time of their question."""
    return hits.join(queries.select("qid", query_t), "qid").where(F.col(t) <= F.col(query_t))


def pending(events: DataFrame, done: DataFrame, key: str = "event_id") -> DataFrame:
    """Events that still have to be processed."""
    return events.join(done.select(key).distinct(), key, "left_anti")


def missing_ids(used: DataFrame, known: DataFrame, col: str) -> DataFrame:
    """Ids that are referenced but not in the store."""
    return used.where(F.col(col).isNotNull()).select(col).distinct().join(known.select(col), col, "left_anti")


def voice_pending(speech: DataFrame, voices: DataFrame) -> DataFrame:
    """Events with speech that are not done: a segment has no voice, or a voice the store lacks."""
    seen = speech.join(
        voices.select(F.col("voice_id").alias("global_voice")).distinct().withColumn("_known", F.lit(True)), "global_voice", "left"
    )
    return seen.where(F.col("_known").isNull()).select("event_id").distinct()


def with_vectors(events: DataFrame, vecs: DataFrame, kinds: Sequence[str] = ("caption", "vision", "audio")) -> DataFrame:
    """Caption, vision and audio vectors next to their event, null where there is none."""
    wide = vecs.groupBy("event_id").agg(
        *[F.first(F.when(F.col("kind") == k, F.col("vec")), ignorenulls=True).alias(f"{k}_vec") for k in kinds]
    )
    return events.join(wide, "event_id", "left")


def merge_hits(core: DataFrame, expanded: DataFrame, key: str = "timestamp", event: str = "event_id") -> DataFrame:
    """Core hits and those expanded ones whose clip time is not in the core; an expanded event comes once, events of equal clip time all stay."""
    extra = expanded.dropDuplicates(["qid", event]).join(core.select("qid", key).distinct(), ["qid", key], "left_anti")
    return core.withColumn("is_core", F.lit(True)).unionByName(extra.withColumn("is_core", F.lit(False)), allowMissingColumns=True)


def entity_rollup(mentions: DataFrame, t: str = "t_sec") -> DataFrame:
    """Match count, first and last time, latest description per entity.

    All descriptions of an entity stay rows of ``mentions``; they are never gathered into one value.
    """
    last = F.struct(F.col(t), F.col("event_id"), F.col("pos"))
    return mentions.groupBy("global_name").agg(
        F.count(F.lit(1)).alias("match_count"), F.min(t).alias("first_t"), F.max(t).alias("last_t"),
        F.max_by("description", last).alias("latest_description"),
        F.count_distinct("description").alias("descriptions"),
    )


def related_person(speech: DataFrame) -> DataFrame:
    """A10: per voice and person the number of distinct events."""
    return (
        speech.where("global_voice IS NOT NULL AND person_key IS NOT NULL")
        .groupBy("global_voice", "person_key").agg(F.count_distinct("event_id").alias("events"))
    )
