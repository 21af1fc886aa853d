"""Readers of the record files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lifethread import schemas
from lifethread.operators.contracts import expect
from lifethread.operators.ordered import number_rows

# Media file endings.
CLIP_ENDINGS = (".mp4", ".avi", ".mov", ".mkv", ".MP4", ".AVI", ".MOV", ".MKV")


def _json(spark: SparkSession, path: str | list[str], schema: str, multiline: bool = True) -> DataFrame:
    reader = spark.read.schema(schema).option("multiLine", multiline).option("recursiveFileLookup", True)
    return reader.option("pathGlobFilter", "*.json").json(path)


def read_events(spark: SparkSession, path: str | list[str], multiline: bool = True) -> DataFrame:
    """Event records with the file each came from; ``file_order`` sorts as the files do."""
    return _json(spark, path, schemas.EVENT, multiline).withColumn("file_order", F.col("_metadata.file_path"))


def event_objects(events: DataFrame) -> DataFrame:
    """Objects of events, one row each, in record order."""
    return events.select(
        "event_id", F.posexplode("attributes.interaction_object").alias("pos", "o")
    ).select(
        "event_id", "pos", *[F.col(f"o.{c}").alias(c) for c in ("name", "description", "action", "location", "global_name")],
        *[F.coalesce(F.col(f"o.match_info.{c}"), F.lit(0.0)).alias(c) for c in ("text_similarity", "vision_similarity", "final_score")],
        F.coalesce("o.match_info.is_new", F.lit(False)).alias("is_new"),
        F.when(F.size("o.interaction_segments") > 0, F.size("o.interaction_segments")).alias("segment_count"),
    )


def event_speech(events: DataFrame) -> DataFrame:
    """Speech segments of events, one row each, in record order."""
    return events.select("event_id", F.posexplode("attributes.interaction_language").alias("pos", "s")).select("event_id", "pos", "s.*")


def event_relations(events: DataFrame) -> DataFrame:
    """Relations of events, one row each."""
    return events.select("event_id", F.inline("relations"))


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """Global entities from a file keyed by name; kind from the name's prefix.

    The file is one JSON object, so it is read by one task: an import step. Afterwards entities are a table.
    """
    return entities_from_text(spark.read.text(path, wholetext=True))


def entities_from_text(text: DataFrame) -> DataFrame:
    """Entities of keyed JSON objects, one object per row."""
    keyed = text.select(F.explode(F.from_json("value", f"map<string, struct<{_colons(schemas.ENTITY)}>>")).alias("key", "e"))
    label = F.when(F.startswith("key", F.lit("person_")), "Person").when(F.startswith("key", F.lit("object_")), "Object")
    described = F.transform("e.descriptions", lambda d: F.from_json(d, schemas.DESCRIPTION))
    return keyed.select(
        F.col("key").alias("global_name"), label.alias("label"), described.alias("descriptions"),
        "e.related_events", "e.representative_images", "e.unmatched_candidates", "e.metadata",
        F.coalesce(F.try_element_at(described, F.lit(-1))["text"], F.lit("")).alias("description"),
    )


def entity_descriptions(entities: DataFrame) -> DataFrame:
    return entities.select(F.col("global_name").alias("entity"), F.posexplode("descriptions").alias("pos", "d")).select("entity", "pos", "d.*")


def _colons(ddl: str) -> str:
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in T.StructType.fromDDL(ddl))


def read_voices(spark: SparkSession, path: str | list[str], multiline: bool = True) -> DataFrame:
    """S3: voice records; ``related_person`` keeps the order of its keys."""
    return spark.read.schema(schemas.VOICE).option("multiLine", multiline).json(path)


def voice_names(voices: DataFrame) -> DataFrame:
    """Names a voice was tied to, in file order: (voice_id, ordinal, related_name)."""
    return voices.select("voice_id", F.posexplode("related_person").alias("ordinal", "related_name", "_v")).drop("_v")


def read_asr(spark: SparkSession, path: str | list[str], multiline: bool = True) -> DataFrame:
    """Transcripts."""
    return _json(spark, path, schemas.ASR, multiline)


def asr_segments(asr: DataFrame) -> DataFrame:
    return asr.select("event_id", "duration", "language", F.posexplode("speech_segments").alias("pos", "s")).select(
        "event_id", "duration", "language", "pos", "s.*"
    )


def read_tracks(spark: SparkSession, path: str | list[str], multiline: bool = True) -> DataFrame:
    """Tracks per event."""
    return _json(spark, path, schemas.TRACK, multiline)


def track_frames(tracks: DataFrame) -> DataFrame:
    """One row per tracked frame: the parallel arrays of an object side by side."""
    objects = tracks.select("event_id", "video_path", F.inline("objects"))
    zipped = objects.select(
        "event_id", "video_path", "object_name", F.posexplode(F.arrays_zip("timestep", "bbox", "score")).alias("frame_pos", "f")
    )
    side = lambda i, n: F.get("f.bbox", F.lit(i)).alias(n)
    return zipped.select(
        "event_id", "video_path", "object_name", "frame_pos", F.col("f.timestep").alias("t"),
        F.struct(side(0, "x"), side(1, "y"), side(2, "w"), side(3, "h")).alias("box"), F.col("f.score").alias("score"),
    )


def track_of(tracks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Tracks of given (event_id, object_name) pairs."""
    return track_frames(tracks).join(wanted.select("event_id", "object_name").distinct(), ["event_id", "object_name"], "left_semi")


def read_qa(spark: SparkSession, path: str | list[str], multiline: bool = True) -> DataFrame:
    """Questions; a target may have a time, a list of times, or neither."""
    return spark.read.schema(schemas.QA).option("multiLine", multiline).json(path).select(
        F.col("ID").alias("qid"), "question", F.coalesce("type", F.lit("Unknown")).alias("type"),
        F.coalesce("need_name", F.lit(False)).alias("need_name"), F.coalesce("need_audio", F.lit(False)).alias("need_audio"),
        F.concat_ws("_", "query_time.date", "query_time.time").alias("query_ts"), "target_time.date", "target_time.time", "target_time.time_list",
    )


_MANIFESTS = {
    "key_value": ("key string, value string", 2),
    "utt_spk": ("utt string, spk string", 2),
    "trials": ("enrol string, test string, target int", 3),
    "timed_text": ("spk string, start double, end double, text string", 4),
}


def read_manifest(spark: SparkSession, path: str | list[str], kind: str) -> tuple[DataFrame, DataFrame]:
    """Whitespace lists: key_value, utt_spk, trials or timed_text; and the lines that do not fit.

    The last field of key_value and timed_text is the rest of the line. Trial labels are 0, 1, nontarget or target.
    """
    if kind not in _MANIFESTS:
        raise ValueError(f"unknown manifest: {kind}")
    ddl, width = _MANIFESTS[kind]
    open_end = kind in ("key_value", "timed_text")
    lines = spark.read.text(path).where(F.trim("value") != "").withColumnRenamed("value", "_line")
    lines = lines.withColumn("_f", F.split(F.trim("_line"), r"\s+", width if open_end else -1))
    names = [f for f in T.StructType.fromDDL(ddl)]
    values = []
    for i, f in enumerate(names):
        raw = F.get("_f", F.lit(i))
        if f.name == "target":
            raw = F.when(raw.isin("1", "target"), 1).when(raw.isin("0", "nontarget"), 0)
            values.append(raw.alias(f.name))
        else:
            values.append((raw if f.dataType == T.StringType() else raw.try_cast(f.dataType)).alias(f.name))
    parsed = lines.select("_line", F.size("_f").alias("_n"), *values)
    fits = F.col("_n") == width
    if kind == "key_value" or kind == "timed_text":
        fits = F.col("_n") >= width
    for f in names:
        fits = fits & F.col(f.name).isNotNull()
    return parsed.where(fits).drop("_line", "_n"), parsed.where(~fits).select(F.col("_line").alias("value"))


def read_id_csv(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    """A CSV manifest whose ``ID`` is there and unique; otherwise the job fails."""
    reader = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True)
    rows = (reader.schema(schema) if schema else reader).csv(path)
    if "ID" not in rows.columns:
        raise ValueError("the manifest has no column ID")
    return expect(rows, unique=[["ID"]], valid={"ID": F.col("ID").isNotNull()})


def scan_clips(
    spark: SparkSession, path: str, endings: Sequence[str] = CLIP_ENDINGS, start: int = 0, count: int | None = None
) -> DataFrame:
    """Clip files below ``path`` by name, from position ``start`` on; only names are read, no content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    wanted = F.lit(False)
    for e in endings:
        wanted = wanted | F.endswith("path", F.lit(e))
    kept = found.where(wanted)
    if start > 0 or count is not None:  # places are needed for a part of the files only
        keep = F.col("_n") > start
        if count is not None:
            keep = keep & (F.col("_n") <= start + count)
        kept = number_rows(kept, ["path"], "_n").where(keep)
    return kept.select("path", "length", F.regexp_extract("path", r"([^/]+)$", 1).alias("clip_name")).orderBy("path")
