"""Speech segments of clips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifethread.operators.ordered import OrderedScan

MIN_ASR_SECONDS = 0.5


def _usable(s, minimum: float, need_text: bool):
    keep = (s["end_time"] - s["start_time"]) >= minimum
    return keep & F.coalesce(s["text"], F.lit("")).rlike(r"(?U)\S") if need_text else keep


def filter_asr(
    df: DataFrame, minimum: float = MIN_ASR_SECONDS, need_text: bool = True, col: str = "speech_segments"
) -> DataFrame:
    """Keep segments that are long enough and, on request, say something; count the others."""
    kept = F.filter(F.col(col), lambda s: _usable(s, minimum, need_text))
    before = F.size(F.coalesce(F.col(col), F.array()))
    return df.withColumns({"removed": before - F.size(F.coalesce(kept, F.array())), col: kept})


def speaker_segments(
    df: DataFrame, minimum: float, keep_null: bool = True, duration: str | None = "media_duration",
    split: bool | None = None,
) -> DataFrame:
    """Segments cut to the clip, short ones dropped, keyed by speaker.

    One row per kept segment (event_id, pos, speaker_key, start_time, end_time). A segment without
    a speaker is a speaker of its own: null_0, null_1 ... in the order of the clip.
    """
    if duration is not None:
        inside = lambda c: F.when(F.col(duration).isNull(), c).otherwise(
            F.greatest(F.lit(0.0), F.least(c, F.col(duration)))
        )
        df = df.withColumns({c: inside(F.col(c)) for c in ("start_time", "end_time")})
    kept = df.where(F.col("end_time") - F.col("start_time") >= minimum)
    named = kept.where(F.col("speaker").isNotNull()).withColumn("speaker_key", F.col("speaker"))
    if not keep_null:
        return named
    alone = OrderedScan(kept.where(F.col("speaker").isNull()), ["event_id"], ["pos"], split).position("_n").result()
    alone = alone.withColumn("speaker_key", F.concat(F.lit("null_"), (F.col("_n") - 1).cast("string"))).drop("_n")
    return named.unionByName(alone)


def speaker_rollup(segments: DataFrame, speech: DataFrame, objects: DataFrame | None = None) -> DataFrame:
    """Per speaker of a clip the time spoken, the words in order, and the distinct descriptions.

    ``segments`` is the output of P12 and gives the time; words and descriptions come from all speech
    of the same speaker, short segments included. With ``objects`` the distinct actions of the clip are
    added. One output row is one speaker in one clip.
    """
    spent = segments.groupBy("event_id", F.col("speaker_key").alias("speaker")).agg(
        F.sum(F.col("end_time") - F.col("start_time")).alias("total_duration")
    )
    lines = speech.where(F.col("speaker").isNotNull()).groupBy("event_id", "speaker").agg(
        F.sort_array(F.collect_list(F.struct("pos", "text", "description"))).alias("_lines")
    )
    said = lines.select(
        "event_id", "speaker",
        F.array_join(F.transform("_lines", lambda s: F.coalesce(s["text"], F.lit(""))), "").alias("language_text"),
        F.array_distinct(
            F.filter(F.transform("_lines", lambda s: s["description"]), lambda d: F.coalesce(d, F.lit("")) != "")
        ).alias("descriptions"),
    )
    rolled = spent.join(said, ["event_id", "speaker"], "left").withColumns(
        {
            "language_text": F.coalesce("language_text", F.lit("")),
            "descriptions": F.coalesce("descriptions", F.array().cast("array<string>")),
        }
    )
    if objects is None:
        return rolled
    acts = objects.where(F.coalesce("action", F.lit("")) != "").groupBy("event_id", "action").agg(F.min("pos").alias("pos"))
    acts = acts.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("pos", "action"))).alias("_acts"))
    acts = acts.select("event_id", F.transform("_acts", lambda a: a["action"]).alias("actions"))
    return rolled.join(acts, "event_id", "left").withColumn(
        "actions", F.coalesce("actions", F.array().cast("array<string>"))
    )


def speaker_person(speech: DataFrame, objects: DataFrame) -> DataFrame:
    """The persons a speaker is described like; a speaker without one stands for itself."""
    told = (
        speech.where("speaker IS NOT NULL AND description IS NOT NULL AND description NOT IN ('', 'I')")
        .select("event_id", "speaker", "description").distinct()
    )
    people = objects.where(F.startswith("global_name", F.lit("person_"))).select(
        "event_id", "description", F.col("global_name").alias("_person")
    ).distinct()
    found = told.join(people, ["event_id", "description"]).select("event_id", "speaker", "_person").distinct()
    speakers = speech.where("speaker IS NOT NULL").select("event_id", "speaker").distinct()
    return speakers.join(found, ["event_id", "speaker"], "left").select(
        "event_id", "speaker", F.coalesce("_person", "speaker").alias("person_key")
    )
