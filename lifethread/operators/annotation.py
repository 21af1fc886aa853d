"""Clip annotations to event records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_TARGET_SECONDS = 4.0


def segment_seconds(segments: Column) -> Column:
    """Summed length of segments; overlaps count twice."""
    length = lambda s: F.coalesce(s["end_time"], F.lit(0.0)) - F.coalesce(s["start_time"], F.lit(0.0))
    return F.coalesce(F.aggregate(segments, F.lit(0.0), lambda total, s: total + length(s)), F.lit(0.0))


def long_enough(objects: Column, minimum: float) -> Column:
    return F.filter(objects, lambda o: segment_seconds(o["interaction_segments"]) >= minimum)


def filter_short_targets(df: DataFrame, minimum: float = MIN_TARGET_SECONDS, col: str = "interaction_object") -> DataFrame:
    """Drop targets that were touched for less than ``minimum`` seconds in all."""
    return df.withColumn(col, long_enough(F.col(col), minimum))


def first_action(objects: Column) -> Column:
    return F.coalesce(F.nullif(F.try_element_at(objects, F.lit(1))["action"], F.lit("")), F.lit("unknown"))


def primary_action(df: DataFrame, col: str = "interaction_object", out: str = "interaction_action") -> DataFrame:
    """What the first remaining target is used for."""
    return df.withColumn(out, first_action(F.col(col)))


def _blank(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike(r"(?U)\S")


def drop_empty_speech(df: DataFrame, col: str = "interaction_language") -> DataFrame:
    """P10: drop speech that has neither words nor a description."""
    return df.withColumn(col, F.filter(F.col(col), lambda s: ~(_blank(s["text"]) & _blank(s["description"]))))


def normalize_annotation(df: DataFrame, minimum: float = MIN_TARGET_SECONDS) -> DataFrame:
    """Bring both annotation layouts to one event schema.

    Reads ``attributes`` (first layout, null in the second), ``interaction_target``,
    ``interaction_language`` and ``interaction_location`` (second layout). The second has no stated
    action or state; its action comes from the first remaining target.
    """
    first = F.col("attributes").isNotNull()
    as_object = lambda t: F.struct(
        *[F.coalesce(t[n], F.lit("")).alias(n) for n in ("name", "description", "action", "location")],
        t["interaction_segments"].alias("interaction_segments"),
    )
    empty = F.transform(F.coalesce(F.col("interaction_target"), F.array()), as_object)
    objects = F.when(
        first, F.coalesce(F.transform(F.col("attributes.interaction_object"), as_object), F.filter(empty, lambda o: F.lit(False)))
    ).otherwise(empty)
    pick = lambda inside, outside: F.when(first, inside).otherwise(outside)
    unified = df.withColumns(
        {
            "interaction_object": long_enough(objects, minimum),
            "_language": pick(F.col("attributes.interaction_language"), F.col("interaction_language")),
            "_location": F.coalesce(pick(F.col("attributes.interaction_location"), F.col("interaction_location")), F.lit("")),
            "interaction_state": pick(F.coalesce(F.col("attributes.interaction_state"), F.lit("")), F.lit("")),
        }
    ).withColumn(
        "interaction_action",
        pick(F.coalesce(F.col("attributes.interaction_action"), F.lit("unknown")), first_action(F.col("interaction_object"))),
    )
    unified = unified.withColumns({"interaction_language": F.col("_language"), "interaction_location": F.col("_location")})
    return drop_empty_speech(unified.drop("attributes", "interaction_target", "_language", "_location"))
