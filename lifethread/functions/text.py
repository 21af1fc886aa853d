"""Text and label expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the record format: relation type -> edge type.
EDGE_TYPES = {
    "causal": "CAUSAL",
    "temporal_after": "TEMPORAL_AFTER",
    "same_activity_non_causal": "SAME_ACTIVITY",
    "related_to": "RELATED_TO",
}
# Judgments that state no relation.
EMPTY_JUDGMENTS = ("no_relationship", "no_causal", "no_temporal")
SENTENCE_END = "。"
LABEL_CHARS = 50

# Our rules for the intent of a question, one pattern per node kind.
_EDGE = r"(^|[^\p{L}\p{N}])", r"([^\p{L}\p{N}]|$)"
INTENT_RULES = {
    "event": rf"(?i){_EDGE[0]}(happen\p{{L}}*|do|did|doing|does|done|activit\p{{L}}+|action\p{{L}}*|event\p{{L}}*|when|how){_EDGE[1]}",
    "object": rf"(?i){_EDGE[0]}(object\p{{L}}*|tool\p{{L}}*|item\p{{L}}*|thing\p{{L}}*|which|use[ds]?|using|put|hold\p{{L}}*|carry|carried){_EDGE[1]}",
    "person": rf"(?i){_EDGE[0]}(who|whom|whose|person|people|someone|anyone|everyone|name[ds]?|speak\p{{L}}*|said){_EDGE[1]}",
}

FENCE_JSON = r"(?s)```json\s*(.*?)\s*(?:```|$)"
FENCE_ANY = r"(?s)```\s*(.*?)\s*(?:```|$)"


def edge_type(relation: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in EDGE_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, relation), F.upper(relation))


def with_edge_type(df: DataFrame, col: str = "type", out: str = "edge_type") -> DataFrame:
    """Edge type of a relation type; unknown ones are upper-cased."""
    return df.withColumn(out, edge_type(F.col(col)))


def valid_judgments(df: DataFrame, col: str = "type") -> DataFrame:
    """Judgments that do state a relation."""
    return df.where(~F.col(col).isin(*EMPTY_JUDGMENTS))


def _json_text(raw: Column) -> Column:
    """The JSON inside a model response: the text itself, a json fence, or any fence; an unclosed fence runs to the end. Later ones are
    looked at only where the one before is no JSON."""
    tries = [F.trim(raw), F.regexp_extract(raw, FENCE_JSON, 1), F.regexp_extract(raw, FENCE_ANY, 1)]
    return F.coalesce(*[F.when(F.try_parse_json(t).isNotNull() & (t != ""), t) for t in tries])


def parse_responses(
    df: DataFrame, schema: str | T.StructType, col: str = "response", out: str = "parsed"
) -> tuple[DataFrame, DataFrame]:
    """Typed responses, and the rows that hold no readable JSON."""
    text = df.withColumn("_json", _json_text(F.col(col)))
    good = text.where(F.col("_json").isNotNull()).withColumn(out, F.from_json("_json", schema)).drop("_json")
    return good, text.where(F.col("_json").isNull()).drop("_json")


def intent_flags(df: DataFrame, col: str = "response") -> DataFrame:
    """P20: what to search for; an unreadable answer means everything."""
    flags = F.from_json(_json_text(F.col(col)), "event BOOLEAN, object BOOLEAN, person BOOLEAN")
    unread = _json_text(F.col(col)).isNull()
    default = {"event": True, "object": False, "person": False}
    return df.withColumns(
        {
            f"want_{kind}": F.when(unread, F.lit(True)).otherwise(F.coalesce(flags[kind], F.lit(value)))
            for kind, value in default.items()
        }
    )


def classify_intent(df: DataFrame, col: str = "question") -> DataFrame:
    """The same flags from keyword rules; events are searched when no rule fires."""
    hit = {kind: F.coalesce(F.col(col).rlike(rule), F.lit(False)) for kind, rule in INTENT_RULES.items()}
    return df.withColumns(
        {
            "want_event": hit["event"] | ~(hit["object"] | hit["person"]),
            "want_object": hit["object"],
            "want_person": hit["person"],
        }
    )


def cluster_label(summary: Column) -> Column:
    first = F.split_part(summary, F.lit(SENTENCE_END), F.lit(1))
    short = F.concat(F.substring(first, 1, LABEL_CHARS - 3), F.lit("..."))
    return F.when(F.length(first) > LABEL_CHARS, short).otherwise(first)


def label_clusters(df: DataFrame, col: str = "summary", out: str = "label") -> DataFrame:
    """First sentence as a label of at most 50 characters."""
    return df.withColumn(out, cluster_label(F.col(col)))


def relation_prompt(df: DataFrame, history: str = "history", template: str | None = None) -> DataFrame:
    """The text a relation judge is asked, one numbered block per earlier event."""
    block = lambda h, i: F.format_string(
        "### Event %d\n**Event ID**: %s\n**Time**: %s\n**Caption**: %s\n**Location**: %s",
        i + 1, h["event_id"].cast("string"), h["event_time"].cast("string"), h["caption"], h["location"],
    )
    blocks = F.concat_ws("\n\n", F.transform(F.col(history), block))
    text = F.lit(
        template
        or "Current event {current_event_id} at {current_time}, {current_location}: {current_caption}\n\n{historical_events}"
    )
    for mark, value in {
        "{current_event_id}": F.col("event_id").cast("string"),
        "{current_time}": F.col("event_time").cast("string"),
        "{current_location}": F.coalesce(F.col("location"), F.lit("")),
        "{current_caption}": F.coalesce(F.col("caption"), F.lit("")),
        "{historical_events}": blocks,
    }.items():
        text = F.replace(text, F.lit(mark), value)
    return df.withColumn("prompt", text)


def target_times(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per target time of a question, and the questions that name none.

    Reads ``date``, ``time`` and ``time_list``. A ``time`` may chain further days, as in
    ``17044917DAY4_20593813``; pieces after the first need a day and a clock part.
    """
    pieces = F.split("time", "DAY")
    chained = F.filter(
        F.transform(
            pieces,
            lambda p, i: F.when(p == "", F.lit(None).cast("string"))
            .when(i == 0, F.concat(F.col("date"), F.lit("_"), p))
            .when(F.contains(p, F.lit("_")), F.concat(F.lit("DAY"), p)),
        ),
        lambda t: t.isNotNull(),
    )
    listed = F.transform("time_list", lambda t: F.concat(F.col("date"), F.lit("_"), t))
    timed = df.withColumn("_targets", F.when(F.col("time").isNotNull(), chained).otherwise(listed))
    none = F.col("_targets").isNull()
    found = timed.where(~none).select("*", F.posexplode("_targets").alias("target_pos", "target_ts")).drop("_targets")
    return found, timed.where(none).drop("_targets")


def name_prefix(name: Column) -> Column:
    return F.when(F.lower(name).rlike("human|person"), F.lit("person")).otherwise(F.lit("object"))


def name_entities(df: DataFrame, name: str = "name", number: str = "number", out: str = "global_name") -> DataFrame:
    """P25: ``person_007`` or ``object_007``; longer numbers keep all digits."""
    n = F.col(number).cast("string")
    padded = F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n)
    return df.withColumn(out, F.concat(name_prefix(F.col(name)), F.lit("_"), padded))
