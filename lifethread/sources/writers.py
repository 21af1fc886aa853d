"""Writers of graphs, events and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lifethread import schemas
from lifethread.runtime import materialize


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, mode: str = "append") -> None:
    """Nodes by label and edges by type, so that readers prune what they do not walk.

    Rows are dealt by ranges of (label, id) and (type, src), cut from a sample and joined by size: a large label gets as many files as its rows need,
    small ones share a task, and files hold neighbouring keys.
    """
    nodes.repartitionByRange("label", "id").write.mode(mode).partitionBy("label").parquet(f"{path}/nodes")
    edges.repartitionByRange("type", "src").write.mode(mode).partitionBy("type").parquet(f"{path}/edges")


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.NODE).parquet(f"{path}/nodes")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EDGE).parquet(f"{path}/edges")


def merge_membership(edges: DataFrame, path: str) -> None:
    """Cluster membership both ways, each edge once however often it is written.

    ``edges`` has src (event) and dst (cluster). Only edges the store lacks are appended.
    """
    spark = edges.sparkSession
    inside = edges.select(F.col("src").cast("string"), F.col("dst").cast("string")).dropDuplicates()
    props = F.create_map().cast("map<string, string>").alias("props")
    both = inside.select("src", "dst", F.lit("BELONGS_TO").alias("type"), props).unionByName(
        inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("CONTAINS").alias("type"), props)
    )
    stored = read_edges(spark, path).where(F.col("type").isin("BELONGS_TO", "CONTAINS")).select("src", "dst", "type")
    both.join(stored, ["src", "dst", "type"], "left_anti").write.mode("append").partitionBy("type").parquet(f"{path}/edges")


_CLUSTER_EDGES = ("BELONGS_TO", "CONTAINS")


def reset_graph(spark: SparkSession, path: str, scope: str = "all") -> None:
    """Empty the graph: everything, only events, or only clusters, with the edges that hang on them.

    Edges without an end among the nodes that go stay, whatever their type. The folders of types that lose edges are replaced by what
    stays, from a stored table; the others are not touched.
    """
    if scope not in ("all", "events", "clusters"):
        raise ValueError("scope is 'all', 'events' or 'clusters'")
    if scope == "all":
        for schema, part in ((schemas.NODE, "nodes"), (schemas.EDGE, "edges")):
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/{part}")
        return
    label = "Event" if scope == "events" else "Cluster"
    gone = materialize(read_nodes(spark, path).where(F.col("label") == label).select(F.col("id").alias("_gone")), "gone")
    edges = read_edges(spark, path)
    edges = edges.where(F.col("type").isin(*_CLUSTER_EDGES)) if scope == "clusters" else edges
    stay = edges if scope == "events" else edges.limit(0)
    for end in ("src", "dst"):
        stay = stay.join(gone, F.col(end) == F.col("_gone"), "left_anti")
    stay = materialize(stay, "staying")
    types = [r["type"] for r in edges.select("type").distinct().toLocalIterator()]  # one per folder
    _empty_partitions(spark, f"{path}/nodes", "label", [label])
    _empty_partitions(spark, f"{path}/edges", "type", types)
    write_graph(read_nodes(spark, path).limit(0), stay, path)


def _empty_partitions(spark: SparkSession, path: str, column: str, values: Sequence[str]) -> None:
    """Drop the folders of some partition values through Hadoop's file system, wherever the store lies."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(path)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for value in values:
        fs.delete(jvm.org.apache.hadoop.fs.Path(base, f"{column}={value}"), True)


def enrich_events(
    events: DataFrame, names: DataFrame | None = None, voices: DataFrame | None = None, relations: DataFrame | None = None
) -> DataFrame:
    """Events with global names on objects, voices on speech, and relations.

    ``names``: event_id, pos, global_name; ``voices``: event_id, pos, global_voice; ``relations``: event_id,
    related_event_id, type, reason, time_diff_seconds. Relations of an event without new ones stay.
    """
    out = events

    def placed(df: DataFrame, value: str) -> DataFrame:
        return df.groupBy("event_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("pos").cast("int"), value))).alias("_m"))

    for df, value, field in ((names, "global_name", "interaction_object"), (voices, "global_voice", "interaction_language")):
        if df is None:
            continue
        out = out.join(placed(df, value), "event_id", "left")
        found = lambda i: F.try_element_at(F.col("_m"), i)
        items = F.transform(
            f"attributes.{field}", lambda o, i: o.withField(value, F.coalesce(found(i), o[value]))
        )
        out = out.withColumn("attributes", F.col("attributes").withField(field, items)).drop("_m")
    if relations is not None:
        cols = ["related_event_id", "type", "reason", "time_diff_seconds"]
        new = relations.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("_r"))
        empty = F.array().cast(events.schema["relations"].dataType)
        out = out.join(new, "event_id", "left").withColumn("relations", F.coalesce("_r", "relations", empty)).drop("_r")
    return out.select(*events.columns)


def write_events(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partitions: Sequence[str] = ("participant", "day")
) -> None:
    """Events by participant and day (or one of them), in time order, as Parquet or as JSON lines."""
    keyed = df.withColumns({"participant": F.col("metadata.person_name"), "day": F.col("metadata.day")})
    keyed = keyed.repartition(*partitions).sortWithinPartitions(*partitions, "timestamp")
    keyed.write.mode(mode).partitionBy(*partitions).format(fmt).save(path)


def rttm_lines(segments: DataFrame, recording: str = "recording_id") -> DataFrame:
    """One RTTM line per speaker segment."""
    line = F.format_string(
        "SPEAKER %s 0 %.3f %.3f <NA> <NA> %d <NA> <NA>", F.col(recording).cast("string"),
        F.bround("start", 3), F.bround(F.col("end") - F.col("start"), 3), F.col("label").cast("int"),
    )
    return segments.select(line.alias("value"))


def write_rttm(segments: DataFrame, path: str, recording: str = "recording_id") -> None:
    rttm_lines(segments, recording).write.mode("overwrite").text(path)


def segment_records(segments: DataFrame, recording: str = "recording_id") -> DataFrame:
    """Segments as records named ``recording_start_end``."""
    short = lambda c: F.round(c, 3).cast("string")
    key = F.concat_ws("_", F.col(recording).cast("string"), short(F.col("start")), short(F.col("end")))
    return segments.select(key.alias("id"), "start", F.col("end").alias("stop"), F.col("label").alias("speaker"))


def write_segments_json(segments: DataFrame, path: str, recording: str = "recording_id") -> None:
    segment_records(segments, recording).write.mode("overwrite").json(path)


def write_scores(trials: DataFrame, path: str) -> None:
    """``enrol test label score`` with five decimals."""
    line = F.format_string("%s %s %s %.5f", *[F.col(c).cast("string") for c in ("enrol", "test", "target")], F.col("score"))
    trials.select(line.alias("value")).write.mode("overwrite").text(path)


def write_cluster_stats(profile: DataFrame, path: str) -> None:
    """Cluster statistics without vectors."""
    profile.drop("vec").write.mode("overwrite").json(path)
