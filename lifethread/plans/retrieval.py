"""Question answering over the event graph: one plan for all questions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifethread.operators.graph import expand
from lifethread.operators.history import asof_last, best_rows
from lifethread.operators.intervals import time_hits
from lifethread.operators.links import asof_filter, entities_of_events, merge_hits, validate_connected
from lifethread.operators.metrics import recall_report
from lifethread.operators.similarity import cosine_topk
from lifethread.operators.vector_index import VectorIndex, index_topk
from lifethread.runtime import materialize

RULER = "=" * 60


@dataclass(frozen=True)
class Graph:
    """events: event_id, timestamp, t_sec, caption, vec. entities: global_name, label, vec. edges: src, dst, type."""

    events: DataFrame
    entities: DataFrame
    edges: DataFrame

    @property
    def involves(self) -> DataFrame:
        return self.edges.where(F.col("type") == "INVOLVES").select("src", "dst")


@dataclass(frozen=True)
class Config:
    top_k: int = 6
    min_similarity: float = 0.0
    max_events_from_entities: int = 10
    core_limit: int = 20
    hops: int = 2
    expansion_limit: int = 10
    limit_scope: str = "global"
    asof: str = "post"
    snippets: int = 5
    time_window: float = 300.0
    search: dict = field(default_factory=dict)
    #: A stored index of the events' vectors (with ``t_sec`` kept for ``asof="pre"``); without it the search compares with all events.
    index: VectorIndex | None = None
    probes: int = 8
    exact: bool = True


def _event_hits(questions: DataFrame, graph: Graph, cfg: Config) -> DataFrame:
    asked = questions.where("want_event").select("qid", "vec", "query_t")
    known = graph.events.select(F.col("event_id").alias("id"), "vec", "t_sec")
    before = {"query_t": "query_t", "corpus_t": "t_sec"} if cfg.asof == "pre" else {}
    if cfg.index is None:
        top = cosine_topk(asked, known, cfg.top_k, cfg.min_similarity, **before, **cfg.search)
    else:
        top = index_topk(asked, cfg.index, cfg.top_k, cfg.min_similarity, probes=cfg.probes, exact=cfg.exact, **before, **cfg.search)
    hits = top.select("qid", F.col("id").alias("event_id"), F.col("sim").alias("similarity"))
    hits = hits.join(graph.events.select("event_id", "t_sec"), "event_id")
    return asof_filter(hits, questions).drop("query_t")


def _entity_hits(questions: DataFrame, graph: Graph, cfg: Config) -> DataFrame:
    found = None
    for label, wanted in (("Object", "want_object"), ("Person", "want_person")):
        known = graph.entities.where((F.col("label") == label) & F.col("vec").isNotNull())
        part = cosine_topk(
            questions.where(wanted).select("qid", "vec"), known.select(F.col("global_name").alias("id"), "vec"),
            cfg.top_k, cfg.min_similarity, **cfg.search,
        ).select("qid", F.col("id").alias("entity"))
        found = part if found is None else found.unionByName(part)
    return found


def events_through_entities(questions: DataFrame, entities: DataFrame, graph: Graph, m: int, split: bool | None = None) -> DataFrame:
    """Newest ``m`` events up to the question's time that involve any entity found for it.

    The newest of the union are among the newest of each entity, and those come from an as-of join by
    position, so a popular entity costs ``m`` rows per question.
    """
    times = graph.events.select(F.col("event_id").alias("src"), "t_sec")
    facts = graph.involves.distinct().join(times, "src").select(F.col("dst").alias("entity"), F.col("src").alias("event_id"), "t_sec")
    probes = entities.join(questions.select("qid", "query_t"), "qid").select("entity", "qid", "query_t")
    near = asof_last(probes, facts, ["entity"], m, split=split)
    newest = near.select("qid", "event_id", "t_sec").distinct()
    return best_rows(newest, ["qid"], [F.col("t_sec").desc(), F.col("event_id").desc()], m)


def retrieve_core(questions: DataFrame, graph: Graph, cfg: Config = Config()) -> DataFrame:
    """Core events per question: (qid, event_id, t_sec, similarity).

    ``questions`` has qid, vec, query_t, want_event, want_object, want_person. Events by similarity come
    first, those tied to a found entity if there are any; a question without events takes the newest
    events of its entities. At most ``core_limit`` newest per question.
    """
    # Each is used several times below; the hits hold at most top_k rows per question.
    questions = materialize(questions, "questions")
    events = materialize(_event_hits(questions, graph, cfg), "hits")
    found = materialize(_entity_hits(questions, graph, cfg), "hits")
    direct, _ = validate_connected(events, found, graph.involves)
    direct = direct.select("qid", "event_id", "t_sec", "similarity")
    idle = found.join(direct.select("qid").distinct(), "qid", "left_anti")
    through = events_through_entities(questions, idle, graph, cfg.max_events_from_entities)
    both = direct.unionByName(through.withColumn("similarity", F.lit(None).cast("double")))
    return best_rows(both, ["qid"], [F.col("t_sec").desc(), F.col("event_id").desc()], cfg.core_limit)


def retrieve(questions: DataFrame, graph: Graph, cfg: Config = Config(), core: DataFrame | None = None) -> DataFrame:
    """R2: core events and what the graph expands them to, one row per (question, event).

    Expanded events whose clip time is already in the core are left out; their similarity is null.
    """
    core = materialize(retrieve_core(questions, graph, cfg), "core") if core is None else core
    info = graph.events.select("event_id", "timestamp", "caption")
    wide = expand(core.select("qid", "event_id"), graph.events, graph.edges, cfg.hops, cfg.expansion_limit, cfg.limit_scope)
    more = wide.select("qid", F.col("neighbour").alias("event_id"), "t_sec").distinct().join(info, "event_id")
    return materialize(merge_hits(core.join(info, "event_id"), more), "retrieved")


def snippets(
    hits: DataFrame, questions: DataFrame, graph: Graph, k: int = 5
) -> DataFrame:
    """One text per question with its newest ``k`` events, their entities as far as asked for, and how
    many more there are."""
    sized = hits.groupBy("qid").agg(F.count(F.lit(1)).alias("_all"))
    top = best_rows(hits, ["qid"], [F.col("t_sec").desc(), F.col("event_id").desc()], k, rank="_rank")
    near = entities_of_events(graph.involves, top.select("event_id").distinct(), graph.entities)
    named = near.groupBy("event_id").agg(
        *[
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("label") == label, F.col("global_name")))), ", ").alias(f"_{label}")
            for label in ("Object", "Person")
        ]
    )
    full = top.join(named, "event_id", "left").join(questions.select("qid", "want_object", "want_person"), "qid")
    line = lambda wanted, mark, names: F.when(
        F.col(wanted) & (F.coalesce(names, F.lit("")) != ""), F.concat(F.lit(mark), names)
    )
    block = F.concat_ws(
        "\n",
        F.format_string("[%d]", F.col("_rank")),
        F.concat(F.lit("Event: "), F.coalesce("caption", F.lit("No caption"))),
        F.when(F.col("similarity").isNull(), F.lit("Similarity: N/A (expanded)")).otherwise(
            F.format_string("Similarity: %.4f", "similarity")
        ),
        line("want_object", "Object: ", F.col("_Object")),
        line("want_person", "Human: ", F.col("_Person")),
        F.concat(F.lit("Timestamp: "), F.coalesce("timestamp", F.lit("unknown"))),
        F.lit(""),
    )
    texts = full.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("_rank", block.alias("text")))).alias("_blocks"))
    more = F.when(F.col("_all") > k, F.concat(F.lit("... and "), F.col("_all") - k, F.lit(" more memory snippets\n")))
    body = F.concat_ws(
        "\n", F.lit(RULER), F.lit("Relevant Memory Snippets:"), F.lit(RULER), F.lit(""),
        F.array_join(F.transform("_blocks", lambda b: b["text"]), "\n"), more, F.lit(RULER),
    )
    return texts.join(sized, "qid").select("qid", body.alias("snippet_text"))


def evaluate(qa: DataFrame, targets: DataFrame, questions: DataFrame, graph: Graph, cfg: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """Per-question results and the recall report.

    ``qa`` has qid, type, need_name, need_audio for all questions; ``targets`` qid, target_t (P24); a
    question without target is skipped but counts as asked. Event times are compared in whole seconds.
    """
    hits = retrieve(questions, graph, cfg).withColumn("t", F.floor("t_sec"))
    near = time_hits(hits.select("qid", "is_core", "t"), targets.select("qid", F.floor("target_t").alias("target_t")), cfg.time_window)
    best = near.groupBy("qid").agg(
        F.max("is_core").alias("core_hit"), F.max(~F.col("is_core")).alias("expanded_hit"), F.min("time_diff").alias("closest_time_diff")
    )
    first = lambda core: F.slice(
        F.transform(F.reverse(F.array_sort(F.collect_list(F.when(F.col("is_core") == core, F.struct("t_sec", "timestamp"))))), lambda e: e["timestamp"]), 1, 5
    )
    listed = hits.groupBy("qid").agg(
        F.count_if("is_core").alias("core_events"), F.count_if(~F.col("is_core")).alias("expanded_events"),
        first(True).alias("core_timestamps"), first(False).alias("expanded_timestamps"),
    )
    asked = qa.join(targets.select("qid").distinct(), "qid", "left_semi")
    no = F.lit(False)
    results = (
        asked.join(best, "qid", "left").join(listed, "qid", "left")
        .withColumns({"core_hit": F.coalesce("core_hit", no), "expanded_hit": F.coalesce("expanded_hit", no)})
        .withColumn("hit", F.col("core_hit") | F.col("expanded_hit"))
    )
    return results, recall_report(results, qa)
