"""Literal expected values of the record formats and rules."""

import datetime
import json
import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lifethread.functions import boxes, clip_time, text
from lifethread.operators import clustering, contracts, density, graph, history, intervals, metrics, resolve, similarity, speech
from lifethread.plans.embedding import embed
from lifethread.runtime import scratch_path
from lifethread.sources import readers, writers
from lifethread.sources.cache import cached_vectors, embed_with_cache


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_clip_name_id_and_times(spark):
    names = spark.createDataFrame([("DAY1_A1_JAKE_11094208.mp4",), ("other.mp4",), (None,)], "clip_name string")
    ok, bad = clip_time.parse_clips(names)
    assert rows(ok, "day", "person", "hour", "minute", "second", "centisecond", "timestamp") == [(1, "A1_JAKE", 11, 9, 42, 8, "DAY1_11094208")]
    assert bad.count() == 2
    one = clip_time.with_event_id(spark.createDataFrame([("DAY1_11094208", 5)], "timestamp string, n int"), "n", out="numbered")
    one = clip_time.with_datetime(clip_time.with_seconds(clip_time.with_event_id(one)))
    assert rows(one, "event_id", "numbered", "t_sec", "event_time") == [
        ("DAY1_11094208_evt", "DAY1_11094208_evt_0005", 40182.08, datetime.datetime(2024, 1, 1, 11, 9, 42, 80000))
    ]
    stamps = spark.createDataFrame([("DAY2_12000000",)], "timestamp string")
    assert clip_time.with_seconds(stamps).first()["t_sec"] == 129600.0
    lenient = clip_time.with_seconds_safe(spark.createDataFrame([("DAY1_11094208",), ("DAY1_11",), ("xx",)], "timestamp string"))
    assert [r["t_whole"] for r in lenient.collect()] == [40182, None, None]


def test_speaker_segments(spark):
    given = spark.createDataFrame(
        [("e", 0, 0.5, 3.0, "A"), ("e", 1, 5.0, 6.0, "A"), ("e", 2, 8.0, 40.0, None), ("e", 3, 2.0, 4.5, None)],
        "event_id string, pos int, start_time double, end_time double, speaker string",
    ).withColumn("media_duration", F.lit(30.0))
    for split in (False, True):
        got = speech.speaker_segments(given, 2.0, split=split)
        assert rows(got, "speaker_key", "start_time", "end_time") == [("A", 0.5, 3.0), ("null_0", 8.0, 30.0), ("null_1", 2.0, 4.5)]


def test_boxes(spark):
    pair = spark.range(1).select(
        boxes.box(boxes.XYWH, [F.lit(v) for v in (0, 0, 2, 2)]).alias("box_a"), boxes.box(boxes.XYWH, [F.lit(v) for v in (1, 1, 2, 2)]).alias("box_b")
    )
    assert boxes.pair_iou(pair).first()["iou"] == pytest.approx(1 / 7)


def test_label_and_targets(spark):
    long = "a" * 60
    assert text.label_clusters(spark.createDataFrame([(long,)], "summary string")).first()["label"] == "a" * 47 + "..."
    qa = spark.createDataFrame([("q", "DAY3", "17044917DAY4_20593813DAY6_19483807", None), ("n", "DAY3", None, None)], "id string, date string, time string, time_list array<string>")
    found, skipped = text.target_times(qa)
    assert rows(found, "target_pos", "target_ts") == [(0, "DAY3_17044917"), (1, "DAY4_20593813"), (2, "DAY6_19483807")]
    assert skipped.count() == 1


def test_mean_positive_iou(spark):
    frames = spark.createDataFrame([("q", "c", 0.6), ("q", "c", 0.0), ("q", "c", 0.4), ("q", "d", 0.0)], "qid string, candidate string, max_iou double")
    assert rows(similarity.mean_positive_iou(frames), "candidate", "vision_similarity") == [("c", 0.5), ("d", 0.0)]


@pytest.mark.parametrize("split", [False, True])
def test_intervals(spark, split):
    seg = spark.createDataFrame([("r", 0.0, 1.5, "a"), ("r", 0.75, 2.25, "a"), ("r", 1.5, 3.0, "b")], "recording_id string, start double, end double, label string")
    assert rows(intervals.merge_segments(seg, split=split), "start", "end", "label") == [(0.0, 1.875, "a"), (1.875, 3.0, "b")]
    a = spark.createDataFrame([("r", 0.0, 2.0), ("r", 5.0, 6.0)], "recording_id string, start double, end double")
    b = spark.createDataFrame([("r", 1.0, 3.0), ("r", 6.0, 7.0)], "recording_id string, start double, end double")
    assert rows(intervals.union_intervals(a, b, split=split), "start", "end") == [(0.0, 3.0), (5.0, 7.0)]
    one = spark.createDataFrame([("r", 0.0, 3.0)], "recording_id string, start double, end double")
    assert rows(intervals.chunk_intervals(one), "chunk_start", "chunk_end") == [(0.0, 1.5), (0.75, 2.25), (1.5, 3.0)]


def test_sampling_and_history_ties(spark):
    ten = spark.range(10).select(F.lit("k").alias("k"), F.col("id").alias("pos"))
    assert [r["pos"] for r in history.sample_uniform(ten, 3, ["k"]).orderBy("pos").collect()] == [0, 3, 6]
    tied = spark.createDataFrame([("p", 1, i, t) for i, t in enumerate([1.0, 2.0, 2.0, 3.0])], "participant string, day int, event_id int, t_sec double")
    for split in (False, True):
        got = history.history(tied, 2, split=split)
        assert rows(got, "event_id", "past_pos", "past_event_id") == [(1, 1, 0), (2, 1, 0), (3, 1, 1), (3, 2, 2)]


def test_chains_with_predicate(spark):
    events = spark.createDataFrame([("p", i, float(i)) for i in range(3)], "participant string, event_id int, t_sec double")
    assert graph.build_chains(events, lambda new, tail: False).count() == 0
    chains = graph.all_chains(events, graph.build_chains(events, lambda new, tail: False))
    assert rows(graph.chain_summary(chains), "chain", "length") == [(0, 1), (1, 1), (2, 1)]
    every_other = graph.build_chains(events, lambda new, tail: (new["event_id"] - tail["event_id"]) % 2 == 0)
    assert rows(every_other, "src", "dst") == [(0, 2)]


def test_branching_paths_and_cycles(spark):
    nodes = spark.createDataFrame([(c,) for c in "abcdxy"], "event_id string")
    edges = spark.createDataFrame([("a", "b", "NEXT_EVENT"), ("b", "c", "NEXT_EVENT"), ("b", "d", "NEXT_EVENT")], "src string, dst string, type string")
    paths = graph.all_paths(nodes, edges).groupBy("path").count()
    assert sorted(tuple(r["path"]) for r in paths.collect()) == [("a", "b", "c"), ("a", "b", "d"), ("x",), ("y",)]
    loop = spark.createDataFrame([("a", "b", "NEXT_EVENT"), ("x", "y", "NEXT_EVENT"), ("y", "x", "NEXT_EVENT")], "src string, dst string, type string")
    assert rows(graph.all_chains(nodes, loop), "event_id", "chain") == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")]


def test_voice_mean_moves_from_threshold_on():
    unit = lambda c: np.array([c, np.sqrt(1 - c * c)])
    for score, moved in ((0.79, False), (0.80, True)):
        library = resolve.VoiceLibrary()
        library.hear(np.array([1.0, 0.0]), 2.0)
        number, new, got, updated, _ = library.hear(unit(score + 1e-12), 2.0)
        assert (number, new, updated) == (0, False, moved) and got == pytest.approx(score)
        assert np.linalg.norm(library.means[0]) == pytest.approx(1.0)
        assert np.allclose(library.means[0], [1.0, 0.0]) != moved


def test_voice_history_is_pruned():
    library = resolve.VoiceLibrary(resolve.VoiceRules(max_history=3))
    for i in range(6):
        library.hear(np.array([1.0, 0.01 * i]), 2.0 if i % 2 else 1.0)
    assert len(library.history[0]) <= 3


def test_entities_match_by_box():
    library = resolve.EntityLibrary()
    frame = [{"t": 0.0, "x": 0.0, "y": 0.0, "w": 2.0, "h": 2.0}]
    v = np.array([1.0, 0.0])
    assert library.see("human1", "red coat", v, frame, {})[:2] == ("person_001", True)
    near = {"red coat": {0.0: np.array([[0.0, 0.0, 2.0, 2.0]])}}
    assert library.see("human1", "red jacket", v, frame, near)[:2] == ("person_001", False)
    assert library.see("human2", "x", v, frame, near)[:2] == ("person_002", True)  # the latest text is what was looked for


def test_average_linkage_and_speaker_number():
    x = np.array([[1, 0], [0.99, 0.1], [0, 1], [0.1, 0.99]], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert clustering.average_linkage(x, 0.4).tolist() == [0, 0, 1, 1]
    assert clustering.speakers_by_gap(np.array([0.0, 0.0, 0.5, 0.6]), 1, 3) == 2
    assert clustering.merge_centres(np.array([[1.0, 0], [2.0, 0.1], [0, 1.0]]), np.array([1, 2, 1]), np.array([4, 7, 9]), 0.8).tolist() == [4, 4, 9]


def test_two_dense_groups_and_noise():
    rng = np.random.default_rng(3)
    groups = [np.array(c) + rng.normal(size=(12, 3)) * 0.01 for c in ([1.0, 0, 0], [0, 1.0, 0])]
    x = np.vstack([*groups, [[0, 0, 1.0]]])
    labels = density.tree_labels(density.spanning_tree(density.mutual_reachability(x, 4)), len(x), 5)
    assert set(labels[:12]) == {0} and set(labels[12:24]) == {1} and labels[24] == -1


def test_verification_metrics(spark):
    t = spark.createDataFrame([(i, s, y) for i, (s, y) in enumerate([(0.1, 0), (0.2, 0), (0.3, 1), (0.4, 0), (0.5, 1), (0.6, 1)])], "id int, score double, target int")
    for split in (False, True):
        assert metrics.average_precision(t, split=split).first()["average_precision"] == pytest.approx((1 + 1 + 0.75) / 3)
        curve = metrics.det_curve(t, split=split)
        assert metrics.eer(curve).first()["eer"] == pytest.approx(1 / 3)


def test_contracts(spark):
    df = spark.createDataFrame([(1, [1.0]), (1, [float("nan")])], "id int, vec array<double>")
    with pytest.raises(ValueError, match="unique:id"):
        contracts.expect(df, unique=[["id"]])
    with pytest.raises(ValueError, match="nan:vec"):
        contracts.expect(df, no_nan=["vec"])
    assert contracts.expect(df, valid={"id": F.col("id") > 0}) is df


def test_embedder_failures_and_blanks(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, " "), (3, "boom")], "id int, text string")

    def lengths(texts):
        if "boom" in texts:
            raise RuntimeError("no answer")
        return [[len(t), 0.0] for t in texts]

    got = {r["id"]: list(r["vec"]) for r in embed(docs, "id", "text", lengths, batch=1, dimensions=2).collect()}
    assert got == {1: [1.0, 0.0], 2: [0.0, 0.0], 3: [0.0, 0.0]}


def test_entity_and_voice_files(spark):
    path = scratch_path(spark, "golden")
    desc = {"text": "red cup", "action": "hold", "source_event": "e1", "timestamp": "t"}
    body = {"object_001": {"global_name": "object_001", "descriptions": [desc, json.dumps({**desc, "text": "blue cup"})], "metadata": {"match_count": 2}}}
    spark.createDataFrame([(json.dumps(body, indent=1),)], "value string").write.text(path)
    got = readers.entities_from_text(spark.createDataFrame([(json.dumps(body),)], "value string"))
    assert rows(got, "global_name", "label", "description") == [("object_001", "Object", "blue cup")]
    assert rows(readers.entity_descriptions(readers.read_entities(spark, path)), "pos", "text")[0] == (0, "red cup")
    voices = scratch_path(spark, "golden")
    record = {"voice_id": "voice_1", "related_person": {"I": {"event_ids": ["e"], "count": 1}, "person_002": {"event_ids": ["e"], "count": 1}}}
    spark.createDataFrame([(json.dumps([record]),)], "value string").coalesce(1).write.text(voices)
    assert rows(readers.voice_names(readers.read_voices(spark, voices)), "ordinal", "related_name") == [(0, "I"), (1, "person_002")]


def test_relations_of_events_stay_when_none_are_new(spark):
    rel = "array<struct<related_event_id string, type string, reason string, time_diff_seconds double>>"
    events = spark.createDataFrame([("a", [("z", "causal", "r", None)]), ("b", None)], f"event_id string, relations {rel}")
    new = spark.createDataFrame([("b", "a", "temporal_after", "x", 3.0)], "event_id string, related_event_id string, type string, reason string, time_diff_seconds double")
    got = {r["event_id"]: [x["related_event_id"] for x in r["relations"]] for r in writers.enrich_events(events, relations=new).collect()}
    assert got == {"a": ["z"], "b": ["a"]}


def test_failed_batches_are_tried_again(spark, tmp_path):
    """The cache holds what an embedder gave, not the zeros that stand for its failures; all vectors have one width."""
    docs = spark.createDataFrame([(1, "aa"), (2, "bad"), (3, " "), (4, "cccc")], "id int, text string")

    def once(texts):
        if "bad" in texts:
            raise RuntimeError("no answer")
        return [[float(len(t)), 0.0, 0.0] for t in texts]

    path = str(tmp_path / "cache")
    first = {r["id"]: list(r["vec"]) for r in embed_with_cache(docs, "id", "text", path, once, batch=1, dimensions=3).collect()}
    assert first == {1: [1, 0, 0], 2: [0, 0, 0], 3: [0, 0, 0], 4: [1, 0, 0]}
    assert sorted(r["id"] for r in cached_vectors(spark, path, "int").collect()) == [1, 3, 4]
    again = {r["id"]: list(r["vec"]) for r in embed_with_cache(docs, "id", "text", path, lambda ts: [[0.0, 2.0, 0.0] for _ in ts], batch=1, dimensions=3).collect()}
    assert again == {**first, 2: [0, 1, 0]}
    with pytest.raises(Exception, match="dimensions"):
        embed(docs, "id", "text", lambda ts: [[1.0] for _ in ts], dimensions=3).collect()


def test_unclosed_fences(spark):
    fence = "`" * 3
    rows = [(1, f'{fence}json\n{{"k": 1}}'), (2, f'so: {fence}\n{{"k": 2}}\n'), (3, f'{fence}json\n{{"k": 3}}\n{fence} more'), (4, f"{fence}json\n{{"), (5, '{"k": 5}'), (6, None)]
    good, bad = text.parse_responses(spark.createDataFrame(rows, "id int, response string"), "k INT")
    assert {r["id"]: r["parsed"]["k"] for r in good.collect()} == {1: 1, 2: 2, 3: 3, 5: 5} and sorted(r["id"] for r in bad.collect()) == [4, 6]


def test_library_call_from_another_folder(tmp_path):
    """Workers know the package although neither their folder nor their path has it."""
    code = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from lifethread.operators import clustering, density, similarity
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
rows = spark.createDataFrame([(0, i, [float(i % 3 == k) + i / 100 for k in range(3)]) for i in range(30)], "g int, id bigint, vec array<double>")
print(density.hdbscan(rows, by=["g"]).count(), clustering.ahc(rows, ["g"], 0.5).count(), similarity.cosine_topk(rows.withColumnRenamed("id", "qid"), rows, 2).count())
"""
    script = tmp_path / "call.py"
    script.write_text(code)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script), str(Path(__file__).resolve().parents[1])], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.split()[-3:] == ["30", "30", "60"]
