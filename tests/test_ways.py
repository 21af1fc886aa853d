"""The distributed ways give what the small ways give, and streams give what batches give."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lifethread.operators import blocks, clustering, density, fold_ranges, graph, intervals, ordered, resolve, similarity, spectral, vector_index
from lifethread.operators.history import best_rows
from lifethread.plans import retrieval
from lifethread.plans.catalog import state
from lifethread.runtime import materialize
from lifethread.streaming import streams


def same(a, b):
    key = lambda df: sorted(map(str, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))
    assert key(a) == key(b)


def test_scans_cut_into_ranges(spark, tables):
    """One key holds most rows, so its scan crosses many ranges."""
    hot = tables.event.select(F.when(F.col("k") % 5 == 0, F.col("participant")).otherwise(F.lit(-1)).alias("participant"), "event_id", "t_sec", "k", "event_type")
    hot = hot.withColumn("t", F.col("t_sec"))
    for run in (
        lambda s: intervals.active_runs(hot.withColumn("active_count", F.col("k") % 3), ["participant"], split=s),
        lambda s: intervals.score_runs(hot.withColumn("score", F.col("k") % 11 / F.lit(10.0)), keys=["participant"], split=s),
        lambda s: intervals.label_runs(hot.withColumnRenamed("event_type", "label"), keys=["participant"], gap=9000.0, split=s),
        lambda s: graph.build_chains(hot.select("participant", "event_id", "t_sec"), split=s),
        lambda s: ordered.OrderedScan(hot.select("participant", "event_id", "k"), ["participant"], ["event_id"], s)
        .position("n").running_sum(total=F.col("k")).running_max(inclusive=False, top=F.col("k")).following_max(rest=F.col("k")).previous(before=F.col("k")).result(),
    ):
        same(run(False), run(True))


@pytest.mark.parametrize("by", [[], ["label"]])
def test_topk_ways(spark, tables, by):
    corpus = tables.vectors
    queries = corpus.withColumnRenamed("id", "qid")
    ways = ["blocks"] if by else ["corpus", "queries", "blocks"]
    got = [
        {(r["qid"], r["rank"]): (r["id"], r["sim"]) for r in similarity.cosine_topk(queries, corpus, 4, by=by, way=w, block_rows=90).collect()} for w in ways
    ]
    vec = np.array([r["vec"] for r in corpus.orderBy("id").collect()], dtype=float)
    label = np.array([r["label"] for r in corpus.orderBy("id").collect()])
    sims = np.round((vec / np.linalg.norm(vec, axis=1, keepdims=True)) @ (vec / np.linalg.norm(vec, axis=1, keepdims=True)).T, 9)
    if by:
        sims = np.where(label[:, None] == label[None, :], sims, -9)
    for one in got:
        assert len(one) == len(vec) * 4
        for q in range(0, len(vec), 37):
            best = np.lexsort((np.arange(len(vec)), -sims[q]))[:4]
            assert [one[(q, i + 1)][0] for i in range(4)] == best.tolist()


@pytest.mark.parametrize("way", ["queries", "blocks"])
def test_topk_lists_merge_as_a_tree(spark, tables, way):
    """With a dozen reading tasks and lists merged three at a time, ties included, the rows are those of one task."""
    corpus = tables.vectors.select("id", F.transform("vec", lambda v: F.round(v, 0)).alias("vec"))
    corpus = corpus.unionByName(corpus.withColumn("id", F.col("id") + 100_000)).repartition(12)
    queries = corpus.where("id % 3 = 0").withColumnRenamed("id", "qid")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        got = similarity.cosine_topk(queries, corpus, 5, way=way, block_rows=200, fan=3)
        assert got.where("rank <= 5").count() == 5 * queries.where("vec IS NOT NULL").count()
        same(got, similarity.cosine_topk(queries, corpus, 5, way="corpus"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_merged_lists_meet_few_rows(spark, monkeypatch):
    """However many lists: a merge of one question is over at most ``fan * k`` rows."""
    rows = spark.range(3 * 1000 * 4).selectExpr("id % 3 AS qid", "CAST(id DIV 12 AS INT) AS _list", "(id * 7919) % 997 AS sim", "id")
    order = [F.col("sim").desc(), F.col("id")]
    same(blocks.merged_lists(rows, ["qid"], order, 4, 1000, 10), best_rows(rows.drop("_list"), ["qid"], order, 4))
    steps = []
    for_step = lambda df, keys, *rest, **how: steps.append((keys, df.groupBy(*keys).count().agg(F.max("count")).first()[0])) or best_rows(df, keys, *rest, **how)
    monkeypatch.setattr(blocks, "best_rows", for_step)
    blocks.merged_lists(rows, ["qid"], order, 4, 1000, 10)
    assert [k for k, _ in steps] == [["qid", "_list"], ["qid", "_list"], ["qid"]] and all(n <= 40 for _, n in steps)


def test_density_ways(spark, tables):
    given = tables.vectors.select("id", "vec", (F.col("id") % 2).alias("g"))
    same(
        density.hdbscan(given, min_cluster_size=4, min_samples=2, by=["g"]),
        density.hdbscan(given, min_cluster_size=4, min_samples=2, by=["g"], task_rows=10, block_rows=120),
    )


def test_spectral_ways(spark, monkeypatch):
    """Both ways give the same labels, also with copies, equal distances and ids that come again in other recordings."""
    monkeypatch.setattr(spectral, "SETTLED", 1e-5)
    rng = np.random.default_rng(4)
    rows = []
    for rec, many in enumerate((2, 3)):
        centres = np.linalg.qr(rng.normal(size=(6, 6)))[0][:many]
        for i in range(18 * many):
            v = centres[i % many] + (rng.normal(size=6) * 0.15 if i % 3 else 0.0)  # every third is a copy of its centre
            rows.append((rec, i, v.tolist()))
    points = spark.createDataFrame(rows, "rec int, id long, vec array<double>").repartition(3)
    small = clustering.spectral(points, ["rec"], p=0.3, max_speakers=4)
    large = clustering.spectral(points, ["rec"], p=0.3, max_speakers=4, task_rows=4)
    same(small, large)
    truth = {(r, i): i % (2 + r) for r, i, _ in rows}
    assert len({(x.rec, x.label, truth[(x.rec, x.id)]) for x in small.collect()}) == 5
    one = np.array([[0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [1.0, 1.0]] * 3)  # equal distances everywhere
    flat = spark.createDataFrame([(0, i, v.tolist(), 2) for i, v in enumerate(one)], "rec int, id long, x array<double>, k int")
    got = {r.id: r.label for r in spectral.kmeans_rounds(flat, ["rec"], 2).collect()}
    assert [got[i] for i in range(12)] == clustering.kmeans(one, 2).tolist()


def test_multiplication_by_tiles(spark):
    """The Laplacian from tiles of edges that cut recordings and pieces that cut rows is that of the whole matrix."""
    rng = np.random.default_rng(9)
    want, edges, rows = {}, [], []
    for rec, n in (("a", 7), ("b", 10)):
        a, x = np.triu(np.round(rng.random((n, n)), 3) * (rng.random((n, n)) < 0.6), 1), rng.random((n, 3))
        a += a.T
        edges += [(rec, int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))]
        rows += [(rec, i, x[i].tolist()) for i in range(n)]
        y = np.diag(a.sum(axis=1)) @ x - a @ x
        want |= {(rec, i): y[i] for i in range(n)}
    block = spark.createDataFrame(rows, "rec string, id long, x array<double>")
    laplacian = spectral._Laplacian(spark.createDataFrame(edges, "rec string, i long, j long, affinity double"), block, ["rec"], 3, tile=4, piece=5)
    assert laplacian.tiles.agg(F.max(F.length("cols"))).first()[0] <= 5 * 4
    got = {(r.rec, r.id): r.y for r in laplacian.times(block, "x", "y").collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_ids_of_a_recording_only(spark):
    """The same ids in two recordings: linkage by joins and small clusters find only neighbours of their own recording."""
    rng = np.random.default_rng(6)
    centres = np.eye(4)
    rows = [(rec, i, (centres[(i + rec) % 3] + rng.normal(size=4) * 0.05).tolist()) for rec in range(2) for i in range(13 + 8 * rec)]
    points = spark.createDataFrame(rows, "rec int, id long, vec array<double>").repartition(3)
    same(clustering.ahc(points, ["rec"]), clustering.ahc(points, ["rec"], task_rows=4))
    marked = points.withColumn("label", F.when((F.col("id") < 2) & (F.col("rec") == 0), 9).otherwise((F.col("id") + F.col("rec")) % 3).cast("int"))
    got = {(r.rec, r.id): r.label for r in clustering.absorb_minor(marked, ["rec"], 2).collect()}
    assert got == {(rec, i): (i + rec) % 3 for rec, i, _ in rows}


def _pruned(rows, p, least):
    """Affinity of the rows (rec, id, vec) of one recording, entry by entry."""
    n = len(rows)
    keep = n - min(int(np.floor((1.0 - p) * n)), n - least)
    rows = [(i, np.array(v, dtype=float)) for _, i, v in rows if v is not None]
    rows = [(i, v / (np.linalg.norm(v) or 1.0)) for i, v in rows]
    found = {}
    for i in {i for i, _ in rows if i is not None}:
        entries = [(round(float(x @ y), 9), j) for k, x in rows if k == i for j, y in rows]
        entries.sort(key=lambda e: (-e[0], e[1] is None, e[1]))
        for sim, j in entries[:keep]:
            if j is not None and j != i:
                for pair in ((i, j), (j, i)):
                    found[pair] = found.get(pair, 0.0) + sim / 2
    return found


def test_pruned_affinity_leaves_a_block_final(spark):
    """Ties, copies, repeated ids, rows without id, vector or recording; the kept entries are neither sorted nor grouped afterwards."""
    rng = np.random.default_rng(2)
    vecs = np.round(rng.normal(size=(90, 3)), 0).tolist()
    rows = [("a", i, v) for i, v in enumerate(vecs[:40])] + [("b", i, v) for i, v in enumerate(vecs[40:])]
    rows += [("a", 3, vecs[50]), ("a", 3, vecs[3]), ("b", 7, vecs[47]), ("a", None, vecs[8]), ("b", 99, None), (None, 5, vecs[5]), ("c", 1, vecs[0])]
    got = similarity.knn_prune(spark.createDataFrame(rows, "rec string, id long, vec array<double>"), ["rec"], p=0.3, block_rows=16)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "sum(" not in plan
    found = {(r["rec"], r["i"], r["j"]): round(r["affinity"], 6) for r in got.collect()}
    want = {(rec, *pair): round(v, 6) for rec in "abc" for pair, v in _pruned([r for r in rows if r[0] == rec], 0.3, 6).items()}
    assert len(want) > 1000 and found == want


def test_unsettled_vectors_are_an_error(spark, monkeypatch):
    points = spark.createDataFrame([(0, i, [float(i % 5 == j) + i / 40 for j in range(5)]) for i in range(20)], "rec int, id long, vec array<double>")
    monkeypatch.setattr(spectral, "_residual", lambda *_: 1.0)
    monkeypatch.setattr(spectral, "PATIENCE", 1)
    with pytest.raises(RuntimeError, match="did not settle"):
        clustering.spectral(points, ["rec"], p=0.3, max_speakers=2, task_rows=4)


def test_stored_index(spark, tables, tmp_path):
    """A few probes find nine of ten of the exact best rows, over all rows; with the second pass all of them, also under a time bound."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + rng.normal(size=16) * 0.5).tolist(), float(i % 7)) for i in range(2000)] + [(5000, None, 0.0)]
    corpus = spark.createDataFrame(rows, "id bigint, vec array<double>, t double").repartition(4)
    queries = corpus.where("vec IS NOT NULL").selectExpr("id AS qid", "vec", "t + 1 AS qt")
    index = vector_index.build_index(corpus, str(tmp_path / "a"), keep=["t"])
    assert index.vectors.count() == 2000 and index.centres.agg({"rows": "sum"}).first()[0] == 2000 and index.centres.count() <= 45
    want = {(r.qid, r.id) for r in similarity.cosine_topk(queries, corpus, 5).collect()}
    found = vector_index.index_topk(queries, index, 5, probes=6)
    assert len(want & {(r.qid, r.id) for r in found.collect()}) >= 0.9 * len(want)
    same(vector_index.index_topk(queries, index, 5, probes=2, exact=True, block_rows=300), similarity.cosine_topk(queries, corpus, 5))
    timed = {"query_t": "qt", "corpus_t": "t", "exclude_self": True}
    same(vector_index.index_topk(queries, index, 3, 0.2, probes=1, exact=True, **timed), similarity.cosine_topk(queries, corpus, 3, 0.2, **timed))
    again = vector_index.read_index(spark, str(tmp_path / "a"))
    assert again.vectors.count() == 2000
    none = vector_index.build_index(corpus.limit(0), str(tmp_path / "b"), keep=["t"])
    assert vector_index.index_topk(queries, none, 5).count() == 0 == vector_index.index_topk(queries, none, 5, exact=True).count()


def test_index_pairs_are_bounded_by_probes(spark, tmp_path, monkeypatch):
    """Vectors without clusters, so that most cells stay open: only the probed cells become rows, and the rows found are the exact ones."""
    rng = np.random.default_rng(11)
    corpus = spark.createDataFrame([(i, rng.normal(size=12).tolist()) for i in range(400)], "id long, vec array<double>").repartition(3)
    index = vector_index.build_index(corpus, str(tmp_path / "index"))
    queries = corpus.where("id % 4 = 0").withColumnRenamed("id", "qid")
    sizes = []

    def counted(df, tag):
        out = materialize(df, tag)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(vector_index, "materialize", counted)
    want = similarity.cosine_topk(queries, corpus, 5)
    for sent in (blocks.may_be_sent, lambda df, _: df.count() == 100, lambda *_: False):
        monkeypatch.setattr(blocks, "may_be_sent", sent)
        same(vector_index.index_topk(queries, index, 5, probes=2, exact=True, block_rows=64), want)
    assert index.centres.count() > 10 and max(sizes) <= 100 * 5


def test_rotations_have_plans_of_one_size(spark):
    """Products and rotations are those of the matrices, and their plans, which the driver keeps, do not grow with the number of vectors."""
    rng, plans = np.random.default_rng(5), []
    for width in (3, 12):
        x, lx, turn = rng.random((20, width)), rng.random((20, width)), rng.random((2, width, width))
        rows = [(i % 2, i, x[i].tolist(), lx[i].tolist()) for i in range(20)]
        block = spark.createDataFrame(rows, "rec int, id long, x array<double>, lx array<double>").repartition(3)
        for r in spectral._products(block, ["rec"], width).collect():
            own = x[r.rec::2]
            assert np.allclose(r.g, (own.T @ own).ravel()) and np.allclose(r.h, (own.T @ lx[r.rec::2]).ravel())
        turns = spark.createDataFrame([(k, turn[k].ravel().tolist()) for k in range(2)], "rec int, turn array<double>")
        turned = spectral._rotated(block, ["rec"], turns, width)
        for r in turned.collect():
            assert np.allclose(r.x, x[r.id] @ turn[r.rec]) and np.allclose(r.lx, lx[r.id] @ turn[r.rec])
        plans.append(len(turned._jdf.queryExecution().optimizedPlan().toString()))
    assert plans[1] < 1.2 * plans[0]


def test_paths_are_joined_before_their_events_are_rows(spark, tables):
    """A path of n events is one row in the join with its last event, not n rows that each carry the path."""
    from lifethread.plans.catalog.registry import _QUERIES

    plan = _QUERIES["G3_all_paths"](tables)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.find("posexplode") < plan.find("Join")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "event_id string")
    edges = spark.createDataFrame([("a", "b", "NEXT_EVENT"), ("a", "c", "NEXT_EVENT")], "src string, dst string, type string")
    assert sorted(r.path for r in graph.all_paths(nodes, edges, explode=False).collect()) == [["a", "b"], ["a", "c"]]


def test_retrieval_with_a_stored_index(spark, tables, tmp_path):
    graph_, asked = tables.graph, tables.question.where("k % 4 = 0")
    index = vector_index.build_index(graph_.events, str(tmp_path / "events"), cid="event_id", keep=["t_sec"])
    for asof in ("post", "pre"):
        plain, stored = retrieval.Config(asof=asof), retrieval.Config(asof=asof, index=index, probes=3)
        got = [retrieval.retrieve_core(asked, graph_, c).withColumn("similarity", F.round("similarity", 6)) for c in (plain, stored)]
        assert got[0].count() > 0
        same(*got)


@pytest.mark.parametrize("kind", ["ties", "repeated ids"])
def test_density_ways_on_equal_distances(spark, kind):
    """Many equal weights: both ways take edges in the same order and give the same labels."""
    rng = np.random.default_rng(3)
    if kind == "ties":
        rows = [(i % 2, i, v) for i, v in enumerate(rng.integers(-1, 2, (60, 3)).tolist())]
    else:
        near = rng.normal(size=(4, 6))
        rows = [(i % 2, i // 2, (near[i % 4] + rng.normal(size=6) * 0.1).tolist()) for i in range(64)]
    given = spark.createDataFrame([(g, i, [float(x) for x in v]) for g, i, v in rows] + [(0, 999, None)], "g int, id bigint, vec array<double>")
    got = [density.hdbscan(given, min_cluster_size=3, min_samples=2, by=["g"], task_rows=n, **how) for n, how in ((3000, {}), (4, {"block_rows": 25}))]
    assert got[0].count() == len(rows) and got[0].where("label >= 0").count() > 0
    same(*got)


def test_condensed_tree_of_a_chain(spark):
    """A hierarchy as deep as it has points: stretches and selection need rounds by the logarithm of the depth only."""
    n = 400
    angles = np.cumsum(np.linspace(1e-3, 6e-3, n))
    rows = [(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angles)]
    given = spark.createDataFrame(rows, "id bigint, vec array<double>")
    same(density.hdbscan(given, min_cluster_size=5, min_samples=1), density.hdbscan(given, min_cluster_size=5, min_samples=1, task_rows=10))


def test_linkage_ways(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(3, 8))
    data = [(0, i, (centres[i % 3] + rng.normal(size=8) * 0.2).tolist()) for i in range(24)]
    given = spark.createDataFrame(data, "rec int, id bigint, vec array<double>")
    same(clustering.ahc(given, ["rec"], 0.5), clustering.ahc(given, ["rec"], 0.5, task_rows=4))


@pytest.mark.parametrize("who", ["CAST(NULL AS BIGINT)", "CASE WHEN event_id % 3 = 0 THEN 1 ELSE participant + 2 END"])
def test_hot_participant_in_ranges(spark, tables, who):
    """One participant with all or a third of the rows: ranges folded apart give the rows of one fold."""
    segments = state.spoken(tables).withColumn("participant", F.expr(who)).cache()
    whole = resolve.resolve_voices(segments, state.VOICE_RULES).cache()
    got = resolve.resolve_voices(segments, state.VOICE_RULES, range_rows=150).cache()
    same(got, whole)
    assert whole.where("not is_new").count() > 5 and whole.where("is_new").count() > 5
    objects = state.seen_objects(tables).withColumn("participant", F.expr(who)).cache()
    whole = resolve.resolve_entities(objects, state.ENTITY_RULES).cache()
    same(resolve.resolve_entities(objects, state.ENTITY_RULES, range_rows=300), whole)
    assert whole.where("not is_new").count() > 5 and whole.where("error is not null").count() > 0


def test_ranges_of_few_voices(spark):
    """Returning voices, histories beyond their bound, newcomers in the middle: few rounds, the rows of one fold."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16))
    data = []
    for i in range(240):
        v = centres[int(rng.integers(0, 3 if i < 100 else 6))] + rng.normal(size=16) * 0.3
        data.append((7, i, "s", float(i // 2), i % 2, float(rng.uniform(0.5, 4)), v.tolist()))
    given = spark.createDataFrame(data, "participant int, event_id int, speaker string, t_sec double, pos int, duration double, vec array<double>")
    whole = resolve.resolve_voices(given).cache()
    same(resolve.resolve_voices(given, range_rows=50), whole)
    assert whole.select("voice_id").distinct().count() == 6


def test_a_long_key_has_few_ranges(spark, monkeypatch):
    """However many rows a key has, rounds are over at most ``MOST_RANGES`` ranges; rows are those of one fold."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 8))
    data = [(7, i, "s", float(i), 0, 2.0, (centres[int(rng.integers(0, 5))] + rng.normal(size=8) * 0.2).tolist()) for i in range(300)]
    given = spark.createDataFrame(data, "participant int, event_id int, speaker string, t_sec double, pos int, duration double, vec array<double>")
    folded, seen = fold_ranges._judged, []
    monkeypatch.setattr(fold_ranges, "_judged", lambda rows, *rest: (seen.append(rows.agg(F.max("_range")).first()[0]), folded(rows, *rest))[1])
    same(resolve.resolve_voices(given, range_rows=4), resolve.resolve_voices(given))
    assert 0 < max(seen) < 8


def test_stream_equals_batch(spark, tables):
    from lifethread.plans.catalog.registry import _QUERIES

    same(_QUERIES["ST3_stream_resolve"](tables), _QUERIES["C12_resolve_voices"](tables))
    same(_QUERIES["ST3_stream_entities"](tables), _QUERIES["C10_resolve_entities"](tables))
    assert resolve.VoiceRules() != state.VOICE_RULES


def lots(tables, path, given, job):
    """``job`` over a folder that gets one of ``given`` before each run; every run goes on from the run before."""
    from lifethread.streaming import streams

    streams.use_rocksdb(tables.spark)
    accounts = []
    for rows in given:
        rows.write.mode("append").parquet(f"{path}/in")
        out = job(tables.spark.readStream.schema(rows.schema).parquet(f"{path}/in"))
        accounts.append(streams.run_to_table(out, f"{path}/table", f"{path}/checkpoint").collect())
    return tables.spark.read.schema(out.schema).parquet(f"{path}/table"), accounts


def test_stream_begins_with_a_library(spark, tables, tmp_path):
    """Early rows by the batch, its library stored, later rows by the stream in two runs: the decisions of one batch over all rows."""
    from lifethread.streaming import streams

    spoken = state.spoken(tables)
    a, b = spoken.approxQuantile("t_sec", [0.35, 0.7], 0.0)
    segments = spoken.withColumn("lot", F.when(F.col("t_sec") < a, 0).when(F.col("t_sec") < b, 1).otherwise(2)).cache()
    parts = [segments.where(F.col("lot") == i).drop("lot") for i in range(3)]
    assert all(p.count() > 5 for p in parts)
    library = resolve.voice_library(parts[0], state.VOICE_RULES).cache()
    got, _ = lots(tables, f"{tmp_path}/v", parts[1:], lambda df: streams.stream_resolve(df, state.VOICE_RULES, begin=library))
    late = segments.where("lot > 0").select("event_id")
    same(got.drop("match_score"), resolve.resolve_voices(segments, state.VOICE_RULES).join(late, "event_id", "left_semi").drop("match_score"))

    seen = state.seen_objects(tables)
    half = seen.approxQuantile("t_sec", [0.5], 0.0)[0]
    objects = seen.withColumn("lot", (F.col("t_sec") >= half).cast("int")).cache()
    known = resolve.entity_library(objects.where("lot = 0"), state.ENTITY_RULES).cache()
    given = [objects.where("lot = 1").drop("lot")]
    assert known.count() > 0 and given[0].count() > 5
    got, _ = lots(tables, f"{tmp_path}/e", given, lambda df: streams.stream_entities(df, state.ENTITY_RULES, begin=known))
    late = objects.where("lot = 1").select("event_id").distinct()
    whole = resolve.resolve_entities(objects, state.ENTITY_RULES).join(late, "event_id", "left_semi")
    keep = ["participant", "event_id", "pos", "global_name", "is_new", "error"]
    same(got.select(*keep), whole.select(*keep))


def test_chain_predicate_sees_batch_values(spark, tables, tmp_path):
    """Times, days, nulls, arrays and decimals of stored chain ends are what the batch fold shows."""
    from lifethread.streaming import streams

    events = tables.event.select(
        (F.col("participant") % 5).alias("participant"), "event_id", "t_sec", F.col("t_sec").cast("timestamp").alias("at"),
        F.col("t_sec").cast("timestamp").cast("date").alias("day"), F.when(F.col("k") % 3 == 0, F.col("value")).alias("maybe"),
        F.array(F.col("k"), F.col("k") % 2).alias("pair"), F.col("value").cast("decimal(12,2)").alias("exact"), F.when(F.col("k") % 4 == 0, F.col("event_type")).alias("kind"),
    )

    def fits(new, tail):
        import pandas as pd

        apart = (new["at"] - tail["at"]).total_seconds() <= 15 * 86400 and (new["day"] - tail["day"]).days <= 14
        alike = pd.isna(new["maybe"]) == pd.isna(tail["maybe"]) and int(new["pair"][1]) == int(tail["pair"][1])
        return apart and alike and (new["exact"] < 90 or tail["exact"] < 90) and (tail["kind"] is None or tail["kind"] != "error")

    edge = events.agg((F.max("t_sec") / 4).alias("q")).first()["q"]
    given = [events.where((F.col("t_sec") >= i * edge) & ((F.col("t_sec") < (i + 1) * edge) | F.lit(i == 3))) for i in range(4)]
    got, _ = lots(tables, f"{tmp_path}/c", given, lambda df: streams.stream_chains(df, fits))
    whole = graph.build_chains(events, fits)
    assert whole.count() > 20
    same(got, whole)


def test_chains_of_a_stream_handle_plain_rows():
    """No frame is made for a key; null times come last, and stored ends keep their values over batches."""
    from pyspark.sql import types as T

    schema = T.StructType.fromDDL("who long, event_id long, t_sec double, at timestamp, value int")
    rows = streams._Rows(schema, ("who", "event_id"))
    held = []
    state = SimpleNamespace(get=lambda: iter(list(held)), put=lambda x: held.__setitem__(slice(None), x))
    near = lambda new, tail: new["value"] % 2 == tail["value"] % 2 and (new["at"] - tail["at"]).total_seconds() <= 10
    chains = streams._Chains(near, "who", "event_id", "t_sec", rows)
    chains.init(SimpleNamespace(getListState=lambda name, kind: state))
    made = lambda *given: [Row(who=7, event_id=e, t_sec=t, at=None if t is None else int(t * 1_000_000), value=v) for e, t, v in given]
    got = lambda given: [(r["participant"], r["src"], r["dst"]) for r in chains.handleInputRows((7,), iter(given), None)]
    assert got(made((3, 3.0, 1), (9, None, 1), (1, 1.0, 1), (2, 2.0, 2))) == [(7, 1, 3)]
    assert [x[1] for x in held] == [2, 3, 9]
    assert got(made((5, 12.5, 1), (4, 4.0, 2), (6, 14.5, 2))) == [(7, 2, 4), (7, 3, 5)]
    assert [x[1] for x in held] == [9, 4, 5, 6] and held[1] == (7, 4, 4.0, 4_000_000, 2)


def test_best_above_sorts_few(monkeypatch):
    rng = np.random.default_rng(4)
    longest, argsort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, **how: longest.append(len(a)) or argsort(a, **how))
    for size in (0, 1, 2, 3, 4, 400):
        sims = np.r_[np.round(rng.normal(size=size), 1), np.full(int(size > 3), np.nan)]
        want = [int(i) for i in argsort(-sims, kind="stable") if sims[i] > 0.3][:3]
        assert resolve.best_above(sims, 0.3, 3) == want
    library = resolve.EntityLibrary(resolve.EntityRules(text_threshold=-1.0))
    longest.clear()
    for vector in rng.normal(size=(300, 8)):
        library.match(resolve._unit(vector), [], {})
        library.create("object1", "view", vector)
    assert max(longest) <= 3


def test_three_hops_use_no_edge_twice(spark):
    nodes = [("a", 1.0), ("b", 2.0), ("c", 3.0), ("d", 4.0)]
    events = spark.createDataFrame(nodes, "event_id string, t_sec double")
    edges = spark.createDataFrame([("a", "x", "INVOLVES"), ("b", "x", "INVOLVES"), ("b", "c", "NEXT_EVENT"), ("c", "d", "NEXT_EVENT")], "src string, dst string, type string")
    core = spark.createDataFrame([("q", "a")], "qid string, event_id string")
    got = lambda h: sorted((r["neighbour"], r["relation_type"]) for r in graph.expand(core, events, edges, hops=h).collect())
    assert got(1) == [] and got(2) == [("b", "INVOLVES")] and got(3) == [("b", "INVOLVES"), ("c", "INVOLVES")]
    core = spark.createDataFrame([("q", "b")], "qid string, event_id string")
    assert got(3) == [("a", "INVOLVES"), ("c", "NEXT_EVENT"), ("d", "NEXT_EVENT")]


@pytest.mark.parametrize("scope", ["per_core", "global"])
def test_three_hops_against_walking(spark, scope):
    """Many small graphs with hubs, parallel edges, loops and equal times: bounded offers give what all trails give."""
    rng = np.random.default_rng(11)
    events, edges, cores = [], [], []
    for g in range(25):
        n = int(rng.integers(4, 14))
        t = {f"g{g}e{i}": float(rng.integers(0, 6)) for i in range(n)}
        names = [*t, f"g{g}x", f"g{g}y"]
        events += t.items()
        cores += [(g, e) for e in list(t)[: 1 + g % 3]]
        for _ in range(int(rng.integers(n, 4 * n))):
            a, b = rng.integers(0, len(names), 2)
            edges.append((names[a] if rng.random() < 0.6 else f"g{g}x", names[b], f"T{rng.integers(0, 3)}"))
    near = {}
    for i, (a, b, kind) in enumerate(edges):
        near.setdefault(a, []).append((b, kind, i))
        near.setdefault(b, []).append((a, kind, i))
    time, want = dict(events), {}
    for q, c in cores:
        seen = set()
        for b, kind, e1 in near.get(c, []):
            seen.add((b, kind))
            for d, _, e2 in near[b]:
                if e2 != e1:
                    seen.add((d, kind))
                    seen |= {(z, kind) for z, _, e3 in near[d] if e3 not in (e1, e2)}
        rows = [(-time[z], z, kind, c) for z, kind in seen if z in time and time[z] != time[c]]
        want.setdefault((q, c) if scope == "per_core" else q, []).extend(rows)
    expected = sorted((z, kind, c) for rows in want.values() for _, z, kind, c in sorted(set(rows))[:3])
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl).repartition(3)
    got = graph.expand(frame(cores, "qid int, event_id string"), frame(events, "event_id string, t_sec double"), frame(edges, "src string, dst string, type string"), 3, 3, scope)
    assert sorted((r["neighbour"], r["relation_type"], r["core"]) for r in got.collect()) == expected


@pytest.mark.parametrize("way", ["corpus", "queries", "blocks"])
def test_a_kernel_sees_bounded_tiles(spark, way):
    """However many questions and rows meet in a task, a kernel is given at most ``TILE_CELLS`` pairs at a time, and every pair once."""
    side = lambda n, name: spark.range(n).selectExpr(f"id AS {name}", "array(CAST(id % 7 AS DOUBLE), 1.0D) AS vec").coalesce(1)

    def kernel(q, c):
        return {"qid": q.ids, "n": np.full(len(q.ids), len(q.ids) * len(c.ids))}

    how = {"qid": "qid", "cid": "id", "vec": "vec", "way": way, "block_rows": 20_000}
    got = blocks.block_apply(side(3000, "qid"), side(4000, "id"), kernel, "qid long, n long", combine=lambda found: found, **how)
    assert got.agg(F.max("n")).first()[0] <= 1 << 21
    assert got.select("qid").distinct().count() == 3000


def test_long_lists_come_from_few_questions(spark):
    """Where every question may have very many rows, a block holds few questions."""
    rows = spark.range(500).selectExpr("id AS qid", "id", "array(CAST(id % 7 AS DOUBLE), 1.0D) AS vec", "0 AS g")

    def kernel(q, c):
        return {"g": np.zeros(len(q.ids), int), "qid": q.ids, "n": np.full(len(q.ids), len(q.ids))}

    got = blocks.block_best(rows, rows, kernel, "g int, qid long, n long", ["qid"], [F.col("n")], (1 << 20) // 50, qid="qid", cid="id", vec="vec", by=["g"])
    assert got.count() == 500 and got.agg(F.max("n")).first()[0] < 150


def test_temporal_rows_are_handled_as_they_are():
    """A key of few rows costs no frame; times in any order, an equal time sees none of its own."""
    kept = []
    job = streams._Temporal(2, 60.0, "event_id", "t_sec")
    job.recent = SimpleNamespace(get=lambda: iter([("1", 5.0)]), put=kept.extend)
    rows = [Row(event_id=4, t_sec=20.0), Row(event_id=3, t_sec=10.0), Row(event_id=2, t_sec=10.0)]
    got = [(r.event_id, r.related_event_id, r.time_diff_seconds) for r in job.handleInputRows((1, 1), iter(rows), None)]
    assert got == [("2", "1", 5.0), ("3", "1", 5.0), ("4", "2", 10.0), ("4", "3", 10.0)]
    assert kept == [("2", 10.0), ("3", 10.0), ("4", 20.0)]


@pytest.mark.parametrize("scope", ["per_core", "global"])
def test_two_hops_against_walking(spark, scope, monkeypatch):
    """Hubs, equal times, twice-named events, null times and types: few offers a node give what all walks give."""
    rng = np.random.default_rng(5)
    events, edges, cores = [], [], []
    for g in range(20):
        n = int(rng.integers(6, 40))
        names = [f"g{g}e{i}" for i in range(n)]
        events += [(e, None if rng.random() < 0.05 else float(rng.integers(0, 2 + g % 5))) for e in names]
        events += [(e, 1.0 + g) for e in names[::9]]
        cores += [(None if g == 3 else g, e) for e in names[: 1 + 6 * (g % 4)]]
        for _ in range(3 * n):
            a = f"g{g}x" if rng.random() < 0.6 else names[rng.integers(0, n)]
            edges.append((a, [*names, f"g{g}y"][rng.integers(0, n + 1)], None if rng.random() < 0.1 else f"T{rng.integers(0, 2)}"))
    near, time = {}, {}
    for a, b, kind in edges:
        near.setdefault(a, set()).add((b, kind))
        near.setdefault(b, set()).add((a, kind))
    for e, t in events:
        time.setdefault(e, set()).add(t)
    want = {}
    for q, c in set(cores):
        for at in time[c] - {None}:
            reach = {(z, kind) for b, kind in near.get(c, ()) for z in [b, *(d for d, _ in near[b])]}
            rows = {(-t, z, kind or "", c, at) for z, kind in reach for t in time.get(z, ()) if t is not None and t != at}
            want.setdefault((q, c) if scope == "per_core" else q, []).extend(rows)
    expected = sorted((z, kind, c) for rows in want.values() for _, z, kind, c, _ in sorted(rows)[:4])
    seen = []
    taken = graph._offers
    monkeypatch.setattr(graph, "_offers", lambda *a: seen.append(taken(*a)) or seen[-1])
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl).repartition(3)
    got = graph.expand(frame(cores, "qid int, event_id string"), frame(events, "event_id string, t_sec double"), frame(edges, "src string, dst string, type string"), 2, 4, scope)
    assert sorted((r["neighbour"], r["relation_type"] or "", r["core"]) for r in got.collect()) == expected
    assert seen[0].groupBy("src").count().agg(F.max("count")).first()[0] <= 2 * (4 + 2)


def test_linkage_asks_again_only_where_something_changed(spark, monkeypatch):
    """Tight pairs merge at once; groups that go on merging do not make the settled ones look for their nearest again."""
    rng = np.random.default_rng(3)
    settled = [(0, 1000 + i, (np.eye(64)[i // 2] + 0.001 * rng.normal(size=64)).tolist()) for i in range(80)]
    line = [(0, i, np.eye(64)[40:48][i % 8].tolist()) for i in range(8)]
    line = [(g, i, (np.array(v) + 3.0 ** (-i / 4) * np.eye(64)[50]).tolist()) for g, i, v in line]
    points = spark.createDataFrame(settled + line, "rec int, id int, vec array<double>")
    asked = []
    search = clustering.nearest_mean
    monkeypatch.setattr(clustering, "nearest_mean", lambda few, *rest: asked.append(few.count()) or search(few, *rest))
    got = clustering.ahc(points, ["rec"], threshold=0.05, task_rows=10)
    same(got, clustering.ahc(points, ["rec"], threshold=0.05))
    assert len(asked) > 2 and asked[0] == 88 and max(asked[2:]) < 12


def test_clip_files_are_written_by_many_tasks_and_not_numbered(spark, tmp_path, monkeypatch):
    import __spark_entry__ as entry
    from lifethread.plans.catalog import files
    from lifethread.sources import readers

    monkeypatch.setattr(files, "scratch_path", lambda *_: str(tmp_path / "clips"))
    monkeypatch.delattr(readers, "number_rows")
    events = spark.range(300).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "id % 60 AS user_id", "'click' AS event_type", "1.0D AS value", "'1' AS props")
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = entry.queries()["S9_scan_clips"](spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == {(i, 5) for i in range(60)}
    assert len({p.name.split("-")[1] for p in (tmp_path / "clips").rglob("part-*.txt")}) > 4
