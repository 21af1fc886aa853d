"""Vector search, text and voice matching."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lifethread.functions.boxes import iou, to_xyxy
from lifethread.functions.vectors import cosine
from lifethread.operators.blocks import RANK_DIGITS, TILE_CELLS, Side, best_per_row, block_apply, block_best, block_cells, side, similarity, tie_codes
from lifethread.operators.history import best_rows, last_n, sample_uniform
from lifethread.runtime import materialize, ship

TEXT_THRESHOLD = 0.4
TEXT_CANDIDATES = 3
RECENT_DESCRIPTIONS = 5
MATCH_THRESHOLD = 0.5
VOICE_THRESHOLD = 0.5
SAMPLE_FRAMES = 5
# Rows of a block of either side where all of its pairs may leave it.
PRUNE_ROWS = 2048


def cosine_topk(
    queries: DataFrame, corpus: DataFrame, k: int, min_sim: float | None = None, *, qid: str = "qid", cid: str = "id",
    vec: str = "vec", by: Sequence[str] = (), exclude_self: bool = False, query_t: str | None = None,
    corpus_t: str | None = None, way: str | None = None, within: bool = False, score: Callable[[Side, Side], np.ndarray] = similarity,
    q_extra: Sequence[str] = (), c_extra: Sequence[str] = (), **sizes: int,
) -> DataFrame:
    """Exact cosine top-k for a batch of queries: (qid, id, sim, rank); equal scores go by lowest id.

    With ``query_t`` and ``corpus_t`` rows after the query's time are left out before the top-k; with ``by``
    only rows of equal ``by`` are compared. ``within``: an id names a row only together with ``by``; each
    (by, qid) has its own top-k, and the result has the columns ``by`` too. ``score`` may give -inf for pairs that
    need not be looked at; it finds the columns ``q_extra`` and ``c_extra`` beside the vectors.
    """
    carried = list(by) if within else []
    named = "".join(f"{b} {queries.schema[b].dataType.simpleString()}, " for b in carried)
    q_type, c_type = queries.schema[qid].dataType.simpleString(), corpus.schema[cid].dataType.simpleString()
    timed = query_t is not None and corpus_t is not None

    def kernel(q: Side, c: Side) -> dict[str, np.ndarray]:
        scores = score(q, c)
        if min_sim is not None:
            scores = np.where(scores >= min_sim, scores, -np.inf)
        if exclude_self:
            scores = np.where(q.ids[:, None] == c.ids[None, :], -np.inf, scores)
        if timed:
            scores = np.where(c.cols[corpus_t][None, :] > q.cols[query_t][:, None], -np.inf, scores)
        row, col = best_per_row(scores, tie_codes(c.ids), k)
        return {"qid": q.ids[row], "id": c.ids[col], "sim": scores[row, col], **{b: q.cols[b][row] for b in carried}}

    def combine(found: pa.Table) -> pa.Table:
        qids, ids, sims = (np.asarray(found.column(n).to_pandas()) for n in ("qid", "id", "sim"))
        group = pd.factorize(qids, use_na_sentinel=False)[0]
        order = np.lexsort((tie_codes(ids), -sims, group))
        group = group[order]
        first = np.r_[True, group[1:] != group[:-1]]
        place = np.arange(len(group)) - np.maximum.accumulate(np.where(first, np.arange(len(group)), 0))
        return found.take(pa.array(order[place < k]))

    return block_best(
        queries, corpus, kernel, f"{named}qid {q_type}, id {c_type}, sim double", [*carried, "qid"], [F.col("sim").desc(), F.col("id")], k, qid=qid, cid=cid,
        vec=vec, by=by, q_extra=[*q_extra, *([query_t] if timed else [])], c_extra=[*c_extra, *([corpus_t] if timed else [])], combine=combine, way=way, rank="rank", **sizes,
    )


def assign_nearest(points: DataFrame, centers: DataFrame, **how) -> DataFrame:
    """The centre with the highest cosine for every point."""
    return cosine_topk(points, centers, 1, **how).drop("rank")


def knn_prune(
    points: DataFrame, by: Sequence[str], p: float = 0.02, min_neighbours: int = 6, id_col: str = "id", vec: str = "vec", block_rows: int = PRUNE_ROWS,
) -> DataFrame:
    """Affinity of each recording with all but the largest entries of every row set to 0, made symmetric.

    Of n entries a row keeps n - min(floor((1-p)n), n - min_neighbours), itself included. An entry kept by one side only counts half.

    Entries are compared twice: first every row's smallest kept entry is found, one record a row; then each block of pairs knows
    what both of its sides keep and gives its final rows. So the entries, a share of all pairs, are never shuffled, sorted or grouped.
    Rows of one id are one row of the affinity with the entries of them all.
    """
    ship(points.sparkSession)
    n = F.count(F.lit(1))
    keep = (n - F.least(F.floor(F.lit(1.0 - p) * n), n - min_neighbours)).cast("int")
    quota = points.groupBy(*by).agg(keep.alias("_keep"), n.cast("long").alias("_rows"))
    longest = quota.agg(F.max("_rows")).first()[0] or 1
    kind = points.schema[id_col].dataType.simpleString()
    named = ", ".join(f"{b} {points.schema[b].dataType.simpleString()}" for b in by)
    rows = points.where(F.col(vec).isNotNull()).select(
        *by, F.coalesce(id_col, F.lit("0").cast(kind)).alias("id"), F.col(id_col).isNull().alias("none"), F.col(vec).alias("vec"))
    asked = rows.where("NOT none").drop("none").join(quota.drop("_rows"), list(by))

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        """(by..., id, least, last, part, every) of each row: it keeps entries above ``least``, and of those equal to it the ones before ``last``,
        ``part`` of those of ``last``; where the last one has no id, all of them."""
        if left.num_rows == 0 or right.num_rows == 0:
            return cut_schema.empty_table()
        q, c = side(left, "id", "vec", [*by, "_keep"]), side(right, "id", "vec", ["none"])
        q, c = q.take(np.argsort(q.ids, kind="stable")), c.take(np.lexsort((c.ids, c.cols["none"])))
        code = np.cumsum(np.r_[0, (c.ids[1:] != c.ids[:-1]) | (c.cols["none"][1:] != c.cols["none"][:-1])])
        starts = np.flatnonzero(np.r_[True, q.ids[1:] != q.ids[:-1]])
        many = np.diff(np.r_[starts, len(q.ids)])
        least, last, part = np.full(len(starts), -np.inf), np.zeros(len(starts), dtype=np.int64), np.ones(len(starts))
        high = max(1, TILE_CELLS // len(c.ids))
        for m in np.unique(many):
            alike = np.flatnonzero(many == m)
            for lo in range(0, len(alike), max(1, high // m)):
                some = alike[lo: lo + max(1, high // m)]
                at = (starts[some][:, None] + np.arange(m)).ravel()
                scores = similarity(q.take(at), c).reshape(len(some), m, -1).transpose(0, 2, 1).reshape(len(some), -1)
                least[some], last[some], part[some] = _smallest_kept(scores, np.repeat(code, m), q.cols["_keep"][starts[some]])
        first = np.searchsorted(code, last)
        found = {**{b: q.cols[b][starts] for b in by}, "id": q.ids[starts], "least": least, "last": c.ids[first], "part": part, "every": c.cols["none"][first]}
        return pa.table([pa.array(found[f.name], type=f.type) for f in cut_schema], schema=cut_schema)

    cut_ddl = f"{named}, id {kind}, least double, last {kind}, part double, every boolean"
    cut_schema = to_arrow_schema(T.StructType.fromDDL(cut_ddl))
    cuts = materialize(block_cells(asked, rows, cut, cut_ddl, qid="id", unit="id", by=by, question_rows=block_rows, block_rows=longest)[0], "knn-cuts")
    known = rows.where("NOT none").drop("none").join(cuts, [*by, "id"])
    extra = ["least", "last", "part", "every"]

    def pairs(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return schema.empty_table()
        q, c = side(left, "id", "vec", [*by, *extra]), side(right, "id", "vec", extra)
        high = max(1, TILE_CELLS // len(c.ids))
        out = [schema.empty_table()]
        for lo in range(0, len(q.ids), high):
            a = q.take(slice(lo, lo + high))
            sim = similarity(a, c)
            kept = _kept(sim, a, c.ids) + _kept(sim.T, c, a.ids).T
            row, col = np.nonzero((kept > 0) & (a.ids[:, None] != c.ids[None, :]))
            found = {**{b: a.cols[b][row] for b in by}, "i": a.ids[row], "j": c.ids[col], "affinity": sim[row, col] / 2 * kept[row, col]}
            out.append(pa.table([pa.array(found[f.name], type=f.type) for f in schema], schema=schema))
        whole = pa.concat_tables(out)
        if len(np.unique(q.ids)) < len(q.ids) or len(np.unique(c.ids)) < len(c.ids):
            whole = whole.group_by([*by, "i", "j"]).aggregate([("affinity", "sum")]).rename_columns(schema.names)
        return whole

    ddl = f"{named}, i {kind}, j {kind}, affinity double"
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))
    return block_cells(known, known, pairs, ddl, qid="id", unit="id", by=by, question_rows=block_rows, block_rows=block_rows)[0]


def _smallest_kept(scores: np.ndarray, code: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of entries in order of ``code``: score and code of the last of the ``keep`` best, low code first, and the share of its equals kept."""
    scores = np.where(np.isnan(scores), -np.inf, scores)
    least, last, part = np.full(len(scores), -np.inf), np.zeros(len(scores), dtype=np.int64), np.ones(len(scores))
    for k in np.unique(keep):
        rows = np.flatnonzero(keep == k)
        if k <= 0:
            least[rows] = np.inf
        elif k < scores.shape[1]:
            here = scores[rows]
            s = np.partition(here, here.shape[1] - k, axis=1)[:, here.shape[1] - k]
            equal = here == s[:, None]
            need = k - (here > s[:, None]).sum(axis=1)
            at = np.argmax(equal, axis=1)
            for r in np.flatnonzero(equal.sum(axis=1) > 1):
                ties = code[equal[r]]
                at[r] = np.flatnonzero(equal[r])[need[r] - 1]
                lo, hi = np.searchsorted(ties, code[at[r]], "left"), np.searchsorted(ties, code[at[r]], "right")
                part[rows[r]] = (need[r] - lo) / (hi - lo)
            least[rows], last[rows] = s, code[at]
    return least, last, part


def _kept(sim: np.ndarray, a: Side, ids: np.ndarray) -> np.ndarray:
    """1 for entries that a row of ``a`` keeps, 0 for others, between them for a share of equal entries."""
    least = a.cols["least"][:, None]
    kept = (sim > least).astype(np.float64)
    row, col = np.nonzero((sim == least) & (least > -np.inf))
    last, here = a.cols["last"][row], ids[col]
    kept[row, col] = np.where(a.cols["every"][row] | (here < last), 1.0, np.where(here == last, a.cols["part"][row], 0.0))
    return kept


def entity_text_sim(
    pairs: DataFrame, descriptions: DataFrame, n: int = RECENT_DESCRIPTIONS, order: Sequence[str] = ("t_sec", "pos"),
) -> DataFrame:
    """Best similarity of a text to the last ``n`` descriptions of an entity, per (query, entity) pair."""
    recent = last_n(descriptions, n, ["entity"], order).select("entity", F.col("vec").alias("_desc_vec"))
    scored = pairs.join(recent, "entity").withColumn("_sim", cosine(F.col("vec"), F.col("_desc_vec")))
    return scored.groupBy("qid", "entity").agg(F.max("_sim").alias("text_similarity"))


def text_candidates(
    queries: DataFrame, descriptions: DataFrame, threshold: float = TEXT_THRESHOLD, k: int = TEXT_CANDIDATES,
    n: int = RECENT_DESCRIPTIONS, order: Sequence[str] = ("t_sec", "pos"), way: str | None = None, **sizes: int,
) -> DataFrame:
    """The ``k`` entities most like a text, similarity strictly above ``threshold``.

    An entity offers at most ``n`` descriptions, so its best one is among the k * n best descriptions.
    """
    recent = last_n(descriptions, n, ["entity"], order)
    recent = recent.withColumn("_desc", F.concat_ws("|", "entity", *[F.col(o).cast("string") for o in order]))
    near = cosine_topk(queries, recent, k * n, cid="_desc", way=way, **sizes)
    named = near.where(F.col("sim") > threshold).join(recent.select(F.col("_desc").alias("id"), "entity"), "id")
    best = named.groupBy("qid", "entity").agg(F.max("sim").alias("text_similarity"))
    return best_rows(best, ["qid"], [F.col("text_similarity").desc(), F.col("entity")], k, rank="candidate_rank")


def iou_candidates(tracks: DataFrame, detections: DataFrame, keys: Sequence[str] = ("event_id", "t")) -> DataFrame:
    """Largest overlap of a tracked box with the boxes found for a candidate in the same frame.

    ``tracks`` has qid and box (x, y, w, h); ``detections`` has candidate and box_xyxy.
    """
    met = tracks.join(detections, list(keys))
    lap = iou(to_xyxy(F.col("box")), F.col("box_xyxy"), "xyxy")
    return met.groupBy("qid", "candidate", *keys).agg(F.max(lap).alias("max_iou"))


def mean_positive_iou(frames: DataFrame, by: Sequence[str] = ("qid", "candidate"), col: str = "max_iou") -> DataFrame:
    """Mean over frames with any overlap; 0 when there is none."""
    mean = F.avg(F.when(F.col(col) > 0, F.col(col)))
    return frames.groupBy(*by).agg(F.coalesce(mean, F.lit(0.0)).alias("vision_similarity"))


def topk_mean(sims: DataFrame, k: int, by: Sequence[str] = ("qid", "voice_id"), col: str = "sim") -> DataFrame:
    """Mean of the ``k`` highest similarities, of all when there are fewer."""
    return best_rows(sims, by, [F.col(col).desc()], k).groupBy(*by).agg(F.avg(col).alias("score"))


def match_voices(
    queries: DataFrame, history: DataFrame, k: int = 5, threshold: float = VOICE_THRESHOLD, *, qid: str = "qid",
    vec: str = "vec", voice: str = "voice_id", way: str | None = None, **sizes: int,
) -> DataFrame:
    """C11: the voice with the highest top-k mean similarity at or above ``threshold``; first registered wins ties.

    ``history`` has voice_id, voice_no (order of registration), vec, and for a voice without history its
    running mean as the only row. The history of one voice is bounded, and stays in one block.
    """
    q_type = queries.schema[qid].dataType.simpleString()
    rows = history.withColumn("_row", F.monotonically_increasing_id())

    def kernel(q: Side, h: Side) -> dict[str, np.ndarray]:
        numbers = h.cols["voice_no"]
        order = np.argsort(numbers, kind="stable")
        sims = similarity(q, h)[:, order]
        numbers = numbers[order]
        starts = np.r_[0, np.nonzero(numbers[1:] != numbers[:-1])[0] + 1, len(numbers)] if len(numbers) else np.array([0])
        best = np.full(len(q.ids), -np.inf)
        who = np.full(len(q.ids), -1, dtype=np.int64)
        for lo, hi in zip(starts[:-1], starts[1:]):
            top = np.sort(sims[:, lo:hi], axis=1)[:, -k:]
            score = np.round(top.mean(axis=1), RANK_DIGITS)
            better = (score >= threshold) & (score > best)
            best[better], who[better] = score[better], numbers[lo]
        hit = who >= 0
        return {"qid": q.ids[hit], "voice_no": who[hit], "score": best[hit]}

    found = block_apply(
        queries, rows, kernel, f"qid {q_type}, voice_no bigint, score double", qid=qid, cid="_row", vec=vec,
        c_extra=["voice_no"], unit="voice_no", way=way, **sizes,
    )
    best = best_rows(found, ["qid"], [F.col("score").desc(), F.col("voice_no")], 1)
    return best.join(history.select(voice, "voice_no").distinct(), "voice_no")


def score_trials(trials: DataFrame, enrol: DataFrame, test: DataFrame) -> DataFrame:
    """Cosine of every trial; ``enrol`` and ``test`` hold id and vec."""
    left = enrol.select(F.col("id").alias("enrol"), F.col("vec").alias("_a"))
    right = test.select(F.col("id").alias("test"), F.col("vec").alias("_b"))
    return trials.join(left, "enrol").join(right, "test").withColumn("score", cosine(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def match_entities(
    objects: DataFrame, descriptions: DataFrame, tracks: DataFrame, detections: DataFrame,
    match_threshold: float = MATCH_THRESHOLD, frames: int = SAMPLE_FRAMES, text_threshold: float = TEXT_THRESHOLD, **how,
) -> tuple[DataFrame, DataFrame]:
    """Match decision per object, and the candidates that lost with their scores.

    ``objects``: qid, event_id, vec, has_crops. ``descriptions``: entity, text, vec, t_sec, pos. ``tracks``:
    qid, event_id, pos, t, box. ``detections``: event_id, t, desc_text, box_xyxy.

    A cheap text gate leaves at most three candidates per object; only those are compared by box. The
    candidate with the highest mean overlap above 0 is the best; it matches from ``match_threshold`` on.
    """
    usable = objects.where("has_crops")
    text = text_candidates(usable.select("qid", "vec"), descriptions, text_threshold, **how)
    latest = last_n(descriptions, 1, ["entity"], ["t_sec", "pos"]).select("entity", F.col("text").alias("desc_text"))
    sampled = sample_uniform(tracks, frames, ["qid"])
    asked = text.join(latest, "entity").select("qid", F.col("entity").alias("candidate"), "desc_text")
    boxes = sampled.join(asked, "qid").join(detections, ["event_id", "t", "desc_text"])
    per_frame = boxes.groupBy("qid", "candidate", "t").agg(
        F.max(iou(to_xyxy(F.col("box")), F.col("box_xyxy"), "xyxy")).alias("max_iou")
    )
    scored = text.withColumnRenamed("entity", "candidate").join(mean_positive_iou(per_frame), ["qid", "candidate"], "left")
    scored = scored.withColumn("vision_similarity", F.coalesce("vision_similarity", F.lit(0.0)))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("vision_similarity").desc(), "candidate_rank"))
    scored = scored.withColumn("_best", (rank == 1) & (F.col("vision_similarity") > 0))
    best = scored.where("_best").select("qid", "candidate", "text_similarity", "vision_similarity")
    hit = F.col("vision_similarity") >= match_threshold
    decided = usable.select("qid", "event_id").join(best, "qid", "left").select(
        "qid", "event_id", F.when(hit, F.col("candidate")).alias("global_name"),
        (~F.coalesce(hit, F.lit(False))).alias("is_new"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("text_similarity", "vision_similarity")],
        F.coalesce("vision_similarity", F.lit(0.0)).alias("final_score"), F.lit(None).cast("string").alias("error"),
    )
    without = objects.where("NOT has_crops").select(
        "qid", "event_id", F.lit(None).cast("string").alias("global_name"), F.lit(None).cast("boolean").alias("is_new"),
        *[F.lit(None).cast("double").alias(c) for c in ("text_similarity", "vision_similarity", "final_score")],
        F.lit("no_crops").alias("error"),
    )
    matched = decided.where("global_name IS NOT NULL").select("qid", F.col("global_name").alias("candidate"))
    lost = scored.join(matched, ["qid", "candidate"], "left_anti").select(
        "qid", "candidate", "text_similarity", "vision_similarity"
    )
    return decided.unionByName(without), lost
