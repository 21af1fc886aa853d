"""Time intervals: merging, runs, chunks and overlap joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifethread.functions.vectors import vec_mean
from lifethread.operators.ordered import OrderedScan

RECORDING = ("recording_id",)
# Fixed values of the record format.
CHUNK_SECONDS = 1.5
CHUNK_STEP = 0.75
FACE_FRAME_SECONDS = 0.04
TOUCH = 1e-4


def merge_segments(
    df: DataFrame, keys: Sequence[str] = RECORDING, order: Sequence[str] = ("start", "end"), split: bool | None = None
) -> DataFrame:
    """Join touching chunks of one label; chunks of two labels that overlap meet half-way."""
    scan = OrderedScan(df, keys, order, split).previous(_end=F.col("end"), _label=F.col("label"))
    changed = ~F.col("label").eqNullSafe(F.col("_label"))
    overlaps = changed & (F.col("start") < F.col("_end"))
    scan = scan.with_columns(
        _cut=F.when(overlaps, (F.col("start") + F.col("_end")) / 2),
        _new=F.when(F.col("_end").isNull() | changed | (F.col("start") > F.col("_end")), 1).otherwise(0),
    ).running_sum(_island=F.col("_new"))
    at = F.struct(*[F.col(o) for o in order])
    islands = scan.result().groupBy(*keys, "_island").agg(
        F.min_by(F.struct(F.col("start"), F.col("_cut"), F.col("label")), at).alias("_first"),
        F.max_by("end", at).alias("_last_end"),
    )
    cuts = islands.where(F.col("_first._cut").isNotNull()).select(
        *keys, (F.col("_island") - 1).alias("_island"), F.col("_first._cut").alias("_next_cut")
    )
    return islands.join(cuts, [*keys, "_island"], "left").select(
        *keys,
        F.coalesce("_first._cut", "_first.start").alias("start"),
        F.coalesce("_next_cut", "_last_end").alias("end"),
        F.col("_first.label").alias("label"),
    )


def _islands(scan: OrderedScan, keys: Sequence[str], new: Column) -> DataFrame:
    return scan.with_columns(_new=F.when(new, 1).otherwise(0)).running_sum(_island=F.col("_new")).result()


def union_intervals(
    a: DataFrame, b: DataFrame | None = None, keys: Sequence[str] = RECORDING, split: bool | None = None
) -> DataFrame:
    """Union of intervals, of two sources if given; touching ones join."""
    cols = [*keys, "start", "end"]
    rows = a.select(*cols) if b is None else a.select(*cols).unionByName(b.select(*cols))
    scan = OrderedScan(rows, keys, ("start", "end"), split).running_max(inclusive=False, _reach=F.col("end"))
    new = F.col("_reach").isNull() | (F.col("_reach") < F.col("start"))
    return (
        _islands(scan, keys, new).groupBy(*keys, "_island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")
    )


def active_runs(
    df: DataFrame, keys: Sequence[str] = RECORDING, t: str = "t", count: str = "active_count", split: bool | None = None
) -> DataFrame:
    """Intervals of frames with a count; a run ends at the first frame without, or at the last frame."""
    scan = OrderedScan(df, keys, (t,), split).following_max(_last=F.col(t))
    scan = scan.with_columns(_on=(F.col(count) != 0) & (F.col(t) < F.col("_last"))).previous(_was=F.col("_on"))
    was = F.coalesce(F.col("_was"), F.lit(False))
    scan = scan.with_columns(_opens=F.col("_on") & ~was, _closes=~F.col("_on") & was)
    return (
        _islands(scan, keys, F.col("_opens")).where("_opens or _closes").groupBy(*keys, "_island")
        .agg(F.min(F.when(F.col("_opens"), F.col(t))).alias("start"), F.max(F.when(F.col("_closes"), F.col(t))).alias("end"))
        .drop("_island")
    )


def score_runs(
    df: DataFrame, threshold: float = 0.5, keys: Sequence[str] = ("recording_id", "speaker"),
    t: str = "t", score: str = "score", split: bool | None = None,
) -> DataFrame:
    """Intervals where a frame score is above the threshold; a score equal to it keeps the state."""
    says = F.when(F.col(score) > threshold, 1).when(F.col(score) < threshold, 0)
    scan = OrderedScan(df, keys, (t,), split).running_max(
        _state=F.when(says.isNotNull(), F.struct(F.col(t).alias("t"), says.alias("on")))
    )
    scan = scan.with_columns(_on=F.coalesce(F.col("_state.on"), F.lit(0)) == 1).previous(_was=F.col("_on"))
    was = F.coalesce(F.col("_was"), F.lit(False))
    scan = scan.with_columns(_opens=F.col("_on") & ~was, _closes=~F.col("_on") & was)
    runs = (
        _islands(scan, keys, F.col("_opens")).where("_island > 0").groupBy(*keys, "_island")
        .agg(
            F.min(F.when(F.col("_opens"), F.col(t))).alias("start"),
            F.coalesce(F.min(F.when(F.col("_closes"), F.col(t))), F.max(t)).alias("end"),
        )
    )
    return runs.select(*keys, F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


def label_runs(
    df: DataFrame, stride: float = 1.0, keys: Sequence[str] = RECORDING, t: str = "t", label: str = "label",
    gap: float | None = None, split: bool | None = None,
) -> DataFrame:
    """Runs of one face label without a time gap; runs of no length go, except the last of a key."""
    gap = stride * FACE_FRAME_SECONDS + TOUCH if gap is None else gap
    scan = OrderedScan(df, keys, (t,), split).previous(_t=F.col(t), _label=F.col(label))
    new = F.col("_t").isNull() | ~F.col(label).eqNullSafe(F.col("_label")) | (F.col(t) - F.col("_t") > gap)
    runs = (
        _islands(scan, keys, new).groupBy(*keys, "_island")
        .agg(F.min(t).alias("start"), F.max(t).alias("end"), F.min(label).alias("label"))
    )
    last = runs.groupBy(*keys).agg(F.max("_island").alias("_last"))
    kept = (F.col("end") - F.col("start") >= TOUCH) | (F.col("_island") == F.col("_last"))
    return runs.join(last, list(keys)).where(kept).drop("_island", "_last")


def collapse_runs(
    df: DataFrame, keys: Sequence[str] = ("recording_id", "label"), split: bool | None = None
) -> DataFrame:
    """Join ordered intervals that overlap or touch; the end is that of the last one joined."""
    scan = OrderedScan(df, keys, ("start", "end"), split).previous(_end=F.col("end"))
    new = F.col("_end").isNull() | (F.col("_end") < F.col("start"))
    return (
        _islands(scan, keys, new).groupBy(*keys, "_island")
        .agg(F.min("start").alias("start"), F.max_by("end", F.struct("start", "end")).alias("end")).drop("_island")
    )


def relabel(
    df: DataFrame, keys: Sequence[str] = RECORDING, order: Sequence[str] = ("start",), label: str = "label",
    out: str = "new_label", first: int = 0, split: bool | None = None,
) -> DataFrame:
    """Labels 0, 1, 2 ... in the order they first appear."""
    seen = df.groupBy(*keys, label).agg(F.min(F.struct(*[F.col(o) for o in order])).alias("_seen"))
    ranked = OrderedScan(seen, keys, ("_seen", label), split).position(out).result()
    ranked = ranked.select(*keys, label, (F.col(out) + (first - 1)).alias(out))
    same = F.col(f"d.{label}").eqNullSafe(F.col(f"r.{label}"))
    for k in keys:
        same = same & (F.col(f"d.{k}") == F.col(f"r.{k}"))
    return df.alias("d").join(ranked.alias("r"), same).select("d.*", f"r.{out}")


def chunk_intervals(df: DataFrame, length: float = CHUNK_SECONDS, step: float = CHUNK_STEP) -> DataFrame:
    """Sliding chunks over every interval, the last one cut at its end."""
    n = F.ceil((F.col("end") - F.col("start") + (step - length)) / step).cast("long")
    at = F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("chunk")
    rows = df.where(n > 0).select("*", at)
    begin = F.col("start") + F.col("chunk") * F.lit(step)
    return rows.withColumns(
        {"chunk_start": begin, "chunk_end": F.least(begin + F.lit(length), F.col("end"))}
    )


def _buckets(start: Column, end: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(end / width)))


def overlap_pairs(
    a: DataFrame, b: DataFrame, keys: Sequence[str] = RECORDING, width: float = 30.0
) -> DataFrame:
    """Interval pairs that overlap, as columns ``a`` and ``b`` (structs).

    Both sides are laid into time buckets, so the join is an equi-join whose groups are bounded by
    what happens in one bucket; a pair is reported only in the first bucket both intervals share.
    """
    lay = lambda df, name: df.select(
        *keys, F.struct(*[F.col(c) for c in df.columns]).alias(name), _buckets(F.col("start"), F.col("end"), width).alias("_bucket")
    )
    first = F.greatest(F.floor(F.col("a.start") / width), F.floor(F.col("b.start") / width))
    meet = (F.col("a.end") > F.col("b.start")) & (F.col("b.end") > F.col("a.start"))
    return lay(a, "a").join(lay(b, "b"), [*keys, "_bucket"]).where(meet & (F.col("_bucket") == first)).drop("_bucket")


def _shared() -> Column:
    return F.least("a.end", "b.end") - F.greatest("a.start", "b.start")


def overlap_join(
    a: DataFrame, v: DataFrame, keys: Sequence[str] = RECORDING, label_time: bool = False, width: float = 30.0
) -> DataFrame:
    """Overlap per pair of labels; kept above 0.5 s, or with ``label_time`` above the lesser of
    0.5 s and half of what the second label lasts."""
    total = overlap_pairs(a, v, keys, width).groupBy(
        *keys, F.col("a.label").alias("a_label"), F.col("b.label").alias("v_label")
    ).agg(F.sum(_shared()).alias("overlap"))
    if not label_time:
        return total.where(F.col("overlap") > 0.5)
    spent = v.groupBy(*keys, F.col("label").alias("v_label")).agg(F.sum(F.col("end") - F.col("start")).alias("v_time"))
    need = F.least(F.col("v_time") * 0.5, F.lit(0.5))
    return total.join(spent, [*keys, "v_label"]).where(F.col("overlap") > need).drop("v_time")


def visual_speaker_vectors(
    audio: DataFrame, visual: DataFrame, keys: Sequence[str] = RECORDING, minimum: float = 1.0, width: float = 30.0
) -> DataFrame:
    """Mean voice vector of each face label, over audio chunks that share more than a second with it."""
    pairs = overlap_pairs(audio, visual, keys, width).where(_shared() > minimum)
    voiced = pairs.select(*keys, F.col("b.label").alias("label"), F.col("a.vec").alias("vec"))
    return vec_mean(voiced, [*keys, "label"])


def frames_in_segment(
    frames: DataFrame, segments: DataFrame, keys: Sequence[str] = ("event_id",), t: str = "t", width: float = 30.0
) -> DataFrame:
    """Frames that lie in a segment, borders included."""
    laid = segments.withColumn("_bucket", _buckets(F.col("start"), F.col("end"), width))
    inside = F.col(t).between(F.col("start"), F.col("end"))
    return frames.withColumn("_bucket", F.floor(F.col(t) / width)).join(laid, [*keys, "_bucket"]).where(inside).drop("_bucket")


def time_hits(
    hits: DataFrame, targets: DataFrame, window: float, qid: str = "qid", t: str = "t", target: str = "target_t"
) -> DataFrame:
    """Hits within ``window`` seconds of a target of the same question, with the distance."""
    width = max(float(window), 1.0)
    at = F.floor(F.col(target) / width)
    laid = targets.withColumn("_bucket", F.explode(F.sequence(at - 1, at + 1)))
    apart = F.abs(F.col(t) - F.col(target))
    return (
        hits.withColumn("_bucket", F.floor(F.col(t) / width)).join(laid, [qid, "_bucket"]).drop("_bucket")
        .withColumn("time_diff", apart).where(F.col("time_diff") <= window)
    )
