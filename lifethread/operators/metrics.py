"""Retrieval, verification and run reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lifethread.operators.ordered import OrderedScan

# Fixed values of the evaluation protocol.
P_TARGET, C_MISS, C_FA = 0.01, 1.0, 1.0
MIN_BINS = 1_000_000


def single(df: DataFrame) -> Column:
    """The only row of ``df`` as a struct value (a scalar subquery)."""
    return df.select(F.struct("*")).scalar()


def _share(hits: Column, total: Column) -> Column:
    return F.when(total > 0, F.lit(100.0) * hits / total)


def recall_report(results: DataFrame, asked: DataFrame) -> DataFrame:
    """A5: recall overall and by type, need_name and need_audio.

    ``results`` has one row per evaluated question: type, need_name, need_audio, hit, core_hit,
    expanded_hit, closest_time_diff. The overall rates divide by all questions of ``asked``, skipped ones
    included; the groups divide by their evaluated questions. Both counts are columns.
    """
    flag = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    dims = ["type", "need_name", "need_audio"]
    base = results.select(*[F.col(c).cast("string").alias(c) for c in dims], "hit", "core_hit", "expanded_hit", "closest_time_diff")
    sets = [[F.col(c)] for c in dims] + [[]]
    grouped = base.groupingSets(sets, *[F.col(c) for c in dims]).agg(
        F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("evaluated"), flag("hit").alias("hits"),
        flag("core_hit").alias("core_hits"), flag("expanded_hit").alias("expanded_hits"),
        F.avg(F.when(F.col("hit"), F.col("closest_time_diff"))).alias("avg_time_diff"),
    )
    total = single(asked.agg(F.count(F.lit(1)).alias("asked")))["asked"]
    kind = F.when(F.col("_set") == 3, "type").when(F.col("_set") == 5, "need_name").when(F.col("_set") == 6, "need_audio").otherwise("overall")
    value = F.when(F.col("_set") == 3, F.col("type")).when(F.col("_set") == 5, F.col("need_name")).when(F.col("_set") == 6, F.col("need_audio"))
    wide = grouped.withColumn("questions", F.when(F.col("_set") == 7, total).otherwise(F.col("evaluated")))
    return wide.select(
        kind.alias("dimension"), value.alias("value"), "questions", "evaluated", "hits", "core_hits", "expanded_hits",
        _share(F.col("hits"), F.col("questions")).alias("recall"),
        _share(F.col("core_hits"), F.col("questions")).alias("core_recall"),
        _share(F.col("expanded_hits"), F.col("questions")).alias("expanded_recall"),
        "avg_time_diff",
    )


def judgment_summary(df: DataFrame, by: Sequence[str] = (), col: str = "type") -> DataFrame:
    """How many judgments there are of each kind; both spellings of causal count as causal."""
    t = F.col(col)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_judgments"),
        F.count_if(t.isin("causal", "causal_same_strong")).alias("causal"),
        F.count_if(t == "same_activity_non_causal").alias("same_activity_non_causal"),
        F.count_if(t == "no_relationship").alias("no_relationship"),
    )


def det_curve(
    trials: DataFrame, score: str = "score", target: str = "target", weight: str | None = None,
    order: Sequence[str] = ("id",), split: bool | None = True,
) -> DataFrame:
    """Miss and false-alarm rate after each trial in score order, as (pos, score, fnr, fpr).

    The curve runs over the whole table; the scan is cut into ranges, so no task holds all of it.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    is_target = F.col(target) == 1
    weighed = trials.withColumns({"_tar": F.when(is_target, w).otherwise(0.0), "_imp": F.when(F.col(target) == 0, w).otherwise(0.0)})
    total = single(weighed.agg(F.sum("_tar").alias("tar"), F.sum("_imp").alias("imp")))
    scan = OrderedScan(weighed, [], (score, *order), split).position("pos").running_sum(_cum_tar=F.col("_tar"), _cum_imp=F.col("_imp"))
    return scan.result().select(
        *order, "pos", F.col(score).alias("score"),
        (F.col("_cum_tar") / total["tar"]).alias("fnr"), (1 - F.col("_cum_imp") / total["imp"]).alias("fpr"),
    )


def det_curve_binned(
    trials: DataFrame, bins: int | None = None, score: str = "score", target: str = "target", weight: str | None = None,
) -> DataFrame:
    """The same curve over equal score bins; bins without trials repeat the one before and are left out.

    Without ``bins`` there is one bin edge per trial of the larger class, a million at least. The cumulation
    runs over bins only.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    is_target, is_impostor = F.col(target) == 1, F.col(target) == 0
    facts = single(
        trials.agg(
            F.min(score).cast("double").alias("lo"), F.max(score).cast("double").alias("hi"),
            F.sum(F.when(is_target, w).otherwise(0.0)).alias("tar"), F.sum(F.when(is_impostor, w).otherwise(0.0)).alias("imp"),
            F.greatest(F.count_if(is_target), F.count_if(is_impostor), F.lit(MIN_BINS).cast("long")).alias("edges"),
        )
    )
    n = facts["edges"] - 1 if bins is None else F.lit(bins).cast("long")
    place = F.floor((F.col(score) - facts["lo"]) / (facts["hi"] - facts["lo"]) * n)
    counts = trials.withColumn("bin", F.least(F.coalesce(place, F.lit(0).cast("long")), n - 1)).groupBy("bin").agg(
        F.sum(F.when(is_target, w).otherwise(0.0)).alias("_tar"), F.sum(F.when(is_impostor, w).otherwise(0.0)).alias("_imp")
    )
    split = bins is None or bins > MIN_BINS
    scan = OrderedScan(counts, [], ("bin",), split).running_sum(_cum_tar=F.col("_tar"), _cum_imp=F.col("_imp"))
    return scan.result().select(
        "bin", (F.col("_cum_tar") / facts["tar"]).alias("fnr"), (1 - F.col("_cum_imp") / facts["imp"]).alias("fpr")
    )


def eer(curve: DataFrame, pos: str = "pos", score: str | None = "score") -> DataFrame:
    """Equal-error rate between the last point with fewer misses and the first without, and its threshold."""
    gap = F.col("fnr") - F.col("fpr")
    point = F.struct(F.col(pos), "fnr", "fpr", *([F.col(score).alias("s")] if score else []))
    ends = curve.agg(F.min(F.when(gap >= 0, point)).alias("x1"), F.max(F.when(gap < 0, point)).alias("x2"))
    rise = F.col("x2.fpr") - F.col("x1.fpr") - (F.col("x2.fnr") - F.col("x1.fnr"))
    a = (F.col("x1.fnr") - F.col("x1.fpr")) / rise
    value = F.col("x1.fnr") + a * (F.col("x2.fnr") - F.col("x1.fnr"))
    return ends.select(value.alias("eer"), *([F.col("x1.s").alias("threshold")] if score else []))


def min_dcf(curve: DataFrame, p_target: float = P_TARGET, c_miss: float = C_MISS, c_fa: float = C_FA) -> DataFrame:
    """Lowest detection cost, as it is and over the cost of not looking at the scores."""
    cost = F.lit(c_miss * p_target) * F.col("fnr") + F.lit(c_fa * (1 - p_target)) * F.col("fpr")
    blind = min(c_miss * p_target, c_fa * (1 - p_target))
    return curve.agg(F.min(cost).alias("min_dcf")).withColumn("norm_min_dcf", F.col("min_dcf") / F.lit(blind))


def equalize_weights(trials: DataFrame, part: str, target: str = "target") -> DataFrame:
    """Weight trials so that every partition counts as much as the largest, per class."""
    sizes = trials.groupBy(part).agg(
        F.count_if(F.col(target) == 1).alias("_tar"), F.count_if(F.col(target) != 1).alias("_imp")
    )
    most = single(sizes.agg(F.max("_tar").alias("tar"), F.max("_imp").alias("imp")))
    ratio = lambda top, own: F.when(F.col(own) > 0, top / F.col(own)).otherwise(0.0)
    weights = sizes.select(part, ratio(most["tar"], "_tar").alias("_w1"), ratio(most["imp"], "_imp").alias("_w0"))
    return trials.join(weights, part).withColumn("weight", F.when(F.col(target) == 1, F.col("_w1")).otherwise(F.col("_w0"))).drop("_w0", "_w1")


def average_precision(
    trials: DataFrame, score: str = "score", target: str = "target", order: Sequence[str] = ("id",), split: bool | None = True
) -> DataFrame:
    """Area under the precision envelope, taken where a target is found."""
    ranked = trials.withColumn("_down", -F.col(score))
    scan = OrderedScan(ranked, [], ("_down", *order), split).position("_n").running_sum(_tp=(F.col(target) == 1).cast("long"))
    scan = scan.with_columns(_precision=F.col("_tp") / F.col("_n")).following_max(_envelope=F.col("_precision"))
    found = F.count_if(F.col(target) == 1)
    return scan.result().agg(
        (F.sum(F.when(F.col(target) == 1, F.col("_envelope"))) / found).alias("average_precision"), found.alias("targets")
    )


def top1_accuracy(df: DataFrame, scores: str = "scores", target: str = "target") -> DataFrame:
    """Per cent of rows whose highest class score is at the target class; the first class wins ties."""
    guess = F.array_position(F.col(scores), F.array_max(scores)) - 1
    return df.agg((F.lit(100.0) * F.avg((guess == F.col(target)).cast("double"))).alias("accuracy"), F.count(F.lit(1)).alias("rows"))


def run_stats(timings: DataFrame, step: str = "step", seconds: str = "seconds") -> DataFrame:
    """Runs, mean and total seconds per step."""
    return timings.groupBy(step).agg(
        F.count(F.lit(1)).alias("runs"), F.avg(seconds).alias("avg_seconds"), F.sum(seconds).alias("total_seconds")
    )


def track_stats(frames: DataFrame) -> DataFrame:
    """Frames per tracked object, and objects per event."""
    objects = frames.groupBy("event_id", "object_name").agg(F.count(F.lit(1)).alias("num_frames"))
    per_event = objects.groupBy("event_id").agg(F.count(F.lit(1)).alias("num_objects"))
    return objects.join(per_event, "event_id")


def cluster_profile(assigned: DataFrame, label: str = "label", stamp: str = "timestamp", t: str = "t_sec") -> DataFrame:
    """A2: size and time span of every cluster and the number of noise events, largest cluster first."""
    members = assigned.where(F.col(label) != -1).groupBy(label).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.concat(F.min_by(stamp, F.struct(t, stamp)), F.lit(" - "), F.max_by(stamp, F.struct(t, stamp))).alias("time_span"),
    )
    totals = single(assigned.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(label) == -1).alias("noise")))
    return members.withColumns({"total_events": totals["total"], "noise_events": totals["noise"]}).orderBy(
        F.col("event_count").desc(), label
    )
