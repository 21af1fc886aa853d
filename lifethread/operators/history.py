"""Per-entity and per-day history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lifethread.operators.ordered import OrderedScan

HISTORY_EVENTS = 5
HISTORY_SECONDS = 60.0
DAY_KEYS = ("participant", "day")


def best_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows per key. Spark limits each input partition before it shuffles, so a hot key
    sends at most ``n`` rows per partition."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n)
    return ranked.withColumnRenamed("_rank", rank) if rank else ranked.drop("_rank")


def history(
    events: DataFrame, n: int = HISTORY_EVENTS, keys: Sequence[str] = DAY_KEYS, t: str = "t_sec",
    event: str = "event_id", split: bool | None = None,
) -> DataFrame:
    """For each event the latest ``n`` strictly earlier events of its day, oldest first.

    One row per (event, earlier event). Events of equal time do not see each other: positions below
    the first position of the same time are joined by (key, position), never by key alone.
    """
    scan = OrderedScan(events, keys, (t, event), split).position("_rn").previous(_t=F.col(t))
    fresh = F.col("_t").isNull() | (F.col("_t") < F.col(t))
    ranked = scan.with_columns(_first=F.when(fresh, F.col("_rn"))).running_max(_rank=F.col("_first")).result()
    reach = F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), F.col("_rank") - n), F.col("_rank") - 1))
    now = ranked.where(F.col("_rank") > 1).select(*keys, event, t, F.col("_rank"), reach.alias("_rn"))
    past = ranked.select(*keys, F.col("_rn"), F.col(event).alias(f"past_{event}"), F.col(t).alias(f"past_{t}"))
    joined = now.join(past, [*keys, "_rn"])
    pos = (F.col("_rn") - F.greatest(F.lit(1).cast("long"), F.col("_rank") - n) + 1).cast("int")
    return joined.select(*keys, event, t, pos.alias("past_pos"), f"past_{event}", f"past_{t}")


def temporal_edges(
    events: DataFrame, n: int = HISTORY_EVENTS, max_s: float = HISTORY_SECONDS, keys: Sequence[str] = DAY_KEYS,
    t: str = "t_sec", event: str = "event_id", split: bool | None = None,
) -> DataFrame:
    """``temporal_after`` relations to those of the last ``n`` events at most ``max_s`` ago."""
    gap = F.round(F.col(t) - F.col(f"past_{t}"), 6)
    return (
        history(events, n, keys, t, event, split).withColumn("time_diff_seconds", gap)
        .where((F.col("time_diff_seconds") > 0) & (F.col("time_diff_seconds") <= max_s))
        .select(
            event, F.col(f"past_{event}").alias(f"related_{event}"), F.lit("temporal_after").alias("type"),
            "time_diff_seconds", F.col(f"past_{t}").alias("from_t"), F.col(t).alias("to_t"),
        )
    )


def with_reason(edges: DataFrame, base: str = "2024-01-01") -> DataFrame:
    """Reason text ``earlier -> later`` of temporal relations, in calendar time."""
    def when(c: Column) -> Column:
        hundredths = F.round(c * 100).cast("long")
        date = F.date_add(F.lit(base).cast("date"), F.floor(hundredths / 8640000).cast("int"))
        rest = hundredths % 8640000
        part = lambda unit, top: (F.floor(rest / unit) % top).cast("int")
        clock = F.format_string("%02d:%02d:%02d.%02d", part(360000, 24), part(6000, 60), part(100, 60), part(1, 100))
        return F.concat_ws(" ", date.cast("string"), clock)

    return edges.withColumn("reason", F.concat_ws(" -> ", when(F.col("from_t")), when(F.col("to_t"))))


def last_n(df: DataFrame, n: int, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The latest ``n`` rows per entity."""
    return best_rows(df, keys, [F.col(o).desc() for o in order], n)


def first_k(df: DataFrame, k: int, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first ``k`` rows per entity; later ones never push them out."""
    return best_rows(df, keys, [F.col(o).asc() for o in order], k)


def prune_history(
    df: DataFrame, keys: Sequence[str] = ("voice_id",), order: Sequence[str] = ("pos",), maximum: int = 20,
    min_duration: float = 1.5, min_score: float = 0.5,
) -> DataFrame:
    """A history above ``maximum`` keeps only long, sure entries, the best ``maximum`` of them."""
    full = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    sized = df.join(full, list(keys))
    small = sized.where(F.col("_n") <= maximum).drop("_n")
    good = sized.where((F.col("_n") > maximum) & (F.col("duration") >= min_duration) & (F.col("match_score") >= min_score))
    best = best_rows(good.drop("_n"), keys, [F.col("match_score").desc(), *[F.col(o) for o in order]], maximum)
    return small.unionByName(best)


def sample_uniform(df: DataFrame, n: int, keys: Sequence[str], pos: str = "pos") -> DataFrame:
    """Every (size // n)-th position counted from 0, at most ``n`` of them."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    step = F.greatest(F.lit(1).cast("long"), F.floor(F.col("_n") / n))
    hit = (F.col(pos) % F.col("_step") == 0) & (F.col(pos) < F.col("_step") * n)
    return df.join(sizes.withColumn("_step", step).drop("_n"), list(keys)).where(hit).drop("_step")


def best_detection(df: DataFrame, keys: Sequence[str], frame: str = "frame", score: str = "score", first_frames: int | None = None) -> DataFrame:
    """The highest score above 0; the earliest frame wins ties."""
    rows = df.where(F.col(score) > 0)
    if first_frames is not None:
        rows = best_frames(rows, keys, frame, first_frames)
    cols = [c for c in df.columns if c not in keys]
    pick = F.max_by(F.struct(*cols), F.struct(F.col(score), -F.col(frame)))
    return rows.groupBy(*keys).agg(pick.alias("_b")).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in cols])


def best_frames(df: DataFrame, keys: Sequence[str], frame: str, n: int) -> DataFrame:
    """Rows of the first ``n`` distinct frames of a key."""
    at = F.dense_rank().over(Window.partitionBy(*keys).orderBy(frame))
    return df.withColumn("_at", at).where(F.col("_at") <= n).drop("_at")


def topk_crops(
    detections: DataFrame, tracked: DataFrame, k: int = 3, keys: Sequence[str] = ("event_id", "object_name"),
    t: str = "t", score: str = "score", order: Sequence[str] = (),
) -> DataFrame:
    """Best ``k`` detections of an object; tracked frames at other times fill up what is missing."""
    cols = [*keys, t, score, *order]
    spare = tracked.join(detections.select(*keys, t), [*keys, t], "left_anti").select(*cols)
    both = detections.select(*cols, F.lit(False).alias("from_tracking")).unionByName(
        spare.select(*cols, F.lit(True).alias("from_tracking"))
    )
    rank = [F.col("from_tracking"), F.col(score).desc(), F.col(t), *[F.col(o) for o in order]]
    return best_rows(both, keys, rank, k, rank="crop_rank")


def latest(df: DataFrame, n: int, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """T4: newest first, at most ``n``; per question when ``by`` is given."""
    newest = [F.col(o).desc() for o in order]
    return best_rows(df, by, newest, n) if by else df.orderBy(*newest).limit(n)


def cap_per_query(df: DataFrame, m: int, qid: str = "qid", order: Sequence[str] = ("t_sec", "event_id")) -> DataFrame:
    """T5: at most ``m`` of the newest events per question."""
    return best_rows(df, [qid], [F.col(o).desc() for o in order], m)


def asof_last(
    probes: DataFrame, facts: DataFrame, keys: Sequence[str], n: int, t: str = "t_sec", tie: str = "event_id",
    probe_t: str = "query_t", split: bool | None = None,
) -> DataFrame:
    """The last ``n`` facts of a key at or before each probe's time.

    Facts are numbered inside their key and each probe learns its number by a running count, so a
    probe joins ``n`` positions and never meets all facts of a hot key.
    """
    extra = [c for c in probes.columns if c not in (*keys, probe_t)]
    fact_cols = [c for c in facts.columns if c not in keys]
    both = facts.select(
        *keys, F.col(t).alias("_t"), F.lit(0).alias("_kind"), F.struct(*fact_cols).alias("_fact"),
        F.lit(None).cast(probes.select(F.struct(*extra, probe_t)).schema[0].dataType).alias("_probe"),
        F.col(tie).alias("_tie"),
    ).unionByName(
        probes.select(
            *keys, F.col(probe_t).alias("_t"), F.lit(1).alias("_kind"),
            F.lit(None).cast(facts.select(F.struct(*fact_cols)).schema[0].dataType).alias("_fact"),
            F.struct(*extra, probe_t).alias("_probe"), F.lit(None).cast(facts.schema[tie].dataType).alias("_tie"),
        )
    )
    numbered = OrderedScan(both, keys, ("_t", "_kind", "_tie"), split).running_sum(
        _n=F.when(F.col("_kind") == 0, 1).otherwise(0).cast("long")
    ).result()
    reach = F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), F.col("_n") - (n - 1)), F.col("_n")))
    asked = numbered.where((F.col("_kind") == 1) & (F.col("_n") > 0)).select(*keys, "_probe", reach.alias("_n"))
    known = numbered.where(F.col("_kind") == 0).select(*keys, "_n", "_fact")
    return asked.join(known, [*keys, "_n"]).select(*keys, "_probe.*", "_fact.*")
