"""Clip names, event ids and clip clock times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the record format.
CLIP_NAME = r"(DAY\d+)_([A-Z0-9_]+)_(\d{8})\.mp4"
BASE_DATE = "2024-01-01"
DAY_SECONDS = 86400


def _clock_digits(clock: Column, at: int) -> Column:
    return F.substring(clock, at, 2).cast("int")


def parse_clips(df: DataFrame, col: str = "clip_name") -> tuple[DataFrame, DataFrame]:
    """Split clip names into typed parts; names that do not fit go to the second output."""
    name = F.col(col)
    fits = F.coalesce(name.rlike(CLIP_NAME), F.lit(False))
    day_text = F.regexp_extract(name, CLIP_NAME, 1)
    clock = F.regexp_extract(name, CLIP_NAME, 3)
    ok = df.where(fits).withColumns(
        {
            "day": F.substring(day_text, 4, 10).cast("int"),
            "person": F.regexp_extract(name, CLIP_NAME, 2),
            "hour": _clock_digits(clock, 1),
            "minute": _clock_digits(clock, 3),
            "second": _clock_digits(clock, 5),
            "centisecond": _clock_digits(clock, 7),
            "timestamp": F.concat(day_text, F.lit("_"), clock),
        }
    )
    return ok, df.where(~fits)


def event_id(stamp: Column, seq: Column | None = None) -> Column:
    base = F.concat(stamp, F.lit("_evt"))
    return base if seq is None else F.concat(base, F.lit("_"), F.format_string("%04d", seq.cast("int")))


def with_event_id(df: DataFrame, seq: str | None = None, stamp: str = "timestamp", out: str = "event_id") -> DataFrame:
    """One event per clip, or a four-digit sequence when a clip has several."""
    return df.withColumn(out, event_id(F.col(stamp), None if seq is None else F.col(seq)))


def clip_datetime(stamp: Column, base: str = BASE_DATE) -> Column:
    day = F.substring(F.split_part(stamp, F.lit("_"), F.lit(1)), 4, 10).cast("int")
    clock = F.split_part(stamp, F.lit("_"), F.lit(2))
    date = F.date_add(F.lit(base).cast("date"), day - 1)
    second = _clock_digits(clock, 5) + _clock_digits(clock, 7) / F.lit(100)
    return F.make_timestamp_ntz(
        F.year(date), F.month(date), F.dayofmonth(date),
        _clock_digits(clock, 1), _clock_digits(clock, 3), second.cast("decimal(8,6)"),
    )


def with_datetime(df: DataFrame, base: str = BASE_DATE, stamp: str = "timestamp", out: str = "event_time") -> DataFrame:
    """Clip clock time on the calendar, day 1 being ``base``."""
    return df.withColumn(out, clip_datetime(F.col(stamp), base))


def clip_seconds(stamp: Column) -> Column:
    day = F.substring(F.split_part(stamp, F.lit("_"), F.lit(1)), 4, 10).cast("int")
    clock = F.split_part(stamp, F.lit("_"), F.lit(2))
    whole = (
        (day - 1).cast("long") * DAY_SECONDS
        + _clock_digits(clock, 1) * 3600
        + _clock_digits(clock, 3) * 60
        + _clock_digits(clock, 5)
    )
    return whole.cast("double") + _clock_digits(clock, 7) / F.lit(100.0)


def with_seconds(df: DataFrame, stamp: str = "timestamp", out: str = "t_sec") -> DataFrame:
    """Seconds since day 1, with centiseconds."""
    return df.withColumn(out, clip_seconds(F.col(stamp)))


def lenient_seconds(stamp: Column) -> Column:
    parts = F.split(stamp, "_")
    day = F.try_to_number(F.regexp_extract(stamp, r"^(?:DAY)?(\d{1,9})_", 1), F.lit("999999999")).cast("long")
    clock = F.element_at(parts, 2)
    digits = [F.regexp_extract(F.substring(clock, at, 2), r"^(\d\d)$", 1) for at in (1, 3, 5)]
    hour, minute, second = (F.when(d != "", d.cast("long")) for d in digits)
    value = (day - 1) * DAY_SECONDS + hour * 3600 + minute * 60 + second
    return F.when((F.size(parts) == 2) & (F.length(clock) >= 6), value)


def with_seconds_safe(df: DataFrame, stamp: str = "timestamp", out: str = "t_whole") -> DataFrame:
    """P5: whole seconds since day 1; anything unreadable becomes null."""
    return df.withColumn(out, lenient_seconds(F.col(stamp)))


def day_prefix(event: Column) -> Column:
    return F.split_part(event, F.lit("_"), F.lit(1))


def event_stem(event: Column) -> Column:
    """The clip time an event id was made from, as relation targets are matched."""
    return F.replace(event, F.lit("_evt"), F.lit(""))


def with_day(df: DataFrame, event: str = "event_id", audio_root: str = "audios") -> DataFrame:
    """Day folder and audio path of an event."""
    day = day_prefix(F.col(event))
    audio = F.concat(F.lit(audio_root.rstrip("/") + "/"), day, F.lit("/"), event_stem(F.col(event)), F.lit(".wav"))
    return df.withColumns({"day_prefix": day, "audio_path": audio})
