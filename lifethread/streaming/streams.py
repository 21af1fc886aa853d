"""Incremental jobs (ST1-ST4): the batch operators' states kept by Structured Streaming.

Rows are put in event-time order inside a micro-batch. An event that comes after later ones of its key were
processed does not change them: what was decided stays decided.
"""

from __future__ import annotations

import datetime
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lifethread import schemas
from lifethread.runtime import ship
from lifethread.operators.graph import ChainTails
from lifethread.operators.resolve import (
    ENTITY_STATE, VOICE_STATE, EntityLibrary, EntityRules, VoiceLibrary, VoiceRules, entity_schema, hear_rows, see_rows, voice_schema,
)

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Stateful Python operators need this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def stream_events(
    spark: SparkSession, path: str, delay: str = "1 day", schema: str = schemas.EVENT, fmt: str = "json",
    event_time=None, key: str = "event_id", **options: str,
) -> DataFrame:
    """ST1: event records as files arrive; each id once within the watermark.

    The checkpoint remembers which files were read, so a restart goes on where it stopped.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    for name, value in options.items():
        reader = reader.option(name, value)
    rows = reader.load(path)
    at = F.to_timestamp("attributes.interaction_time") if event_time is None else event_time
    return rows.withColumn("event_time", at).withWatermark("event_time", delay).dropDuplicatesWithinWatermark([key])


BATCHES = "batch_id long, rows_in long, rows_late long, watermark timestamp"


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is there and stop; the result is a Parquet table.

    Returns one row per micro-batch of this run (batch_id, rows_in, rows_late, watermark). ``rows_late`` are those
    that came behind the watermark and were dropped by a stateful step. Batch ids and the watermark go on over restarts
    with the same checkpoint, so the rows of all runs together are the whole account.
    """
    query = (
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode(mode).trigger(availableNow=True).start()
    )
    seen: dict[int, dict] = {}
    done = False
    while not done:  # the query keeps its last hundred reports only
        done = query.awaitTermination(1)
        seen.update((p["batchId"], p) for p in query.recentProgress)
    rows = []
    for number, report in sorted(seen.items()):
        late = sum(op["numRowsDroppedByWatermark"] for op in report["stateOperators"])
        mark = report["eventTime"].get("watermark")
        at = datetime.datetime.fromisoformat(mark.replace("Z", "+00:00")) if mark else None
        rows.append((number, report["numInputRows"], late, at))
    return df.sparkSession.createDataFrame(rows, BATCHES)


def only_new(batch: DataFrame, done: DataFrame, key: str = "event_id") -> DataFrame:
    """Rows of a micro-batch whose id the store does not hold; for ``foreachBatch`` sinks written more than once."""
    return batch.join(done.select(key), key, "left_anti")


class _Ordered(StatefulProcessor):
    """Collects the rows a key has in one micro-batch and handles them in time order.

    A key's rows of one micro-batch are held together; bound them by ``maxFilesPerTrigger`` or ``maxBytesPerTrigger``.
    """

    order: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        out = self.step(key, batch)
        if len(out):
            yield out

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.begin(key, initialState)

    def begin(self, key, stored: pd.DataFrame) -> None:
        raise ValueError("this job has no stored state to begin with")

    def close(self) -> None:
        pass


class _Rows:
    """Whole rows as typed columns of a state: times are microseconds and days numbers, in the stream (``plain``) and in the state."""

    def __init__(self, schema: T.StructType, ids: tuple[str, ...]):
        of = lambda *kinds: [f.name for f in schema if isinstance(f.dataType, kinds) and f.name not in ids]
        self.names = schema.names
        self.times, self.days = of(T.TimestampType, T.TimestampNTZType), of(T.DateType)
        self.numbers, self.lists = of(T.IntegralType, T.FractionalType), of(T.ArrayType)
        self.numbers = [n for n in self.numbers if not isinstance(schema[n].dataType, T.DecimalType)]
        kind = lambda f: T.LongType() if f.name in self.times or f.name in self.days else f.dataType
        self.schema = T.StructType([T.StructField(f.name, kind(f)) for f in schema])

    def plain(self, df: DataFrame) -> DataFrame:
        """``df`` as the state holds its rows; times as the session's clock shows them."""
        clock = lambda n: F.timestamp_diff("MICROSECOND", F.lit(datetime.datetime(1970, 1, 1)).cast("timestamp_ntz"), F.col(n).cast("timestamp_ntz"))
        now = {**{n: clock(n) for n in self.times}, **{n: F.unix_date(n).cast("long") for n in self.days}}
        return df.select(*[now.get(n, F.col(n)).alias(n) for n in self.names])

    def get(self, stored: tuple) -> dict:
        """A row as ``build_chains`` shows it to a predicate."""
        row = dict(zip(self.names, stored))
        for n in self.times:
            row[n] = pd.NaT if row[n] is None else pd.Timestamp(row[n], unit="us")
        for n in self.days:
            row[n] = None if row[n] is None else _FIRST_DAY + datetime.timedelta(row[n])
        for n in self.numbers:
            row[n] = math.nan if row[n] is None else row[n]
        for n in self.lists:
            row[n] = None if row[n] is None else np.asarray(row[n])
        return row


_FIRST_DAY = datetime.date(1970, 1, 1)


def _last_if_null(*values) -> tuple:
    return tuple((v is None or v != v, 0 if v is None or v != v else v) for v in values)


class _Chains(StatefulProcessor):
    """Rows are handled as they are, without a frame per key; a chain end is a stored row beside what a predicate sees of it."""

    def __init__(self, predicate, participant: str, event: str, t: str, rows: _Rows):
        self.predicate, self.rows = predicate, rows
        self.participant, self.event, self.t = (rows.names.index(n) for n in (participant, event, t))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tails = handle.getListState("tails", self.rows.schema)

    def _ordered(self, rows) -> list[tuple]:
        return sorted(map(tuple, rows), key=lambda x: _last_if_null(x[self.t], x[self.event]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        seen = (lambda x: None) if self.predicate is None else self.rows.get
        chains = ChainTails(None if self.predicate is None else lambda new, tail: self.predicate(new[1], tail[1]))
        chains.tails = [(tuple(x), seen(x)) for x in self.tails.get()]
        for row in self._ordered(rows):
            tail = chains.add((row, seen(row)))
            if tail is not None:
                yield Row(participant=row[self.participant], src=tail[0][self.event], dst=row[self.event], type="NEXT_EVENT")
        self.tails.put([x for x, _ in chains.tails])

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.tails.put(self._ordered([*self.tails.get(), initialState]))

    def close(self) -> None:
        pass


def _begun(stored: DataFrame | None, *keys: str):
    return None if stored is None else stored.groupBy(*keys)


def stream_chains(
    df: DataFrame, predicate: Callable[[dict, dict], bool] | None = None, participant: str = "participant",
    event: str = "event_id", t: str = "t_sec", begin: DataFrame | None = None,
) -> DataFrame:
    """ST2: NEXT_EVENT edges as events arrive; the state is the open chain ends of a participant.

    Chain ends are kept as typed columns, so a predicate sees the values that it sees in ``build_chains``. ``begin``: open
    ends to start with, rows of the columns of ``df``.
    """
    kind = lambda c: df.schema[c].dataType.simpleString()
    schema = f"participant {kind(participant)}, src {kind(event)}, dst {kind(event)}, type string"
    ship(df.sparkSession)
    rows = _Rows(df.schema, (participant, event))
    begin = None if begin is None else rows.plain(begin)
    return rows.plain(df).groupBy(participant).transformWithState(
        _Chains(predicate, participant, event, t, rows), schema, "Append", "None", _begun(begin, participant)
    )


class _Voices(_Ordered):
    def __init__(self, rules: VoiceRules):
        self.rules = rules
        self.order = ["t_sec", "event_id", "pos"]

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.voices = handle.getMapState("voices", "number int", VOICE_STATE)

    def step(self, key, batch: pd.DataFrame) -> pd.DataFrame:
        library = VoiceLibrary(self.rules)
        for (number,), voice in sorted(self.voices.iterator(), key=lambda x: x[0][0]) if self.voices.exists() else []:
            library.load(number, *voice)
        batch = batch.assign(participant=key[0])
        out = list(hear_rows(library, batch))
        for number in sorted(library.touched):
            self.voices.updateValue((number,), library.dump(number))
        names = ["participant", "event_id", "speaker", "voice_id", "is_new", "match_score", "mean_updated", "register_score"]
        return pd.DataFrame(out, columns=names)

    def begin(self, key, stored: pd.DataFrame) -> None:
        for row in stored.to_dict("records"):
            library = VoiceLibrary(self.rules)
            library.load(0, row["mean"], row["score"], row["duration"], row["unit"])
            self.voices.updateValue((int(row["number"]),), library.dump(0))


def stream_resolve(df: DataFrame, rules: VoiceRules = VoiceRules(), begin: DataFrame | None = None) -> DataFrame:
    """ST3: voices of speakers as segments arrive; the state is one entry per voice, only touched ones are rewritten.

    ``begin``: a stored library (``resolve.voice_library``) that the first batch goes on from.
    """
    ship(df.sparkSession)
    return df.groupBy("participant").transformWithStateInPandas(
        _Voices(rules), voice_schema(df), "Append", "None", _begun(begin, "participant")
    )


class _Entities(_Ordered):
    def __init__(self, rules: EntityRules):
        self.rules = rules
        self.order = ["t_sec", "event_id", "pos"]

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.entities = handle.getMapState("entities", "number int", ENTITY_STATE)

    def step(self, key, batch: pd.DataFrame) -> pd.DataFrame:
        library = EntityLibrary(self.rules)
        for _, entity in sorted(self.entities.iterator(), key=lambda x: x[0][0]) if self.entities.exists() else []:
            library.load(*entity)
        out = list(see_rows(library, batch.assign(participant=key[0])))
        for i in sorted(library.touched):
            self.entities.updateValue((i,), library.dump(i))
        names = ["participant", "event_id", "pos", "global_name", "is_new", "text_similarity", "vision_similarity", "final_score", "error"]
        return pd.DataFrame(out, columns=names)

    def begin(self, key, stored: pd.DataFrame) -> None:
        for row in stored.to_dict("records"):
            library = EntityLibrary(self.rules)
            library.load(row["name"], row["text"], row["vectors"])
            self.entities.updateValue((int(row["number"]),), library.dump(0))


def stream_entities(df: DataFrame, rules: EntityRules | None = None, begin: DataFrame | None = None) -> DataFrame:
    """ST3: global entities of objects as they arrive; the state is one entry per entity.

    ``begin``: a stored library (``resolve.entity_library``) that the first batch goes on from.
    """
    ship(df.sparkSession)
    return df.groupBy("participant").transformWithStateInPandas(
        _Entities(rules or EntityRules()), entity_schema(df), "Append", "None", _begun(begin, "participant")
    )


class _Temporal(StatefulProcessor):
    """Keys are many and have few rows each, so rows are handled as they are, without a frame per key."""

    def __init__(self, n: int, max_s: float, event: str, t: str):
        self.n, self.max_s, self.event, self.t = n, max_s, event, t

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "event string, t double")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = lambda v, none: (v is None, none if v is None else v)  # nulls come last
        batch = sorted(((row[self.t], row[self.event]) for row in rows), key=lambda r: (*known(r[0], 0.0), *known(r[1], 0)))
        past = [(e, t) for e, t in self.recent.get()]
        for t, event in batch:
            t, event = math.nan if t is None else float(t), str(math.nan if event is None else event)
            earlier = [p for p in past if p[1] < t][-self.n :]
            for e, at in earlier:
                gap = round(t - at, 6)
                if 0 < gap <= self.max_s:
                    yield Row(event_id=event, related_event_id=e, type="temporal_after", time_diff_seconds=gap)
            past = sorted([*past, (event, t)], key=lambda p: p[1])
            newest = past[-1][1]  # n strictly earlier ones and all of the newest time can still count
            past = [p for p in past if p[1] < newest][-self.n :] + [p for p in past if p[1] == newest]
        self.recent.put(past)

    def close(self) -> None:
        pass


def stream_temporal_edges(
    df: DataFrame, n: int = 5, max_s: float = 60.0, keys: tuple[str, ...] = ("participant", "day"), event: str = "event_id", t: str = "t_sec"
) -> DataFrame:
    """ST4: ``temporal_after`` relations as events arrive; the state is the last ``n`` events of a day."""
    ship(df.sparkSession)
    return df.select(*keys, event, t).groupBy(*keys).transformWithState(
        _Temporal(n, max_s, event, t), "event_id string, related_event_id string, type string, time_diff_seconds double", "Append", "None"
    )
