"""Structured Streaming forms of the telemetry operators.

Event time is ``ts``; rows later than the watermark are dropped. State is kept by key and ends by timers on event time: when the
watermark passes the time after which nothing more can come of a key, what is still to be said of it is said, and its state
goes. A stream that has no more files is closed by ``closing_events``, which bring the watermark past all timers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import NumericType, StructType

WATERMARK = "1 day"
DAY_US = 86_400_000_000
#: Buckets of keys; each is one row of state.
BUCKETS = 1024
#: What says that a stream has come to its end; no operator takes it for a stage.
END = "end of stream"


def read_events(spark: SparkSession, path: str, schema: StructType, watermark: str = WATERMARK, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of event files with a watermark on ``ts``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def closing_events(events: DataFrame, after: str = "30 days") -> DataFrame:
    """Two rows of the shape of ``events``, far behind all of them and in two partitions: the first moves the watermark, the second lets timers fire."""
    last = events.agg(F.max("ts").alias("ts"))
    row = {f.name: F.lit(None).cast(f.dataType) for f in events.schema} | {"event_id": F.lit(-1).cast(events.schema["event_id"].dataType), "user_id": F.lit(-1).cast(events.schema["user_id"].dataType), "event_type": F.lit(END)}
    rows = last.select((F.coalesce("ts", F.lit("2000-01-01").cast(events.schema["ts"].dataType)) + F.expr(f"interval {after}")).alias("_ts"), F.explode(F.array(F.lit(0), F.lit(1))).alias("_n"))
    return rows.repartitionByRange(2, "_n").select(*((F.col("_ts") + F.make_interval(days=F.col("_n"))).alias("ts") if c == "ts" else row[c].alias(c) for c in events.columns))


def quiet_sessions(events: DataFrame, key: str, gap: str) -> DataFrame:
    """Sessions of a key that end when nothing came for ``gap``, with the last event of each (what a debounced writer writes).

    In append mode a session is given, and its state goes, when the watermark has passed its end.
    """
    last = F.max_by("event_id", F.struct("ts", "event_id"))
    out = events.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), last.alias("event_id"))
    return out.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("quiet_at"), "n", "event_id")


class Kept(StatefulProcessor):
    """State of keys: one value for each, and a time at which ``due`` is asked what is to be said and what is left.

    Subclasses say what new rows do (``take``) and what the time does (``due``); both give rows, the next value (None: nothing is
    kept) and the time in microseconds at which to ask again. Keys are dealt into buckets by hash. A bucket's values are one row of
    state with one timer, that of the key which is due first: reading, writing and timers cost a call for each bucket
    and batch, not for each key.
    """

    #: The value's columns, the columns that are given besides the key's, and those that the rows need besides us and event_id.
    value: str
    out: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.state)

    def _read(self) -> dict[tuple, tuple[int, tuple]]:
        """The time and value of each key of the bucket."""
        if not self.held.exists():
            return {}
        n = len(self.keys)
        return {row[:n]: (row[n], row[n + 1 :]) for row in zip(*self.held.get(), strict=True)}

    def _write(self, kept: dict[tuple, tuple[int, tuple]]) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if kept:
            self.held.update(tuple(map(list, zip(*((*key, due, *value) for key, (due, value) in kept.items()), strict=True))))
            self.handle.registerTimer(min(due for due, _ in kept.values()) // 1000 + 1)
        else:
            self.held.clear()

    @staticmethod
    def _keep(kept: dict[tuple, tuple[int, tuple]], key: tuple, after: tuple | None, due: int | None) -> None:
        if after is None:
            kept.pop(key, None)
        else:
            kept[key] = due, after

    def _given(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.names).astype(object if not rows else self.kinds)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # the whole batch of a bucket is ordered first: its parts may come in any order
        data = pd.concat(list(rows))
        data = data[data["stage"] != END]
        if len(data):
            nulls = int(key[0]) // self.buckets
            present = [k for i, k in enumerate(self.keys) if not nulls >> i & 1]
            data = data.sort_values([*present, "us", "event_id"])
            columns = {c: data[c].tolist() for c in data.columns}
            keys = list(zip(*(columns[k] if k in present else [None] * len(data) for k in self.keys), strict=True))
            kept, out, first = self._read(), [], 0
            for end in range(1, len(keys) + 1):
                if end == len(keys) or keys[end] != keys[first]:
                    own = keys[first]
                    said, *left = self.take({c: v[first:end] for c, v in columns.items()}, kept[own][1] if own in kept else None)
                    out += [(*own, *r) for r in said]
                    self._keep(kept, own, *left)
                    first = end
            self._write(kept)
            yield self._given(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept, out = self._read(), []
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        for own in [k for k, (due, _) in kept.items() if due // 1000 + 1 <= now]:
            said, *left = self.due(kept[own][1], now * 1000)
            out += [(*own, *r) for r in said]
            self._keep(kept, own, *left)
        self._write(kept)
        yield self._given(out)

    def close(self) -> None:
        pass

    def take(self, rows: dict[str, list], held: tuple | None) -> tuple[list[tuple], tuple | None, int | None]:
        """What the columns of a key's new rows, in order, say and leave."""
        raise NotImplementedError

    def due(self, held: tuple, now_us: int) -> tuple[list[tuple], tuple | None, int | None]:
        """Nothing is said at the end of a key's time, unless a subclass does."""
        return [], None, None


def by_key(events: DataFrame, keys: list[str], processor: Kept) -> DataFrame:
    """``events`` (ts, event_id, stage and keys) through a keyed state; gives the keys and the processor's columns."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in events.select(*keys).schema]
    shape = ", ".join([*kinds, processor.out])
    processor.keys, processor.buckets = list(keys), BUCKETS
    processor.names = [c.split()[0] for c in shape.split(", ")]
    numbers = {"long": "Int64", "bigint": "Int64", "int": "Int32", "boolean": "boolean"}
    processor.kinds = {c.split()[0]: numbers.get(c.split()[1], object) for c in shape.split(", ")}
    processor.state = ", ".join(f"{kind}_{name} array<{of}>" for kind, columns in (("key", kinds), ("at", ["due long"]), ("value", processor.value.split(", "))) for name, of in map(str.split, columns))
    # keys with nulls have buckets of their own, and numbers stand for the nulls, so that pandas makes no floats of the others' numbers
    nulls = sum((F.col(k).isNull().cast("int") * (1 << i) for i, k in enumerate(keys)), F.lit(0))
    rows = events.withColumn("us", F.unix_micros("ts")).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)) + nulls * BUCKETS)
    rows = rows.withColumns({f.name: F.coalesce(f.name, F.lit(0).cast(f.dataType)) for f in events.select(*keys).schema if isinstance(f.dataType, NumericType)})
    return rows.groupBy("_bucket").transformWithStateInPandas(statefulProcessor=processor, outputStructType=shape, outputMode="Append", timeMode="EventTime")


class Heartbeats(Kept):
    """(us): events at least ``every_us`` after the last one that was emitted. A key is forgotten ``keep_us`` after its last event."""

    value, out = "beat long, last long", "us long"

    def __init__(self, every_us: int, keep_us: int = DAY_US):
        self.every, self.keep = every_us, keep_us

    def take(self, rows, held):
        beat, out = held[0] if held else None, []
        for us in rows["us"]:
            if beat is None or us - beat >= self.every:
                out.append((us,))
                beat = us
        last = rows["us"][-1]
        return out, (beat, last), last + self.keep


class ChangedTokens(Kept):
    """(event_id): events whose change token is not that of the key's last event. A key is forgotten ``keep_us`` after its last event."""

    value, out = "token string", "event_id long"

    def __init__(self, token: str, keep_us: int = DAY_US):
        self.token, self.keep = token, keep_us

    def take(self, rows, held):
        token, out = held[0] if held else None, []
        for event, now in zip(rows["event_id"], rows[self.token], strict=True):
            if now != token:
                out.append((event,))
            token = now
        return out, (token,), rows["us"][-1] + self.keep


class Settled(Kept):
    """(since_us): a row for each key that ends settled: since when it had no event that unsettles it, if that is ``least_us`` before its last event.

    A key ends when the watermark is ``keep_us`` past its last event; then the row is given and the state goes.
    """

    value, out = "since long, last long", "since_us long"

    def __init__(self, unsettled: str, least_us: int, keep_us: int = DAY_US):
        self.unsettled, self.least, self.keep = unsettled, least_us, keep_us

    def take(self, rows, held):
        since, last = held or (None, None)
        for us, now in zip(rows["us"], rows["stage"], strict=True):
            since = None if now == self.unsettled else us if since is None else since
            last = us
        return [], (since, last), last + self.keep

    def due(self, held, now_us):
        since, last = held
        return ([(since,)] if since is not None and last - since >= self.least else []), None, None


class BoundedWaits(Kept):
    """(event_id, state): each start mark once, as "done" when an end mark follows within ``most_us``, as "timed out" when the time has passed."""

    value, out = "events array<long>, at array<long>", "event_id long, state string"

    def __init__(self, start: str, end: str, most_us: int):
        self.start, self.end, self.most = start, end, most_us

    def _kept(self, waiting):
        return (([e for e, _ in waiting], [at for _, at in waiting]), min(at for _, at in waiting) + self.most) if waiting else (None, None)

    def take(self, rows, held):
        waiting, out = list(zip(*held, strict=True)) if held else [], []
        for event, us, now in zip(rows["event_id"], rows["us"], rows["stage"], strict=True):
            if now == self.end:
                out += [(e, "done" if us - at <= self.most else "timed out") for e, at in waiting if us > at]
                waiting = [(e, at) for e, at in waiting if us <= at]
            elif now == self.start:
                waiting.append((event, us))
        return out, *self._kept(waiting)

    def due(self, held, now_us):
        waiting = list(zip(*held, strict=True))
        out = [(e, "timed out") for e, at in waiting if at + self.most < now_us]
        return out, *self._kept([(e, at) for e, at in waiting if at + self.most >= now_us])


class LatestCycle(Kept):
    """(event_id, change): events of the newest cycle of a key (1), and again those of a cycle that a newer one supersedes (-1)."""

    value, out = "cycle long, events array<long>", "event_id long, change int"

    def __init__(self, cycle: str, keep_us: int = DAY_US):
        self.cycle, self.keep = cycle, keep_us

    def take(self, rows, held):
        newest, given = (held[0], list(held[1])) if held else (None, [])
        out = []
        for event, cycle in zip(rows["event_id"], rows[self.cycle], strict=True):
            if newest is None or cycle > newest:
                out += [(e, -1) for e in given]
                newest, given = cycle, []
            if cycle == newest:
                out.append((event, 1))
                given.append(event)
        return out, (newest, given), rows["us"][-1] + self.keep


class PairedMarks(Kept):
    """(start_id, end_id, us, forced): start and end marks of a key. A newer start within ``most_us`` replaces an open one, an end closes it; else it is forced to close after that time."""

    value, out = "start_id long, start_us long", "start_id long, end_id long, us long, forced boolean"

    def __init__(self, start: str, end: str, most_us: int = DAY_US):
        self.start, self.end, self.most = start, end, most_us

    def take(self, rows, held):
        out = []
        for event, us, now in zip(rows["event_id"], rows["us"], rows["stage"], strict=True):
            if held and us - held[1] > self.most:
                out.append((held[0], None, self.most, True))
                held = None
            if now == self.start:
                held = event, us
            elif now == self.end and held:
                out.append((held[0], event, us - held[1], False))
                held = None
        return out, held, held[1] + self.most if held else None

    def due(self, held, now_us):
        return [(held[0], None, self.most, True)], None, None


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there into a Parquet table."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start(path)
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def run_to_batches(stream: DataFrame, path: str, checkpoint: str, mode: str) -> None:
    """Runs a stream that gives whole or updated results; each batch is written with its number as ``_batch``, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/_batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
