"""Sessions over a stream with late events: sent, corrected and expired.

Outside what the reference describes: a general addition.

Events of a micro-batch are first put together to parts of sessions where they lie, so that a key with a
third of all events sends few rows to its state. The state of a key is its open sessions. A session is sent when the
stream's time has passed its end by the gap, or with each change where ``eager``; an event that comes later, but not behind the watermark,
changes or joins sessions that were sent, which are taken back (sign -1) and sent anew (sign 1). Once the watermark
has passed a session's end by the gap nothing can change it, and a timer drops it from the state.
The sum of signs by session is at any time what was sent and holds; for a whole stream it is ``batch_sessions``.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A session: first and last event in microseconds, number of events, sum of their values.
SESSION = "start long, last long, n long, total long"


def _parts(gap_us: int):
    """Events of a batch as parts of sessions: neighbours of a key that are at most the gap apart."""

    def run(frames):
        for f in frames:
            f = f.dropna(subset=["key", "us"]).sort_values(["key", "us"])
            if not len(f):
                continue
            key, us = f["key"].to_numpy(), f["us"].to_numpy()
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (np.diff(us) > gap_us)])
            at = np.flatnonzero(new)
            ends = np.concatenate([at[1:], [len(f)]])
            total = np.add.reduceat(f["value"].fillna(0).to_numpy().astype(np.int64), at)
            yield pd.DataFrame({"key": key[at], "start": us[at], "last": us[ends - 1], "n": ends - at, "total": total})

    return run


def merged(sessions: list[list], gap_us: int) -> list[list]:
    """Sessions [start, last, n, total, sent] that are at most the gap apart, joined; sent is what was sent of each, a list."""
    out: list[list] = []
    for s in sorted(sessions, key=lambda s: s[:2]):
        if out and s[0] - out[-1][1] <= gap_us:
            last = out[-1]
            last[1], last[2], last[3] = max(last[1], s[1]), last[2] + s[2], last[3] + s[3]
            last[4] = last[4] + s[4]
        else:
            out.append([*s[:4], list(s[4])])
    return out


class Sessions(StatefulProcessor):
    """Open sessions of a key; rows (key, start, last, n, total, sign)."""

    def __init__(self, gap_us: int, delay_us: int, eager: bool):
        self.gap, self.delay, self.eager = gap_us, delay_us, eager

    def init(self, handle) -> None:
        self.handle = handle
        # a session's row, then a row for what was sent of it, told apart by is_sent; in order
        self.open = handle.getListState("open", "is_sent boolean, start long, last long, n long, total long")

    def _read(self) -> list[list]:
        out: list[list] = []
        for is_sent, *values in self.open.get() if self.open.exists() else ():
            if is_sent:
                out[-1][4].append(tuple(values))
            else:
                out.append([*values, []])
        return out

    def _write(self, sessions: list[list]) -> None:
        rows = [r for s in sessions for r in ((False, *s[:4]), *((True, *t) for t in s[4]))]
        if rows:
            self.open.put(rows)
        else:
            self.open.clear()

    def _settled(self, key, sessions: list[list], watermark_us: int):
        """What is due is sent, what has changed is corrected, what can't change goes; timers for the rest."""
        left, out, next_us = [], [], None
        for s in sessions:
            now, due = tuple(s[:4]), s[1] + self.gap
            if self.eager or s[4] or watermark_us >= due - self.delay:
                if s[4] != [now]:
                    out += [(*t, -1) for t in s[4]] + [(*now, 1)]
                    s[4] = [now]
            if watermark_us < due:
                left.append(s)
                at = due if s[4] else due - self.delay
                next_us = at if next_us is None else min(next_us, at)
        if next_us is not None:
            # one timer a key, for what comes first; then the next one is set. In milliseconds, up to the next one: a timer never comes early
            self.handle.registerTimer(max(-(-next_us // 1000), 1))
        self._write(left)
        if out:
            rows = pd.DataFrame(out, columns=["start", "last", "n", "total", "sign"])
            rows.insert(0, "key", key[0])
            yield rows

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        sessions = self._read()
        for frame in rows:
            sessions += [[int(a), int(b), int(n), int(t), []] for a, b, n, t in zip(frame["start"], frame["last"], frame["n"], frame["total"], strict=True)]
        yield from self._settled(key, merged(sessions, self.gap), timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        yield from self._settled(key, self._read(), timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def session_changes(events: DataFrame, key: str, time: str, value: Column, gap_us: int, delay_us: int, eager: bool = False) -> DataFrame:
    """A stream of (key, start, last, n, total, sign), start and last in microseconds, of a stream of events.

    ``value`` gives whole numbers, so that sums are exact; null counts as zero. Events with a null key or time go nowhere. An event
    that is more than ``delay_us`` behind the latest one may be dropped, as with any watermark; a part of a session is judged by its last event.
    The session needs the RocksDB state store (``ROCKS`` as spark.sql.streaming.stateStore.providerClass).
    """
    spark = events.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKS:
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass must be {ROCKS}")
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(F.col(key).alias("key"), F.unix_micros(F.col(time).cast("timestamp")).alias("us"), value.cast("long").alias("value"))
    parts = rows.mapInPandas(_parts(gap_us), f"key {kind}, {SESSION}")
    marked = parts.withColumn("at", F.timestamp_micros("last")).withWatermark("at", f"{delay_us} microseconds")
    return marked.groupBy("key").transformWithStateInPandas(Sessions(gap_us, delay_us, eager), f"key {kind}, {SESSION}, sign int", "Append", "EventTime")


def standing(changes: DataFrame) -> DataFrame:
    """The sessions that hold: those sent more often than taken back."""
    names = ["key", "start", "last", "n", "total"]
    return changes.groupBy(*names).agg(F.sum("sign").alias("sign")).where("sign > 0").select(*names)


def batch_sessions(events: DataFrame, key: str, time: str, value: Column, gap_us: int) -> DataFrame:
    """The sessions of a whole table, with the same columns as ``standing``.

    Parts are made where the rows lie and then joined: by key in time order, each is compared with the latest end before it.
    """
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(F.col(key).alias("key"), F.unix_micros(F.col(time).cast("timestamp")).alias("us"), value.cast("long").alias("value"))
    parts = rows.mapInPandas(_parts(gap_us), f"key {kind}, {SESSION}")
    order = Window.partitionBy("key").orderBy("start", "last", "n", "total")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    number = F.sum(F.when(F.col("start") - before <= gap_us, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    numbered = parts.withColumn("number", number)
    return numbered.groupBy("key", "number").agg(F.min("start").alias("start"), F.max("last").alias("last"), F.sum("n").alias("n"), F.sum("total").alias("total")).drop("number")


def replayed(spark: SparkSession, stream: DataFrame, key: str, time: str, value: Column, gap_us: int, delay_us: int, folder: str, eager: bool = True) -> DataFrame:
    """All that a stream has now, through the state, as rows of changes written below ``folder``."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        changes = session_changes(stream, key, time, value, gap_us, delay_us, eager)
        query = changes.writeStream.format("parquet").option("path", f"{folder}/changes").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(changes.schema).parquet(f"{folder}/changes")
