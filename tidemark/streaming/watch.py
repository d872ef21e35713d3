"""Raw watch events to settled changes: pairing, expiry, supersession, debounce.

Raw events (id, ts, mode, path, to_path, tracker) are touches, removals and
renames, which come whole (``both``) or as halves (``from``, ``to``) that share a
tracker. Two processors work one after the other in one streaming query:

* by tracker, halves of opposite direction within a gap are one rename; a half
  without a partner is, the gap later, a removal (``from``) or a touch (``to``);
* by path, a change is told once the path was quiet for a while after it. A
  rename counts as a change of its destination and takes away what was pending
  at its source.

Both hold events back in state until the watermark has passed them and then take
them in order of time and id, so the result is the same however the events are
split into micro-batches. :func:`watched` is the same on a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from tidemark.operators import cdc
from tidemark.streaming.changes import bucket

#: Changes by path: a mark takes pending ones away and is never told.
CHANGE = "path string, at timestamp, id long, change string, from_path string"
MARK = "superseded"

#: State store that keeps timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def timers(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in a store that has timers."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, STORE)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["path", "at", "id", "change", "from_path"])
    return frame.assign(at=pd.to_datetime(frame["at"], unit="ms"))


class InOrder(StatefulProcessor):
    """Holds the events of a bucket of keys until the watermark has passed them, then hands each key's on in order.

    Keys are dealt to buckets by their hash, for a call and timers each would
    cost more than their events. Subclasses say when an event of a time may be
    handled (``wait_ms``) and what handling gives. Events of one key, time and id
    replace each other, so a row read twice counts once.
    """

    KEY = VALUE = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", f"key {self.KEY}, t long, id long, {self.VALUE}")

    def wait_ms(self) -> int:
        """How long after an event's time it may be handled."""
        return 0

    def values(self, rows: pd.DataFrame) -> Iterator[tuple]:
        """(key, time, id, ...) of each row."""
        raise NotImplementedError

    def handled(self, key, ripe: list[tuple], held: list[tuple], watermark: int) -> list[tuple]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = [event for frame in rows for event in self.values(frame)]
        if events:
            self.held.appendList(events)
            self.handle.registerTimer(min(e[1] for e in events) + self.wait_ms())
        return iter([])

    def taken(self) -> dict:
        """Every key's events, each once, in order."""
        by_key: dict = {}
        for key, t, id_, *value in self.held.get():
            by_key.setdefault(key, {})[t, id_] = value
        return {key: sorted((*k, *v) for k, v in events.items()) for key, events in by_key.items()}

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, told, left = timerValues.getCurrentWatermarkInMs(), [], []
        for name, held in self.taken().items():
            n = sum(h[0] + self.wait_ms() <= now for h in held)
            told += self.handled(name, held[:n], held, now)
            left += [(name, *h) for h in held[n:]]
        _keep(self.held, left)
        if left:
            self.handle.registerTimer(min(h[1] for h in left) + self.wait_ms())
        if told:
            yield _frame(told)

    def close(self) -> None:
        pass


def _keep(state, rows: list[tuple]) -> None:
    if rows:
        state.put(rows)
    elif state.exists():
        state.clear()


class Pairing(InOrder):
    """Halves of one tracker: renames, and what is left over when the gap has passed."""

    KEY, VALUE = "long", "is_source boolean, path string"

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getListState("waiting", "key long, t long, id long, is_source boolean, path string")

    def values(self, rows):
        yield from zip(*[rows[c].tolist() for c in ("tracker", "t", "id", "is_source", "path")])

    def alone(self, half: tuple) -> tuple:
        t, id_, is_source, path = half
        return path, t + self.gap_ms, id_, "removed" if is_source else "touched", None

    def taken(self):
        self.now_waiting = {key: tuple(half) for key, *half in self.waiting.get()} if self.waiting.exists() else {}
        return {key: [] for key in self.now_waiting} | super().taken()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
        _keep(self.waiting, [(k, *half) for k, half in self.now_waiting.items()])
        if self.now_waiting:
            self.handle.registerTimer(min(half[0] for half in self.now_waiting.values()) + self.gap_ms)

    def handled(self, key, ripe, held, watermark):
        told, waiting = [], self.now_waiting.pop(key, None)
        for half in ripe:
            if waiting and waiting[2] != half[2] and half[0] - waiting[0] <= self.gap_ms:
                source, target = (waiting, half) if waiting[2] else (half, waiting)
                told.append((target[3], half[0], half[1], "renamed", source[3]))
                if source[3] != target[3]:
                    told.append((source[3], half[0], half[1], MARK, None))
                waiting = None
            else:
                told += [self.alone(waiting)] if waiting else []
                waiting = half
        if waiting and waiting[0] + self.gap_ms <= watermark:
            told.append(self.alone(waiting))
            waiting = None
        if waiting:
            self.now_waiting[key] = waiting
        return told


class Settling(InOrder):
    """Changes of one path that nothing follows before the path has been quiet, at the time they have settled."""

    KEY, VALUE = "string", "change string, from_path string"

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def wait_ms(self) -> int:
        return self.quiet_ms

    def values(self, rows):
        at = rows["at"].astype("datetime64[ms]").astype("int64")
        yield from zip(rows["path"].tolist(), at.tolist(), *[rows[c].tolist() for c in ("id", "change", "from_path")])

    def handled(self, key, ripe, held, watermark):
        following = [*held[1:], None][: len(ripe)]
        quiet = [a for a, b in zip(ripe, following) if b is None or b[0] - a[0] >= self.quiet_ms]
        return [(key, t + self.quiet_ms, id_, change, source) for t, id_, change, source in quiet if change != MARK]


def whole(events: DataFrame, at: str = "at") -> tuple[DataFrame, DataFrame]:
    """Plain changes and renames that came whole, by path; and the halves that have a tracker.

    A half without a tracker is the removal or touch that it looks like: pairing
    it by guess could join two files' histories. Mere access is nothing.
    """
    half = F.col("mode").isin("from", "to")
    paired = half & F.col("tracker").isNotNull()
    change = F.when(F.col("mode") == "both", "renamed").when(F.col("mode").isin("removed", "from"), "removed").when(F.col("mode").isin("touched", "to"), "touched")
    null = F.lit(None).cast("string")
    row = lambda path, change, source: F.struct(path.alias("path"), F.col(at), F.col("id"), change.alias("change"), source.alias("from_path"))
    both = F.col("mode") == "both"
    rows = F.array_compact(
        F.array(
            F.when(change.isNotNull(), row(F.when(both, F.col("to_path")).otherwise(F.col("path")), change, F.when(both, F.col("path")))),
            F.when(both & (F.col("path") != F.col("to_path")), row(F.col("path"), F.lit(MARK), null)),
        )
    )
    plain = events.where(~paired).select(F.explode(rows).alias("r")).select("r.*")
    halves = events.where(paired).select("id", "tracker", (F.col("mode") == "from").alias("is_source"), "path", F.col(at))
    return plain, halves


def watch_stream(events: DataFrame, gap_ms: int, quiet_ms: int, delay: str) -> DataFrame:
    """Settled changes (path, at_ms, id, change, from_path) of a stream of raw events (with ``ts``).

    ``delay`` is how late an event may come after a later one. The stream must be
    started within :func:`timers`.
    """
    plain, halves = whole(events.withColumn("at", F.timestamp_millis(F.unix_millis("ts"))).withWatermark("at", delay))
    keyed = halves.withColumns({"t": F.unix_millis("at"), "bucket": bucket(F.col("tracker"))}).groupBy("bucket")
    pairs = keyed.transformWithStateInPandas(Pairing(gap_ms), CHANGE, "Append", "EventTime", eventTimeColumnName="at")
    settled = plain.unionByName(pairs).withColumn("bucket", bucket(F.col("path"))).groupBy("bucket").transformWithStateInPandas(Settling(quiet_ms), CHANGE, "Append", "EventTime", eventTimeColumnName="at")
    return settled.select("path", F.unix_millis("at").alias("at_ms"), "id", "change", "from_path")


def watched(events: DataFrame, gap_ms: int, quiet_ms: int) -> DataFrame:
    """Settled changes of a whole table of raw events, and when each has settled."""
    plain, halves = whole(events.withColumn("at", F.unix_millis("ts")))
    placed = cdc.rename_pairs(halves.withColumnRenamed("at", "t"), gap_ms)
    first, second = F.struct("id", "is_source", "path", "t"), F.col("_next")
    pair = placed.where("_next IS NOT NULL").select(F.when(F.col("is_source"), first).otherwise(second).alias("s"), F.when(F.col("is_source"), second).otherwise(first).alias("d"), second.alias("l"))
    null = F.lit(None).cast("string")
    renamed = pair.select(F.col("d.path").alias("path"), F.col("l.t").alias("at"), F.col("l.id").alias("id"), F.lit("renamed").alias("change"), F.col("s.path").alias("from_path"))
    marks = pair.where("s.path <> d.path").select(F.col("s.path").alias("path"), F.col("l.t").alias("at"), F.col("l.id").alias("id"), F.lit(MARK).alias("change"), null.alias("from_path"))
    alone = placed.where("NOT _paired").select("path", (F.col("t") + gap_ms).alias("at"), "id", F.when(F.col("is_source"), "removed").otherwise("touched").alias("change"), null.alias("from_path"))
    every = plain.unionByName(renamed).unionByName(marks).unionByName(alone)
    next_at = F.lead("at").over(Window.partitionBy("path").orderBy("at", "id"))
    quiet = every.withColumn("_next", next_at).where(F.col("_next").isNull() | (F.col("_next") - F.col("at") >= quiet_ms))
    return quiet.where(F.col("change") != MARK).select("path", (F.col("at") + quiet_ms).alias("at_ms"), "id", "change", "from_path")
