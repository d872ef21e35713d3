"""The change feed as streams: append, debounce, deduplication, rename pairing.

Time is event time under a watermark; rows later than it are dropped. Each
stream runs until the available input is read and leaves a table, so its result
can be held against the batch operator of the same name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.sources.shared import shared_path


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream: id, file_id, kind, ts."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # A pattern, for the source takes a plain path to be a folder.
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    return raw.select(F.col("event_id").alias("id"), F.col("user_id").alias("file_id"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"))


def drained(stream: DataFrame, label: str) -> DataFrame:
    """Run an append stream over what is there and read what it wrote."""
    spark, out = stream.sparkSession, shared_path(stream.sparkSession, label)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{out}-log").option("path", out).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def fed_into(rows: DataFrame, order: str, goes: int, late: int, run: Callable[[DataFrame, str], None], label: str) -> None:
    """Let ``rows`` arrive in several goes, some of them late, and ``run`` a stream of them after each.

    Rows go to the feed by ranges of ``order`` (a whole number); each is put off
    by a hash of it, by less than ``late``, so it may come after rows of a higher
    one. ``run`` gets the stream and the folder of its log, the same each time, as
    a job does that is started anew.
    """
    spark, path = rows.sparkSession, shared_path(rows.sparkSession, f"{label}-feed")
    low, high = (x or 0 for x in rows.agg(F.min(order), F.max(order)).first())
    place = F.col(order) - low + F.pmod(F.xxhash64(order), F.lit(max(late, 1)))
    go = F.least(F.floor(place * goes / (high - low + max(late, 1))), F.lit(goes - 1))
    stream = spark.readStream.schema(rows.schema).parquet(f"{path}/*")
    for n in range(goes):
        rows.where(go == n).write.parquet(f"{path}/go={n}")
        run(stream, f"{path}-log")


def fed(rows: DataFrame, order: str, goes: int, late: int, make: Callable[[DataFrame], DataFrame], label: str, progress: list | None = None) -> DataFrame:
    """What ``make`` gives, as an append stream, of ``rows`` that arrive as in :func:`fed_into`; ``progress`` collects each run's last."""
    spark, out, schemas = rows.sparkSession, shared_path(rows.sparkSession, label), []

    def run(stream: DataFrame, log: str) -> None:
        made = make(stream)
        schemas.append(made.schema)
        query = made.writeStream.format("parquet").option("checkpointLocation", log).option("path", out).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        if progress is not None:
            progress.append(query.lastProgress)

    fed_into(rows, order, goes, late, run, label)
    return spark.read.schema(schemas[0]).parquet(out)


def append_batches(stream: DataFrame, label: str = "append") -> DataFrame:
    """Each micro-batch to a folder of its own number, so a repeated batch replaces itself."""
    spark, out = stream.sparkSession, shared_path(stream.sparkSession, label)
    query = (
        stream.writeStream.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}"))
        .option("checkpointLocation", f"{out}-log")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/*")


def debounced(changes: DataFrame, gap: str, delay: str) -> DataFrame:
    """Bursts by file, emitted once the watermark has passed their quiet gap.

    A change that comes more than ``delay`` after a later one is dropped, so only
    an input that arrives in order, or in one batch, may do without.
    """
    burst = changes.withWatermark("ts", delay).groupBy("file_id", F.session_window("ts", gap).alias("w"))
    return burst.agg(F.max_by("kind", F.struct("ts", "id")).alias("kind"), F.count("*").alias("n"), F.unix_millis(F.max("ts")).alias("last_ms"), F.unix_millis(F.min("ts")).alias("first_ms")).drop("w")


def deduplicated(changes: DataFrame, keys: list[str], delay: str) -> DataFrame:
    return changes.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def apply_batches(stream: DataFrame, on_changes: Callable[[DataFrame, int], None], on_overflow: Callable[[int], None], label: str = "changes") -> None:
    """Hand each micro-batch of changes (with a kind) on; overflow marks come first, once a batch.

    A feed that overflowed has lost changes, so ``on_overflow`` is to scan all
    roots again. Both get the batch's number, to make a repeated batch harmless.
    """

    def step(batch: DataFrame, number: int) -> None:
        if not batch.where("kind = 'overflow'").isEmpty():
            on_overflow(number)
        on_changes(batch.where("kind <> 'overflow'"), number)

    log = shared_path(stream.sparkSession, f"{label}-log")
    stream.writeStream.foreachBatch(step).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()


def halves_joined(sources: DataFrame, targets: DataFrame, gap_ms: int, delay: str) -> DataFrame:
    """Streams of rename halves (id, tracker, ts, path) joined by tracker within a gap; halves that meet none come out alone.

    Both sides have a watermark and the times of a pair bound each other, so a
    half leaves the state, alone or not, once the watermark has passed it by the
    gap. A half without a tracker meets none and comes out at once; it is kept
    from the join, whose state would take null for equal to null.
    """

    def side(rows: DataFrame, name: str) -> DataFrame:
        named = rows.select(*[F.col(c).alias(f"{name}_{c}") for c in ("tracker", "id", "path", "ts")])
        return named.withWatermark(f"{name}_ts", delay)

    f, t = side(sources, "from"), side(targets, "to")
    gap = F.expr(f"INTERVAL {gap_ms} MILLISECONDS")
    near = (F.col("from_tracker") == F.col("to_tracker")) & (F.col("from_ts") >= F.col("to_ts") - gap) & (F.col("from_ts") <= F.col("to_ts") + gap)
    joined = f.where("from_tracker IS NOT NULL").join(t.where("to_tracker IS NOT NULL"), near, "full")
    shape = lambda rows: rows.select(F.coalesce("from_tracker", "to_tracker").alias("tracker"), "from_id", "to_id", "from_path", "to_path", F.unix_millis(F.greatest("from_ts", "to_ts")).alias("t"))
    lone = lambda rows, other: rows.select("*", *[F.lit(None).cast(rows.schema[n].dataType).alias(m) for n, m in zip(rows.columns, other.columns)])
    return shape(joined).unionByName(shape(lone(f.where("from_tracker IS NULL"), t))).unionByName(shape(lone(t.where("to_tracker IS NULL"), f)))


PAIR = "tracker long, from_id long, to_id long, t long, change string"
HALVES = "tracker array<long>, id array<long>, is_source array<boolean>, t array<long>"
#: Groups that trackers are dealt to by their hash; a stream's state is kept by them, so the number stays.
BUCKETS = 512


def bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def paired(halves: DataFrame, gap_ms: int, delay: str) -> DataFrame:
    """Rename halves (id, tracker, is_source, ts) paired by tracker.

    The state of a tracker is the one half that waits. A half of the other
    direction within the gap pairs with it (renamed). A half that another takes
    the place of, or whose gap the watermark has passed, is told alone: a source
    as removed, a destination as touched. Trackers are handled by buckets of
    their hash, for a call and a state row each would cost more than their rows.
    """

    def alone(tracker: int, half: tuple) -> tuple:
        id_, is_source, t = half
        return (tracker, id_, None, t, "removed") if is_source else (tracker, None, id_, t, "touched")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = {tracker: tuple(half) for tracker, *half in zip(*state.get)} if state.exists else {}
        rows = [] if state.hasTimedOut else [r for f in frames for r in zip(*[f[c].tolist() for c in ("tracker", "t", "id", "is_source")])]
        told = []
        for tracker, t, id_, is_source in sorted(rows):
            half, other = (id_, is_source, t), waiting.pop(tracker, None)
            if other and other[1] != is_source and t - other[2] <= gap_ms:
                source, target = (other, half) if other[1] else (half, other)
                told.append((tracker, source[0], target[0], t, "renamed"))
            else:
                if other:
                    told.append(alone(tracker, other))
                waiting[tracker] = half
        watermark = state.getCurrentWatermarkMs()
        for tracker in [k for k, half in waiting.items() if half[2] + gap_ms + 1 < watermark]:
            told.append(alone(tracker, waiting.pop(tracker)))
        if waiting:
            state.update(tuple(list(c) for c in zip(*[(k, *half) for k, half in waiting.items()])))
            state.setTimeoutTimestamp(max(min(half[2] for half in waiting.values()) + gap_ms + 1, watermark + 1))
        elif state.exists:
            state.remove()
        if told:
            yield pd.DataFrame(told, columns=["tracker", "from_id", "to_id", "t", "change"], dtype=object)

    rows = halves.withWatermark("ts", delay).withColumn("t", F.unix_millis("ts"))
    # Without a tracker nothing tells which halves belong together, and null is no group.
    source = F.col("is_source")
    lone = rows.where("tracker IS NULL").select("tracker", F.when(source, F.col("id")).alias("from_id"), F.when(~source, F.col("id")).alias("to_id"), "t", F.when(source, "removed").otherwise("touched").alias("change"))
    dealt = rows.where("tracker IS NOT NULL").withColumn("bucket", bucket(F.col("tracker"))).groupBy("bucket")
    return dealt.applyInPandasWithState(step, PAIR, HALVES, "append", GroupStateTimeout.EventTimeTimeout).unionByName(lone)
