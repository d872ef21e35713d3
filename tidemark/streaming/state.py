"""The file state kept by a stream: one version a micro-batch.

A version is a folder of its own number, written whole, and the events of a
micro-batch one beside it. A batch reads the newest version below its own
number, so a batch that runs again, after a failure, writes the same again. The
two newest versions of the state stay, and all events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import cdc
from tidemark.sources.shared import drop_table, shared_path

STATE = "path string, size_bytes long, mtime_unix long, deleted_at long"
EVENTS = "path string, kind string, size_bytes long, at_unix_ms long"

#: The kind of the mark of a feed that has lost changes.
OVERFLOW = "overflow"


class StateTable:
    """Versions of the state, and the events that led from one to the next, in one folder."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root or shared_path(spark, "file-state")
        for name, schema in (("state", f"{STATE}, version long"), ("events", f"{EVENTS}, version long")):
            # Version partitions are seen by their folders; an empty write makes the table exist.
            spark.createDataFrame([], schema).write.partitionBy("version").mode("append").parquet(f"{self.root}/{name}")

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(f"{schema}, version long").parquet(f"{self.root}/{name}")

    def before(self, version: int) -> DataFrame:
        """The state that a batch of this number starts from; empty if it is the first."""
        rows = self._read("state", STATE).where(F.col("version") < version)
        last = rows.agg(F.max("version")).first()[0]
        return rows.where(F.col("version") == F.lit(last)).drop("version")

    def latest(self) -> DataFrame:
        return self.before((1 << 63) - 1)

    def events(self) -> DataFrame:
        return self._read("events", EVENTS)

    def put(self, state: DataFrame, events: DataFrame, version: int) -> None:
        events.select("path", "kind", "size_bytes", "at_unix_ms").write.mode("overwrite").parquet(f"{self.root}/events/version={version}")
        state.select("path", "size_bytes", "mtime_unix", "deleted_at").write.mode("overwrite").parquet(f"{self.root}/state/version={version}")
        # A batch that runs again needs the version before its own, and none before that.
        drop_table(self.spark, f"{self.root}/state/version={version - 2}")


def applied(state: DataFrame, seen: DataFrame, at_ms: int) -> tuple[DataFrame, DataFrame]:
    """State and events after what was ``seen`` (path, size_bytes, mtime_unix; no size: it was gone) of some paths.

    What was there and is known by no live row is created, and takes the newest
    tombstone of its path if it has one; of other size or time it is modified;
    what was gone and was live is deleted. All else changes nothing.
    """
    there = seen.where("size_bytes IS NOT NULL")
    kinds = cdc.decide(seen, state, there)
    gone = kinds.where("kind = 'deleted'").select("path")
    news = there.join(kinds.where("kind <> 'deleted'").select("path"), "path", "left_semi")
    after, _ = cdc.tombstoned(cdc.upsert(state, news), gone, F.lit(at_ms).cast("long"))
    told = kinds.join(there.select("path", "size_bytes"), "path", "left")
    return after, told.withColumn("at_unix_ms", F.lit(at_ms).cast("long"))


def rescanned(state: DataFrame, snapshot: DataFrame, at_ms: int) -> tuple[DataFrame, DataFrame]:
    """State and events after a full scan: what it does not hold is gone."""
    missing = state.where("deleted_at IS NULL").select("path").join(snapshot, "path", "left_anti")
    null = F.lit(None).cast("long")
    return applied(state, snapshot.select("path", "size_bytes", "mtime_unix").unionByName(missing.select("path", null.alias("size_bytes"), null.alias("mtime_unix"))), at_ms)


def merge_batch(table: StateTable, batch: DataFrame, number: int, rescan: Callable[[], DataFrame] | None = None) -> None:
    """One micro-batch of looks at paths (path, kind, t, id, size_bytes, mtime_unix) as the next version.

    Of several looks at a path the last by time and id counts. If the batch holds
    an overflow mark, changes were lost: then first all roots are scanned once
    (``rescan`` gives path, size_bytes, mtime_unix), and the batch's own looks
    change only what is newer than that scan, that is nothing.
    """
    rows = batch.where(F.col("kind") != OVERFLOW)
    last = rows.groupBy("path").agg(F.max_by(F.struct("size_bytes", "mtime_unix"), F.struct("t", "id")).alias("s")).select("path", "s.*")
    at_ms = batch.agg(F.coalesce(F.max("t"), F.lit(0))).first()[0]
    state = table.before(number)
    if rescan is not None and not batch.where(F.col("kind") == OVERFLOW).isEmpty():
        after, events = rescanned(state, rescan(), at_ms)
    else:
        after, events = applied(state, last, at_ms)
    table.put(after, events, number)


def merge_stream(looks: DataFrame, table: StateTable, rescan: Callable[[], DataFrame] | None = None, log: str | None = None) -> None:
    """Run a stream of looks into a state table until the input at hand is read; the batch's number is its version."""
    query = (
        looks.writeStream.foreachBatch(lambda batch, number: merge_batch(table, batch, number, rescan))
        .option("checkpointLocation", log or f"{table.root}/log")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
