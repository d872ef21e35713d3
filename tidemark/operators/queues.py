"""Durable work queues (file_id, queued_at_unix, attempt_count) as tables.

Every function returns the queue's next state; the caller writes it as a new
version and never over the one being read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.sources.shared import written


def enqueue(queue: DataFrame, ids: DataFrame, now: int, reset: bool = False) -> DataFrame:
    """Ids are queued as of now; attempts are kept unless ``reset``."""
    news = ids.select("file_id").distinct().withColumn("_new", F.lit(True))
    merged = queue.join(news, "file_id", "full")
    kept = F.coalesce("attempt_count", F.lit(0))
    return merged.select(
        "file_id",
        F.when(F.col("_new"), F.lit(now).cast("long")).otherwise(F.col("queued_at_unix")).alias("queued_at_unix"),
        (F.when(F.col("_new"), F.lit(0)).otherwise(kept) if reset else kept).cast("int").alias("attempt_count"),
    )


def pending(queue: DataFrame, limit: int = schemas.QUEUE_BATCH) -> DataFrame:
    """The oldest rows that have attempts left."""
    return queue.where(F.col("attempt_count") < schemas.MAX_ATTEMPTS).orderBy("queued_at_unix", "file_id").limit(limit)


def record_attempt(queue: DataFrame, picked: DataFrame) -> DataFrame:
    """One more attempt for the picked rows, to be written before the work begins."""
    marked = queue.join(picked.select("file_id", F.lit(1).alias("_one")), "file_id", "left")
    return marked.select("file_id", "queued_at_unix", (F.col("attempt_count") + F.coalesce("_one", F.lit(0))).cast("int").alias("attempt_count"))


def complete(queue: DataFrame, done: DataFrame) -> DataFrame:
    return queue.join(done.select("file_id"), "file_id", "left_anti")


def drain_step(queue: DataFrame, inputs: DataFrame, work: Callable[[DataFrame], DataFrame], limit: int = schemas.QUEUE_BATCH) -> tuple[DataFrame, DataFrame]:
    """One turn of a worker: the results that succeeded, and the queue after it.

    The oldest pending rows are picked and their attempt is written before the
    work begins, so that a lost driver has used it up. ``work`` maps the picked
    rows of ``inputs`` to results with an error column; rows without an error
    leave the queue, others stay for as long as they have attempts.
    """
    picked = written(pending(queue, limit), "picked")
    tried = written(record_attempt(queue, picked), "queue")
    # At most ``limit`` ids.
    results = written(work(inputs.join(F.broadcast(picked.select("file_id")), "file_id", "left_semi")), "results")
    done = results.where("error IS NULL")
    return done, complete(tried, done)


def to_requeue(metadata: DataFrame, live_files: DataFrame, queue: DataFrame, version: int) -> DataFrame:
    """Files of an old extractor version, and live files neither extracted nor queued."""
    stale = metadata.where(F.col("extractor_version") < version).select("file_id", F.lit("stale").alias("reason"))
    never = live_files.select("file_id").join(metadata.select("file_id"), "file_id", "left_anti").join(queue.select("file_id"), "file_id", "left_anti")
    return stale.unionByName(never.select("file_id", F.lit("never").alias("reason")))


def stale_enrichment(enrichment: DataFrame, version: int) -> DataFrame:
    return enrichment.where(F.col("enrichment_version") < version).select("file_id")


def wants_model(enabled: bool, body: Column) -> Column:
    """Whether a text goes on to a model: the feature is on and the text long enough."""
    return F.lit(enabled) & (F.length(F.coalesce(body, F.lit(""))) >= schemas.MIN_ENRICH_CHARS)
