"""Counts of the store, and their text form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREFIX = "tidemark"


def stats(events: DataFrame, files: DataFrame, queue: DataFrame) -> DataFrame:
    """One row: events, live files that are no directories, and the queue's depth."""
    counts = events.agg(F.count("*").alias("events"))
    live = files.where("deleted_at IS NULL AND NOT is_dir").agg(F.count("*").alias("files"))
    depth = queue.agg(F.count("*").alias("pending_extractions"))
    return counts.join(F.broadcast(live)).join(F.broadcast(depth))


def rendered(values: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """Metric rows (name, help, type, value) as exposition text, three lines each."""
    full = F.concat(F.lit(f"{prefix}_"), "name")
    lines = F.array(F.concat_ws(" ", F.lit("# HELP"), full, "help"), F.concat_ws(" ", F.lit("# TYPE"), full, "type"), F.concat_ws(" ", full, F.col("value").cast("string")))
    return values.select("name", F.posexplode(lines).alias("line_no", "line"))


def parsed(lines: DataFrame, line: str = "line") -> DataFrame:
    """(name, value) of sample lines, values as floats; comments and values that are no numbers drop out."""
    cut = F.split(F.trim(F.col(line)), " +")
    rows = lines.where(~F.startswith(F.trim(F.col(line)), F.lit("#"))).select(F.get(cut, F.lit(0)).alias("name"), F.get(cut, F.lit(1)).try_cast("double").alias("value"))
    return rows.where("value IS NOT NULL")
