"""Event log: joins, latest rows, counts, grouping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import clock
from tidemark.operators.numbering import islands


def with_facts(events: DataFrame, metadata: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Events with the metadata and enrichment of their files, where known."""
    return events.join(metadata, "file_id", "left").join(enrichment, "file_id", "left")


def facet_filter(facets: dict[str, str | None]) -> Column | None:
    """Conjunction of the given equalities; null never matches. None without any."""
    for field, value in facets.items():
        schemas.check_facet(field, value)
    terms = [F.col(field) == value for field, value in facets.items() if value is not None]
    return reduce(lambda a, b: a & b, terms) if terms else None


def latest_per_file(events: DataFrame) -> DataFrame:
    """Each file's event of greatest id: one aggregate, no self-join."""
    columns = [c for c in events.columns if c != "file_id"]
    return events.groupBy("file_id").agg(F.max_by(F.struct(*columns), "id").alias("e")).select("file_id", "e.*")


def latest_ranked(events: DataFrame, ranked: DataFrame) -> DataFrame:
    """Latest event of each (file_id, rank) row; files without events drop out."""
    wanted = events.join(ranked.select("file_id").distinct(), "file_id", "left_semi")
    return latest_per_file(wanted).join(ranked, "file_id")


def facet_counts(rows: DataFrame, field: str, limit: int = schemas.FACET_LIMIT) -> DataFrame:
    """The commonest values of a facet; equal counts in order of the value."""
    schemas.check_facet(field, None)
    counted = rows.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("value")).agg(F.count("*").alias("count"))
    return counted.orderBy(F.desc("count"), "value").limit(limit)


def scan_summary(entries: DataFrame) -> DataFrame:
    """Files, directories, recorded changes and skipped entries of one scan."""
    return entries.agg(
        F.count_if(~F.col("is_dir")).alias("files_seen"),
        F.count_if("is_dir").alias("dirs_seen"),
        F.count_if(F.col("kind").isNotNull()).alias("events_recorded"),
        F.count_if("skipped").alias("skipped"),
    )


def by_day(events: DataFrame, now_ms: Column) -> DataFrame:
    counted = events.groupBy(clock.day(F.col("at_unix_ms")).alias("day")).agg(F.count("*").alias("n"), F.min("at_unix_ms").alias("_at"))
    return counted.select("day", "n", clock.day_label(F.col("_at"), now_ms).alias("label"))


def consecutive_days(rows: DataFrame, order: list[Column], now_ms: Column) -> DataFrame:
    """Stretches of neighbours of one day in the order of a listing: (n_group, day, label, n, first_id, last_id).

    A day comes again where the listing leaves it and returns. The order should
    be unique.
    """
    placed = islands(rows, clock.day(F.col("at_unix_ms")), order, "n_group")
    by = F.struct(*[o.alias(f"o{n}") for n, o in enumerate(order)])
    groups = placed.withColumn("_by", by).groupBy("n_group").agg(F.min(clock.day(F.col("at_unix_ms"))).alias("day"), F.min("at_unix_ms").alias("_at"), F.count("*").alias("n"), F.min_by("id", "_by").alias("first_id"), F.max_by("id", "_by").alias("last_id"))
    return groups.select("n_group", "day", clock.day_label(F.col("_at"), now_ms).alias("label"), "n", "first_id", "last_id")


def merged_page(shown: DataFrame, page: DataFrame) -> DataFrame:
    """The shown rows with those of the page that are new."""
    return page.join(shown.select("id"), "id", "left_anti").unionByName(shown)


def tail(log: DataFrame, order: list[str], n: int | None = None) -> DataFrame:
    """The last n rows (default 200, at most 2,000), oldest first."""
    n = schemas.clamp(n, schemas.LOG_DEFAULT, schemas.LOG_MAX)
    return log.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)
