"""The timeline: what changed, most recent first, by page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators.events import facet_filter, with_facts
from tidemark.operators.paths import resolve
from tidemark.sources.shared import written

#: Fact columns of a timeline row, besides the event's own.
FACTS = (
    "doc_type title author language page_count word_count image_taken_at_unix image_camera_model git_branch git_head_commit git_head_author git_head_at_unix"
    " summary keywords entities classification"
).split()


def timeline(
    events: DataFrame,
    metadata: DataFrame,
    enrichment: DataFrame,
    limit: int | None = None,
    before_id: int | None = None,
    kind: str | None = None,
    files: DataFrame | None = None,
    **facets: str | None,
) -> DataFrame:
    """One page of events with the facts known of their files.

    Filters on events come first and reach the scan. Without a facet the page is
    cut before any join and facts are read for its files only; with one the
    joins come first, and Catalyst makes those whose nulls it rejects inner
    ones. Paths are resolved for the rows of the page only.
    """
    schemas.check_kind(kind)
    rows = events
    if before_id is not None:
        rows = rows.where(F.col("id") < before_id)
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    facts = [c for c in metadata.columns if c in FACTS]
    more = [c for c in enrichment.columns if c in FACTS]
    metadata, enrichment = metadata.select("file_id", *facts), enrichment.select("file_id", *more)
    order, n = [F.desc("at_unix_ms"), F.desc("id")], schemas.clamp(limit)
    condition = facet_filter(facets)
    if condition is None:
        rows = written(rows.orderBy(*order).limit(n), "page")
        # At most 500 ids.
        ids = F.broadcast(rows.select("file_id").distinct())
        metadata, enrichment = (t.join(ids, "file_id", "left_semi") for t in (metadata, enrichment))
    joined = with_facts(rows, metadata, enrichment)
    if condition is not None:
        joined = joined.where(condition)
    page = joined.select(*events.columns, *facts, *more).orderBy(*order).limit(n)
    if files is None:
        return page
    named = resolve(files, page.select(F.col("file_id").alias("id")).distinct()).withColumnRenamed("id", "file_id")
    return page.join(named, "file_id", "left")


def page_after(events: DataFrame, size: int, page: int) -> DataFrame:
    """Page ``page`` (from 1) by the cursor: each page starts before the last id of the one before.

    A page's last row is found by a top-k of at most 500 rows, one job a page.
    """
    before = None
    for _ in range(page - 1):
        last = next_before_id(_ordered(events, before, size)).first()
        if last is None or last["next_before_id"] is None:
            return events.limit(0)
        before = last["next_before_id"]
    return _ordered(events, before, size)


def _ordered(events: DataFrame, before: int | None, size: int) -> DataFrame:
    rows = events if before is None else events.where(F.col("id") < before)
    return rows.orderBy(F.desc("at_unix_ms"), F.desc("id")).limit(schemas.clamp(size))


def next_before_id(page: DataFrame) -> DataFrame:
    """Cursor for the next page: the last row's id, null for an empty page."""
    return page.agg(F.min_by("id", F.struct("at_unix_ms", "id")).alias("next_before_id"))


def json_rows(page: DataFrame) -> DataFrame:
    """Rows as JSON text; absent facts are left out."""
    return page.select("id", F.to_json(F.struct(*page.columns)).alias("json"))


def with_previous_path(events: DataFrame, paths: DataFrame, names: DataFrame) -> DataFrame:
    """Events with path and, for renames, the path before: previous parent and name.

    ``paths`` are (id, path), ``names`` (id, name); unknown kinds read as modified.
    """
    now = paths.select(F.col("id").alias("file_id"), "path")
    parent = paths.select(F.col("id").alias("prev_parent_id"), F.col("path").alias("_parent"))
    name = names.select(F.col("id").alias("prev_component_id"), F.col("name").alias("_name"))
    rows = events.join(now, "file_id", "left").join(parent, "prev_parent_id", "left").join(name, "prev_component_id", "left")
    kind = F.when(F.col("kind").isin(*schemas.EVENT_KINDS), F.col("kind")).otherwise("modified")
    before = F.when(F.col("_name").isNotNull(), F.concat(F.coalesce("_parent", F.lit("")), F.lit("/"), F.col("_name")))
    return rows.select("id", "file_id", kind.alias("kind"), "path", before.alias("previous_path"))
