"""Semantic search with facets, filtered after ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark import schemas
from tidemark.operators import knn
from tidemark.operators.events import facet_filter, latest_ranked, with_facts
from tidemark.sources.shared import written


def search(vectors: DataFrame, events: DataFrame, metadata: DataFrame, enrichment: DataFrame, query: Sequence[float], limit: int | None = None, before: bool = False, **facets: str | None) -> DataFrame:
    """Nearest files with their latest event, facts and distance.

    A facet is applied to the ranked candidates, of which a filtered search
    takes more, so fewer than ``limit`` rows may come back. With ``before`` the
    facet restricts the vectors first and the result is exact and full.
    """
    limit = schemas.clamp(limit)
    condition = facet_filter(facets)
    if condition is not None and before:
        facts = metadata.join(enrichment, "file_id", "left").where(condition).select("file_id")
        near = knn.exact(vectors.join(facts, "file_id", "left_semi"), query, limit)
    else:
        near = knn.two_stage(vectors, query, knn.pool(limit, condition is not None))
    # At most 500 rows from here on, ranked once for the two joins that need them.
    near = written(near, "ranked")
    ranked = near.withColumn("rank", F.row_number().over(Window.orderBy("distance", "file_id")))
    hits = with_facts(latest_ranked(events, ranked), metadata, enrichment)
    if condition is not None:
        hits = hits.where(condition)
    return hits.orderBy("rank").limit(limit)
