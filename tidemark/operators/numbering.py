"""Positions in a global order without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.sources.shared import written


def dealt(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` dealt by ranges of the order and written, with the number of their range in ``_range``."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def previous(rows: DataFrame, by: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """Rows of :func:`dealt` with the value of the row before, of equal ``by``, in the order they were dealt by.

    Neighbours in one range are found there; the first row of a range takes the
    last value of the nearest range before it, from a table of one row per range
    and value of ``by``. So no group, however large, meets in one task. Null
    equals null in ``by``; the value of no row is null.
    """
    keyed = rows.withColumn("_value", F.struct(value.alias("v"))).withColumn("_order", F.struct(*[o.alias(f"o{n}") for n, o in enumerate(order)]))
    within = Window.partitionBy("_range", *by).orderBy("_order")
    near = keyed.withColumn("_before", F.lag("_value").over(within))
    lasts = keyed.groupBy("_range", *by).agg(F.max_by("_value", "_order").alias("_last"))
    carried = lasts.withColumn("_carried", F.lag("_last").over(Window.partitionBy(*by).orderBy("_range"))).drop("_last")
    carried = carried.select(F.col("_range").alias("_r"), *[F.col(b).alias(f"_b{n}") for n, b in enumerate(by)], "_carried")
    same = F.col("_range") == F.col("_r")
    for n, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_b{n}"))
    found = near.join(carried, same)
    return found.select(*[c for c in rows.columns], F.coalesce("_before", "_carried")["v"].alias(name))


def islands(rows: DataFrame, label: Column, order: list[Column], name: str = "island") -> DataFrame:
    """``rows`` with the number (from 1) of their stretch of equal labels in a global order, which should be unique.

    Stretches open where the label differs from the row before; they are counted
    by range, each from those of the ranges before it. Null is a label of its own.
    """
    marked = previous(dealt(rows.withColumn("_label", label), *order), [], order, F.struct(F.col("_label").alias("l")), "_prev")
    opens = marked.withColumn("_opens", F.when(F.col("_prev").isNotNull() & F.col("_prev.l").eqNullSafe(F.col("_label")), 0).otherwise(1))
    within = F.sum("_opens").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = opens.groupBy("_range").agg(F.sum("_opens").alias("_n"))
    starts = sums.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = opens.withColumn("_k", within).join(F.broadcast(starts), "_range")
    return placed.withColumn(name, F.col("_k") + F.col("_start")).drop("_range", "_label", "_prev", "_opens", "_k", "_start")


def numbered(rows: DataFrame, order: Column, name: str = "n") -> DataFrame:
    """``rows`` with their position (from 1) in the order of ``order``, which should be unique.

    Rows are dealt by ranges of the order and written; each range is numbered on
    its own and starts from the rows of the ranges before it, a table of one row
    per range.
    """
    placed = dealt(rows, order)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_rows"))
    starts = sizes.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return placed.withColumn("_k", within).join(F.broadcast(starts), "_range").withColumn(name, F.col("_k") + F.col("_start")).drop("_range", "_k", "_start")
