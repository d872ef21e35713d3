"""Mix sources to target weights by weighted sampling without replacement.

Every document gets an exponential key divided by its quality weight
(Efraimidis-Spirakis); within its source the documents are sorted by the key
and their sizes summed up to the source's word budget. Whole epochs of a
source come first, the rest is the head of the sorted order.

A hot source is cut into ranges of the logarithm of the key: each range is sorted
on its own and starts from the sum of the ranges before it, so no task sorts a
whole source. Whatever the weights, the logarithm of an exponential draw lies in
any range of length r with a chance of at most r / e, so that ranges of like
length bound the pieces for equal, extreme and mixed weights alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import MAX_BROADCAST_IDS, SPACES, bounded, clashing, n_words, shuffle_partitions, written
from tidemark.operators.numbering import numbered


#: Weights below (0 and negative ones) count as this.
LEAST_WEIGHT = 1e-9
#: Up to so many sources meet the texts by a broadcast; more by a shuffle.
MAX_SOURCES = 100_000


def exponential_key(id_col: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight with u in (0, 1) drawn from 52 bits of md5(seed:id)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(1 << 52))) / F.greatest(weight, F.lit(LEAST_WEIGHT))


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, max_epochs: float) -> tuple[DataFrame, int]:
    """Per source: source_key, source_size, rows, target; and the rows of all.

    Sources in code point order, null last, take the weights in turn and share
    ``share`` times all words. A target above ``max_epochs`` times its source's
    size stops there, and what is over is shared again by weight until none is
    above. Each round is one aggregate over one row per source; the driver sees
    sums only.
    """
    per_source = sizes.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    placed = numbered(per_source, F.col("source").asc_nulls_last(), "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    ranked = written(placed.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(max_epochs)), "mix-sources")
    total, rows = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    level, capped = 0.0, -1
    while True:
        above = F.col("cap") < F.col("weight") * level
        n, held, free = ranked.agg(F.count(F.when(above, 1)), F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))).first()
        if n == capped or not free:
            break
        level, capped = (total * share - held) / free, n
    target = F.least(F.col("cap"), F.col("weight") * level)
    return ranked.select("source_key", "source_size", "rows", target.alias("target")), rows


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality: DataFrame | None = None,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 42,
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken.

    ``quality`` has columns (id, weight), one row an id; a document without one
    weighs 1, as does a null weight, and weights below 1e-9 count as 1e-9: such
    documents come last. Other columns of ``docs`` are ignored. Sizes are words; a null text has 0. ``taken`` is a multiple of
    the size: whole epochs of the source, and once more for documents at the
    head of the key order. The document that the budget ends in is taken if that
    comes nearer to the target. Equal keys (repeated rows) go by id, then size.
    A null source is a source of its own. An empty table gives no rows.
    """
    summed = _summed(docs, id_col, text_col, source_col, quality, weights, share, max_epochs, seed)
    taken = F.col("size") * (F.col("epochs") + F.when(F.col("once_more"), 1).otherwise(0))
    return summed.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def take(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality: DataFrame | None = None,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 42,
) -> DataFrame:
    """The rows of ``docs`` that :func:`mix` takes words of, with size, source_size, target and taken.

    What a source takes in part is the head of its key order, so a source's
    decisions are its epochs and its last (key, id). Those, one row a source,
    meet the texts, which are not shuffled for them. The keys are drawn again from
    the ids; weights other than 1 are written and counted, and up to a million
    are broadcast, more join by a shuffle of the texts.

    Every row comes back once; rows of a source that repeat an id (or lack one)
    are taken alike, as often as the most taken of them. Columns of ``docs`` by
    the four names give way. Texts without a word and empty tables give no rows.
    """
    summed = _summed(docs, id_col, text_col, source_col, quality, weights, share, max_epochs, seed)
    last = F.max(F.when(F.col("once_more") & (F.col("size") > 0), F.struct("key", "id"))).alias("_mix_last")
    heads = summed.groupBy("source_key").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("epochs").alias("_mix_epochs"), last)
    heads = bounded(written(heads, "mix-heads"), MAX_SOURCES).withColumnRenamed("source_key", "_mix_source")
    rows = clashing(docs, ["size", "source_size", "target", "taken"])
    names = rows.columns
    weight = F.lit(1.0)
    if quality is not None:
        given = quality.toDF("_mix_id", "_mix_weight").where(F.col("_mix_weight").cast("double") != 1.0)
        rows = rows.join(bounded(written(given, "mix-weights"), MAX_BROADCAST_IDS), F.col(id_col) == F.col("_mix_id"), "left")
        weight = F.coalesce(F.col("_mix_weight").cast("double"), F.lit(1.0))
    drawn = F.struct(exponential_key(F.col(id_col), weight, seed).alias("key"), F.col(id_col).alias("id"))
    times = F.coalesce(F.col("_mix_epochs"), F.lit(0)) + F.when(drawn <= F.col("_mix_last"), 1).otherwise(0)
    met = rows.join(heads, _source_key(F.col(source_col)) == F.col("_mix_source"))
    some = met.where((times > 0) & (F.ltrim(F.col(text_col), F.lit(SPACES)) != ""))
    sized = some.select(*names, n_words(F.col(text_col)).alias("size"), "source_size", "target", times.alias("_mix_times"))
    return sized.select(*names, "size", "source_size", "target", (F.col("size") * F.col("_mix_times")).cast("long").alias("taken"))


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("null")).otherwise(F.concat(F.lit("source:"), source.cast("string")))


def _summed(docs: DataFrame, id_col: str, text_col: str, source_col: str, quality: DataFrame | None, weights: Sequence[int], share: float, max_epochs: float, seed: int) -> DataFrame:
    """Every document with its source's sums, whole epochs, and whether it is taken once more."""
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size")).withColumn("source_key", _source_key(F.col("source")))
    if quality is None:
        sized = sized.withColumn("weight", F.lit(1.0))
    else:
        given = quality.toDF("id", "weight")
        sized = sized.join(given, "id", "left").withColumn("weight", F.coalesce(F.col("weight").cast("double"), F.lit(1.0)))
    drawn = written(sized.withColumn("key", exponential_key(F.col("id"), F.col("weight"), seed)), "mix-drawn")
    targets, rows = source_targets(drawn, weights, share, max_epochs)
    pieces = 3 * shuffle_partitions(docs.sparkSession)
    ranges = F.greatest(F.lit(1), F.ceil(F.col("rows") * pieces / max(rows, 1)))
    placed = drawn.join(targets, "source_key").withColumn("piece", F.floor(F.log("key") * ranges))
    placed = written(placed.select("id", "source", "source_key", "size", "key", "source_size", "target", "piece"), "mix-placed")
    before = Window.partitionBy("source_key").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("source_key", "piece").agg(F.sum("size").alias("words"))
    starts = starts.select("source_key", "piece", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("source_key", "piece").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.withColumn("within", F.sum("size").over(within)).join(starts, ["source_key", "piece"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    summed = summed.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("upto", F.col("start") + F.col("within"))
    under = F.col("rest") - (F.col("upto") - F.col("size"))
    once_more = (F.col("upto") <= F.col("rest")) | ((under > 0) & (F.col("upto") - F.col("rest") < under))
    return summed.withColumn("once_more", once_more)
