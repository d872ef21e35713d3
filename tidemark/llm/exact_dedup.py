"""Exact deduplication with a log-structured merge index of text digests.

Memtables of (digest, id) rows are flushed as sorted Parquet runs that carry
Bloom filters on the digest. Compaction merges all runs into one level that
keeps, per digest, the smallest identifier. Documents whose digest is shared
("hits") are verified byte by byte; a digest that different texts share is
resolved by the texts themselves.

Everything is DataFrame code. A digest that a third of all rows share is one
row per task after map-side aggregation, and joins back through a plain
equi-join, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import MAX_BROADCAST_IDS, bounded, one_spaced, shared_path, without, written

#: Up to so many shared digests the verification scan is filtered by a broadcast
#: (about 16 MB); beyond it by a shuffled semi-join.
MAX_BROADCAST_HITS = 200_000


def sha256(text: Column) -> Column:
    # Declared as never null, so that a join on it infers no filter that normalises and hashes every text once more.
    return F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b""))


class DigestIndex:
    """Runs and compacted level of digests under one shared folder."""

    def __init__(self, spark: SparkSession, root: str | None = None, id_type: str = "long"):
        self.spark = spark
        self.run_schema, self.level_schema = f"digest binary, id {id_type}, copies long", f"digest binary, keep_id {id_type}, n long"
        self.root = root or shared_path(spark, "digest-index")
        self.runs: list[str] = []
        self.level: str | None = None
        self.generation = 0

    def flush(self, keyed: DataFrame) -> str:
        """Write one memtable of (id, digest) rows as sorted runs with filters.

        A row repeated with the same id and digest is stored once with its
        number of copies. The exchange deals by digest and id together, so that
        no digest is a hot key.
        """
        path = f"{self.root}/level0-{len(self.runs)}-{self.generation}"
        memtable = keyed.groupBy("digest", "id").agg(F.count("*").alias("copies"))
        self._write(memtable.sortWithinPartitions("digest", "id"), path)
        self.runs.append(path)
        return path

    def members(self) -> DataFrame:
        return self.spark.read.schema(self.run_schema).parquet(*self.runs)

    def compact(self) -> DataFrame:
        """Merge all runs to one level: per digest the smallest id and the rows."""
        self.generation += 1
        path = f"{self.root}/level1-{self.generation}"
        merged = self.members().groupBy("digest").agg(F.min("id").alias("keep_id"), F.sum("copies").alias("n"))
        self._write(merged.sortWithinPartitions("digest"), path)
        self.level = path
        return self.compacted()

    def compacted(self) -> DataFrame:
        return self.spark.read.schema(self.level_schema).parquet(self.level)

    def _write(self, df: DataFrame, path: str) -> None:
        df.write.option("parquet.bloom.filter.enabled#digest", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    max_broadcast_hits: int = MAX_BROADCAST_HITS,
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, digest.

    Texts are equal if identical after each run of ASCII white space became one
    space; null counts as the empty text. Of equal texts exactly one row is
    kept: one with the smallest id (a null id is larger than any other). Rows
    that repeat both id and text are members like others, and one of them is
    kept. Ids keep their type. Other columns are ignored; an empty table gives no
    rows.
    """
    text = one_spaced(F.col(text_col))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("norm")).withColumn("digest", digest(F.col("norm")))
    index = DigestIndex(docs.sparkSession, id_type=keyed.schema["id"].dataType.simpleString())
    index.flush(keyed.select("id", "digest"))
    level = index.compact()
    members = index.members()
    unequal = _unequal_digests(keyed, level, max_broadcast_hits)
    if unequal is None:
        grouped = members.join(level, "digest")
    else:
        sound = members.join(unequal, "digest", "left_anti").join(level, "digest")
        grouped = sound.unionByName(_by_text(keyed.join(unequal, "digest", "left_semi")))
    return _one_kept(grouped, id_col)


def _unequal_digests(keyed: DataFrame, level: DataFrame, max_broadcast_hits: int) -> DataFrame | None:
    """Byte verification: digests whose texts differ, or None if there are none.

    The least and the greatest text of a digest are the same bytes only if all
    are. Aggregation starts in the map tasks, so a large group ships one pair of
    texts per task.
    """
    hits = bounded(level.where("n > 1").select("digest"), max_broadcast_hits)
    texts = keyed.join(hits, "digest", "left_semi").groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("greatest"))
    unequal = texts.where("least <> greatest").select("digest")
    return None if unequal.isEmpty() else unequal


def _by_text(keyed: DataFrame) -> DataFrame:
    """Groups by the texts themselves, for digests that did not verify."""
    members = keyed.groupBy("digest", "norm", "id").agg(F.count("*").alias("copies"))
    groups = keyed.groupBy("digest", "norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("n"))
    return members.join(groups, ["digest", "norm"]).select("digest", "id", "copies", "keep_id", "n")


def _one_kept(grouped: DataFrame, id_col: str) -> DataFrame:
    copy = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    return grouped.select("*", copy).select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("n").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        "digest",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` drops; columns stay.

    The dropped ids leave by an anti-join. Rows whose id is null or repeated are
    taken apart, however many rows there are besides: only these are matched by
    id and digest, and of rows alike in both one stays.
    """
    decided = written(exact_dedup(docs, id_col, text_col).select(F.col(id_col).alias("_id"), "kept", "digest"), "exact-decided")
    repeated = written(decided.where("_id IS NOT NULL").groupBy("_id").count().where("count > 1").select("_id"), "repeated-ids")
    some = not repeated.isEmpty()
    repeated = bounded(repeated, MAX_BROADCAST_IDS)
    dropped = decided.where("NOT kept AND _id IS NOT NULL").select("_id")
    plain = docs
    odd = docs.where(F.col(id_col).isNull())
    if some:
        dropped = dropped.join(repeated, "_id", "left_anti")
        of = lambda how: docs.join(repeated, F.col(id_col) == F.col("_id"), how)
        plain, odd = of("left_anti"), odd.unionByName(of("left_semi"))
    elif decided.where("_id IS NULL").isEmpty():
        return without(docs, dropped.withColumnRenamed("_id", id_col), id_col)
    plain = without(plain.where(F.col(id_col).isNotNull()), dropped.withColumnRenamed("_id", id_col), id_col)
    stays = decided.where("kept").select("_id", "digest").where(F.col("_id").isNull())
    if some:
        stays = stays.unionByName(decided.where("kept").select("_id", "digest").join(repeated, "_id", "left_semi"))
    keyed = odd.withColumn("_digest", sha256(one_spaced(F.col(text_col))))
    met = keyed.join(stays, keyed[id_col].eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("digest")), "left_semi")
    return plain.unionByName(met.dropDuplicates([id_col, "_digest"]).select(docs.columns))
