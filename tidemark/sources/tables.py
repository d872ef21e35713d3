"""The given tables seen as a file history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.text import word_count


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ev: event log; users stand for files."""
    kind = F.create_map(*[F.lit(x) for x in ("signup", "created", "error", "deleted", "purchase", "renamed")])
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("file_id"),
        F.coalesce(F.try_element_at(kind, F.col("event_type")), F.lit("modified")).alias("kind"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("at_unix_ms"),
        F.get_json_object("props", "$.k").cast("long").alias("size_bytes"),
    )


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fm: metadata of all documents."""
    size = F.col("n_chars")
    return (
        table(spark, sf_dir, "documents")
        .select(
            F.col("doc_id").alias("file_id"),
            F.when(size < 300, "text").when(size < 2000, "docx").otherwise("pdf").alias("doc_type"),
            F.col("source").alias("author"),
            F.col("lang").alias("language"),
            word_count(F.col("text")).alias("word_count"),
            F.substring("text", 1, schemas.MAX_BODY_CHARS).alias("body_text"),
            F.when(F.col("doc_id") % 4 < 2, 1).otherwise(2).alias("extractor_version"),
        )
    )


def enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fe: classification of labelled documents."""
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("junk")
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("file_id"), kind.alias("classification"), (F.col("doc_id") % 3).cast("int").alias("enrichment_version"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.knn import stored

    return stored(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("file_id"), "embedding"), 64)


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of the pages: host and path of each URL, without query and fragment."""
    bare = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", "/"), r"[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", bare.alias("path"))


def page_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tree: one node (id, parent_id, name) per distinct prefix of the page paths."""
    from tidemark.operators.paths import tree_of

    return tree_of(page_paths(spark, sf_dir).select("path"))


def nation_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tree2: region, nation and customer as three levels."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    null = F.lit(None).cast("long")
    rows = region.select(F.col("r_regionkey").cast("long").alias("id"), null.alias("parent_id"), F.col("r_name").alias("name"))
    rows = rows.unionByName(nation.select((F.col("n_nationkey") + 1000).cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("parent_id"), F.col("n_name").alias("name")))
    return rows.unionByName(
        customer.select((F.col("c_custkey") + 1_000_000).cast("long").alias("id"), (F.col("c_nationkey") + 1000).cast("long").alias("parent_id"), F.col("c_name").alias("name"))
    )


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"))
    return ids.select("file_id", (F.col("file_id") * 7919 % 10007).alias("queued_at_unix"), (F.col("file_id") % 7).cast("int").alias("attempt_count"))


def snapshot(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    """Two directory snapshots: (path, size_bytes, mtime_unix)."""
    size = F.col("n_chars") + (F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0) if new else F.lit(0))
    rows = table(spark, sf_dir, "documents").where(f"doc_id % {7 if new else 10} <> 0")
    path = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"))
    return rows.select("doc_id", path.alias("path"), size.cast("long").alias("size_bytes"), (F.col("doc_id") * 60).alias("mtime_unix"))


def rename_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).where("kind = 'renamed'")
    return rows.select("id", F.col("file_id").alias("tracker"), (F.col("id") % 2 == 0).alias("is_source"), F.col("at_unix_ms").alias("t"))


def watch_events(raw: DataFrame) -> DataFrame:
    """Raw watch events of the events table (or a stream of it): id, ts, mode, path, to_path, tracker.

    Users stand for files and trackers; a purchase is a rename, a fifth of them
    whole, the others halves, some without a tracker.
    """
    id_, user = F.col("event_id"), F.col("user_id")
    name = lambda n: F.concat(F.lit("/f"), n.cast("string"))
    rename, whole = F.col("event_type") == "purchase", F.col("event_id") % 5 == 0
    mode = F.when(rename & whole, "both").when(rename & (id_ % 2 == 0), "from").when(rename, "to").when(F.col("event_type") == "error", "removed").when(F.col("event_type") == "view", "access").otherwise("touched")
    return raw.select(
        id_.alias("id"),
        F.col("ts").cast("timestamp").alias("ts"),
        mode.alias("mode"),
        name(F.when(mode == "to", user + 1).otherwise(user)).alias("path"),
        F.when(mode == "both", name(user + 1 + id_ % 3)).alias("to_path"),
        F.when(mode.isin("from", "to") & (id_ % 11 != 0), user).alias("tracker"),
    )
