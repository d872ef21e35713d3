"""Directory trees as snapshots, by Spark's binary file source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.text import any_directory


def scan(spark: SparkSession, root: str, skip_dirs: tuple[str, ...] = schemas.SKIP_DIRS, max_entries: int | None = None) -> DataFrame:
    """(path, size_bytes, mtime_unix) of the files below a root; contents are not read.

    Spark's file sources leave out names that begin with a dot or an underscore.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^[a-z]+:/*", "/")
    rows = files.select(path.alias("path"), F.col("length").alias("size_bytes"), F.unix_seconds("modificationTime").alias("mtime_unix"))
    depth = len([p for p in root.split("/") if p and not p.endswith(":")])
    rows = rows.where(~any_directory(F.col("path"), F.array(*[F.lit(d) for d in skip_dirs]), depth))
    return rows if max_entries is None else rows.limit(max_entries)


def heads(spark: SparkSession, root: str) -> DataFrame:
    """(path, head) with the first 8 KiB of each file, for sniffing.

    A file above 2 GiB, which Spark cannot hold in a value, has a null head.
    """
    read = contents(spark, root)
    return read.select("path", F.substring("content", 1, schemas.SNIFF_BYTES).alias("head"))


def contents(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, error): the first 64 MiB of each file.

    Spark holds a file in one value, so one above 2 GiB cannot be read: its
    content is null and ``error`` says so, else it is null.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    fits = F.col("length") <= (1 << 31) - 1
    read = files.where(fits).select("path", F.substring("content", 1, schemas.MAX_READ_BYTES).alias("content"), F.lit(None).cast("string").alias("error"))
    large = files.where(~fits).select("path", F.lit(None).cast("binary").alias("content"), F.lit("larger than 2 GiB").alias("error"))
    return read.unionByName(large)


def append(rows: DataFrame, path: str) -> None:
    """Append rows to a table in one commit; an empty frame adds none."""
    rows.write.mode("append").parquet(path)
