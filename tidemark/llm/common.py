"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.sources.shared import shared_dir, shared_path, written

__all__ = ["bounded", "clashing", "least_rows", "n_words", "one_spaced", "shared_dir", "shared_path", "shuffle_partitions", "split_of", "table", "text_chunks", "without", "written"]

#: The six ASCII white-space characters that part words in the text contracts.
SPACE_RUN = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark (any store Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows.

    The count is measured, so the hint never meets a table that grew; a larger
    table is returned as it is and joins by a shuffle.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


#: Up to so many ids (about 32 MB in memory) leave a table by a broadcast.
MAX_BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """``docs`` without the rows of these ids; rows without an id stay.

    The ids are written and counted first. Few enough of them are broadcast, so
    that the texts that stay are not shuffled; more are joined by a shuffle.
    """
    gone = bounded(written(ids, "dropped-ids"), MAX_BROADCAST_IDS)
    return docs.join(gone, id_col, "left_anti").select(docs.columns)


def least_rows(rows: DataFrame, n: int, by: str | None = None) -> DataFrame:
    """One row for each of the ``n`` least draws (``draw``, a 64-bit hash), of each value of ``by`` if given.

    Rows that share a draw are made one first, so that copies neither count nor
    crowd others out. The draws are written and counted, and all but a share
    that holds ``n`` of them almost surely is filtered in the tasks that read
    them, so that what meets in one task is bounded by ``n`` and not by the
    number of tasks.
    """
    unit = F.shiftrightunsigned("draw", 11) / F.lit(float(1 << 53))
    enough = n + 6 * n**0.5 + 10
    keys = ["draw"] if by is None else [by, "draw"]
    rows = written(rows.dropDuplicates(keys), "draws")
    if by is None:
        total = rows.count()
        return rows.where(unit < F.lit(enough / max(total, 1))).orderBy(unit, "draw").limit(n)
    counts = bounded(rows.groupBy(by).agg(F.count("*").alias("_n")), 100_000)
    near = rows.join(counts, by).where(unit < F.lit(enough) / F.col("_n")).drop("_n")
    ranked = near.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(unit, "draw")))
    return ranked.where(F.col("_k") <= n).drop("_k")


def one_spaced(text: Column) -> Column:
    """The text with every run of white space made one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def n_words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null has 0.

    One pass over the text: each word, with the white space after it, becomes
    one character.
    """
    led = F.ltrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.octet_length(F.regexp_replace(led, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")).cast("long")


def split_of(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, mod ``modulus`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def text_chunks(texts: list, max_bytes: int = 8 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Slices of a batch's texts as UTF-8, of bounded size together.

    A text longer than the bound makes a slice of its own. Null is empty.
    """
    start, size, held = 0, 0, []
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(raw) > max_bytes:
            yield start, held
            start, size, held = i, 0, []
        held.append(raw)
        size += len(raw)
    if held:
        yield start, held


def clashing(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` without columns that an operator is about to add itself."""
    return df.drop(*[n for n in names if n in df.columns])
