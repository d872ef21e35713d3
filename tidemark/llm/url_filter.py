"""Judge URLs by host and path rules: a sort-merge range join with a sweep.

A URL is looked up under each suffix of its host that some rule names. There
its canonical key (reversed host, then path) falls into the intervals that the
rules' prefixes span. Rules and keys are sorted together and swept once: a rule
opens at its prefix and closes behind it, the running sum of both is the height
of the stack of open rules, and the last rule opened at the present height is
the innermost one that holds. DataFrame code only.

Keys of a hot host are dealt over several sweeps by a salt; only the rules of
that host are repeated, once a sweep.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import bounded, shuffle_partitions, written

#: Up to so many rule hosts (about 100 bytes each) are broadcast; more are shuffled.
MAX_BROADCAST_HOSTS = 100_000


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def rule_table(spark, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) tuples as a DataFrame; an empty host fits every URL."""
    rows = [F.struct(F.lit(verdict).alias("verdict"), F.lit(host).alias("host"), F.lit(path).alias("path")) for verdict, host, path in rules]
    return spark.range(1).select(F.inline(F.array(*rows).cast("array<struct<verdict:string,host:string,path:string>>")))


def _events(rules: DataFrame) -> DataFrame:
    """Per rule an opening at its prefix and a closing behind it, by sort key.

    No UTF-8 text holds the byte FF, so prefix + FF lies behind every text that
    starts with the prefix. A rule given twice is one rule, and blocks if either
    does.
    """
    one = rules.select(F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    one = one.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rule = F.struct(F.concat("host", "path").alias("rule"), "verdict")
    start = F.concat(reversed_host(F.col("host")), F.col("path")).cast("binary")
    turns = F.array(
        F.struct(start.alias("key"), F.lit(1).alias("turn"), rule.alias("opened")),
        F.struct(F.concat(start, F.unhex(F.lit("FF"))).alias("key"), F.lit(-1).alias("turn"), F.lit(None).cast("struct<rule:string,verdict:string>").alias("opened")),
    )
    return one.select("host", F.explode(turns).alias("t")).select("host", "t.*")


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict of every row.

    The longest rule (host and path together, as text) wins; of equally long
    ones that with the longer host. Without a rule the verdict is ``default``
    and rule is null. A null url, or one without ``://``, has an empty host and
    path. Repeated rows are judged alike. Columns of ``pages`` with one of the
    four names are replaced.
    """
    spark = pages.sparkSession
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(*keep, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    distinct = written(rows.select("host", "path").distinct(), "url-keys")
    events = _events(rules)
    depth = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 0
    found = _sweep(distinct, events, depth, shuffle_partitions(spark))
    # An equi-join that adaptive execution may split where one URL is frequent.
    return rows.join(found, ["host", "path"], "left").select(*keep, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _sweep(urls: DataFrame, events: DataFrame, depth: int, partitions: int) -> DataFrame:
    """The winning rule of each (host, path) that has one."""
    labels = F.split("host", r"\.")
    first = F.greatest(F.size(labels) - depth + 1, F.lit(1))
    suffixes = F.transform(F.sequence(first, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    suffixes = F.concat(F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(suffixes), F.array(F.lit("")))
    hosts = bounded(events.select(F.col("host").alias("at")).distinct(), MAX_BROADCAST_HOSTS)
    keys = written(urls.select("host", "path", F.explode(suffixes).alias("at")).join(hosts, "at"), "url-sought")
    per_host = keys.groupBy("at").agg(F.count("*").alias("keys"))
    total = max(keys.count(), 1)
    sweeps = per_host.select("at", F.ceil(F.col("keys") * 4 * partitions / total).cast("int").alias("sweeps"))
    sweeps = bounded(written(sweeps, "url-sweeps"), MAX_BROADCAST_HOSTS)
    sought = keys.join(sweeps, "at").select(
        "at",
        F.pmod(F.xxhash64("host", "path"), F.col("sweeps")).cast("int").alias("salt"),
        F.concat(reversed_host(F.col("at")), F.col("path")).cast("binary").alias("key"),
        F.lit(0).alias("turn"),
        F.lit(None).cast("struct<rule:string,verdict:string>").alias("opened"),
        "host",
        "path",
    )
    opened = events.withColumnRenamed("host", "at").join(sweeps, "at").select(
        "at", F.explode(F.sequence(F.lit(0), F.col("sweeps") - 1)).alias("salt"), "key", "turn", "opened", F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path")
    )
    # Openings sort before keys equal to their prefix; a closing key equals no other.
    order = [F.col("key"), F.col("turn").desc()]
    swept = Window.partitionBy("at", "salt").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slot = Window.partitionBy("at", "salt", "height").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = sought.unionByName(opened).withColumn("height", F.sum("turn").over(swept)).withColumn("top", F.last("opened", ignorenulls=True).over(slot))
    fits = held.where("turn = 0 AND height > 0").select("host", "path", "top.*", F.length("at").alias("host_length"))
    best = F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.col("host_length")))
    return fits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.*")
