"""Change detection between snapshots, and the state that changes make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def changed(a: str, b: str) -> Column:
    """Size or modification time differs; null equals null."""
    return ~(F.col(f"{a}.size_bytes").eqNullSafe(F.col(f"{b}.size_bytes")) & F.col(f"{a}.mtime_unix").eqNullSafe(F.col(f"{b}.mtime_unix")))


def diff(old: DataFrame, new: DataFrame, deletes: bool = False) -> DataFrame:
    """(path, kind, size_bytes) of what changed from the live state ``old`` to the snapshot ``new``.

    New paths are created, paths of other size or time modified. Only with
    ``deletes`` are missing paths deleted. An unchanged snapshot gives nothing.
    """
    o, n = old.alias("o"), new.alias("n")
    joined = n.join(o, F.col("n.path") == F.col("o.path"), "full" if deletes else "left")
    kind = F.when(F.col("n.path").isNull(), "deleted").when(F.col("o.path").isNull(), "created").when(changed("n", "o"), "modified")
    path = F.coalesce("n.path", "o.path").alias("path")
    return joined.select(path, kind.alias("kind"), F.col("n.size_bytes").alias("size_bytes")).where("kind IS NOT NULL")


def upsert(state: DataFrame, snapshot: DataFrame) -> DataFrame:
    """State (path, size_bytes, mtime_unix, deleted_at) after a snapshot.

    A path of the snapshot takes its live row, else its newest tombstone, and is
    live with the new size and time; other rows stay. One shuffle by path: the
    candidate row is chosen by a rank, and the merge is a union with a window.
    """
    order = Window.partitionBy("path").orderBy(F.col("deleted_at").isNull().desc(), F.col("deleted_at").desc())
    ranked = state.withColumn("_k", F.row_number().over(order))
    news = snapshot.select("path", F.col("size_bytes").alias("_size"), F.col("mtime_unix").alias("_mtime"), F.lit(1).alias("_k"), F.lit(True).alias("_new"))
    merged = ranked.join(news, ["path", "_k"], "full")
    return merged.select(
        "path",
        F.when(F.col("_new"), F.col("_size")).otherwise(F.col("size_bytes")).alias("size_bytes"),
        F.when(F.col("_new"), F.col("_mtime")).otherwise(F.col("mtime_unix")).alias("mtime_unix"),
        F.when(F.col("_new"), F.lit(None).cast("long")).otherwise(F.col("deleted_at")).alias("deleted_at"),
    )


def tombstoned(state: DataFrame, gone: DataFrame, at_ms: Column) -> tuple[DataFrame, DataFrame]:
    """State with the live rows of the ``gone`` paths tombstoned, and their deleted events."""
    marked = state.join(gone.select("path", F.lit(True).alias("_gone")).distinct(), "path", "left")
    hit = F.col("_gone") & F.col("deleted_at").isNull()
    after = marked.withColumn("deleted_at", F.when(hit, at_ms).otherwise(F.col("deleted_at"))).drop("_gone")
    return after, marked.where(hit).select("path", F.lit("deleted").alias("kind"), at_ms.alias("at_unix_ms"))


def fold(events: DataFrame) -> DataFrame:
    """State of each file after its events: the last one decides."""
    last = F.max_by(F.struct("id", "kind", "at_unix_ms", "size_bytes"), "id")
    folded = events.groupBy("file_id").agg(last.alias("e"), F.count("*").alias("n_events"))
    gone = F.when(F.col("e.kind") == "deleted", F.col("e.at_unix_ms"))
    return folded.select("file_id", F.col("e.id").alias("last_id"), F.col("e.size_bytes").alias("size_bytes"), gone.alias("deleted_at"), "n_events")


def keep_newest(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows by key, those of ``new`` in place of old ones; of new rows that repeat a key one stays."""
    new = new.dropDuplicates([key])
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def coalesced(changes: DataFrame, gap: str) -> DataFrame:
    """Bursts of changes (file_id, ts, kind, id) as one each: the last kind after a quiet gap."""
    burst = changes.groupBy("file_id", F.session_window("ts", gap).alias("w"))
    return burst.agg(F.max_by("kind", F.struct("ts", "id")).alias("kind"), F.count("*").alias("n"), F.unix_millis(F.max("ts")).alias("last_ms"), F.unix_millis(F.min("ts")).alias("first_ms")).drop("w")


def raw_kind(kind: Column) -> Column:
    """Kinds of raw watch events: removals, touches, and null for mere access."""
    return F.when(kind == "deleted", "removed").when(kind.isin("created", "modified", "renamed", "any", "other"), "touched")


def rename_pairs(halves: DataFrame, gap_ms: int) -> DataFrame:
    """Rename halves (id, tracker, is_source, t) with their pair number and place.

    Within a tracker, halves of opposite direction at most ``gap_ms`` apart and
    next to each other make a run; in a run the first and second are a pair, the
    third and fourth, and so on. A half of the same direction starts a new run,
    so the newer of two alike is the one that pairs. A half without a tracker has
    no mate: a guess could join two files' histories.
    """
    lone, halves = halves.where("tracker IS NULL"), halves.where("tracker IS NOT NULL")
    order = Window.partitionBy("tracker").orderBy("t", "id")
    linked = (F.lag("is_source").over(order) != F.col("is_source")) & (F.col("t") - F.lag("t").over(order) <= gap_ms)
    runs = halves.withColumn("_run", F.sum(F.when(linked, 0).otherwise(1)).over(order))
    within = Window.partitionBy("tracker", "_run").orderBy("t", "id")
    placed = runs.withColumn("_k", F.row_number().over(within))
    mate = Window.partitionBy("tracker", "_run", F.floor((F.col("_k") - 1) / 2)).orderBy("_k")
    half = F.struct(*[c for c in halves.columns if c != "tracker"])
    mated = placed.withColumn("_next", F.lead(half).over(mate)).withColumn("_paired", F.count("*").over(mate.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) == 2)
    alone = lone.withColumns({"_run": F.lit(1).cast("long"), "_k": F.lit(1), "_next": F.lit(None).cast(mated.schema["_next"].dataType), "_paired": F.lit(False)})
    return mated.unionByName(alone)


def paired(halves: DataFrame, gap_ms: int) -> DataFrame:
    """(tracker, from_id, to_id, t) of each pair."""
    rows = rename_pairs(halves, gap_ms).where("_next IS NOT NULL")
    source = F.when(F.col("is_source"), F.col("id")).otherwise(F.col("_next.id"))
    target = F.when(F.col("is_source"), F.col("_next.id")).otherwise(F.col("id"))
    return rows.select("tracker", source.alias("from_id"), target.alias("to_id"), F.col("_next.t").alias("t"))


def unpaired(halves: DataFrame, gap_ms: int) -> DataFrame:
    """Halves that found no mate: a source became a removal, a destination a touch."""
    return rename_pairs(halves, gap_ms).where("NOT _paired").select("id", "tracker", F.when(F.col("is_source"), "removed").otherwise("touched").alias("change"))


def rename_action(from_excluded: Column, to_excluded: Column) -> Column:
    """What a rename is where a side lies in an excluded directory."""
    return F.when(from_excluded & to_excluded, "ignore").when(from_excluded, "arrival").when(to_excluded, "departure").otherwise("rename")


def decide(touched: DataFrame, state: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(path, kind) of touched paths, held against the live state and what is there now.

    Gone before it could be looked at is deleted if it was known, else nothing;
    unknown is created; of other size or time is modified; else nothing.
    """
    t = touched.select("path").distinct().alias("t")
    live = state.where("deleted_at IS NULL").alias("s")
    joined = t.join(live, F.col("t.path") == F.col("s.path"), "left").join(snapshot.alias("n"), F.col("t.path") == F.col("n.path"), "left")
    known, there = F.col("s.path").isNotNull(), F.col("n.path").isNotNull()
    kind = F.when(known & ~there, "deleted").when(there & ~known, "created").when(there & changed("s", "n"), "modified")
    return joined.select(F.col("t.path").alias("path"), kind.alias("kind")).where("kind IS NOT NULL")


def apply_renames(state: DataFrame, renames: DataFrame, at_ms: Column) -> tuple[DataFrame, DataFrame]:
    """State (id, path, deleted_at) after renames (from_path, to_path), and their events.

    A known live source keeps its id under the new path. A live row at the
    destination gives way: it is tombstoned and deleted. An unknown source makes
    the destination an arrival (created, without an id yet); a null destination
    lies outside all roots and is a removal. A path takes part in at most one
    rename of a batch on each side.
    """
    live = state.where("deleted_at IS NULL")
    moves = renames.join(live.select(F.col("path").alias("from_path"), F.col("id").alias("_id")), "from_path", "left")
    leaving = moves.where("_id IS NOT NULL").select(F.col("_id").alias("id"), F.lit(True).alias("_moves"), F.col("to_path").alias("_to"))
    targets = renames.where("to_path IS NOT NULL").select(F.col("to_path").alias("path"), F.lit(True).alias("_taken")).distinct()
    seen = state.join(leaving, "id", "left").join(targets, "path", "left")
    is_live = F.col("deleted_at").isNull()
    moves_on = is_live & F.coalesce("_moves", F.lit(False))
    gives_way = is_live & ~F.coalesce("_moves", F.lit(False)) & F.coalesce("_taken", F.lit(False))
    goes = gives_way | (moves_on & F.col("_to").isNull())
    after = seen.select(
        "id",
        F.when(moves_on, F.coalesce("_to", "path")).otherwise(F.col("path")).alias("path"),
        F.when(goes, at_ms).otherwise(F.col("deleted_at")).alias("deleted_at"),
    )
    event = F.when(goes, "deleted").when(moves_on, "renamed")
    told = seen.select("id", F.when(moves_on, F.coalesce("_to", "path")).otherwise(F.col("path")).alias("path"), event.alias("kind"), F.when(moves_on & F.col("_to").isNotNull(), F.col("path")).alias("previous_path")).where("kind IS NOT NULL")
    arrivals = moves.where("_id IS NULL AND to_path IS NOT NULL")
    null = lambda kind: F.lit(None).cast(kind)
    return after, told.unionByName(arrivals.select(null("long").alias("id"), F.col("to_path").alias("path"), F.lit("created").alias("kind"), null("string").alias("previous_path")))


def not_superseded(changes: DataFrame, renames: DataFrame) -> DataFrame:
    """Pending changes on paths that no rename of the batch leaves or reaches."""
    both = renames.select(F.explode(F.array("from_path", "to_path")).alias("path")).where("path IS NOT NULL").distinct()
    return changes.join(both, "path", "left_anti")
