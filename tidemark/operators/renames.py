"""Renames applied in their order: chains, swaps, victims and arrivals within one batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.numbering import dealt, previous
from tidemark.sources.shared import written

FILE = "struct<id:bigint,born:bigint>"


def _file(id_: Column, born: Column) -> Column:
    return F.struct(id_.cast("long").alias("id"), born.cast("long").alias("born"))


def _resolved(nodes: DataFrame) -> DataFrame:
    """(seq, file) of nodes (seq, up, file) whose file is that of the node they point to, by pointer doubling.

    A chain of n renames takes log2(n) joins. Nodes that have their file leave
    the joins' left side, so later rounds carry only what still points.
    """
    done, open_ = nodes.where("up IS NULL"), nodes.where("up IS NOT NULL")
    found = [done.select("seq", "file")]
    while not open_.isEmpty():
        every = done.unionByName(open_).select(F.col("seq").alias("_seq"), F.col("up").alias("_up"), F.col("file").alias("_file"))
        step = written(open_.join(every, F.col("up") == F.col("_seq")).select("seq", F.col("_up").alias("up"), F.col("_file").alias("file")), "chains")
        closed, open_ = step.where("up IS NULL"), step.where("up IS NOT NULL")
        done = written(done.unionByName(closed), "resolved")
        found = [done.select("seq", "file")]
    return found[0]


def traced(state: DataFrame, renames: DataFrame) -> DataFrame:
    """``renames`` with the file that each one moves and the file at its destination.

    ``state`` has (id, path, deleted_at), at most one live row a path; ``renames``
    (seq, from_path, to_path, at_ms), applied by ``seq``. Who is at a path before a
    rename follows from the rename that touched it last: one that left it leaves
    it empty; one that reached it put there the file it moved, or, if it moved
    none, what was there, or else a file that was born by it. Each of these points
    to one earlier rename or to a row of the state, so pointer doubling finds all
    of them at once. ``mover`` and ``victim`` are (id, born): a known file has an
    id, one born in this batch the seq of its birth; null is no file.
    """
    moves = renames.where("from_path IS NOT NULL AND NOT from_path <=> to_path").select("seq", "from_path", "to_path", "at_ms")
    sides = F.array(F.struct(F.col("from_path").alias("path"), F.lit(False).alias("reaches")), F.struct(F.col("to_path").alias("path"), F.lit(True).alias("reaches")))
    touches = moves.select("seq", F.explode(sides).alias("s")).select("seq", "s.*").where("path IS NOT NULL")
    last = previous(dealt(touches, F.col("seq")), ["path"], [F.col("seq")], F.struct("seq", "reaches"), "last")
    live = state.where("deleted_at IS NULL").select("path", F.col("id").alias("_id"))
    met = last.join(live, "path", "left").select("seq", "reaches", "last", F.when(F.col("last").isNull(), F.col("_id")).alias("known"))
    side = lambda reaches: F.max(F.when(F.col("reaches") == reaches, F.struct(F.lit(1).alias("one"), "last", "known")))
    both = written(met.groupBy("seq").agg(side(False).alias("f"), side(True).alias("t")).join(moves, "seq"), "moves")
    nodes = both.where("to_path IS NOT NULL").select(
        "seq",
        F.when(F.col("f.last.reaches"), F.col("f.last.seq")).when(F.col("f.known").isNotNull(), None).when(F.col("t.last.reaches"), F.col("t.last.seq")).alias("up"),
        _file(F.coalesce("f.known", "t.known"), F.when(F.coalesce("f.known", "t.known").isNull(), F.col("seq"))).alias("file"),
    )
    after = written(_resolved(nodes), "occupants")
    at = lambda name: after.select(F.col("seq").alias(f"_{name}"), F.col("file").alias(f"_{name}_file"))
    reached = lambda s: F.when(F.col(f"{s}.last.reaches"), F.col(f"{s}.last.seq"))
    held = both.join(at("f"), reached("f") == F.col("_f"), "left").join(at("t"), reached("t") == F.col("_t"), "left")
    known = lambda s: F.when(F.col(f"{s}.known").isNotNull(), _file(F.col(f"{s}.known"), F.lit(None)))
    return held.select("seq", "from_path", "to_path", "at_ms", F.coalesce("_f_file", known("f")).alias("mover"), F.coalesce("_t_file", known("t")).alias("victim"))


def told(moves: DataFrame) -> DataFrame:
    """Events (seq, id, born, path, kind, previous_path, at_ms) of traced renames; a victim's comes before its mover's."""
    row = lambda file, path, kind, before: F.struct(file["id"].alias("id"), file["born"].alias("born"), path.alias("path"), F.lit(kind).alias("kind"), before.alias("previous_path"))
    source, to, null = F.col("from_path"), F.col("to_path"), F.lit(None).cast("string")
    moved, taken, inside = F.col("mover").isNotNull(), F.col("victim").isNotNull(), to.isNotNull()
    events = F.array_compact(
        F.array(
            F.when(moved & ~inside, row(F.col("mover"), source, "deleted", null)),
            F.when(moved & inside & taken, row(F.col("victim"), to, "deleted", null)),
            F.when(moved & inside, row(F.col("mover"), to, "renamed", source)),
            F.when(~moved & inside & ~taken, row(_file(F.lit(None), F.col("seq")), to, "created", null)),
        )
    )
    return moves.select("seq", "at_ms", F.explode(events).alias("e")).select("seq", "e.*", "at_ms")


def applied(state: DataFrame, renames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """State (id, born, path, deleted_at) after all renames in their order, and their events.

    A file keeps its id wherever it goes. One that others displace, or that
    leaves all roots, is tombstoned where it was. A rename whose source is
    unknown is an arrival, which changes nothing where a file already is. Rows
    that rename a path to itself, or have no source, do nothing.
    """
    events = written(told(traced(state, renames)), "rename-events")
    final = events.groupBy("id", "born").agg(F.max_by(F.struct("path", "kind", "at_ms"), F.struct("seq", F.col("kind") == "deleted")).alias("e"))
    ends = final.select("id", "born", F.col("e.path").alias("_path"), F.when(F.col("e.kind") == "deleted", F.col("e.at_ms")).alias("_gone"))
    old = state.join(ends.where("id IS NOT NULL").drop("born"), "id", "left")
    kept = old.select("id", F.lit(None).cast("long").alias("born"), F.coalesce("_path", "path").alias("path"), F.coalesce("_gone", "deleted_at").alias("deleted_at"))
    born = ends.where("id IS NULL").select("id", "born", F.col("_path").alias("path"), F.col("_gone").alias("deleted_at"))
    return kept.unionByName(born), events
