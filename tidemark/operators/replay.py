"""Replay of an event log: each file's state by composing what its events do.

An event acts on a file that is absent, dead or live. What a stretch of events
does is a table of three rows, one for each of these it may start from, and two
stretches one after the other compose to another such table. That is
associative, so a file's events are folded in pieces: by ranges of the global
order, and then piece by piece. A file that holds a third of all events is spread
over all ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.numbering import dealt

#: Numbers of the states, and their names in that order (fixed values).
ABSENT, DEAD, LIVE = 0, 1, 2
NAMES = ("absent", "dead", "live")

COUNTS = ("created", "revived", "modified", "deleted")


def _effect(state: Column, **fields: Column) -> Column:
    """What a stretch does: the state after it, counts, the last size, and when the file last died."""
    long = lambda c: c.cast("long")
    return F.struct(state.cast("int").alias("state"), *[long(fields[c]).alias(c) for c in COUNTS], long(fields["size"]).alias("size"), long(fields["died"]).alias("died"))


def _start(state: Column) -> Column:
    null, zero = F.lit(None), F.lit(0)
    return _effect(state, **dict.fromkeys(COUNTS, zero), size=null, died=null)


def _step(done: Column, event: Column) -> Column:
    """One event more: a deletion ends a live file and is nothing else; any other makes, revives or modifies."""
    gone, was = event["kind"] == "deleted", done["state"]
    one = lambda test: F.when(test, 1).otherwise(0)
    ends = gone & (was == LIVE)
    return _effect(
        F.when(ends, DEAD).when(gone, was).otherwise(LIVE),
        created=done["created"] + one(~gone & (was == ABSENT)),
        revived=done["revived"] + one(~gone & (was == DEAD)),
        modified=done["modified"] + one(~gone & (was == LIVE)),
        deleted=done["deleted"] + one(ends),
        size=F.when(gone, done["size"]).otherwise(event["size_bytes"]),
        died=F.when(ends, event["at_unix_ms"]).otherwise(done["died"]),
    )


def _then(first: Column, table: Column) -> Column:
    """What a stretch did, and after it the stretch of a table."""
    next_ = F.get(table, first["state"])
    touched = (next_["created"] + next_["revived"] + next_["modified"]) > 0
    return _effect(next_["state"], **{c: first[c] + next_[c] for c in COUNTS}, size=F.when(touched, next_["size"]).otherwise(first["size"]), died=F.coalesce(next_["died"], first["died"]))


def replayed(events: DataFrame) -> DataFrame:
    """(file_id, state, created, revived, modified, deleted, size_bytes, deleted_at, n_events) after all events by id.

    ``events`` has (id, file_id, kind, at_unix_ms, size_bytes). The first event
    that is no deletion creates a file; a deletion of what is not there does
    nothing; what comes after a deletion revives the same file. A null file is a
    file of its own.
    """
    pieces = dealt(events.select("file_id", "id", "kind", "at_unix_ms", "size_bytes"), F.col("id"))
    listed = pieces.groupBy("file_id", "_range").agg(F.array_sort(F.collect_list(F.struct("id", "kind", "at_unix_ms", "size_bytes"))).alias("_events"))
    table = F.transform(F.array(*map(F.lit, (ABSENT, DEAD, LIVE))), lambda s: F.aggregate("_events", _start(s), _step))
    tables = listed.select("file_id", F.struct("_range", table.alias("table")).alias("piece"), F.size("_events").alias("n"))
    files = tables.groupBy("file_id").agg(F.array_sort(F.collect_list("piece")).alias("_pieces"), F.sum("n").alias("n_events"))
    whole = F.aggregate("_pieces", _start(F.lit(ABSENT)), lambda done, piece: _then(done, piece["table"]))
    done = files.select("file_id", whole.alias("w"), "n_events")
    name = F.element_at(F.array(*map(F.lit, NAMES)), F.col("w.state") + 1)
    return done.select("file_id", name.alias("state"), *[F.col(f"w.{c}").alias(c) for c in COUNTS], F.col("w.size").alias("size_bytes"), F.when(F.col("w.state") == DEAD, F.col("w.died")).alias("deleted_at"), "n_events")
