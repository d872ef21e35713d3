"""Directory trees listed by tasks, level by level.

The frontier, the directories of one level, is dealt to tasks, each of which
lists its share; what they find is written, and the directories among it are the
next frontier. So a tree takes one pass per level, wide levels are listed by many
tasks, and neither the tree nor a level meets in the driver. The file system
must be mounted on every machine under the same path.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.sources.shared import written

#: An entry, its path as bytes, and whether it is to be listed.
ENTRY = "path string, parent string, name string, depth int, is_dir boolean, size_bytes long, mtime_unix long, skipped boolean, raw binary, descend boolean"
COLUMNS = [c.split()[0] for c in ENTRY.split(", ")]


def plain_path(path: str) -> str:
    """A path without the scheme of local files; other schemes are refused."""
    bare = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    if "://" in bare:
        raise ValueError(f"not a mounted path: {path}")
    return bare.rstrip("/") or "/"


def _row(raw: bytes, depth: int, info: os.stat_result | None, skipped: bool, descend: bool) -> tuple:
    # Bytes of a name that are no UTF-8 become the replacement character.
    parent, name = (part.decode("utf-8", "replace") for part in os.path.split(raw))
    is_dir = info is not None and stat.S_ISDIR(info.st_mode)
    size = info.st_size if info and not is_dir else None
    return raw.decode("utf-8", "replace"), parent, name, depth, is_dir, size, int(info.st_mtime // 1) if info else None, skipped, raw, descend


def _looked_at(entry: os.DirEntry, depth: int, skip: frozenset[str], follow: bool) -> tuple | None:
    """The row of one entry; None for a directory to skip."""
    try:
        info = entry.stat(follow_symlinks=follow)
    except OSError:
        return _row(entry.path, depth, None, True, False)
    is_dir = stat.S_ISDIR(info.st_mode)
    if is_dir and os.fsdecode(entry.name) in skip:
        return None
    # A link to a directory that it lies in would never end.
    inside, target = (os.path.realpath(p) + b"/" for p in (os.path.dirname(entry.path), entry.path))
    loops = is_dir and entry.is_symlink() and inside.startswith(target)
    return _row(entry.path, depth, info, loops, is_dir and not loops)


def _listed(frames: Iterator[pd.DataFrame], skip: frozenset[str], follow: bool) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for raw, depth in zip(frame["raw"], frame["depth"]):
            rows = []
            try:
                with os.scandir(bytes(raw)) as found:
                    rows = [row for e in found if (row := _looked_at(e, int(depth) + 1, skip, follow))]
            except OSError:
                rows.append(_row(bytes(raw), int(depth), None, True, False))
            told = pd.DataFrame(rows, columns=COLUMNS)
            yield told.astype({"size_bytes": "Int64", "mtime_unix": "Int64"})


def walk(spark: SparkSession, roots: list[str], skip_dirs: tuple[str, ...] = schemas.SKIP_DIRS, follow_symlinks: bool = False, max_entries: int | None = None) -> DataFrame:
    """(path, parent, name, depth, is_dir, size_bytes, mtime_unix, skipped) of all below the roots.

    Directories are rows, without a size; so are names that begin with a dot or
    an underscore. Directories of a name in ``skip_dirs`` are left out with all
    that they hold. Links are rows of their own and are not followed unless
    asked; a followed link that leads back to a directory around it is skipped.
    What cannot be read, an entry or a directory's list, is a row that is
    ``skipped`` and else empty. A root itself is no row, unless it cannot be
    listed. Names are text, with U+FFFD for bytes that are no UTF-8.
    ``max_entries`` keeps that many rows, in no order.
    """
    skip = frozenset(skip_dirs)
    tops = [(plain_path(r).encode("utf-8", "surrogateescape"), 0) for r in roots]
    frontier = spark.createDataFrame(tops, "raw binary, depth int")
    levels = []
    # A number of its own: a level is small in bytes, and few tasks would list it were they left to merge.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while not frontier.isEmpty():
        found = written(frontier.repartition(tasks, "raw").mapInPandas(lambda frames: _listed(frames, skip, follow_symlinks), ENTRY), "listing")
        levels.append(found)
        frontier = found.where("descend").select("raw", "depth")
    rows = reduce(DataFrame.unionByName, levels) if levels else spark.createDataFrame([], ENTRY)
    rows = rows.drop("raw", "descend")
    return rows if max_entries is None else rows.limit(max_entries)
