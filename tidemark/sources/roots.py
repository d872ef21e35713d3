"""Change feeds of several roots as one stream, whose roots may come and go while it runs.

The roots are rows of a table that is read anew for every micro-batch. Of each
root the source tells, by stage: that it was added or removed (``command``), on
being added what lies under it (``scan``), and from then on its changes
(``change``). A root is a folder with Parquet files of changes under ``feed`` and
of what it holds under ``held``; changes from before a root was added are not
told, for its scan has seen what they led to. An offset says how many files of
each root's feed have been read, so a feed must grow by files whose names come
last.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "tidemark_roots"
SCHEMA = "stage string, root string, path string, kind string, t long, id long, size_bytes long, mtime_unix long"
CHANGE = ["path", "kind", "t", "id", "size_bytes", "mtime_unix"]


def _files(uri: str) -> list[str]:
    """Parquet files of a folder, in the order of their names; none if there is no folder."""
    system, path = fs.FileSystem.from_uri(uri)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=True))
    # Files that are still being written have names with a dot or an underscore.
    parts = [f.path for f in found if f.is_file and f.path.endswith(".parquet") and not any(p[:1] in "._" for p in f.path[len(path) :].split("/") if p)]
    return sorted(parts)


def _rows(uri: str, files: list[str], columns: list[str]) -> Iterator[tuple]:
    system, _ = fs.FileSystem.from_uri(uri)
    for batch in ds.dataset(files, filesystem=system, format="parquet").to_batches(columns=columns) if files else ():
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


class Part(InputPartition):
    def __init__(self, stage: str, root: str, kind: str | None = None, file: str | None = None):
        self.stage, self.root, self.kind, self.file = stage, root, kind, file


class RootReader(DataSourceStreamReader):
    def __init__(self, table: str):
        self.table = table

    def initialOffset(self) -> dict:  # noqa: N802
        return {"roots": "{}"}

    def latestOffset(self) -> dict:  # noqa: N802
        roots = sorted({r for (r,) in _rows(self.table, _files(self.table), ["root"]) if r is not None})
        return {"roots": json.dumps({r: len(_files(f"{r}/feed")) for r in roots})}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        before, now = json.loads(start["roots"]), json.loads(end["roots"])
        parts = [Part("command", r, "removed") for r in before if r not in now]
        for root, upto in now.items():
            if root not in before:
                parts.append(Part("command", root, "added"))
                parts += [Part("scan", root, file=f) for f in _files(f"{root}/held")]
            else:
                parts += [Part("change", root, file=f) for f in _files(f"{root}/feed")[before[root] : upto]]
        return parts

    def read(self, partition: Part) -> Iterator[tuple]:
        if partition.stage == "command":
            yield "command", partition.root, None, partition.kind, None, None, None, None
            return
        for row in _rows(partition.root, [partition.file], CHANGE):
            yield partition.stage, partition.root, *row


class RootSource(DataSource):
    """Option ``path``: the folder of the Parquet table of roots, with one column, ``root``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> RootReader:  # noqa: N802
        return RootReader(self.options["path"])


def root_stream(spark: SparkSession, table: str) -> DataFrame:
    """The stream of all roots of a table of roots (a URI of a folder)."""
    spark.dataSource.register(RootSource)
    return spark.readStream.format(NAME).load(table)


def by_stage(batch: DataFrame, number: int, on_commands: Callable[[DataFrame, int], None], on_scans: Callable[[DataFrame, int], None], on_changes: Callable[[DataFrame, int], None]) -> None:
    """Hand one micro-batch on by stage: commands first, then the scans of new roots, then changes."""
    for stage, act in (("command", on_commands), ("scan", on_scans), ("change", on_changes)):
        act(batch.where(F.col("stage") == stage), number)
