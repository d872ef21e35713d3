"""Work on long values: rows dealt to all tasks, and read row by row in Arrow batches, a slice in memory at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text and binary values that a slice gathers before it is handed on.
SLICE_BYTES = 1 << 20
#: Rows of a slice at most.
SLICE_ROWS = 1_000


def dealt(df: DataFrame) -> DataFrame:
    """``df`` in even parts, for work that costs more than its shuffle.

    A row group of a file is read by one task, so a table of few row groups
    would be worked on by few tasks. Rows are dealt by their place, so copies
    and null keys spread like others.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.withColumn("_place", F.monotonically_increasing_id()).repartition(parts, "_place").drop("_place")


def row_by_row(make: Callable[..., tuple], schema: pa.Schema, max_bytes: int = SLICE_BYTES) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: ``make`` of each row's values, as rows of ``schema``.

    Only one row's values are Python objects beside the rows that wait for
    their slice to fill, however many rows a batch has. A row longer than the
    bound ends its slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for i in range(batch.num_rows):
                row = make(*[column[i].as_py() for column in batch.columns])
                held.append(row)
                size += sum(len(v) for v in row if isinstance(v, (str, bytes)))
                if size >= max_bytes or len(held) >= SLICE_ROWS:
                    yield _batch(held, schema)
                    held, size = [], 0
            if held:
                yield _batch(held, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(zip(*rows), schema)], schema=schema)
