"""Tokens of every text, counted without making the ids of any text.

Tasks cut texts into pre-tokens and count them, many documents to a chunk. Of a
chunk's distinct pre-tokens, parted by a hash, only they themselves are shuffled:
a part meets all chunks' pre-tokens, encodes each distinct one once, for the
number of its pieces alone, and tells every chunk the numbers of its own. These
join the chunk's frequencies, and frequency times pieces is summed per document.

A pre-token that stands in every document is one entry a chunk, so there is no
hot key; what a task holds is a chunk, or the distinct pre-tokens of a part.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import vocab
from tidemark.llm.blobs import packed, slim, unpacked
from tidemark.llm.common import shuffle_partitions, written

#: Characters of text a chunk.
CHUNK_CHARS = 16 << 20

#: Least number of hash parts of the pre-tokens; there are as many as shuffle partitions if these are more.
PARTS = 64

#: Pre-tokens that a task remembers at once; beyond them it starts anew.
REMEMBERED = 2_000_000


def posted(batches: Iterator[pa.RecordBatch], path: str, parts: int) -> Iterator[pa.RecordBatch]:
    """Of each chunk of texts, a row per document, and a row per part with the chunk's pre-tokens and their frequencies."""
    cutter = vocab.load(path)
    chunk = TaskContext.get().partitionId() << 33
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end] or "") <= CHUNK_CHARS):
                size += len(texts[end] or "")
                end += 1
            yield _chunk(ids.slice(start, end - start), texts[start:end], chunk, cutter, parts)
            chunk += 1
            start = end


def _chunk(ids: pa.Array, texts: list, chunk: int, cutter, parts: int) -> pa.RecordBatch:
    number: dict[str, int] = {}
    units, times, sizes, special = [], [], [], []
    for text in texts:
        cut, n = cutter.units(text) if text else ([], 0)
        found = Counter(cut)
        units.extend([number.setdefault(u, len(number)) for u in found])
        times.extend(found.values())
        sizes.append(len(found))
        special.append(n)
    # Units in order of part, then of their bytes.
    raw = [u.encode() for u in number]
    part = [zlib.crc32(r) % parts for r in raw]
    order = sorted(range(len(raw)), key=lambda i: (part[i], raw[i]))
    place = np.empty(len(raw), np.int64)
    place[order] = np.arange(len(raw))
    unit = place[np.array(units, np.int64)]
    by_unit = np.argsort(unit, kind="stable")
    doc, times = np.repeat(np.arange(len(texts)), sizes)[by_unit], np.array(times, np.int64)[by_unit]
    held = np.concatenate(([0], np.cumsum(np.bincount(unit, minlength=len(raw)))))
    bounds = np.searchsorted(np.array(part, np.int64)[order], np.arange(parts + 1)).tolist()
    told = [(n, *_part([raw[u] for u in order[i:j]], held[i : j + 1], doc, times)) for n, (i, j) in enumerate(zip(bounds, bounds[1:])) if i < j]
    n, m = len(texts), len(told)
    some = lambda values, kind: pa.concat_arrays([pa.array(values, kind), pa.nulls(m, kind)])
    more = lambda i, kind: pa.concat_arrays([pa.nulls(n, kind), pa.array([t[i] for t in told], kind)])
    columns = {"chunk": pa.array([chunk] * (n + m), pa.int64()), "id": pa.concat_arrays([ids, pa.nulls(m, ids.type)]), "doc": some(range(n), pa.int64())}
    columns |= {"n_bytes": some([len((t or "").encode()) for t in texts], pa.int64()), "special": some(special, pa.int64())}
    columns |= {"part": more(0, pa.int32()), "units": more(1, pa.binary()), "docs": more(2, pa.binary())}
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _part(units: list[bytes], held: np.ndarray, doc: np.ndarray, times: np.ndarray) -> tuple[bytes, bytes]:
    """A part's units, and where each stands: documents (all but a unit's first as distances) and times."""
    doc, times = doc[held[0] : held[-1]], times[held[0] : held[-1]]
    opens = held[:-1] - held[0]
    steps = np.diff(doc, prepend=0)
    steps[opens] = doc[opens]
    lengths = np.array(list(map(len, units)), np.int64)
    return packed(slim(lengths), np.frombuffer(b"".join(units), np.uint8)), packed(slim(np.diff(held)), slim(steps), slim(times - 1))


def units_of(blob: bytes) -> list[bytes]:
    lengths, raw = unpacked(blob)
    ends, raw = np.cumsum(lengths, dtype=np.int64).tolist(), raw.tobytes()
    return [raw[i:j] for i, j in zip([0, *ends], ends)]


def pieces(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Numbers of pieces of each chunk's units of a part, in their order; rows come part by part."""
    cutter = vocab.load(path)
    known: dict[bytes, int] = {}
    at = None
    for batch in batches:
        for part, chunk, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if part != at or len(known) > REMEMBERED:
                known.clear()
                at = part
            units = units_of(blob)
            fresh = [u for u in units if u not in known]
            known.update(zip(fresh, map(len, cutter.ids([u.decode() for u in fresh]))))
            counts = packed(slim(np.array([known[u] for u in units], np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([part], pa.int32()), pa.array([counts], pa.binary())], names=["chunk", "part", "pieces"])


def _summed(chunk: pa.Table, told: pa.Table) -> pa.Table:
    """Documents of one chunk with their tokens."""
    docs = chunk.filter(pc.is_valid(chunk["doc"])).sort_by("doc")
    total = np.array(docs["special"].to_pylist(), np.int64)
    counts = dict(zip(told["part"].to_pylist(), told["pieces"].to_pylist()))
    postings = chunk.filter(pc.is_valid(chunk["part"]))
    for part, blob in zip(postings["part"].to_pylist(), postings["docs"].to_pylist()):
        sizes, steps, times = (a.astype(np.int64) for a in unpacked(blob))
        upto = np.cumsum(steps)
        opens = np.cumsum(sizes) - sizes
        doc = upto - np.repeat(upto[opens] - steps[opens], sizes)
        np.add.at(total, doc, (times + 1) * np.repeat(unpacked(counts[part])[0].astype(np.int64), sizes))
    return docs.select(["id", "n_bytes"]).append_column("n_tokens", pa.array(total))


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, parts: int | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    ``path`` is a vocabulary file, ``.json`` (byte-level) or ``.model``, at the
    same place on every machine. Counts are those of the file's own library on
    the whole text, with no token added; the string of a special token within a
    text is one token where the library makes it so. Null and empty texts have
    no bytes and no tokens. Rows that repeat an id, or have none, are counted one
    by one and keep it, of whatever type it is. Other columns are ignored; an
    empty table gives no rows.
    """
    parts = parts or max(PARTS, shuffle_partitions(docs.sparkSession))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    long, binary = T.LongType(), T.BinaryType()
    fields = [("chunk", long), ("id", rows.schema["id"].dataType), ("doc", long), ("n_bytes", long), ("special", long), ("part", T.IntegerType()), ("units", binary), ("docs", binary)]
    chunks = written(rows.mapInArrow(lambda batches: posted(batches, path, parts), T.StructType([T.StructField(*f) for f in fields])), "pre-tokens")
    units = chunks.where("part IS NOT NULL").select("part", "chunk", "units").repartition(min(parts, shuffle_partitions(docs.sparkSession)), "part").sortWithinPartitions("part", "chunk")
    told = units.mapInArrow(lambda batches: pieces(batches, path), "chunk long, part int, pieces binary")
    out = T.StructType([rows.schema["id"], T.StructField("n_bytes", long), T.StructField("n_tokens", long)])
    summed = chunks.drop("units").groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_summed, out)
    return summed.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
