"""Two tokenizers over one text: groups, links, and how usual each link is.

Both encode each text; where tokens of both end at one byte, a group ends, and
two tokens whose bytes overlap are linked. Of an id pair the corpus knows in how
many documents it is linked, counted outside memory:

1. Tasks align texts, chunk by chunk. A chunk's records (pair, document, links)
   are sorted, radix-partitioned and written as zstd runs: keys with their number
   of documents, and the documents apart.
2. Only the keys are shuffled, by radix part. A task spills the runs of a part to
   a file of its own and merges them, a heap of block ends deciding how far all
   runs can be read; wide merges are made of narrow ones. Pairs come out in the
   order of their first side, so each of its ids has its highest count as soon as
   its pairs are through, and every run gets the counts of its keys streamed back.
3. Counts meet the documents of their run, and are summed by document.

The pairs of one first-side id are spread over parts by their second side, so
that an id that stands in every document is no hot key: a part holds at most one
key a run for a pair. Its highest count is the greatest of the parts', a table
of at most one row per id of the vocabulary.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import tempfile
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import vocab
from tidemark.llm.blobs import packed, slim, spread, unpacked
from tidemark.llm.common import shuffle_partitions, written

#: Characters of text a chunk, and documents.
CHUNK_CHARS = 12 << 20
CHUNK_DOCS = 1 << 16

#: Least number of radix parts of the pairs; there are as many as shuffle partitions if these are more.
PARTS = 64

#: Runs that are merged at once, and keys a block of a merged run.
FAN_IN = 64
BLOCK = 1 << 16

#: Words whose alignment a worker remembers before it starts anew.
REMEMBERED = 300_000

#: Both tokenizers part a text where a space follows what is no white space. Where
#: no space touches other white space, that is at every space.
CUT = re.compile(r"(?<=\S)(?= )")
TOUCHING = re.compile(r"\s | \s")

COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class Aligner:
    """Aligns words (a text's parts from space to space) and remembers them by number."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = vocab.load(path_a, plain=True), vocab.load(path_b, plain=True)
        self.bytes_a, self.bytes_b = self.a.token_bytes(), self.b.token_bytes()
        self.size_b = len(self.bytes_b)
        self.length_a, self.length_b = (np.array(list(map(len, t)), np.int64) for t in (self.bytes_a, self.bytes_b))
        text = lambda size, sign: np.array([f"{i}{sign}" for i in range(size)], "S")
        self.text_a = text(len(self.bytes_a), ","), text(len(self.bytes_a), "|")
        self.text_b = text(self.size_b, ","), text(self.size_b, ";")
        self.forget()

    def forget(self) -> None:
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.known = 0
        self.groups: list[bytes] = []
        self.sizes = np.zeros((0, 4), np.int64)
        self.sound = np.zeros(0, bool)
        self.pairs = np.zeros(0, np.int64)
        self.starts = np.zeros(1, np.int64)

    def numbers(self, text: str) -> list[int]:
        """The numbers of a text's words; a word is what follows the space before it."""
        spaced = " " + text
        words = [p[1:] for p in CUT.split(spaced)] if TOUCHING.search(spaced) else spaced.split(" ")[1:]
        return list(map(self.number.__getitem__, words))

    def learn(self) -> None:
        """Align the words numbered since the last time."""
        words = list(self.number)[self.known :]
        self.known += len(words)
        if not words:
            return
        ids_a, ids_b, sound = [], [], []
        spaced = [" " + word for word in words]
        for unit, one, two in zip(spaced, self.a.ids(spaced), self.b.ids(spaced)):
            whole = unit.encode("utf-8", "surrogatepass")
            good = b"".join([self.bytes_a[i] for i in one]) == whole == b"".join([self.bytes_b[i] for i in two])
            sound.append(good)
            ids_a.append(one if good else [])
            ids_b.append(two if good else [])
        na, nb = (np.array(list(map(len, ids)), np.int64) for ids in (ids_a, ids_b))
        a, b = (np.array([i for each in ids for i in each], np.int64) for ids in (ids_a, ids_b))
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        # Between neighbouring ends of either side lies one token of each: a link.
        ends = np.union1d(ends_a, ends_b)
        at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        closing = np.flatnonzero((ends_a[at_a] == ends) & (ends_b[at_b] == ends)) if len(ends) else np.empty(0, np.int64)
        last_a, last_b = at_a[closing], at_b[closing]
        group_a, group_b = np.searchsorted(last_a, np.arange(len(a))), np.searchsorted(last_b, np.arange(len(b)))
        text = np.empty(len(a) + len(b), np.result_type(*self.text_a, *self.text_b))
        sign_a, sign_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        sign_a[last_a], sign_b[last_b] = True, True
        text[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = np.where(sign_a, self.text_a[1][a], self.text_a[0][a])
        text[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = np.where(sign_b, self.text_b[1][b], self.text_b[0][b])
        cuts = np.concatenate(([0], np.cumsum(na + nb))).tolist()
        self.groups += [text[i:j].tobytes().translate(None, b"\0")[:-1] for i, j in zip(cuts, cuts[1:])]
        word_ends_a = np.cumsum(na)
        owner = np.searchsorted(word_ends_a, at_a, "right")
        links = np.bincount(owner, minlength=len(words))
        groups = np.bincount(owner[closing], minlength=len(words))
        self.sizes = np.concatenate((self.sizes, np.stack((na, nb, groups, links), 1)))
        self.sound = np.concatenate((self.sound, np.array(sound, bool)))
        self.pairs = np.concatenate((self.pairs, a[at_a] * self.size_b + b[at_b] if len(ends) else ends))
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(links)))

    def records(self, docs: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, document, links) of words in documents, one each by pair and document, in that order."""
        once, times = np.unique(docs * max(self.known, 1) + words, return_counts=True)
        docs, words = once // max(self.known, 1), once % max(self.known, 1)
        sizes = self.starts[words + 1] - self.starts[words]
        pair = self.pairs[np.repeat(self.starts[words], sizes) + spread(sizes)]
        docs, times = np.repeat(docs, sizes), np.repeat(times, sizes)
        order = np.lexsort((docs, pair))
        pair, docs, times = pair[order], docs[order], times[order]
        opens = np.flatnonzero(np.concatenate(([True], (np.diff(pair) != 0) | (np.diff(docs) != 0)))) if len(pair) else np.empty(0, np.int64)
        return pair[opens], docs[opens], np.add.reduceat(times, opens) if len(opens) else times


def part_of(pair: np.ndarray, size_b: int, parts: int) -> np.ndarray:
    """The radix part of a pair: by its first side, moved on by the high bits of the second."""
    return (pair // size_b + (pair % size_b >> 9)) % parts


class Chunk:
    """Documents of one chunk, and the rows it gives."""

    def __init__(self, aligner: Aligner, texts: list):
        if len(aligner.number) > REMEMBERED:
            aligner.forget()
        self.aligner = aligner
        numbers = [aligner.numbers(t) if t else [] for t in texts]
        aligner.learn()
        self.docs = np.repeat(np.arange(len(texts)), [len(n) for n in numbers])
        self.words = np.array([i for n in numbers for i in n], np.int64)
        bad = np.zeros(len(texts), bool)
        bad[self.docs[~aligner.sound[self.words]]] = True
        good = ~bad[self.docs]
        self.docs, self.words = self.docs[good], self.words[good]
        self.sizes = np.stack([np.bincount(self.docs, weights=aligner.sizes[self.words, i], minlength=len(texts)).astype(np.int64) for i in range(4)], 1) if texts else np.zeros((0, 4), np.int64)
        held = aligner.groups
        self.groups = ["" if dropped or not n else hashlib.sha256(b";".join([held[i] for i in n])).hexdigest() for n, dropped in zip(numbers, bad.tolist())]

    def runs(self, parts: int) -> Iterator[tuple[int, bytes, bytes]]:
        """(part, keys, documents) of each part with a record."""
        pair, docs, times = self.aligner.records(self.docs, self.words)
        part = part_of(pair, self.aligner.size_b, parts)
        order = np.argsort(part, kind="stable")
        pair, docs, times, part = pair[order], docs[order], times[order], part[order]
        bounds = np.searchsorted(part, np.arange(parts + 1)).tolist()
        for n, (i, j) in enumerate(zip(bounds, bounds[1:])):
            if i < j:
                opens = np.flatnonzero(np.concatenate(([True], np.diff(pair[i:j]) != 0)))
                keys, sizes = pair[i:j][opens], np.diff(np.append(opens, j - i))
                # Documents of a key ascend: all but its first are told by their distance.
                steps = np.diff(docs[i:j], prepend=0)
                steps[opens] = docs[i:j][opens]
                yield n, packed(slim(np.diff(keys, prepend=0)), slim(sizes)), packed(slim(steps), slim(times[i:j] - 1))


def keys_of(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, sizes = unpacked(blob)
    return np.cumsum(steps, dtype=np.int64), sizes.astype(np.int64)


def documents_of(blob: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, links) of a run's records."""
    steps, times = unpacked(blob)
    total = np.cumsum(steps, dtype=np.int64)
    opens = np.cumsum(sizes) - sizes
    return total - np.repeat(total[opens] - steps[opens].astype(np.int64), sizes), times.astype(np.int64) + 1


def _align(batches: Iterator[pa.RecordBatch], paths: tuple[str, str], parts: int) -> Iterator[pa.RecordBatch]:
    aligner = Aligner(*paths)
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and end - start < CHUNK_DOCS and (end == start or size + len(texts[end] or "") <= CHUNK_CHARS):
                size += len(texts[end] or "")
                end += 1
            chunk, n = Chunk(aligner, texts[start:end]), end - start
            runs = list(chunk.runs(parts))
            m = len(runs)
            some = lambda values, kind: pa.concat_arrays([pa.array(values, kind), pa.nulls(m, kind)])
            more = lambda i, kind: pa.concat_arrays([pa.nulls(n, kind), pa.array([r[i] for r in runs], kind)])
            columns = {"run": pa.array([row] * (n + m), pa.int64()), "id": pa.concat_arrays([ids.slice(start, n), pa.nulls(m, ids.type)]), "doc": some(range(n), pa.int64())}
            columns |= {c: some(chunk.sizes[:, i], pa.int64()) for i, c in enumerate(COUNTS)} | {"groups_sha256": some(chunk.groups, pa.string())}
            columns |= {"part": more(0, pa.int32()), "keys": more(1, pa.binary()), "docs": more(2, pa.binary())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
            row += n
            start = end


class Spill:
    """Runs of one part in a file of the task, which goes when the task does."""

    def __init__(self):
        self.file = tempfile.TemporaryFile()

    def put(self, blob: bytes) -> tuple[int, int]:
        at = self.file.seek(0, 2)
        self.file.write(blob)
        return at, len(blob)

    def get(self, place: tuple[int, int]) -> bytes:
        self.file.seek(place[0])
        return self.file.read(place[1])

    def blocks(self, run: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for place in run:
            yield keys_of(self.get(place))


def merged(runs: list[Iterator[tuple[np.ndarray, np.ndarray]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ascending keys of sorted runs of (keys, counts) blocks, and the sums of their counts.

    The heap holds the last key of each run's block. Up to the least of these all
    runs are in memory, so the keys up to it are final.
    """
    held: dict[int, list[np.ndarray]] = {}
    heap: list[tuple[int, int]] = []

    def read(n: int) -> None:
        block = next(runs[n], None)
        if block is None:
            held.pop(n, None)
        else:
            held[n] = list(block)
            heapq.heappush(heap, (int(block[0][-1]), n))

    for n in range(len(runs)):
        read(n)
    while heap:
        bound = heap[0][0]
        taken = []
        for block in held.values():
            upto = int(np.searchsorted(block[0], bound, "right"))
            taken.append((block[0][:upto], block[1][:upto]))
            block[0], block[1] = block[0][upto:], block[1][upto:]
        while heap and heap[0][0] == bound:
            read(heapq.heappop(heap)[1])
        keys, counts = (np.concatenate(c) for c in zip(*taken))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        opens = np.flatnonzero(np.concatenate(([True], np.diff(keys) != 0)))
        yield keys[opens], np.add.reduceat(counts, opens)


def _count_part(rows: Iterator[tuple[int, bytes]], size_b: int, fan_in: int) -> Iterator[tuple[int | None, bytes]]:
    """Counts of each run's keys, in their order; last (no run) the highest count of each first side."""
    spill, given = Spill(), []
    levels: list[list[list[tuple[int, int]]]] = [[]]

    def narrow(level: int) -> None:
        run = [spill.put(packed(slim(np.diff(k[i : i + BLOCK], prepend=0)), slim(c[i : i + BLOCK]))) for k, c in merged([spill.blocks(r) for r in levels[level]]) for i in range(0, len(k), BLOCK)]
        levels[level] = []
        if level + 1 == len(levels):
            levels.append([])
        levels[level + 1].append(run)
        if len(levels[level + 1]) == fan_in:
            narrow(level + 1)

    for run, blob in rows:
        place = spill.put(blob)
        given.append((run, place))
        levels[0].append([place])
        if len(levels[0]) == fan_in:
            narrow(0)
    for level in range(len(levels) - 1):
        if levels[level]:
            narrow(level)
    totals = list(merged([spill.blocks(r) for level in levels for r in level]))
    keys, counts = (np.concatenate(c) for c in zip(*totals))
    for run, place in given:
        yield run, packed(slim(counts[np.searchsorted(keys, keys_of(spill.get(place))[0])]))
    side = keys // size_b
    opens = np.flatnonzero(np.concatenate(([True], np.diff(side) != 0)))
    yield None, packed(slim(side[opens]), slim(np.maximum.reduceat(counts, opens)))


def _count(batches: Iterator[pa.RecordBatch], size_b: int, fan_in: int) -> Iterator[pa.RecordBatch]:
    def told(part: int, rows: Iterator) -> Iterator[pa.RecordBatch]:
        for run, blob in _count_part(rows, size_b, fan_in):
            yield pa.RecordBatch.from_arrays([pa.array([run], pa.int64()), pa.array([part], pa.int32()), pa.array([blob], pa.binary())], names=["run", "part", "counts"])

    rows = ((p, r, k) for batch in batches for p, r, k in zip(*(batch.column(i).to_pylist() for i in range(3))))
    row = next(rows, None)
    while row is not None:
        part = row[0]

        def of_part() -> Iterator[tuple[int, bytes]]:
            nonlocal row
            while row is not None and row[0] == part:
                yield row[1:]
                row = next(rows, None)

        yield from told(part, of_part())


def _sum(highest: np.ndarray, size_b: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Documents of one run with the sums of what their links count."""

    def step(run: pa.Table, back: pa.Table) -> pa.Table:
        docs = run.filter(pc.is_valid(run["doc"])).sort_by("doc")
        best, total = np.zeros(docs.num_rows, np.int64), np.zeros(docs.num_rows, np.int64)
        counts = dict(zip(back["part"].to_pylist(), back["counts"].to_pylist()))
        records = run.filter(pc.is_valid(run["part"]))
        for part, keys, held in zip(*(records[c].to_pylist() for c in ("part", "keys", "docs"))):
            pair, sizes = keys_of(keys)
            count = unpacked(counts[part])[0].astype(np.int64)
            doc, times = documents_of(held, sizes)
            np.add.at(total, doc, times * np.repeat(count, sizes))
            np.add.at(best, doc, times * np.repeat(count == highest[pair // size_b], sizes))
        told = docs.select(["id", *COUNTS, "groups_sha256"])
        return told.append_column("n_best", pa.array(best)).append_column("count_sum", pa.array(total))

    return step


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``path_a`` and ``path_b`` are vocabulary files, at the same place on every
    machine; the first encodes a space and the text, the second, which puts that
    space itself, the text. Strings of special tokens are plain text. A link's
    count is the number of rows of ``docs`` that link its ids; ``n_best`` are the
    links whose count is the highest of their first id, ``count_sum`` sums the
    counts over links, and ``groups_sha256`` digests the groups
    (``a1,a2|b1;a3|b2``). Texts that are null or empty, or that either side's
    tokens do not spell byte for byte, have no tokens: zeros and an empty
    digest. Rows that repeat an id or have none count and come back one by one,
    an id may be of any type, other columns are ignored, and an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    parts = parts or max(PARTS, shuffle_partitions(spark))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    told = [rows.schema["id"], *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("groups_sha256", T.StringType())]
    schema = T.StructType(
        [T.StructField("run", T.LongType()), told[0], T.StructField("doc", T.LongType()), *told[1:], T.StructField("part", T.IntegerType())]
        + [T.StructField(c, T.BinaryType()) for c in ("keys", "docs")]
    )
    size_b = len(vocab.load(path_b).token_bytes())
    chunks = written(rows.mapInArrow(lambda batches: _align(batches, (path_a, path_b), parts), schema), "aligned")
    keys = chunks.where("part IS NOT NULL").select("part", "run", "keys").repartition(min(parts, shuffle_partitions(spark)), "part").sortWithinPartitions("part", "run")
    counted = written(keys.mapInArrow(lambda batches: _count(batches, size_b, fan_in), "run long, part int, counts binary"), "link-counts")
    highest = np.zeros(len(vocab.load(path_a).token_bytes()), np.int64)
    # One row a part, each with at most one count per id of the first vocabulary.
    for row in counted.where("run IS NULL").select("counts").toLocalIterator():
        side, count = (x.astype(np.int64) for x in unpacked(bytes(row["counts"])))
        highest[side] = np.maximum(highest[side], count)
    back = counted.where("run IS NOT NULL")
    out = T.StructType([*told, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    summed = chunks.groupBy("run").cogroup(back.groupBy("run")).applyInArrow(_sum(highest, size_b), out)
    return summed.select(F.col("id").alias(id_col), *COUNTS, "n_best", "count_sum", "groups_sha256")
