"""Find benchmark items in documents with one Aho-Corasick automaton.

The windows of all items become patterns over normalised text; every document
is normalised and scanned once, many documents to a chunk. Matches are mapped
back to word numbers and to character offsets in the original text.

The automaton is built once per Python worker from a broadcast list of items of
bounded size; it reads the texts once, and nothing is shuffled. A benchmark above
the bound is cut into shards, long items into pieces that overlap by a window
less a word. Then the texts are written once, with a number for each row, every
shard reads them on its own and gives only the hits it found, and these meet
their rows at the end. One automaton lives at a time.
"""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import MAX_BROADCAST_IDS, bounded, clashing, text_chunks, written

#: UTF-8 bytes to search bytes: A-Z to lower case, 0-9, a-z and bytes of
#: non-ASCII characters as they are, every other ASCII character to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b) in string.digits + string.ascii_lowercase else 32 for b in range(256))

#: Bytes of benchmark text a shard; its automaton has about 13 nodes a byte.
SHARD_BYTES = 256 << 10

#: Bytes of text that are normalised at once.
CHUNK_BYTES = 2 << 20

HITS = "array<struct<first:int,last:int>>"
SPANS = "array<struct<start:int,end:int>>"

#: The automaton this worker built last, by the run's key.
_built: dict = {}


def windows(text: str | None, size: int) -> list[tuple[str, int]]:
    """The windows of an item as search patterns, and their numbers of words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    n = min(size, len(words))
    return [(f" {b' '.join(words[i : i + n]).decode('latin-1')} ", n) for i in range(len(words) - n + 1)] if n else []


def automaton(items: list[tuple[str, str | None]], size: int):
    """Patterns of all items; a pattern's value is (words, item ids)."""
    import ahocorasick

    found: dict[str, tuple[int, set]] = {}
    for item, text in items:
        for pattern, n in windows(text, size):
            found.setdefault(pattern, (n, set()))[1].add(item)
    machine = ahocorasick.Automaton()
    for pattern, value in found.items():
        machine.add_word(pattern, value)
    if found:
        machine.make_automaton()
    return machine if found else None


class Chunk:
    """Normalised text of several documents, and where its words are.

    Words are parted by one space and documents by at least two, so no pattern
    reaches over the end of a document.
    """

    def __init__(self, raws: list[bytes]):
        self.folded = folded = np.frombuffer((b" " + b"  ".join(raws) + b"  ").translate(FOLD), np.uint8)
        word = folded != 32
        after = np.empty_like(word)
        after[0], after[1:] = False, word[:-1]
        self.starts = np.flatnonzero(word & ~after)
        self.ends = np.flatnonzero(~word & after)
        lengths = np.fromiter((len(r) + 2 for r in raws), np.int64, len(raws))
        self.at = np.concatenate(([0], np.cumsum(lengths))) + 1
        keep = word | after
        keep[0] = True
        keep[self.at[1:] - 1] = True
        self.text = folded[keep].tobytes().decode("latin-1")
        place = np.cumsum(keep, dtype=np.int32)
        self.placed = place[self.starts] - 1
        #: Number of the first word of each document, and of all words at the end.
        self.first = np.searchsorted(self.starts, self.at)

    def characters(self, doc: int, firsts: list[int], lasts: list[int]) -> list[dict[str, int]]:
        """Character ranges of ranges of a document's words: lead bytes are counted once along it."""
        at, end, base = int(self.at[doc]), int(self.at[doc + 1]), int(self.first[doc])
        before = np.concatenate(([0], np.cumsum((self.folded[at:end] & 0xC0) != 0x80)))
        starts = before[self.starts[base + np.array(firsts)] - at].tolist()
        ends = before[self.ends[base + np.array(lasts)] - at].tolist()
        return [{"start": a, "end": b} for a, b in zip(starts, ends)]

    def scan(self, machine) -> tuple[list[int], list[int], list[set]]:
        """First word, last word and items of every occurrence of a window."""
        if machine is None:
            return [], [], []
        ends, values = [], []
        for end, value in machine.iter(self.text):
            ends.append(end - 1)
            values.append(value)
        last = (np.searchsorted(self.placed, ends, "right") - 1).tolist() if ends else []
        return [b - v[0] + 1 for b, v in zip(last, values)], last, [v[1] for v in values]


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of words joined where they touch or overlap."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _scan_batches(batches: Iterator[pa.RecordBatch], shared, key: str, size: int, text_col: str) -> Iterator[pa.RecordBatch]:
    if key not in _built:
        _built.clear()
        _built[key] = automaton(shared.value, size)
    machine = _built[key]
    for batch in batches:
        names = batch.schema.names
        texts = batch.column(names.index(text_col)).to_pylist()
        words, hits, spans, items = (batch.column(names.index(c)).to_pylist() for c in ("n_words", "_hits", "spans", "items"))
        for start, raws in text_chunks(texts, CHUNK_BYTES):
            _scan_chunk(raws, machine, start, words, hits, spans, items)
        pair = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        place = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        done = {"n_words": pa.array(words, pa.int64()), "_hits": pa.array(hits, pair), "spans": pa.array(spans, place), "items": pa.array(items, pa.list_(pa.string()))}
        yield pa.RecordBatch.from_arrays([done.get(n, batch.column(i)) for i, n in enumerate(names)], names=names)


def _scan_chunk(raws, machine, start, words, hits, spans, items) -> None:
    chunk = Chunk(raws)
    for i, n in enumerate(np.diff(chunk.first).tolist()):
        words[start + i] = n
    per_doc: dict[int, tuple[list, set]] = {}
    firsts, lasts, found = chunk.scan(machine)
    owners = (np.searchsorted(chunk.first, lasts, "right") - 1).tolist() if lasts else []
    for a, b, doc, ids in zip(firsts, lasts, owners, found):
        ranges, names = per_doc.setdefault(doc, ([], set()))
        ranges.append((a, b))
        names |= ids
    for doc in [i for i in range(len(raws)) if i in per_doc or hits[start + i]]:
        ranges, names = per_doc.get(doc, ([], set()))
        base = int(chunk.first[doc])
        before = [(r["first"], r["last"]) for r in hits[start + doc]]
        merged = merge(before + [(a - base, b - base) for a, b in merge(ranges)])
        hits[start + doc] = [{"first": a, "last": b} for a, b in merged]
        items[start + doc] = sorted(names | set(items[start + doc]), key=lambda x: (x is not None, x))
        spans[start + doc] = chunk.characters(doc, *map(list, zip(*merged)))


def _shard_hits(batches: Iterator[pa.RecordBatch], shared, key: str, size: int) -> Iterator[pa.RecordBatch]:
    """(row, hits, items) of the rows (row, text) that a shard hits."""
    for batch in _scan_batches(batches, shared, key, size, "text"):
        hit = pc.greater(pc.list_value_length(batch.column(batch.schema.names.index("_hits"))), 0)
        yield batch.select(["_row", "_hits", "items"]).filter(hit)


def pieces(items: DataFrame, size: int, step: int) -> DataFrame:
    """(id, text) of the items' words in lower case, in pieces of about ``step`` windows that lose none."""
    plain = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    words = F.split(F.trim(F.regexp_replace(plain, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), " ")
    last = F.greatest(F.ceil((F.size("words") - size + 1) / step).cast("int") - 1, F.lit(0))
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice("words", i * step + 1, step + size - 1), " "))
    return items.select("id", words.alias("words")).select("id", F.explode(each).alias("text"))


def find_items(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 13, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, items, spans and contaminated.

    A window is ``size`` consecutive words of an item; an item of fewer words
    but at least one is one window. ``items`` are the ids (as strings, sorted)
    of items with a window in the document, ``spans`` the character ranges of
    hit words in the original text, joined where hit words adjoin. A document is
    contaminated if at least a twentieth of its words, and at least one, is hit.
    Null or empty texts have no words; an empty benchmark hits nothing; an item
    given twice counts once; items without an id hit like others and stand as
    one null, first among ``items``. Columns of ``docs`` with one of the new names are
    replaced.
    """
    docs = clashing(docs, ["n_words", "n_hit", "items", "spans", "contaminated", "_hits"])
    items = items.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if total > shard_bytes:
        items = written(pieces(items, size, max(1, shard_bytes // 16)), "items")
        total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_bytes))
    if shards > 1:
        # A shard's rows lie together, so that reading one skips the others' files.
        shard = F.pmod(F.xxhash64("id", "text"), F.lit(shards)).cast("int")
        items = written(items.select("id", "text", shard.alias("shard")).repartition(min(shards, 1_000), "shard").sortWithinPartitions("shard"), "item-shards")
    none = lambda kind: F.array().cast(kind)
    empty = {"n_words": F.lit(0).cast("long"), "_hits": none(HITS), "spans": none(SPANS), "items": none("array<string>")}
    spark = docs.sparkSession

    def shared_items(rows: list):
        return spark.sparkContext.broadcast([(r["id"], r["text"]) for r in rows])

    if shards == 1:
        found, shared = docs.withColumns(empty), shared_items(items.collect())
    else:
        kept = written(docs.withColumn("_row", F.monotonically_increasing_id()), "decontam-texts")
        read = kept.select("_row", F.col(text_col).alias("text")).withColumns(empty)
        partial = None
        for shard in range(shards):
            told = shared_items(items.where(F.col("shard") == shard).collect())
            hit = read.mapInArrow(lambda batches, told=told, key=uuid.uuid4().hex: _shard_hits(batches, told, key, size), f"_row long, _hits {HITS}, items array<string>")
            hit = written(hit, "shard-hits")
            told.unpersist()
            partial = hit if partial is None else partial.unionByName(hit)
        all_hits = partial.groupBy("_row").agg(F.flatten(F.collect_list("_hits")).alias("_hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        met = kept.join(bounded(written(all_hits, "hits"), MAX_BROADCAST_IDS // 10), "_row", "left")
        found = met.drop("_row").withColumns(empty | {"_hits": F.coalesce("_hits", empty["_hits"]), "items": F.coalesce("items", empty["items"])})
        found, shared = found.select(*docs.columns, *empty), shared_items([])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in found.schema])
    found = found.mapInArrow(lambda batches, key=uuid.uuid4().hex: _scan_batches(batches, shared, key, size, text_col), schema)
    n_hit = F.aggregate("_hits", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    found = found.withColumn("n_hit", n_hit).drop("_hits")
    return found.withColumn("contaminated", is_contaminated(F.col("n_words"), F.col("n_hit")))


def is_contaminated(n_words: Column, n_hit: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)
