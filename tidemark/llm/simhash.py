"""Near-duplicates by SimHash fingerprints, linked with BK-trees.

Fingerprints within the radius are found exactly: cut into radius + 3 blocks,
two of them agree in at least three blocks, so every set of three blocks is a
key under which the pair meets. Keys that several fingerprints share form
shards of bounded size, each shard gets a BK-tree (children keyed by their
Hamming distance to the parent), and a search follows only the edges within the
radius. A larger group is cut into several shards; each shard's tree is then
sent to every block of the group's queries.

A shard yields stars, not pairs: one link a row, to the smallest id of its
part, and a search ends as soon as it has met every part of its tree. Components over the links come from alternating large
and small stars, written to the shared folder each round.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import shuffle_partitions, text_chunks, without, written

#: Fingerprints in one shard's tree.
SHARD = 1024


def fingerprint(raw: bytes) -> int:
    """64-bit SimHash over 3-word shingles of one UTF-8 text."""
    from xxhash import xxh64_intdigest

    words = raw.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= 3:
        return xxh64_intdigest(line, 42)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[:-2].tolist()
    stops = (ends[2:] - 1).tolist()
    hashes = np.array([xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, stops)], np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = []
        for _, raws in text_chunks(batch.column(1).to_pylist()):
            prints += [fingerprint(raw) for raw in raws]
        signed = pa.array(np.array(prints, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), signed], names=["id", "print"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, print) of every row; a text without words (or null) has print 0."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fingerprints, T.StructType([rows.schema["id"], T.StructField("print", T.LongType())]))


class BKTree:
    """Tree of distinct fingerprints; children hang at their integer distance."""

    def __init__(self):
        self.prints: list[int] = []
        self.children: list[dict[int, int]] = []

    def insert(self, print_: int) -> int:
        new = len(self.prints)
        self.prints.append(print_)
        self.children.append({})
        at = 0
        while new:
            d = (self.prints[at] ^ print_).bit_count()
            child = self.children[at].get(d)
            if child is None:
                self.children[at][d] = new
                break
            at = child
        return new

    def near(self, print_: int, radius: int) -> Iterator[int]:
        """Numbers of nodes within the radius, found along edges within it."""
        stack = [0] if self.prints else []
        while stack:
            at = stack.pop()
            d = (self.prints[at] ^ print_).bit_count()
            if d <= radius:
                yield at
            for edge, child in self.children[at].items():
                if d - radius <= edge <= d + radius:
                    stack.append(child)


class Parts:
    """Union-find over node numbers; the number of parts is kept."""

    def __init__(self):
        self.parent: list[int] = []
        self.count = 0

    def add(self) -> None:
        self.parent.append(len(self.parent))
        self.count += 1

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        self.count -= 1
        return True


def spanning_links(tree_rows: list[tuple[int, int]], query_rows: list[tuple[int, int]], radius: int) -> list[tuple[int, int]]:
    """Stars of the parts that links form among the tree's rows and the queries.

    Rows are (id, print as unsigned). Every row of a part but the one with the
    smallest tree id yields (id, that id); a query that meets several parts
    joins them. A search ends once it has met all there are.
    """
    tree, parts, met = BKTree(), Parts(), []
    for _, print_ in tree_rows:
        near = tree.near(print_, radius)
        tree_size = len(tree.prints)
        parts.add()
        for other in near:
            parts.union(tree_size, other)
            if parts.count == 1:
                break
        tree.insert(print_)
    for id_, print_ in query_rows:
        mine = -1
        for other in tree.near(print_, radius):
            if mine < 0:
                mine = other
                met.append((id_, other))
            else:
                parts.union(mine, other)
            if parts.count == 1:
                break
    roots = [parts.find(i) for i in range(len(tree_rows))]
    least: dict[int, int] = {}
    for root, (id_, _) in zip(roots, tree_rows):
        least[root] = min(id_, least.get(root, id_))
    links = [(id_, least[root]) for root, (id_, _) in zip(roots, tree_rows)]
    links += [(id_, least[roots[other]]) for id_, other in met]
    return [(a, b) for a, b in links if a != b]


def _link_units(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by unit; a unit may run over the end of a batch."""
    unit, tree, queries, links = None, [], [], []

    def flush():
        links.extend(spanning_links(tree, queries, radius))

    for batch in batches:
        units, roles, ids, prints = (batch.column(i).to_pylist() for i in range(4))
        for u, role, id_, print_ in zip(units, roles, ids, prints):
            if u != unit:
                flush()
                unit, tree, queries = u, [], []
            (queries if role else tree).append((id_, print_ & 0xFFFFFFFFFFFFFFFF))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])
        links.clear()
    flush()
    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])


def _keys(radius: int) -> Column:
    """Array of block keys of column ``print``: three of radius + 3 blocks each."""
    n = radius + 3
    edges = [round(64 * i / n) for i in range(n + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return F.array(*[F.xxhash64(F.lit(k), F.col("print").bitwiseAND(F.lit(signed(sum(c))))) for k, c in enumerate(combinations(masks, 3))])


def links(nodes: DataFrame, radius: int = 3, shard: int = SHARD) -> DataFrame:
    """Spanning links (a, b), a > b, among ``nodes`` (id, print), prints distinct.

    Work is dealt in units: a shard's tree with one block of queries, each of
    at most about ``shard`` rows.
    """
    keyed = nodes.select("id", "print", F.explode(_keys(radius)).alias("key"))
    groups = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    groups = groups.select("key", F.ceil(F.col("n") / shard).cast("int").alias("shards"))
    # A plain equi-join: adaptive execution splits a group that is too large.
    met = keyed.join(groups, "key").withColumn("own", F.pmod(F.xxhash64("print"), F.col("shards")).cast("int"))
    trees = F.transform(F.sequence(F.lit(0), F.col("own")), lambda t: F.struct(t.alias("tree"), F.col("own").alias("block")))
    blocks = F.transform(F.sequence(F.col("own"), F.col("shards") - 1), lambda q: F.struct(F.col("own").alias("tree"), q.alias("block")))
    units = met.select("key", "own", "id", "print", F.explode(F.array_distinct(F.concat(trees, blocks))).alias("u"))
    role = (F.col("u.tree") != F.col("own")).cast("int")
    unit = F.xxhash64("key", "u.tree", "u.block")
    units = units.select(unit.alias("unit"), role.alias("role"), "id", "print")
    units = units.repartition(shuffle_partitions(nodes.sparkSession), "unit").sortWithinPartitions("unit", "role", "id")
    found = units.mapInArrow(lambda batches: _link_units(batches, radius), "a long, b long")
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, component): the smallest id reachable over links (a > b).

    Alternates large and small stars until the links are stars already; each
    round is written to the shared folder, and the driver learns only whether
    another is needed. The ids of a hot node meet its minimum in an equi-join
    whose other side is one row per node.
    """
    edges = written(links, "links")
    for _ in range(max_rounds):
        if _are_stars(edges):
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.greatest("b", "m").alias("x"), F.col("m").alias("y"), "a")
        small = small.select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct("a", F.col("y").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = written(small, "links")
    raise RuntimeError("components did not settle")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every id has one link, to an id that has none."""
    once = edges.groupBy("a").count().where("count > 1").isEmpty()
    return once and edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, shard: int = SHARD) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (hex) and component_id.

    Equal fingerprints are one node, whatever the number of documents; nodes
    within ``radius`` differing bits are linked. Texts without words, null ones
    included, have fingerprint zero and are linked like others. Rows that repeat
    an id are one document's. The nodes are the fingerprints themselves, so rows
    without an id link what is near them. The component is the smallest id
    reachable, null where no document reachable has one. An empty table gives no
    rows.
    """
    prints = written(fingerprints(docs, id_col, text_col), "prints")
    nodes = written(prints.groupBy("print").agg(F.min("id").alias("id")), "print-nodes")
    linked = components(links(nodes.select(F.col("print").alias("id"), "print"), radius, shard))
    # A component's root is not among its linked ids.
    roots = linked.unionByName(linked.select(F.col("component").alias("id"), "component").distinct()).withColumnRenamed("id", "print")
    least = nodes.join(roots, "print").groupBy("component").agg(F.min("id").alias("least"))
    linked = roots.join(least, "component").select("print", "least")
    named = nodes.join(linked, "print", "left").select("print", F.coalesce("least", "id").alias("component_id"))
    # Hot fingerprints: a plain equi-join that adaptive execution may split.
    rows = prints.join(named, "print")
    return rows.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id.

    Rows that repeat that id stay together; rows without an id are never dropped.
    """
    found = near_dedup(docs, id_col, text_col, radius)
    return without(docs, found.where(f"{id_col} <> component_id").select(id_col), id_col)
