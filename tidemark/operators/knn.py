"""Nearest neighbours in two stages: sign bits first, then exact distance."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.vectors import checked, euclidean, hamming, sign_bits


def _literal(vector: Sequence[float]):
    return F.array(*[F.lit(float(x)) for x in vector]).cast("array<float>")


def exact(vectors: DataFrame, query: Sequence[float], limit: int) -> DataFrame:
    """(file_id, distance) of the nearest vectors; equal distances by id."""
    return vectors.select("file_id", euclidean(F.col("embedding"), _literal(query)).alias("distance")).orderBy("distance", "file_id").limit(limit)


def two_stage(vectors: DataFrame, query: Sequence[float], limit: int, oversample: int = schemas.HAMMING_OVERSAMPLE) -> DataFrame:
    """The nearest by Hamming distance, ``oversample`` times as many as wanted, ranked by exact distance.

    The first stage reads only ids and bits; vectors are read for its few rows.
    """
    width = len(query)
    bits = sign_bits(_literal(query), width)
    first = vectors.select("file_id", hamming(F.col("bits"), bits).alias("h")).orderBy("h", "file_id").limit(oversample * limit)
    # At most oversample x limit ids: a bounded broadcast.
    return exact(vectors.join(F.broadcast(first.select("file_id")), "file_id"), query, limit)


def pool(limit: int, filtered: bool) -> int:
    """Number of candidates: more of them where a filter will drop some."""
    return min(limit * schemas.FILTER_OVERSAMPLE, schemas.MAX_CANDIDATES) if filtered else limit


#: Queries, and vectors, that meet in one task at most.
MAX_BLOCK_QUERIES = 16_384
MAX_BLOCK_VECTORS = 131_072
#: Rows and columns of the table of approximate distances that a task holds.
TILE_QUERIES, TILE_VECTORS = 1_024, 4_096

_NEAR = "query_id long, best array<struct<d:double,file_id:long>>, first array<struct<h:int,file_id:long,d:double>>"


def recall(vectors: DataFrame, queries: DataFrame, limit: int, width: int, max_broadcast: int = MAX_BLOCK_QUERIES) -> DataFrame:
    """Per query (query_id, embedding): how many of the exact nearest the two stages find.

    Queries are a stated set held against all rows. Blocks of at most
    ``max_broadcast`` queries meet parts of at most ``MAX_BLOCK_VECTORS`` vectors,
    one pair of them a task; a task gives each of its queries' best rows of both
    stages, of which the best are taken over all parts. The pairs are as many as
    queries times vectors, and no pair is left out; a task holds one block, one
    part and one tile of distances. Rows without a vector are near to nothing.
    """
    asked = queries.where("embedding IS NOT NULL").select("query_id", checked(F.col("embedding"), width).alias("q"))
    held = vectors.where("embedding IS NOT NULL").select("file_id", checked(F.col("embedding"), width).alias("embedding"), "bits")
    n, m = queries.count(), vectors.count()
    blocks, tasks = max(1, -(-n // max_broadcast)), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # As many tasks as shuffle partitions, or more where a part would be too large.
    parts = max(1, -(-m // MAX_BLOCK_VECTORS), -(-tasks // blocks) if m > TILE_VECTORS else 1)
    dealt = lambda key, k: F.pmod(F.xxhash64(key), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = held.withColumn("part", dealt("file_id", parts)).withColumn("block", every(blocks))
    right = asked.withColumn("block", dealt("query_id", blocks)).withColumn("part", every(parts))
    words = -(-width // 64)
    right = right.withColumn("qb", sign_bits(F.col("q"), width))
    most = limit * schemas.HAMMING_OVERSAMPLE

    def meet(vectors_: pa.Table, queries_: pa.Table) -> pa.Table:
        found = _nearest(
            vectors_["file_id"].to_numpy(), _matrix(vectors_["embedding"], width), _matrix(vectors_["bits"], words), _matrix(queries_["q"], width), _matrix(queries_["qb"], words), limit, most
        )
        best, first = zip(*found) if found else ((), ())
        return pa.table([queries_["query_id"].cast(pa.int64()), pa.array(best, _BEST), pa.array(first, _FIRST)], names=["query_id", "best", "first"])

    met = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(meet, _NEAR)
    least = lambda name, k: F.slice(F.array_sort(F.flatten(F.collect_list(name))), 1, k)
    merged = met.groupBy("query_id").agg(least("best", limit).alias("best"), least("first", most).alias("first"))
    rescored = F.array_sort(F.transform("first", lambda c: F.struct(c["d"].alias("d"), c["file_id"].alias("file_id"))))
    hits = F.size(F.array_intersect("best", F.slice(rescored, 1, limit)))
    return merged.where(F.size("best") > 0).select("query_id", hits.cast("long").alias("hits"), F.size("best").cast("long").alias("wanted"))


_BEST = pa.list_(pa.struct([("d", pa.float64()), ("file_id", pa.int64())]))
_FIRST = pa.list_(pa.struct([("h", pa.int32()), ("file_id", pa.int64()), ("d", pa.float64())]))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width)


def _distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of each row of ``x`` to its row of ``q``, summed in the order of the components."""
    total = np.zeros(len(x))
    for k in range(x.shape[1]):
        total += (x[:, k].astype(np.float64) - q[:, k].astype(np.float64)) ** 2
    return np.sqrt(total)


def _cut(who: np.ndarray, keys: tuple, most: int) -> np.ndarray:
    """Positions of the ``most`` least rows of each ``who``, by ``keys``, the first counting most."""
    order = np.lexsort((*reversed(keys), who))
    sorted_ = who[order]
    starts = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[rank < most]


def _nearest(ids: np.ndarray, x: np.ndarray, bits: np.ndarray, q: np.ndarray, qbits: np.ndarray, limit: int, most: int) -> list[tuple[list, list]]:
    """(best, first) of each query: the ``limit`` nearest by (distance, id) and the ``most`` nearest by (Hamming distance, id).

    Vectors go by in order of id. A product of matrices gives squared distances
    up to rounding, of which all within the error of the worst one kept so far
    are worked out exactly.
    """
    order = np.argsort(ids, kind="stable")
    ids, x, bits = ids[order], x[order], bits[order]
    if len(ids):
        # Copies of a vector share all distances, so beyond the first ``most`` of them by id none can be among the best.
        _, copy = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)
        few = np.sort(_cut(copy, (ids,), max(limit, most)))
        ids, x, bits = ids[few], x[few], bits[few]
    wide, square = x.astype(np.float64), (x.astype(np.float64) ** 2).sum(axis=1)
    out = []
    for lo in range(0, len(q), TILE_QUERIES):
        asked, asked_bits = q[lo : lo + TILE_QUERIES].astype(np.float64), qbits[lo : lo + TILE_QUERIES]
        n, asked_square = len(asked), (asked**2).sum(axis=1)
        near = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]  # query, vector, distance
        first = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)]  # query, vector, Hamming distance
        reach, worst = np.full(n, np.inf), np.full(n, 1 << 30, np.int32)
        for at in range(0, len(ids), TILE_VECTORS):
            some = slice(at, at + TILE_VECTORS)
            with np.errstate(invalid="ignore", over="ignore"):
                near_square = asked_square[:, None] + square[None, some] - 2 * (asked @ wide[some].T)
                slack = 1e-9 * (asked_square[:, None] + square[None, some])
                if at == 0 and near_square.shape[1] > limit:
                    # Nothing is kept yet, so what the first tile holds sets the bar.
                    bar = np.partition(near_square + slack, limit - 1, axis=1)[:, limit - 1 : limit]
                else:
                    bar = (reach**2)[:, None]
                who, what = np.nonzero(~(near_square > bar + slack))
            what = what + at
            near = [np.concatenate(p) for p in zip(near, (who, what, _distances(x[what], asked[who])))]
            keep = _cut(near[0], (near[2], near[1]), limit)
            near = [p[keep] for p in near]
            _raise_bar(reach, near[0], near[2], limit)
            apart = np.zeros((n, len(ids[some])), np.uint8 if bits.shape[1] < 4 else np.int32)
            for w in range(bits.shape[1]):
                apart += np.bitwise_count(asked_bits[:, w, None].view(np.uint64) ^ bits[some, w][None].view(np.uint64))
            if at == 0 and apart.shape[1] > most:
                worst = np.partition(apart, most - 1, axis=1)[:, most - 1].astype(np.int32) + 1
            # Ids ascend, so a later vector as far off as the worst one kept does not take its place.
            who, what = np.nonzero(apart < worst[:, None])
            first = [np.concatenate(p) for p in zip(first, (who, what + at, apart[who, what].astype(np.int32)))]
            keep = _cut(first[0], (first[2], first[1]), most)
            first = [p[keep] for p in first]
            _raise_bar(worst, first[0], first[2], most)
        exact_d = _distances(x[first[1]], asked[first[0]])
        best, early = [[] for _ in range(n)], [[] for _ in range(n)]
        for k, d, i in zip(near[0].tolist(), near[2].tolist(), ids[near[1]].tolist()):
            best[k].append({"d": d, "file_id": i})
        for k, h, d, i in zip(first[0].tolist(), first[2].tolist(), exact_d.tolist(), ids[first[1]].tolist()):
            early[k].append({"h": h, "file_id": i, "d": d})
        out += zip(best, early)
    return out


def _raise_bar(bar: np.ndarray, who: np.ndarray, value: np.ndarray, most: int) -> None:
    """Set the bar of each query that has ``most`` rows to its worst value; ``who`` is sorted and each one's values ascend."""
    full = np.flatnonzero(np.bincount(who, minlength=len(bar)) == most)
    bar[full] = value[np.searchsorted(who, full, "right") - 1]


def stored(vectors: DataFrame, dimensions: int) -> DataFrame:
    """(file_id, embedding, bits): bits come with their vector, whose width is checked."""
    checked_vector = checked(F.col("embedding"), dimensions)
    return vectors.select("file_id", checked_vector.alias("embedding"), sign_bits(checked_vector, dimensions).alias("bits"))


def check_config(config: DataFrame, model: str, dimensions: int) -> None:
    """Refuse to mix vectors of another model or width than those stored."""
    row = config.where("id = 1").first()
    if row is not None and (row["model"], row["dimensions"]) != (model, dimensions):
        raise ValueError(f"stored vectors are {row['model']} x {row['dimensions']}, not {model} x {dimensions}")
