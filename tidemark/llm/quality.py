"""Quality by weak supervision: labellers, expectation-maximisation, a hashed scorer.

Overlapping heuristic labellers vote good, bad or nothing on every document.
Documents with the same votes are alike to the label model, so the counts of
vote patterns over all documents (at most 3 to the number of labellers) are all
that expectation-maximisation needs; it estimates how each labeller votes on
good and on bad documents. The posterior labels of a bounded sample train a
linear scorer over hashed words and word shapes, which then scores every whole
text.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import clashing, least_rows

#: Fixed bounds of the scorer: documents that train it, and its buckets.
SAMPLE = 4_000
BUCKETS = 1 << 16
EPOCHS = 80

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_SIGNS = bytes(b for b in range(33, 127) if chr(b) in "#$%&*+<=>@[\\]^_`{|}~/")
_CALLS = b"!?"
_ENDS = (b".", b"!", b"?", b":", b'"', b")", "…".encode())


def _count(raw: bytes, kinds: bytes) -> int:
    return len(raw) - len(raw.translate(None, kinds))


def _three(bad: bool, good: bool) -> int:
    return -1 if bad else 1 if good else 0


def votes(raw: bytes) -> list[int]:
    """Each labeller's vote on a text: 1 good, -1 bad, 0 none.

    Several labellers look at each kind of fault, so that their votes overlap.
    """
    words = raw.split()
    n = len(words)
    if not n:
        return [-1] + [0] * (LABELLERS - 1)
    letters = max(_count(raw, _LETTERS), 1)
    mean = sum(map(len, words)) / n
    lines = [x.strip() for x in raw.split(b"\n") if x.strip()]
    ended = sum(x.endswith(_ENDS) for x in lines) / len(lines)
    twice = sum(map(eq, words, words[1:])) / n
    kinds = len(set(words))
    short = sum(len(w) <= 4 for w in words) / n
    marked = sum(w[-1] in _SIGNS for w in words) / n
    shouted = sum(w.isupper() for w in words) / n
    signs, calls = _count(raw, _SIGNS) / n, _count(raw, _CALLS) / n
    return [
        -1 if n < 10 else 0,
        -1 if signs > 0.3 else 0,
        -1 if marked > 0.15 else 0,
        -1 if _count(raw, _UPPER) > 0.4 * letters else 0,
        -1 if shouted > 0.3 else 0,
        -1 if calls > 0.3 else 0,
        -1 if twice > 0.2 else 0,
        -1 if n >= 20 and kinds < 2 * n**0.5 else 0,
        -1 if len(set(lines)) < 0.6 * len(lines) else 0,
        _three(ended < 0.3, ended > 0.6),
        _three(short < 0.05, 0.2 < short < 0.8),
        _three(mean < 2.5 or mean > 14, 3 <= mean <= 10),
    ]


LABELLERS = 12


def pattern_of(raw: bytes) -> int:
    """The votes as one number in base 3."""
    number = 0
    for v in votes(raw):
        number = number * 3 + v + 1
    return number


def votes_of(pattern: int) -> list[int]:
    out = []
    for _ in range(LABELLERS):
        pattern, v = divmod(pattern, 3)
        out.append(v - 1)
    return out[::-1]


def label_model(patterns: dict[int, int], rounds: int = 100) -> tuple[dict[int, float], np.ndarray]:
    """Posterior of good by pattern, and P(vote | class) by class, labeller and vote.

    Starts from the bad votes of each pattern, so that class 1 stays the good one.
    """
    if not patterns:
        return {}, np.zeros((2, LABELLERS, 3))
    keys = sorted(patterns)
    cast = np.array([votes_of(k) for k in keys])
    weight = np.array([patterns[k] for k in keys], float)
    against = (cast < 0).sum(axis=1)
    good = np.where(against == 0, 0.95, np.where(against == 1, 0.5, 0.05))
    likes = np.zeros((2, LABELLERS, 3))
    for _ in range(rounds):
        for c, share in ((0, 1 - good), (1, good)):
            for v in (-1, 0, 1):
                likes[c, :, v + 1] = ((cast == v) * (weight * share)[:, None]).sum(axis=0) + 1
        likes /= likes.sum(axis=2, keepdims=True)
        prior = ((weight * good).sum() + 1) / (weight.sum() + 2)
        logs = [np.log(likes[c])[np.arange(LABELLERS), cast + 1].sum(axis=1) for c in (0, 1)]
        new = 1 / (1 + np.exp(np.clip(logs[0] + np.log(1 - prior) - logs[1] - np.log(prior), -50, 50)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return dict(zip(keys, good.tolist())), likes


#: Letters and digits of a word to the signs of its shape.
_SHAPE = bytes(88 if 65 <= b <= 90 else 120 if 97 <= b <= 122 or b >= 128 else 57 if 48 <= b <= 57 else b for b in range(256))
_RUNS = re.compile(rb"(.)\1+")
_shapes: dict[bytes, int] = {}


def _shape_bucket(word: bytes) -> int:
    """Bucket of a word's shape: kinds of characters, runs as one."""
    signs = word.translate(_SHAPE)
    found = _shapes.get(signs)
    if found is None:
        found = zlib.crc32(b"shape " + _RUNS.sub(rb"\1", signs)) % BUCKETS
        if len(_shapes) > 50_000:
            _shapes.clear()
        _shapes[signs] = found
    return found


def _word_bucket(word: bytes) -> int:
    return zlib.crc32(word.lower()) % BUCKETS


_RUN = zlib.crc32(b"shape of a word again") % BUCKETS
_LINE = zlib.crc32(b"shape of a line again") % BUCKETS


def features(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights of a text.

    Words weigh the logarithms of their counts, to unit length; shapes of words,
    and words and lines that come again, weigh the root of their share.
    """
    words = raw.split()
    lines = raw.split(b"\n")
    found = Counter(words)
    plain = np.fromiter(map(_word_bucket, found), np.int64, len(found))
    forms = np.fromiter(map(_shape_bucket, found), np.int64, len(found))
    counts = np.fromiter(found.values(), np.float64, len(found))
    shapes, where = np.unique(forms, return_inverse=True)
    again = [sum(map(eq, words, words[1:])), (len(lines) - len(set(lines))) * len(words) // len(lines)]
    shares = np.sqrt(np.append(np.bincount(where, counts, len(shapes)), again) / max(len(words), 1))
    weight = np.log1p(counts)
    return np.concatenate((plain, shapes, (_RUN, _LINE))), np.concatenate((weight / (np.linalg.norm(weight) or 1.0), shares))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], targets: list[float], epochs: int = EPOCHS, decay: float = 1e-4) -> np.ndarray:
    """Logistic weights by bucket, from features of texts; the last is the bias."""
    w, squares = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-8)
    if not rows:
        return w
    row = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
    at, x = np.concatenate([a for a, _ in rows]), np.concatenate([v for _, v in rows])
    y = np.array(targets)
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[at] * x, len(rows)) + w[-1], -50, 50)))
        miss = (y - p) / len(rows)
        grad = np.append(np.bincount(at, miss[row] * x, BUCKETS), miss.sum()) - decay * w / len(rows)
        squares += grad**2
        w += 0.5 * grad / np.sqrt(squares)
    return w


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()
    for batch in batches:
        found.update(pattern_of((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(0).to_pylist())
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())], names=["pattern", "n"])


def _taught(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(draw, features of the whole text, pattern) of each row (draw, text)."""
    for batch in batches:
        raws = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
        told = [summed(*features(r)) for r in raws]
        columns = [batch.column(0), pa.array([a for a, _ in told], pa.list_(pa.int32())), pa.array([x for _, x in told], pa.list_(pa.float32())), pa.array(map(pattern_of, raws), pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=["draw", "at", "x", "pattern"])


def summed(at: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features with one entry a bucket, at most ``BUCKETS`` whatever the text."""
    buckets, where = np.unique(at, return_inverse=True)
    return buckets.astype(np.int32), np.bincount(where, x, len(buckets)).astype(np.float32)


def sample_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SAMPLE) -> list:
    """(at, x, pattern) of the ``n`` documents of least hash of id and text; repeated rows count once.

    The tasks read whole texts and send their features, one entry a bucket,
    which bounds what the driver holds. Hashes are chosen first, so that no task
    gathers the texts of others.
    """
    rows = docs.select(F.xxhash64(id_col, text_col).alias("draw"), F.col(text_col).alias("text"))
    least = least_rows(rows.select("draw"), n)
    found = rows.join(F.broadcast(least), "draw").mapInArrow(_taught, "draw long, at array<int>, x array<float>, pattern int")
    return found.groupBy("draw").agg(F.min(F.struct("at", "x", "pattern")).alias("row")).orderBy("draw").select("row.*").collect()


_held: dict = {}


def _score(batches: Iterator[pa.RecordBatch], shared, key: str, text_col: str) -> Iterator[pa.RecordBatch]:
    if key not in _held:
        _held.clear()
        _held[key] = shared.value
    w, posterior = _held[key]
    for batch in batches:
        names = batch.schema.names
        scores, weak = [], []
        for text in batch.column(names.index(text_col)).to_pylist():
            raw = (text or "").encode("utf-8", "surrogatepass")
            weak.append(posterior[pattern_of(raw)])
            if not raw.split():
                scores.append(0.0)
                continue
            at, x = features(raw)
            scores.append(float(1 / (1 + np.exp(-np.clip(w[at] @ x + w[-1], -50, 50)))))
        done = {"score": pa.array(scores, pa.float64()), "weak_label": pa.array(weak, pa.float64())}
        yield pa.RecordBatch.from_arrays([done[n] if n in done else batch.column(i) for i, n in enumerate(names)], names=names)


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """``docs`` with score (0 to 1), weak_label (posterior of good) and predicted.

    Labels of people are not used. A text without words (or null) scores 0. An
    empty table gives no rows; a table of one kind of document is scored by what
    its votes say. The scorer's sample are at most ``sample`` documents of least
    hash of id and text; every text is voted on, learned from and scored whole. Repeated rows get equal scores. Columns score,
    weak_label and predicted of ``docs`` are replaced.
    """
    counts = docs.select(text_col).mapInArrow(_patterns, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    posterior, _ = label_model({r["pattern"]: r["n"] for r in counts})
    taught = sample_texts(docs, id_col, text_col, sample)
    weights = fit([(np.array(r["at"], np.int64), np.array(r["x"])) for r in taught], [posterior[r["pattern"]] for r in taught])
    shared, key = docs.sparkSession.sparkContext.broadcast((weights, posterior)), uuid.uuid4().hex
    out = clashing(docs, ["score", "weak_label", "predicted"]).withColumns({"score": F.lit(0.0), "weak_label": F.lit(0.0)})
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in out.schema])
    out = out.mapInArrow(lambda batches: _score(batches, shared, key, text_col), schema)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
