"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every token is predicted from two tokens on each side: their embeddings, by
position, feed a hidden layer and a softmax over word classes; a word's
probability in its class is its share of the class's count. The most frequent
words are classes of their own, the others share a class with the words that
end alike. Word counts come from all documents.

Texts are tokenised once, into the shared folder. They are dealt to slices by a
hash of id and text, so that what a slice learns does not depend on how the
input is split; every position of every text trains in one of the rounds, and
the networks of the slices are averaged by their positions after each. The sums
are made in tasks, and the driver gets about as many weight vectors as the root
of the number of slices. Then every token of every text is scored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import SPACES, clashing, text_chunks, written

#: Word numbers: a hash, whose last digits tell the ending. Counts of words are
#: gathered by number, so they grow with the words of the input up to this bound.
ENDINGS = 64
WORDS = 1 << 22
#: Sizes of the network: words with an embedding of their own (the others have
#: their ending's), and words that are a class of their own.
OWN = 2_048
CONTEXT = OWN + ENDINGS
SINGLE = 64
CLASSES = SINGLE + ENDINGS
DEPTH = 8
HIDDEN = 32
SIDE = 2
ROUNDS = 2
#: Positions worked on at once, few enough for the caches.
BATCH = 512
ONES = np.ones(max(BATCH, CLASSES), np.float32)
#: Logits beyond it might overflow in exp.
LARGE = 60
#: Tokens of a slice, about.
SLICE = 2_000_000


def number_of(word: bytes) -> int:
    return zlib.crc32(word) % (WORDS // ENDINGS) * ENDINGS + zlib.crc32(word[-2:]) % ENDINGS


#: Bytes of text whose words are numbered together, and of a word that are taken in step with others'.
TOGETHER = 1 << 18
IN_STEP = 32


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes part words; the steps of crc32 by byte; a word's ending by its last two bytes, the first a space if it has but one."""
    gaps = np.zeros(256, bool)
    gaps[list(SPACES.encode())] = True
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, steps >> 1 ^ 0xEDB88320, steps >> 1).astype(np.uint32)
    endings = [zlib.crc32(bytes([b] if gaps[a] else [a, b])) % ENDINGS for a in range(256) for b in range(256)]
    return gaps, steps, np.array(endings, np.int32)


def tokens_of(raws: list[bytes]) -> list[np.ndarray]:
    """The words' numbers (``number_of``) of each text."""
    out: list[np.ndarray] = []
    start, size = 0, 0
    for i, raw in enumerate(raws, 1):
        size += len(raw)
        if size >= TOGETHER or i == len(raws):
            out += _numbered(raws[start:i])
            start, size = i, 0
    return out


def _numbered(raws: list[bytes]) -> list[np.ndarray]:
    gaps, steps, endings = _tables()
    joined = b" " + b" ".join(raws).lower() + b" "
    data = np.frombuffer(joined, np.uint8)
    gap = gaps[data]
    edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    begins, ends = edges[::2], edges[1::2]
    # Words by length: those that have a byte at a step are the last of them.
    lengths = np.minimum(ends - begins, IN_STEP + 1).astype(np.uint8)
    order = np.argsort(lengths, kind="stable")
    at, state = begins[order], np.full(len(begins), 0xFFFFFFFF, np.uint32)
    done = np.cumsum(np.bincount(lengths, minlength=IN_STEP + 2))
    for k in range(min(int(lengths.max(initial=0)), IN_STEP)):
        now = state[done[k] :]
        now[:] = steps.take(now.astype(np.uint8) ^ data.take(at[done[k] :] + k)) ^ now >> 8
    sums = np.empty_like(state)
    sums[order] = ~state
    for k in order[done[IN_STEP] :].tolist():
        sums[k] = zlib.crc32(joined[begins[k] : ends[k]])
    last = data[ends - 2].astype(np.int32) << 8 | data[ends - 1]
    numbers = (sums % (WORDS // ENDINGS)).astype(np.int32) * ENDINGS + endings.take(last)
    return np.split(numbers, np.searchsorted(begins, np.cumsum([len(r) + 1 for r in raws[:-1]]) + 1))


def tokens(raw: bytes) -> np.ndarray:
    return tokens_of([raw])[0]


class Vocabulary:
    """What the counts of all words say: embedding row, class, and share in the class, by number."""

    def __init__(self, found: np.ndarray, counts: np.ndarray):
        top = np.lexsort((found, -counts))[:OWN]
        numbers = np.arange(WORDS) % ENDINGS
        self.context_of = (OWN + numbers).astype(np.int16)
        self.context_of[found[top]] = np.arange(len(top))
        self.class_of = (SINGLE + numbers).astype(np.uint8)
        self.class_of[found[top[:SINGLE]]] = np.arange(len(top[:SINGLE]))
        # Numbers that no text has weigh next to nothing.
        smooth = np.full(WORDS, 1e-3)
        smooth[found] = counts
        self.within = np.log(smooth / np.bincount(self.class_of, smooth, CLASSES)[self.class_of]).astype(np.float32)


class Network:
    """Embeddings, hidden layer and class softmax, in single precision."""

    SHAPES = ((2 * SIDE * (CONTEXT + 1), DEPTH), (2 * SIDE * DEPTH, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,))

    def __init__(self, flat: np.ndarray | None = None, words: Vocabulary | None = None, seed: int = 42):
        if flat is None:
            rng = np.random.default_rng(seed)
            flat = np.concatenate([(rng.standard_normal(int(np.prod(s))) * (0.1 if len(s) > 1 else 0)) for s in self.SHAPES])
        self.flat, self.words = flat.astype(np.float32), words
        cuts = np.cumsum([int(np.prod(s)) for s in self.SHAPES])[:-1]
        self.parts = [p.reshape(s) for p, s in zip(np.split(self.flat, cuts), self.SHAPES)]
        self.squares = [np.full(p.shape, 1e-4, np.float32) for p in self.parts]

    def context(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows of the embedding table for the neighbours of positions ``at``; CONTEXT is padding."""
        steps = [d for d in range(-SIDE, SIDE + 1) if d]
        return np.stack([ids[at + d] + k * (CONTEXT + 1) for k, d in enumerate(steps)], axis=1)

    def forward(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs, hidden layer and class log-probabilities up to a constant of the row, taken away by callers."""
        table, inner, shift, outer, bias = self.parts
        x = table.take(rows.ravel(), axis=0).reshape(len(rows), -1)
        h = x @ inner
        h += shift
        np.tanh(h, out=h)
        logits = h @ outer
        logits += bias
        # The hidden layer lies within 1, which bounds the logits; exp can't overflow below.
        if np.abs(outer).sum(axis=0).max() + np.abs(bias).max() > LARGE:
            logits -= logits.max(axis=1, keepdims=True)
        return x, h, logits

    def learn(self, rows: np.ndarray, classes: np.ndarray, rate: float = 0.05) -> None:
        """One step of adaptive gradient ascent on a batch."""
        _, inner, _, outer, _ = self.parts
        x, h, miss = self.forward(rows)
        np.exp(miss, out=miss)
        miss *= (-1 / (miss @ ONES[:CLASSES] * len(rows)))[:, None]
        miss[np.arange(len(rows)), classes] += 1 / len(rows)
        back = miss @ outer.T
        back *= 1 - h * h
        ones = ONES[: len(rows)]
        grads = [None, x.T @ back, ones @ back, h.T @ miss, ones @ miss]
        spread = (back @ inner.T).reshape(-1, DEPTH)
        flat = rows.ravel()
        order = np.argsort(flat, kind="stable")
        sorted_ = flat[order]
        begins = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
        used, dense = sorted_[begins], np.add.reduceat(spread.take(order, axis=0), begins, axis=0)
        squares = self.squares[0].take(used, axis=0) + dense * dense
        self.squares[0][used] = squares
        self.parts[0][used] = self.parts[0].take(used, axis=0) + rate * dense / np.sqrt(squares)
        for k in range(1, len(grads)):
            self.squares[k] += grads[k] ** 2
            self.parts[k] += rate * grads[k] / np.sqrt(self.squares[k])

    def log_probs(self, ids: np.ndarray, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), np.float64)
        for i in range(0, len(at), BATCH):
            part = at[i : i + BATCH]
            _, _, logits = self.forward(self.context(ids, part))
            w = words[part]
            own = logits[np.arange(len(part)), self.words.class_of[w]]
            np.exp(logits, out=logits)
            out[i : i + BATCH] = own - np.log(logits @ ONES[:CLASSES]) + self.words.within[w]
        return out


def laid_out(each: list[np.ndarray], words: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of several texts with padding between: context rows, numbers, positions."""
    pad = np.full(SIDE, -1, np.int32)
    numbers = np.concatenate([x for e in each for x in (pad, e)] + [pad])
    return np.where(numbers < 0, CONTEXT, words.context_of[numbers]), numbers, np.flatnonzero(numbers >= 0)


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(draw, numbers as bytes) of each row (draw, text) that has tokens."""
    for batch in batches:
        draws = batch.column(0).to_pylist()
        for start, raws in text_chunks(batch.column(1).to_pylist(), 4 << 20):
            found = [(draws[start + i], t) for i, t in enumerate(tokens_of(raws)) if len(t)]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([t.tobytes() for _, t in found], pa.binary()), pa.array([len(t) for _, t in found], pa.int64())], names=["draw", "numbers", "n"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(WORDS, np.int64)
    for batch in batches:
        if len(batch):
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), minlength=WORDS)
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["word", "n"])


def in_round(numbers: np.ndarray, at: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """Which positions a round trains on: each position is in one of the rounds."""
    return (numbers[at].astype(np.int64) * 40_503 + at * 7 + turn) % rounds == 0


#: Texts are learned from in runs of so many tokens.
RUN = 100_000


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The texts of each slice in runs; rows come sorted by slice and draw."""
    held, size, of = [], 0, None
    for batch in batches:
        for slice_, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if held and (slice_ != of or size >= RUN):
                yield of, held
                held, size = [], 0
            of = slice_
            held.append(np.frombuffer(raw, np.int32))
            size += len(held[-1])
    if held:
        yield of, held


def _train(batches: Iterator[pa.RecordBatch], shared, key: str, turn: int, rounds: int) -> Iterator[pa.RecordBatch]:
    """A row for each slice: its weights after a round times its positions, and their number."""
    flat, words = shared.value[0], _vocabulary(key, shared)
    network, seen, of = None, 0, None

    def done() -> pa.RecordBatch:
        weights = np.concatenate([p.ravel() for p in network.parts]).astype(np.float64) * seen
        return pa.RecordBatch.from_arrays([pa.array([of], pa.int32()), pa.array([seen], pa.int64()), pa.array([weights.tobytes()], pa.binary())], names=["slice", "seen", "weights"])

    for slice_, each in _runs(batches):
        if slice_ != of:
            if seen:
                yield done()
            network, seen, of = Network(flat.copy(), words), 0, slice_
        rows, numbers, at = laid_out(each, words)
        at = at[in_round(numbers, at, turn, rounds)]
        seen += len(at)
        around, classes = network.context(rows, at), words.class_of[numbers[at]]
        for i in range(0, len(at), BATCH):
            network.learn(around[i : i + BATCH], classes[i : i + BATCH])
    if seen:
        yield done()


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the slices' rows, in order, by group (rows come sorted by group and slice)."""
    of, seen, total = None, 0, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([of], pa.int32()), pa.array([seen], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["slice", "seen", "weights"])

    for batch in batches:
        for group, n, raw in zip(*(batch.column(k).to_pylist() for k in range(3))):
            weights = np.frombuffer(raw, np.float64)
            if group != of:
                if total is not None:
                    yield done()
                of, seen, total = group, n, weights.copy()
            else:
                seen, total = seen + n, total + weights
    if total is not None:
        yield done()


def _vocabulary(key: str, shared) -> Vocabulary:
    """The run's vocabulary; a worker makes it once."""
    if key not in _held:
        _held.clear()
        _held[key] = Vocabulary(*shared.value[1])
    return _held[key]


_held: dict = {}


def _score(batches: Iterator[pa.RecordBatch], shared, key: str, text_col: str) -> Iterator[pa.RecordBatch]:
    network = Network(shared.value[0], _vocabulary(key, shared))
    for batch in batches:
        names = batch.schema.names
        counts, sums = [], []
        for _, raws in text_chunks(batch.column(names.index(text_col)).to_pylist(), 1 << 20):
            each = tokens_of(raws)
            rows, numbers, at = laid_out(each, network.words)
            logs = np.append(np.cumsum(network.log_probs(rows, numbers, at)), 0.0) if len(at) else np.zeros(1)
            lengths = np.array([len(e) for e in each])
            ends = np.cumsum(lengths)
            upto = np.where(ends > 0, logs[ends - 1], 0.0)
            counts += lengths.tolist()
            sums += np.diff(np.concatenate(([0.0], upto))).tolist()
        done = {"n_tokens": pa.array(counts, pa.int64()), "log_prob": pa.array(sums, pa.float64())}
        yield pa.RecordBatch.from_arrays([done[n] if n in done else batch.column(i) for i, n in enumerate(names)], names=names)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, slice_tokens: int = SLICE) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], str]:
    """Flat weights, word numbers with their counts, and the run's key."""
    context, key = docs.sparkSession.sparkContext, uuid.uuid4().hex
    rows = docs.select(F.xxhash64(id_col, text_col).alias("draw"), F.col(text_col).alias("text"))
    texts = written(rows.mapInArrow(_tokenise, "draw long, numbers binary, n long"), "lm-tokens")
    total = texts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counted = texts.select("numbers").mapInArrow(_count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    counts = counted.column("word").to_numpy(), counted.column("n").to_numpy()
    slices = max(1, -(-total // slice_tokens))
    groups = max(1, round(slices**0.5))
    dealt = texts.select(F.pmod("draw", F.lit(slices)).cast("int").alias("slice"), "draw", "numbers")
    dealt = dealt.repartition(slices, "slice").sortWithinPartitions("slice", "draw").select("slice", "numbers")
    flat = Network().flat
    for turn in range(rounds):
        shared = context.broadcast((flat, counts))
        kind = "slice int, seen long, weights binary"
        learned = dealt.mapInArrow(lambda batches, shared=shared, turn=turn: _train(batches, shared, key, turn, rounds), kind)
        learned = learned.repartition(groups, F.pmod("slice", F.lit(groups))).sortWithinPartitions(F.pmod("slice", F.lit(groups)), "slice")
        summed = learned.select(F.pmod("slice", F.lit(groups)).alias("slice"), "seen", "weights").mapInArrow(_add_up, kind)
        got = sorted(summed.collect(), key=lambda r: r["slice"])
        if got:
            flat = (sum(np.frombuffer(bytes(r["weights"]), np.float64) for r in got) / sum(r["seen"] for r in got)).astype(np.float32)
    return flat, counts, key


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, slice_tokens: int = SLICE) -> DataFrame:
    """``docs`` with n_tokens, log_prob (sum over all tokens) and mean_log_prob.

    Tokens are runs without ASCII white space, A-Z lower-cased. A text without
    tokens (or null) has log_prob 0 and a null mean. An empty table gives no
    rows. Repeated rows score alike up to rounding, and any split of the input
    gives the same scores up to rounding. Columns with the three names are
    replaced.
    """
    flat, counts, key = train(docs, id_col, text_col, rounds, slice_tokens)
    shared = docs.sparkSession.sparkContext.broadcast((flat, counts))
    out = clashing(docs, ["n_tokens", "log_prob", "mean_log_prob"]).withColumns({"n_tokens": F.lit(0).cast("long"), "log_prob": F.lit(0.0)})
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in out.schema])
    out = out.mapInArrow(lambda batches: _score(batches, shared, key, text_col), schema)
    return out.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))
