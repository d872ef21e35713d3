"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are all words of the examples; document frequencies come from all
documents. A term weighs TF times IDF times its information gain, the mutual
information of its presence and the label among the examples: with TF times IDF
alone the words that two texts share by chance drown the few that tell, and
hardly any score reaches the threshold (README). The examples lie in an inverted index that is cut into blocks of
consecutive examples. Of every term that many examples hold, each block knows
the greatest weight; the few postings of the other terms are summed as they
are. Texts are searched in batches: the block maxima bound what a block can
hold for a text, blocks whose bound stays below the text's k-th best are left
out, and what remains is scored by matrix products in single precision. All
that come near the k-th best are scored again in double precision, term by
term, so the result is exact and does not depend on the batch.
Distance-weighted votes of the neighbours give the score, and the neighbours
with the terms that weigh most in their cosine are the evidence.

Examples are a bounded sample (``per_class`` rows a class, of least id hash);
the index, its broadcast and a search are bounded by it. Texts are read whole.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import clashing, least_rows, written

#: Lower-case UTF-8 to words and spaces: ASCII but for letters parts words, as
#: do the signs beyond ASCII below (Latin-1, general and CJK punctuation).
FOLD = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SIGNS = re.compile("[\u0080-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u00d7\u00f7\u2000-\u206f\u3000-\u3004\u3007-\u3020\u3030]+")

#: Fixed bounds of the model.
PER_CLASS = 4_000
NEIGHBOURS = 15
BLOCK = 256
#: A term is common if at least one in so many examples holds it.
COMMON = 24
#: Texts of one search, and what single precision may be off by.
BATCH, SLACK = 128, 2e-5
#: Neighbours and terms that are told of, and judged texts that a worker remembers.
EVIDENCE, TOLD = 3, 5
CACHE = 2_000

#: A sparse vector: terms in order, and their weights.
Vector = tuple[np.ndarray, np.ndarray]


def words(text: str | None) -> list[bytes]:
    """Runs of letters, in lower case, as UTF-8."""
    text = (text or "").lower()
    if not text.isascii():
        text = SIGNS.sub(" ", text)
    return text.encode("utf-8", "replace").translate(FOLD).split()


def _spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, one range after the other, and the range of each."""
    lengths = end - begin
    owner = np.repeat(np.arange(len(begin)), lengths)
    return np.arange(len(owner)) + (begin - (np.cumsum(lengths) - lengths))[owner], owner


class BlockMaxIndex:
    """Unit vectors of examples by term and by example, in blocks of consecutive ones.

    Terms below ``common`` are held by many examples: their weights stand in a
    matrix, with the maxima of each block beside it. The postings of the others
    are flat arrays, with ``first`` where each term's begin.
    """

    def __init__(self, begin: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_terms: int, common: int, block: int = BLOCK):
        self.n, self.n_terms, self.common, self.block = len(begin) - 1, n_terms, common, block
        self.blocks = -(-self.n // block)
        self.begin, self.terms, self.weights = begin, terms, weights
        number = np.repeat(np.arange(self.n), np.diff(begin))
        head = self.terms < common
        self.matrix = np.zeros((common, self.blocks * block), np.float32)
        self.matrix[self.terms[head], number[head]] = self.weights[head]
        self.tops = self.matrix.reshape(common, self.blocks, block).max(axis=2)
        order = np.argsort(self.terms[~head], kind="stable")
        self.posted, self.posting = self.weights[~head][order].astype(np.float32), number[~head][order]
        self.first = np.searchsorted(self.terms[~head][order], np.arange(n_terms + 1))
        self.dense = np.zeros(n_terms)

    def search(self, queries: list[Vector], k: int) -> list[list[tuple[float, int, list[int]]]]:
        """The k examples of greatest cosine above 0, by text; of equal ones the lower numbers.

        With the first ones come the terms that weigh most in the cosine.
        """
        if not self.n or not queries:
            return [[] for _ in queries]
        width = self.blocks * self.block
        owner = np.repeat(np.arange(len(queries)), [len(t) for t, _ in queries])
        terms = np.concatenate([t for t, _ in queries])
        weights = np.concatenate([w for _, w in queries]).astype(np.float32)
        head = terms < self.common
        common = np.zeros((len(queries), self.common), np.float32)
        common[owner[head], terms[head]] = weights[head]
        at, pair = _spread(self.first[terms[~head]], self.first[terms[~head] + 1])
        cells = owner[~head][pair] * width + self.posting[at]
        scores = np.bincount(cells, weights[~head][pair] * self.posted[at], len(queries) * width).astype(np.float32).reshape(len(queries), width)
        bounds = common @ self.tops + scores.reshape(len(queries), self.blocks, self.block).max(axis=2)
        least = self._visit(common, scores, bounds, k)
        found = []
        for i, query in enumerate(queries):
            near = np.flatnonzero(scores[i] >= least[i])
            if len(near) > k:
                near = near[scores[i, near] >= np.partition(scores[i, near], len(near) - k)[len(near) - k] - SLACK]
            found.append(self._exact(query, near, k))
        return found

    def _visit(self, common: np.ndarray, scores: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
        """Complete the scores of all blocks that a text may need; what each text's k best reach at least.

        The best block of each text comes first and sets what others must reach.
        A block that is left out keeps no score.
        """
        rows, block = np.arange(len(scores)), self.block
        best, least = bounds.argmax(axis=1), np.full(len(scores), SLACK / 2, np.float32)
        done = np.zeros(bounds.shape, bool)

        def complete(of: np.ndarray, b: int) -> None:
            cut = slice(b * block, (b + 1) * block)
            scores[of, cut] += common[of] @ self.matrix[:, cut]
            done[of, b] = True
            if k <= block:
                reached = np.partition(scores[of, cut], block - k, axis=1)[:, block - k]
                least[of] = np.maximum(least[of], reached - SLACK)

        for b in np.unique(best).tolist():
            complete(np.flatnonzero(best == b), b)
        for b in np.argsort(-bounds.max(axis=0), kind="stable").tolist():
            of = rows[~done[:, b] & (bounds[:, b] >= least - SLACK)]
            if len(of):
                complete(of, b)
        scores.reshape(len(scores), self.blocks, block)[~done] = -1
        return np.maximum(least - SLACK, 0)

    def _exact(self, query: Vector, near: np.ndarray, k: int) -> list[tuple[float, int, list[int]]]:
        near = near[near < self.n]
        at, _ = _spread(self.begin[near], self.begin[near + 1])
        if not len(at):
            return []
        self.dense[query[0]] = query[1]
        terms = self.terms[at]
        parts = self.dense[terms] * self.weights[at]
        self.dense[query[0]] = 0
        ends = np.cumsum(self.begin[near + 1] - self.begin[near])
        begins = ends - (self.begin[near + 1] - self.begin[near])
        sums = np.round(np.add.reduceat(parts, begins), 12).tolist()
        best = sorted((-s, i, j) for j, (s, i) in enumerate(zip(sums, near.tolist())) if s > 0)[:k]
        found = []
        for n, (s, i, j) in enumerate(best):
            told: list[int] = []
            if n < EVIDENCE:
                own = parts[begins[j] : ends[j]]
                top = np.argsort(-own, kind="stable")[:TOLD]
                told = terms[begins[j] : ends[j]][top[own[top] > 0]].tolist()
            found.append((-s, i, told))
        return found


def information_gain(held: np.ndarray, toxic: np.ndarray, n: int, n_toxic: int) -> np.ndarray:
    """Mutual information of a term's presence and the label, in nats, by term.

    Of ``n`` examples, ``n_toxic`` of them toxic, ``held`` and ``toxic`` have the
    term. It is above 0, however little a term tells, so that no term drops out.
    """
    gain = np.full(len(held), 1e-9)
    for cell, row, column in ((toxic, held, n_toxic), (held - toxic, held, n - n_toxic), (n_toxic - toxic, n - held, n_toxic), (n - n_toxic - held + toxic, n - held, n - n_toxic)):
        full = cell > 0
        gain[full] += cell[full] / n * np.log(cell[full] * n / (row[full] * column))
    return np.maximum(gain, 1e-9)


class Terms:
    """All words of the examples, most frequent first, and what they weigh."""

    def __init__(self, words: list[str], weight: np.ndarray, common: int):
        self.words, self.weight, self.common = words, weight, common
        self.number = {w.encode(): i for i, w in enumerate(words)}

    def vector(self, text: str | None) -> Vector:
        """Unit vector of the words of a text that are terms."""
        bag = Counter(words(text))
        terms = np.fromiter(map(self.number.get, bag, repeat(-1)), np.int64, len(bag))
        counts = np.fromiter(bag.values(), float, len(bag))
        order = np.argsort(terms)[np.count_nonzero(terms < 0) :]
        terms = terms[order]
        weights = (1 + np.log(counts[order])) * self.weight[terms]
        return terms, weights / (np.sqrt(weights @ weights) if len(terms) else 1.0)


@dataclass
class Examples:
    """The examples as flat arrays: ids, labels, and where each vector's terms and weights begin."""

    names: list[str]
    labels: np.ndarray
    begin: np.ndarray
    terms: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Examples:
        """From rows (id, label, terms, weights); examples of like common words are put side by side."""
        table = table.combine_chunks()
        ids, labels = table.column("id").to_pylist(), np.array(table.column("label").to_pylist(), np.int64)
        lists = [table.column(c).chunk(0) if len(table) else pa.array([], pa.list_(pa.float64())) for c in ("terms", "weights")]
        terms, weights = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
        begin = np.concatenate(([0], np.cumsum([len(x) for x in lists[0]]))).astype(np.int64)
        order = sorted(range(len(ids)), key=lambda i: (terms[begin[i] : begin[i + 1]].astype(">i4").tobytes(), str(ids[i])))
        at, _ = _spread(begin[order], begin[1:][order])
        lengths = np.diff(begin)[order]
        return cls([str(ids[i]) for i in order], labels[order], np.concatenate(([0], np.cumsum(lengths))), terms[at].astype(np.int32), weights[at])


class Model:
    """Terms, and the index of the examples that have any."""

    def __init__(self, terms: Terms, examples: Examples, prior_weight: float = 1.0):
        self.terms, self.prior_weight = terms, prior_weight
        # Examples without terms sort first.
        empty = int((np.diff(examples.begin) == 0).sum())
        self.names, self.labels = examples.names[empty:], examples.labels[empty:].tolist()
        self.index = BlockMaxIndex(examples.begin[empty:], examples.terms, examples.weights, len(terms.words), terms.common)
        # Without an example of no words, all examples say what to expect of one.
        likely = examples.labels[:empty] if empty else examples.labels
        self.base = float((likely.sum() + 0.5) / (len(likely) + 1)) if len(likely) else 0.0
        self.cache: dict = {}

    def judge(self, texts: list[str | None], k: int = NEIGHBOURS) -> list[tuple[float, list[tuple]]]:
        """Score and evidence of each text: neighbours with cosine, label and shared terms."""
        keys = [hashlib.blake2b((t or "").encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
        if len(self.cache) > CACHE:
            self.cache.clear()
        found = {key: self.cache[key] for key in keys if key in self.cache}
        fresh = {key: text for key, text in zip(keys, texts) if key not in found}
        queries = [self.terms.vector(text) for text in fresh.values()]
        for key, near in zip(fresh, self.index.search(queries, k)):
            found[key] = self._vote(near) if near else (self.base, [])
        self.cache.update(found)
        return [found[key] for key in keys]

    def _vote(self, near: list[tuple[float, int, list[int]]]) -> tuple[float, list[tuple]]:
        weights = [1 / (1.05 - s) for s, *_ in near]
        votes = sum(w for w, (_, i, _) in zip(weights, near) if self.labels[i])
        score = (votes + self.prior_weight * self.base) / (sum(weights) + self.prior_weight)
        return score, [(self.names[i], s, self.labels[i], [self.terms.words[t] for t in told]) for s, i, told in near[:EVIDENCE]]


def examples(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> DataFrame:
    """(id, label, text) of at most ``per_class`` labelled documents a class, of least id hash.

    Rows are chosen by id before any text is read; a document labelled twice
    counts as toxic if one label says so.
    """
    labelled = labels.where(learn & F.col("toxic").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("toxic") == 1).cast("int")).alias("label"))
    chosen = least_rows(labelled.withColumn("draw", F.xxhash64("id")), per_class, "label").drop("draw")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    return written(rows.select("id", "label", "text"), "toxicity-examples")


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, examples, toxic examples) of a task's rows (id, label, text)."""
    held, toxic = Counter(), Counter()
    for batch in batches:
        for label, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            found = set(words(text))
            held.update(found)
            toxic.update(found if label else ())
    yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64()), pa.array([toxic[w] for w in held], pa.int64())], names=["word", "held", "toxic"])


def terms_of(docs: DataFrame, taught: DataFrame, text_col: str = "text") -> Terms:
    """All words of the examples, weighed by IDF over all documents and information gain."""
    n, n_toxic = taught.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    counted = taught.mapInArrow(_held, "word string, held long, toxic long").groupBy("word").agg(F.sum("held").alias("held"), F.sum("toxic").alias("toxic"))
    counted = counted.orderBy(F.col("held").desc(), "word").toArrow()
    found, held, toxic = (counted.column(c) for c in ("word", "held", "toxic"))
    found, held, toxic = found.to_pylist(), held.to_numpy().astype(float), toxic.to_numpy().astype(float)
    total, frequency = document_frequencies(docs, found, text_col) if found else (0, np.zeros(0))
    idf = np.log((total + 1) / (frequency + 1)) + 1
    return Terms(found, idf * information_gain(held, toxic, n, n_toxic), int((held * COMMON >= n).sum()))


def document_frequencies(docs: DataFrame, terms: list[str], text_col: str = "text") -> tuple[int, np.ndarray]:
    """Number of all documents, and of those that have each term."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, found, n = {t.encode(): i for i, t in enumerate(shared.value)}, Counter(), 0
        known = frozenset(number)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                found.update(known.intersection(words(text)))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *[number[w] for w in found]], pa.int32()), pa.array([n, *found.values()], pa.int64())], names=["term", "n"])

    rows = docs.select(text_col).mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    shared.unpersist()
    term, n = rows.column("term").to_numpy(), rows.column("n").to_numpy()
    frequency = np.zeros(len(terms))
    frequency[term[term >= 0]] = n[term >= 0]
    return int(n[term < 0].sum()), frequency


def _vectors(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """(id, label, terms, weights) of each row (id, label, text)."""
    terms = Terms(*shared.value)
    for batch in batches:
        found = [terms.vector(t) for t in batch.column(2).to_pylist()]
        columns = [batch.column(0), batch.column(1), pa.array([t for t, _ in found], pa.list_(pa.int32())), pa.array([w for _, w in found], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "terms", "weights"])


def vectors(taught: DataFrame, terms: Terms) -> Examples:
    """The examples as unit vectors, made in the tasks."""
    shared = taught.sparkSession.sparkContext.broadcast((terms.words, terms.weight, terms.common))
    kind = T.StructType([taught.schema["id"], taught.schema["label"], T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("weights", T.ArrayType(T.DoubleType()))])
    return Examples.of(taught.mapInArrow(lambda batches: _vectors(batches, shared), kind).toArrow())


#: The model this worker built last, by the run's key.
_models: dict = {}


def _judge(batches: Iterator[pa.RecordBatch], shared, key: str, text_col: str) -> Iterator[pa.RecordBatch]:
    if key not in _models:
        _models.clear()
        terms, taught = shared.value
        _models[key] = Model(Terms(*terms), taught)
    model = _models[key]
    kind = pa.list_(pa.struct([("doc_id", pa.string()), ("cosine", pa.float64()), ("label", pa.int32()), ("terms", pa.list_(pa.string()))]))
    for batch in batches:
        names = batch.schema.names
        texts = batch.column(names.index(text_col)).to_pylist()
        judged = [j for at in range(0, len(texts), BATCH) for j in model.judge(texts[at : at + BATCH])]
        evidence = [[{"doc_id": n, "cosine": s, "label": la, "terms": t} for n, s, la, t in e] for _, e in judged]
        done = {"score": pa.array([s for s, _ in judged], pa.float64()), "evidence": pa.array(evidence, kind)}
        yield pa.RecordBatch.from_arrays([done[n] if n in done else batch.column(i) for i, n in enumerate(names)], names=names)


def score_toxicity(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS, threshold: float = 0.7) -> DataFrame:
    """``docs`` with score (0 to 1), predicted and evidence (up to 3 neighbours).

    ``learn`` is a condition on the rows of ``labels`` (id, toxic); only those
    teach, and only a text decides its score. A text without any word of the
    examples, null and empty ones included, has the share of toxic ones among
    the examples without words, or else among all, as score; without labels
    every score is 0. Ties between neighbours go to the lower number in the
    index, which repeated runs share. Columns score, predicted and evidence of
    ``docs`` are replaced.
    """
    taught = examples(docs, labels, learn, id_col, text_col, per_class)
    terms = terms_of(docs, taught, text_col)
    model = (terms.words, terms.weight, terms.common), vectors(taught, terms)
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    evidence = "array<struct<doc_id:string,cosine:double,label:int,terms:array<string>>>"
    out = clashing(docs, ["score", "predicted", "evidence"]).withColumns({"score": F.lit(0.0), "evidence": F.array().cast(evidence)})
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in out.schema])
    out = out.mapInArrow(lambda batches: _judge(batches, shared, key, text_col), schema)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
