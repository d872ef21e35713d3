"""Runs of words: stretches that repeat with a period, whole texts at a time.

Seed and extend along diagonals. A run of period q and at least max(12, 2q)
words matches itself q words on for at least max(12 - q, q) words, so it holds a
pair of equal k-grams q words apart for any k up to that. Lags below 12 are
served by 6-grams, and lags of k to 2k - 1 by k-grams of k = 12, 24, 48 and so on:
the k-gram index of each scale is made of that of the scale before, occurrence
pairs in one document are listed by lag, and every pair is extended both ways
unless the table of what its lag has covered holds it already.

Within a stretch of small period p (at most k / 2) k-grams recur every p words,
and listing their pairs would cost the square of its length. Two facts spare
that, and lose no run. Where a match of lag q begins, its k-gram or that q words
on is the first of its stretch: were both inside, the word before would match as
well. So only pairs with such a first k-gram are listed. And pairs inside one
stretch are multiples of p, whose run is the stretch itself, known from a
smaller scale.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import text_chunks

#: The least length of a run, and half of it: the k-gram that any run of a lag below it holds twice.
LEAST = 12
SEED = LEAST // 2

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def ranked(*columns: np.ndarray) -> np.ndarray:
    """Numbers from 0 that are equal where all the columns are."""
    key = columns[0]
    for column in columns[1:]:
        key = np.unique(key, return_inverse=True)[1] * (int(column.max(initial=0)) + 1) + column
    return np.unique(key, return_inverse=True)[1]


class Diagonals:
    """Matches of a word sequence with itself, by lag, each extended once."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.covered: dict[int, int] = {}
        #: Period of the run from a start to an end; lags come in ascending order, so the smallest stays.
        self.found: dict[tuple[int, int], int] = {}

    def same(self, a: int, b: int, step: int, most: int) -> int:
        """How many words on from ``a`` and ``b`` (b > a), in the direction of ``step``, are equal, ``most`` at most."""
        w, n, block = self.words, 0, 32
        while n < most:
            size = min(block, most - n)
            x, y = a + step * n, b + step * n
            one, two = (w[x : x + size], w[y : y + size]) if step > 0 else (w[x - size + 1 : x + 1][::-1], w[y - size + 1 : y + 1][::-1])
            unequal = one != two
            at = int(unequal.argmax())
            if unequal[at]:
                return n + at
            n, block = n + size, min(block * 2, 1 << 20)
        return n

    def extend(self, firsts: np.ndarray, seconds: np.ndarray, k: int) -> None:
        """Extend pairs of equal k-grams, given by their places."""
        lags = seconds - firsts
        order = np.lexsort((firsts, lags))
        lags, firsts = lags[order], firsts[order]
        # Neighbours on a diagonal are one seed: from the first of them to the last.
        opens = np.flatnonzero(np.concatenate(([True], (np.diff(lags) != 0) | (np.diff(firsts) > 1)))) if len(firsts) else np.empty(0, np.int64)
        lasts = firsts[np.append(opens[1:], len(firsts)) - 1] if len(firsts) else firsts
        for q, i, last in zip(lags[opens].tolist(), firsts[opens].tolist(), lasts.tolist()):
            reached = self.covered.get(q, 0)
            if i < reached:
                continue
            start = i - self.same(i - 1, i + q - 1, -1, i - reached)
            end = last + k + self.same(last + k, last + k + q, 1, len(self.words) - (last + k + q))
            self.covered[q] = end
            if end - start >= max(LEAST - q, q):
                self.found.setdefault((start, end + q), q)

    def stretches(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts (ascending) and ends of the runs of k words or more whose period is at most k / 2."""
        some = sorted(place for place, q in self.found.items() if 2 * q <= k <= place[1] - place[0])
        both = np.array(some, np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]


def ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from low to high of each pair, joined, and the number of their pair."""
    sizes = np.maximum(high - low, 0)
    owner = np.repeat(np.arange(len(low)), sizes)
    return np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[owner], owner


def find_runs(words: np.ndarray, owner: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """All runs (start, end, smallest period) of a sequence of word numbers, ascending.

    ``owner`` is the document of each word; the last word of a document must be
    one that stands nowhere else. ``longest`` is the longest document's length.
    """
    n, found = len(words), Diagonals(words)
    if n < LEAST:
        return []
    two = ranked(words[:-1], words[1:])
    three = ranked(two[:-1], words[2:])
    gram = ranked(three[:-3], three[3:], owner[: n - SEED + 1])
    place, k = np.arange(len(gram)), SEED
    at = np.full(n, -1)
    while True:
        # The index of this scale: places by gram, those that recur in their document.
        order = np.lexsort((place, gram))
        place, gram = place[order], gram[order]
        again = np.concatenate(([False], gram[1:] == gram[:-1]))
        kept = again | np.append(again[1:], False)
        place, gram = place[kept], gram[kept]
        if not len(place):
            break
        if k == SEED:
            for shift in range(1, LEAST):
                near = np.flatnonzero((gram[shift:] == gram[:-shift]) & (place[shift:] - place[:-shift] < LEAST))
                if not len(near):
                    break
                listed = (place[near], place[near + shift]) if shift == 1 else tuple(np.concatenate(p) for p in zip(listed, (place[near], place[near + shift])))
            if shift > 1:
                found.extend(*listed, k)
        else:
            starts, ends = found.stretches(k)
            inner = np.zeros(n + 1, np.int32)
            np.add.at(inner, starts + 1, 1)
            np.add.at(inner, np.maximum(ends - k + 1, starts + 1), -1)
            lead = np.flatnonzero(np.cumsum(inner)[place] == 0)
            i, g = place[lead], gram[lead]
            beyond = np.zeros(n, np.int64)
            beyond[starts] = ends - k + 1
            key = gram * (n + 1) + place
            where = lambda p: np.searchsorted(key, g * (n + 1) + np.clip(p, 0, n))
            later, a = ranges(where(np.maximum(i + k, beyond[i])), where(i + 2 * k))
            earlier, b = ranges(where(i - 2 * k + 1), where(i - k + 1))
            found.extend(np.concatenate((i[a], place[earlier])), np.concatenate((place[later], i[b])), k)
        # The next scale's grams are two of this one's, one after the other.
        step, k = k, (2 * k if k > SEED else LEAST)
        if 2 * k > longest:
            break
        at[place] = gram
        follows = place + step
        good = follows < n
        good[good] = at[follows[good]] >= 0
        one, two = gram[good], at[follows[good]]
        at[place] = -1
        place = place[good]
        if not len(place):
            break
        gram = ranked(one, two)
    return sorted((start, end, q) for (start, end), q in found.found.items())


def _chunk(raws: list[bytes]) -> tuple[list[list[bytes]], list[list[tuple[int, int, int]]]]:
    """Words of each text, and its runs (start, length, period)."""
    number: dict[bytes, int] = {}
    words = [raw.split() for raw in raws]
    codes: list[int] = []
    for n, each in enumerate(words):
        codes.extend([number.setdefault(w, len(number)) for w in each])
        codes.append(-1 - n)
    code = np.array(codes, np.int64)
    ends = np.flatnonzero(code < 0)
    code[ends] = len(number) + np.arange(len(ends))
    owner = np.repeat(np.arange(len(ends)), np.diff(np.concatenate(([-1], ends))))
    runs: list[list] = [[] for _ in raws]
    first = np.concatenate(([0], ends + 1))
    for start, end, q in find_runs(code, owner, max(map(len, words), default=0)):
        doc = int(owner[start])
        runs[doc].append((start - int(first[doc]), end - start, q))
    return words, runs


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run repeats after its first period, one space between them."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, q in runs:
            keep[start + q : start + length] = False
        words = [w for w, k in zip(words, keep.tolist()) if k]
    return b" ".join(words).decode("utf-8", "surrogatepass")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    for batch in batches:
        texts = batch.column(batch.schema.names.index("_text")).to_pylist()
        for start, raws in text_chunks(texts):
            words, runs = _chunk(raws)
            told = [[dict(zip(("start", "length", "period"), r)) for r in each] for each in runs]
            left = [batch.column(i).slice(start, len(raws)) for i, c in enumerate(batch.schema.names) if c != "_text"]
            made = [pa.array(map(len, words), pa.int64()), pa.array(told, kind), pa.array(map(collapsed, words, runs), pa.string())]
            names = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*left, *made], names=[*names, "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: id, n_words, runs and the collapsed text.

    Words are what ASCII white space parts. A run is a stretch of words with
    smallest period q and at least max(12, 2q) words that no word next to it
    continues with period q; ``runs`` has (start, length, period) of all of a
    text's runs, by start, then period, words counted from 0. ``collapsed`` joins
    by one space the words that lie in no run beyond its first q words. Null and
    empty texts have no words. Rows are judged one by one, so null and repeated
    ids keep their rows and an id may be of any type. Other columns are ignored;
    an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    kinds = T.StructType.fromDDL(f"n_words bigint, runs {RUNS}, collapsed string")
    return rows.mapInArrow(_scan, T.StructType([rows.schema[0], *kinds]))
