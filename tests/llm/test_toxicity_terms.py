"""All terms of the examples are searched, and the query equals brute force."""

import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.test_contracts import MID, SF, rows_of
from tidemark.llm import toxicity
from tidemark.llm.queries import QUERIES


def test_a_few_labels_fill_the_index(spark):
    texts = [f"plain words of text {'abcdefghij'[i % 10]}" for i in range(46)] + ["you are an idiot"] * 6 + ["what an idiot you are", "plain text of words"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 46)) for i in range(52)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels, F.lit(True)).collect()}
    assert got[52]["predicted"] == 1 and got[53]["predicted"] == 0
    assert set(got[52]["evidence"][0]["terms"]) == {"an", "are", "idiot", "you"}


def brute_scores(docs, labels):
    """Score by id: 15 nearest labelled documents over all words, one pair at a time."""
    held_out = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    bags = {d["doc_id"]: Counter(w for w in re.findall(r"\w+", (d["text"] or "").lower()) for w in re.split(r"[\d_]+", w) if w) for d in docs}
    taught = {r["doc_id"]: r["toxic"] for r in labels if not held_out(r["doc_id"]) and r["doc_id"] in bags}
    n, toxic = len(taught), sum(taught.values())

    def gain(w):
        total = 0.0
        for label in (0, 1):
            for has in (True, False):
                cell = sum((w in bags[i]) == has and x == label for i, x in taught.items())
                row = sum((w in bags[i]) == has for i in taught)
                total += cell / n * math.log(cell * n / (row * (toxic if label else n - toxic))) if cell else 0
        return max(total + 1e-9, 1e-9)

    terms = {w for i in taught for w in bags[i]}
    every = Counter(w for bag in bags.values() for w in bag)
    weight = {w: (math.log((len(docs) + 1) / (every[w] + 1)) + 1) * gain(w) for w in terms}

    def vector(bag):
        raw = {w: (1 + math.log(k)) * weight[w] for w, k in bag.items() if w in weight}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {w: x / norm for w, x in raw.items()}

    vectors = {i: vector(bags[i]) for i in taught}
    base = (toxic + 0.5) / (n + 1)
    out = {}
    for i, bag in bags.items():
        mine = vector(bag)
        near = sorted(((sum(x * v.get(w, 0) for w, x in mine.items()), taught[j]) for j, v in vectors.items()), reverse=True)[:15]
        near = [(1 / (1.05 - s), label) for s, label in near if s > 0]
        out[i] = (sum(w for w, label in near if label) + base) / (sum(w for w, _ in near) + 1)
    return out


def test_query_equals_brute_force(spark):
    want = brute_scores(rows_of(SF, "documents"), rows_of(SF, "labels"))
    got = {r["doc_id"]: r for r in QUERIES["op5_toxicity"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(got[i]["score"] == pytest.approx(want[i], abs=1e-6) for i in want)
    # Texts without a word that tells have neighbours all the same.
    assert sum(bool(r["evidence"]) for r in got.values()) > 0.9 * len(got)


def test_scores_do_not_depend_on_the_split(spark):
    docs, labels = (spark.createDataFrame([tuple(r[c] for c in ("doc_id", k)) for r in rows_of(MID, t)], f"doc_id long, {k} {kind}") for t, k, kind in (("documents", "text", "string"), ("labels", "toxic", "int")))
    scores = [{r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs.repartition(n), labels, F.lit(True)).collect()} for n in (1, 7)]
    assert scores[0].keys() == scores[1].keys() and max(abs(scores[0][i] - scores[1][i]) for i in scores[0]) < 1e-9
