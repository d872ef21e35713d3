"""Queries of the learned operators against plain versions over the whole of a small table."""

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm.test_contracts import SF, rows_of
from tidemark.llm import langid, quality
from tidemark.llm.common import split_of
from tidemark.llm.queries import QUERIES


def grams_of(text):
    """All n-grams of a text's folded bytes, as a set."""
    folded = b" " + b" ".join(text.encode().translate(langid.FOLD).split()) + b" "
    return {folded[i : i + n] for n in langid.LENGTHS for i in range(len(folded) - n + 1)}


def test_language_equals_kernel_ridge_over_all_pairs(spark):
    docs = rows_of(SF, "documents")
    split = {d["doc_id"]: zlib.crc32(str(d["doc_id"]).encode()) % 5 for d in docs}
    learn = list({d["text"]: d for d in docs if split[d["doc_id"]] and d["lang"] and d["text"]}.values())
    assert max(Counter(d["lang"] for d in learn).values()) <= langid.PER_LANGUAGE
    sets = [grams_of(d["text"]) for d in learn]
    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    between = np.array([[kernel(a, b) for b in sets] for a in sets])
    langs = sorted({d["lang"] for d in learn})
    count = Counter(d["lang"] for d in learn)
    weight = np.array([1 / count[d["lang"]] for d in learn])
    weight *= len(learn) / weight.sum()
    target = np.array([[1.0 if d["lang"] == la else -1.0 for la in langs] for d in learn])
    # Weighted ridge with a free offset, solved for the multipliers of the texts themselves.
    mean = weight / weight.sum()
    centre = np.eye(len(learn)) - np.ones((len(learn), 1)) * mean[None, :]
    inner = centre @ between @ centre.T
    penalty = langid.RIDGE * len(learn) * 1e-2
    alpha = np.linalg.solve(np.diag(weight) @ inner + penalty * np.eye(len(learn)), np.diag(weight) @ (target - mean @ target))
    # With all texts as landmarks the approximation by landmarks is exact.
    table = spark.read.parquet(f"{SF}/documents.parquet")
    exact = langid.identify(table.select("doc_id", "text"), table, split_of(F.col("doc_id"), 5) != 0, landmarks=len(learn))
    got = {r["doc_id"]: r for r in exact.collect()}
    query = {r["doc_id"]: r for r in QUERIES["op10_language_id"](spark, SF).collect()}
    assert len(got) == len(query) == len(docs)
    assert sum(query[i]["lang_pred"] == got[i]["lang_pred"] for i in got) > 0.97 * len(got)
    near = 0
    for d in docs:
        row = got[d["doc_id"]]
        assert query[d["doc_id"]]["held_out"] == (split[d["doc_id"]] == 0)
        if not any(c.isalpha() for c in d["text"] or ""):
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
            continue
        own = grams_of(d["text"])
        to = np.array([kernel(own, s) for s in sets])
        margin = (to - mean @ between) @ centre.T @ alpha + mean @ target
        best = int(margin.argmax())
        assert row["lang_pred"] == langs[best]
        near += abs(row["score"] - 1 / (1 + np.exp(-4 * margin[best]))) < 0.01
    assert near == sum(r["lang_pred"] != "und" for r in got.values())


def test_quality_equals_plain_maximisation_and_dense_learning(spark):
    docs = rows_of(SF, "documents")
    raws = [(d["text"] or "").encode() for d in docs]
    cast = [quality.votes(r) for r in raws]
    good = [(0.95, 0.5, 0.05)[min(sum(v < 0 for v in c), 2)] for c in cast]
    for _ in range(100):
        like = {}
        for c in (0, 1):
            for k in range(quality.LABELLERS):
                mass = {v: 1.0 for v in (-1, 0, 1)}
                for votes, g in zip(cast, good):
                    mass[votes[k]] += g if c else 1 - g
                for v in mass:
                    like[c, k, v] = mass[v] / sum(mass.values())
        prior = (sum(good) + 1) / (len(good) + 2)
        new = []
        for votes in cast:
            odds = np.log(prior) - np.log(1 - prior) + sum(np.log(like[1, k, v]) - np.log(like[0, k, v]) for k, v in enumerate(votes))
            new.append(float(1 / (1 + np.exp(-np.clip(odds, -50, 50)))))
        moved = max(abs(a - b) for a, b in zip(good, new))
        if moved < 1e-9:
            break
        good = new
    rows = QUERIES["op3_quality"](spark, SF).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(docs)
    assert all(abs(got[d["doc_id"]]["weak_label"] - g) < 1e-6 for d, g in zip(docs, good))
    # The scorer, on a dense matrix of all documents.
    dense = np.zeros((len(docs), quality.BUCKETS))
    for row, raw in zip(dense, raws):
        at, x = quality.features(raw)
        np.add.at(row, at, x)
    used = np.flatnonzero(dense.any(axis=0))
    x = np.hstack((dense[:, used], np.ones((len(docs), 1))))
    w, squares = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-8)
    decay = np.append(np.full(len(used), 1e-4), 1e-4)
    for _ in range(quality.EPOCHS):
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (np.array(good) - p) / len(docs) - decay * w / len(docs)
        squares += grad**2
        w += 0.5 * grad / np.sqrt(squares)
    for d, raw, score in zip(docs, raws, 1 / (1 + np.exp(-x @ w))):
        want = float(score) if raw.split() else 0.0
        assert abs(got[d["doc_id"]]["score"] - want) < 1e-3 and got[d["doc_id"]]["predicted"] == int(got[d["doc_id"]]["score"] >= 0.5)
