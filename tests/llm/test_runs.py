"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tests.llm.test_contracts import MID, rows_of
from tidemark.llm import runs
from tidemark.llm.queries import QUERIES, repeating, run_digests


def brute_runs(words):
    """Every period's maximal stretches, by comparing all words at that lag."""
    n, found = len(words), {}
    code = {w: i for i, w in enumerate(dict.fromkeys(words))}
    w = np.array([code[x] for x in words])
    for q in range(1, n // 2 + 1):
        same = np.concatenate(([False], w[q:] == w[:-q], [False]))
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a + q >= max(12, 2 * q):
                found.setdefault((a, b - a + q), q)
    return sorted((s, length, q) for (s, length), q in found.items())


def of_words(words):
    return runs._chunk([" ".join(map(str, words)).encode()])[1][0]


def repeats(rng, depth):
    """Words that repeat at several scales."""
    if depth == 0:
        return [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randint(1, 6))]
    part = repeats(rng, depth - 1)
    out = part * rng.randint(1, 4) + repeats(rng, depth - 1)[: rng.randint(0, 6)]
    return out + part[: rng.randint(0, len(part))]


def test_random_repeats_equal_brute_force():
    rng = random.Random(3)
    seen = 0
    for _ in range(1_500):
        words = repeats(rng, rng.randint(0, 5))[:600]
        want = brute_runs(words)
        assert of_words(words) == want, words
        seen += len(want)
    assert seen > 3_000


@pytest.mark.parametrize(
    "words",
    [
        ["a"] * 11,
        ["a"] * 12,
        ["a"] * 500 + ["b"] + ["a"] * 500 + ["b"],
        (["a"] * 30 + ["b"]) * 12,
        (["a", "b"] * 20 + ["c"]) * 7 + ["a"],
        list("aabaabaabaabaaba" * 2),
        [str(i) for i in range(100)] * 2,
        [str(i) for i in range(100)] * 2 + [str(i) for i in range(99)],
        ["b"] + list("aab") * 5 + ["a"] + list("aab") * 5 + ["a"],
    ],
)
def test_stretches_inside_stretches(words):
    assert of_words(words) == brute_runs(words)


def test_fibonacci_words_hold_runs_of_every_scale():
    a, b = ["x"], ["x", "y"]
    while len(b) < 1_500:
        a, b = b, b + a
    assert of_words(b) == brute_runs(b)


def test_several_texts_do_not_meet():
    texts = [["a"] * 7, ["a"] * 7, ["b", "c"] * 9, [], ["b", "c"] * 9, ["x"]]
    words, got = runs._chunk([" ".join(t).encode() for t in texts])
    assert got == [brute_runs(t) for t in texts] and [len(w) for w in words] == [7, 7, 18, 0, 18, 1]


def test_long_repeats_do_not_cost_their_square():
    for words in (["word"] * 400_000, (["word"] * 1_999 + ["end"]) * 200, ["a"] * 150_000 + ["b"] + ["a"] * 150_000 + ["b"]):
        found = of_words(words)
        assert found[0][0] == 0 and found[-1][0] + found[-1][1] <= len(words)


def test_odd_rows(spark):
    texts = [(1, None), (1, ""), (None, " \t\n"), (2, "a " * 12), (2, "a " * 12), (3, "x" * 100_000), (4, "p q\tr\n" * 40_000)]
    docs = spark.createDataFrame([(i, t, 7, "clash", "clash") for i, t in texts], "doc_id long, text string, n_words int, runs string, collapsed string")
    got = sorted(((r["doc_id"] or 0), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in runs.periodic_runs(docs).collect())
    assert got == [(0, 0, [], ""), (1, 0, [], ""), (1, 0, [], ""), (2, 12, [(0, 12, 1)], "a"), (2, 12, [(0, 12, 1)], "a"), (3, 1, [], "x" * 100_000), (4, 120_000, [(0, 120_000, 3)], "p q r")]
    assert runs.periodic_runs(docs.limit(0)).count() == 0
    assert runs.periodic_runs(docs.selectExpr("cast(doc_id as string) doc_id", "text")).schema["doc_id"].dataType.simpleString() == "string"


def brute_query(doc):
    words = re.findall(r"[^\x20\x09-\x0D]+", doc["text"] or "")
    n, h = len(words), zlib.crc32(str(doc["doc_id"]).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = brute_runs(words)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(found), *told, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_query_equals_brute_force(spark):
    rows = QUERIES["op12_periodic_runs"](spark, MID).collect()
    got = {r["doc_id"]: (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["runs_sha256"], r["collapsed_sha256"]) for r in rows}
    docs = rows_of(MID, "documents")
    assert len(rows) == len(docs) and got == {d["doc_id"]: brute_query(d) for d in docs}
    assert any(r["n_runs"] == 0 for r in rows) and sum(r["n_runs"] > 0 for r in rows) > 50


def test_planting_into_odd_documents(spark):
    hit = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:6]
    rows = list(zip(hit, [None, "", " \n", "one", "a b", "a b c d e f g h"])) + [(None, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in run_digests(runs.periodic_runs(repeating(docs))).collect()}
    assert len(got) == len(rows)
    for i, text in rows[:-1]:
        r = got[i]
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["runs_sha256"], r["collapsed_sha256"]) == brute_query({"doc_id": i, "text": text})
