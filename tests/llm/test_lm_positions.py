"""All positions train the network; scores against a plain reference and any split."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_contracts import MID, rows_of
from tidemark.llm import lm_score


def vocabulary(raws):
    found, counts = np.unique(np.concatenate([lm_score.tokens(r) for r in raws]), return_counts=True)
    return lm_score.Vocabulary(found, counts)


def test_every_position_trains_in_one_round():
    raws = [b"a b c d e f g", b"", b"h a a a b"]
    _, numbers, at = lm_score.laid_out([lm_score.tokens(r) for r in raws], vocabulary(raws))
    assert len(at) == 12
    for rounds in (1, 2, 3):
        taken = sum(lm_score.in_round(numbers, at, turn, rounds).astype(int) for turn in range(rounds))
        assert np.array_equal(taken, np.ones(len(at)))


def test_log_probs_equal_a_plain_network():
    raws = [b"the cat sat on the mat", b"the dog", b"cat"]
    words = vocabulary(raws)
    net = lm_score.Network(words=words, seed=3)
    rows, numbers, at = lm_score.laid_out([lm_score.tokens(r) for r in raws], words)
    got = net.log_probs(rows, numbers, at)
    table, inner, shift, outer, bias = net.parts
    every = Counter(n for r in raws for n in lm_score.tokens(r).tolist())
    want = []
    for raw in raws:
        text = lm_score.tokens(raw).tolist()
        for i, word in enumerate(text):
            x = []
            for k, d in enumerate((-2, -1, 1, 2)):
                row = words.context_of[text[i + d]] if 0 <= i + d < len(text) else lm_score.CONTEXT
                x += table[int(row) + k * (lm_score.CONTEXT + 1)].tolist()
            h = [math.tanh(sum(a * inner[j, m] for j, a in enumerate(x)) + shift[m]) for m in range(lm_score.HIDDEN)]
            logits = [sum(a * outer[j, c] for j, a in enumerate(h)) + bias[c] for c in range(lm_score.CLASSES)]
            own = int(words.class_of[word])
            inside = sum(n for w, n in every.items() if words.class_of[w] == own)
            want.append(logits[own] - math.log(sum(map(math.exp, logits))) + math.log(every[word] / inside))
    # Numbers without a text weigh a thousandth each in a class of words that end alike.
    assert np.allclose(got, want, atol=1e-3) or np.all(got <= np.array(want) + 1e-3)
    single = [i for i, n in enumerate(numbers[at]) if words.class_of[n] < lm_score.SINGLE]
    assert single and np.allclose(got[single], np.array(want)[single], atol=1e-4)


def test_numbers_tell_the_ending():
    assert lm_score.number_of(b"nation") % lm_score.ENDINGS == lm_score.number_of(b"station") % lm_score.ENDINGS == zlib.crc32(b"on") % lm_score.ENDINGS


def test_scores_do_not_depend_on_the_split_and_beat_word_counts(spark):
    rows = [(r["doc_id"], r["text"]) for r in rows_of(MID, "documents")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scores = []
    for n in (1, 7):
        scored = lm_score.score_documents(docs.repartition(n), slice_tokens=60_000)
        scores.append({r["doc_id"]: (r["n_tokens"], r["log_prob"]) for r in scored.select("doc_id", "n_tokens", "log_prob").collect()})
    assert scores[0].keys() == scores[1].keys()
    assert all(scores[1][i] == (n, pytest.approx(s, rel=1e-5, abs=1e-6)) for i, (n, s) in scores[0].items())
    whole = lm_score.score_documents(docs).agg(F.sum("log_prob")).first()[0]
    words = Counter(w for _, t in rows for w in lm_score.tokens((t or "").encode()).tolist())
    total = sum(words.values())
    plain = sum(n * math.log(n / total) for n in words.values()) / total
    assert whole / total > plain + 0.3 and sum(s for _, s in scores[0].values()) / total > plain + 0.1


@pytest.mark.parametrize("together", [1, 40, 1 << 18])
def test_words_are_numbered_together_as_one_by_one(monkeypatch, together):
    monkeypatch.setattr(lm_score, "TOGETHER", together)
    raws = [b"The cat  sat\ton\nTHE mat", b"", b" \x0b\x0c\r ", b"x", b" a bc ", b"q" * 31 + b" " + b"q" * 32 + b" " + b"q" * 33 + b" " + b"Q" * 999, "Él ÉL \x00 \x1c\x85 漢字 z".encode(), b"a\rb\nc", b""]
    want = [[lm_score.number_of(w) for w in raw.lower().split()] for raw in raws]
    got = lm_score.tokens_of(raws)
    assert [g.tolist() for g in got] == want and {g.dtype for g in got} == {np.dtype(np.int32)}
    assert lm_score.tokens_of([]) == [] and [len(t) for t in lm_score.tokens_of([b"", b" "])] == [0, 0]


@pytest.mark.parametrize("scale", [1, 50, 5_000])
def test_no_logits_are_too_large(scale):
    raws = [b"the cat sat on the mat", b"the dog", b"cat"] * 400
    words = vocabulary(raws)
    net = lm_score.Network(words=words, seed=3)
    net.parts[3][:] *= scale
    rows, numbers, at = lm_score.laid_out(lm_score.tokens_of(raws), words)
    assert len(at) > 2 * lm_score.BATCH
    around = net.context(rows, at)
    table, inner, shift, outer, bias = (p.astype(float) for p in net.parts)
    logits = np.tanh(table[around].reshape(len(at), -1) @ inner + shift) @ outer + bias
    logits -= logits.max(axis=1, keepdims=True)
    of = words.class_of[numbers[at]]
    want = logits[np.arange(len(at)), of] - np.log(np.exp(logits).sum(axis=1)) + words.within[numbers[at]]
    assert np.allclose(net.log_probs(rows, numbers, at), want, rtol=1e-4, atol=1e-4)
    net.learn(around[:512], of[:512])
    assert all(np.isfinite(p).all() for p in net.parts)
