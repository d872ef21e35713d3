"""Alignment of two tokenizers against brute force over whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.test_contracts import MID, rows_of
from tidemark.llm import alignment, blobs, vocab
from tidemark.llm.queries import QUERIES

BYTE = str(public_tokenizers.path("byte_bpe_50k.json"))
PIECE = str(public_tokenizers.path("piece_bpe_32k.model"))


def brute(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text."""
    a_lib, b_lib = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a_lib.encode_special_tokens = True
    a_bytes, b_bytes = vocab.ByteLevel(BYTE, plain=True).token_bytes(), vocab.Pieces(PIECE).token_bytes()
    told, held = [], defaultdict(int)
    for text in texts:
        a = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        want = (" " + (text or "")).encode()
        if b"".join(a_bytes[i] for i in a) != want or b"".join(b_bytes[i] for i in b) != want:
            a, b = [], []
        span = lambda ids, raw: list(zip(ids, np.cumsum([0] + [len(raw[i]) for i in ids]).tolist(), np.cumsum([len(raw[i]) for i in ids]).tolist()))
        sa, sb = span(a, a_bytes), span(b, b_bytes)
        links, j = [], 0
        for x, s, e in sa:
            while j and sb[j - 1][2] > s:
                j -= 1
            while j < len(sb) and sb[j][1] < e:
                if sb[j][2] > s:
                    links.append((x, sb[j][0]))
                j += 1
        both = sorted({e for *_, e in sa} & {e for *_, e in sb})
        groups, i, k = [], 0, 0
        for end in both:
            one, two = [], []
            while i < len(sa) and sa[i][2] <= end:
                one.append(str(sa[i][0]))
                i += 1
            while k < len(sb) and sb[k][2] <= end:
                two.append(str(sb[k][0]))
                k += 1
            groups.append(",".join(one) + "|" + ",".join(two))
        told.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
        for pair in set(links):
            held[pair] += 1
    highest = defaultdict(int)
    for (x, _), n in held.items():
        highest[x] = max(highest[x], n)
    return [(na, nb, g, len(links), sum(held[p] == highest[p[0]] for p in links), sum(held[p] for p in links), sha) for na, nb, g, links, sha in told]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

ODD = [
    None, "", " ", "  ", "\n", " \n \n ", "a", " a", "a ", "a  b", "x\n \ny", "x \n\n y", "a　 b \u0085 c", "▁x", "a ▁", "some ▁ text", "<|endoftext|> <s>", "<0x41>\x00\x07",
    "漢字 かな😀‍👩 été", "word " * 9_000, "x" * 20_000, "a", "a", "… “quoted” it's 12 345", "࢏ ʼn \x1c \x1d",
]


@pytest.mark.parametrize("chunk, parts, fan_in", [(1 << 20, 64, 64), (300, 3, 2), (40, 1, 3)])
def test_equals_brute_force(spark, monkeypatch, chunk, parts, fan_in):
    monkeypatch.setattr(alignment, "CHUNK_CHARS", chunk)
    monkeypatch.setattr(alignment, "REMEMBERED", chunk)
    monkeypatch.setattr(alignment, "BLOCK", 7)
    rng = random.Random(11)
    bits = [" ", "  ", "\n", "the ", "tion", "été", ".", "'s", "9", "　", "▁", "\x1c", " <s>", "quer"]
    texts = ODD + ["".join(rng.choices(bits, k=rng.randint(1, 20))) for _ in range(200)]
    rows = [(None if i == 3 else i // 2, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id int, text string, run string, n_a int").repartition(3)
    got = alignment.align(docs, BYTE, PIECE, parts=parts, fan_in=fan_in)
    assert got.schema["doc_id"].dataType.simpleString() == "int"
    told = Counter((r["doc_id"], *(r[c] for c in COLUMNS)) for r in got.collect())
    assert told == Counter((i, *w) for (i, _), w in zip(rows, brute(texts)))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    assert alignment.align(docs, BYTE, PIECE).count() == 0
    docs = spark.createDataFrame([("x", None), (None, "")], "doc_id string, text string")
    assert sorted(tuple(r[c] for c in COLUMNS) for r in alignment.align(docs, BYTE, PIECE).collect()) == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_merging_runs_equals_counting():
    rng = np.random.default_rng(1)
    runs = [np.unique(rng.integers(0, 500, rng.integers(1, 300))) for _ in range(9)]
    blocks = lambda keys: iter([(keys[i : i + 11], np.full(len(keys[i : i + 11]), 2)) for i in range(0, len(keys), 11)])
    keys, counts = (np.concatenate(c) for c in zip(*alignment.merged([blocks(k) for k in runs])))
    want = Counter(int(k) for r in runs for k in r)
    assert keys.tolist() == sorted(want) and counts.tolist() == [2 * want[k] for k in sorted(want)]


def test_packing():
    for arrays in ([[]], [[0, 1, 255], [256]], [[1 << 33], [], [7, 70_000]]):
        given = [blobs.slim(np.array(a, np.int64)) for a in arrays]
        assert [a.tolist() for a in blobs.unpacked(blobs.packed(*given))] == arrays


def test_query_equals_brute_force(spark):
    rows = QUERIES["op11_tokenizer_alignment"](spark, MID).collect()
    docs = rows_of(MID, "documents")
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(rows) == len(docs) and got == dict(zip([d["doc_id"] for d in docs], brute([d["text"] for d in docs])))
