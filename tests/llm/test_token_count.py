"""Token counts against the libraries themselves."""

import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.test_contracts import MID, rows_of
from tidemark.llm import token_count, vocab
from tidemark.llm.queries import QUERIES

BYTE = str(public_tokenizers.path("byte_bpe_50k.json"))
PIECE = str(public_tokenizers.path("piece_bpe_32k.model"))

ODD = [
    None, "", " ", "  ", "\n", " \n ", "a", " a", "a ", "a  b", "a \n\n  b\tc ", "it's we'll I'D 'tis''s", "x" * 30_000, "ab " * 20_000,
    "<|endoftext|>", "a<|endoftext|>b", " <|endoftext|>  <|endoftext|> b", "<|endoftext|", "<s> </s> <unk> <0x41>",
    "▁x y▁ ▁", "été 漢字　かな 😀‍👩", "a b  c　\u0085d\x1ce\x1f f", "12 345 6½²", "\x00\x07", "ʼn ߿ ࢏ ꟎ \U0001e6c0\U000323b0 a", "…—“”",
]


def test_code_points_on_which_the_patterns_agree():
    cutter = vocab.ByteLevel(BYTE)
    pre = cutter.library.pre_tokenizer
    for block in range(0, 0x110000, 64):
        codes = [chr(c) for c in range(block, block + 64) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}1{c}.{c} {c}{c}\n{c}" for c in codes if not vocab.OUTSIDE.search(c))
        assert [text[a:b] for _, (a, b) in pre.pre_tokenize_str(text)] == cutter.pattern.findall(text), hex(block)


@pytest.mark.parametrize("path", [BYTE, PIECE])
def test_units_are_encoded_apart(path):
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "\t", "a", "word", "▁", "é", "漢字", "'s", "'", "12", ".", "<|endoftext|>", "　", " ", "\x1c", "࢏", "😀"]
    texts = [t for t in ODD if t] + ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(3_000)]
    cutter = vocab.load(path, plain=True)
    whole = sentencepiece.SentencePieceProcessor(model_file=path).encode if path is PIECE else lambda t: cutter.library.encode(t, add_special_tokens=False).ids
    for text in texts:
        units = cutter.units(text)[0]
        assert [i for ids in cutter.ids(units) for i in ids] == whole(text), repr(text)


def want(path, text):
    if path is PIECE:
        return len(sentencepiece.SentencePieceProcessor(model_file=path).encode(text or ""))
    return len(Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("chunk, parts, remembered", [(1 << 20, 64, 1 << 20), (20_000, 3, 5), (50, 1, 0)])
@pytest.mark.parametrize("path", [BYTE, PIECE])
def test_counts(spark, monkeypatch, path, chunk, parts, remembered):
    monkeypatch.setattr(token_count, "CHUNK_CHARS", chunk)
    monkeypatch.setattr(token_count, "REMEMBERED", remembered)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(7, "again"), (7, "again"), (None, "no id"), (None, None)]
    docs = spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], "doc_id int, text string, n_tokens int, unit string").repartition(3)
    got = token_count.count_tokens(docs, path, limit=100, parts=parts)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and got.schema["doc_id"].dataType.simpleString() == "int"
    told = [(i, len((t or "").encode()), n, n > 100) for i, t in rows for n in [want(path, t)]]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(told, key=str)
    assert token_count.count_tokens(docs.limit(0), path).count() == 0


def test_query_equals_the_library(spark):
    rows = QUERIES["op13_token_counts"](spark, MID).collect()
    docs = rows_of(MID, "documents")
    library = Tokenizer.from_file(BYTE)
    told = {d["doc_id"]: (len((d["text"] or "").encode()), len(library.encode(d["text"] or "", add_special_tokens=False).ids)) for d in docs}
    assert len(rows) == len(docs) and {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in rows} == told
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in rows) and any(r["over_limit"] for r in rows)
