"""Rows that the mix takes, against what the mix says of every document."""

import random

import pytest

from tidemark.llm import mixing


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_taken_rows_equal_the_mix(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "MAX_BROADCAST_IDS", most)
    monkeypatch.setattr(mixing, "MAX_SOURCES", most)
    rng = random.Random(5)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 60))), rng.choice(["a", "a", "a", "b", None, "null"]), i % 7) for i in range(500)]
    rows += [(None, "x y z", "b", 0), (600, None, "a", 0), (601, " \t\n ", None, 0), (602, "word " * 50_000, "c", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    given = spark.createDataFrame([(i, w) for i, w in zip(range(0, 500, 3), [0.01, 2.0, None, 100.0, 0.0] * 40)], "id long, weight double")
    want = {r["doc_id"]: (r["size"], r["source_size"], r["target"], r["taken"]) for r in mixing.mix(docs, quality=given).collect() if r["taken"] > 0}
    out = mixing.take(docs, quality=given)
    assert out.columns == ["doc_id", "text", "source", "size", "source_size", "target", "taken"]
    got = [(r["doc_id"], (r["size"], r["source_size"], r["target"], r["taken"])) for r in out.collect()]
    assert len(got) == len(want) and dict(got) == want


def test_repeated_rows_come_back_once_each(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (1, "c", "t"), (None, "d e f", None), (None, "d", None), (2, None, "s")], "doc_id long, text string, source string")
    rows = mixing.take(docs).collect()
    assert len(rows) == len({(r["doc_id"], r["text"], r["source"]) for r in rows}) + sum(r["source"] == "s" for r in rows) // 2
    assert all(0 < r["taken"] <= 2 * r["size"] for r in rows)
    assert len({r["taken"] for r in rows if r["source"] == "s"}) <= 1
    assert mixing.take(docs.limit(0)).collect() == []


def test_texts_are_not_shuffled(spark, capsys):
    docs = spark.range(50).selectExpr("id doc_id", "repeat('w ', 5) text", "'s' source")
    mixing.take(docs, quality=spark.createDataFrame([(1, 2.0)], "id long, weight double")).explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
