"""Ids of other types, repeated or absent; long texts with many hits."""

import time

from pyspark.sql import functions as F

from tidemark.llm import decontam, exact_dedup
from tidemark.llm.decontam import Chunk, automaton


def test_exact_copies_with_string_ids(spark):
    docs = spark.createDataFrame([("b", "x  y", 1), ("a", "x y", 2), (None, "x\ty", 3), ("c", "other", 4), (None, "alone", 5), (None, "alone", 6), ("d", "d", 7), ("d", "d", 8), ("d", "e", 9)], "doc_id string, text string, kept int")
    rows = exact_dedup.exact_dedup(docs).collect()
    assert sorted((r["doc_id"] or "-", r["keep_id"] or "-", r["kept"]) for r in rows) == sorted(
        [("b", "a", False), ("a", "a", True), ("-", "a", False), ("c", "c", True), ("-", "-", True), ("-", "-", False), ("d", "d", True), ("d", "d", False), ("d", "d", True)]
    )
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] or "-", r["text"]) for r in left.collect()) == [("-", "alone"), ("a", "x y"), ("c", "other"), ("d", "d"), ("d", "e")]


def test_one_odd_id_does_not_shuffle_the_texts(spark):
    rows = [(i, f"text {i % 40}") for i in range(60)]
    for more in ([], [(None, "text 1"), (None, "new")], [(3, "again"), (3, "text 3")]):
        docs = spark.createDataFrame(rows + more, "doc_id long, text string")
        left = exact_dedup.drop_exact_copies(docs)
        want = {(i, t) for i, t in rows if i < 40} | {m for m in more if m[1] in ("new", "again")}
        assert sorted(map(tuple, left.collect()), key=str) == sorted(want, key=str)
        plan = left._jdf.queryExecution().optimizedPlan().toString()
        # Only the branch of odd rows deduplicates by an aggregate.
        assert plan.count("Aggregate") == bool(more)


def test_hits_of_a_long_text_take_linear_time():
    text = ("alpha beta " + "été " * 2 + "x ") * 40_000
    machine = automaton([("1", "alpha beta")], 13)
    raws = [text.encode()]
    words, hits, spans, items = [0], [[]], [[]], [[]]
    began = time.perf_counter()
    decontam._scan_chunk(raws, machine, 0, words, hits, spans, items)
    assert time.perf_counter() - began < 5
    assert words == [200_000] and len(hits[0]) == len(spans[0]) == 40_000 and items == [["1"]]
    assert all(text[s["start"] : s["end"]] == "alpha beta" for s in spans[0][::997])
    assert Chunk([b""]).first.tolist() == [0, 0]


def test_a_large_benchmark_writes_the_texts_once(spark, monkeypatch):
    labels = []
    real = decontam.written
    monkeypatch.setattr(decontam, "written", lambda df, label: labels.append(label) or real(df, label))
    items = spark.createDataFrame([(i, f"passage number {i} of the set") for i in range(40)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"é {i} passage number {i} of the set, passage number {i + 1} of the set" if i % 3 else "none", "clash") for i in range(30)], "doc_id long, text string, items string")
    whole = {r["doc_id"]: r for r in decontam.find_items(docs, items).collect()}
    cut = {r["doc_id"]: r for r in decontam.find_items(docs, items, shard_bytes=120).collect()}
    assert whole == cut and any(len(r["items"]) == 2 for r in cut.values())
    assert labels.count("decontam-texts") == 1 and labels.count("shard-hits") > 5
    assert all("passage number" in docs_text[s["start"] : s["end"]] for r in cut.values() for docs_text in [r["text"]] for s in r["spans"])
