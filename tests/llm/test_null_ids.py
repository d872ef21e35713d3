"""Documents and benchmark items without an id."""

from tidemark.llm import decontam, simhash


def test_null_id_near_copies_link_others(spark, monkeypatch):
    prints = {"a": 0b0, "b": 0b111, "c": 0b111111, "far": (1 << 40) - 1, "also far": (1 << 40) - 2}
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, id_col, text_col: spark.createDataFrame([(r["doc_id"], prints[r["text"]]) for r in docs.collect()], "id long, print long"))
    # a and c are near by b alone, which has no id; no far one has any.
    docs = spark.createDataFrame([(4, "a"), (None, "b"), (None, "b"), (2, "c"), (None, "far"), (None, "also far")], "doc_id long, text string")
    got = sorted((int(r["fingerprint"], 16), r["doc_id"] or -1, r["component_id"]) for r in simhash.near_dedup(docs).collect())
    assert [(p, i, c) for p, i, c in got if p < 64] == [(0, 4, 2), (7, -1, 2), (7, -1, 2), (63, 2, 2)]
    assert [c for p, _, c in got if p > 63] == [None, None]
    left = simhash.drop_near_copies(docs)
    assert sorted(r["doc_id"] or -1 for r in left.collect()) == [-1, -1, -1, -1, 2]


def test_items_without_an_id_hit(spark):
    items = spark.createDataFrame([(None, "two words"), (7, "some words"), (3, "two words")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "two words and some words"), (2, "none")], "doc_id long, text string")
    for shard_bytes in (1 << 20, 12):
        got = {r["doc_id"]: (r["items"], r["n_hit"]) for r in decontam.find_items(docs, items, shard_bytes=shard_bytes).collect()}
        assert got == {1: ([None, "3", "7"], 4), 2: ([], 0)}


def test_ids_may_be_strings(spark):
    docs = spark.createDataFrame([("b", "one two three four"), ("a", "ONE two three four"), (None, "other words here now"), ("c", "quite another text again")], "doc_id string, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_dedup(docs).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", None: None}
