"""Walks against the operating system's, roots that come and go, and language profiles."""

import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import language
from tidemark.sources import roots, walk


def test_a_walk_equals_the_systems(spark, tmp_path):
    for name in ("a/b/c", "a/.hidden", "_under/d", ".git/objects", "x/.git", "node_modules/y", "empty"):
        (tmp_path / name).mkdir(parents=True)
    for n, name in enumerate(("a/1.txt", "a/b/c/2.txt", "a/.hidden/.3", "_under/d/_4", ".git/5", "x/.git/6", "x/target", "plain name with space+plus%41", "é 漢字")):
        (tmp_path / name).write_bytes(b"x" * n)
    (tmp_path / os.fsdecode(b"bad\xff")).write_bytes(b"bytes")
    os.symlink(tmp_path / "a", tmp_path / "x/link")
    os.symlink(tmp_path / "nowhere", tmp_path / "x/broken")
    skip = (".git", "node_modules", "target")
    want = {}
    for top, dirs, names in os.walk(tmp_path):
        links = [d for d in dirs if os.path.islink(f"{top}/{d}")]
        dirs[:] = [d for d in dirs if d not in skip]
        for name in [*dirs, *names]:
            full = f"{top}/{name}"
            info = os.lstat(full)
            is_dir = name in dirs and name not in links
            want[os.fsencode(full).decode("utf-8", "replace")] = (is_dir, None if is_dir else info.st_size, int(info.st_mtime), full.count("/") - str(tmp_path).count("/"))
    found = walk.walk(spark, [f"file://{tmp_path}"], skip_dirs=skip)
    rows = found.collect()
    assert {r["path"]: (r["is_dir"], r["size_bytes"], r["mtime_unix"], r["depth"]) for r in rows} == want and len(rows) == len(want)
    assert not any(r["skipped"] for r in rows) and any(r["name"] == "bad�" for r in rows)
    assert all(r["path"] == f"{r['parent']}/{r['name']}" for r in rows)
    assert walk.walk(spark, [str(tmp_path)], max_entries=3).count() == 3


def test_followed_links_and_what_cannot_be_read(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/b/f").write_bytes(b"12")
    os.symlink(tmp_path / "a", tmp_path / "a/b/up")
    os.symlink(tmp_path / "a/b", tmp_path / "side")
    os.symlink(tmp_path / "nowhere", tmp_path / "broken")
    rows = {r["path"].removeprefix(f"{tmp_path}/"): r for r in walk.walk(spark, [str(tmp_path), str(tmp_path / "missing")], follow_symlinks=True).collect()}
    assert {p for p, r in rows.items() if r["skipped"]} == {"broken", "a/b/up", "missing", "side/up"}
    assert rows["side/f"]["size_bytes"] == 2 and rows["side"]["is_dir"]
    assert "a/b/up/b" not in rows
    with pytest.raises(ValueError):
        walk.plain_path("s3://bucket/x")


def test_roots_come_and_go_between_batches(spark, tmp_path):
    change = "path string, kind string, t long, id long, size_bytes long, mtime_unix long"

    def put(root, part, *ids):
        spark.createDataFrame([(f"/{i}", "touched", i, i, i, None) for i in ids], change).coalesce(1).write.parquet(f"file://{tmp_path}/{root}/{part}")

    def table(*names):
        spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in names], "root string").write.mode("overwrite").parquet(f"file://{tmp_path}/table")

    told = []
    stream = roots.root_stream(spark, f"file://{tmp_path}/table")

    def note(stage):
        return lambda rows, number: told.extend((number, stage, r["root"][-1], r["kind"] if stage == "command" else r["id"]) for r in rows.orderBy("root", "id").collect())

    def run():
        begun = len(told)
        stream.writeStream.foreachBatch(lambda b, n: roots.by_stage(b, n, note("command"), note("scan"), note("change"))).option("checkpointLocation", f"file://{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
        return [t[1:] for t in told[begun:]]

    put("a", "held", 1, 2)
    put("a", "feed/go=0", 1)
    table("a")
    assert run() == [("command", "a", "added"), ("scan", "a", 1), ("scan", "a", 2)]
    put("a", "feed/go=1", 3)
    put("b", "held", 7)
    table("a", "b")
    # What was added comes before what changed.
    assert run() == [("command", "b", "added"), ("scan", "b", 7), ("change", "a", 3)]
    put("b", "feed/go=0", 8)
    put("a", "feed/go=2", 4)
    table("b")
    assert run() == [("command", "a", "removed"), ("change", "b", 8)]
    assert run() == []


def test_languages_by_profile(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    known = language.profiles(docs.where(~held))
    assert known.groupBy("lang").count().agg(F.max("count")).first()[0] == language.SIZE
    want = {r["doc_id"]: r["want"] for r in docs.where(held).select("doc_id", language.iso_639_3(F.col("lang")).alias("want")).collect()}
    got = {r["doc_id"]: r["language"] for r in language.detected(docs.where(held), known).collect()}
    assert len(got) == len(want)
    named = [got[i] == want[i] for i in got if got[i]]
    assert len(named) > 0.95 * len(want) and sum(named) == len(named)


def test_languages_compete_within_a_script(spark):
    texts = [("en", "the quick brown fox jumps over the lazy dog and then the other dog"), ("ru", "быстрая лиса прыгает через ленивую собаку и бежит дальше"), (None, "taught nothing"), ("xx", None)]
    known = language.profiles(spark.createDataFrame(texts, "lang string, text string"))
    given = [(1, "  the dog and the fox jump over another brown dog there  "), (2, "собака прыгает через лису и бежит быстрее лисы дальше"), (3, "the dog"), (4, None), (5, "1234567890 " * 10), (6, "漢字かな交じり文" * 10), (1, "the dog and the fox and the dog and the fox again"), (None, "the lazy dog jumps over the quick brown fox and runs")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in given], "doc_id long, text string, language string")
    got = sorted(((r["doc_id"] or 0), r["language"]) for r in language.detected(docs, known).collect() if r["language"])
    assert got == [(0, "eng"), (1, "eng"), (1, "eng"), (2, "rus")]
    assert language.detected(docs, known).count() == len(given)
    assert language.detected(docs.limit(0), known).count() == 0
    assert language.detected(docs, known.limit(0)).where("language IS NOT NULL").count() == 0


def test_scripts(spark):
    rows = spark.createDataFrame([("abc é",), ("абв a",), ("漢字 a",), ("ಕನ್ನಡ",), ("12 !",), (None,)], "t string")
    assert [r["s"] for r in rows.select(language.script(F.col("t")).alias("s")).collect()] == ["Latin", "Cyrillic", "Han", "Other", None, None]


def test_long_values_are_worked_on_in_slices():
    """A batch of many rows leaves as bounded slices, and the rows of later slices are not made before earlier ones are taken."""
    import pyarrow as pa

    from tidemark.sources.slices import SLICE_ROWS, row_by_row

    made = []

    def make(n, body):
        made.append(n)
        return n, body and body * 2

    schema = pa.schema([("n", pa.int64()), ("body", pa.string())])
    batch = pa.RecordBatch.from_pydict({"n": list(range(50)), "body": [None if n == 7 else "x" * 100 for n in range(50)]})
    out = row_by_row(make, schema, max_bytes=1_000)(iter([batch, batch.slice(0, 0), batch.slice(48)]))
    first = next(out)
    assert len(made) == first.num_rows == 5 and first.schema == schema
    rest = list(out)
    rows = [tuple(r.values()) for b in [first, *rest] for r in b.to_pylist()]
    assert rows == [(n, None if n == 7 else "x" * 200) for n in [*range(50), 48, 49]] and max(b.num_rows for b in rest) <= 6
    short = pa.RecordBatch.from_pydict({"n": list(range(2_500)), "body": [""] * 2_500})
    assert [b.num_rows for b in row_by_row(make, schema)(iter([short]))] == [SLICE_ROWS, SLICE_ROWS, 500]


def test_extraction_and_endpoints_hand_on_slices(spark):
    from pyspark.sql import functions as F

    from tidemark.sources import endpoints, office

    files = spark.range(4).select("id", F.lit("pdf").alias("doc_type"), F.lit(b"%PDF-1.4\n").alias("content"))
    asked = spark.range(4).select(F.col("id").alias("file_id"), F.lit("x").alias("body_text"))
    for frame in (office.extract(files), endpoints.enrich(asked, endpoints.stub_chat, "m", "s")):
        assert "MapInArrow" in frame._jdf.queryExecution().executedPlan().toString() and frame.where("error IS NULL").count() == 4


@pytest.mark.parametrize("piece", [3, 1 << 20])
def test_triples_are_ranked_as_by_a_plain_count(monkeypatch, piece):
    monkeypatch.setattr(language, "PIECE", piece)
    for text in ["", "42 _", "a", "Aa aA b-b_b1b", "der Mensch und das Meer, der Wind", "ΣΑΣ ΟΔΟΣ İx", "x²y ⅷz ª\U00020000字", "aaaa aaa aa a " * 9]:
        found = Counter()
        for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            found.update(f" {word} "[k : k + 3] for k in range(len(word)))
        want = sorted(found, key=lambda g: (-found[g], g))
        for size in (2, 300):
            assert language.ranked(text, size).tolist() == [language.key_of(g) for g in want[:size]]


def test_nearest_profile_as_by_a_plain_sum():
    profiles = {"b": {"abc": 1, "bcd": 2}, "a": {"abc": 2, "bcd": 1}, "c": {"xyz": 1}, "d": {"abc": 300}}
    known = language.Known(profiles)
    for grams in (["abc", "bcd"], ["bcd", "abc"], ["bcd", "zzz", "xyz"], ["zzz"], [], ["abc"]):
        less = {c: [abs(k - of[g]) - 300 for k, g in enumerate(grams, 1) if g in of] for c, of in profiles.items()}
        want = min(((sum(x), c) for c, x in less.items() if x), default=(0, None))[1]
        assert known.nearest(np.array([language.key_of(g) for g in grams], np.int64), 300) == want


def test_one_row_group_is_told_by_many_tasks(spark):
    rows = spark.range(64).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the sea and the wind of the night and the day").alias("text"), F.lit("en").alias("lang")).coalesce(1)
    told = language.detected(rows, language.profiles(rows)).withColumn("task", F.spark_partition_id())
    assert told.select("task").distinct().count() > 1
    assert told.groupBy("language").count().collect() == [("eng", 64)]
