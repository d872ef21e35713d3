"""Operators of the file history on small tables: rules, limits, invariants."""

import io
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import clock, json_text, text, vectors
from tidemark.operators import cdc, knn, paths, queues
from tidemark.operators import events as ev
from tidemark.plans import metrics, timeline
from tidemark.plans.search import search
from tidemark.sources import endpoints, files, office

EVENTS = "id long, file_id long, kind string, at_unix_ms long, size_bytes long"
META = "file_id long, doc_type string, author string, language string, git_branch string"
RICH = "file_id long, classification string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def store(spark):
    events = spark.createDataFrame([(1, 1, "created", 1000, 1), (2, 2, "created", 3000, 2), (3, 1, "modified", 2000, 3), (4, 3, "odd", 2000, None)], EVENTS)
    meta = spark.createDataFrame([(1, "pdf", "Ada", "en", "main"), (2, "docx", "Bob", "de", None)], META)
    rich = spark.createDataFrame([(1, "business"), (2, "personal")], RICH)
    return events, meta, rich


def ids(df):
    return [r["id"] for r in df.collect()]


def test_timeline_order_limits_and_filters(store):
    assert ids(timeline.timeline(*store)) == [2, 4, 3, 1]
    assert len(ids(timeline.timeline(*store, limit=0))) == 1
    assert ids(timeline.timeline(*store, doc_type="pdf")) == [3, 1]
    assert ids(timeline.timeline(*store, git_branch="main", classification="business", kind="modified")) == [3]
    assert ids(timeline.timeline(*store, author="nobody")) == []
    assert ids(timeline.timeline(*store, before_id=3)) == [2, 1]


def test_timeline_refuses_bad_arguments(store):
    for bad in ({"kind": "moved"}, {"colour": "red"}, {"author": "x" * 257}):
        with pytest.raises(ValueError):
            timeline.timeline(*store, **bad)
    for check, bad in ((schemas.check_query, " "), (schemas.check_query, "x" * 4097), (schemas.check_roots, []), (schemas.check_roots, ["a", " "])):
        with pytest.raises(ValueError):
            check(bad)
    assert schemas.clamp(None) == 50 and schemas.clamp(10_000) == 500 and schemas.check_query("a") == "a"


def test_paging_over_equal_times_loses_nothing(spark):
    rows = spark.createDataFrame([(i, 1, "created", 5000, i) for i in range(10)], EVENTS)
    seen = [i for page in range(1, 6) for i in ids(timeline.page_after(rows, 3, page))]
    assert sorted(seen) == list(range(10)) and len(seen) == 10


def test_json_leaves_nulls_out(store):
    said = {r["id"]: json.loads(r["json"]) for r in timeline.json_rows(store[0]).collect()}
    assert "size_bytes" not in said[4] and said[1]["size_bytes"] == 1


def test_latest_keeps_the_callers_rank(spark, store):
    ranked = spark.createDataFrame([(2, 1), (1, 2), (99, 3)], "file_id long, rank int")
    assert [(r["file_id"], r["id"]) for r in ev.latest_ranked(store[0], ranked).orderBy("rank").collect()] == [(2, 2), (1, 3)]


def test_facets(spark, store):
    rows = spark.createDataFrame([(1, "pdf"), (2, "pdf"), (3, "docx"), (4, "text"), (5, None)], "file_id long, doc_type string")
    assert [tuple(r) for r in ev.facet_counts(rows, "doc_type").collect()] == [("pdf", 2), ("docx", 1), ("text", 1)]
    with pytest.raises(ValueError):
        ev.facet_counts(rows, "size")


NAMES = ["a b", "quote'", 'double"', "semi;colon", "$(x)", "..hidden", "...", "a..b", "日本", "\u00e9", "e\u0301", " lead", "trail ", "tab\tx", "%", "_", "x" * 300]


def test_paths_round_trip_and_stay_apart(spark):
    given = [f"/home/{n}/file" for n in NAMES] + [f"/home/{n}" for n in NAMES]
    tree = paths.tree_of(spark.createDataFrame([(p,) for p in given], "path string"))
    got = {r["path"] for r in paths.resolve(tree.select("id", "parent_id", "name")).collect()}
    assert set(given) <= got and len(got) == len(given) + 1
    names = paths.intern(tree)
    assert names.count() == len(set(NAMES)) + 2 and names.select("id").distinct().count() == names.count()


def test_deep_dangling_and_cyclic_paths(spark):
    chain = [(i, i - 1 if i else None, f"n{i}") for i in range(200)]
    deep = [(1000 + i, 999 + i if i else None, "d") for i in range(400)]
    rows = spark.createDataFrame([*chain, *deep, (5000, 4999, "lost"), (5001, 5000, "x"), (6000, 6001, "a"), (6001, 6000, "b")], "id long, parent_id long, name string")
    wanted = spark.createDataFrame([(199,), (1399,), (5001,), (6000,), (7,), (77777,)], "id long")
    got = {r["id"]: r["path"] for r in paths.resolve(rows, wanted).collect()}
    assert got[199] == "".join(f"/n{i}" for i in range(200)) and got[7] == "".join(f"/n{i}" for i in range(8))
    assert got[1399].count("/") == 256 and got[5001] == "/lost/x" and got[77777] == "" and got[6000].count("/") == 256


@pytest.mark.parametrize("given, want", [("/home/user/../user/docs", "/home/user/docs"), ("/../../a", "/a"), ("a//b/./c/", "/a/b/c"), ("/", None), ("", None), ("/..", None), ("/...", "/...")])
def test_normal_path(spark, given, want):
    assert one(spark, text.normal_path(F.lit(given))) == want


def test_owning_root_takes_the_longest_by_components(spark):
    rows = spark.createDataFrame([("/a/b/c",), ("/a/bc",), ("/x",)], "path string")
    roots = spark.createDataFrame([("/a",), ("/a/b",)], "root string")
    assert {r["path"]: r["root"] for r in paths.owning_root(rows, roots).collect()} == {"/a/b/c": "/a/b", "/a/bc": "/a", "/x": None}


def test_exclusion_rules_differ(spark):
    skip = F.array(F.lit(".git"), F.lit("target"))
    for path, watch, scan in (("/r/.git/x", True, True), ("/r/.gitignore", False, False), ("/r/a/target", True, False), ("/target/a/b", True, False)):
        assert one(spark, text.any_part(F.lit(path), skip)) is watch
        assert one(spark, text.any_directory(F.lit(path), skip)) is scan
    for a, b, want in ((True, True, "ignore"), (True, False, "arrival"), (False, True, "departure"), (False, False, "rename")):
        assert one(spark, cdc.rename_action(F.lit(a), F.lit(b))) == want


def test_null_parent_matches_null(spark):
    rows = spark.createDataFrame([(1, None, "a", None), (2, None, "a", 5), (3, 1, "a", 9), (4, 1, "a", 7)], "id long, parent_id long, name string, deleted_at long")
    assert sorted(ids(paths.child_of(rows, None, "a"))) == [1, 2]
    assert sorted(ids(paths.live_first(rows))) == [1, 3]


# --- vectors


def emb(spark, vectors_):
    rows = spark.createDataFrame(list(vectors_.items()), "file_id long, embedding array<float>")
    return rows.withColumn("bits", vectors.sign_bits(F.col("embedding"), len(next(iter(vectors_.values())))))


@pytest.mark.parametrize("v, want", [([1.0, -1.0, 0.0, -0.5], 0b0101), ([1.0] * 3, 0b111), ([float("nan"), -0.0], 0b10)])
def test_sign_bits(spark, v, want):
    assert one(spark, vectors.sign_bits(F.array(*map(F.lit, v)), len(v))) == [want]


def test_wide_vectors_take_more_words(spark):
    rng = random.Random(0)
    a, b = ([rng.uniform(-1, 1) for _ in range(130)] for _ in range(2))
    bits = [vectors.sign_bits(F.array(*map(F.lit, v)), 130) for v in (a, b)]
    assert one(spark, F.size(bits[0])) == 3 and vectors.bit_width(130) == 136
    assert one(spark, vectors.hamming(*bits)) == sum((x >= 0) != (y >= 0) for x, y in zip(a, b))


def test_rescoring_beats_bits(spark):
    stored = emb(spark, {1: [100.0] * 4, 2: [1.0, 1.0, 1.0, -0.01]})
    assert [r["file_id"] for r in knn.two_stage(stored, [1.0] * 4, 1).collect()] == [2]
    assert [r["file_id"] for r in knn.exact(stored, [1.0] * 4, 2).collect()] == [2, 1]


def test_search_filters_after_ranking(spark, store):
    events, meta, rich = store
    stored = emb(spark, {1: [0.0, 1.0], 2: [1.0, 0.1]})
    assert [r["file_id"] for r in search(stored, events, meta, rich, [1.0, 0.0], 1, doc_type="pdf").collect()] == [1]
    assert [r["file_id"] for r in search(stored, events, meta, rich, [1.0, 0.0], 1, before=True, doc_type="pdf").collect()] == [1]
    assert [(r["file_id"], r["id"]) for r in search(stored, events, meta, rich, [1.0, 0.0], 5).collect()] == [(2, 2), (1, 3)]
    assert knn.pool(20, True) == 100 and knn.pool(200, True) == 500 and knn.pool(7, False) == 7


def test_recall_by_blocks_equals_broadcast(spark):
    rng = random.Random(8)
    rows = emb(spark, {i: [rng.uniform(-1, 1) for _ in range(8)] for i in range(120)})
    asked = rows.where("file_id % 10 = 0").select(F.col("file_id").alias("query_id"), "embedding")
    plain, blocked = (sorted(tuple(r) for r in knn.recall(rows, asked, 5, 8, max_broadcast=m).collect()) for m in (100, 5))
    assert plain == blocked and len(plain) == 12 and all(r[2] == 5 for r in plain)


def test_recall_in_parts_and_tiles_equals_plain_ranks(spark, monkeypatch):
    """Several parts, blocks and tiles, with many copies and equal bits, against ranks over all pairs."""
    for name, n in (("MAX_BLOCK_VECTORS", 90), ("TILE_QUERIES", 4), ("TILE_VECTORS", 16)):
        monkeypatch.setattr(knn, name, n)
    rng = random.Random(9)
    vector = lambda: [rng.uniform(-1, 1) for _ in range(4)]
    some = {i: vector() if i % 3 else [0.5, -0.5, 0.25, 0.125] for i in range(400)}
    rows = emb(spark, some)
    asked = rows.where("file_id % 25 = 0").select(F.col("file_id").alias("query_id"), "embedding")
    kept = {r["file_id"]: (list(r["embedding"]), r["bits"][0]) for r in rows.collect()}

    def plain(q):
        far = {i: (math.dist(v, kept[q][0]), bin(b ^ kept[q][1]).count("1")) for i, (v, b) in kept.items()}
        best = sorted(far, key=lambda i: (far[i][0], i))[:5]
        first = sorted(far, key=lambda i: (far[i][1], i))[: 5 * schemas.HAMMING_OVERSAMPLE]
        return q, len(set(best) & set(sorted(first, key=lambda i: (far[i][0], i))[:5])), 5

    want = [plain(q) for q in range(0, 400, 25)]
    assert 0 < sum(h for _, h, _ in want) < 5 * len(want)
    assert sorted(tuple(r) for r in knn.recall(rows, asked, 5, 4, max_broadcast=7).collect()) == want


def test_recall_tasks_hold_bounded_parts(spark):
    """Pairs meet in tasks' matrices, none as a row of a join."""
    rows = emb(spark, {i: [1.0, -1.0] for i in range(10)})
    plan = knn.recall(rows, rows.select(F.col("file_id").alias("query_id"), "embedding"), 2, 2)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan and "FlatMapCoGroupsInArrow" in plan
    empty = rows.limit(0)
    assert knn.recall(empty, empty.select(F.col("file_id").alias("query_id"), "embedding"), 2, 2).count() == 0


def test_numbered_counts_over_ranges(spark):
    from tidemark.operators.numbering import numbered

    rows = spark.range(500).select((F.col("id") * 37 % 500).alias("v"))
    assert all(r["n"] == r["v"] + 1 for r in numbered(rows, F.col("v")).collect()) and numbered(rows.limit(0), F.col("v")).count() == 0


def test_config_and_width_are_checked(spark):
    config = spark.createDataFrame([(1, "m", 3)], schemas.EMBEDDING_CONFIG)
    knn.check_config(config, "m", 3)
    with pytest.raises(ValueError):
        knn.check_config(config, "m", 4)
    with pytest.raises(Exception, match="dimensions"):
        one(spark, vectors.checked(F.array(F.lit(1.0)), 3))


# --- change data

SNAP = "path string, size_bytes long, mtime_unix long"


def test_unchanged_snapshot_is_silent_and_deletes_are_optional(spark):
    a = spark.createDataFrame([("/a", 1, 1), ("/b", None, 1), ("/c", 1, 1)], SNAP)
    b = spark.createDataFrame([("/a", 1, 2), ("/b", None, 1), ("/d", 1, 1)], SNAP)
    assert cdc.diff(a, a).count() == 0
    assert {(r["path"], r["kind"]) for r in cdc.diff(a, b).collect()} == {("/a", "modified"), ("/d", "created")}
    assert {(r["path"], r["kind"]) for r in cdc.diff(a, b, deletes=True).collect()} == {("/a", "modified"), ("/d", "created"), ("/c", "deleted")}


def test_upsert_takes_live_then_newest_tombstone(spark):
    state = spark.createDataFrame([("/a", 1, 1, None), ("/a", 9, 9, 50), ("/b", 2, 2, 10), ("/b", 3, 3, 20), ("/c", 4, 4, None)], SNAP + ", deleted_at long")
    snap = spark.createDataFrame([("/a", 11, 11), ("/b", 22, 22), ("/n", 33, 33)], SNAP)
    got = sorted((tuple(r) for r in cdc.upsert(state, snap).collect()), key=str)
    assert got == sorted([("/a", 11, 11, None), ("/a", 9, 9, 50), ("/b", 2, 2, 10), ("/b", 22, 22, None), ("/c", 4, 4, None), ("/n", 33, 33, None)], key=str)
    after, gone = cdc.tombstoned(state, snap.select("path"), F.lit(99).cast("long"))
    assert [r["path"] for r in gone.collect()] == ["/a"] and after.where("deleted_at = 99").count() == 1


def test_rename_runs(spark):
    half = lambda i, source, t, tracker=1: (i, tracker, source, t)
    rows = [half(1, True, 0), half(2, False, 500), half(3, True, 900), half(4, True, 1000), half(5, False, 2000), half(6, False, 9000), half(7, False, 100, 2), half(8, True, 200, 2)]
    frame = spark.createDataFrame(rows, "id long, tracker long, is_source boolean, t long")
    assert {(r["from_id"], r["to_id"]) for r in cdc.paired(frame, 1000).collect()} == {(1, 2), (4, 5), (8, 7)}
    assert {(r["id"], r["change"]) for r in cdc.unpaired(frame, 1000).collect()} == {(3, "removed"), (6, "touched")}


# --- queues


def test_queue_life(spark):
    queue = spark.createDataFrame([(1, 100, 0), (2, 200, 4), (3, 50, 5)], schemas.QUEUE)
    assert [r["file_id"] for r in queues.pending(queue).collect()] == [1, 2]
    after = queues.record_attempt(queue, queues.pending(queue))
    assert {r["file_id"]: r["attempt_count"] for r in after.collect()} == {1: 1, 2: 5, 3: 5}
    again = queues.enqueue(after, spark.createDataFrame([(3,), (9,), (9,)], "file_id long"), 777)
    assert {tuple(r) for r in again.collect()} == {(1, 100, 1), (2, 200, 5), (3, 777, 5), (9, 777, 0)}
    assert {r["attempt_count"] for r in queues.enqueue(after, queue, 1, reset=True).collect()} == {0}
    assert queues.complete(again, queue).count() == 1


def test_requeue_is_stale_or_never(spark):
    meta = spark.createDataFrame([(1, 1), (2, 2)], "file_id long, extractor_version int")
    live = spark.createDataFrame([(1,), (2,), (3,), (4,)], "file_id long")
    queued = spark.createDataFrame([(4, 1, 0)], schemas.QUEUE)
    assert {tuple(r) for r in queues.to_requeue(meta, live, queued, 2).collect()} == {(1, "stale"), (3, "never")}


# --- scalars


@pytest.mark.parametrize("name, ext, kind", [("Makefile", None, "unknown"), (".gitignore", None, "unknown"), ("a.TXT", "txt", "text"), ("a.tar.gz", "gz", "unknown"), ("r.Docx", "docx", "docx"), ("x.", None, "unknown"), ("s.rs", "rs", "text")])
def test_extension(spark, name, ext, kind):
    assert one(spark, text.extension(F.lit(name))) == ext and one(spark, text.doc_type(F.lit(name))) == kind


@pytest.mark.parametrize("head, name, kind", [(b"%PDF-1", "a.txt", "pdf"), (b"\xff\xd8\xff\xe0", "a", "jpeg"), (b"II*\0", "a", "tiff"), (b"PK\3\4", "a.xlsx", "xlsx"), (b"PK\3\4", "a.zip", "unknown"), (b"hello", "a.md", "text")])
def test_sniff(spark, head, name, kind):
    assert one(spark, text.sniffed(F.lit(bytearray(head)), F.lit(name))) == kind


@pytest.mark.parametrize("n, a, b", [(0, "0 B", "0 B"), (1023, "1023 B", "1023 B"), (1024, "1.0 KiB", "1.0 KiB"), (10 * 1024, "10 KiB", "10.0 KiB"), (1_500_000, "1.4 MiB", "1.4 MiB"), (5 << 40, "5.0 TiB", "5.0 TiB"), (5000 << 40, "5000 TiB", "5000.0 TiB")])
def test_bytes(spark, n, a, b):
    assert (one(spark, text.bytes_label(F.lit(n))), one(spark, text.bytes_label_fixed(F.lit(n)))) == (a, b)


def test_bytes_halfway_go_to_the_even_decimal(spark):
    labels = [one(spark, text.bytes_label_fixed(F.lit(n))) for n in (12_544, 12_800, 12_672 << 10, 12_928 << 20, 1_234_567 << 30, -1)]
    assert labels == ["12.2 KiB", "12.5 KiB", "12.4 MiB", "12.6 GiB", "1205.6 TiB", "-1 B"]
    assert [one(spark, text.bytes_label(F.lit(n))) for n in (1_280, 9_472, 12_544)] == ["1.3 KiB", "9.3 KiB", "12 KiB"]


def test_times(spark):
    assert one(spark, clock.exif_seconds(F.lit("2024:02:03 04:05:06"))) == 1706933106
    assert one(spark, clock.exif_seconds(F.lit("2023:02:31 00:00:60"))) == one(spark, clock.exif_seconds(F.lit("2023:03:03 00:01:00")))
    assert one(spark, clock.exif_seconds(F.lit("2023:13:01 00:00:00"))) is None and one(spark, clock.exif_seconds(F.lit("never"))) is None
    assert one(spark, clock.hms(F.lit(-1))) == "23:59:59" and one(spark, clock.duration(F.lit(3661))) == "1h01m01s"
    now = 1_700_000_000_000
    for back, said in ((-5, "just now"), (59, "just now"), (60, "1 min ago"), (3600, "1 hour ago"), (7200, "2 hours ago"), (86400, "1 day ago"), (6 * 86400, "6 days ago"), (8 * 86400, "2023-11-06")):
        assert one(spark, clock.ago(F.lit(now - back * 1000), F.lit(now))) == said
    assert one(spark, clock.day_label(F.lit(now), F.lit(now + 86_400_000))) == "Yesterday"


def test_text_helpers(spark):
    assert one(spark, text.camera(F.lit("Canon"), F.lit("canon EOS"))) == "canon EOS"
    assert one(spark, text.camera(F.lit("Acme "), F.lit("X"))) == "Acme X" and one(spark, text.camera(F.lit(None).cast("string"), F.lit(" "))) is None
    assert one(spark, text.camera(F.lit("Acme"), F.lit(None).cast("string"))) == "Acme"
    assert one(spark, text.word_count(F.lit("a b 　c\n"))) == 3 and one(spark, text.cap(F.lit("é" * 9000), 8000)) == "é" * 8000
    assert one(spark, text.url_joined(F.lit("http://x/v1//"), F.lit("/embeddings"))) == "http://x/v1/embeddings"
    assert one(spark, text.valid_text(F.lit(bytearray(b"a\xff")))) == "a�"
    assert one(spark, text.directory(F.lit("/a/b"))) == "/a/" and one(spark, text.base_name(F.lit("/a/b"))) == "b"


# --- model endpoints


def chat(content):
    return F.lit(json.dumps({"choices": [{"message": {"content": content}}]}))


def test_replies(spark):
    good = one(spark, json_text.reply(json_text.chat_content(chat('Sure {"summary": "s", "keywords": ["k"]} ok'))))
    assert (good["summary"], good["keywords"], good["entities"], good["classification"]) == ("s", ["k"], [], "")
    for bad in ("no braces", '{"summary": 1, "keywords": "x"}', "{oops}"):
        assert one(spark, json_text.reply(json_text.chat_content(chat(bad)))) is None
    assert one(spark, json_text.chat_content(F.lit('{"choices": []}'))) is None
    assert one(spark, json_text.first_vector(F.lit('{"data": [{"embedding": [1, 2]}]}'))) == [1.0, 2.0]


def test_endpoint_failures_stay_in_their_row(spark):
    rows = spark.createDataFrame([(1, "fine text"), (2, "boom")], "file_id long, body_text string")

    def client(request):
        if "boom" in request:
            raise TimeoutError("slow")
        return endpoints.stub_chat(request)

    got = {r["file_id"]: r for r in endpoints.enrich(rows, client, "m", "p").collect()}
    assert got[1]["summary"] == "fine text" and got[1]["entities"] is None and got[2]["error"].startswith("TimeoutError")
    vectors_ = {r["file_id"]: r for r in endpoints.embed(rows, endpoints.stub_embedding, "m", 9).collect()}
    assert vectors_[1]["embedding"] is None and vectors_[1]["error"] == "vector of another width"


# --- documents


def test_office_documents(spark):
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>one</t></si><si><r><t>t</t></r><r><t>wo</t></r></si></sst>")
        for n in (1, 2, 10):
            z.writestr(f"xl/worksheets/sheet{n}.xml", f"<s><c t='s'><v>{n % 2}</v></c><c t='inlineStr'><is><t>in{n}</t></is></c><c><v>5</v></c></s>")
    rows = spark.createDataFrame([(1, "xlsx", bytearray(out.getvalue())), (2, "docx", bytearray(b"nonsense")), (3, "jpeg", bytearray(b"\xff\xd8\xff")), (4, "text", bytearray(b"x"))], "id long, doc_type string, content binary")
    got = {r["id"]: r for r in office.extract(rows).collect()}
    assert got[1]["page_count"] == 3 and got[1]["body_text"] == "two\nin1\none\nin10\none\nin2"
    assert got[2]["error"].startswith("BadZipFile") and got[3]["error"] is None and got[4]["body_text"] is None
    # The first bytes tell the type, whatever the name says; of a zip the name does.
    name = F.element_at(F.array(F.lit("a.xlsx"), F.lit("b.docx"), F.lit("c.pdf"), F.lit("d.md")), F.col("id").cast("int"))
    named = {r["id"]: r for r in office.extract_named(rows.select("id", name.alias("name"), "content")).collect()}
    assert [named[i]["doc_type"] for i in (1, 2, 3, 4)] == ["xlsx", "docx", "jpeg", "text"] and named[1]["page_count"] == 3 and named[2]["error"].startswith("BadZipFile")


def test_scan_of_a_directory(spark, tmp_path):
    for name in ("a/x.txt", "a/.git/config", "b/y +1.md", "target"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("hello")
    got = {r["path"].removeprefix(str(tmp_path)): r["size_bytes"] for r in files.scan(spark, str(tmp_path)).collect()}
    assert got == {"/a/x.txt": 5, "/b/y +1.md": 5, "/target": 5}
    assert files.scan(spark, str(tmp_path), max_entries=1).count() == 1
    assert bytes(files.heads(spark, str(tmp_path)).first()["head"]) == b"hello" and files.contents(spark, str(tmp_path)).count() == 3  # .git is hidden from Spark
    files.append(spark.range(2), str(tmp_path / "out"))
    files.append(spark.range(0), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_metrics_round_trip(spark):
    rows = spark.createDataFrame([("ready", "Is it.", "gauge", 1), ("events_total", "All.", "counter", 42)], "name string, help string, type string, value long")
    assert {tuple(r) for r in metrics.parsed(metrics.rendered(rows)).collect()} == {("tidemark_ready", 1.0), ("tidemark_events_total", 42.0)}
    assert metrics.parsed(spark.createDataFrame([("a b",), ("# x",), ("",)], "line string")).count() == 0


def test_log_tail(spark):
    rows = spark.range(300).withColumnRenamed("id", "n")
    assert [r["n"] for r in ev.tail(rows, ["n"], 3).collect()] == [297, 298, 299] and ev.tail(rows, ["n"]).count() == 200


def test_rename_over_a_file_and_out_of_sight(spark):
    state = spark.createDataFrame([(1, "/a", None), (2, "/b", None), (3, "/c", None), (4, "/d", 5)], "id long, path string, deleted_at long")
    renames = spark.createDataFrame([("/a", "/b"), ("/c", None), ("/d", "/e"), ("/nowhere", None)], "from_path string, to_path string")
    after, told = cdc.apply_renames(state, renames, F.lit(9).cast("long"))
    assert {tuple(r) for r in after.collect()} == {(1, "/b", None), (2, "/b", 9), (3, "/c", 9), (4, "/d", 5)}
    assert {tuple(r) for r in told.collect()} == {(1, "/b", "renamed", "/a"), (2, "/b", "deleted", None), (3, "/c", "deleted", None), (None, "/e", "created", None)}


def test_pdf_and_deadline():
    from tidemark.queries import _as_pdf

    got = office.extract_one("pdf", _as_pdf("one (two) \\ three\nfour"))
    assert got["body_text"] == "one (two) \\ three\nfour" and got["page_count"] == 1 and got["author"] == "Ada"
    assert office.extract_one("pdf", b"junk")["error"] == "ValueError: no PDF header"
    with pytest.raises(TimeoutError), office.deadline(0.05):
        while True:
            pass


def test_overflow_comes_first_and_once(spark, tmp_path):
    from tidemark.streaming import changes

    spark.createDataFrame([(1, "touched"), (2, "overflow"), (3, "overflow"), (4, "removed")], "id long, kind string").coalesce(1).write.parquet(str(tmp_path / "feed"))
    stream = spark.readStream.schema("id long, kind string").parquet(str(tmp_path / "feed"))
    seen = []
    changes.apply_batches(stream, lambda batch, n: seen.append((n, sorted(r["id"] for r in batch.collect()))), lambda n: seen.append((n, "rescan")))
    assert seen == [(0, "rescan"), (0, [1, 4])]


def test_few_wanted_ids_are_walked_up(spark):
    from tidemark.operators import paths

    files = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (4, 99, "lost"), (5, 6, "x"), (6, 5, "y"), (7, None, "z")], "id long, parent_id long, name string")
    wanted = spark.createDataFrame([(3,), (1,), (4,), (8,), (5,)], "id long")
    got = {r["id"]: r["path"] for r in paths.resolve(files, wanted, depth=8).collect()}
    assert got == {3: "/a/b/c", 1: "/a", 4: "/lost", 8: "", 5: "/y/x" * 4}
    found = {r["path"]: r["id"] for r in paths.lookup(files, spark.createDataFrame([(p,) for p in ("/a/b/c", "/a/b", "/z", "/b", "/a/c", "/", "/a/b/c/d")], "path string")).collect()}
    assert found == {"/a/b/c": 3, "/a/b": 2, "/z": 7, "/b": None, "/a/c": None, "/": None, "/a/b/c/d": None}


def test_trimmed_takes_all_white_space(spark):
    from tidemark.functions.text import trimmed

    rows = spark.createDataFrame([("\n\t a b   ",), ("\n",), ("",), (None,), ("x",)], "s string")
    assert [r[0] for r in rows.select(trimmed(F.col("s"))).collect()] == ["a b", None, None, None, "x"]


def test_repeated_new_keys_upsert_once(spark):
    from tidemark.operators.cdc import keep_newest

    old = spark.createDataFrame([(1, "old"), (2, "old")], "k long, v string")
    new = spark.createDataFrame([(1, "new"), (1, "new")], "k long, v string")
    assert sorted((r["k"], r["v"]) for r in keep_newest(old, new, "k").collect()) == [(1, "new"), (2, "old")]
