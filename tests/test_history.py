"""Renames, replays, orders and streams against plain Python, row by row."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cdc, numbering, paths, renames, replay
from tidemark.plans import metrics
from tidemark.queries import halves_joined
from tidemark.sources import files
from tidemark.streaming import changes, state, watch

MOVES = "seq long, from_path string, to_path string, at_ms long"


def sequential(state_rows, moves):
    """Renames one by one: events, and where each file ends."""
    at = {path: (id_, None) for id_, path, gone in state_rows if gone is None}
    where = {(id_, None): (path, gone) for id_, path, gone in state_rows}
    events = []
    for seq, source, to, ms in sorted(moves, key=lambda m: m[0]):
        if source is None or source == to:
            continue
        mover = at.get(source)
        if to is None:
            if mover:
                del at[source]
                where[mover] = (source, ms)
                events.append((seq, *mover, source, "deleted", None, ms))
        elif mover is None:
            if to not in at:
                at[to] = (None, seq)
                where[at[to]] = (to, None)
                events.append((seq, None, seq, to, "created", None, ms))
        else:
            if to in at:
                where[at[to]] = (to, ms)
                events.append((seq, *at[to], to, "deleted", None, ms))
            del at[source]
            at[to] = mover
            where[mover] = (to, None)
            events.append((seq, *mover, to, "renamed", source, ms))
    return Counter(events), Counter((*file, *end) for file, end in where.items())


def replays(spark, state_rows, moves):
    after, events = renames.applied(spark.createDataFrame(state_rows, "id long, path string, deleted_at long"), spark.createDataFrame(moves, MOVES))
    return Counter(map(tuple, events.collect())), Counter(map(tuple, after.collect()))


def test_renames_in_order_equal_a_sequential_replay(spark):
    rng = random.Random(8)
    names = [f"/{c}" for c in "abcdefgh"]
    rows = [(i, n, 5 if i % 4 == 3 else None) for i, n in enumerate(names)] + [(20, "/a", 3)]
    moves = [(seq, rng.choice([*names, None]), rng.choice([*names, "/new", None]), 100 + seq) for seq in range(200)]
    assert replays(spark, rows, moves) == sequential(rows, moves)


@pytest.mark.parametrize("moves", [[("a", "b"), ("b", "c")], [("b", "c"), ("a", "b")], [("a", "t"), ("b", "a"), ("t", "b")], [("a", "b"), ("b", "a")], [("a", "b"), ("b", None), ("x", "b"), ("b", "a")], [("a", "a"), (None, "a"), ("x", "y"), ("y", "z")]])
def test_chains_and_swaps(spark, moves):
    rows = [(1, "a", None), (2, "b", None), (3, "c", None)]
    given = [(n, *m, 10 * n) for n, m in enumerate(moves)]
    assert replays(spark, rows, given) == sequential(rows, given)


def test_one_file_renamed_a_thousand_times(spark):
    moves = [(n, f"/{n}", f"/{n + 1}", n) for n in range(1_000)]
    events, after = replays(spark, [(1, "/0", None)], moves)
    assert after == Counter([(1, None, "/1000", None)]) and len(events) == 1_000


def test_no_renames(spark):
    events, after = replays(spark, [(1, "/0", None)], [])
    assert after == Counter([(1, None, "/0", None)]) and not events


def test_replay_equals_row_by_row_and_splits_a_hot_file(spark):
    rng = random.Random(2)
    rows = [(n, 0 if n % 3 == 0 else rng.choice([1, 2, None]), rng.choice(["created", "deleted", "deleted", "modified", "renamed"]), n * 10, rng.choice([None, n])) for n in range(900)]
    rows += [(2_000, 9, "deleted", 5, 5), (2_001, 9, "deleted", 6, 6), (2_002, 8, "created", 7, 7), (2_003, 8, "deleted", 8, 8), (2_004, 8, "created", 9, 9)]
    rng.shuffle(rows)
    want = {}
    for _, file, kind, at, size in sorted(rows, key=lambda r: r[0]):
        s = want.setdefault(file, dict(state="absent", created=0, revived=0, modified=0, deleted=0, size=None, died=None, n=0))
        s["n"] += 1
        if kind == "deleted":
            if s["state"] == "live":
                s.update(state="dead", died=at, deleted=s["deleted"] + 1)
        else:
            did = {"absent": "created", "dead": "revived", "live": "modified"}[s["state"]]
            s.update(state="live", size=size, **{did: s[did] + 1})
    events = spark.createDataFrame(rows, "id long, file_id long, kind string, at_unix_ms long, size_bytes long")
    got = {r["file_id"]: r for r in replay.replayed(events).collect()}
    assert {f: (r["state"], r["created"], r["revived"], r["modified"], r["deleted"], r["size_bytes"], r["deleted_at"], r["n_events"]) for f, r in got.items()} == {
        f: (s["state"], s["created"], s["revived"], s["modified"], s["deleted"], s["size"], s["died"] if s["state"] == "dead" else None, s["n"]) for f, s in want.items()
    }
    assert got[8]["revived"] == 1 and got[9]["state"] == "absent"
    ranges = numbering.dealt(events, F.col("id")).where("file_id = 0").groupBy("_range").count().collect()
    assert len(ranges) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(r["count"] for r in ranges) < 150
    assert replay.replayed(events.limit(0)).count() == 0


def test_previous_row_and_islands_over_ranges(spark):
    rng = random.Random(4)
    rows = [(n, rng.choice(["a", "b", None]), rng.choice([1, 1, 1, 2, None])) for n in range(300)]
    df = spark.createDataFrame(rows, "n long, g string, v int").repartition(3)
    got = {r["n"]: r["p"] for r in numbering.previous(numbering.dealt(df, F.col("n")), ["g"], [F.col("n")], F.col("v"), "p").collect()}
    last, want = {}, {}
    for n, g, v in rows:
        want[n] = last.get(g)
        last[g] = v
    assert got == want
    stretch, number = {}, 0
    for k, (n, _, v) in enumerate(rows):
        number += k == 0 or v != rows[k - 1][2]
        stretch[n] = number
    assert {r["n"]: r["island"] for r in numbering.islands(df, F.col("v"), [F.col("n")]).collect()} == stretch
    assert numbering.islands(df.limit(0), F.col("v"), [F.col("n")]).count() == 0


def test_a_dictionary_keeps_its_ids(spark, tmp_path):
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    folder = f"file://{tmp_path}/dictionary"
    first = {r["name"]: r["id"] for r in paths.intern_into(folder, names("m", "c", "c", None), 0).collect()}
    assert first == {"c": 1, "m": 2}
    second = {r["name"]: r["id"] for r in paths.intern_into(folder, names("z", "a", "m"), 1).collect()}
    assert second == {"c": 1, "m": 2, "a": 3, "z": 4}
    again = {r["name"]: r["id"] for r in paths.intern_into(folder, names("z", "a", "m"), 1).collect()}
    assert again == second
    assert {r["name"]: r["id"] for r in paths.intern_into(folder, names(), 2).collect()} == second


def test_halves_without_a_tracker_never_pair(spark):
    rows = [(1, None, True, 0, "/a"), (2, None, False, 10, "/b"), (3, 7, True, 100, "/c"), (4, 7, False, 110, "/d")]
    halves = spark.createDataFrame(rows, "id long, tracker long, is_source boolean, t long, path string")
    assert [tuple(r) for r in cdc.paired(halves, 100).collect()] == [(7, 3, 4, 110)]
    assert sorted(tuple(r) for r in cdc.unpaired(halves, 100).collect()) == [(1, None, "removed"), (2, None, "touched")]
    timed = halves.withColumn("ts", F.timestamp_millis("t"))
    got = changes.fed(timed, "id", 2, 1, lambda s: changes.paired(s.select("id", "tracker", "is_source", "ts"), 100, "0 seconds"), "lone").collect()
    assert {tuple(r) for r in got if r["tracker"] is None} == {(None, 1, None, 0, "removed"), (None, None, 2, 10, "touched")}
    assert [tuple(r) for r in got if r["tracker"] == 7] == [(7, 3, 4, 110, "renamed")]


RAW = "id long, ms long, mode string, path string, to_path string, tracker long"


def test_watching_in_goes_equals_watching_at_once(spark):
    rng = random.Random(6)
    rows = []
    for n in range(400):
        mode = rng.choice(["touched", "removed", "access", "both", "from", "to", "from", "to"])
        rows.append((n, 50 * n + rng.randrange(50), mode, f"/{rng.randrange(6)}", f"/{rng.randrange(6)}" if mode == "both" else None, rng.choice([1, 2, None]) if mode in ("from", "to") else None))
    rows.append((400, 10_000_000, "access", "/end", None, None))
    raw = spark.createDataFrame(rows, RAW).withColumn("ts", F.timestamp_millis("ms")).drop("ms")
    want = Counter(map(tuple, watch.watched(raw, 120, 60).collect()))
    with watch.timers(spark):
        got = changes.fed(raw, "id", 3, 15, lambda s: watch.watch_stream(s, 120, 60, "3 seconds"), "watched")
        assert Counter(map(tuple, got.collect())) == want
    assert {c for _, _, _, c, _ in want} == {"touched", "removed", "renamed"}
    # Whatever is pending at a rename's source goes: none is told there within the quiet time after it.
    told = [t for t in want if t[3] == "renamed"]
    assert told and all(not any(p == source and at - 60 <= ms < at for p, ms, *_ in want) for _, at, _, _, source in told for at in [at])


def test_the_state_of_joined_halves_is_dropped(spark):
    raw = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    progress = []
    rows = changes.fed(raw, "event_id", 4, 5, halves_joined, "joined", progress)
    assert rows.count() > 0 and len(progress) == 4
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    # Of thirty days' halves those of three days and a gap stay.
    assert kept[-1] < 0.25 * raw.where("event_type = 'purchase'").count()


LOOKS = "path string, kind string, t long, id long, size_bytes long, mtime_unix long"


def test_a_stream_of_looks_keeps_the_state_of_a_merge(spark):
    rng = random.Random(9)
    table, state_now = state.StateTable(spark), spark.createDataFrame([], state.STATE)
    for number in range(3):
        rows = [(f"/{rng.randrange(8)}", "touched", n, n, *rng.choice([(None, None), (1, 1), (2, 1), (2, 2)])) for n in range(10 * number, 10 * number + 8)]
        batch = spark.createDataFrame(rows, LOOKS)
        last = {r[0]: r for r in sorted(rows, key=lambda r: (r[2], r[3]))}
        snapshot = spark.createDataFrame([(p, *r[4:]) for p, r in last.items() if r[4] is not None], "path string, size_bytes long, mtime_unix long")
        kinds = cdc.decide(spark.createDataFrame([(p,) for p in last], "path string"), state_now, snapshot)
        told = Counter((r["path"], r["kind"]) for r in kinds.collect())
        gone, news = kinds.where("kind = 'deleted'"), snapshot.join(kinds.where("kind <> 'deleted'"), "path", "left_semi")
        want = Counter(map(tuple, cdc.tombstoned(cdc.upsert(state_now, news), gone, F.lit(max(r[2] for r in rows)).cast("long"))[0].collect()))
        for _ in range(2):
            # The second time is a batch that runs again.
            state.merge_batch(table, batch, number)
            assert Counter(map(tuple, table.before(number + 1).collect())) == want
            assert Counter((r["path"], r["kind"]) for r in table.events().where(F.col("version") == number).collect()) == told
        state_now = spark.createDataFrame(list(want.elements()), state.STATE)
    assert Counter(map(tuple, table.latest().collect())) == want
    kept = spark.read.parquet(f"{table.root}/state").select("version").distinct().collect()
    assert sorted(r["version"] for r in kept) == [1, 2]


def test_an_overflow_scans_all_roots_once(spark):
    table, scans = state.StateTable(spark), []
    disk = {"/kept": (1, 1), "/changed": (9, 9), "/unseen": (4, 4)}

    def rescan():
        scans.append(1)
        return spark.createDataFrame([(p, *s) for p, s in disk.items()], "path string, size_bytes long, mtime_unix long")

    state.merge_batch(table, spark.createDataFrame([("/kept", "touched", 1, 1, 1, 1), ("/changed", "touched", 2, 2, 2, 2), ("/lost", "touched", 3, 3, 3, 3)], LOOKS), 0, rescan)
    assert not scans
    state.merge_batch(table, spark.createDataFrame([(None, "overflow", 10, 10, None, None), (None, "overflow", 11, 11, None, None), ("/changed", "touched", 10, 12, 5, 5)], LOOKS), 1, rescan)
    assert len(scans) == 1
    live = {r["path"]: (r["size_bytes"], r["mtime_unix"]) for r in table.before(2).where("deleted_at IS NULL").collect()}
    assert live == disk
    assert {(r["path"], r["kind"]) for r in table.events().where("version = 1").collect()} == {("/changed", "modified"), ("/unseen", "created"), ("/lost", "deleted")}


def test_small_repairs(spark, tmp_path):
    lines = spark.createDataFrame([("a 1.5",), ("b -3",), ("c 1e3",), ("# HELP a x",), ("d none",), ("e   7 1700000000",)], "line string")
    assert {r["name"]: r["value"] for r in metrics.parsed(lines).collect()} == {"a": 1.5, "b": -3.0, "c": 1000.0, "e": 7.0}
    given = spark.createDataFrame([("/r/a", 1), ("/r/a", 1), ("/x", 2), (None, 3)], "path string, n int")
    roots = spark.createDataFrame([("/r",), ("/r/a/b",)], "root string")
    assert Counter(map(tuple, paths.owning_root(given, roots).collect())) == Counter([("/r/a", 1, "/r"), ("/r/a", 1, "/r"), ("/x", 2, None), (None, 3, None)])
    (tmp_path / "small").write_bytes(b"abc")
    with open(tmp_path / "large", "wb") as f:
        f.truncate(2_200_000_000)
    assert {r["path"].rsplit("/", 1)[1]: r["head"] and bytes(r["head"]) for r in files.heads(spark, str(tmp_path)).collect()} == {"small": b"abc", "large": None}


def test_stream_state_is_kept_by_buckets_of_trackers(spark, tmp_path):
    """Pairing calls no more groups than buckets, and tells each tracker's halves apart within one."""
    from pyspark.sql import functions as F

    raw = spark.range(4_000).select("id", F.floor(F.col("id") / 4).alias("tracker"), (F.col("id") % 2 == 0).alias("is_source"), F.timestamp_millis(1_000 + F.col("id") % 4 * 30).alias("ts"))
    seen = []
    got = changes.fed(raw, "id", 1, 1, lambda s: changes.paired(s, 50, "0 seconds"), "buckets", seen).collect()
    assert sorted((r["tracker"], r["from_id"], r["to_id"]) for r in got) == sorted((n // 4, n, n + 1) for n in range(0, 4_000, 2)) and {r["change"] for r in got} == {"renamed"}
    plan = changes.paired(spark.readStream.schema(raw.schema).parquet(str(tmp_path)), 50, "0 seconds")._jdf.queryExecution().analyzed().toString()
    assert "bucket" in plan
