"""Queries against brute force over the small given tables."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash

from tidemark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
MID = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def rows_of(sf, name):
    return duckdb.connect().execute(f"SELECT * FROM '{sf}/{name}.parquet'").fetchdf().to_dict("records")


def brute_decontam(docs, items, size=13):
    windows = defaultdict(set)
    for item in items:
        words = WORD.findall((item["text"] or "").translate(LOWER))
        n = min(size, len(words))
        for i in range(len(words) - n + 1) if n else []:
            windows[tuple(words[i : i + n])].add(str(item["item_id"]))
    lengths = {len(w) for w in windows}
    out = {}
    for doc in docs:
        words = WORD.findall((doc["text"] or "").translate(LOWER))
        hit, ids = set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                if (found := windows.get(tuple(words[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    ids |= found
        sha = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out[doc["doc_id"]] = (len(words), len(hit), len(ids), sha, bool(hit) and 20 * len(hit) >= len(words))
    return out


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=3):
    """prints: (id, fingerprint) pairs to {id: smallest id reachable}."""
    by_print = defaultdict(list)
    for i, p in prints:
        by_print[p].append(i)
    nodes = list(by_print)
    parent = {p: p for p in nodes}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for k, a in enumerate(nodes):
        for b in nodes[:k]:
            if (a ^ b).bit_count() <= radius:
                parent[find(a)] = find(b)
    least = {}
    for p in nodes:
        root = find(p)
        least[root] = min([least.get(root, 1 << 62), *by_print[p]])
    return {i: least[find(p)] for i, p in prints}


def test_decontamination_equals_brute_force(spark):
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in QUERIES["op2_decontamination"](spark, MID).collect()}
    want = brute_decontam(rows_of(MID, "documents"), rows_of(MID, "benchmark"))
    assert got == want
    assert any(r[4] for r in want.values()) and any(r[1] and not r[4] for r in want.values()) or any(r[4] for r in want.values())


def test_simhash_equals_brute_force(spark):
    docs = rows_of(MID, "documents")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op6_simhash"](spark, MID).collect()}
    prints = [(d["doc_id"], brute_fingerprint(d["text"])) for d in docs]
    components = brute_components(prints)
    assert got == {i: (f"{p:016x}", components[i]) for i, p in prints}
    assert len(set(components.values())) < len(prints)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    want = Counter(cursor.fetchall())
    assert Counter(tuple(r) for r in QUERIES[name](spark, SF).select(*columns).collect()) == want


def test_toxicity_on_held_out_labels(spark):
    labels = {r["doc_id"]: r["toxic"] for r in rows_of(MID, "labels")}
    rows = QUERIES["op5_toxicity"](spark, MID).collect()
    assert len(rows) == len(rows_of(MID, "documents")) and all(0 <= r["score"] <= 1 for r in rows)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    toxic, clean = [s for s, x in held if x], [s for s, x in held if not x]
    auc = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert auc > 0.75
    assert sum(s >= 0.7 for s in clean) <= 0.02 * len(clean)


def test_language_on_held_out_documents(spark):
    langs = {r["doc_id"]: r["lang"] for r in rows_of(MID, "documents")}
    rows = QUERIES["op10_language_id"](spark, MID).collect()
    held = [r["lang_pred"] == langs[r["doc_id"]] for r in rows if r["held_out"]]
    assert len(rows) == len(langs) and sum(held) > 0.95 * len(held)
