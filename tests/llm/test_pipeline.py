"""The pipeline against a brute-force version of every stage."""

import os
import re

import duckdb
import pandas as pd

import corpus_pipeline
from tests.llm.test_contracts import brute_components, brute_decontam, brute_fingerprint, rows_of
from tidemark.llm.queries import _MIX, QUERIES
from tidemark.sources.shared import shared_dir

SF = "/root/testdata/sf0.001"
MID = "/root/testdata/sf0.01"


def brute(sf):
    docs = [d for d in rows_of(sf, "documents") if any(c.isalpha() for c in d["text"] or "")]
    best = {}
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        best.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", d["text"]), d)
    docs = list(best.values())
    comp = brute_components([(d["doc_id"], brute_fingerprint(d["text"])) for d in docs])
    docs = [d for d in docs if comp[d["doc_id"]] == d["doc_id"]]
    hits = brute_decontam(docs, rows_of(sf, "benchmark"))
    docs = pd.DataFrame([d for d in docs if not hits[d["doc_id"]][4]])
    con = duckdb.connect()
    con.register("left_docs", docs)
    con.execute(f"CREATE VIEW labels AS SELECT * FROM '{sf}/labels.parquet'")
    sql = "WITH " + _MIX.format(docs="left_docs") + "SELECT doc_id, size, source_size, target, taken FROM mixed WHERE taken > 0"
    return {r[0]: r[1:] for r in con.execute(sql).fetchall()}


def test_pipeline_equals_brute_force(spark):
    rows = corpus_pipeline.run(spark, MID).collect()
    got = {r["doc_id"]: (r["size"], r["source_size"], r["target"], r["taken"]) for r in rows}
    assert len(got) == len(rows) and got == brute(MID)


def test_only_the_last_stage_stays(spark):
    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    rows = corpus_pipeline.run(spark, SF)
    left = set(os.listdir(shared_dir(spark).removeprefix("file:"))) - before
    assert rows.count() > 0 and len(left) == 1 and left.pop().startswith("stage-source_mixing")


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(3).unionByName(docs.limit(2).selectExpr("cast(null as bigint) doc_id", "cast(null as string) text", "cast(null as string) lang", "cast(null as string) source", "n_chars")).unionByName(docs.limit(3))
    for frame in (docs, odd, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, SF)
            assert out.columns[: len(docs.columns)] == docs.columns or set(docs.columns) <= set(out.columns), name
            assert out.count() <= frame.count()
            if name == "exact_dedup" and frame is odd:
                assert out.count() == 4


def test_registered(spark):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(QUERIES) | {"pipeline"} <= names
    assert {n.split("_")[0] for n in names if re.match(r"op\d", n)} == {f"op{i}" for i in range(1, 14)}
