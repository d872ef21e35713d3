"""Registered queries of the file-history engine, by name; their SQL is in ``oracle``."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Callable
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import clock, json_text, text, vectors
from tidemark.operators import cdc, knn, language, paths, queues, renames, replay
from tidemark.operators import events as ev
from tidemark.oracle import ORACLE_SQL
from tidemark.plans import metrics, timeline
from tidemark.plans.search import search
from tidemark.sources import endpoints, files, office, roots, slices, tables, walk
from tidemark.sources.shared import shared_path, written
from tidemark.streaming import changes, watch
from tidemark.streaming import state as streamed_state

__all__ = ["ORACLE_SQL", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
GAP_MS = 6 * 3_600_000
GAP = "6 hours"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _timeline(name: str, **args) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return timeline.timeline(tables.events(spark, sf_dir), tables.metadata(spark, sf_dir), tables.enrichment(spark, sf_dir), **args)

    run.__name__ = name
    query(run)


_timeline("tl_default")
_timeline("tl_all_filters", limit=500, before_id=9_000, kind="modified", doc_type="pdf", author="src1", language="en", classification="good")
_timeline("tl_kind", kind="created")
_timeline("tl_doc_type", doc_type="docx")
_timeline("tl_author", author="src3")
_timeline("tl_language", language="de")
_timeline("tl_classification", classification="good")
_timeline("tl_before_id", before_id=500)
_timeline("tl_null_metadata_excluded", limit=500, doc_type="text")
_timeline("tl_limit_clamp_zero", limit=0)
_timeline("tl_limit_clamp_huge", limit=100_000)


def _with_branch(metadata: DataFrame) -> DataFrame:
    return metadata.withColumn("git_branch", F.when(F.col("file_id") % 2 == 0, "main").otherwise("dev"))


def _customer_events(spark, sf_dir):
    return tables.events(spark, sf_dir).withColumn("file_id", F.col("file_id") + 1_000_001)


@query
def tl_git_branch(spark, sf_dir):
    facts = _with_branch(tables.metadata(spark, sf_dir)).drop("body_text")
    return timeline.timeline(tables.events(spark, sf_dir), facts, tables.enrichment(spark, sf_dir), git_branch="main")


@query
def tl_paths(spark, sf_dir):
    page = timeline.timeline(_customer_events(spark, sf_dir), tables.metadata(spark, sf_dir), tables.enrichment(spark, sf_dir), files=tables.nation_tree(spark, sf_dir))
    return page.select("id", "file_id", "kind", "at_unix_ms", "path")


@query
def tl_page2(spark, sf_dir):
    return timeline.page_after(tables.events(spark, sf_dir), 50, 2)


@query
def tl_cursor(spark, sf_dir):
    return timeline.next_before_id(tables.events(spark, sf_dir).orderBy(F.desc("at_unix_ms"), F.desc("id")).limit(schemas.clamp(None)))


@query
def tl_json_rows(spark, sf_dir):
    rows = tables.events(spark, sf_dir).join(tables.metadata(spark, sf_dir).select("file_id", "doc_type", "language"), "file_id", "left")
    return timeline.json_rows(rows)


@query
def rename_previous_path(spark, sf_dir):
    renamed = F.col("kind") == "renamed"
    rows = _customer_events(spark, sf_dir).withColumns({"prev_parent_id": F.when(renamed, F.col("id") % 25 + 1000), "prev_component_id": F.when(renamed, F.col("id") % 5)})
    tree = tables.nation_tree(spark, sf_dir)
    return timeline.with_previous_path(rows, paths.resolve(tree), tree.select("id", "name"))


def _facet(field: str, source: Callable) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ev.facet_counts(source(spark, sf_dir), field)

    run.__name__ = f"facet_{field}"
    query(run)


for _field in ("doc_type", "author", "language"):
    _facet(_field, tables.metadata)
_facet("classification", tables.enrichment)
_facet("git_branch", lambda spark, sf_dir: _with_branch(tables.metadata(spark, sf_dir)))


def _files(spark, sf_dir):
    """Page tree as files: leaves without children are files; every tenth is deleted."""
    tree = tables.page_tree(spark, sf_dir)
    parents = tree.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("id"), F.lit(True).alias("is_dir")).distinct()
    gone = F.when(F.length("path") % 10 == 0, F.lit(1_000))
    return tree.join(parents, "id", "left").select("id", "parent_id", "name", "path", F.coalesce("is_dir", F.lit(False)).alias("is_dir"), gone.cast("long").alias("deleted_at"))


@query
def agg_stats(spark, sf_dir):
    return metrics.stats(tables.events(spark, sf_dir), _files(spark, sf_dir), tables.queue(spark, sf_dir))


@query
def agg_schema_version(spark, sf_dir):
    applied = tables.events(spark, sf_dir).select((F.col("id") % 5 + 1).cast("int").alias("version"))
    return applied.agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"))


@query
def agg_scan_summary(spark, sf_dir):
    found = cdc.diff(tables.snapshot(spark, sf_dir, False), tables.snapshot(spark, sf_dir, True)).select("path", "kind")
    files = tables.snapshot(spark, sf_dir, True).join(found, "path", "left").select(F.lit(False).alias("is_dir"), "kind", (F.col("doc_id") % 11 == 0).alias("skipped"))
    prefixes = F.array(F.substring_index("path", "/", 2), F.substring_index("path", "/", 3))
    folders = tables.snapshot(spark, sf_dir, True).select(F.explode(prefixes).alias("path")).distinct().select(F.lit(True).alias("is_dir"), F.lit(None).cast("string").alias("kind"), F.lit(False).alias("skipped"))
    return ev.scan_summary(files.unionByName(folders))


def _now(spark, sf_dir):
    return F.lit(tables.events(spark, sf_dir).agg(F.max("at_unix_ms")).first()[0] or 0)


@query
def agg_by_day(spark, sf_dir):
    return ev.by_day(tables.events(spark, sf_dir), _now(spark, sf_dir)).select(F.col("day").cast("string").alias("day"), "n", F.when(F.col("label").isin("Today", "Yesterday"), F.col("label")).otherwise("earlier").alias("label"))


@query
def latest_per_file(spark, sf_dir):
    return ev.latest_per_file(tables.events(spark, sf_dir))


@query
def latest_for_ids_ordered(spark, sf_dir):
    ranked = tables.table(spark, sf_dir, "customer").where("c_custkey % 7 = 0").select(F.col("c_custkey").cast("long").alias("file_id"), (F.lit(10_000_000) - F.col("c_custkey")).alias("rank"))
    return ev.latest_ranked(tables.events(spark, sf_dir), ranked)


@query
def orphan_events(spark, sf_dir):
    known = tables.table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("file_id"))
    return tables.events(spark, sf_dir).join(known, "file_id", "left_anti").select("id", "file_id")


@query
def orphan_metadata(spark, sf_dir):
    return tables.metadata(spark, sf_dir).select("file_id").join(tables.events(spark, sf_dir), "file_id", "left_anti")


@query
def orphan_enrichment(spark, sf_dir):
    return tables.enrichment(spark, sf_dir).select("file_id").join(tables.events(spark, sf_dir), "file_id", "left_anti")


@query
def page_merge_new(spark, sf_dir):
    rows = tables.events(spark, sf_dir)
    return ev.merged_page(rows.where("id % 3 = 0"), rows.where("id % 2 = 0"))


@query
def path_resolve(spark, sf_dir):
    return paths.resolve(tables.nation_tree(spark, sf_dir))


@query
def path_resolve_pages(spark, sf_dir):
    tree = tables.page_tree(spark, sf_dir)
    return paths.resolve(tree.select("id", "parent_id", "name")).select("path")


@query
def path_lookup(spark, sf_dir):
    """Every path of the tree from the root down, and one below each that is not there."""
    tree = tables.nation_tree(spark, sf_dir)
    known = paths.resolve(tree).select("path")
    return paths.lookup(tree, known.unionByName(known.select(F.concat("path", F.lit("/none")).alias("path"))))


@query
def path_children(spark, sf_dir):
    name = tables.table(spark, sf_dir, "region").agg(F.min("r_name")).first()[0]
    return paths.child_of(tables.nation_tree(spark, sf_dir), None, name)


@query
def path_intern(spark, sf_dir):
    return paths.intern(tables.page_tree(spark, sf_dir))


@query
def path_component_names(spark, sf_dir):
    names = paths.intern(tables.page_tree(spark, sf_dir))
    asked = tables.page_paths(spark, sf_dir).select("page_id", F.get(F.split("path", "/"), F.lit(1)).alias("name"))
    return asked.join(names, "name").select("page_id", F.col("id").alias("component_id"), "name")


@query
def path_normalise(spark, sf_dir):
    odd = F.concat("path", F.lit("/./a//../"), F.when(F.col("page_id") % 3 == 0, "../../../../x").otherwise("b"))
    return tables.page_paths(spark, sf_dir).select("page_id", text.normal_path(odd).alias("path"))


@query
def path_split(spark, sf_dir):
    return tables.page_paths(spark, sf_dir).select("page_id", text.directory(F.col("path")).alias("dir"), text.base_name(F.col("path")).alias("name"))


@query
def path_join(spark, sf_dir):
    return tables.page_paths(spark, sf_dir).select("page_id", text.joined(F.filter(F.split("path", "/"), lambda p: p != "")).alias("path"))


@query
def path_ensure_chain(spark, sf_dir):
    rows = tables.page_paths(spark, sf_dir)
    return paths.missing_chain(rows.select("path"), paths.tree_of(rows.where("page_id % 2 = 0").select("path"))).select("path", "name")


@query
def path_owning_root(spark, sf_dir):
    rows = tables.page_paths(spark, sf_dir)
    roots = rows.where("page_id % 5 = 0").select(F.explode(F.slice(paths.prefixes(F.col("path")), 1, 2)).alias("root")).distinct()
    return paths.owning_root(rows, roots)


@query
def path_excluded_watch(spark, sf_dir):
    return tables.page_paths(spark, sf_dir).select("page_id", text.any_part(F.col("path"), F.array(F.lit("en"), F.lit("de"))).alias("excluded"))


@query
def path_excluded_scan(spark, sf_dir):
    return tables.page_paths(spark, sf_dir).select("page_id", text.any_directory(F.col("path"), F.array(F.lit("en"), F.lit("de"))).alias("excluded"))


@query
def path_lookup_live_first(spark, sf_dir):
    gone = F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") * 10)
    rows = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 50).alias("parent_id"), F.col("source").alias("name"), gone.alias("deleted_at"))
    return paths.live_first(rows)


def _query_vector(spark, sf_dir):
    return tables.table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0]


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("distance", F.round("distance", 6))


@query
def knn_two_stage(spark, sf_dir):
    return _rounded(knn.two_stage(tables.embeddings(spark, sf_dir), _query_vector(spark, sf_dir), 10))


@query
def knn_exact(spark, sf_dir):
    return _rounded(knn.exact(tables.embeddings(spark, sf_dir), _query_vector(spark, sf_dir), 10))


@query
def knn_faceted(spark, sf_dir):
    found = search(tables.embeddings(spark, sf_dir), tables.events(spark, sf_dir), tables.metadata(spark, sf_dir).drop("body_text"), tables.enrichment(spark, sf_dir), _query_vector(spark, sf_dir), 20, language="en")
    return _rounded(found).select("file_id", "id", "kind", "doc_type", "language", "distance")


@query
def knn_faceted_exact(spark, sf_dir):
    found = search(tables.embeddings(spark, sf_dir), tables.events(spark, sf_dir), tables.metadata(spark, sf_dir).drop("body_text"), tables.enrichment(spark, sf_dir), _query_vector(spark, sf_dir), 20, before=True, language="en")
    return _rounded(found).select("file_id", "id", "language", "distance")


@query
def knn_recall(spark, sf_dir):
    stored = tables.embeddings(spark, sf_dir)
    return knn.recall(stored, stored.where("file_id % 50 = 0").select(F.col("file_id").alias("query_id"), "embedding"), 10, 64)


@query
def vec_bits(spark, sf_dir):
    word = F.col("bits")[0]
    low = word.bitwiseAND(F.lit(0xFFFFFFFF))
    return tables.embeddings(spark, sf_dir).select("file_id", low.alias("low"), F.shiftrightunsigned(word, 32).alias("high"))


@query
def vec_hamming(spark, sf_dir):
    bits = vectors.sign_bits(F.array(*[F.lit(float(x)) for x in _query_vector(spark, sf_dir)]), 64)
    return tables.embeddings(spark, sf_dir).select("file_id", vectors.hamming(F.col("bits"), bits).alias("hamming"))


@query
def vec_l2(spark, sf_dir):
    asked = F.array(*[F.lit(float(x)) for x in _query_vector(spark, sf_dir)]).cast("array<float>")
    return tables.embeddings(spark, sf_dir).select("file_id", F.round(vectors.euclidean(vectors.checked(F.col("embedding"), 64), asked), 6).alias("distance"))


@query
def cdc_snapshot_diff(spark, sf_dir):
    return cdc.diff(tables.snapshot(spark, sf_dir, False), tables.snapshot(spark, sf_dir, True))


@query
def cdc_with_deletes(spark, sf_dir):
    return cdc.diff(tables.snapshot(spark, sf_dir, False), tables.snapshot(spark, sf_dir, True), deletes=True)


def _state(spark, sf_dir):
    gone = F.when(F.col("doc_id") % 4 == 0, F.col("doc_id") * 100)
    return tables.snapshot(spark, sf_dir, False).withColumn("deleted_at", gone).select("path", "size_bytes", "mtime_unix", "deleted_at")


@query
def cdc_upsert_state(spark, sf_dir):
    return cdc.upsert(_state(spark, sf_dir), tables.snapshot(spark, sf_dir, True))


@query
def cdc_tombstones(spark, sf_dir):
    old, new = _state(spark, sf_dir), tables.snapshot(spark, sf_dir, True)
    return cdc.tombstoned(old, old.join(new, "path", "left_anti"), F.lit(5_000).cast("long"))[1]


@query
def cdc_tombstone_state(spark, sf_dir):
    old, new = _state(spark, sf_dir), tables.snapshot(spark, sf_dir, True)
    return cdc.tombstoned(old, old.join(new, "path", "left_anti"), F.lit(5_000).cast("long"))[0]


@query
def cdc_state_fold(spark, sf_dir):
    return cdc.fold(tables.events(spark, sf_dir))


@query
def change_decide(spark, sf_dir):
    touched = tables.table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    return cdc.decide(touched, _state(spark, sf_dir), tables.snapshot(spark, sf_dir, True))


def _rename_batch(spark, sf_dir):
    """Files /f/<id>, of which some are renamed to their neighbours, to new names or out of sight."""
    docs = tables.table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/f/"), F.col("doc_id").cast("string"))
    state = docs.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("id"), path.alias("path"), F.when(F.col("doc_id") % 11 == 0, F.lit(1).cast("long")).alias("deleted_at"))
    to = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("/f/"), (F.col("doc_id") + 1).cast("string"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("/g/"), F.col("doc_id").cast("string")))
    renames = docs.where("doc_id % 4 IN (0, 2) OR doc_id % 12 = 3").select(path.alias("from_path"), to.alias("to_path"))
    return state, renames


@query
def rename_apply(spark, sf_dir):
    return cdc.apply_renames(*_rename_batch(spark, sf_dir), F.lit(99).cast("long"))[0]


@query
def rename_apply_events(spark, sf_dir):
    return cdc.apply_renames(*_rename_batch(spark, sf_dir), F.lit(99).cast("long"))[1]


@query
def rename_supersedes(spark, sf_dir):
    state, renames = _rename_batch(spark, sf_dir)
    return cdc.not_superseded(state.select("id", "path"), renames)


@query
def queue_pending(spark, sf_dir):
    return queues.pending(tables.queue(spark, sf_dir))


def _new_ids(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").where("doc_id % 10 IN (0, 3)").select(F.col("doc_id").alias("file_id"))


@query
def queue_enqueue(spark, sf_dir):
    return queues.enqueue(tables.queue(spark, sf_dir).where("file_id % 5 <> 0"), _new_ids(spark, sf_dir), 20_000)


@query
def queue_record_attempt(spark, sf_dir):
    rows = tables.queue(spark, sf_dir)
    return queues.record_attempt(rows, queues.pending(rows))


@query
def queue_complete(spark, sf_dir):
    done = tables.metadata(spark, sf_dir).where("extractor_version = 2").select("file_id")
    return queues.complete(tables.queue(spark, sf_dir), done)


@query
def queue_drain(spark, sf_dir):
    def work(rows: DataFrame) -> DataFrame:
        return rows.select("file_id", F.when(F.col("word_count") % 3 == 0, "unreadable").alias("error"))

    return queues.drain_step(tables.queue(spark, sf_dir), tables.metadata(spark, sf_dir).select("file_id", "word_count"), work)[1]


def _half_queue(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").where("doc_id % 15 = 0").select(F.col("doc_id").alias("file_id"), F.lit(1).cast("long").alias("queued_at_unix"), F.lit(3).alias("attempt_count"))


@query
def queue_requeue_stale(spark, sf_dir):
    live = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"))
    return queues.to_requeue(tables.metadata(spark, sf_dir).where("file_id % 5 <> 0"), live, _half_queue(spark, sf_dir), 2)


@query
def queue_requeued(spark, sf_dir):
    return queues.enqueue(_half_queue(spark, sf_dir), queue_requeue_stale(spark, sf_dir), 30_000, reset=True)


@query
def queue_requeue_enrichment(spark, sf_dir):
    return queues.stale_enrichment(tables.enrichment(spark, sf_dir), 2)


@query
def queue_gate(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").where(queues.wants_model(True, text.cap(F.col("text")))).select("doc_id")


@query
def queue_depth(spark, sf_dir):
    return tables.queue(spark, sf_dir).agg(F.count("*").alias("depth"))


@query
def upsert_metadata(spark, sf_dir):
    old = tables.metadata(spark, sf_dir).select("file_id", "doc_type", "extractor_version")
    new = tables.table(spark, sf_dir, "documents").where("doc_id % 4 = 0").select(F.col("doc_id").alias("file_id"), F.lit("pdf").alias("doc_type"), F.lit(3).alias("extractor_version"))
    return cdc.keep_newest(old, new, "file_id")


@query
def upsert_enrichment(spark, sf_dir):
    new = tables.table(spark, sf_dir, "documents").where("doc_id % 4 = 0").select(F.col("doc_id").alias("file_id"), F.lit("reviewed").alias("classification"), F.lit(9).alias("enrichment_version"))
    return cdc.keep_newest(tables.enrichment(spark, sf_dir), new, "file_id")


@query
def vec_bit_width(spark, sf_dir):
    cut = F.slice("embedding", F.lit(1), F.size("embedding") - (F.col("vec_id") % 13).cast("int"))
    rows = tables.table(spark, sf_dir, "embeddings").select("vec_id", cut.alias("v"))
    hexed = F.array_join(F.transform(vectors.sign_bytes(F.col("v")), lambda b: F.lpad(F.hex(b), 2, "0")), "")
    return rows.select("vec_id", F.size("v").alias("dimensions"), vectors.bit_width(F.size("v")).alias("bit_dimensions"), hexed.alias("packed"))


@query
def vec_checked(spark, sf_dir):
    vectors_ = tables.table(spark, sf_dir, "embeddings")
    return vectors_.select(F.col("vec_id").alias("file_id"), F.size(vectors.checked(F.col("embedding"), 64)).alias("width"))


@query
def knn_config(spark, sf_dir):
    """The stored model and width, which the given ones must equal."""
    config = tables.table(spark, sf_dir, "embeddings").agg(F.lit(1).alias("id"), F.lit("given").alias("model"), F.max(F.size("embedding")).alias("dimensions"))
    knn.check_config(config, "given", 64)
    return config


@query
def json_chat_request(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id", F.md5(json_text.chat_request("m", "Describe.", F.col("text")).cast("binary")).alias("md5"))


@query
def fn_valid_text(spark, sf_dir):
    raw = F.concat(F.col("lang").cast("binary"), F.unhex(F.lit("FF")), F.col("source").cast("binary"))
    return tables.table(spark, sf_dir, "documents").select("doc_id", text.valid_text(raw).alias("text"))


@query
def fn_word_count(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"))


@query
def fn_trimmed(spark, sf_dir):
    """Texts between white space of several kinds, every eleventh made of nothing else."""
    inner = F.when(F.col("doc_id") % 11 > 0, F.col("text")).otherwise(F.lit("\u3000"))
    padded = F.concat(F.lit("\n\t\u2003"), inner, F.lit("\u00a0\x0b \r"))
    return tables.table(spark, sf_dir, "documents").select("doc_id", text.trimmed(padded).alias("trimmed"))


@query
def fn_cap_body(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id", F.md5(text.cap(F.col("text")).cast("binary")).alias("md5"))


def _file_names(spark, sf_dir):
    endings = F.array(*[F.lit(e) for e in ("txt", "PDF", "docx", "XLSX", "pptx", "jpg", "html", "gz")])
    name = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 9 == 8, "").otherwise(F.concat(F.lit("."), F.element_at(endings, (F.col("doc_id") % 8 + 1).cast("int")))))
    name = F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("."), "source")).otherwise(name)
    return tables.table(spark, sf_dir, "documents").select("doc_id", name.alias("name"), "text")


@query
def fn_extension(spark, sf_dir):
    return _file_names(spark, sf_dir).select("doc_id", "name", text.extension(F.col("name")).alias("extension"))


@query
def fn_doc_type(spark, sf_dir):
    return _file_names(spark, sf_dir).select("doc_id", text.doc_type(F.col("name")).alias("doc_type"))


@query
def fn_sniff(spark, sf_dir):
    magic = F.array(*[F.unhex(F.lit(m)) for m in ("25504446", "FFD8FF", "49492A00", "504B0304", "00")])
    head = F.concat(F.element_at(magic, (F.col("doc_id") % 5 + 1).cast("int")), F.coalesce("text", F.lit("")).cast("binary"))
    return _file_names(spark, sf_dir).select("doc_id", text.sniffed(F.substring(head, 1, schemas.SNIFF_BYTES), F.col("name")).alias("doc_type"))


@query
def fn_camera_model(spark, sf_dir):
    make = F.when(F.col("p_partkey") % 5 > 0, F.substring_index("p_name", " ", 1))
    model = F.when(F.col("p_partkey") % 7 > 0, F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat(F.lit(" X"), F.col("p_partkey").cast("string"), F.lit(" "))))
    return tables.table(spark, sf_dir, "part").select("p_partkey", text.camera(make, model).alias("camera"))


@query
def fn_civil_to_unix(spark, sf_dir):
    n = F.col("id")
    stamp = F.format_string("%04d:%02d:%02d %02d:%02d:%02d", (1950 + n % 150).cast("int"), (1 + n % 12).cast("int"), (1 + n % 31).cast("int"), (n % 24).cast("int"), (n % 60).cast("int"), (n % 61).cast("int"))
    return tables.events(spark, sf_dir).select("id", clock.exif_seconds(stamp).alias("seconds"))


@query
def fn_format_bytes(spark, sf_dir):
    n = (F.col("n_chars") * F.col("n_chars") * F.col("n_chars") * (F.col("doc_id") % 5)).cast("long")
    return tables.table(spark, sf_dir, "documents").select("doc_id", text.bytes_label(n).alias("label"), text.bytes_label_fixed(n).alias("fixed"))


@query
def fn_relative_time(spark, sf_dir):
    return tables.events(spark, sf_dir).select("id", clock.ago(F.col("at_unix_ms"), _now(spark, sf_dir)).alias("ago"))


@query
def fn_hms(spark, sf_dir):
    shifted = F.col("at_unix_ms") - F.when(F.col("id") % 2 == 0, F.lit(4_000_000_000_123)).otherwise(F.lit(0))
    return tables.events(spark, sf_dir).select("id", clock.hms(shifted).alias("hms"))


@query
def fn_duration(spark, sf_dir):
    return tables.events(spark, sf_dir).select("id", clock.duration(F.col("id") * 37).alias("duration"))


@query
def fn_url_join(spark, sf_dir):
    return tables.table(spark, sf_dir, "pages").select("page_id", text.url_joined(F.concat("url", F.lit("//")), F.lit("/chat/completions")).alias("url"))


@query
def detect_language(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents")
    return language.detected(docs, language.profiles(docs))


@query
def language_profiles(spark, sf_dir):
    return language.profiles(tables.table(spark, sf_dir, "documents"))


def _chat_bodies(spark, sf_dir):
    said = F.to_json(F.struct(F.col("text").alias("summary"), F.when(F.col("turn") % 2 == 0, F.array("role")).alias("keywords"), F.col("role").alias("classification")))
    content = F.when(F.col("conv_id") % 9 == 0, F.col("text")).otherwise(F.concat(F.lit("Sure: "), said, F.lit(" done")))
    choices = F.when(F.col("conv_id") % 11 == 0, F.array().cast("array<struct<message:struct<content:string>>>")).otherwise(F.array(F.struct(F.struct(content.alias("content")).alias("message"))))
    return tables.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct(choices.alias("choices"))).alias("body"))


@query
def json_chat_reply(spark, sf_dir):
    got = json_text.reply(json_text.chat_content(F.col("body")))
    return _chat_bodies(spark, sf_dir).select("conv_id", "turn", got.alias("r")).select("conv_id", "turn", F.col("r.summary").alias("summary"), F.size("r.keywords").alias("n_keywords"), F.col("r.classification").alias("classification"))


@query
def json_embedding_reply(spark, sf_dir):
    body = F.to_json(F.struct(F.array(F.struct("embedding")).alias("data")))
    got = tables.table(spark, sf_dir, "embeddings").select("vec_id", json_text.first_vector(body).alias("v"))
    return got.select("vec_id", F.size("v").alias("width"), F.round(F.col("v")[0].cast("double"), 6).alias("first"))


@query
def json_list_or_null(spark, sf_dir):
    items = F.filter(F.array("lang", F.when(F.col("doc_id") % 2 == 0, F.col("source"))), lambda x: x.isNotNull() & (x != "en"))
    return tables.table(spark, sf_dir, "documents").select("doc_id", json_text.list_or_null(items).alias("items"))


def _metric_rows(spark, sf_dir):
    counts = tables.events(spark, sf_dir).groupBy(F.concat(F.col("kind"), F.lit("_total")).alias("name")).agg(F.count("*").alias("value"))
    return counts.select("name", F.lit("Events of a kind.").alias("help"), F.lit("counter").alias("type"), "value")


@query
def metrics_render(spark, sf_dir):
    return metrics.rendered(_metric_rows(spark, sf_dir))


@query
def metrics_parse(spark, sf_dir):
    return metrics.parsed(metrics.rendered(_metric_rows(spark, sf_dir)))


@query
def log_tail(spark, sf_dir):
    return ev.tail(tables.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"])


def _raw_changes(spark, sf_dir):
    return tables.events(spark, sf_dir).select("id", "file_id", "kind", F.timestamp_millis("at_unix_ms").alias("ts"))


@query
def debounce_batch(spark, sf_dir):
    rows = _raw_changes(spark, sf_dir).withColumn("kind", cdc.raw_kind(F.col("kind"))).where("kind IS NOT NULL")
    return cdc.coalesced(rows, GAP)


@query
def rename_pairs(spark, sf_dir):
    return cdc.paired(tables.rename_halves(spark, sf_dir), GAP_MS)


@query
def rename_unpaired(spark, sf_dir):
    return cdc.unpaired(tables.rename_halves(spark, sf_dir), GAP_MS)


@query
def rename_exclusion_matrix(spark, sf_dir):
    rows = tables.page_paths(spark, sf_dir)
    moved = rows.select("page_id", "path", F.regexp_replace("path", "/(en|fr)/", "/de/").alias("to"))
    skip = F.array(F.lit("de"), F.lit("es"))
    return moved.select("page_id", cdc.rename_action(text.any_part(F.col("path"), skip), text.any_part(F.col("to"), skip)).alias("action"))


@query
def stream_append(spark, sf_dir):
    return changes.append_batches(changes.event_stream(spark, sf_dir)).select("id", "file_id", "kind")


@query
def stream_dedupe(spark, sf_dir):
    rows = changes.event_stream(spark, sf_dir)
    return changes.drained(changes.deduplicated(rows, ["file_id", "kind"], "3650 days"), "dedupe").select("file_id", "kind")


@query
def stream_debounce(spark, sf_dir):
    return changes.drained(changes.debounced(changes.event_stream(spark, sf_dir), GAP, "0 seconds"), "debounce")


def _streamed_halves(spark, sf_dir):
    halves = changes.event_stream(spark, sf_dir).where("kind = 'purchase'").select("id", F.col("file_id").alias("tracker"), (F.col("id") % 2 == 0).alias("is_source"), "ts")
    return changes.drained(changes.paired(halves, GAP_MS, "0 seconds"), "renames")


@query
def stream_rename(spark, sf_dir):
    return _streamed_halves(spark, sf_dir).where("change = 'renamed'").drop("change")


@query
def stream_rename_unpaired(spark, sf_dir):
    return _streamed_halves(spark, sf_dir).where("change <> 'renamed'").select(F.coalesce("from_id", "to_id").alias("id"), "tracker", "change")


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, body in parts.items():
            archive.writestr(name, body)
    return out.getvalue()


def _core(title: str) -> str:
    return f"<cp xmlns:dc='d'><dc:title>{escape(title)}</dc:title><dc:creator>Ada</dc:creator></cp>"


def _clean(body: str) -> str:
    return escape("".join(c for c in body if c >= " " or c == "\n"))


def _as_docx(body: str) -> bytes:
    runs = "".join(f"<p><r><t>{_clean(x)}</t></r></p>" for x in body.split("\n"))
    return _zip({"word/document.xml": f"<document><body>{runs}</body></document>", "docProps/core.xml": _core(body[:20].strip())})


def _as_xlsx(body: str) -> bytes:
    shared = "".join(f"<si><t>{_clean(x)}</t></si>" for x in body.split("\n"))
    cells = "".join(f"<c t='s'><v>{k}</v></c>" for k in range(body.count("\n") + 1))
    return _zip({"xl/sharedStrings.xml": f"<sst>{shared}</sst>", "xl/worksheets/sheet1.xml": f"<s><row>{cells}<c><v>7</v></c></row></s>"})


def _as_pptx(body: str) -> bytes:
    return _zip({f"ppt/slides/slide{k}.xml": f"<s><p><t>{_clean(x)}</t></p></s>" for k, x in enumerate(body.split("\n"), 1)})


def _as_pdf(body: str) -> bytes:
    shown = body.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r")
    page = zlib.compress(b"BT (" + shown.replace(b"\n", b") Tj T* (") + b") Tj ET")
    return b"%PDF-1.4\n1 0 obj << /Type /Page >> endobj\n2 0 obj << /Filter /FlateDecode >>\nstream\n" + page + b"\nendstream endobj\n3 0 obj << /Author (Ada) >> endobj\n"


def _as_tiff(body: str) -> bytes:
    make, model, taken = b"Acme\0", f"Acme {len(body)}\0".encode(), b"2024:02:03 04:05:06\0"
    at = 8 + 2 + 3 * 12 + 4
    rows, data = b"", b""
    for tag, value in ((0x010F, make), (0x0110, model), (0x0132, taken)):
        rows += struct.pack("<HHII", tag, 2, len(value), at + len(data))
        data += value
    return b"II*\0" + struct.pack("<IH", 8, 3) + rows + struct.pack("<I", 0) + data


def _documents_as(spark: SparkSession, sf_dir: str, doc_type: str, make: Callable[[str], bytes]) -> DataFrame:
    """The documents' texts packed as files of a type, in the tasks that read them."""

    schema = pa.schema([("id", pa.int64()), ("doc_type", pa.string()), ("content", pa.binary())])
    pack = slices.row_by_row(lambda id_, body: (id_, doc_type, make(body or "")), schema)
    return tables.table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(pack, "id long, doc_type string, content binary")


def _office(doc_type: str, make: Callable[[str], bytes]) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = office.extract(_documents_as(spark, sf_dir, doc_type, make))
        return got.select("id", "author", "page_count", F.length("body_text").alias("n_chars"), text.word_count(F.col("body_text")).alias("words"), "error")

    run.__name__ = f"extract_{doc_type}"
    query(run)


_office("docx", _as_docx)
_office("xlsx", _as_xlsx)
_office("pptx", _as_pptx)
_office("pdf", _as_pdf)


@query
def extract_exif(spark, sf_dir):
    got = office.extract(_documents_as(spark, sf_dir, "tiff", _as_tiff))
    return got.select("id", text.camera(F.col("make"), F.col("model")).alias("camera"), clock.exif_seconds(F.col("taken")).alias("taken_at"), "error")


QUIET_MS = 3_600_000
#: Events arrive in so many goes, fewer than so many places late; the watermark waits so long for them.
GOES, LATE, DELAY = 3, 20, "3 days"


@query
def watch_changes(spark, sf_dir):
    return watch.watched(tables.watch_events(tables.table(spark, sf_dir, "events")), GAP_MS, QUIET_MS)


@query
def stream_watch_changes(spark, sf_dir):
    def settled(stream):
        return watch.watch_stream(tables.watch_events(stream), GAP_MS, QUIET_MS, DELAY)

    with watch.timers(spark):
        return changes.fed(tables.table(spark, sf_dir, "events"), "event_id", GOES, LATE, settled, "watch")


@query
def stream_debounce_late(spark, sf_dir):
    """As ``stream_debounce``, but the events arrive in several goes, some of them late."""
    named = lambda stream: stream.select(F.col("event_id").alias("id"), F.col("user_id").alias("file_id"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    return changes.fed(tables.table(spark, sf_dir, "events"), "event_id", GOES, LATE, lambda stream: changes.debounced(named(stream), GAP, DELAY), "late")


def halves_joined(stream):
    rows = tables.watch_events(stream)
    return changes.halves_joined(rows.where("mode = 'from'"), rows.where("mode = 'to'"), GAP_MS, DELAY)


@query
def stream_rename_join(spark, sf_dir):
    return changes.fed(tables.table(spark, sf_dir, "events"), "event_id", GOES, LATE, halves_joined, "halves")


def _rename_chains(spark, sf_dir):
    """Files /f<user>, some deleted, and renames to neighbours, in chains, swaps and out of sight, by time."""
    raw = tables.table(spark, sf_dir, "events")
    user, id_ = F.col("user_id"), F.col("event_id")
    name = lambda n: F.concat(F.lit("/f"), n.cast("string"))
    state = raw.select(user.alias("id")).distinct().select("id", name(F.col("id")).alias("path"), F.when(F.col("id") % 5 == 0, F.lit(1).cast("long")).alias("deleted_at"))
    to = F.when(id_ % 13 > 0, name(user + id_ % 4 - 1))
    moves = raw.where("event_type IN ('purchase', 'click')").select(id_.alias("seq"), name(user).alias("from_path"), to.alias("to_path"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    return state, moves


@query
def rename_chain_events(spark, sf_dir):
    return renames.applied(*_rename_chains(spark, sf_dir))[1]


@query
def rename_chain_state(spark, sf_dir):
    return renames.applied(*_rename_chains(spark, sf_dir))[0]


@query
def cdc_replay(spark, sf_dir):
    return replay.replayed(tables.events(spark, sf_dir))


@query
def agg_consecutive_days(spark, sf_dir):
    rows = tables.events(spark, sf_dir)
    now = F.lit(1_706_745_600_000).cast("long")
    return ev.consecutive_days(rows, [-F.col("size_bytes"), -F.col("id")], now)


@query
def path_intern_into(spark, sf_dir):
    tree, folder = tables.page_tree(spark, sf_dir), shared_path(spark, "dictionary")
    paths.intern_into(folder, tree.where("name < 'm'"), 0)
    paths.intern_into(folder, tree.where("name >= 'a'"), 1)
    # Run once more, as after a failure.
    paths.intern_into(folder, tree.where("name >= 'a'"), 1)
    return paths.intern_into(folder, tree, 2)


def looks(raw):
    """What was seen of files at each event: their size and time, or, at an error, that they were gone."""
    there = F.col("event_type") != "error"
    return raw.select(
        F.col("event_id").alias("id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("t"),
        F.concat(F.lit("/u"), F.col("user_id").cast("string")).alias("path"),
        F.lit("touched").alias("kind"),
        F.when(there, F.get_json_object("props", "$.k").cast("long")).alias("size_bytes"),
        F.when(there, F.floor(F.col("event_id") / 100)).alias("mtime_unix"),
    )


@query
def stream_state_merge(spark, sf_dir):
    table = streamed_state.StateTable(spark)
    changes.fed_into(looks(tables.table(spark, sf_dir, "events")), "id", GOES, LATE, lambda stream, log: streamed_state.merge_stream(stream, table, log=log), "looks")
    return table.latest().where("deleted_at IS NULL").drop("deleted_at")


@query
def scan_walk(spark, sf_dir):
    """Directories of documents laid out by source and language, as a walk finds them."""
    top = shared_path(spark, "laid-out")
    tables.table(spark, sf_dir, "documents").select("text", "source", "lang").write.partitionBy("source", "lang").text(top)
    found = written(walk.walk(spark, [top]), "walked")
    held = found.groupBy(F.col("parent").alias("path")).agg(F.count_if("is_dir").alias("n_dirs"), (F.count_if(~F.col("is_dir") & ~F.startswith("name", F.lit("."))) > 0).alias("has_files"))
    base = len(walk.plain_path(top)) + 1
    return held.join(found.where("is_dir").select("path", "depth"), "path", "left").select(F.substr("path", F.lit(base + 1)).alias("path"), F.coalesce("depth", F.lit(0)).alias("depth"), "n_dirs", "has_files")


@query
def scan_hidden(spark, sf_dir):
    top = shared_path(spark, "hidden")
    tables.table(spark, sf_dir, "region").select("r_name", F.concat(F.lit("_"), F.lower("r_name")).alias("_k")).write.partitionBy("_k").json(top)
    found = walk.walk(spark, [top], skip_dirs=("_k=_asia",))
    return found.where("is_dir OR name = '_SUCCESS'").select("name", "is_dir", "depth", F.col("size_bytes").isNull().alias("no_size"), "skipped")


def _laid_out(spark, sf_dir) -> str:
    """A folder with one text file per source and language: its documents, a line each."""
    top = shared_path(spark, "texts")
    rows = tables.table(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("text"), "doc_id", "source", "lang")
    dealt = rows.repartition("source", "lang").sortWithinPartitions("source", "lang", "doc_id")
    dealt.select("text", "source", "lang").write.partitionBy("source", "lang").text(top)
    return top


def _folder():
    """The folder of a file, below the one that holds all."""
    return F.regexp_extract("path", "(source=[^/]*/lang=[^/]*)/", 1).alias("folder")


@query
def scan_files(spark, sf_dir):
    return files.scan(spark, _laid_out(spark, sf_dir)).select(_folder(), "size_bytes")


@query
def read_contents(spark, sf_dir):
    return files.contents(spark, _laid_out(spark, sf_dir)).select(_folder(), F.md5("content").alias("md5"), "error")


@query
def read_heads(spark, sf_dir):
    return files.heads(spark, _laid_out(spark, sf_dir)).select(_folder(), F.md5("head").alias("md5"))


@query
def append_rows(spark, sf_dir):
    """Documents appended in two commits, and an empty one."""
    rows, path = tables.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), shared_path(spark, "appended")
    for some in (rows.where("n_chars < 1000"), rows.limit(0), rows.where("n_chars >= 1000")):
        files.append(some, path)
    return spark.read.schema(rows.schema).parquet(path)


def feed_roots(spark, sf_dir):
    """Three roots: what each holds, and two goes of changes of each; gives their folders and a writer of changes."""
    rows = looks(tables.table(spark, sf_dir, "events"))
    top = shared_path(spark, "roots")
    root = lambda n: f"{top}/root{n}"
    of = lambda n: rows.where(F.col("id") % 3 == n)
    for n in range(3):
        of(n).groupBy("path").agg(F.min_by(F.struct("kind", "t", "id", "size_bytes", "mtime_unix"), "id").alias("s")).select("path", "s.*").write.parquet(f"{root(n)}/held")
    half = rows.agg(F.max("id")).first()[0] // 2

    def change(n: int, go: int) -> None:
        of(n).where((F.col("id") <= half) if go == 0 else (F.col("id") > half)).write.parquet(f"{root(n)}/feed/go={go}")

    return root, change


@query
def stream_roots(spark, sf_dir):
    """Roots 0 and 1 from the start; then 2 comes and 0 goes. Rows by root and stage, as they came."""
    root, change = feed_roots(spark, sf_dir)
    top, out = shared_path(spark, "root-table"), shared_path(spark, "told")
    stream = roots.root_stream(spark, top)

    def run(*now: int) -> None:
        spark.createDataFrame([(root(n),) for n in now], "root string").coalesce(1).write.mode("overwrite").parquet(top)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start()
        query.awaitTermination()

    run(0, 1)
    for n in range(3):
        change(n, 0)
    run(0, 1)
    run(1, 2)
    for n in range(3):
        change(n, 1)
    run(1, 2)
    told = spark.read.schema(stream.schema).parquet(out)
    name = F.regexp_extract("root", "[^/]*$", 0)
    return told.groupBy(name.alias("root"), "stage", F.when(F.col("stage") == "command", F.col("kind")).alias("command")).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query
def extract_html_title(spark, sf_dir):
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return tables.table(spark, sf_dir, "pages").select("page_id", text.trimmed(title).alias("title"))


@query
def llm_enrich_stub(spark, sf_dir):
    return endpoints.enrich(tables.metadata(spark, sf_dir).select("file_id", "body_text"), endpoints.stub_chat, "stub", "Describe the document as JSON.")


@query
def llm_embed_stub(spark, sf_dir):
    return endpoints.embed(tables.metadata(spark, sf_dir).select("file_id", "body_text"), endpoints.stub_embedding, "stub", 8)
