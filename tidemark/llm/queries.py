"""The registered query of each operator, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import one_spaced, split_of, table

#: The rules of the URL query (fixed values).
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def _op(module: str):
    return import_module(f"tidemark.llm.{module}")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = _op("url_filter")
    judged = op.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), op.rule_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def quality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling weight by the quality label: 2 for good, 0.5 for bad documents."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    weight = F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0)
    return labels.select("doc_id", weight.alias("weight"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = _op("quality").score_quality(docs)
    return scored.select("doc_id", "score", "weak_label", "predicted", (F.col("predicted") == 1).alias("kept"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return _op("mixing").mix(docs, quality=quality_weights(spark, sf_dir))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = _op("decontam").find_items(docs, table(spark, sf_dir, "benchmark"))
    joined = F.array_join("items", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), "contaminated")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = split_of(F.col("doc_id"), 3) == 1
    scored = _op("toxicity").score_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "evidence")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _op("simhash").near_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return _op("html_extract").extract(pages).select("page_id", "url", "text", "n_chars")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decided = _op("exact_dedup").exact_dedup(docs)
    return decided.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _op("lm_score").score_documents(docs).select("doc_id", "n_tokens", "log_prob", "mean_log_prob")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = split_of(F.col("doc_id"), 5) == 0
    named = _op("langid").identify(docs.select("doc_id", "text"), docs, ~held_out)
    return named.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _op("alignment").align(docs, str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = repeating(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = _op("runs").periodic_runs(docs)
    return run_digests(found)


def repeating(docs: DataFrame) -> DataFrame:
    """The documents of the query: in a tenth of them, told by a hash of the id, the words from some place on repeat the first few after it.

    Documents without an id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    n, a = F.size("_words"), (F.col("_g") % F.size("_words")).cast("int")
    p = 1 + F.floor((n - a) / (3 + F.col("_g") % 8)).cast("int")
    words = F.split(F.trim(one_spaced(F.col("text"))), " ")
    placed = docs.withColumn("_g", F.when(h % 10 == 0, F.floor(h / 10))).withColumn("_words", F.when(F.col("_g").isNotNull(), F.filter(words, lambda w: w != "")))
    planted = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("_words", F.when(i < a, i).otherwise(a + (i - a) % p)))
    return placed.withColumn("text", F.when(n > 0, F.array_join(planted, " ")).otherwise(F.col("text"))).drop("_g", "_words")


def run_digests(found: DataFrame) -> DataFrame:
    """The longest run of each document, of equal ones the first, then the one of the smallest period, and digests of all runs and of what is left."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    told = found.withColumn("_best", best)
    return told.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_best.start")).alias("start"),
        F.col("_best.length").alias("length"),
        (-F.col("_best.period")).alias("period"),
        F.floor(1000 * F.col("_best.length") / -F.col("_best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _op("token_count").count_tokens(docs, str(public_tokenizers.path("byte_bpe_50k.json")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_decontamination": op2_decontamination,
    "op3_quality": op3_quality,
    "op4_source_mixing": op4_source_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_simhash": op6_simhash,
    "op7_html_extraction": op7_html_extraction,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_language_id": op10_language_id,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_token_counts": op13_token_counts,
}

_OP1 = r"""
WITH rules(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
parts AS (
  SELECT page_id, row_number() OVER () AS n,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fits AS (
  SELECT p.*, r.rhost || r.rpath AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.n ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST, length(r.rhost) DESC) AS k
  FROM parts p LEFT JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE k = 1
"""

_MIX = r"""
sized AS (
  SELECT d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+')) AS size, coalesce(CASE l.quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 END, 1.0)::DOUBLE AS weight
  FROM {docs} d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM src),
filled AS (
  SELECT *, row_number() OVER o AS n, sum(cap) OVER o AS caps, sum(w) OVER o AS ws, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget, sum(w) OVER () AS w_all
  FROM ranked WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
levels AS (
  SELECT arg_min((budget - (caps - cap)) / (w_all - (ws - w)), n) AS level FROM filled WHERE (budget - (caps - cap)) / (w_all - (ws - w)) <= cap / w),
targets AS (SELECT r.source, r.source_size, least(r.cap, r.w * l.level) AS target FROM ranked r, levels l),
keyed AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target,
    -ln((('0x' || substr(md5('42:' || coalesce(s.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE) / s.weight AS k
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
summed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto,
    CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs
  FROM keyed),
mixed AS (
  SELECT doc_id, source, size, source_size, target,
    (size * (epochs + CASE WHEN upto <= target - epochs * source_size
      OR (target - epochs * source_size - (upto - size) > 0 AND upto - (target - epochs * source_size) < target - epochs * source_size - (upto - size)) THEN 1 ELSE 0 END))::BIGINT AS taken
  FROM summed)
"""

_OP8 = r"""
WITH normed AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM normed WINDOW g AS (PARTITION BY norm)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_url_filters": _OP1,
    "op4_source_mixing": "WITH " + _MIX.format(docs="documents") + "SELECT doc_id, source, size, source_size, target, taken FROM mixed",
    "op8_exact_dedup": _OP8,
}
