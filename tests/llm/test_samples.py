"""Fitting samples where many rows are copies, or all rows are large."""

import random

from pyspark.sql import functions as F

from tidemark.llm import html_extract, langid, quality
from tidemark.llm.common import least_rows
from tests.llm.test_operators import PAGE


def test_least_rows_count_draws_and_not_copies(spark):
    rows = spark.range(100_000).select((F.col("id") % 2).alias("kind"), F.xxhash64(F.col("id") % 50).alias("draw"))
    every = sorted({r["draw"] & 0xFFFFFFFFFFFFFFFF for r in rows.distinct().collect()})
    got = [r["draw"] & 0xFFFFFFFFFFFFFFFF for r in least_rows(rows.select("draw"), 20).collect()]
    assert sorted(got) == every[:20]
    assert len(least_rows(rows, 300, "kind").collect()) == 50


def test_copies_leave_pages_to_learn_from(spark):
    few = [(PAGE.format(i),) for i in range(5)]
    pages = spark.createDataFrame(few, "html string").crossJoin(spark.range(4_000))
    assert len(html_extract.sample_lessons(pages, "html")) == 6 * 5


def test_large_pages_are_learned_from(spark):
    large = [PAGE.format(i).replace("</article>", "<p>More prose of this page, as it goes on.</p>" * 600 + "</article>") for i in range(40)]
    pages = spark.createDataFrame([(i, p) for i, p in enumerate(large)], "page_id long, html string")
    got = html_extract.extract(pages).collect()
    assert all(r["text"].startswith("Head") and r["text"].count("More prose") == 600 for r in got)
    few = html_extract.sample_lessons(pages, "html", n=4, most=100)
    assert len(few) == 24 and len(few[0][2]) == 100


def test_a_language_of_copies_is_learned(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, F.concat(F.lit("le renard brun et le chien "), F.col("id") % 5)).otherwise(F.concat(F.lit("the quick fox and the dog "), F.col("id"))).alias("text"), F.when(F.col("id") % 2 == 0, "fr").otherwise("en").alias("lang"))
    found = langid.sample(rows, "text", "lang", F.lit(True))
    assert {la: sum(lang == la for lang, _ in found) for la in ("en", "fr")} == {"en": 300, "fr": 5}


def test_quality_learns_from_long_texts_and_rows_without_ids(spark):
    rng = random.Random(8)
    sentence = lambda: " ".join("".join(rng.choices("abcdefghij", k=rng.choice((3, 4, 5, 8)))) for _ in range(12)) + ".\n"
    texts = ["".join(sentence() for _ in range(300)) for _ in range(30)] + ["SPAM$$$ WORDS### NOW&&& " * 1_000] * 12
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    taught = quality.sample_texts(docs)
    assert len(taught) == 31
    whole = {tuple(quality.summed(*quality.features(t.encode()))[0].tolist()) for t in texts}
    assert {tuple(r["at"]) for r in taught} == whole
    got = quality.score_quality(docs).collect()
    assert all(r["predicted"] == int(not r["text"].startswith("SPAM")) and r["score"] != 0.5 for r in got)


def test_every_language_has_a_landmark():
    texts = [f"{chr(97 + i % 26)}{chr(97 + i // 26)} " * 5 for i in range(120)]
    model = langid.fit([langid.distinct_grams(t.encode()) for t in texts], [f"l{i}" for i in range(120)])
    assert model.landmarks.shape[1] == 120
    assert [model.languages[k] for k in model.scores([t.encode() for t in texts]).argmax(axis=1)] == [f"l{i}" for i in range(120)]
