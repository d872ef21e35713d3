"""Operators on small tables: nulls, empty and long texts, ties, repeats, clashing columns."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontam, exact_dedup, html_extract, langid, lm_score, mixing, quality, simhash, toxicity, url_filter
from tidemark.llm.common import n_words, split_of
from tests.llm.test_contracts import brute_components, brute_decontam

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, **more):
    rows = [(i, t, "en" if i % 2 else "fr", None if i % 5 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", "   \n", "a", "a", "a ", "x" * 200_000, "one two three four", "ONE two\tthree four", "word " * 50_000, "été naïve déjà", "!!!", "\ud7ff 漢字 かな"]


def test_word_count(spark):
    got = {r["doc_id"]: r["n"] for r in docs_of(spark, ODD).select("doc_id", n_words(F.col("text")).alias("n")).collect()}
    want = {i: len((t or "").encode().split()) for i, t in enumerate(ODD)}
    assert got == want


# --- URL filters


def brute_rule(host, path, rules):
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, "allow")


def test_url_rules_against_brute_force(spark):
    rng = random.Random(7)
    hosts = ["org", "a.org", "b.a.org", "xa.org", "com", "a.com", "c.b.a.com", ""]
    places = ["", "/", "/e", "/en", "/en/", "/en/1", "/en/10", "/é", "/f/x"]
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h in hosts for p in places if rng.random() < 0.6}.values())
    urls = [f"http://{h}{p}{t}" for h in [*hosts, "q.b.a.org", "A.ORG", "net"] for p in places for t in ("", "?q=/en", "#x", "zz")] + [None, "", "no scheme", "://", "http://a.org", "x://a://b/c"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(0, urls[0], "clash")], "page_id long, url string, verdict string")
    got = url_filter.judge_urls(pages, url_filter.rule_table(spark, rules)).collect()
    assert len(got) == len(urls) + 1
    for row in got:
        url = urls[row["page_id"]]
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = rest
        for sign in "/?#":
            host = host.split(sign)[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        assert (row["host"], row["path"]) == (host, path)
        assert (row["rule"], row["verdict"]) == brute_rule(host, path, rules), url


def test_url_rules_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    none = url_filter.rule_table(spark, [])
    assert [r["verdict"] for r in url_filter.judge_urls(pages, none).collect()] == ["allow"]
    rules = url_filter.rule_table(spark, [("block", "org", "/"), ("allow", "org", "/")])
    assert [r["verdict"] for r in url_filter.judge_urls(pages, rules).collect()] == ["block"]
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


# --- exact deduplication


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.substring(F.unhex(F.md5(F.substring(t, 1, 1).cast("binary"))), 1, 2)])
def test_exact_dedup(spark, digest):
    texts = ODD + ["b", "B", "b", "a  b", "a b"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "a"), (3, "other"), (None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup.exact_dedup(docs, digest=digest).collect()
    norm = lambda t: " ".join([""] * bool((t or "")[:1].isspace()) + (t or "").split() + [""] * bool((t or "").strip() and t[-1:].isspace())) if (t or "").strip() else (" " if t else "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    want = Counter((i, min(x for x in groups[norm(t)] if x is not None), len(groups[norm(t)])) for i, t in rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert exact_dedup.drop_exact_copies(docs).count() == len(groups)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_digest_index_compacts_later_runs(spark):
    index = exact_dedup.DigestIndex(spark)
    rows = lambda *r: spark.createDataFrame(list(r), "id long, digest binary")
    index.flush(rows((5, b"x"), (7, b"y")))
    index.compact()
    index.flush(rows((2, b"x"), (9, b"z"), (9, b"z")))
    got = {bytes(r["digest"]): (r["keep_id"], r["n"]) for r in index.compact().collect()}
    assert got == {b"x": (2, 2), b"y": (7, 1), b"z": (9, 2)}


def test_unique_ids_drop_by_id(spark):
    docs = docs_of(spark, ["p q", "p  q", "r", "p q"])
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [0, 2]


# --- mixing


def test_mix(spark):
    rng = random.Random(3)
    texts = [" ".join("w" for _ in range(rng.randint(0, 80))) for _ in range(400)] + [None, ""]
    docs = docs_of(spark, texts)
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(texts)
    by_source = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append(r)
    total = sum(r["size"] for r in rows)
    names = sorted(s for s in by_source if s is not None) + [None]
    weight = {s: [5, 2, 1][k % 3] for k, s in enumerate(names)}
    sizes = {s: sum(r["size"] for r in by_source[s]) for s in names}
    capped = set()
    while True:
        level = (1.5 * total - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in names if s not in capped)
        more = {s for s in names if s not in capped and weight[s] * level > 2 * sizes[s]}
        if not more:
            break
        capped |= more
    for s in names:
        target = 2 * sizes[s] if s in capped else weight[s] * level
        assert all(abs(r["target"] - target) < 1e-6 and r["source_size"] == sizes[s] for r in by_source[s])
        assert abs(sum(r["taken"] for r in by_source[s]) - target) <= 80
        assert all(r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0) for r in by_source[s])
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(docs.repartition(3)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}
    assert mixing.mix(docs.limit(0)).count() == 0


def test_quality_weights_favour_documents(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), (F.col("id") % 2).cast("string").alias("source"))
    heavy = spark.range(2000).select("id", F.when(F.col("id") % 4 < 2, 4.0).otherwise(1.0).alias("weight"))
    got = mixing.mix(docs, quality=heavy, weights=(1,), share=0.5).groupBy((F.col("doc_id") % 4 < 2).alias("heavy")).agg(F.sum("taken").alias("n")).collect()
    n = {r["heavy"]: r["n"] for r in got}
    assert n[True] > 1.5 * n[False] and abs(n[True] + n[False] - 3000) <= 6


@pytest.mark.parametrize("weights", [{0: 0.01}, {0: 100.0}, {0: 0.01, 1: 100.0, 2: 0.0, 3: None}])
def test_no_piece_holds_a_source(spark, weights):
    """Pieces of a hot source stay small whatever the weights; the rows are mixed whole."""
    docs = spark.range(6_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    weight = F.element_at(F.array(*[F.lit(w).cast("double") for w in weights.values()]), (F.col("id") % len(weights) + 1).cast("int"))
    given = spark.range(6_000).select("id", weight.alias("weight"))
    rows = mixing.mix(docs, quality=given, weights=(1,), share=0.5).collect()
    assert len(rows) == 6_000 and abs(sum(r["taken"] for r in rows) - 9_000) <= 3
    keys = docs.join(given, F.col("doc_id") == F.col("id")).select(F.floor(F.log(mixing.exponential_key(F.col("doc_id"), F.coalesce("weight", F.lit(1.0)), 42)) * 12).alias("piece"))
    assert keys.groupBy("piece").count().agg(F.max("count")).first()[0] < 0.06 * 6_000
    if len(weights) > 1:
        assert not any(r["taken"] for r in rows if r["doc_id"] % 4 == 2)


def test_repeated_rows_and_null_weights_are_mixed(spark):
    docs = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, "c", None), (2, None, "s")], "doc_id long, text string, source string")
    given = spark.createDataFrame([(1, None), (2, -1.0)], "id long, weight double")
    rows = mixing.mix(docs, quality=given).collect()
    assert sorted(r["size"] for r in rows) == [0, 1, 2, 2]


# --- decontamination


def test_decontamination_edges(spark):
    long_item = " ".join(f"k{i}" for i in range(30))
    items = [{"item_id": 1, "text": long_item}, {"item_id": 2, "text": "Two words"}, {"item_id": 3, "text": None}, {"item_id": 4, "text": "!?"}, {"item_id": 10, "text": "two  WORDS"}, {"item_id": 5, "text": "été"}]
    texts = ODD + ["says two-words here", f"é {long_item.upper()} z", " ".join(long_item.split()[3:20]), "twowords two", "two", "words", long_item + " pad" * 1000, "ÉTÉ été"]
    docs = docs_of(spark, texts).withColumn("n_hit", F.lit("clash"))
    bench = spark.createDataFrame([(i["item_id"], i["text"]) for i in items], "item_id long, text string")
    want = brute_decontam([{"doc_id": i, "text": t} for i, t in enumerate(texts)], items)
    for shard_bytes in (1 << 20, 40):
        rows = decontam.find_items(docs, bench, shard_bytes=shard_bytes).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], len(r["items"]), r["contaminated"]) for r in rows} == {k: (*v[:3], v[4]) for k, v in want.items()}
        for r in rows:
            said = " ".join(texts[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"])
            assert len(decontam.Chunk([said.encode()]).starts) == r["n_hit"]
    assert decontam.find_items(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.find_items(docs.limit(0), bench).count() == 0


# --- SimHash


@pytest.mark.parametrize("shard", [1024, 4])
def test_links_and_components_against_brute_force(spark, shard):
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(200):
        p = rng.choice(prints)
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            p ^= 1 << bit
        prints.append(p)
    rows = [(i, p) for i, p in enumerate(prints)]
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    frame = spark.createDataFrame([(i, signed(p)) for i, p in rows], "id long, print long")
    nodes = frame.groupBy("print").agg(F.min("id").alias("id"))
    found = {r["id"]: r["component"] for r in simhash.components(simhash.links(nodes, shard=shard)).collect()}
    want = brute_components(rows)
    least = {}
    for i, p in rows:
        least.setdefault(p, i)
    assert {i: found.get(least[p], least[p]) for i, p in rows} == want


def test_bk_tree_search_is_exact():
    rng = random.Random(1)
    prints = list({rng.getrandbits(12) for _ in range(300)})
    tree = simhash.BKTree()
    for p in prints:
        tree.insert(p)
    for q in prints[:50]:
        assert sorted(tree.near(q, 2)) == [i for i, p in enumerate(prints) if (p ^ q).bit_count() <= 2]


def test_near_dedup_edges(spark):
    docs = docs_of(spark, ODD)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_dedup(docs).collect()}
    assert got[0] == got[1] == got[2] == ("0" * 16, 0)
    assert got[7] == got[8] and got[3] == got[4] == got[5]
    left = simhash.drop_near_copies(docs)
    assert left.columns == docs.columns and left.count() == len({c for _, c in got.values()})
    assert simhash.near_dedup(docs.limit(0)).count() == 0


# --- language identification


def test_language_edges(spark):
    texts = ["the quick brown fox and the dog in the park"] * 12 + ["le renard brun et le chien dans la forêt"] * 12
    rows = [(i, t, "en" if i < 12 else "fr", "s", 1) for i, t in enumerate(texts)]
    train = spark.createDataFrame(rows, DOCS)
    docs = docs_of(spark, ODD + ["the dog and the fox", "le chien et le renard"]).withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in langid.identify(docs, train, F.lit(True)).collect()}
    n = len(ODD)
    assert [got[i]["lang_pred"] for i in (0, 1, 2, 11)] == ["und"] * 4 and got[0]["score"] == 0
    assert got[n]["lang_pred"] == "en" and got[n + 1]["lang_pred"] == "fr" and got[12]["lang_pred"] != "und"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in langid.identify(docs, train.limit(0), F.lit(True)).collect()} == {"und"}
    assert langid.identify(docs.limit(0), train, F.lit(True)).count() == 0


def test_kernel_is_blended_presence():
    model = langid.fit([langid.distinct_grams(t) for t in (b"abc abd", b"xyz")], ["a", "b"], 2)
    sets = [{g for n in (1, 2, 3) for g in zip(*[langid.fold(t)[k:] for k in range(n)])} for t in (b"abc abd", b"xyz")]
    own = len(sets[0]) ** 0.5 * len(sets[1]) ** 0.5
    assert np.allclose(model.kernel([b"xyz"])[0], [len(sets[0] & sets[1]) / own, 1], atol=1e-6)


# --- toxicity


def test_search_equals_brute_force():
    rng = random.Random(2)
    unit = lambda v: {k: x / sum(y * y for y in v.values()) ** 0.5 for k, x in v.items()}
    arrays = lambda v: (np.array(sorted(v)), np.array([v[t] for t in sorted(v)]))
    vectors = [unit({rng.randrange(30): rng.random() + 0.1 for _ in range(rng.randint(1, 6))}) for _ in range(500)]
    for common, block in ((0, 16), (8, 16), (30, 7)):
        begin = np.cumsum([0] + [len(v) for v in vectors])
        index = toxicity.BlockMaxIndex(begin, *(np.concatenate([arrays(v)[k] for v in vectors]) for k in (0, 1)), 40, common, block)
        queries = [unit({rng.randrange(40): rng.random() + 0.1 for _ in range(4)}) for _ in range(60)]
        for q, found in zip(queries, index.search([arrays(q) for q in queries], 10)):
            every = sorted((-round(sum(w * v.get(t, 0) for t, w in sorted(q.items())), 9), n) for n, v in enumerate(vectors))
            assert np.allclose([s for s, *_ in found], [-s for s, n in every if s < 0][:10])


def test_toxicity_edges(spark):
    texts = [f"good plain text number {i} you idiot" if i % 4 == 0 else f"good plain text number {i}" for i in range(200)] + [None, ""]
    docs = docs_of(spark, texts).withColumn("predicted", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 200)] + [(4, 1), (999, 1), (None, 0)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels, split_of(F.col("doc_id"), 3) != 1).collect()}
    assert len(got) == len(texts)
    assert all(got[i]["predicted"] == int(i % 4 == 0) for i in range(200)) and got[200]["predicted"] == got[201]["predicted"] == 0
    assert got[0]["evidence"][0]["terms"] == ["idiot"] or "idiot" in got[0]["evidence"][0]["terms"]
    assert {r["score"] for r in toxicity.score_toxicity(docs, labels.limit(0), F.lit(True)).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), labels, F.lit(True)).count() == 0


# --- HTML extraction

PAGE = """<html><head><title>T</title></head><body><nav><ul><li>Home</li></ul></nav><article><h1>Head {0}</h1><p>First &amp; <b>bold</b>
  text of page {0}, long enough to be read as prose.<p>Second paragraph of page {0}, with more words in it.</article><footer>&copy; {0}</footer></body></html>"""


def test_extract(spark):
    rows = [(i, f"u{i}", PAGE.format(i)) for i in range(40)] + [(40, None, None), (41, "u", ""), (42, "u", "<<<a <p"), (43, "u", "plain < text & more"), (44, "u", PAGE.format(44)[:300])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r for r in html_extract.extract(pages).collect()}
    assert len(got) == len(rows)
    for i in range(40):
        assert got[i]["text"] == f"Head {i}\nFirst & bold text of page {i}, long enough to be read as prose.\nSecond paragraph of page {i}, with more words in it."
    assert got[40]["text"] == got[41]["text"] == "" and got[41]["n_chars"] == 0
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_extract.extract(pages.limit(0)).count() == 0
    assert {r["text"] for r in html_extract.extract(pages.where("page_id >= 40 AND page_id < 43")).collect()} == {""}


def test_other_containers():
    field = html_extract.train([PAGE.format(i) for i in range(60)])
    body = "This is an article sentence that goes on for a while, as sentences do."
    page = f"<body><div class='site-header'><p>{body} No.</p></div><main><div class='post-content'><p>{body} Yes.</p><div class='advert'><p>{body} No.</p></div><p>{body} Yes.</p></div><section id='comments'><p>{body} No.</p></section></main><aside><p>{body} No.</p></aside></body>"
    assert html_extract.main_text(field, page) == f"{body} Yes.\n{body} Yes."


def test_viterbi_and_gradient_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(0)
    field = html_extract.ChainField(step=rng.normal(size=(2, 2)))
    page = html_extract.blocks("<p>a<p>b.<ul><li>c<li>d</ul>")
    field.state = rng.normal(size=field.state.shape)
    scores = field.emissions(page)
    value = lambda ls: sum(scores[i, x] for i, x in enumerate(ls)) + sum(field.step[a, b] for a, b in zip(ls, ls[1:]))
    paths = list(product((0, 1), repeat=len(page)))
    assert field.decode(page) == list(max(paths, key=value))
    expect, pair = field._expectations(scores[None], np.ones((1, len(page)), bool))
    p = np.exp([value(x) for x in paths])
    p /= p.sum()
    assert np.allclose(expect[0, :, 1], [sum(w for w, x in zip(p, paths) if x[i]) for i in range(len(page))])
    assert np.isclose(pair[0, 1], sum(w * sum((a, b) == (0, 1) for a, b in zip(x, x[1:])) for w, x in zip(p, paths)))


# --- quality


def test_label_model_finds_labellers():
    rng = random.Random(4)
    counts = Counter()
    truth = Counter()
    for _ in range(20_000):
        good = rng.random() < 0.8
        v = [-1 if rng.random() < (0.02 if good else 0.6) else 0 for _ in range(quality.LABELLERS)]
        key = int("".join(str(x + 1) for x in v), 3)
        counts[key] += 1
        truth[key, good] += 1
    posterior, likes = quality.label_model(counts)
    right = sum(n for (k, good), n in truth.items() if (posterior[k] > 0.5) == good)
    assert right > 0.98 * 20_000 and np.allclose(likes[1, :, 0], 0.02, atol=0.01) and np.allclose(likes[0, :, 0], 0.6, atol=0.03)


def test_quality_edges(spark):
    prose = "This is a plain sentence of some words that a person wrote. It is followed by another one, as it should be."
    texts = ODD + [f"{prose} {i}." for i in range(80)] + ["SPAM$$$ WORDS### NOW&&& " * 20] * 12
    docs = docs_of(spark, texts).withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in quality.score_quality(docs).collect()}
    n = len(ODD)
    assert len(got) == len(texts) and got[0]["score"] == got[1]["score"] == 0
    assert all(got[i]["predicted"] == 1 for i in range(n, n + 80)) and all(got[i]["predicted"] == 0 for i in range(n + 80, n + 92))
    assert quality.score_quality(docs.limit(0)).count() == 0


# --- LM scoring


def test_lm_learns_order(spark):
    rng = random.Random(6)
    natural = lambda: " ".join(w for _ in range(30) for w in rng.choice(["the cat sat down .", "a dog ran off ."]).split())
    texts = [natural() for _ in range(400)]
    shuffled = [" ".join(rng.sample(t.split(), len(t.split()))) for t in texts[:20]]
    docs = docs_of(spark, texts + shuffled + [None, "", "cat"]).withColumn("log_prob", F.lit("clash"))
    got = {r["doc_id"]: r for r in lm_score.score_documents(docs).collect()}
    mean = lambda ids: np.mean([got[i]["mean_log_prob"] for i in ids])
    assert mean(range(20)) > mean(range(400, 420)) + 0.1
    assert got[420]["mean_log_prob"] is None and got[421]["log_prob"] == 0 and got[422]["n_tokens"] == 1
    assert lm_score.score_documents(docs.limit(0)).count() == 0


def test_lm_gradient():
    net = lm_score.Network(seed=1)
    rows = np.array([[1, lm_score.CONTEXT + 3, 5, 7]])
    likely = lambda: net.forward(rows)[2][0, 9] - np.log(np.exp(net.forward(rows)[2][0]).sum())
    before = likely()
    for _ in range(5):
        net.learn(rows, np.array([9]))
    assert likely() > before
