"""Properties of the small helpers, without Spark."""

import html

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.test_contracts import LOWER, WORD, brute_decontam, brute_fingerprint
from tidemark.llm import decontam, html_extract, langid, simhash

TEXT = st.text(alphabet="abAB0 é漢.,\n\t\x0b\x85 ", max_size=60)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_chunk_finds_the_words_of_every_text(texts):
    raws = [t.encode() for t in texts]
    chunk = decontam.Chunk(raws)
    for i, text in enumerate(texts):
        a, b = chunk.first[i], chunk.first[i + 1]
        found = [raws[i][chunk.starts[k] - chunk.at[i] : chunk.ends[k] - chunk.at[i]].decode() for k in range(a, b)]
        assert [w.translate(LOWER) for w in found] == WORD.findall(text.translate(LOWER))


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5), st.lists(TEXT, max_size=4), st.integers(1, 3))
def test_scan_equals_brute_force(texts, items, size):
    machine = decontam.automaton([(str(i), t) for i, t in enumerate(items)], size)
    n = len(texts)
    words, hits, spans, ids = [0] * n, [[] for _ in texts], [[] for _ in texts], [[] for _ in texts]
    decontam._scan_chunk([t.encode() for t in texts], machine, 0, words, hits, spans, ids)
    want = brute_decontam([{"doc_id": i, "text": t} for i, t in enumerate(texts)], [{"item_id": i, "text": t} for i, t in enumerate(items)], size)
    for i in range(n):
        assert (words[i], sum(h["last"] - h["first"] + 1 for h in hits[i]), len(ids[i])) == want[i][:3]


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_fingerprint_equals_brute_force(text):
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4095), st.booleans()), max_size=30, unique_by=lambda x: x[0]))
def test_stars_span_what_is_linked(rows):
    tree = [(i * 7 + 1, p) for i, (p, q) in enumerate(rows) if not q]
    queries = [(i * 7 + 1, p) for i, (p, q) in enumerate(rows) if q]
    links = simhash.spanning_links(tree, queries, 2)
    ids = dict(tree + queries)
    parent = {i: i for i in ids}

    def find(x, parent):
        while parent[x] != x:
            x = parent[x]
        return x

    want = dict(parent)
    for i, p in ids.items():
        for j, q in tree:
            if i != j and (p ^ q).bit_count() <= 2:
                want[find(i, want)] = find(j, want)
    for a, b in links:
        parent[find(a, parent)] = find(b, parent)
    same = lambda who: {frozenset(x for x in ids if find(x, who) == find(i, who)) for i in ids}
    assert same(parent) == same(want) and len(links) <= len(ids)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/pabdiv &;'\"=-!", max_size=80))
def test_blocks_read_any_markup(page):
    assert all(b.text == " ".join(b.text.split()) and b.text for b in html_extract.blocks(page))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab &<é", min_size=1, max_size=20), max_size=5))
def test_blocks_give_back_paragraphs(texts):
    page = "".join(f"<div><p>{html.escape(t)}</div>" for t in texts)
    assert [b.text for b in html_extract.blocks(page)] == [x for t in texts if (x := " ".join(t.split()))]


@given(st.binary(max_size=40))
def test_folded_bytes_have_single_spaces(raw):
    folded = langid.fold(raw).tobytes()
    assert b"  " not in folded.strip() and folded[:1] == b" " == folded[-1:]
