"""Markup that is ordinary and must not cost article text."""

from html.parser import HTMLParser

import pytest

from tidemark.llm.html_extract import ChainField, blocks, declared, lessons, main_text, train, undressed
from tidemark.llm.queries import QUERIES
from tests.llm.test_contracts import MID, rows_of


def kept(page):
    return " ".join(b.text for b in blocks(page) if declared(b) == 1)


@pytest.mark.parametrize(
    "inside, text",
    [
        ("<p>a <svg class='x' /> b</p><p>c</p>", "a b c"),
        ("<p>a <math/> b</p>", "a b"),
        ("<p>a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b</p>", "a x=2 b"),
        ("<p>a <svg><path d='z'><text>no</text></svg> b</p>", "a b"),
        ("<p>a <button>no</p><p>b</p>", "a b"),
        ("<p>a <button>no<p>b</p><p>c <button>no</button></p>", "a b c"),
        ("<p>a <button><div>no</div></button> b</p>", "a b"),
        ("<div>a <select><option>no<option>no</div><p>b</p>", "a b"),
        ("<ul><li>a <button>no<li>b</ul>", "a b"),
        ("<p>a <textarea>no</p><p>b</p>", "a b"),
        ("<p>a</p><script>no </p> no</script><p>b</p>", "a b"),
        ("<p>a</p><object><object>x</object>y</object><p>b</p>", "a xy b"),
        ("<p>a <canvas>x</canvas></p><noscript>y</noscript>", "a x y"),
        ("<div style='overflow:hidden'>a</div>", "a"),
        ("<div class='overflow-hidden'>a</div>", "a"),
        ("<div aria-hidden=false>a</div>", "a"),
        ("<div aria-hidden='true'>no</div>a", "a"),
        ("<div hidden>no</div>a", "a"),
        ("<div style='color:red; display : none'>no</div>a<div style=visibility:hidden>no</div>", "a"),
    ],
)
def test_article_text_stays(inside, text):
    assert kept(f"<body><article>{inside}</article><footer><button>x</button><svg></svg></footer></body>") == text


def test_many_unclosed_elements_are_read_in_one_pass():
    page = "<article>" + "<p>word <svg>no" * 20_000
    assert kept(page).split() == ["word"] * 20_000


def test_deep_pages_take_room_in_proportion():
    import tracemalloc

    peaks = []
    for n in (4_000, 16_000):
        tracemalloc.start()
        field = ChainField()
        assert main_text(field, "<div>a " * n) == ""
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 6 * peaks[0] and peaks[1] < 50 << 20


def test_pages_that_declare_nothing_have_text():
    prose = "This is a sentence of page {0} that goes on for a while, as sentences do."
    page = f"<div><a>Home {{0}}</a> | <a>About</a></div><div><h1>Head {{0}}</h1><p>{prose}</p><p>{prose}</p></div><div>© 2024 Foo {{0}}</div>"
    field = train([page.format(i) for i in range(50)])
    assert main_text(field, page.format(7)) == "\n".join(["Head 7", prose.format(7), prose.format(7)])


def test_the_query_against_the_declared_article(spark):
    """The given pages declare their articles; the field, told of no declaration, must find them."""
    rows = {r["page_id"]: r for r in QUERIES["op7_html_extraction"](spark, MID).collect()}
    pages = rows_of(MID, "pages")
    assert len(rows) == len(pages)
    for page in pages:
        want = "\n".join(b.text for b in blocks(page["html"]) if declared(b) == 1)
        assert (rows[page["page_id"]]["text"], rows[page["page_id"]]["n_chars"]) == (want, len(want))


def test_pages_without_names_are_mostly_found():
    pages = [r["html"] for r in rows_of(MID, "pages")]
    field = ChainField().fit([x for i, p in enumerate(pages[:100]) for x in lessons(p, i)])
    right = wrong = missed = 0
    for page in map(blocks, pages[100:]):
        for block, label in zip(page, field.decode(undressed(page))):
            want = int(declared(block) == 1)
            right, wrong, missed = right + (label and want), wrong + (label > want), missed + (label < want)
    assert right > 0.95 * (right + missed) and right > 0.95 * (right + wrong)


@pytest.fixture(scope="module")
def field():
    return train([r["html"] for r in rows_of(MID, "pages")][:100])


@pytest.mark.parametrize(
    "name, stays",
    [
        ("related-work", True), ("notice-of-motion", True), ("form-and-function", True), ("byline", True), ("tags", True), ("social-contract", True), ("comment-on-hegel", True),
        ("related", False), ("related-posts", False), ("site-footer", False), ("adBanner", False), ("cookie-notice", False), ("comments comment-list", False), ("x promo", False),
    ],
)
def test_names_of_several_words_are_told_by_all_of_them(field, name, stays):
    said = "The motion was carried, as everyone expected, by a large majority of votes."
    page = f'<html><body><nav><a href="/">Home</a></nav><article><h1>Title</h1><p>{said}</p><section class="{name}"><p>These lines, which follow it, stand in a part of their own, with a name.</p></section><p>{said}</p></article><footer>Foot</footer></body></html>'
    assert ("These lines" in main_text(field, page)) is stays


class Reader(HTMLParser):
    """What stands between article tags, parted at every tag of a block; knows nothing of names or features."""

    APART = set("article p h1 h2 h3 h4 h5 h6 ul ol li div section blockquote pre table tr td th figure figcaption header footer nav aside form dl dt dd hr main".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.silent, self.parts = 0, 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.silent += tag in ("script", "style")
        aside = tag == "div" and dict(attrs).get("class") == "ad"
        if tag in self.APART or aside:
            self.parts.append("")
        elif tag == "br":
            self.parts[-1] += " "

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.silent -= tag in ("script", "style")
        if tag in self.APART:
            self.parts.append("")

    def handle_data(self, data):
        if self.inside and not self.silent:
            self.parts[-1] += data


def test_the_query_against_a_plain_reader(spark):
    pages = {p["page_id"]: p["html"] for p in rows_of(MID, "pages")}
    for row in QUERIES["op7_html_extraction"](spark, MID).collect():
        reader = Reader()
        reader.feed(pages[row["page_id"]] or "")
        want = "\n".join(t for t in (" ".join(p.split()) for p in reader.parts) if t)
        assert row["text"] == want, row["page_id"]
