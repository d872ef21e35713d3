"""Main text of web pages by a linear-chain conditional random field.

A page is cut into its leaf blocks: runs of text without a block tag between.
Features of a block are the tags around it, whatever words their classes and
ids have, its own tag, and what its text is like (length, ending, share of
links, place); the field labels the blocks of a page together as article or
other (Viterbi), trained by gradient ascent on the likelihood of labelled pages.

Pages of the training sample are labelled by what their markup declares
(:func:`declared`), or, where it declares no article, by :func:`prose`; neither
is a feature. Each is learned in other dress too, among others without any name
that declares, so that the text's features carry pages that declare nothing.
The sample has a fixed bound; every page is judged as a whole.
"""

from __future__ import annotations

import html as htmllib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import clashing, least_rows

#: Elements that part blocks (fixed values).
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table"
    " tbody td tfoot th thead title tr ul".split()
)
#: Elements without an end tag, and elements whose content is not text (fixed values).
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea template iframe svg select button".split())
#: Of these, the ones whose content is characters up to the end tag, and those that end at the next of their kind.
TEXT_ONLY = frozenset("script style textarea iframe".split())
NOT_NESTED = frozenset("select button".split())
#: Block elements that an open p ends at (fixed values).
ENDS_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: Elements whose start ends an open one of the same kind (fixed values).
SAME_KIND = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in a class, id or role that tell of something other than the article (fixed values).
OTHER_WORDS = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form header login masthead menu nav navbar"
    " navigation newsletter notice pagination popup popular promo promoted promotion recommended related reply respond share sharing sidebar signup social sponsor sponsored"
    " subscribe subscription toolbar widget".split()
)
ARTICLE_WORDS = frozenset("article body content entry main page post story text".split())
#: Words that say nothing beside those of the two lists above (fixed values).
PLAIN_WORDS = frozenset(
    "area bar block bottom box cell col column container count entries entry first footer global group header heading inner item items last layout left link links list local module mobile outer page panel"
    " post posts primary right row secondary section site slot small sticky text title top unit view web wrap wrapper zone".split()
)
OTHER_TAGS = frozenset("aside button dialog footer form head header label menu nav title".split())
ARTICLE_TAGS = frozenset("article main".split())

KNOWN_WORDS = OTHER_WORDS | ARTICLE_WORDS | PLAIN_WORDS

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"<]*\"|'[^'<]*'|[^>])*)(?:>|\Z)", re.DOTALL)
NAMED = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN = re.compile(r"hidden|none", re.IGNORECASE)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
HIDING_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.IGNORECASE)

#: Bounds of the training sample (parameters): pages, and blocks in a row of one page.
SAMPLE_PAGES = 200
SAMPLE_BLOCKS = 512
#: Times a page is learned in other dress, and length of training.
DRESSED = 4
EPOCHS = 120
BUCKETS = 1 << 16
#: Elements with names whose words a block is told by, innermost first.
NEAR = 6


class Element:
    """An element with its parent; what blocks in it share is worked out once."""

    __slots__ = ("tag", "parent", "depth", "tags", "near", "hidden", "said", "told")

    def __init__(self, tag: str, words: frozenset[str], parent: Element | None):
        self.tag, self.parent, self.told = tag, parent, None
        if parent is None:
            self.depth, self.tags, self.near, self.hidden, self.said = 0, frozenset(), (), False, None
            return
        self.depth = parent.depth + 1
        self.tags = parent.tags if tag in parent.tags or tag not in BLOCK_TAGS else parent.tags | {tag}
        self.near = (words, *parent.near[: NEAR - 1]) if words else parent.near
        self.hidden = parent.hidden or "hidden" in words
        # A header inside an article holds its title, so it declares nothing there.
        other = words & OTHER_WORDS or self.hidden or tag in OTHER_TAGS and not (tag == "header" and parent.said)
        article = tag in ARTICLE_TAGS or words & ARTICLE_WORDS
        self.said = 0 if other or parent.said == 0 else 1 if article else parent.said


ROOT = Element("", frozenset(), None)


def chain(*path: tuple[str, frozenset[str]]) -> Element:
    """The innermost of elements, given outermost first."""
    at = ROOT
    for tag, words in path:
        at = Element(tag, words, at)
    return at


@dataclass(slots=True)
class Block:
    """Text of a leaf block, the element that holds it, and the share of its text in links."""

    text: str
    element: Element
    linked: float = 0.0


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order; blocks without text are left out."""
    page = page or ""
    out: list[Block] = []
    stack = [ROOT]
    opened: Counter[str] = Counter()
    held: list[str] = []
    at, linked = 0, 0
    endless: set[str] = set()

    def hold(text: str) -> None:
        nonlocal linked
        held.append(text)
        linked += len(text) if opened["a"] else 0

    def flush() -> None:
        nonlocal linked
        if held:
            raw = "".join(held)
            text = " ".join(htmllib.unescape(raw).split())
            if text:
                out.append(Block(text, stack[-1], linked / len(raw)))
            held.clear()
            linked = 0

    def leave(upto: int) -> None:
        while len(stack) > upto:
            opened[stack.pop().tag] -= 1

    while at < len(page):
        found = TOKEN.search(page, at)
        if not found:
            hold(page[at:])
            break
        if found.start() > at:
            hold(page[at : found.start()])
        at = max(found.end(), found.start() + 1)
        name = (found[2] or "").lower()
        if not name:
            continue
        if name == "br":
            hold(" ")
            continue
        if found[1]:
            if name in BLOCK_TAGS:
                flush()
            if opened[name] and _may_close(stack, name):
                upto = len(stack) - 1
                while stack[upto].tag != name:
                    upto -= 1
                leave(upto)
            continue
        if name in RAW_TAGS:
            if name != "svg" or not found[3].rstrip().endswith("/"):
                at = _raw_end(page, at, name, stack, opened, endless)
            continue
        if name in BLOCK_TAGS:
            flush()
            if name in ENDS_P:
                leave(_closed(stack, {"p"}))
            if name in SAME_KIND:
                leave(_closed(stack, SAME_KIND[name]))
        if name not in VOID_TAGS and not found[3].rstrip().endswith("/"):
            words = _names(found[3]) if found[3].strip() else frozenset()
            stack.append(Element(name, words, stack[-1]))
            opened[name] += 1
    flush()
    return out


def _raw_end(page: str, at: int, name: str, stack: list[Element], opened: Counter[str], endless: set[str]) -> int:
    """Where the content of a raw element that begins at ``at`` has ended.

    That is behind its end tag. Without one (but for script and style, which run
    to the end of the page) it is where the container ends, by an end tag or as
    a p or list item does, or where the next select or button begins.
    ``endless`` keeps the names of elements that no tag up to the page's end has
    ended, so that the page is not read through for each of them.
    """
    if name in TEXT_ONLY and name not in endless:
        end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.IGNORECASE).search(page, at)
        if end:
            return end.end()
        if name in ("script", "style"):
            return len(page)
        endless.add(name)
    inner: list[str] = []
    early = -1
    while token := TOKEN.search(page, at):
        tag = (token[2] or "").lower()
        at = max(token.end(), token.start() + 1)
        if not tag:
            continue
        if token[1]:
            if tag in inner:
                while inner.pop() != tag:
                    pass
            elif tag == name:
                return token.end()
            elif opened[tag] and _may_close(stack, tag):
                return early if early >= 0 else token.start()
            continue
        if tag == name and name in NOT_NESTED:
            return early if early >= 0 else token.start()
        if early < 0 and not inner and _ends_container(stack, tag):
            early = token.start()
            if name in endless:
                return early
        if tag in ("script", "style"):
            at = _raw_end(page, at, tag, [], Counter(), endless)
        elif tag not in VOID_TAGS and not token[3].rstrip().endswith("/"):
            inner.append(tag)
    endless.add(name)
    return early if early >= 0 else len(page)


def _ends_container(stack: list[Element], name: str) -> bool:
    """Whether the start of an element ends the innermost open block element."""
    inmost = next((e.tag for e in reversed(stack) if e.tag in BLOCK_TAGS), "")
    return inmost == "p" and name in ENDS_P or inmost in SAME_KIND.get(name, ())


def _may_close(stack: list[Element], name: str) -> bool:
    """An inline end tag does not reach over an open block element."""
    if name in BLOCK_TAGS:
        return True
    for element in reversed(stack):
        if element.tag == name:
            return True
        if element.tag in BLOCK_TAGS:
            return False
    return False


def _closed(stack: list[Element], kinds: set[str]) -> int:
    """Height of the stack once the innermost element of the kinds is closed, unless a container is in between."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in kinds:
            return i
        if stack[i].tag in BLOCK_TAGS and stack[i].tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
            break
    return len(stack)


def _names(attributes: str) -> frozenset[str]:
    """The names that an element goes by, in class, id, role or itemprop.

    A name is told by its words (``site-footer``, ``adBanner``) only where all of
    them are of the lists; else it is one word of its own, for ``related-work`` or
    ``notice-of-motion`` are no related links and no notice.
    """
    words = set()
    for found in NAMED.finditer(attributes):
        for name in (found[1] or found[2] or found[3] or "").split():
            parts = {w.lower() for w in NAME_WORD.findall(name)}
            words |= parts if parts <= KNOWN_WORDS else {name.lower()}
    words.discard("hidden")
    return frozenset(words | ({"hidden"} if HIDDEN.search(attributes) and _hides(attributes) else set()))


def _hides(attributes: str) -> bool:
    """Whether an element is hidden by attribute, aria-hidden=true or its style."""
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and HIDING_STYLE.search(value):
            return True
    return False


def declared(block: Block) -> int | None:
    """1 for article, 0 for other, None where the markup around a block says neither."""
    return block.element.said


_ENDS = tuple(".!?…:;\"”»)")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def prose(page: list[Block]) -> list[int]:
    """Labels of a page that declares no article: sentences, and headings that lead to them.

    What the markup declares to be something else stays so.
    """
    labels: list[int] = []
    for block in reversed(page):
        long = len(block.text) >= 40 and block.linked < 0.3 and block.text.endswith(_ENDS) and "©" not in block.text
        leads = block.element.tag in _HEADINGS and bool(labels and labels[-1])
        labels.append(int((long or leads) and declared(block) is None))
    return labels[::-1]


def labels_of(page: list[Block]) -> list[int]:
    """What a page of the training sample teaches."""
    said = [declared(b) for b in page]
    return [x or 0 for x in said] if 1 in said else prose(page)


def _id(name: str) -> int:
    """Number of a feature: a hash that all workers share."""
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS


def element_features(element: Element) -> np.ndarray:
    """Features that all blocks of an element share."""
    if element.told is None:
        names = {f"in:{tag}" for tag in element.tags} | {f"own:{element.tag}", f"deep:{min(element.depth, 8)}"}
        for rank, words in enumerate(element.near):
            names |= {f"word:{w}" for w in words} | {f"word{min(rank, 2)}:{w}" for w in words}
        if element.hidden:
            names.add("hidden")
        element.told = np.array(sorted({_id(n) for n in names}), np.int32)
    return element.told


#: Numbers of the features of texts.
_SIZES = [_id(f"size:{k}") for k in range(64)]
_OTHERS = {name: _id(name) for name in ["end:0", "end:1", "sign", "bias", *(f"place:{k}" for k in range(4)), *(f"link:{k}" for k in range(4)), *(f"comma:{k}" for k in range(3))]}


def text_features(page: list[Block]) -> list[list[int]]:
    """Features of each block's text."""
    out = []
    for i, block in enumerate(page):
        text, o = block.text, _OTHERS
        told = [
            _SIZES[len(text).bit_length()],
            o["end:1" if text.endswith(_ENDS) else "end:0"],
            o[f"place:{4 * i // len(page)}"],
            o[f"link:{min(3, int(block.linked * 3 + 0.999))}"],
            o[f"comma:{min(2, text.count(','))}"],
            o["bias"],
        ]
        if "©" in text or "|" in text or "·" in text:
            told.append(o["sign"])
        out.append(told)
    return out


#: A page to learn from: feature numbers, number of features and label of each block.
Lesson = tuple[np.ndarray, np.ndarray, np.ndarray]


def lesson(page: list[Block], labels: list[int]) -> Lesson:
    told = [np.concatenate((element_features(b.element), np.array(t, np.int32))) for b, t in zip(page, text_features(page))]
    return np.concatenate(told), np.array([len(t) for t in told], np.int32), np.array(labels, np.int32)


class ChainField:
    """Two-label linear chain: state weights by feature, and transitions."""

    def __init__(self, state: np.ndarray | None = None, step: np.ndarray | None = None):
        self.state = np.zeros((BUCKETS, 2)) if state is None else state
        self.step = np.zeros((2, 2)) if step is None else step

    def emissions(self, page: list[Block]) -> np.ndarray:
        if not page:
            return np.zeros((0, 2))
        told = text_features(page)
        out = np.add.reduceat(self.state[[k for t in told for k in t]], np.cumsum([0] + [len(t) for t in told[:-1]]), axis=0)
        around: dict[int, np.ndarray] = {}
        for i, block in enumerate(page):
            key = id(block.element)
            if key not in around:
                around[key] = self.state[element_features(block.element)].sum(axis=0)
            out[i] += around[key]
        return out

    def decode(self, page: list[Block]) -> list[int]:
        """The likeliest labels of the whole page (Viterbi)."""
        scores = self.emissions(page).tolist()
        if not scores:
            return []
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b = scores[0]
        back = []
        for x, y in scores[1:]:
            to0, to1 = a + s00 >= b + s10, a + s01 >= b + s11
            back.append((0 if to0 else 1, 0 if to1 else 1))
            a, b = (a + s00 if to0 else b + s10) + x, (a + s01 if to1 else b + s11) + y
        label = int(b > a)
        labels = [label]
        for pair in reversed(back):
            label = pair[label]
            labels.append(label)
        return labels[::-1]

    def fit(self, lessons: list[Lesson], epochs: int = EPOCHS, rate: float = 0.5, decay: float = 1e-5) -> ChainField:
        """Ascend the mean log-likelihood of whole label sequences by block.

        Pages of like length are padded to a rectangle, so a forward and
        backward pass is one vector step a position.
        """
        if not lessons:
            return self
        lessons = sorted(lessons, key=lambda x: len(x[2]))
        used, flat = np.unique(np.concatenate([f for f, _, _ in lessons]), return_inverse=True)
        gold = np.concatenate([g for _, _, g in lessons])
        sizes = np.concatenate([n for _, n, _ in lessons])
        row, begins, total = np.repeat(np.arange(len(gold)), sizes), np.cumsum(sizes) - sizes, len(gold)
        lengths = np.array([len(g) for _, _, g in lessons])
        first = np.concatenate(([0], np.cumsum(lengths)))
        cuts = np.flatnonzero(np.diff(np.log2(lengths).astype(int), prepend=-1)).tolist() + [len(lengths)]
        groups = [(first[a], first[b], np.arange(lengths[b - 1])[None, :] < lengths[a:b, None]) for a, b in zip(cuts, cuts[1:])]
        truth = np.zeros((total, 2))
        truth[np.arange(total), gold] = 1
        pairs = np.zeros((2, 2))
        inner = np.ones(total, bool)
        inner[first[:-1]] = False
        np.add.at(pairs, (gold[np.flatnonzero(inner) - 1], gold[inner]), 1)
        state = np.ascontiguousarray(self.state[used].T)
        squares, step_squares = np.full_like(state, 1e-8), np.full_like(self.step, 1e-8)
        for _ in range(epochs):
            emit = np.stack([np.add.reduceat(s[flat], begins) for s in state], axis=1)
            expect, pair_expect = np.empty((total, 2)), np.zeros((2, 2))
            for a, b, inside in groups:
                cells = np.zeros((*inside.shape, 2))
                cells[inside] = emit[a:b]
                found, pair = self._expectations(cells, inside)
                expect[a:b] = found[inside]
                pair_expect += pair
            miss = truth - expect
            grad = np.stack([np.bincount(flat, miss[:, k][row], len(used)) for k in (0, 1)]) / total - decay * state
            step_grad = (pairs - pair_expect) / total - decay * self.step
            squares += grad**2
            step_squares += step_grad**2
            state += rate * grad / np.sqrt(squares)
            self.step += rate * step_grad / np.sqrt(step_squares)
        self.state[used] = state.T
        return self

    def _expectations(self, cells: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width, _ = cells.shape
        ahead, behind = np.zeros_like(cells), np.zeros_like(cells)
        ahead[:, 0] = cells[:, 0]
        for t in range(1, width):
            new = np.logaddexp(ahead[:, t - 1, 0, None] + self.step[0], ahead[:, t - 1, 1, None] + self.step[1]) + cells[:, t]
            ahead[:, t] = np.where(inside[:, t, None], new, ahead[:, t - 1])
        for t in range(width - 2, -1, -1):
            later = cells[:, t + 1] + behind[:, t + 1]
            new = np.logaddexp(self.step[:, 0] + later[:, 0, None], self.step[:, 1] + later[:, 1, None])
            behind[:, t] = np.where(inside[:, t + 1, None], new, 0)
        whole = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        expect = np.exp(ahead + behind - whole[:, None, None])
        pair = np.zeros((2, 2))
        for t in range(1, width):
            joint = np.exp(ahead[:, t - 1, :, None] + self.step + (cells[:, t] + behind[:, t])[:, None, :] - whole[:, None, None])
            pair += joint[inside[:, t]].sum(axis=0)
        return expect, pair


#: Containers and block elements that variants of labelled pages are dressed in (fixed values).
ARTICLE_DRESS = [
    (),
    (("article", frozenset()),),
    (("main", frozenset()),),
    (("div", frozenset({"content"})),),
    (("div", frozenset({"main"})), ("article", frozenset({"post"}))),
    (("section", frozenset({"entry", "content"})),),
    (("div", frozenset({"page"})), ("div", frozenset({"article", "body"}))),
    (("article", frozenset()), ("header", frozenset())),
    (("div", frozenset()), ("div", frozenset())),
]
ARTICLE_LEAVES = ("p", "p", "p", "p", "h1", "h2", "h3", "li", "blockquote", "pre", "td", "dd", "figcaption", "div")
BOXES = ("div", "div", "section", "ul")
OTHER_LEAVES = ("p", "p", "p", "p", "li", "div", "h2", "h3", "h4", "td", "a", "label")


def dressed(page: list[Block], labels: list[int], rng: np.random.Generator) -> tuple[list[Block], list[int]]:
    """A labelled page in other dress: other containers, with other blocks put in.

    The added blocks borrow article text, so that where a block stands decides
    and not its words alone.
    """
    outer = (("html", frozenset()), ("body", frozenset()))
    dress = ARTICLE_DRESS[rng.integers(len(ARTICLE_DRESS))]
    words, tags = sorted(OTHER_WORDS), sorted(OTHER_TAGS - {"header"})
    texts = [b.text for b, label in zip(page, labels) if label]
    out: list[tuple[Block, int]] = []

    def strange() -> None:
        box = ((BOXES[rng.integers(len(BOXES))], frozenset({words[rng.integers(len(words))]})),) if rng.random() < 0.6 else ((tags[rng.integers(len(tags))], frozenset()),)
        inside = dress if rng.random() < 0.5 else ()
        for _ in range(rng.integers(1, 4)):
            leaf = (OTHER_LEAVES[rng.integers(len(OTHER_LEAVES))], frozenset())
            out.append((Block(texts[rng.integers(len(texts))], chain(*outer, *inside, *box, leaf)), 0))

    strange()
    for block, label in zip(page, labels):
        if not label:
            out.append((block, 0))
            continue
        if rng.random() < 0.5:
            strange()
        leaf = (ARTICLE_LEAVES[rng.integers(len(ARTICLE_LEAVES))], frozenset())
        out.append((Block(block.text, chain(*outer, *dress, leaf), block.linked), 1))
    strange()
    return [b for b, _ in out], [label for _, label in out]


def undressed(page: list[Block]) -> list[Block]:
    """A page without the names that declare: plain containers, plain leaves."""
    plain = frozenset("p li td dd dt blockquote pre a h1 h2 h3 h4 h5 h6".split())
    return [Block(b.text, chain(("html", frozenset()), ("body", frozenset()), ("div", frozenset()), (b.element.tag if b.element.tag in plain else "div", frozenset())), b.linked) for b in page]


def lessons(page: str | None, draw: int, most: int = SAMPLE_BLOCKS) -> list[Lesson]:
    """What a page teaches: as it is, some times in other dress, once undressed.

    Of a page of more than ``most`` blocks, so many in a row teach, from a place
    that the draw gives.
    """
    found = blocks(page)
    labels = labels_of(found)
    at = draw % max(len(found) - most + 1, 1)
    found, labels = found[at : at + most], labels[at : at + most]
    if not found:
        return []
    rng = np.random.default_rng(draw & 0xFFFFFFFFFFFFFFFF)
    others = [dressed(found, labels, rng) for _ in range(DRESSED)] if any(labels) else []
    return [lesson(p, la) for p, la in [(found, labels), *others, (undressed(found), labels)]]


def train(pages: list[str]) -> ChainField:
    """Fit on pages of a sample."""
    return ChainField().fit([x for draw, page in enumerate(pages) for x in lessons(page, draw)])


def main_text(field: ChainField, page: str | None) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, label in zip(found, field.decode(found)) if label)


def _teach(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(draw, lessons) of each row (draw, html)."""
    kind = pa.list_(pa.struct([("flat", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("labels", pa.list_(pa.int32()))]))
    for batch in batches:
        draws, pages = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        taught = [[{"flat": f, "sizes": n, "labels": g} for f, n, g in lessons(page, draw, most)] for draw, page in zip(draws, pages)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(taught, kind)], names=["draw", "lessons"])


def sample_lessons(pages: DataFrame, html_col: str, n: int = SAMPLE_PAGES, most: int = SAMPLE_BLOCKS) -> list[Lesson]:
    """Lessons of at most ``n`` distinct pages of least hash, ``most`` blocks of each.

    The tasks parse the pages and send numbers of features, so what the driver
    holds is bounded however large the pages are. Hashes are chosen first.
    """
    rows = pages.where(F.col(html_col).isNotNull()).select(F.xxhash64(html_col).alias("draw"), F.col(html_col).alias("html"))
    # At most n hashes: a bounded broadcast.
    wanted = least_rows(rows.select("draw"), n)
    kind = "draw long, lessons array<struct<flat:array<int>,sizes:array<int>,labels:array<int>>>"
    found = rows.join(F.broadcast(wanted), "draw").mapInArrow(lambda batches: _teach(batches, most), kind)
    found = found.groupBy("draw").agg(F.min("lessons").alias("lessons")).orderBy("draw").collect()
    return [tuple(np.array(x[k], np.int32) for k in ("flat", "sizes", "labels")) for r in found for x in r["lessons"]]


def _extract(batches: Iterator[pa.RecordBatch], shared, html_col: str, keep: list[str]) -> Iterator[pa.RecordBatch]:
    field = ChainField(*shared.value)
    for batch in batches:
        names = batch.schema.names
        texts = [main_text(field, page) for page in batch.column(names.index(html_col)).to_pylist()]
        columns = [batch.column(names.index(n)) for n in keep]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*keep, "text", "n_chars"])


def extract(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE_PAGES) -> DataFrame:
    """The columns of ``pages`` but the html, with text and n_chars of every row.

    Character references are decoded, white space inside a block becomes one
    space, blocks are joined in page order by one line feed. A null or empty
    page, or one without article blocks, has an empty text. Malformed markup is
    read as far as it goes. Where no page declares an article, the field learns
    from what looks like prose. Repeated rows get equal texts. Columns text and
    n_chars of ``pages`` are replaced.
    """
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    field = ChainField().fit(sample_lessons(pages, html_col, sample))
    shared = pages.sparkSession.sparkContext.broadcast((field.state, field.step))
    base = clashing(pages, ["text", "n_chars"])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in base.schema if f.name != html_col] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return base.mapInArrow(lambda batches: _extract(batches, shared, html_col, keep), schema)
