"""Leaf blocks of raw HTML pages and the numbers that describe them."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from html import unescape
from itertools import chain

import numpy as np

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu "
    "nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
UNSEEN = frozenset("script style template noscript svg iframe title textarea canvas".split())
#: What the start of an element ends, if it is open; and the elements that keep what is outside open.
ENDS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("html body table ul ol dl div section article aside main nav header footer form select blockquote".split())

#: A quote quotes only after the = of an attribute; any other is part of a name or value, and the tag ends at its >.
_MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))?+)*+)(?:>|\Z)|</?\Z",
    re.S,
)
_NAMED = re.compile(r"(?:^|[\s\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")

#: Words that the parts around articles are made of.
FURNITURE = frozenset(
    "home about contact news sport login register sign signup search menu subscribe subscribers newsletter inbox briefing cookie cookies privacy policy terms conditions accept settings preferences consent copyright © rights reserved advertisement advertise "
    "sponsored offer sale shop cart checkout buy share tweet follow facebook twitter reply replies comment comments related popular trending recommended latest recent posts next previous prev page pages more read also like likes may "
    "categories category tags archive archives by skip content contents toc edit jump navigation up back top feedback help support careers jobs sitemap imprint accessibility download app email e-mail mail password username name send submit "
    "print views powered version changelog docs epaper notify free trial references footnotes".split()
)
PATH, LEAF, WORDS, NUMBERS = 256, 32, 64, 11
WIDTH = PATH + LEAF + WORDS + NUMBERS


class Path:
    """An open element inside its parent; places are the bits of the hashed tags and names of all that are open."""

    __slots__ = ("tag", "places", "depth")

    def __init__(self, tag: str, names: tuple[str, ...], parent: Path | None):
        self.tag = tag
        self.places = _name_places(tag, names) | (parent.places if parent else 0)
        self.depth = parent.depth + 1 if parent else 1


@dataclass
class Block:
    """A run of text between block boundaries: the innermost open element, its text, characters in links."""

    path: Path | None
    text: str
    linked: int


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order, with character references decoded and white space made single spaces.

    Markup, comments, and what scripts, styles and the other elements of UNSEEN hold are left out: of an svg nothing is
    read, of noscript neither, as it stands in for a script; text in math and object is read. Ends of
    elements may be missing, elements may be nested to any depth, and a page may break off anywhere.
    """
    page = page or ""
    out: list[Block] = []
    stack: list[Path] = []
    is_open: Counter[str] = Counter()
    held: list[str] = []
    path: Path | None = None
    linked = at = 0

    def flush() -> None:
        nonlocal held, linked
        if held:
            text = " ".join(unescape("".join(held)).split())
            if text:
                out.append(Block(path, text, min(linked, len(text))))
            held, linked = [], 0

    def close(names: tuple[str, ...], scope: frozenset[str]) -> None:
        if not any(map(is_open.get, names)):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].tag in names:
                for x in stack[i:]:
                    is_open[x.tag] -= 1
                del stack[i:]
                return
            if stack[i].tag in scope:
                return

    while at < len(page):
        mark = _MARK.search(page, at)
        stop = mark.start() if mark else len(page)
        if stop > at:
            piece = page[at:stop]
            if not held and not piece.isspace():
                path = stack[-1] if stack else None
            if held or not piece.isspace():
                held.append(piece)
            if is_open["a"]:
                linked += len(piece)
        if not mark:
            break
        at = mark.end()
        if not mark[2]:
            continue
        tag = mark[2].lower()
        if tag in BLOCK or tag in UNSEEN:
            flush()
        if mark[1]:
            close((tag,), frozenset())
            continue
        if tag in UNSEEN:
            if not mark[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in BLOCK and tag != "br":
            close(("p",), SCOPE)
        if tag in ENDS:
            close(ENDS[tag], SCOPE - {"div"} if tag == "li" else SCOPE)
        if tag not in VOID:
            named = " ".join(x for m in _NAMED.findall(mark[3]) for x in m).lower() if "=" in mark[3] else ""
            stack.append(Path(tag, tuple(_WORD.findall(named)), stack[-1] if stack else None))
            is_open[tag] += 1
    flush()
    return out


def _bucket(kind: str, name: str, size: int) -> int:
    return zlib.crc32(f"{kind}:{name}".encode("utf-8", "surrogatepass")) % size


@lru_cache(maxsize=20_000)
def _name_places(tag: str, names: tuple[str, ...]) -> int:
    places = 1 << _bucket("tag", tag, PATH)
    for n in names:
        places |= 1 << _bucket("name", n, PATH)
    return places


@lru_cache(maxsize=1000)
def _leaf(tag: str) -> int:
    return PATH + _bucket("leaf", tag, LEAF)


class _Words(dict):
    """Bucket of each word; remembers the first 100,000."""

    def __missing__(self, word: str) -> int:
        at = _bucket("word", word, WORDS)
        if len(self) < 100_000:
            self[word] = at
        return at


_words = _Words()


def features(blocks: list[Block]) -> np.ndarray:
    """One row of WIDTH numbers per block: its tag path, its hashed words, and its shape and place."""
    return features_of([blocks])[0]


def features_of(pages: list[list[Block]]) -> list[np.ndarray]:
    """features() of every page."""
    blocks = [b for page in pages for b in page]
    n = len(blocks)
    x = np.zeros((n, WIDTH), np.float32)
    if not n:
        return [x[:0] for _ in pages]
    sizes = [len(page) for page in pages]
    of_page = np.repeat(np.array(sizes), sizes)
    place = np.concatenate([np.arange(k) for k in sizes])
    bits = b"".join([(b.path.places if b.path else 0).to_bytes(PATH // 8, "little") for b in blocks])
    x[:, :PATH] = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").reshape(n, PATH)
    x[np.arange(n), [_leaf(b.path.tag if b.path else "") for b in blocks]] = 1
    texts = [b.text for b in blocks]
    words = [t.lower().split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, n)
    at = np.fromiter(map(_words.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
    hashed = np.bincount(np.repeat(np.arange(n) * WORDS, counts) + at, minlength=n * WORDS).reshape(n, WORDS)
    x[:, PATH + LEAF : PATH + LEAF + WORDS] = hashed / counts[:, None]
    size = np.fromiter(map(len, texts), np.int64, n)
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    stops = np.fromiter((len(t) - len(t.translate(None, b".,;:!?")) for t in raw), np.int64, n)
    more = (
        np.log1p(size) / 5, np.log1p(counts) / 4, np.fromiter((b.linked for b in blocks), np.int64, n) / size, stops / counts, [t[-1] in ".!?:;\"”" for t in texts],
        [sum(w.strip(".,:;!?()|") in FURNITURE for w in t) / max(1, min(len(t), 12)) for t in words], [any(c.isdigit() for c in t[:12]) for t in texts],
        place / of_page, np.fromiter((b.path.depth if b.path else 0 for b in blocks), np.int64, n) / 10, ["©" in t for t in texts], np.log1p(of_page) / 5,
    )
    x[:, -NUMBERS:] = np.stack([np.asarray(c, float) for c in more], 1)
    return np.split(x, np.cumsum(sizes)[:-1])
