"""A page as a table of nodes, with what the classifier sees of each.

The reader follows the rules of HTML that matter for text: void and raw-text elements, end tags that may
be left out, stray end tags, comments, character references. Quotes count after an equals sign only, and
a tag or comment that never ends takes the rest of the page, as in a browser. It makes flat lists, in page
order, in time that grows with the page's length and not faster: patterns never go back, and the nearest
open element of a name is known without a search.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterable

import numpy as np

#: Elements of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template svg iframe".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption legend summary dd dt li".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("html body table td th ul ol dl article section div nav main aside header footer form blockquote".split())
NEVER = frozenset("script style noscript template svg iframe textarea title head select option button input".split())
TAGS = "html body header footer nav main article section aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th figure figcaption blockquote pre form a b i span label".split()

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>=]|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?)*+)(?:>|\Z)|([^<]++|<)", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(?:class|id|role|itemprop|aria-label|rel|data-[\w-]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}|[A-Z][a-z]+")
_NAMED = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_MAY_HIDE = re.compile(r"hidden|display", re.I)
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_SPACE = re.compile(r"\s+")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
HASHED = 64
#: Nodes whose features are made at a time.
ROWS = 20_000


class Page:
    """``tag``, ``parent`` and ``tokens`` (hashed, of the attributes) of nodes, and ``pieces``: text with its
    node, in page order. Node 0 is the root. A hidden node has a token more: that decides nothing here."""

    def __init__(self, source: str):
        self.tag, self.parent, self.tokens = ["#root"], [-1], [0]
        self.pieces: list[tuple[int, str]] = []
        self.starts = [0]  # where each node's tag begins in the source
        self.open: list[int] = [0]
        self.at: dict[str, list[int]] = {}  # places in open, by name
        self.scopes: list[int] = []
        at, n = 0, len(source)
        match = _TOKEN.match
        while at < n:
            m = match(source, at)
            at = m.end()
            if m[4] is not None:
                self.pieces.append((self.open[-1], m[4]))
                continue
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._close((tag,), tag in BLOCK)
                continue
            if tag in CLOSES_P:
                self._close(("p",))
            elif tag in SIBLINGS:
                self._close(SIBLINGS[tag])
            node = len(self.tag)
            attributes = m[3]
            self.tag.append(tag), self.parent.append(self.open[-1]), self.starts.append(m.start())
            self.tokens.append(_tokens(attributes) if attributes else 0)
            if tag in BLOCK or tag == "br":
                self.pieces.append((node, ""))  # where a block or line begins
            if tag in RAW and not (tag == "svg" and _closed(attributes)):
                end = _RAW_END[tag].search(source, at)
                at = end.end() if end else n
            elif tag not in RAW and tag not in VOID and not (attributes.endswith("/") and tag not in BLOCK):
                self.at.setdefault(tag, []).append(len(self.open))
                if tag in SCOPE:
                    self.scopes.append(len(self.open))
                self.open.append(node)

    def _close(self, tags: Iterable[str], through: bool = False) -> None:
        """Close the nearest open element of these names, with what is open in it; but for ``through``,
        not beyond a scope."""
        k = max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)
        if not k or not (through or k >= (self.scopes[-1] if self.scopes else 0)):
            return
        for node in reversed(self.open[k:]):
            self.at[self.tag[node]].pop()
        del self.open[k:]
        while self.scopes and self.scopes[-1] >= k:
            self.scopes.pop()


def _closed(attributes: str) -> bool:
    """Whether a tag ends in a slash that isn't the end of a value without quotes."""
    if not attributes.endswith("/"):
        return False
    cut = max(attributes.rfind(c) for c in " \t\n\r\f\"'")
    return "=" not in attributes[cut + 1 :] and not (attributes[cut : cut + 1].isspace() and attributes[: cut + 1].rstrip().endswith("="))


def _tokens(attributes: str) -> int:
    """Hashed attribute tokens as a set of bits."""
    out = 0
    for a, b, c in _ATTRIBUTE.findall(attributes):
        for part in _PART.findall(a or b or c):
            out |= 1 << zlib.crc32(part.lower().encode()) % HASHED
    if _MAY_HIDE.search(attributes) and _hidden(attributes):
        out |= 1 << zlib.crc32(b"hidden") % HASHED
    return out


def _hidden(attributes: str) -> bool:
    for name, a, b, c in _NAMED.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _NO_DISPLAY.search(value):
            return True
    return False


#: Tags that matter for all that stands below them.
REGIONS = "nav header footer aside form article main section ul table blockquote figure".split()
N_FEATURES = len(TAGS) + 1 + 2 * HASHED + len(REGIONS) + 15


def _bits(masks: list[int]) -> np.ndarray:
    return np.unpackbits(np.array(masks, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


class Features:
    """Of every node: its tag, hashed attribute tokens of itself and of its ancestors, and statistics of its
    subtree, its depth and its siblings. Rows are made when they are asked for."""

    def __init__(self, page: Page):
        self.tag, self.own, self.above, self.regions, self.stats = _measured(page)

    def __len__(self) -> int:
        return len(self.tag)

    def rows(self, a: int, b: int) -> np.ndarray:
        out = np.zeros((b - a, N_FEATURES), np.float32)
        base = len(TAGS) + 1
        out[np.arange(b - a), self.tag[a:b]] = 1
        out[:, base : base + HASHED] = _bits(self.own[a:b])
        out[:, base + HASHED : base + 2 * HASHED] = _bits(self.above[a:b])
        for k in range(len(REGIONS)):
            out[:, base + 2 * HASHED + k] = self.regions[a:b] >> k & 1
        out[:, -self.stats.shape[1] :] = self.stats[a:b]
        return out


def features(page: Page) -> np.ndarray:
    every = Features(page)
    return every.rows(0, len(every))


def _measured(page: Page) -> tuple[np.ndarray, list[int], list[int], np.ndarray, np.ndarray]:
    n = len(page.tag)
    parent = np.array(page.parent)
    own = np.zeros((n, 4))  # characters, characters in links, commas and stops, words
    index = {t: i for i, t in enumerate(TAGS)}
    tag = np.array([index.get(t, len(TAGS)) for t in page.tag])
    link = np.zeros(n, bool)
    depth, above = np.zeros(n), np.zeros(n, np.int64)
    tokens = [0] * n
    regions = {t: 1 << k for k, t in enumerate(REGIONS)}
    for i in range(1, n):
        p = page.parent[i]
        link[i] = link[p] or page.tag[i] == "a"
        depth[i] = depth[p] + 1
        above[i] = above[p] | regions.get(page.tag[p], 0)
        tokens[i] = tokens[p] | page.tokens[p]
    for node, text in page.pieces:
        if text and page.tag[node] not in NEVER:
            size = len(text.strip())
            own[node] += (size, size * link[node], text.count(",") + text.count(". ") + text.count(".\n"), text.count(" ") + bool(size))
    below = own.copy()
    count = np.ones((n, 4))  # nodes, links, paragraphs, items of lists and forms
    count[:, 1] = [t == "a" for t in page.tag]
    count[:, 2] = [t == "p" for t in page.tag]
    count[:, 3] = [t in ("li", "input", "select", "button", "label") for t in page.tag]
    for i in range(n - 1, 0, -1):
        below[parent[i]] += below[i]
        count[parent[i]] += count[i]
    total = max(1.0, below[0, 0])
    children = np.bincount(parent[1:], minlength=n)
    nth = np.zeros(n)
    seen: dict[int, int] = {}
    for i in range(1, n):
        nth[i] = seen.get(parent[i], 0)
        seen[parent[i]] = nth[i] + 1
    around = below[parent, 0] - below[:, 0]
    start = np.cumsum(own[:, 0]) - own[:, 0]
    size = below[:, 0]
    stats = [
        np.log1p(size), below[:, 1] / np.maximum(size, 1), below[:, 2] / np.maximum(below[:, 3], 1), size / count[:, 0], size / total,
        np.log1p(count[:, 1]), np.log1p(count[:, 2]), np.log1p(count[:, 3]), depth, children, nth / np.maximum(children[parent], 1),
        around / np.maximum(below[parent, 0], 1), start / total, below[:, 3] / np.maximum(count[:, 0], 1), link,
    ]
    return tag, page.tokens, tokens, above, np.stack(stats, 1)


def texts(page: Page, keep: np.ndarray) -> list[str]:
    """The blocks of text of the kept nodes, in page order."""
    out, parts = [], []
    bare = [t in NEVER for t in page.tag]
    for i in range(1, len(bare)):
        bare[i] = bare[i] or bare[page.parent[i]]
    block = [0] * len(bare)
    for i in range(1, len(bare)):
        block[i] = i if page.tag[i] in BLOCK else block[page.parent[i]]
    current = 0

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            out.append(text)
        parts.clear()

    for node, text in page.pieces:
        if page.tag[node] == "br" and not text:
            parts.append(" ")
            continue
        if block[node] != current:
            flush()
            current = block[node]
        if text and keep[node] and not bare[node]:
            parts.append(text)
    flush()
    return out
