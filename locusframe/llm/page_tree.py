"""One page as a tree: elements with their presentation, and blocks of text in page order.

The tokens of HTML are read in one pass that never looks back, so a page costs
time in proportion to its length. End tags that are left out are supplied for
paragraphs, list items and table parts; formatting elements are transparent,
however they overlap. Elements nested deeper than MAX_DEPTH hang from the last
level, with their whole text.
"""

from __future__ import annotations

import html
import re

import xxhash

MAX_DEPTH = 256

# Elements and words of HTML and of its common authoring conventions.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol "
    "optgroup option p pre search section select summary table tbody td template tfoot th thead tr ul".split()
)
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that are no part of an article, and those that are none outside of it.
NOISE_TAGS = frozenset("head nav footer aside noscript template button select dialog menu search object svg canvas audio video map".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
NOISE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager topbar header masthead banner footer colophon copyright sidebar aside widget related recommended trending notice cookie cookies consent gdpr popup modal "
    "overlay newsletter subscribe subscription paywall alert ad ads adv advert adverts advertisement advertisements adsbygoogle sponsor sponsored promo promotion promoted form search login signup comment comments disqus respond "
    "reply replies discussion share sharing social".split()
)
#: Words that make an article element a reader's comment or an advert.
COMMENT_WORDS = frozenset("comment comments reply replies respond ad ads advert advertisement sponsored promo promoted related".split())
_NEGATES = frozenset("no not with without has".split())
_HEADINGS = frozenset("article post entry title heading headline".split())
_CLOSES_P = BLOCKS - {"body", "button", "caption", "head", "html", "noscript", "optgroup", "option", "select", "tbody", "td", "template", "tfoot", "th", "thead", "tr"}
#: What an element ends that is still open, and where the search for it stops.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}

_TAG = re.compile(r"<(?:/(?P<end>[A-Za-z][^\s/>]*+)[^>]*+(?:>|\Z)|(?P<start>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?P<whole>>|\Z)|[!?/][^>]*+(?:>|\Z))")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"[0-9]+")
_INVISIBLE = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_RAW_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}

KEEP, BY_TAG, BY_CLASS = 0, 1, 2


class Node:
    __slots__ = ("tag", "parent", "key", "noise", "region", "style", "last", "begin", "links")

    def __init__(self, tag: str, parent: Node | None, label: str, noise: int, region: bool, begin: int = 0):
        self.tag, self.parent, self.noise, self.region, self.begin = tag, parent, noise, region, begin
        self.key = xxhash.xxh3_128_digest((parent.key if parent else b"") + label.encode())  # the path of presentations from the root
        self.style, self.last = b"", ""  # children's presentations, runs of the same taken as one
        self.links: list[str] = []


def _noise_of(tag: str, attrs: dict[str, str], inside: bool) -> int:
    if tag in NOISE_TAGS or "hidden" in attrs or attrs.get("role", "").lower() in NOISE_ROLES or _INVISIBLE.search(attrs.get("style", "")):
        return BY_TAG
    if tag == "form" or tag == "header" and not inside:
        return BY_CLASS
    if tag in ("html", "body", "main"):
        return KEEP
    for name in (*attrs.get("class", "").split(), attrs.get("id", "")):
        words = [w.lower() for w in _WORD.findall(name)]
        for before, word in zip(["", *words], words, strict=False):
            if word in (COMMENT_WORDS if tag == "article" else NOISE_WORDS) and before not in _NEGATES and not (word == "header" and (inside or _HEADINGS.intersection(words))):
                return BY_CLASS
    return KEEP


class Page:
    """nodes in page order and blocks (node, text), white space as one blank; `site` stands at the root of all paths."""

    def __init__(self, text: str, site: str = ""):
        root = Node("", None, site + "\n", KEEP, False)
        self.nodes, self.blocks = [root], []
        self._stack, self._buffer = [root], []
        self._open: dict[str, int] = {}
        self._skip: tuple[str, int] | None = None  # a formatting element that is noise, and how often its like is open in it
        self._read(text or "")
        self._flush()
        self.regions = self._regions()

    def _flush(self) -> None:
        if self._buffer:
            words = html.unescape("".join(self._buffer)).split()
            self._buffer.clear()
            if words:
                self.blocks.append((self._stack[-1], " ".join(words)))

    def _pop_to(self, depth: int) -> None:
        self._flush()
        for node in self._stack[depth:]:
            self._open[node.tag] -= 1
        del self._stack[depth:]
        self._skip = None

    def _push(self, tag: str, attrs: dict[str, str]) -> None:
        self._flush()
        stack = self._stack
        if tag in _CLOSES_P and stack[-1].tag == "p":
            self._pop_to(len(stack) - 1)
        if tag in _ENDS:
            ended, stops = _ENDS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in stops:
                    break
                if stack[i].tag in ended:
                    self._pop_to(i)
                    break
        if len(stack) >= MAX_DEPTH:
            self._pop_to(MAX_DEPTH - 1)
        parent = stack[-1]
        inside = self._open.get("article", 0) + self._open.get("main", 0) > 0
        noise = _noise_of(tag, attrs, inside)
        region = tag in ("article", "main") or attrs.get("role", "").lower() in ("main", "article") or "articlebody" in attrs.get("itemprop", "").lower()
        if tag == "article" and self._open.get("article") and any(x.tag == "article" and x.begin < len(self.blocks) for x in stack):
            noise = noise or BY_CLASS  # an article after the text of one that is open is a comment on it
        label = f"{tag}#{_DIGITS.sub('0', attrs.get('id', ''))}.{' '.join(sorted(_DIGITS.sub('0', attrs.get('class', '')).split()))}"
        if parent.last != label:
            parent.last, parent.style = label, xxhash.xxh3_64_digest(parent.style + label.encode())
        node = Node(tag, parent, label, noise, region, len(self.blocks))
        self.nodes.append(node)
        if tag != "hr":
            stack.append(node)
            self._open[tag] = self._open.get(tag, 0) + 1

    def _read(self, text: str) -> None:
        at, n, buffer = 0, len(text), self._buffer
        while at < n:
            lt = text.find("<", at)
            if lt < 0:
                lt = n
            if lt > at and not self._skip:
                buffer.append(text[at:lt])
            if lt == n:
                break
            if text.startswith("<!--", lt):
                end = lt + 4 if text.startswith((">", "->"), lt + 4) else text.find("-->", lt + 4)
                at = n if end < 0 else text.index(">", end) + 1
                continue
            m = _TAG.match(text, lt)
            if m is None:  # a sign that opens nothing
                if not self._skip:
                    buffer.append("<")
                at = lt + 1
                continue
            at = m.end()
            if m["start"] is not None:
                if m["whole"]:
                    at = self._start(m["start"].lower(), m["attrs"], text, at)
            elif m["end"] is not None:
                self._end(m["end"].lower())

    def _start(self, tag: str, written: str, text: str, at: int) -> int:
        if tag in RAW:
            m = _RAW_ENDS[tag].search(text, at)
            return text.find(">", m.end()) + 1 or len(text) if m else len(text)
        if tag == "br":
            if not self._skip:
                self._buffer.append("\n")
            return at
        attrs = {}
        if written.strip(" /\t\r\n\f"):
            for a in _ATTRIBUTE.finditer(written):
                attrs.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")
        if tag in BLOCKS:
            self._push(tag, attrs)
        elif tag in VOID:
            if not self._skip and attrs.get("src"):
                self._stack[-1].links.append(attrs["src"])
        elif self._skip:
            if tag == self._skip[0]:
                self._skip = tag, self._skip[1] + 1
        else:
            if attrs and _noise_of(tag, attrs, False) or tag in NOISE_TAGS:
                self._skip = tag, 1
            elif attrs.get("href"):
                self._stack[-1].links.append(attrs["href"])
        return at

    def _end(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
            if self._open.get(tag):
                depth = len(self._stack) - 1
                while self._stack[depth].tag != tag:
                    depth -= 1
                self._pop_to(depth)
        elif self._skip and tag == self._skip[0]:
            self._skip = (tag, self._skip[1] - 1) if self._skip[1] > 1 else None

    def _regions(self) -> set[int]:
        """Nodes that hold the main text: articles before main elements, those outside noise before those in containers that only a name makes noise; all if there is none."""
        worst: dict[int, int] = {}  # noise on the way to a node, itself included: 0 none, 1 by element, 2 by name only
        for node in self.nodes:
            above = worst[id(node.parent)] if node.parent else KEEP
            worst[id(node)] = BY_TAG if BY_TAG in (above, node.noise) else max(above, node.noise)
        filled: set[int] = set()
        for node, _ in self.blocks:
            while node is not None and id(node) not in filled:
                filled.add(id(node))
                node = node.parent
        found = [x for x in self.nodes if x.region and x.noise == KEEP and id(x) in filled]
        for allowed in (KEEP, BY_CLASS):
            fit = [x for x in found if worst[id(x)] == allowed]
            if fit:
                articles = [x for x in fit if x.tag != "main"] or fit
                for x in articles:
                    up = x.parent
                    while up is not None:  # what holds the article is no noise
                        up.noise = KEEP
                        up = up.parent
                return {id(x) for x in articles}
        return {id(self.nodes[0])}

    def main_blocks(self) -> list[tuple[Node, str, bool]]:
        """Blocks that presentation does not rule out, and whether each is running text of an article; where nothing but forms is left, these count as text."""
        for forms in (False, True):
            state: dict[int, tuple[bool, bool]] = {}  # kept, inside a region
            for node in self.nodes:
                kept, inside = state[id(node.parent)] if node.parent else (True, False)
                noise = node.noise and not (forms and node.tag == "form")
                state[id(node)] = kept and not noise, inside or id(node) in self.regions
            out = [(node, text, self.nodes[0] is not node and id(self.nodes[0]) not in self.regions and node.tag in _RUNNING) for node, text in self.blocks if state[id(node)] == (True, True)]
            if out:
                return out
        return []


_RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd td th caption figcaption article main".split())
