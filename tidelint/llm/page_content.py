"""Main text of web pages by a tree-structured graphical model.

Every block element of a page is a node with one of three states: boilerplate,
content, or mere structure around both. Its tag, its class and role, the amount
of its own text and the share of links below it give node potentials; a parent
and its child share a pair potential. Both are counts over labelled pages.
Sum-product messages, leaves to root and back, give exact marginals. The text of
nodes that are rather content than boilerplate is the main text.

Pages are read whole and each by itself; nodes of one batch are handled level by
level. Messages are scaled, so deep or wide trees do not underflow.

Null and empty html give an empty text. Tags that are not closed, not opened or
not nested are read as browsers do for blocks. What is never shown (scripts, menus of
forms, drawings) is left out up to its end tag; without one it ends at the next tag
that may not stand in it or with the block around it, so that no open tag hides the
rest of a page. A head ends at the first tag or text that may not stand in it.
Formulas are text. Repeated rows are read each.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidelint.llm.labelled_pages import PAGES

BOILERPLATE, CONTENT, STRUCTURE = range(3)

# HTML's block elements, elements whose text is never shown as text, and words that sites use in class names.
_BLOCKS = frozenset("""html body article main section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th
caption blockquote pre figure figcaption form fieldset details summary address hr dialog menu center""".split())
_HIDDEN = frozenset("head template svg object select button canvas audio video annotation annotation-xml".split())
_RAW = frozenset("script style title textarea iframe noscript".split())
_CODE = frozenset("script style".split())
_CONTROLS = frozenset(("button", "select"))
_IN_HEAD = frozenset("base basefont bgsound link meta template html head".split()) | _RAW
# HTML tags that end a drawing which was not closed.
_OUTSIDE = frozenset("body article main section nav aside header footer p h1 h2 h3 h4 h5 h6 table form blockquote".split())   # no part of a control or of a frame
_OUT_OF_SVG = _BLOCKS | frozenset("b big br code em embed i img nobr ruby s small span strong strike sub sup tt u var".split())
_TAGS = ["article", "main", "nav", "masthead", "header", "footer", "aside", "form", "section", "div", "p", "list", "li", "heading", "body", "quote", "table", "other"]
_GROUP = {"ul": "list", "ol": "list", "dl": "list", "dt": "li", "dd": "li", "html": "body", "blockquote": "quote", "pre": "quote", "figure": "quote",
          "figcaption": "quote", "menu": "nav", "dialog": "aside", "fieldset": "form", **{f"h{i}": "heading" for i in range(1, 7)},
          **{t: "table" for t in "table thead tbody tfoot tr td th caption".split()}}
_AGAINST = re.compile(r"(?:^|[\s_-])(?:ads?|adv|adverts?|advertis(?:ing|ements?)|banners?|sponsor(?:s|ed)?|promos?|promot(?:ed|ions?)|nav(?:bar|igation|menu|s)?|menus?|breadcrumbs?|side-?bar|"
                      r"foot(?:er)?|comments?|repl(?:y|ies)|disqus|sharing|cookies?|consent|pop-?up|modal|newsletters?|subscri(?:be|ption)s?|recommend(?:ed|ations?)|widgets?|login|copyright|skip|toolbar|pager|logo)(?:$|[\s_-])")
# Words that name a part of the site on a container, but may name what a paragraph is about.
_SITE = re.compile(r"(?:^|[\s_-])(?:responses?|share|social|notices?|related|search|legal|pagination)(?:$|[\s_-])")
_PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table caption figure figcaption".split())
_FOR = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|main|body|story|text|page)(?:$|[\s_-])")
_ROLES = {"navigation": 1, "banner": 1, "contentinfo": 1, "complementary": 1, "search": 1, "dialog": 1, "alert": 1, "form": 1, "menu": 1, "main": 2, "article": 2}

_TOKEN = re.compile(r"<!--(?:.*?-->|.*)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>\"']|\"[^\"]*\"|'[^']*')*))>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|y)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}


@lru_cache(100_000)
def _marks(attributes: str) -> tuple[int, int, str]:
    """What class and id say (0 nothing, 1 against, 2 for content, 3 against if on a container), what the role says, and a training label."""
    named, role, label = "", 0, ""
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "").lower()
        if name.lower() == "role":
            role = _ROLES.get(value, 0)
        elif name.lower() == "y":
            label = value
        else:
            named += " " + value
    return 1 if _AGAINST.search(named) else 3 if _SITE.search(named) else 2 if _FOR.search(named) else 0, role, label


class Page:
    """Block nodes of one page in page order, and its pieces of text with the node each belongs to."""

    def __init__(self, source: str) -> None:
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.seen: list[tuple[int, int, int]] = []          # tag group, names, role
        self.label: list[str] = []
        self.size: list[int] = []
        self.linked: list[int] = []
        self.texts: list[tuple[int, str]] = []
        self._open: list[tuple[str, int]] = []
        self._places: dict[str, list[int]] = {}             # of the open elements, by tag
        self._run: list[str] = []
        self._link = False
        self._start("html", "")
        self._read(source)
        self._flush()

    def _start(self, tag: str, attributes: str) -> None:
        names, role, label = _marks(attributes) if attributes.strip() else (0, 0, "")
        if names == 3:
            names = 0 if tag in _PARAGRAPHS else 1
        group = _GROUP.get(tag, tag)
        if tag == "header" and not any(map(self._places.get, ("article", "main", "section"))):
            group = "masthead"                              # of the page, not of a text
        self.parent.append(self._open[-1][1] if self._open else -1)
        self.depth.append(len(self._open))
        self.seen.append((_TAGS.index(group) if group in _TAGS else len(_TAGS) - 1, names, role))
        self.label.append(label)
        self.size.append(0)
        self.linked.append(0)
        self._places.setdefault(tag, []).append(len(self._open))
        self._open.append((tag, len(self.parent) - 1))

    def _flush(self) -> None:
        text = " ".join("".join(self._run).split())
        self._run = []
        if text:
            node = self._open[-1][1]
            self.texts.append((node, text))
            self.size[node] += len(text)

    def _place(self, tags: set[str]) -> int:
        """Where the innermost open element of `tags` is, 0 if there is none."""
        return max((self._places[t][-1] for t in tags if self._places.get(t)), default=0)

    def _close(self, tags: set[str], until: set[str]) -> None:
        """Closes the open element of `tags` that no element of `until` holds."""
        at = self._place(tags)
        if at and at > self._place(until):
            self._flush()
            while len(self._open) > at:
                self._places[self._open.pop()[0]].pop()

    def _text(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        self._run.append(text)
        if self._link:
            self.linked[self._open[-1][1]] += len(text.strip())

    def _read(self, source: str) -> None:
        hidden: _Hidden | None = None
        ends: dict[str, int] = {}                           # next end tags of raw elements, found once
        at = 0
        while at < len(source):
            found = _TOKEN.search(source, at)
            raw = source[at:found.start() if found else len(source)]
            if hidden and hidden.tag == "head" and raw.strip():
                hidden = None
            if raw and not hidden:
                self._text(raw)
            if found is None:
                break
            at = found.end()
            end, tag, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
            if not tag:
                continue
            tag, empty = tag.lower(), attributes.endswith("/")
            if hidden and hidden.left_by(tag, bool(end), empty, self._places):
                shown, hidden = hidden.tag == tag, None
                if shown:
                    continue
            if tag in _RAW:
                self._run.append(" ")
                if not end and not empty:
                    at = _after(source, tag, at, ends)
            elif hidden:
                continue
            elif tag in _HIDDEN:
                self._run.append(" ")
                if not end and not empty:
                    hidden = _Hidden(tag, _closed(source, tag, at, ends))
            elif tag == "a":
                self._link = not end
            elif tag in ("br", "img", "input"):
                self._run.append(" ")
            elif tag in _BLOCKS:
                self._link = False
                if end:
                    self._close({tag}, set())
                    self._flush()
                elif tag not in ("html", "body") or tag == "body" and not self._places.get("body"):
                    self._flush()
                    self._close({"p"}, {"table", "td", "th"})
                    if tag in _CLOSES:
                        self._close(*_CLOSES[tag])
                    if tag != "hr":
                        self._start(tag, attributes)


def _end(source: str, tag: str, at: int, ends: dict[str, int]) -> int:
    """Behind the next end tag of `tag` from `at`, or beyond the page."""
    if ends.get(tag, -1) <= at:
        close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
        ends[tag] = close.end() if close else len(source) + 1
    return ends[tag]


def _after(source: str, tag: str, at: int, ends: dict[str, int]) -> int:
    """Where the raw element `tag`, whose content starts at `at`, ends. One without an end tag is all there is left if code, else empty."""
    end = _end(source, tag, at, ends)
    return end if end <= len(source) else len(source) if tag in _CODE else at


def _closed(source: str, tag: str, at: int, ends: dict[str, int]) -> bool:
    """Whether an element whose content starts at `at` has its end tag. A control holds none of its kind, so a later one's end tag is not its own."""
    end = _end(source, tag, at, ends)
    return end <= len(source) and not (tag in _CONTROLS and re.compile(rf"<{tag}\b", re.I).search(source, at, end))


class _Hidden:
    """An open element whose content is not shown."""

    def __init__(self, tag: str, closed: bool) -> None:
        self.tag, self.closed, self.level = tag, closed, 1
        self.inside: dict[str, int] = {}                    # blocks that were opened in it

    def left_by(self, tag: str, end: bool, empty: bool, around: dict[str, list[int]]) -> bool:
        """Whether a tag ends it: its own end tag, a tag that may not stand in it, or the end of a block around it."""
        if self.tag == "head":
            return tag in ("head", "body") if end else tag not in _IN_HEAD
        if tag == self.tag:
            if tag not in _CONTROLS:
                self.level += -1 if end else not empty
            return end and (not self.level or tag in _CONTROLS)
        if self.closed and self.tag == "template":
            return False
        if end:
            if tag in _BLOCKS and not self.inside.get(tag):
                return bool(around.get(tag)) or tag == "p" and self.tag == "svg"
            if tag in self.inside:
                self.inside[tag] -= 1
            return False
        if self.tag == "svg" and not self.inside.get("foreignobject"):
            if tag == "foreignobject":
                self.inside[tag] = 1
            return tag in _OUT_OF_SVG
        if tag in _OUTSIDE and not self.closed:
            return True
        if tag in _BLOCKS or tag == "foreignobject":
            self.inside[tag] = self.inside.get(tag, 0) + 1
        return False


class Trees:
    """The nodes of several pages, level by level."""

    def __init__(self, pages: list[Page]) -> None:
        first = np.cumsum([0, *(len(p.parent) for p in pages)])
        self.first = first
        self.parent = np.concatenate([np.asarray(p.parent) + np.where(np.asarray(p.parent) < 0, 0, f) for p, f in zip(pages, first, strict=False)])
        depth = np.concatenate([p.depth for p in pages])
        by_depth = np.argsort(depth, kind="stable")
        self.levels = np.split(by_depth, np.cumsum(np.bincount(depth))[:-1])
        size, linked = (np.concatenate([getattr(p, name) for p in pages]).astype(float) for name in ("size", "linked"))
        below, links = size.copy(), linked
        for level in reversed(self.levels[1:]):
            np.add.at(below, self.parent[level], below[level])
            np.add.at(links, self.parent[level], links[level])
        share = links / np.maximum(below, 1)
        tag, names, role = np.concatenate([np.asarray(p.seen).reshape(-1, 3) for p in pages]).T
        #: Node features, each a small number.
        self.seen = np.stack([tag, names, role, np.digitize(size, (1, 20, 80, 250)), np.digitize(share, (0.2, 0.5))])
        self.tag = tag

    def beliefs(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log beliefs of each node; log potentials with all messages from children; the message to the parent."""
        own = sum(table[values] for table, values in zip(model.nodes, self.seen, strict=True))
        inward = own.copy()
        message = np.zeros_like(own)
        for level in reversed(self.levels[1:]):
            message[level] = _through(inward[level], model.pairs)
            np.add.at(inward, self.parent[level], message[level])
        belief = inward.copy()
        for level in self.levels[1:]:
            belief[level] = inward[level] + _through(belief[self.parent[level]] - message[level], model.pairs.T)
        return belief, inward, message

    def marginals(self, model: Model) -> np.ndarray:
        """Probabilities of the states of each node."""
        return _normal(self.beliefs(model)[0])


def _normal(log: np.ndarray) -> np.ndarray:
    p = np.exp(log - log.reshape(len(log), -1).max(1).reshape(-1, *[1] * (log.ndim - 1)))
    return p / p.reshape(len(p), -1).sum(1).reshape(-1, *[1] * (log.ndim - 1))


def _through(log: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Log messages of nodes through log pair potentials, scaled to at most 0."""
    top = log.max(1, keepdims=True)
    out = np.log(np.exp(log - top) @ np.exp(pairs).T)
    return out - out.max(1, keepdims=True)


class Model:
    """Log node potentials by feature and log pair potentials (parent, child).

    Fitted to labelled pages by their likelihood: each step moves the potentials
    by the counts that the labels show less those that the marginals expect, with
    a penalty on their squares.
    """

    def __init__(self, sources: list[str], steps: int = 300, penalty: float = 0.1) -> None:
        pages = [Page(s) for s in sources]
        trees = Trees(pages)
        states = np.concatenate([_states(p) for p in pages])
        self.nodes = [np.zeros((n, 3)) for n in (len(_TAGS), 3, 3, 5, 3)]
        self.pairs = np.zeros((3, 3))
        child = np.concatenate(trees.levels[1:])
        parent = trees.parent[child]
        shown = np.eye(3)[states]
        seen_pairs = np.zeros((3, 3))
        np.add.at(seen_pairs, (states[parent], states[child]), 1.0)
        weights = [*self.nodes, self.pairs]
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        for step in range(1, steps + 1):
            belief, inward, message = trees.beliefs(self)
            wrong = shown - _normal(belief)
            joint = _normal((belief[parent] - message[child])[:, :, None] + self.pairs + inward[child][:, None, :])
            slopes = []
            for table, values in zip(self.nodes, trees.seen, strict=True):
                slope = np.zeros_like(table)
                np.add.at(slope, values, wrong)
                slopes.append(slope)
            slopes.append(seen_pairs - joint.sum(0))
            for w, slope, m, v in zip(weights, slopes, first, second, strict=True):       # steps of even size for all weights
                slope = slope - penalty * w
                m += 0.1 * (slope - m)
                v += 0.01 * (slope * slope - v)
                w += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)


def _states(page: Page) -> np.ndarray:
    marks = {"b": BOILERPLATE, "c": CONTENT}
    states = np.full(len(page.parent), STRUCTURE)
    for i, (parent, label) in enumerate(zip(page.parent, page.label, strict=True)):
        states[i] = marks[label] if label in marks else states[parent] if parent >= 0 else STRUCTURE
    return states


def texts(sources: list[str], model: Model) -> list[str]:
    """Main text of each page."""
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    trees = Trees(pages)
    p = trees.marginals(model)
    keep = p[:, CONTENT] > p[:, BOILERPLATE]
    return ["\n".join([t for node, t in page.texts if keep[first + node]]) for page, first in zip(pages, trees.first, strict=False)]


def main_text(pages: DataFrame, labelled: list[str] = PAGES) -> DataFrame:
    """Per row: page_id, url, text and n_chars, its number of code points."""
    model = Model(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 100):
                part = batch.slice(low, 100)
                found = texts([x or "" for x in part.column(2).to_pylist()], model)
                yield pa.record_batch({"page_id": part.column(0), "url": part.column(1), "text": pa.array(found, pa.string()), "n_chars": pa.array(list(map(len, found)), pa.int64())})

    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
