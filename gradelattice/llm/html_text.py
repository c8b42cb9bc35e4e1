"""Main text of web pages by tag-path ratios.

A page becomes text blocks, each with the path of open tags from the root.  Blocks of one path form a group, whose ratios
(text per block, and text weighted by punctuation and by the share outside links) are smoothed over paths in the order
they first occur, fused by product, and thresholded; the paths above the threshold select the content, and with them the
element that holds most of it.  Blocks of that element are the article, apart from what its tags or names mark as
something else.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradelattice.llm.batches import slices, texts
from gradelattice.session import ship_package

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
PHRASING = frozenset("svg math canvas object audio video button select map noscript iframe template".split())  # inside a paragraph, though dropped
INLINE = PHRASING | frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr br".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
                     "h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
CLOSES_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
               "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
               "tfoot": {"thead", "tbody", "tr", "td", "th"}}
SCOPE = frozenset("table td th ul ol dl div article section main body html select".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements that are never part of an article, and words that name such parts in class, id or role.
DROPPED = frozenset("head nav footer aside form script style noscript template iframe noembed noframes object svg math canvas audio video "
                    "button select textarea input menu dialog title xmp map".split())
NAMES = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion outbrain taboola "
                  "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc sidebar side aside widget widgets related recommended "
                  "recommendations comment comments commentlist disqus respond reply replies discussion reviews footer header masthead topbar toolbar "
                  "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing "
                  "social search skip complementary contentinfo dialog alertdialog form hidden copyright legal disclaimer".split())
GOOD = frozenset("article main content post entry story".split())  # their headers hold a title
# Words that may stand beside a name of those and say nothing more.
STRUCTURE = frozenset("site page global top bottom left right center primary secondary fixed sticky mobile desktop outer inner wrapper wrap container box "
                      "bar block section area region panel list item items link links row col column columns slot unit group inline button buttons "
                      "icon icons text title heading body area posts articles stories news js is has the and of".split()) - {"news"}
NO, MAYBE, YES = 0, 1, 2
HOLDERS = frozenset("html body div section td th center article main blockquote fieldset details".split())

_OPEN = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"[^\s/>]+")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?|\"[^\"]*\"?|'[^']*'?")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？]")
SMOOTH = np.array([0.25, 0.5, 0.25])
THRESHOLD = 0.1  # of the largest fused ratio
SHARE = 0.3  # of the largest article's text, from which another one of the page is part of the text


def _named(name: str) -> int:
    """What one class, id or role says: its words name a part that is no article, or some of them do."""
    words = _WORD.findall(_CAMEL.sub("-", name).lower())
    hits = [w in NAMES for w in words]
    if not any(hits) or words[-1] == "header" and words[0] in GOOD:
        return NO
    return YES if all(hit or w in STRUCTURE or w in GOOD for w, hit in zip(words, hits)) else MAYBE


def _marked(tag: str, attributes: str) -> int:
    """Whether tag or names say that the element is not part of an article."""
    if tag in DROPPED:
        return YES
    out = NO
    if not attributes or tag in ("html", "body", "main"):
        return out
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return YES
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return YES
        if key in ("class", "id", "role"):
            out = max([out, *map(_named, html.unescape(value).split())])
    return out


class _Tokens:
    """Texts and tags of a page from left to right; no part of it is looked at more than a few times."""

    def __init__(self, page: str):
        self.page, self.size, self.at = page, len(page), 0
        self.last = {c: page.rfind(c) for c in "\"'>"}

    def _end(self, at: int) -> int:
        """Position behind the tag that is open at ``at``; a quote that is never closed ends nothing."""
        page, first = self.page, at
        while True:
            m = _STOP.search(page, at)
            if not m:
                break
            if m[0] == ">":
                return m.end()
            if page[at:m.start()].rstrip()[-1:] != "=" or m.end() > self.last[m[0]]:
                at = m.end()  # no value starts here
                if m.end() > self.last[m[0]]:
                    break
                continue
            at = page.index(m[0], m.end()) + 1
        return page.index(">", first) + 1 if first <= self.last[">"] else self.size

    def __iter__(self) -> Iterator[tuple[str, bool, str]]:
        """(tag, whether it closes, attributes), or ("", False, text)."""
        page = self.page
        while self.at < self.size:
            m = _OPEN.search(page, self.at)
            if not m:
                yield "", False, page[self.at:]
                return
            if m.start() > self.at:
                yield "", False, page[self.at:m.start()]
            self.at = m.end()
            if m[0] == "<!--":
                end = page.find("-->", m.end())
                self.at = end + 3 if end >= 0 else self.size
            elif m[0] in ("<!", "<?"):
                self.at = page.index(">", m.end()) + 1 if m.end() <= self.last[">"] else self.size
            else:
                name = _NAME.match(page, m.end() - 1)
                self.at = self._end(name.end())
                yield name[0].lower(), m[0][1] == "/", page[name.end():self.at - 1]

    def skip_to(self, tag: str) -> None:
        """Behind the end tag of an element whose content is no markup."""
        end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(self.page, self.at)
        self.at = end.end() if end else self.size


class Block:
    """Text in an element: ``node`` is that element, ``path`` the number of its tag path, ``linked`` the characters in links."""

    __slots__ = ("text", "node", "path", "linked", "marked")

    def __init__(self, text: str, node: int, path: int, linked: int, marked: int):
        self.text, self.node, self.path, self.linked, self.marked = text, node, path, linked, marked


class Page:
    """Text blocks in page order, and the tree of the elements around them; parents have smaller numbers."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.parent, self.kind = [-1], [""]        # of elements that are not inline
        self.paths: dict[tuple[int, str], int] = {}
        self.path_tag, self.path_parent = [""], [-1]
        self._read(_Tokens(page))

    def _path(self, above: int, tag: str) -> int:
        found = self.paths.get((above, tag))
        if found is None:
            found = self.paths[above, tag] = len(self.path_tag)
            self.path_tag.append(tag)
            self.path_parent.append(above)
        return found

    def _read(self, tokens: _Tokens) -> None:
        # tag, mark with what is around it, mark of inline elements only, element, path, whether it is inline
        stack: list[tuple[str, int, int, int, int, bool]] = [("", NO, NO, 0, 0, False)]
        open_: dict[str, int] = {}
        parts: list[str] = []
        links = linked = 0

        def flush() -> None:
            nonlocal linked
            if parts:
                text = " ".join(html.unescape("".join(parts)).split())
                if text:
                    inner = next(e for e in reversed(stack) if not e[5])
                    self.blocks.append(Block(text, inner[3], inner[4], min(linked, len(text)), inner[1]))
                parts.clear()
            linked = 0

        def close(index: int) -> None:
            nonlocal links
            if not all(e[5] for e in stack[index:]):
                flush()
            for e in stack[index:]:
                open_[e[0]] -= 1
                links -= e[0] == "a"
            del stack[index:]

        for tag, closing, attributes in tokens:
            if not tag:
                if stack[-1][2] != YES:
                    parts.append(attributes)
                    if links:
                        linked += len(attributes)
                continue
            if closing:
                if open_.get(tag, 0):
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == tag:
                            close(k)
                            break
                        if tag in INLINE and stack[k][0] in SCOPE:
                            break
                continue
            if tag in CLOSES_P or tag in CLOSES_LIKE:
                like = CLOSES_LIKE.get(tag, frozenset()) | ({"p"} if tag in CLOSES_P else set())
                if any(open_.get(x, 0) for x in like):
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] in like:
                            close(k)
                            if tag in CLOSES_P:
                                break
                        elif stack[k][0] in SCOPE and stack[k][0] not in like:
                            break
            if tag in VOID:
                if tag in INLINE:
                    parts.append(" " if tag == "br" else "")
                else:
                    flush()
                continue
            _, around, within, node, path, _ = stack[-1]
            inline = tag in INLINE or within == YES and tag not in CLOSES_P and tag not in CLOSES_LIKE
            if not inline:
                flush()
            if tag in RAW:
                tokens.skip_to(tag)
                continue
            mark = _marked(tag, attributes)
            if tag == "header" and not (open_.get("article", 0) or open_.get("main", 0)):
                mark = YES
            if inline:
                stack.append((tag, around, max(within, mark), node, path, True))
            else:
                self.parent.append(node)
                self.kind.append(tag)
                path = self._path(path, tag)
                stack.append((tag, max(around, mark, within), NO, len(self.kind) - 1, path, False))
            open_[tag] = open_.get(tag, 0) + 1
            links += tag == "a"
        flush()


def _fused(found: list[Block]) -> dict[int, float]:
    """Smoothed and fused tag-path ratios."""
    order: dict[int, int] = {}
    for b in found:
        order.setdefault(b.path, len(order))
    chars, marks, free, count = (np.zeros(len(order)) for _ in range(4))
    for b in found:
        k = order[b.path]
        chars[k] += len(b.text)
        marks[k] += len(_PUNCTUATION.findall(b.text))
        free[k] += max(0, len(b.text) - b.linked)
        count[k] += 1
    ratio = free / count
    dense = ratio * np.log2(2 + marks) * (free / np.maximum(chars, 1))
    smooth = [np.convolve(np.pad(x, 1, mode="edge"), SMOOTH, mode="valid") if len(x) else x for x in (ratio, dense)]
    own = np.sqrt(ratio * dense)
    # A path keeps its own weight beside its neighbours', so that a bare path between two rich ones does not become rich.
    return dict(zip(order, np.sqrt(own * np.sqrt(smooth[0] * smooth[1]))))


def main_text(html_page: str | None) -> str:
    """Blocks of the article, joined by an empty line; empty if there are none."""
    if not html_page:
        return ""
    page = Page(html_page)
    found = [b for b in page.blocks if b.marked != YES]
    if not found:
        return ""
    weight = _fused(found)
    least = THRESHOLD * max(weight.values())
    rich = {p for p, w in weight.items() if w >= least and w > 0}
    worth = lambda b: max(1, len(b.text) - b.linked) if b.path in rich else 0
    # A name that only may speak against an element does so unless most content lies there.
    if 2 * sum(worth(b) for b in found if b.marked == MAYBE) <= sum(map(worth, found)):
        found = [b for b in found if b.marked == NO]
    gain = [0] * len(page.kind)
    for b in found:
        gain[b.node] += worth(b)
    for node in range(len(gain) - 1, 0, -1):
        gain[page.parent[node]] += gain[node]
    best = _article(page, found, gain)
    inside = [0 in best]
    for node in range(1, len(gain)):
        inside.append(inside[page.parent[node]] or node in best)
    listed = lambda b: b.linked > 0.6 * len(b.text) and b.path not in rich
    return "\n\n".join(b.text for b in found if inside[b.node] and not listed(b))


def _article(page: Page, found: list[Block], gain: list[int]) -> set[int]:
    """The elements that hold the article; the root for a page without elements."""
    kind, parent = page.kind, page.parent
    within = [False]  # an article around the element
    for node in range(1, len(kind)):
        within.append(within[parent[node]] or kind[parent[node]] == "article")
    articles = [o for o in range(1, len(kind)) if kind[o] == "article" and gain[o] and not within[o]]
    mains = [o for o in range(1, len(kind)) if kind[o] == "main" and gain[o]]
    largest = max((gain[o] for o in articles), default=0)
    if articles and (not mains or largest >= SHARE * sum(gain[o] for o in articles)):
        return {o for o in articles if gain[o] >= SHARE * largest}
    if mains:
        return {max(mains, key=lambda o: (gain[o], -o))}
    holders = [o for o in range(1, len(kind)) if kind[o] in HOLDERS and gain[o]]
    if not holders:
        return {0}
    # The innermost element that holds nearly all rich text, widened to the page's title where that stands outside.
    most = max(gain[o] for o in holders)
    best = max(o for o in holders if gain[o] >= 0.9 * most)

    def around(node: int) -> list[int]:
        out = []
        while node >= 0:
            out.append(node)
            node = parent[node]
        return out

    held = {best}
    for node in range(best + 1, len(kind)):
        if parent[node] in held:
            held.add(node)
    headed = [False]
    for path in range(1, len(page.path_tag)):
        headed.append(headed[page.path_parent[path]] or page.path_tag[path] in HEADINGS)
    if not any(b.node in held and headed[b.path] for b in found):
        title = next((b for b in found if page.path_tag[b.path] == "h1"), None)
        if title:
            above = set(around(best))
            best = next(o for o in around(title.node) if o in above)
    return {best}


def extract(pages: DataFrame, *, html: str = "html", into: str = "text") -> DataFrame:
    """``pages`` without ``html``, with the main text in ``into`` and its code points in ``n_chars``.

    A null or empty page, or one without an article, has the empty text.  Whole pages are read, in time in proportion to
    their length; repeated rows give the same text; other columns are kept, and columns named as the results are replaced.
    """
    ship_package(pages.sparkSession)
    kept = pages.drop(*{into, "n_chars"} - {html})
    names = [c for c in kept.columns if c != html]
    schema = T.StructType([*[f for f in kept.schema.fields if f.name != html], T.StructField(into, T.StringType()), T.StructField("n_chars", T.LongType())])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, html):
            found = [main_text(p) for p in texts(batch, html)]
            out = batch.select(names)
            yield out.append_column(into, pa.array(found, pa.string())).append_column("n_chars", pa.array([len(x) for x in found], pa.int64()))

    return kept.mapInArrow(read, schema)
