"""Main text of web pages by the line-block distribution.

Markup is stripped into lines, one for each block element. Parts that are never article text (menus, forms, scripts, what
is marked as advert, notice, comment and so on) leave no line; where such a part, or the edge of an article, lies between
blocks that are not siblings, it leaves ``WIDTH`` empty ones. A line counts its characters outside links and white space; within an
article, where menus leave no line, those of links too. Over every ``WIDTH`` neighbouring lines the counts are summed: text surges
where the sum leaves zero and dives where it comes back, and the lines of all windows between two such points are a stretch, lines
that are all link at its edges included.

A stretch is kept unless more than half of its characters are links, and the one that counts most is kept in any case. Where articles
hold most of the counted characters, text outside of them must surge to ``SURGE`` somewhere as well. Nothing within a kept stretch is dropped.
A heading that says no more than that comments follow ends the text until the next heading of its level, or the end of the part it is in.

Scale: one pass over the pages, no exchange; a task holds one batch of pages. The time is linear in the length of a page,
however broken its markup.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import only, table

#: Lines in a block of the distribution.
WIDTH = 3
#: Counted characters within a block to which text beside a marked article surges.
SURGE = 86

_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
#: Elements whose content is no markup; it ends at their own end tag.
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "canvas", "object", "head"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_SKIP = {"nav", "footer", "aside", "form", "button", "select", "option", "label", "fieldset", "dialog", "menu"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
_TEXT = {"p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd", "pre", "td", "th", "figcaption", "blockquote"}
_LISTS = {"ul", "ol", "dl", "table", "thead", "tbody", "tfoot", "tr", "figure"}
#: An end tag of an inline element, p or li does not reach beyond these.
_WALLS = {"article", "main", "body", "table", "td", "aside", "nav", "footer", "form"}
_ENDS_PARAGRAPH = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "li", "table", "pre", "blockquote", "section", "article", "main", "header", "figure", "hr"}

_ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
#: A class, id or role marks a part if all words of it that say anything are among these; within an article, the first row only.
_NOISE_WITHIN = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adsbygoogle sponsor sponsored promo promos promoted promotion cookie cookies consent gdpr notice notices "
    "popup modal newsletter subscribe subscription signup share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond".split()
)
_NOISE = _NOISE_WITHIN | set(
    "nav navbar navigation menu menus submenu menubar breadcrumb breadcrumbs sidebar sidebars side footer footers masthead header headers banner banners notification notifications "
    "overlay login search toolbar pagination pager skip widget widgets complementary contentinfo toc tags alert alerts alertdialog dialog".split()
)
#: Words that say nothing by themselves.
_NEUTRAL = set(
    "box boxes wrap wrapper container block blocks section sections list area bar panel inner outer top bottom left right slot unit item items holder zone row col column columns content "
    "body text main site page global primary secondary post posts article articles entry story user users reader readers form link links button buttons the js".split()
)
#: Within an article, where ids name headings, those of comments only mark a part.
_NOISE_IDS = {"comment", "comments", "commentlist", "disqus", "respond"}
_OWN = {"post", "article", "entry", "story", "content"}
_PARTS = re.compile(r"[a-z]+")
_HEADING = re.compile(r"h[1-6]")
#: Headings of reader comments; the whole of a heading.
_REMARKS = re.compile(r"(?:(?:reader|user) )?comments(?: ?\(\d+\))?:?|\d+ (?:comments?|replies|responses)|(?:leave|post|write) a (?:comment|reply)", re.I)


def _marks(attributes: str, name: str, within: bool) -> bool:
    """Whether the attributes mark an element as no article text."""
    for key, value in _ATTRIBUTE.findall(attributes):
        words = _NOISE if not within else _NOISE_IDS if key.lower() == "id" else _NOISE_WITHIN
        tokens = value.strip("\"'").lower().split()
        if key.lower() == "aria-label" and len(tokens) != 1:
            continue
        for token in tokens:
            parts = _PARTS.findall(token)
            said = [p for p in parts if p not in _NEUTRAL]
            if said and all(p in words for p in said):
                if said[0] in ("header", "headers") and not _OWN.isdisjoint(parts):
                    continue  # the header of the article
                if name in _TEXT and len(parts) > 1:
                    continue  # a compound on a paragraph names what it says
                return True
    return False


class _Tags:
    """The tags of a page in order; finding the end of each takes time linear in the page altogether."""

    def __init__(self, page: str):
        self.page = page
        self.plain = False  # a tag had no end outside quotation marks: from there on, the next ">" ends any

    def end(self, at: int) -> int:
        """Position of the ">" that ends the tag whose name ends at ``at``; -1 if there is none."""
        page = self.page
        first = close = page.find(">", at)
        if close < 0 or self.plain:
            return close
        i = at
        while True:
            quotes = [q for q in (page.find('"', i, close), page.find("'", i, close)) if q >= 0]
            if not quotes:
                return close
            i = page.find(page[min(quotes)], min(quotes) + 1) + 1
            close = max(close, page.find(">", i)) if i else -1
            if not i or close < i:
                self.plain = True
                return first


_EMPTY = ("", 0, 0, False)


class _Lines:
    """What the stripping of one page has found so far."""

    def __init__(self) -> None:
        self.lines: list[tuple[str, int, int, bool]] = []  # text, counted characters, those that are no white space, within an article
        self.text: list[str] = []
        self.linked = 0
        self.stack: list[tuple[str, str]] = []  # open elements, and what they are: "", "noise", "form", "article"
        self.places: dict[str, list[int]] = defaultdict(list)  # of the open elements, by name
        self.blocks: list[int] = []  # places of open elements other than paragraphs and inline ones
        self.containers: list[int] = []  # and of those that are neither text nor lists
        self.walls: list[int] = []
        self.noise = self.links = self.articles = self.mains = 0
        self.remarks: tuple[str, int] | None = None  # the heading of open comments, and the place of the part they are in
        self.forms: list[int] = []  # places of open forms outside articles
        self.uid, self.uids = 0, [0]  # identities of the open elements
        self.parent = -1  # that of the element around the last line's block
        self.pending = False

    @property
    def silent(self) -> bool:
        return bool(self.noise or self.forms or self.remarks)

    def put(self, raw: str) -> None:
        if raw and not self.silent:
            said = html.unescape(raw)
            self.text.append(said)
            if self.links:
                self.linked += len("".join(said.split()))

    def close(self) -> None:
        """End the line."""
        if self.text:
            whole = " ".join("".join(self.text).split())
            block = self.blocks[-1] if self.blocks else -1
            if block >= 0 and _HEADING.fullmatch(self.stack[block][0]) and _REMARKS.fullmatch(whole):
                self.remarks = (self.stack[block][0], self.containers[-1] if self.containers else -1)
            elif whole:
                inmost = max(self.blocks[-1] if self.blocks else -1, self.places["p"][-1] if self.places["p"] else -1)
                own = len(self.containers) > 1 and self.containers[-1] == inmost and self.stack[inmost][0] not in ("body", "html")
                around = self.uids[self.containers[-2 if own else -1] + 1] if self.containers else 0
                if self.pending and around != self.parent:
                    self.lines += [_EMPTY] * WIDTH
                self.pending, self.parent = False, around
                said = len(whole) - whole.count(" ")
                self.lines.append((whole, said if self.articles else max(0, said - self.linked), said, bool(self.articles)))
            self.text.clear()
        self.linked = 0

    def edge(self) -> None:
        """The edge of an article or main part."""
        self.close()
        self.lines += [_EMPTY] * WIDTH

    def push(self, name: str, kind: str) -> None:
        k = len(self.stack)
        self.stack.append((name, kind))
        self.places[name].append(k)
        self.uid += 1
        self.uids.append(self.uid)
        if name != "p" and name not in _INLINE:
            self.blocks.append(k)
            if name not in _TEXT and name not in _LISTS:
                self.containers.append(k)
        if name in _WALLS:
            self.walls.append(k)
        if kind == "noise":
            self.noise += 1
        elif kind == "form":
            self.forms.append(k)
        elif kind == "article":
            self.articles += 1
        self.links += name == "a"
        self.mains += name == "main"

    def pop(self, k: int) -> None:
        """Close all elements from place k on."""
        while len(self.stack) > k:
            name, kind = self.stack.pop()
            place = len(self.stack)
            self.places[name].pop()
            self.uids.pop()
            for places in (self.blocks, self.containers, self.walls, self.forms):
                if places and places[-1] == place:
                    places.pop()
            self.links -= name == "a"
            self.mains -= name == "main"
            if self.remarks and self.remarks[1] == place:
                self.remarks, self.pending = None, True
            if kind == "noise":
                self.noise -= 1
            elif kind == "article":
                self.edge()
                self.articles -= 1
            elif name == "main" and not self.silent:
                self.edge()

    def start(self, name: str, attributes: str) -> None:
        if name not in _INLINE:
            self.close()
        if name in _VOID or attributes.endswith("/"):
            return
        if name in _ENDS_PARAGRAPH and self.places["p"] and self.places["p"][-1] > (self.blocks[-1] if self.blocks else -1):
            self.pop(self.places["p"][-1])  # a block ends the paragraph before it, and what is open in it
        within = bool(self.articles)
        if self.remarks and (name in ("article", "main") or _HEADING.fullmatch(name) and name <= self.remarks[0]):
            self.remarks, self.pending = None, True
        kind = ""
        if name == "form" and not within:
            kind = "form"
        elif name in _SKIP or _HIDDEN.search(attributes) or name == "header" and not within and not self.mains:
            kind = "noise"
        elif name not in ("body", "html", "main") and attributes and _marks(attributes, name, within):
            kind = "noise"
        if name in ("article", "main") and not kind and not self.noise:
            if self.forms:  # a form around the whole page
                self.forms.clear()
            kind = "article" if name == "article" else ""
            self.edge()
        elif kind and not self.silent:
            self.close()
            self.pending = True
        self.push(name, kind)

    def end(self, name: str) -> None:
        if name not in _INLINE:
            self.close()
        places = self.places.get(name)
        if not places:
            return
        if (name in _INLINE or name in ("p", "li")) and self.walls and places[-1] < self.walls[-1]:
            return  # an end tag without its start
        self.pop(places[-1])


def lines_of(page: str) -> list[tuple[str, int, int, bool]]:
    """(text, counted characters, characters, within an article) of each line in page order; runs of empty lines part what is not together."""
    found, tags = _Lines(), _Tags(page)
    raw_ends: dict[str, re.Pattern[str]] = {}
    absent: set[str] = set()  # end tags that the rest of the page has not
    at, size = 0, len(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            found.put(page[at:])
            break
        found.put(page[at:start])
        if page.startswith("<!--", start):
            stop = page.find("-->", start + 4)
            at = stop + 3 if stop >= 0 else size
            continue
        m = _NAME.match(page, start + 1)
        close = tags.end(m.end()) if m else page.find(">", start) if page.startswith(("<!", "<?"), start) else -1
        if close < 0:
            if m or page.startswith(("<!", "<?"), start):  # no tag ends any more
                found.put(page[start:])
                break
            found.put("<")
            at = start + 1
            continue
        at = close + 1
        if not m:
            continue
        name = m[0].lower()
        if name.startswith("/"):
            found.end(name[1:])
            continue
        attributes = page[m.end() : close].rstrip()
        if name == "br":
            found.put(" ")
        elif name in _RAW:
            if name != "head" and not attributes.endswith("/"):
                if name not in raw_ends:
                    raw_ends[name] = re.compile(rf"</{name}\s*>", re.I)
                stop = None if name in absent else raw_ends[name].search(page, at)
                if stop is None:
                    absent.add(name)
                at = stop.end() if stop else size
        else:
            found.start(name, attributes)
    found.close()
    return found.lines


def main_text(page: str | None) -> str:
    """The text between surge and dive points, one block to a line."""
    lines = lines_of(page or "")
    counted = [n for _, n, _, _ in lines]
    ends = range(-WIDTH + 1, len(lines))
    sums = [sum(counted[max(i, 0) : i + WIDTH]) for i in ends]  # of the windows that hold any line
    stretches: list[tuple[int, int, int]] = []  # first and last line, largest sum
    first = None
    for i, n in zip([*ends, len(lines)], [*sums, 0], strict=True):
        if n and first is None:
            first = i
        elif not n and first is not None:
            stretches.append((max(first, 0), min(i + WIDTH - 1, len(lines)), max(sums[first + WIDTH - 1 : i + WIDTH - 1])))
            first = None
    marked = 2 * sum(n for _, n, _, within in lines if within) > sum(counted)
    most = max((sum(counted[a:b]) for a, b, _ in stretches), default=0)
    kept = []
    for a, b, peak in stretches:
        n, of = sum(counted[a:b]), sum(said for _, _, said, _ in lines[a:b])
        own = peak >= SURGE or not marked or any(within for *_, within in lines[a:b])
        if n == most or 2 * n >= of and own:
            kept += [t for t, *_ in lines[a:b] if t]
    return "\n".join(kept)


def _extract(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in chunks:
        for first in range(0, whole.num_rows, 200):
            batch = whole.slice(first, 200)
            texts = [main_text(p.as_py()) for p in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page, from its whole html.

    Null and empty pages, and pages without text outside links, give an empty text. Markup that never ends is read to the
    end of the page: an open comment or script has no text, an open tag is text. Repeated rows and null ids each give a
    row; an empty table gives an empty result; other columns are ignored.
    """
    rows = only(pages, id=id_col, url=url_col, html=html_col)
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_extract, f"id {kind}, url string, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
