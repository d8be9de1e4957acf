"""Main text of web pages by composite text density.

For every element, characters per tag are weighed down by the share of its characters and tags
that are links. The element whose children's densities have the largest sum is the core; the least
density on its path to the body is the threshold, and in every element that reaches it the subtree
with the largest sum is taken as well. What HTML or an exact class name marks as navigation,
adverts or reader comments is cut out before densities are computed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are never part of an article.
DROPPED = frozenset(
    "aside button canvas datalist dialog footer form head iframe input label math menu nav noscript object option script select style svg"
    " template textarea title".split()
)
#: Roles that say the same.
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
#: Class names and ids of such elements; a name counts if all its parts are of these and of PLACES.
NAMED = frozenset(
    "ad ads advert adverts advertisement advertisements banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer"
    " header masthead menu nav navbar navigation newsletter notice notices pager pagination popup promo related replies respond search share"
    " sharing sidebar sidebars social sponsored subscribe widget widgets".split()
)
#: Those that count inside an article too, and only as class names.
GUESTS = frozenset("ad ads advert adverts advertisement advertisements comment comments newsletter promo related replies respond share sharing social sponsored subscribe".split())
PLACES = frozenset("area bar block bottom box container inner item left list main outer page right section site thread top wrap wrapper".split())
#: An opening tag ends these open elements.
ENDS = {t: frozenset({t}) for t in ("li", "option", "tr", "p")} | {t: frozenset({"dd", "dt"}) for t in ("dd", "dt")} | {t: frozenset({"td", "th"}) for t in ("td", "th")}
#: ... unless one of these lies between.
HOLDS = frozenset("article aside body div dl main ol section table ul".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+|[^\W\d_A-Za-z]+")


def _named(names: str | None, known: frozenset[str]) -> bool:
    for name in (names or "").split():
        parts = {p.lower() for p in _PARTS.findall(name)}
        if parts & known and parts <= known | PLACES:
            return True
    return False


class _Page(HTMLParser):
    """Elements in page order, and the text with the element that holds it; None ends a block.

    The open elements are kept by tag and by kind as well, so that a tag finds what it ends
    without a walk through all of them.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.dropped, self.named = ["#page"], [-1], [False], [False]
        self.text: list[tuple[int, str | None]] = []
        self.open = [0]
        self.depths: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def _close(self, depth: int) -> None:
        for at in range(len(self.open) - 1, depth - 1, -1):
            node = self.open[at]
            self.depths[self.tag[node]].pop()
            if self.tag[node] in BLOCKS:
                self.blocks.pop()
                self.text.append((self.parent[node], None))
        del self.open[depth:]

    def _last(self, tags: frozenset[str]) -> int:
        """Depth of the innermost open element of these, or 0."""
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=0)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        ends = ENDS.get(tag, frozenset({"p"}) if tag in BLOCKS and tag != "br" else frozenset())
        depth = self._last(ends)
        if depth and depth >= self._last(HOLDS - ends):
            self._close(depth)
        given, up = dict(attrs), self.open[-1]
        within = bool(self.depths.get("article") or self.depths.get("main"))
        marked = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in (given.get("style") or "").replace(" ", "").lower()
        if not marked and tag not in ("html", "body", "main", "h1"):
            if within or tag == "article":
                marked = _named(given.get("class"), GUESTS)
            else:
                marked = (given.get("role") or "").lower() in ROLES or _named(given.get("class"), NAMED) or _named(given.get("id"), NAMED)
            marked = marked or (within and _named(given.get("id"), frozenset({"comments", "disqus"})))
        self.tag.append(tag)
        self.parent.append(up)
        self.dropped.append(tag in DROPPED or (tag == "header" and not within))
        self.named.append(marked)
        if tag in BLOCKS:
            self.text.append((up, None))
        if tag not in VOID:
            self.depths.setdefault(tag, []).append(len(self.open))
            if tag in BLOCKS:
                self.blocks.append(len(self.open))
            self.open.append(len(self.tag) - 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # as in a browser, only void elements end here

    def handle_endtag(self, tag: str) -> None:
        if not self.depths.get(tag):
            return
        depth = self.depths[tag][-1]
        if tag in BLOCKS or not self.blocks or self.blocks[-1] < depth:  # an inline end tag doesn't end blocks
            self._close(depth)

    def handle_data(self, data: str) -> None:
        self.text.append((self.open[-1], data))


def _density(chars: int, tags: int, link_chars: int, link_tags: int, page_share: float) -> float:
    """Characters per tag, weighed down by links; page_share: of the page's characters in links."""
    if not chars:
        return 0.0
    base = math.log(chars * link_chars / max(1, chars - link_chars) + page_share * chars + math.e)
    ratio = chars / max(1, link_chars) * max(1, tags) / max(1, link_tags)
    return chars / max(1, tags) * (math.log(max(ratio, 1.0)) / math.log(base) if base > 1 else math.log(max(ratio, 1.0)))


class Densities:
    """The elements of a page with what of them is left, their densities and their children's sums."""

    def __init__(self, page: _Page):
        tag, parent, count = page.tag, page.parent, len(page.tag)
        self.tag, self.parent, self.text = tag, parent, page.text
        self.end = end = [i + 1 for i in range(count)]
        holds = [t == "main" or (t == "article" and not n) for t, n in zip(tag, page.named)]
        for i in range(count - 1, 0, -1):
            end[parent[i]] = max(end[parent[i]], end[i])
            holds[parent[i]] |= holds[i]
        self.gone = gone = [False] * count
        for i in range(1, count):
            gone[i] = gone[parent[i]] or page.dropped[i] or (page.named[i] and not holds[i])
        in_link = [False] * count
        chars, tags, link_chars, link_tags = ([0] * count for _ in range(4))
        self.chars = chars
        for i in range(1, count):
            in_link[i] = tag[i] == "a" or in_link[parent[i]]
        for node, data in page.text:
            if data and not gone[node]:
                size = len("".join(data.split()))
                chars[node] += size
                link_chars[node] += size * in_link[node]
        for i in range(count - 1, 0, -1):
            if not gone[i]:
                up = parent[i]
                chars[up] += chars[i]
                link_chars[up] += link_chars[i]
                tags[up] += tags[i] + 1
                link_tags[up] += link_tags[i] + (tag[i] == "a")
        self.body = body = next((i for i in range(count) if tag[i] == "body" and not gone[i]), 0)
        share = link_chars[body] / max(1, chars[body])
        self.density = [0.0 if gone[i] else _density(chars[i], tags[i], link_chars[i], link_tags[i], share) for i in range(count)]
        self.block = [not gone[i] and chars[i] > 0 and tag[i] in BLOCKS for i in range(count)]
        self.total, leaf = [0.0] * count, [True] * count
        for i in range(1, count):
            if self.block[i]:
                self.total[parent[i]] += self.density[i]
                leaf[parent[i]] = False
        for i in range(count):
            if not self.block[i] and i != body:
                self.total[i] = -1.0  # only blocks are chosen
            elif leaf[i]:
                self.total[i] = self.density[i]

    def path(self, node: int) -> Iterator[int]:
        """node and what holds it, up to the body."""
        while node > self.body:
            yield node
            node = self.parent[node]
        yield self.body

    def chosen(self) -> list[int]:
        """The subtrees of the article, none inside another.

        Of subtrees that share a container below the body, the container is taken, so that nothing
        between them is lost; of an article or main element around one, the whole element.
        """
        best = list(range(len(self.tag)))  # the subtree with the largest sum in each
        for i in range(len(self.tag) - 1, 0, -1):
            if not self.gone[i] and self.total[best[i]] > self.total[best[self.parent[i]]]:
                best[self.parent[i]] = best[i]
        core = best[self.body]
        least = min(self.density[i] for i in self.path(core))
        found = {core, *(best[i] for i in range(self.body, self.end[self.body]) if self.block[i] and self.density[i] >= least and i != self.body)}
        tops: list[int] = []
        for i in sorted(found):
            if not tops or i >= self.end[tops[-1]]:
                tops.append(i)
        wide: dict[int, int] = {}  # by the child of the body that holds it, what holds all of them
        for i in tops:
            *_, child, _ = [i, *self.path(i)] if i > self.body else [i, i, i]
            held = wide.setdefault(child, i)
            while not held <= i < self.end[held]:
                held = self.parent[held]
            wide[child] = held
        return [self._whole(i) for i in wide.values()]

    def _whole(self, node: int) -> int:
        """The outermost article or main element around node, the only one in it that holds most of its text, or node with its heading."""
        named = [i for i in self.path(node) if self.tag[i] in ("article", "main")]
        if named:
            return named[0]
        outer, at = [], node
        while at < self.end[node]:
            if self.tag[at] in ("article", "main") and not self.gone[at] and self.chars[at]:
                outer.append(at)
                at = self.end[at]
            else:
                at += 1
        if len(outer) == 1 and 2 * self.chars[outer[0]] >= self.chars[node]:
            return outer[0]
        up = self.parent[node]
        heads = node > self.body and any(self.tag[i] == "h1" and self.parent[i] == up and not self.gone[i] for i in range(up + 1, node))
        return up if heads and 2 * self.chars[node] >= self.chars[up] else node


def main_text(html: str | None) -> str:
    """Blocks of the article in page order, one a line."""
    if not html:
        return ""
    page = _Page()
    page.feed(html)
    page.close()
    found = Densities(page)
    if not found.chars[0]:
        return ""
    inside = [False] * len(page.tag)
    for top in found.chosen():
        for i in range(top, found.end[top]):
            inside[i] = not found.gone[i]
    lines, held = [], []
    for node, data in [*page.text, (0, None)]:
        if data is None:
            if line := " ".join("".join(held).split()):
                lines.append(line)
            held = []
        elif inside[node]:
            held.append(data)
    return "\n".join(lines)


def extract_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The columns in keep with text and n_chars (code points) for every row.

    Null and empty html, and pages without an article, give an empty text. Whole pages are read,
    whatever their length, in time in proportion to it; line breaks end blocks. Repeated rows give
    repeated rows, an empty table none. Other columns of pages play no part.
    """
    given = pages.select(*keep, F.col(html_col).alias("__html"))
    schema = given.drop("__html").schema.add("text", T.StringType()).add("n_chars", T.LongType())

    def extract(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [main_text(x.as_py()) for x in part.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.names)

    return given.mapInArrow(extract, schema)
