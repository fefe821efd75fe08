"""Rows and links out of HTML, in pandas UDFs on the standard library's parser.

The tree follows the rules by which browsers build one where end tags are left out: a
row or a cell ends the one before it in its own table, whatever else is still open
inside; paragraphs, list items and links end likewise; end tags reach no further than
the cell or table around them; what stands between rows moves before the table; rows
and cells outside of tables are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Set
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SCOPE = frozenset({"table", "td", "th", "caption", "template"})
SECTIONS, CELLS = frozenset({"tbody", "thead", "tfoot"}), frozenset({"td", "th"})
ROWS = SECTIONS | CELLS | {"tr"}
#: Where only parts of tables may stand, and what else may.
BETWEEN = SECTIONS | {"table", "tr"}
PARTS = ROWS | {"caption", "colgroup", "col", "script", "style", "template"}
BLOCKS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: By tag, the elements that it ends, and those that shield them.
ENDS = {
    "li": ({"li"}, SCOPE | {"ul", "ol"}), "dd": ({"dd", "dt"}, SCOPE | {"dl"}), "dt": ({"dd", "dt"}, SCOPE | {"dl"}), "a": ({"a"}, SCOPE), "option": ({"option"}, SCOPE | {"select"}),
    **{tag: ({"p"}, SCOPE | {"button"}) for tag in BLOCKS},
}
LIST_ROW = "symbol string, type string, is_sme boolean, company_name string, detail_path string, bidding_range string, listing_date_text string, price_text string"


class Element:
    def __init__(self, tag: str, attrs: dict, parent: Element | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Element]:
        """All elements below, in the order of the page. Pages can be nested deeper than Python's calls."""
        open_ = [iter(self.children)]
        while open_:
            child = next(open_[-1], None)
            if child is None:
                open_.pop()
            elif isinstance(child, Element):
                yield child
                open_.append(iter(child.children))

    def has(self, tag: str | None, name: str | None = None) -> bool:
        return (tag is None or self.tag == tag) and (name is None or name in (self.attrs.get("class") or "").split())

    def all(self, tag: str | None, name: str | None = None) -> list[Element]:
        return [x for x in self.walk() if x.has(tag, name)]

    def text(self, without: str | None = None, nested: bool = True) -> str:
        """All text below; not that of elements with the class ``without``, at any depth or only of children."""
        out, open_ = [], [iter(self.children)]
        while open_:
            child = next(open_[-1], None)
            if child is None:
                open_.pop()
            elif isinstance(child, str):
                out.append(child)
            elif not (without and (nested or len(open_) == 1) and child.has(None, without)):
                open_.append(iter(child.children))
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {}, None)
        self.open, self.count = [self.root], Counter()  # elements without an end so far, and how many of each tag

    def _pop(self, to: int) -> None:
        for node in self.open[to:]:
            self.count[node.tag] -= 1
        del self.open[to:]

    def _close(self, tags: Set[str], shields: Set[str]) -> None:
        """Ends the innermost open element of the tags, and all inside it, if no shield is nearer."""
        if not any(self.count[t] for t in tags):
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                self._pop(k)
                return
            if self.open[k].tag in shields:
                return

    def _back_to(self, tags: Set[str]) -> None:
        k = len(self.open)
        while self.open[k - 1].tag not in tags:
            k -= 1
        self._pop(k)

    def _put(self, node: Element | str, part: bool) -> None:
        """Into the innermost open element; before the table, if that takes only parts of tables."""
        at = self.open[-1]
        if at.tag in BETWEEN and not part:
            k = next(k for k in range(len(self.open) - 1, 0, -1) if self.open[k].tag == "table")
            at = self.open[k - 1]
            at.children.insert(len(at.children) - 1, node)  # an open table is its parent's last child
        else:
            at.children.append(node)
        if isinstance(node, Element):
            node.parent = at

    def _start(self, tag: str, attrs: dict) -> None:
        node = Element(tag, attrs, None)
        self._put(node, tag in PARTS)
        if tag not in VOID:
            self.open.append(node)
            self.count[tag] += 1

    def handle_starttag(self, tag, attrs):
        if tag in ROWS:
            if not self.count["table"]:
                return
            self._close(CELLS if tag in CELLS else {"tr"} if tag == "tr" else SECTIONS, {"table", "template"})
            self._back_to(BETWEEN if tag in CELLS else SECTIONS | {"table"} if tag == "tr" else {"table"})
            if tag in CELLS and self.open[-1].tag != "tr":
                self._start("tr", {})
        else:
            for tags, shields in [ENDS["p"]] if tag in BLOCKS else [ENDS[tag]] if tag in ENDS else []:
                self._close(tags, shields)
        self._start(tag, dict(attrs))

    def handle_endtag(self, tag):
        self._close({tag}, {"template"} if tag == "table" else {"table", "template"} if tag in ROWS else SCOPE)

    def handle_data(self, data):
        self._put(data, not data.strip())


def parse(html: str | None) -> Element:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def list_rows(html: str | None) -> list[dict]:
    """Table rows with a link to a detail page, the first row of each."""
    rows, seen = [], set()
    for tr in parse(html).all("tr"):
        links = [a for cell in tr.all("td") if cell.has("td", "name") or cell.has("td", "ipo-logo") for a in cell.all("a")]
        href = (links[0].attrs.get("href") or "") if links else ""
        if not re.match(r"/ipo/[0-9]+/", href):
            continue
        path = href if href.endswith("/") else f"{href}/"
        if path in seen:
            continue
        seen.add(path)
        below = list(tr.walk())
        pick = lambda tag, name: [x for x in below if x.has(tag, name)]  # noqa: B023, E731
        marks, titles, dates, prices = pick(None, "ipo-symbol")[:1], pick(None, "ipo-name")[:1], pick("td", "date"), pick("td", "text-right")[:1]
        kind = "".join(t.text() for m in marks for t in m.all(None, "ipo-type")).strip()
        rows.append({
            "symbol": marks[0].text("ipo-type").strip() if marks else "", "type": kind, "is_sme": "sme" in kind.lower(),
            "company_name": titles[0].text().strip() if titles else "", "detail_path": path,
            "bidding_range": dates[0].text("hidden", nested=False).strip() if dates else "",
            "listing_date_text": dates[1].text().strip() if len(dates) > 1 else "", "price_text": prices[0].text().strip() if prices else "",
        })
    return rows


def prospectus_link(html: str | None) -> str | None:
    """The first link to a .pdf whose text says prospectus."""
    for a in parse(html).all("a"):
        href = a.attrs.get("href") or ""
        if ".pdf" in href and "prospectus" in a.text().lower():
            return href
    return None


def extract_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """Explodes the list rows of each page, with their place in it (from 0); the other columns are repeated."""

    @F.pandas_udf(f"array<struct<{LIST_ROW.replace(' ', ':').replace(',:', ',')}>>")
    def rows(column: pd.Series) -> pd.Series:
        return column.map(list_rows)

    kept = [c for c in pages.columns if c != html]
    return pages.select(*kept, F.posexplode(rows(html)).alias("place", "_row")).select(*kept, "place", "_row.*")


def extract_prospectus(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replaces the page by prospectus_url."""

    @F.pandas_udf("string")
    def link(column: pd.Series) -> pd.Series:
        return column.map(prospectus_link)

    return pages.withColumn("prospectus_url", link(html)).drop(html)


def extract_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """Explodes the links of each page, in order: place (from 0), href and label; the other columns are repeated. Anchors without href are none."""

    @F.pandas_udf("array<struct<href:string,label:string>>")
    def links(column: pd.Series) -> pd.Series:
        return column.map(lambda page: [{"href": a.attrs["href"], "label": a.text().strip()} for a in parse(page).all("a") if a.attrs.get("href") is not None])

    kept = [c for c in pages.columns if c != html]
    return pages.select(*kept, F.posexplode(links(html)).alias("place", "_link")).select(*kept, "place", "_link.*")


def link_targets(html):
    """All href values of anchors on regular HTML, as an expression."""
    return F.regexp_extract_all(html, F.lit(r'<a\s[^>]*?href="([^"]*)"'), 1)
