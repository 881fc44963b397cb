"""Records from HTML: native expressions for regular parts, a parser for listings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import date_millis, path_stem, strip_prefix
from .schemas import TENDER

# Elements that have no closing tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def tag_text(html: Column, tag: str) -> Column:
    """Raw inner text of the first such element, markup removed; null when there is none."""
    element = rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>"
    inner = F.regexp_extract(html, element, 1)
    return F.when(html.rlike(element), F.trim(F.regexp_replace(inner, "<[^>]*>", "")))


def links(html: Column) -> Column:
    """array<struct<href, text>> of the links, in order."""
    pattern = r'(?s)<a href="([^"]*)"[^>]*>(.*?)</a>'
    return F.arrays_zip(
        F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("href"),
        F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("text"),
    )


class Element:
    """One element: tag, classes, attributes, children (elements and strings)."""

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.classes = frozenset((attrs.get("class") or "").split())

    def elements(self) -> list["Element"]:
        return [c for c in self.children if isinstance(c, Element)]

    def text(self) -> str:
        parts, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                parts.append(node)
            else:
                todo.extend(reversed(node.children))
        return " ".join("".join(parts).split())

    def own_text(self) -> str:
        return "".join(c for c in self.children if isinstance(c, str))

    def find(self, tag: str, *classes: str) -> Iterator["Element"]:
        """Descendants with the tag and all the classes, in document order."""
        todo = list(reversed(self.elements()))
        while todo:
            node = todo.pop()
            if node.tag == tag and node.classes.issuperset(classes):
                yield node
            todo.extend(reversed(node.elements()))


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("#root", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Element(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        if self.open[-1].tag not in ("script", "style"):
            self.open[-1].children.append(data)


def parse(html: str) -> Element:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def extract_with(pages: DataFrame, key: str, records: Callable[[Element], list[dict]], schema: str) -> DataFrame:
    """(key, fields...) of every record a page holds; `records` gives them from the parsed page."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *[r.get(n) for n in names]) for k, h in zip(batch[key], batch["html"]) for r in records(parse(h))]
            yield pd.DataFrame(rows, columns=[key, *names])

    return pages.select(key, "html").mapInPandas(run, f"{key} {dict(pages.dtypes)[key]}, {schema}")


def article_records(page: Element) -> list[dict]:
    """One record per article: heading, paragraphs, characters of text, with entities decoded."""
    out = []
    for article in page.find("article"):
        heading = next(article.find("h1"), None)
        out.append(
            {
                "heading": heading.text() if heading else None,
                "n_paragraphs": sum(1 for _ in article.find("p")),
                "n_chars": len(article.text()),
            }
        )
    return out


ARTICLE_SCHEMA = "heading string, n_paragraphs int, n_chars int"

# Class names of the listing and the labels before its fields.
ITEM, HEADER, LEFT, RIGHT = "notice-search-item", "notice-search-item-header", "left-col", "right-col"
PREFIXES = {
    "publishedBy": "Publisert av: ",
    "doffinReference": "Doffin referanse: ",
    "announcementType": "Kunngjøringstype: ",
    "announcementDate": "Kunngjøringsdato: ",
    "county": "Fylke: ",
    "municipality": "Kommune: ",
}
_RAW_SCHEMA = ", ".join(
    f"{n} string" for n in
    "name internalUrl image publishedBy publishedByUrl doffinReference announcementType announcementDate "
    "tenderDeadline county municipality externalUrl".split()
)


def _child_divs(parent: Element | None) -> list[Element]:
    return [c for c in parent.elements() if c.tag == "div"] if parent else []


def _href(link: Element | None) -> str | None:
    return link.attrs.get("href", "").strip() if link else None


def listing_records(page: Element) -> list[dict]:
    """Raw fields of every result block of a listing page."""
    out = []
    for article in page.find("article", "widget", "widget-content", "widget-eps-search-result-widget"):
        for block in article.elements():
            if block.tag != "div" or ITEM not in block.classes:
                continue
            header = next(block.find("div", HEADER), None)
            anchors = [c for c in header.elements() if c.tag == "a"] if header else []
            images = [c for c in header.elements() if c.tag == "img"] if header else []
            left, right = _child_divs(next(block.find("div", LEFT), None)), _child_divs(next(block.find("div", RIGHT), None))
            places = {
                field: next((d.text() for d in block.find("div") if d.own_text().strip().startswith(f"{label}:")), None)
                for field, label in (("municipality", "Kommune"), ("county", "Fylke"))
            }
            publisher = next(iter(left[0].elements()), None) if left else None
            deadline = next((c for c in right[1].elements() if c.tag == "span"), None) if len(right) > 1 else None
            out.append(
                {
                    "name": anchors[-1].text() if anchors else None,
                    "internalUrl": _href(anchors[-1]) if anchors else None,
                    "image": images[0].attrs.get("src") if images else None,
                    "publishedBy": left[0].text() if left else None,
                    "publishedByUrl": _href(publisher),
                    "doffinReference": right[0].text() if right else None,
                    "announcementType": left[1].text() if len(left) > 1 else None,
                    "announcementDate": right[-1].text() if len(right) > 1 else None,
                    "tenderDeadline": deadline.text() if deadline else None,
                    "externalUrl": next((_href(a) for a in anchors if {"pull-right", "doc-icon"} <= a.classes), None),
                    **places,
                }
            )
    return out


def extract_listing(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """The tender records of listing pages, one per result block."""
    raw = extract_with(pages, key, listing_records, _RAW_SCHEMA)
    fields = {n: F.col(n) for n in TENDER.fieldNames() if n not in ("flag", "id")}
    for name, prefix in PREFIXES.items():
        fields[name] = strip_prefix(F.col(name), prefix)
    fields["announcementDate"] = date_millis(fields["announcementDate"])
    fields["tenderDeadline"] = date_millis(F.col("tenderDeadline"))
    fields["flag"], fields["id"] = path_stem(F.col("image")), F.lit(None).cast("bigint")
    return raw.select(*[fields[n].alias(n) for n in TENDER.fieldNames()])
