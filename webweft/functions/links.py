"""What a page or a rich text holds, read in one pass, in time linear in the text: links (a[href], area[href], img[src]
and, where asked for, iframe[src], in that order, each in page order), anchor names, entries nested in it.

The reader is tolerant.  Comments, and what scripts and styles hold, have no tags; a comment, a script or a tag that never
ends takes the rest of the text.  An element that nobody closes ends with the one around it; a link also ends where the
next begins.  What is under craft-entry holds no links of this text.  Character references are decoded, the first of a
repeated attribute counts, names are in lower case.  A null text is an empty one."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Tag: attribute of the address, attribute of the text (none: the text inside).
SOURCES = {"a": ("href", None), "area": ("href", "alt"), "img": ("src", "alt"), "iframe": ("src", "title")}
NESTED = "craft-entry"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an end tag of lower rank does not close.
RANKS = {"div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180, "table": 190, "head": 200, "body": 200, "html": 220}
_RANK = 100
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_ATTRIBUTE = re.compile(r"""[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|(["'])|([^\s>]*+)))?+)""")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style")}
_NUMBER = re.compile(r"[ \t\n\r\v\f]*\+?([0-9]{1,18})")


class Text:
    """found: by tag, the [address, text] of its links; anchors: ids of all elements, then names of anchors; entries: ids of
    nested entries, each once."""

    def __init__(self, html: str | None, tags: tuple[str, ...] = ("a", "area", "img")):
        self.found: dict[str, list[list[str]]] = {t: [] for t in tags}
        self.ids: dict[str, None] = {}
        self.names: dict[str, None] = {}
        self.entries: dict[int, None] = {}
        self._read(html or "")

    @property
    def anchors(self) -> list[str]:
        return list(self.ids | self.names)

    def links(self) -> list[tuple[str, str, str]]:
        return [(tag, href, text) for tag, links in self.found.items() for href, text in links]

    def _attributes(self, html: str, at: int) -> tuple[dict[str, str], int, bool]:
        """(attributes, position after the tag or -1, whether the tag closes itself)"""
        held: dict[str, str] = {}
        while True:
            m = _ATTRIBUTE.match(html, at)
            if m is None or m[5]:  # no > to come, or a quote that nothing closes
                return held, -1, False
            at = m.end()
            if m[1]:
                return held, at, html[at - 2] == "/"
            value = m[3] or m[4] or m[6] or ""
            held.setdefault(m[2].lower(), unescape(value) if "&" in value else value)

    def _read(self, html: str) -> None:
        stack: list[str] = []
        opened: dict[str, int] = {}
        link, depth = None, 0  # the open link's text in pieces, and where its element stands in the stack
        pieces: list[str] = []
        at = 0

        def end_link():
            nonlocal link
            if link is not None:
                link[1] = "".join(pieces)
                link = None
            pieces.clear()

        while True:
            tag = html.find("<", at)
            if link is not None:
                text = html[at : tag if tag >= 0 else len(html)]
                pieces.append(unescape(text) if "&" in text else text)
            if tag < 0:
                break
            at = tag + 1
            if html.startswith("!--", at):
                at = html.find("-->", at + 1) + 3  # <!--> is a whole comment
                if at < 3:
                    break
                continue
            lead = html[at : at + 1]
            if lead in ("!", "?"):
                at = html.find(">", at) + 1
                if not at:
                    break
                continue
            closes = lead == "/"
            m = _NAME.match(html, at + closes)
            if not m:
                if closes:  # what begins like an end tag and is none is left out like a comment
                    at = html.find(">", at) + 1
                    if not at:
                        break
                elif link is not None:
                    pieces.append("<")
                continue
            name = m[0].lower()
            if closes:
                at = html.find(">", m.end()) + 1
                if not at:
                    break
                if opened.get(name):
                    rank, k = RANKS.get(name, _RANK), len(stack) - 1
                    while stack[k] != name and RANKS.get(stack[k], _RANK) <= rank:
                        k -= 1
                    if stack[k] == name:
                        for gone in stack[k:]:
                            opened[gone] -= 1
                        del stack[k:]
                        if link is not None and k <= depth:
                            end_link()
                continue
            held, at, whole = self._attributes(html, m.end())
            if at < 0:
                break
            self._meet(name, held)
            inside = opened.get(NESTED, 0)
            if name == "a":
                end_link()
            if name in self.found and not inside:
                address, text = SOURCES[name]
                if address in held:
                    one = [held[address], "" if text is None else held.get(text, "")]
                    self.found[name].append(one)
                    if name == "a" and not whole:
                        link, depth = one, len(stack)
            if name in VOID or whole:
                continue
            if name in _RAW_END:
                m = _RAW_END[name].search(html, at)
                if not m:
                    break
                at = m.start()
            stack.append(name)
            opened[name] = opened.get(name, 0) + 1
        end_link()

    def _meet(self, name: str, held: dict[str, str]) -> None:
        if "id" in held and held["id"].strip():
            self.ids[held["id"].strip()] = None
        if name == "a" and held.get("name", "").strip():
            self.names[held["name"].strip()] = None
        if name == NESTED:
            m = _NUMBER.match(held.get("data-entry-id", ""))
            if m and int(m[1]):
                self.entries[int(m[1])] = None


def _tags(images: bool, iframes: bool) -> tuple[str, ...]:
    return ("a", "area", *["img"] * images, *["iframe"] * iframes)


def page_links(html: str | None, images: bool = True, iframes: bool = False) -> list[tuple[str, str, str]]:
    """(tag, href, text) of each link."""
    return Text(html, _tags(images, iframes)).links()


def anchor_names(html: str | None) -> list[str]:
    """What a fragment may name: the ids of all elements, then the names of anchors, each once in page order."""
    return Text(html, ()).anchors


def nested_ids(html: str | None) -> list[int]:
    """Ids of the entries nested in a text, each once in page order."""
    return list(Text(html, ()).entries)


def _batches(rows: list[tuple], names: str, *kinds: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names.split())


def _pages(pages: DataFrame) -> DataFrame:
    return pages.selectExpr("CAST(page_id AS BIGINT) AS page_id", "html")


def _each(batches: Iterator[pa.RecordBatch], size: int = 256):
    """(first column, last column) in lists of at most `size` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            yield part.column(0).to_pylist(), part.column(part.num_columns - 1).to_pylist()


def anchors(pages: DataFrame) -> DataFrame:
    """page_id and its anchor names of pages(page_id, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _each(batches):
            yield _batches([(i, anchor_names(h)) for i, h in zip(ids, texts, strict=True)], "page_id anchors", pa.int64(), pa.list_(pa.string()))

    return _pages(pages).mapInArrow(run, "page_id long, anchors array<string>")


def nested(pages: DataFrame) -> DataFrame:
    """(page_id, pos, entry_id) of the entries nested in pages(page_id, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _each(batches):
            rows = [(i, k, e) for i, h in zip(ids, texts, strict=True) for k, e in enumerate(nested_ids(h))]
            yield _batches(rows, "page_id pos entry_id", pa.int64(), pa.int32(), pa.int64())

    return _pages(pages).mapInArrow(run, "page_id long, pos int, entry_id long")


def extracted(pages: DataFrame, images: bool = True, iframes: bool = False) -> DataFrame:
    """page_id, pos (from 0), tag, href and text of each link of pages(page_id, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _each(batches):
            rows = [(i, k, *link) for i, html in zip(ids, texts, strict=True) for k, link in enumerate(page_links(html, images, iframes))]
            yield _batches(rows, "page_id pos tag href text", pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())

    return _pages(pages).mapInArrow(run, "page_id long, pos int, tag string, href string, text string")


def _lists(found: list[list[tuple]]) -> pa.Array:
    """Lists of links, column by column: no object is made of each."""
    columns = list(zip(*(f for links in found for f in links), strict=True)) or [()] * 3
    one = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], names=["tag", "href", "text"])
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, found))], pa.int32()), one)


def bodies(values: DataFrame, text: str = "value", images: bool = True, iframes: bool = False, links: bool = True) -> DataFrame:
    """values, without the rich text in column `text`, with its links (array of tag, href, text; left out unless asked for) and
    entries (array of ids), each text read once for both."""
    tags, at = _tags(images, iframes) if links else (), values.columns.index(text)
    kept = [f for f in values.schema.fields if f.name != text]
    more = "links array<struct<tag:string,href:string,text:string>>, " * links + "entries array<bigint>"
    schema = StructType([*kept, *StructType.fromDDL(more).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                read = [Text(t, tags) for t in part.column(at).to_pylist()]
                held = [_lists([t.links() for t in read])] * links + [pa.array([list(t.entries) for t in read], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *held], names=schema.names)

    return values.mapInArrow(run, schema)
