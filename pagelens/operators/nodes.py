"""HTML pages to one row per element and text run: the only parsing step."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from pagelens.session import bounded_batches, stored

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_PROSE = frozenset("script style noscript template".split())
CDATA = frozenset(("script", "style"))
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
IMPLIED_END = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table", "thead", "tbody", "tfoot")), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot"), ("table",)), "tbody": (("thead", "tbody", "tfoot"), ("table",)), "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
    "option": (("option",), ("select", "datalist")), "optgroup": (("optgroup",), ("select",)),
}
#: Elements nested deeper are cut and counted.
MAX_DEPTH = 400

ANCESTOR = pa.struct([("id", pa.int32()), ("tag", pa.string()), ("role", pa.string()), ("cls", pa.string()), ("id_attr", pa.string())])
ARROW = pa.schema(
    [("page_id", pa.int64()), ("node_id", pa.int32()), ("parent_id", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("own_text", pa.string()), ("ancestors", pa.list_(ANCESTOR)), ("last_desc", pa.int32()), ("cut_below", pa.int32())]
)
NODES = "page_id bigint, node_id int, parent_id int, depth int, tag string, attrs map<string,string>, own_text string, ancestors array<struct<id:int,tag:string,role:string,cls:string,id_attr:string>>, last_desc int, cut_below int"


#: Tags and comments as most pages write them. Every version of the standard parser reads these alike; it gets whatever else a page has.
PLAIN = re.compile(r"""([^<]*)<(?:(/?)([a-z][a-z0-9]*)((?: [a-z][a-z0-9:-]*(?:="[^"<>&]*"|='[^'<>&]*')?)*)>|!(?:DOCTYPE|doctype) [^<>]*>|!-- [^<>-]* -->)""")
PLAIN_ATTR = re.compile(r""" ([a-z][a-z0-9:-]*)(?:="([^"]*)"|='([^']*)')?""")
#: Elements whose text some or all versions read in a way of its own, and where they all agree: no markup, nor references but in titles and text areas.
RAW_TEXT = {tag: re.compile(f"([^<{amp}]*)</{tag}>") for amp, tags in (("", "script style title textarea"), ("&", "iframe noembed noframes noscript plaintext xmp")) for tag in tags.split()}


class PageWalk(HTMLParser):
    """Rows of one page in pre-order; text runs are rows with tag ``#text`` (``#raw`` inside script and style)."""

    def __init__(self, page_id: int | None) -> None:
        super().__init__(convert_charrefs=True)
        self.page_id, self.rows = page_id, []
        self.open, self.tags, self.paths = [], [], [()]  # open elements, their tags, and the ids above their children

    def add(self, tag: str, attrs: dict[str, str], text: str | None) -> dict:
        n, above = len(self.rows), self.paths[-1]
        row = {"page_id": self.page_id, "node_id": n, "parent_id": above[-1] if above else None, "depth": len(above), "tag": tag, "attrs": attrs, "own_text": text, "last_desc": n, "cut_below": 0, "above": above}
        self.rows.append(row)
        return row

    def close_to(self, depth: int) -> None:
        while len(self.open) > depth:
            self.open.pop()["last_desc"] = len(self.rows) - 1
            self.tags.pop()
            self.paths.pop()

    def close_nearest(self, tags: tuple[str, ...], fence: tuple[str, ...]) -> None:
        for k in range(len(self.tags) - 1, -1, -1):
            if self.tags[k] in tags:
                self.close_to(k)
                return
            if self.tags[k] in fence:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ENDS_PARAGRAPH and "p" in self.tags:
            self.close_nearest(("p",), ("button", "td", "th", "table", "caption", "template"))
        if tag in IMPLIED_END:
            self.close_nearest(*IMPLIED_END[tag])
        if len(self.open) > MAX_DEPTH:
            self.open[-1]["cut_below"] += 1
            return
        row = self.add(tag, {k: v or "" for k, v in reversed(attrs)}, None)  # the first of equal attributes counts
        if tag not in VOID:
            self.open.append(row)
            self.tags.append(tag)
            self.paths.append((*row["above"], row["node_id"]))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.tags:
            self.close_nearest((tag,), ())

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.add("#raw" if self.tags and self.tags[-1] in NO_PROSE else "#text", {}, data)

    def plain(self, html: str) -> int:
        """Read plain markup from the start; where the rest begins."""
        at = 0
        while m := PLAIN.match(html, at):
            text, slash, tag, attrs = m.groups()
            raw = None if slash or tag not in RAW_TEXT else RAW_TEXT[tag].match(html, m.end())
            if slash and attrs or not slash and tag in RAW_TEXT and not raw:
                break
            if text:
                self.handle_data(unescape(text))
            at = m.end()
            if slash:
                self.handle_endtag(tag)
            elif tag:
                self.handle_starttag(tag, [(k, v or w) for k, v, w in PLAIN_ATTR.findall(attrs)] if attrs else [])
                if raw:
                    if raw[1]:
                        self.handle_data(raw[1] if tag in CDATA else unescape(raw[1]))
                    self.handle_endtag(tag)
                    at = raw.end()
        return at


def page_rows(page_id: int | None, html: str | None) -> list[dict]:
    walk, html = PageWalk(page_id), html or ""
    walk.feed(html[walk.plain(html) :])
    walk.close()
    walk.close_to(0)
    return walk.rows


def offsets(lists: list) -> pa.Array:
    return pa.array(accumulate(map(len, lists), initial=0), pa.int32())


def node_batch(pages: list[list[dict]]) -> pa.RecordBatch:
    """The rows of whole pages as one batch; ancestors are gathered from the columns of the rows they are."""
    rows = [r for page in pages for r in page]
    attrs = [r["attrs"] for r in rows]
    column = lambda name: pa.array([r[name] for r in rows], ARROW.field(name).type)
    said = lambda name: pa.array([a.get(name) for a in attrs], pa.string())
    first = accumulate(map(len, pages), initial=0)
    above = pa.array([start + k for start, page in zip(first, pages) for r in page for k in r["above"]], pa.int32())
    made = {c: column(c) for c in ("page_id", "node_id", "parent_id", "depth", "tag", "own_text", "last_desc", "cut_below")}
    made["attrs"] = pa.MapArray.from_arrays(offsets(attrs), pa.array([k for a in attrs for k in a], pa.string()), pa.array([v for a in attrs for v in a.values()], pa.string()))
    parts = (made["node_id"], made["tag"], said("role"), said("class"), said("id"))
    made["ancestors"] = pa.ListArray.from_arrays(offsets([r["above"] for r in rows]), pa.StructArray.from_arrays([p.take(above) for p in parts], fields=list(ANCESTOR)))
    return pa.RecordBatch.from_arrays([made[f.name] for f in ARROW], schema=ARROW)


#: Rows of nodes from which a batch is sent on.
BATCH_ROWS = 5000


def html_nodes(pages: DataFrame) -> DataFrame:
    """One row per element and text run of ``pages(page_id, html)``, in pre-order within the page.

    ``[node_id, last_desc]`` spans a subtree, so "contains" is a range test.
    Unclosed, void and stray tags are tolerated; a null or empty page has no
    rows; elements deeper than ``MAX_DEPTH`` are counted in ``cut_below`` of the
    deepest one kept. Other columns of ``pages`` are not read. A narrow map:
    rows of a page stay together and nothing is shuffled.

    Spark takes nodes to be as many as pages and as small; their joins are told
    to merge, for a table that it thinks small would be sent whole to the driver.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done: list[list[dict]] = []
            n = 0
            for page_id, html in zip(batch.column(0), batch.column(1)):
                done.append(page_rows(page_id.as_py(), html.as_py()))
                n += len(done[-1])
                if n > BATCH_ROWS:
                    yield node_batch(done)
                    done, n = [], 0
            if n:
                yield node_batch(done)

    bounded_batches(pages.sparkSession)
    return pages.select("page_id", "html").mapInArrow(parse, NODES).hint("merge")


def parsed_once(pages: DataFrame) -> DataFrame:
    """``html_nodes`` written to the shared folder and read again.

    For queries that read the nodes several times: the pages are parsed once, and
    a step reads only the columns and tags that it uses. Kept in memory, nodes of
    many pages (a row repeats its ancestors) would fill the executors.
    """
    return stored(html_nodes(pages)).hint("merge")
