"""Tables of stored pages by the million: a page's rows are walked where they were parsed, and no node is stored, joined or shuffled.

The results are those of ``tables.table_inventory`` and ``tables.table_cells`` over
the nodes of the same pages.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from pagelens.operators.nodes import page_rows
from pagelens.operators.tables import BLOCKISH, CELL_CHARS, CELL_ROLES, MAX_SPAN, TABLE_ROLES, in_slots
from pagelens.session import bounded_batches

INVENTORY = pa.schema([("page_id", pa.int64()), ("table_id", pa.int32()), ("table_ix", pa.int32()), ("kind", pa.string()), ("caption", pa.string()), ("rows", pa.int64()), ("cols", pa.int64())])
INVENTORY_SQL = "page_id bigint, table_id int, table_ix int, kind string, caption string, rows bigint, cols bigint"
CELLS = pa.schema(
    [("page_id", pa.int64()), ("table_id", pa.int32()), ("row_ix", pa.int32()), ("col_ix", pa.int32()), ("text", pa.string()), ("is_th", pa.bool_()), ("in_head", pa.bool_()), ("copied", pa.bool_()), ("clipped", pa.bool_()), ("table_rows", pa.int32()), ("first_data_row", pa.int32()), ("width", pa.int32())]
)
CELLS_SQL = "page_id bigint, table_id int, row_ix int, col_ix int, text string, is_th boolean, in_head boolean, copied boolean, clipped boolean, table_rows int, first_data_row int, width int"
#: Rows of the result from which a batch is sent on.
BATCH_ROWS = 20_000
PARTS = frozenset(("caption", "thead", *BLOCKISH))
BLANKS = re.compile("[ \t\n\x0b\f\r\xa0]+")
WHOLE = re.compile(r"[\x00-\x20]*([+-]?[0-9]+)[\x00-\x20]*")


def squash(text: str) -> str:
    """As ``functions.text.squash``."""
    return BLANKS.sub(" ", text).strip(" ")


def span(attrs: dict[str, str], *names: str) -> int:
    for name in names:
        m = WHOLE.fullmatch(attrs.get(name, ""))
        if m and -(2**31) <= int(m[1]) < 2**31:
            return min(max(int(m[1]), 1), MAX_SPAN)
    return 1


class PageTables:
    """What one page's rows say about its tables, in one pass from parents to children."""

    def __init__(self, rows: list[dict]) -> None:
        self.rows = rows
        self.tables: list[dict] = []
        self.first_row, self.first_cell, self.n_rows, self.n_cells = {}, {}, {}, {}
        self.marked, self.nests, self.blocks = set(), set(), set()
        self.captions, self.ids = {}, {}
        self.units: dict[int, list[tuple]] = {}  # of each table: rows and cells in order
        self.texts: dict[int, list[str]] = {}
        outside = (None, None, (), False, False)
        below: dict[int | None, tuple] = {None: outside}  # nearest table and row, cells, in a head, in a foot
        for r in rows:
            tag, n, above = r["tag"], r["node_id"], below[r["parent_id"]]
            owner, row, cells, head, foot = above
            if tag[0] == "#":
                if cells and tag == "#text":
                    for c in cells:
                        self.texts.setdefault(c, []).append(r["own_text"])
                continue
            attrs = r["attrs"]
            role = attrs.get("role") if attrs else None
            is_row, is_cell = tag == "tr" or role == "row", tag in ("td", "th") or role in CELL_ROLES
            is_table = tag == "table" or role is not None and role.strip(" ").split(" ")[0].lower() in TABLE_ROLES
            if attrs and "id" in attrs:
                self.ids.setdefault(attrs["id"], n)
            if tag == "caption":
                self.captions.setdefault(r["parent_id"], n)
            if is_table:
                self.tables.append(r)
            if owner is not None and (is_row or is_cell or is_table or tag in PARTS):
                self.part(r, tag, owner, row, cells, is_row, is_cell, is_table)
                if is_cell:
                    self.units.setdefault(owner, []).append((n if row is None else row, n, None, tag == "th" or role in ("columnheader", "rowheader"), head))
                elif is_row:
                    self.units.setdefault(owner, []).append((n, None, 0 if head else 2 if foot else 1, False, head))
            if is_row or is_cell or tag in ("table", "thead", "tfoot") or role in TABLE_ROLES:
                above = (n if tag == "table" or role in TABLE_ROLES else owner, n if is_row else row, (*cells, n) if is_cell else cells, head or tag == "thead", foot or tag == "tfoot")
            below[n] = above

    def part(self, r: dict, tag: str, owner: int, row: int | None, cells: tuple, is_row: bool, is_cell: bool, is_table: bool) -> None:
        if is_row:
            self.first_row.setdefault(owner, r["node_id"])
            self.n_rows[owner] = self.n_rows.get(owner, 0) + 1
        if is_cell:
            self.first_cell.setdefault(owner, r["node_id"])
            counts = self.n_cells.setdefault(owner, {})
            counts[row] = counts.get(row, 0) + 1
        if tag in ("th", "thead", "caption"):
            self.marked.add(owner)
        if is_table:
            self.nests.add(owner)
        if tag in BLOCKISH and cells and cells[-1] == self.first_cell.get(owner):
            self.blocks.add(owner)

    def inner(self, n: int) -> str:
        return squash("".join(r["own_text"] for r in self.rows[n + 1 : self.rows[n]["last_desc"] + 1] if r["tag"] == "#text"))

    def is_layout(self, r: dict) -> bool:
        n, attrs = r["node_id"], r["attrs"]
        if attrs.get("role", "").strip(" ").lower() in ("presentation", "none"):
            return True
        leading = self.n_cells.get(n, {}).get(self.first_row[n], 0) if n in self.first_row else 0
        small = n not in self.marked and not attrs.get("summary") and (self.n_rows.get(n, 0) <= 1 or leading <= 1) and n in self.blocks
        return r["tag"] == "table" and (n in self.nests or small)

    def data_tables(self) -> list[dict]:
        """The outermost tables that are not layout."""
        out, end = [], -1
        for r in self.tables:
            if r["node_id"] > end and not self.is_layout(r):
                out.append(r)
                end = r["last_desc"]
        return out

    def caption(self, r: dict) -> str:
        if r["node_id"] in self.captions:
            return self.inner(self.captions[r["node_id"]])
        label = squash(r["attrs"].get("aria-label", ""))
        named = self.ids.get(r["attrs"]["aria-labelledby"].strip(" ").split(" ")[0]) if not label and "aria-labelledby" in r["attrs"] else None
        return label if named is None else self.inner(named)

    def inventory(self) -> Iterator[tuple]:
        for ix, r in enumerate(self.data_tables()):
            n, role = r["node_id"], r["attrs"].get("role", "").strip(" ").lower()
            kind = "table" if r["tag"] == "table" else "div-grid" if role in ("grid", "treegrid") else "div-table"
            yield r["page_id"], n, ix, kind, self.caption(r), self.n_rows.get(n, 0), max(self.n_cells.get(n, {}).values(), default=0)

    def cells(self) -> Iterator[tuple]:
        for r in self.data_tables():
            units = self.units.get(r["node_id"], [])
            parts: dict[int, int] = {}
            for row, cell, part, _, _ in units:
                parts[row] = max(parts.get(row, -1), -1 if part is None else part)
            at = {row: ix for ix, row in enumerate(sorted(parts, key=lambda row: (parts[row], row)))}
            found = []
            for row, cell, _, is_th, head in units:
                if cell is not None:
                    text, attrs = squash("".join(self.texts.get(cell, ()))), self.rows[cell]["attrs"]
                    clipped = len(text) > CELL_CHARS
                    found.append({"row_ix": at[row], "unit": cell, "text": text[:CELL_CHARS] + "..." if clipped else text, "is_th": is_th, "in_head": head, "rowspan": span(attrs, "rowspan", "aria-rowspan") if attrs else 1, "colspan": span(attrs, "colspan", "aria-colspan") if attrs else 1, "clipped": clipped})
            found.sort(key=lambda x: (x["row_ix"], x["unit"]))
            slots, deep = in_slots(len(at), found)
            heads: dict[int, tuple[bool, bool]] = {}
            for (row, _), v in slots:
                th, head = heads.get(row, (True, True))
                heads[row] = th and v[1], head and v[2]
            # an empty row ends the headers too
            data = next((k for k, (row, (th, head)) in enumerate(heads.items()) if k != row or not (th or head)), max(heads, default=-1) + 1)
            width = max((c for (_, c), _ in slots), default=-1) + 1
            for (row, col), v in slots:
                yield (r["page_id"], r["node_id"], row, col, *v, deep, data, width)


def walked(pages: DataFrame, told: Callable[[PageTables], Iterator[tuple]], schema: pa.Schema, sql: str) -> DataFrame:
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        out: list[tuple] = []
        for batch in batches:
            for page_id, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out.extend(told(PageTables(page_rows(page_id, html))))
                if len(out) > BATCH_ROWS:
                    yield made(out)
                    out = []
        if out:
            yield made(out)

    bounded_batches(pages.sparkSession)
    return pages.select("page_id", "html").mapInArrow(walk, sql)


def page_inventory(pages: DataFrame) -> DataFrame:
    """``tables.table_inventory`` of ``pages(page_id, html)``; a narrow map."""
    return walked(pages, PageTables.inventory, INVENTORY, INVENTORY_SQL)


def page_cells(pages: DataFrame) -> DataFrame:
    """``tables.table_cells`` of ``pages(page_id, html)`` with ``first_data_row`` and ``width`` of their tables; a narrow map."""
    return walked(pages, PageTables.cells, CELLS, CELLS_SQL)
