"""Tables and lists of stored pages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelens.functions import text as T
from pagelens.functions import urls as U
from pagelens.operators.structure import attr, inner_text, role_of, under
from pagelens.session import stored

CELL_CHARS = 200
#: Spans are no wider than this, whatever a page says.
MAX_SPAN = 1000
TABLE_ROLES = ("table", "grid", "treegrid")
CELL_ROLES = ("columnheader", "rowheader", "cell", "gridcell")
#: Content of a cell that makes a small table one of layout.
BLOCKISH = ("table", "div", "p", "ul", "ol", "form", "section", "article", "nav", "h1", "h2", "h3")


def is_table() -> Column:
    return (F.col("tag") == "table") | role_of().isin(*TABLE_ROLES)


def above(test) -> Column:
    """Id of the nearest ancestor that passes ``test``."""
    return F.get(F.filter(F.reverse("ancestors"), lambda x: F.coalesce(test(x), F.lit(False))), F.lit(0))["id"]


def table_above() -> Column:
    return above(lambda x: (x["tag"] == "table") | x["role"].isin(*TABLE_ROLES))


def is_row() -> Column:
    return (F.col("tag") == "tr") | F.coalesce(attr("role") == "row", F.lit(False))


def row_above() -> Column:
    return above(lambda x: (x["tag"] == "tr") | (x["role"] == "row"))


def is_cell(x: Column | None = None) -> Column:
    """A cell of either kind, of a node or of an ancestor ``x``."""
    tag, role = (F.col("tag"), attr("role")) if x is None else (x["tag"], x["role"])
    return tag.isin("td", "th") | F.coalesce(role.isin(*CELL_ROLES), F.lit(False))


def table_inventory(nodes: DataFrame) -> DataFrame:
    """Data tables of each page: layout tables left out first, then the outermost kept, numbered in order.

    A layout table has a presentational role, contains another table, or has no
    header cells, caption or summary, at most one row or a first row of at most
    one cell, and block content in its first cell. ``kind`` is ``table``,
    ``div-table`` or ``div-grid``; the caption comes from ``caption``,
    ``aria-label`` or the element that ``aria-labelledby`` names first.
    """
    tables = nodes.where(is_table()).select("page_id", "node_id", "tag", F.lower(F.trim(F.coalesce(attr("role"), F.lit("")))).alias("role"), attr("summary").alias("summary"), attr("aria-label").alias("label"), F.substring_index(F.trim(attr("aria-labelledby")), " ", 1).alias("label_id"), "last_desc")
    parts = nodes.where(is_row() | is_cell() | F.col("tag").isin("caption", "thead", *BLOCKISH) | is_table())
    parts = parts.select("page_id", "node_id", "tag", is_row().alias("row"), is_cell().alias("cell"), is_table().alias("nested"), row_above().alias("row_id"), above(is_cell).alias("cell_id"), table_above().alias("owner")).where("owner is not null")
    first_row = F.min(F.when(F.col("row"), F.col("node_id"))).over(W.partitionBy("page_id", "owner"))
    first_cell = F.min(F.when(F.col("cell"), F.col("node_id"))).over(W.partitionBy("page_id", "owner"))
    placed = parts.withColumn("first_row", first_row).withColumn("first_cell", first_cell)
    per_row = placed.where("cell").groupBy("page_id", "owner", "row_id").agg(F.count("*").alias("n"), F.max(F.col("row_id") == F.col("first_row")).alias("leads"))
    cells = per_row.groupBy("page_id", "owner").agg(F.max("n").alias("cols"), F.max(F.when(F.col("leads"), F.col("n"))).alias("first_cols"))
    block = F.col("tag").isin(*BLOCKISH) & (F.col("cell_id") == F.col("first_cell"))
    facts = placed.groupBy("page_id", "owner").agg(F.count_if("row").alias("rows"), F.max(F.col("tag").isin("th", "thead", "caption")).alias("marked"), F.max("nested").alias("nests"), F.max(F.coalesce(block, F.lit(False))).alias("blocks"))
    known = tables.join(facts.join(cells, ["page_id", "owner"], "left").withColumnRenamed("owner", "node_id"), ["page_id", "node_id"], "left").na.fill(0, ["rows", "cols", "first_cols"]).na.fill(False, ["marked", "nests", "blocks"])
    small = ~F.col("marked") & (F.coalesce("summary", F.lit("")) == "") & ((F.col("rows") <= 1) | (F.col("first_cols") <= 1)) & F.col("blocks")
    layout = F.col("role").isin("presentation", "none") | ((F.col("tag") == "table") & (F.col("nests") | small))
    kept = stored(known.where(~layout)).hint("merge")  # met four times; as many as the tables, though small on disk
    outer = kept.select(F.col("page_id").alias("op"), F.col("node_id").alias("o"), F.col("last_desc").alias("ol"))
    top = kept.join(outer, (F.col("page_id") == F.col("op")) & (F.col("node_id") > F.col("o")) & (F.col("node_id") <= F.col("ol")), "left_anti")
    captions = inner_text(nodes, nodes.where("tag = 'caption'")).select("page_id", F.col("parent_id").alias("node_id"), F.col("inner").alias("caption")).groupBy("page_id", "node_id").agg(F.first("caption").alias("caption"))
    named = inner_text(nodes, nodes.where(attr("id").isNotNull()).join(top.select("page_id").distinct(), "page_id", "left_semi")).select("page_id", attr("id").alias("label_id"), F.col("inner").alias("named")).groupBy("page_id", "label_id").agg(F.first("named").alias("named"))
    told = top.join(captions, ["page_id", "node_id"], "left").join(named, ["page_id", "label_id"], "left")
    kind = F.when(F.col("tag") == "table", "table").when(F.col("role").isin("grid", "treegrid"), "div-grid").otherwise("div-table")
    return told.select("page_id", F.col("node_id").alias("table_id"), (F.row_number().over(W.partitionBy("page_id").orderBy("node_id")) - 1).alias("table_ix"), kind.alias("kind"), F.coalesce("caption", F.nullif(T.squash(F.col("label")), F.lit("")), "named", F.lit("")).alias("caption"), "rows", "cols")


def table_choice(inventory: DataFrame, index: int | None = None) -> DataFrame:
    """``page_id, table_id, refused, choices``: the table of each page that a read without a location means.

    Without ``index`` a page of several tables is refused as ``ambiguous``, with
    ``choices`` to pick from; an index that no table has is ``index-out-of-range``.
    Pages without a table have no row.
    """
    each = F.array_sort(F.collect_list(F.struct(F.col("table_ix").alias("index"), "kind", "caption", "rows", "table_id")))
    pages = inventory.groupBy("page_id").agg(each.alias("t"))
    at = F.lit(0) if index is None else F.lit(index)
    refused = F.when(F.lit(index is None) & (F.size("t") > 1), "ambiguous").when(F.lit(index is not None) & ((at < 0) | (at >= F.size("t"))), "index-out-of-range")
    choices = F.transform("t", lambda x: F.struct(x["index"], x["kind"], x["caption"], x["rows"]))
    return pages.withColumn("refused", refused).select("page_id", F.when(F.col("refused").isNull(), F.get("t", at)["table_id"]).alias("table_id"), "refused", F.when(F.col("refused").isNotNull(), choices).alias("choices"))


CELLS = "page_id long, table_id int, row_ix int, col_ix int, text string, is_th boolean, in_head boolean, copied boolean, clipped boolean, table_rows int"


def in_slots(rows: int, cells: list[dict]) -> tuple[list[tuple], int]:
    """Cells of one table of ``rows`` rows in their slots, in order, and how many rows they fill; a later cell takes a slot over an earlier span."""
    slots: dict[tuple[int, int], tuple] = {}
    at, c = -1, 0
    for x in cells:
        if x["row_ix"] != at:
            at, c = x["row_ix"], 0
        while (at, c) in slots:
            c += 1
        for i in range(x["rowspan"]):
            for k in range(x["colspan"]):
                slots[at + i, c + k] = (x["text"], x["is_th"], x["in_head"], bool(i or k), x["clipped"])
        c += x["colspan"]
    return sorted(slots.items()), max([rows, *(r + 1 for r, _ in slots)])


def laid_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cells of whole tables with row and column spans, in their slots."""
    for pdf in batches:
        out: list[tuple] = []
        for page, table, rows, cells in zip(pdf["page_id"], pdf["table_id"], pdf["table_rows"], pdf["cells"]):
            slots, deep = in_slots(rows, cells)
            out += [(page, table, r, c, *v, deep) for (r, c), v in slots]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CELLS.split(", ")])


def table_cells(nodes: DataFrame, inventory: DataFrame) -> DataFrame:
    """``page_id, table_id, row_ix, col_ix, text, is_th, in_head, copied, clipped, table_rows`` with spans expanded.

    Rows are those of the table's head, body and foot, in this order, empty ones
    counted. Texts over 200 characters are clipped. Where ``nodes`` are those of
    ``hidden_nodes``, hidden text is left out. A cell's texts, row and table meet
    in one shuffle on the page, which all steps after share. Tables without
    spans are numbered by windows; the others are laid out cell by cell, many
    tables at a time.
    """
    span = lambda *names: F.least(F.greatest(F.coalesce(*(attr(n).try_cast("int") for n in names), F.lit(1)), F.lit(1)), F.lit(MAX_SPAN))
    shown = (F.col("tag") == "#text") & (F.col("hidden_reason").isNull() if "hidden_reason" in nodes.columns else F.lit(True))
    holders = F.transform(F.filter("ancestors", is_cell), lambda x: x["id"])
    cell = F.struct(table_above().alias("table_id"), row_above().alias("row_id"), ((F.col("tag") == "th") | F.coalesce(attr("role").isin("columnheader", "rowheader"), F.lit(False))).alias("is_th"), under("thead").alias("in_head"), span("rowspan", "aria-rowspan").alias("rowspan"), span("colspan", "aria-colspan").alias("colspan"))
    row = F.struct(table_above().alias("table_id"), F.when(under("thead"), 0).when(under("tfoot"), 2).otherwise(1).alias("part"))
    kept = nodes.where(is_row() | is_cell() | shown).select(
        "page_id", "node_id", "own_text", F.when(shown, holders).otherwise(F.array("node_id")).alias("of"), F.when(is_cell(), cell).alias("cell"), F.when(is_row() & ~is_cell(), row).alias("row")
    )
    kept = kept.where(F.size("of") > 0).repartition("page_id").withColumn("unit", F.explode("of"))
    texts = F.array_join(F.array_sort(F.collect_list(F.when(F.col("own_text").isNotNull(), F.struct("node_id", "own_text"))))["own_text"], "")
    units = kept.groupBy("page_id", "unit").agg(F.first("cell", True).alias("cell"), F.first("row", True).alias("row"), T.squash(texts).alias("text"))
    units = units.select("page_id", "unit", F.coalesce("cell.table_id", "row.table_id").alias("table_id"), F.coalesce("cell.row_id", "unit").alias("row_id"), F.col("row.part").alias("part"), "cell", "text")
    units = units.join(inventory.select("page_id", "table_id"), ["page_id", "table_id"], "left_semi")
    table, one_row = W.partitionBy("page_id", "table_id"), W.partitionBy("page_id", "table_id", "row_id")
    placed = units.withColumn("part", F.max("part").over(one_row))
    placed = placed.withColumn("row_ix", F.dense_rank().over(table.orderBy("part", "row_id")) - 1).withColumn("spans", F.max((F.col("cell.rowspan") > 1) | (F.col("cell.colspan") > 1)).over(table))
    placed = placed.withColumn("table_rows", F.max("row_ix").over(table) + 1).where("cell is not null")
    clipped = F.length("text") > CELL_CHARS
    placed = placed.select("page_id", "table_id", "row_ix", "unit", F.when(clipped, F.concat(F.left("text", F.lit(CELL_CHARS)), F.lit("..."))).otherwise(F.col("text")).alias("text"), clipped.alias("clipped"), "cell.is_th", "cell.in_head", "cell.rowspan", "cell.colspan", "spans", "table_rows")
    plain = placed.where("not spans").select("page_id", "table_id", "row_ix", (F.row_number().over(W.partitionBy("page_id", "table_id", "row_ix").orderBy("unit")) - 1).alias("col_ix"), "text", "is_th", "in_head", F.lit(False).alias("copied"), "clipped", "table_rows")
    whole = F.array_sort(F.collect_list(F.struct("row_ix", "unit", "text", "is_th", "in_head", "rowspan", "colspan", "clipped")))
    spanned = placed.where("spans").groupBy("page_id", "table_id", "table_rows").agg(whole.alias("cells")).mapInPandas(laid_out, CELLS)
    return plain.unionByName(spanned)


def with_first_data_row(cells: DataFrame) -> DataFrame:
    """``cells`` with ``first_data_row``: how many leading rows consist of header cells alone, or stand in the head altogether."""
    if "first_data_row" in cells.columns:
        return cells
    row, table = W.partitionBy("page_id", "table_id", "row_ix"), W.partitionBy("page_id", "table_id")
    heads = F.min("is_th").over(row) | F.min("in_head").over(row)
    marked = cells.withColumn("__head", heads)
    # an empty row ends the headers too: rows before it are consecutive
    order = F.dense_rank().over(table.orderBy("row_ix")) - 1
    marked = marked.withColumn("__head", F.col("__head") & (order == F.col("row_ix")))
    return marked.withColumn("first_data_row", F.coalesce(F.min(F.when(~F.col("__head"), order)).over(table), F.max("row_ix").over(table) + 1)).drop("__head")


def table_headers(cells: DataFrame) -> DataFrame:
    """Header of each column: its texts in the leading header rows joined by `` / ``, without empty ones and repeats in a row; ``first_data_row`` follows them."""
    heads = with_first_data_row(cells).where("row_ix < first_data_row")
    parts = F.filter(F.array_sort(F.collect_list(F.struct("row_ix", "text")))["text"], lambda x: x != "")
    joined = heads.groupBy("page_id", "table_id", "col_ix", "first_data_row").agg(parts.alias("p"))
    return joined.select("page_id", "table_id", "col_ix", "first_data_row", F.array_join(F.filter("p", lambda x, i: (i == 0) | (x != F.get("p", i - 1))), " / ").alias("header"))


def get_table(cells: DataFrame, start_row: int = 0, max_rows: int = 50, choice: DataFrame | None = None) -> DataFrame:
    """``page_id, table_id, row, cells, total_rows, next_start_row``: a page of data rows of each table, padded to the table's width; of the tables of ``table_choice`` alone, if given.

    ``row`` counts from the first data row. Rows without any cell are counted in
    ``total_rows`` and have no row of their own.
    """
    if choice is not None:
        cells = cells.join(choice.where("refused is null").select("page_id", "table_id"), ["page_id", "table_id"], "left_semi")
    sized = with_first_data_row(cells)
    if "width" not in sized.columns:
        sized = sized.withColumn("width", F.max("col_ix").over(W.partitionBy("page_id", "table_id")) + 1)
    data = sized.withColumn("row", F.col("row_ix") - F.col("first_data_row")).where(F.col("row").between(max(0, start_row), max(0, start_row) + max(1, max_rows) - 1))
    rows = data.groupBy("page_id", "table_id", "row").agg(F.map_from_entries(F.collect_list(F.struct("col_ix", "text"))).alias("m"), F.first("width").alias("width"), (F.first("table_rows") - F.first("first_data_row")).cast("long").alias("total_rows"))
    end = max(0, start_row) + max(1, max_rows)
    return rows.select("page_id", "table_id", "row", F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda c: F.coalesce(F.element_at("m", c), F.lit(""))).alias("cells"), "total_rows", F.when(F.col("total_rows") > end, F.lit(end)).alias("next_start_row"))


def list_items(nodes: DataFrame, pages: DataFrame, start_index: int = 0, max_items: int = 50) -> DataFrame:
    """Items of the outermost lists outside navigation with at least two items: term (for description lists), text, first link.

    Each item belongs to its outermost list; a description's term is the last
    ``dt`` before it.
    """
    top = F.get(F.filter("ancestors", lambda x: x["tag"].isin("ul", "ol", "dl") | (x["role"] == "list")), F.lit(0))["id"]
    near = F.get(F.filter(F.reverse("ancestors"), lambda x: x["tag"].isin("ul", "ol", "dl") | (x["role"] == "list")), F.lit(0))["id"]
    rows = inner_text(nodes, nodes.where(F.col("tag").isin("li", "dt", "dd") & ~under("nav"))).withColumn("list_id", top).where(top == near)
    w = W.partitionBy("page_id", "list_id").orderBy("node_id")
    termed = rows.withColumn("term", F.when(F.col("tag") == "dd", F.last(F.when(F.col("tag") == "dt", F.col("inner")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))).where("tag <> 'dt'")
    hrefs = nodes.where((F.col("tag") == "a") & attr("href").isNotNull()).select(F.col("page_id").alias("hp"), F.get(F.filter("ancestors", lambda x: x["tag"].isin("li", "dd")), F.lit(0))["id"].alias("item"), "node_id", attr("href").alias("href")).groupBy("hp", "item").agg(F.min_by("href", "node_id").alias("href"))
    linked = termed.join(hrefs, (F.col("page_id") == F.col("hp")) & (F.col("node_id") == F.col("item")), "left").join(pages.select("page_id", "url"), "page_id")
    w = W.partitionBy("page_id", "list_id")
    out = linked.withColumn("pos", F.row_number().over(w.orderBy("node_id")) - 1).withColumn("total", F.count("*").over(w)).where("total >= 2")
    return out.where(F.col("pos").between(start_index, start_index + max_items - 1)).select("page_id", "list_id", "pos", "total", "term", F.left("inner", F.lit(CELL_CHARS)).alias("text"), U.shorten_href(F.col("url"), F.col("href")).alias("href"))


