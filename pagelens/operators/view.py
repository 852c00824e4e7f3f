"""Budgeted views: ranking by quota, the ladder of rungs, what to read next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelens.operators.fold import ordered_fold

CLASSES = ("nav", "form_control", "primary", "other", "prose_link")
#: Caps of the 16 rungs (regions, quotas of nav, form, primary, other, lead, headings, fields, next calls, forms and tables; null is no cap).
RUNGS = (
    (1, None, 60, 120, 32, 24, 420, 40, 40, 6, None), (2, 36, 58, 118, 31, 23, 410, 39, 39, 6, None), (3, 33, 55, 114, 30, 22, 395, 38, 38, 6, None), (4, 30, 52, 110, 29, 21, 380, 36, 36, 6, 60),
    (5, 27, 49, 104, 28, 20, 365, 35, 35, 5, 50), (6, 24, 46, 98, 26, 18, 350, 33, 33, 5, 40), (7, 22, 43, 92, 25, 17, 330, 31, 31, 5, 32), (8, 20, 40, 86, 23, 15, 310, 30, 30, 5, 26),
    (9, 18, 36, 78, 21, 13, 280, 28, 27, 5, 22), (10, 16, 32, 68, 19, 11, 250, 25, 24, 4, 18), (11, 14, 28, 56, 17, 9, 220, 22, 21, 4, 15), (12, 12, 24, 44, 15, 7, 180, 19, 18, 4, 12),
    (13, 11, 22, 36, 13, 5, 140, 17, 15, 4, 10), (14, 10, 20, 28, 11, 3, 0, 14, 12, 3, 8), (15, 8, 16, 20, 8, 0, 0, 10, 6, 3, 6), (16, 6, 12, 12, 6, 0, 0, 6, 4, 2, 4),
)


UNITS = ("region", "nav", "form_control", "primary", "other", "lead", "heading", "field", "next_call", "form")
#: Units that each view shows, and how much further the forms view reads fields.
VIEWS = {
    "auto": (*UNITS, "prose_link"),
    "outline": ("region", "lead", "heading", "next_call"),
    "act": ("region", "nav", "form_control", "primary", "other", "prose_link", "next_call"),
    "forms": ("region", "form_control", "field", "form", "next_call"),
    "tables": ("region", "form", "next_call"),
}
FORMS_FIELDS = 12


def rung_table(spark: SparkSession, links: bool = False, view: str = "auto") -> DataFrame:
    """The rungs as rows ``(rung, unit, cap)`` for a view; ``links`` lifts the quota of prose links from zero, ``forms`` scales that of fields."""
    if view not in VIEWS:
        raise ValueError(f"a view is one of {', '.join(VIEWS)}")
    scaled = lambda u, c: c * FORMS_FIELDS if view == "forms" and u == "field" and c is not None else c
    rows = [(r[0], u, scaled(u, c)) for r in RUNGS for u, c in zip(UNITS, r[1:]) if u in VIEWS[view]]
    rows += [(r[0], "prose_link", None if links else 0) for r in RUNGS if "prose_link" in VIEWS[view]]
    return spark.createDataFrame(rows, "rung int, unit string, cap int")


def view(units: DataFrame, kind: str = "auto", rung: int = 1, links: bool = False) -> DataFrame:
    """``units(page_id, unit, pos, …)`` that a view shows at a rung, the first ``cap`` of each kind in order, with ``total`` and ``suppressed`` of the kind.

    Units of kinds outside the view are left out.
    """
    w = W.partitionBy("page_id", "unit")
    caps = rung_table(units.sparkSession, links, kind).where(F.col("rung") == rung).select("unit", "cap")
    place, total = unused("place", units), F.count("*").over(w)
    ranked = units.join(F.broadcast(caps), "unit").withColumn(place, F.row_number().over(w.orderBy("pos"))).withColumn("total", total)
    kept = ranked.where(F.col("cap").isNull() | (F.col(place) <= F.col("cap")))
    return kept.withColumn("suppressed", F.greatest(F.col("total") - F.coalesce("cap", "total"), F.lit(0))).drop(place, "cap")


def unused(name: str, df: DataFrame) -> str:
    while name in df.columns:
        name += "_"
    return name


def rank_score(name: Column, in_viewport: Column, area: Column, top: Column, has_state: Column) -> Column:
    """Rank of a control: named, in view, large, high up, with a state."""
    return F.when(F.coalesce(name, F.lit("")) != "", 8.0).otherwise(-6.0) + F.when(in_viewport, 6.0).otherwise(0.0) + F.least(F.lit(6.0), F.sqrt(area) / 20) - F.least(F.lit(6.0), top / 2000) + F.when(has_state, 1.0).otherwise(0.0)


def select_by_quota(units: DataFrame, quotas: dict[str, int], score: str = "score") -> DataFrame:
    """The best units of each class of a page, in document order, with the suppressed count of the class."""
    cap = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv)), F.col("cls")), F.lit(0))
    n = F.row_number().over(W.partitionBy("page_id", "cls").orderBy(F.desc(score), "node_id"))
    total = F.count("*").over(W.partitionBy("page_id", "cls"))
    return units.withColumn("__n", n).withColumn("cls_total", total).where(F.col("__n") <= cap).withColumn("suppressed", F.greatest(F.col("cls_total") - cap, F.lit(0))).drop("__n")


def budget_ladder(units: DataFrame, budget: int = 5000, links: bool = False) -> DataFrame:
    """The first rung whose cost fits each page of ``units(page_id, unit, pos, tokens)``.

    A rung keeps the first ``cap`` of each unit. The page may spend ``budget``
    less a tenth, at least 120. A rung that costs more than an earlier one is
    skipped; where none fits, ``rung`` is null and ``floor`` the least cost.
    Costs come from running sums per unit, so a page is not multiplied by rungs.
    """
    rungs = rung_table(units.sparkSession, links)
    running = units.withColumn("n", F.row_number().over(W.partitionBy("page_id", "unit").orderBy("pos"))).withColumn("sofar", F.sum("tokens").over(W.partitionBy("page_id", "unit").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)))
    packed = running.groupBy("page_id", "unit").agg(F.array_sort(F.collect_list(F.struct("n", "sofar")))["sofar"].alias("cost"))  # one number per unit of the page
    priced = packed.join(F.broadcast(rungs), "unit").withColumn("k", F.least(F.coalesce("cap", F.size("cost")), F.size("cost"))).withColumn("c", F.when(F.col("k") > 0, F.get("cost", F.col("k") - 1)).otherwise(0))
    total = priced.groupBy("page_id", "rung").agg(F.sum("c").cast("long").alias("total"))
    before = F.min("total").over(W.partitionBy("page_id").orderBy("rung").rowsBetween(W.unboundedPreceding, -1))
    effective = max(120, budget - budget // 10)
    fits = (F.col("total") <= effective) & (F.col("before").isNull() | (F.col("total") <= F.col("before")))
    walked = total.withColumn("before", before)
    return walked.groupBy("page_id").agg(F.min(F.when(fits, F.col("rung"))).alias("rung"), F.min_by(F.when(fits, F.col("total")), F.when(fits, F.col("rung"))).alias("tokens"), F.min("total").alias("floor"))


def next_calls(regions: DataFrame, limit: int = 6) -> DataFrame:
    """Regions most worth reading next."""
    value = 2 * (F.col("interactive") - F.col("prose_links")) + 3 * F.col("headings") + F.least("text_blocks", F.lit(40))
    value = F.when(F.coalesce("has_children", F.lit(False)), value * 0.4).otherwise(value.cast("double"))
    ranked = regions.withColumn("value", value).where("value > 0").withColumn("rank", F.row_number().over(W.partitionBy("page_id").orderBy(F.desc("value"), "region_id")))
    return ranked.where(F.col("rank") <= limit)


STATUSES = ("printed", "summarized", "suppressed_by_quota", "dropped_by_rung", "listed_not_expanded", "not_reached", "listed_container_only", "no_content")


def unit_ledger(units: DataFrame, caps: dict[str, int | None], quotas: dict[str, int], field_cap: int | None = None) -> DataFrame:
    """``units`` with ``status``, what a read of the page did with each: one of ``STATUSES``.

    ``units(page_id, kind, node_id, cls, pos, reached, owns, has_children,
    expanded, form_id)``, one row per thing the page has. In order:
    ``not_reached`` beyond the walk; a region without content of its own is
    ``listed_container_only`` with nested regions and ``no_content`` without; an
    affordance beyond the quota of its class (0 for a class without one) is
    ``suppressed_by_quota``; what is beyond the rung's cap of its kind (no cap:
    null) is ``dropped_by_rung``; a region that is not opened is
    ``listed_not_expanded``; a field of a dropped form goes with it, one beyond
    ``field_cap`` of its form is ``summarized``; the rest is ``printed``. Ranks
    count only what an earlier rule left. Nulls count as false, a null kind has no cap.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    table = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv)) if d else F.create_map().cast("map<string,int>")
    cap = F.element_at(table({k: v for k, v in caps.items() if v is not None}), F.coalesce("kind", F.lit("")))
    quota = F.coalesce(F.element_at(table(quotas), F.coalesce("cls", F.lit(""))), F.lit(0))
    empty = (F.col("kind") == "region") & ~flag("owns")
    early = F.when(~flag("reached"), "not_reached").when(empty & flag("has_children"), "listed_container_only").when(empty, "no_content")
    rows = units.withColumn("__early", early)
    order = ["pos", "node_id"]
    within = F.row_number().over(W.partitionBy("page_id", "kind", "cls", F.col("__early").isNull()).orderBy(*order))
    rows = rows.withColumn("__early", F.when(F.col("__early").isNull() & (F.col("kind") == "affordance") & (within > quota), "suppressed_by_quota").otherwise(F.col("__early")))
    rank = F.row_number().over(W.partitionBy("page_id", "kind", F.col("__early").isNull()).orderBy(*order))
    is_field = F.col("kind") == "field"
    rows = rows.withColumn("__early", F.when(F.col("__early").isNull() & ~F.coalesce(is_field, F.lit(False)) & (rank > cap), "dropped_by_rung").otherwise(F.col("__early")))
    lost = rows.where("kind = 'form' and __early is not null").select("page_id", F.col("node_id").alias("form_id"), F.lit(True).alias("__lost")).distinct()
    rows = rows.join(lost, ["page_id", "form_id"], "left").withColumn("__early", F.when(F.col("__early").isNull() & is_field & F.col("__lost"), "dropped_by_rung").otherwise(F.col("__early")))
    field = F.row_number().over(W.partitionBy("page_id", "form_id", F.col("__early").isNull() & F.coalesce(is_field, F.lit(False))).orderBy(*order))
    much = F.lit(False) if field_cap is None else F.coalesce(is_field, F.lit(False)) & (field > field_cap)
    closed = (F.col("kind") == "region") & ~flag("expanded")
    status = F.when(F.col("__early").isNotNull(), F.col("__early")).when(closed, "listed_not_expanded").when(much, "summarized").otherwise("printed")
    return rows.withColumn("status", status).drop("__early", "__lost")


def completeness(ledger: DataFrame) -> DataFrame:
    """``page_id, kind, status, cls, n, level``: units of each page by kind, status and class, with subtotals by kind and status, by kind and by page, from one aggregation over grouping sets.

    Every unit of the ledger is counted once on each level, so the statuses of a
    page sum to its census.
    """
    sets = [["page_id", "kind", "status", "cls"], ["page_id", "kind", "status"], ["page_id", "kind"], ["page_id"]]
    level = F.when(F.grouping("kind") == 1, "page").when(F.grouping("status") == 1, "kind").when(F.grouping("cls") == 1, "status").otherwise("class")
    return ledger.groupingSets(sets, "page_id", "kind", "status", "cls").agg(F.count("*").alias("n"), level.alias("level"))


def pack_parts(parts: DataFrame, ceiling: int = 400) -> DataFrame:
    """Greedy packing of ``parts(owner, pos, name, tokens)`` in order: a part is kept if the sum stays under the ceiling; later smaller ones may still fit.

    ``owner, tokens, kept, dropped``, the names joined by commas.
    """

    def step(state: list[int], row: tuple) -> tuple:
        owner, pos, name, tokens = row
        fits = state[0] + tokens <= ceiling
        state[0] += tokens * fits
        return owner, pos, name, tokens, fits

    kind = lambda c: parts.select(c).schema[0].dataType.simpleString()
    rows = parts.select("owner", "pos", "name", F.col("tokens").cast("long").alias("tokens"))
    packed = ordered_fold(rows, "owner", ["pos", "name"], lambda: [0], step, f"owner {kind('owner')}, pos {kind('pos')}, name string, tokens long, fits boolean")
    names = lambda fits: F.array_join(F.array_sort(F.collect_list(F.when(F.col("fits") == fits, F.struct("pos", "name"))))["name"], ",")
    return packed.groupBy("owner").agg(F.coalesce(F.sum(F.when(F.col("fits"), F.col("tokens"))), F.lit(0)).alias("tokens"), names(True).alias("kept"), names(False).alias("dropped"))


def fit_columns(cells: DataFrame, budget: int = 5000) -> DataFrame:
    """Columns of each table kept when the number is halved from the right until the priced cells of ``cells(table_id, col_ix, tokens)`` fit."""
    per = cells.groupBy("table_id", "col_ix").agg(F.sum("tokens").alias("t"))
    w = W.partitionBy("table_id").orderBy("col_ix")
    prefix = per.withColumn("n", F.row_number().over(w)).withColumn("cost", F.sum("t").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("total", F.count("*").over(W.partitionBy("table_id")))
    halves = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: F.greatest(F.floor(F.col("total") / F.pow(F.lit(2), k)), F.lit(1)))
    tried = prefix.where(F.array_contains(halves, F.col("n").cast("long")))
    return tried.groupBy("table_id").agg(F.max("total").alias("total"), F.coalesce(F.max(F.when(F.col("cost") <= budget, F.col("n"))), F.lit(1)).alias("kept")).withColumn("dropped", F.col("total") - F.col("kept"))
