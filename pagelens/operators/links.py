"""Links, metadata, feeds, citations and paging of stored pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelens.functions import text as T
from pagelens.functions import urls as U
from pagelens.operators.structure import NO_PROSE, attr, inner_text, under
from pagelens.session import few, stored

#: Labels that mean "next page", and citation tags by field, best first.
NEXT_WORDS = ("next", "next page", "older", "older posts", "more", "»", "›", "→", "suivant", "weiter", "siguiente")
CITATION = {"title": ("citation_title", "dc.title"), "author": ("citation_author", "dc.creator"), "date": ("citation_publication_date", "citation_date", "dc.date"), "journal": ("citation_journal_title",), "doi": ("citation_doi", "dc.identifier"), "pdf": ("citation_pdf_url",)}
NAMED_METAS = ("description", "keywords", "author", "robots", "viewport", "generator")


def get_links(nodes: DataFrame, pages: DataFrame, kind: str | None = None, pattern: str | None = None, limit: int | None = 40) -> DataFrame:
    """Deduplicated links of each page by (kind, name, href), in order of first position, with counts.

    ``kind``: ``nav`` inside nav, header or footer, ``prose`` inside a paragraph,
    quote or caption, else ``other``. ``kind_total`` counts distinct links before
    the filters; ``pattern`` is a case-insensitive substring of name or href;
    ``limit`` null keeps all.
    """
    anchors = inner_text(nodes, nodes.where((F.col("tag") == "a") & attr("href").isNotNull())).join(pages.select("page_id", "url"), "page_id")
    where = F.when(under("nav", "header", "footer"), "nav").when(under("p", "blockquote", "figcaption"), "prose").otherwise("other")
    named = anchors.select("page_id", "node_id", where.alias("kind"), F.left(F.coalesce(F.nullif("inner", F.lit("")), attr("aria-label"), F.lit("")), F.lit(100)).alias("name"), U.shorten_href(F.col("url"), attr("href")).alias("href"))
    rows = named.groupBy("page_id", "kind", "name", "href").agg(F.count("*").alias("n"), F.min("node_id").alias("first"))
    rows = rows.withColumn("kind_total", F.count("*").over(W.partitionBy("page_id", "kind")))
    if kind:
        rows = rows.where(F.col("kind") == kind)
    if pattern:
        rows = rows.where(F.contains(F.lower("name"), F.lit(pattern.lower())) | F.contains(F.lower("href"), F.lit(pattern.lower())))
    rows = rows.withColumn("pos", F.row_number().over(W.partitionBy("page_id").orderBy("first", "name", "href")))
    return rows if limit is None else rows.where(F.col("pos") <= limit)


def get_metadata(nodes: DataFrame) -> DataFrame:
    """Title, language, canonical link, og and twitter properties, six named metas, feeds and JSON-LD of each page. Of equal keys the last counts."""
    text = nodes.where("tag in ('#text', '#raw')").select("page_id", "own_text", F.get("ancestors", F.size("ancestors") - 1).alias("up"))
    titles = text.where("up.tag = 'title'").groupBy("page_id").agg(T.squash(F.array_join(F.collect_list("own_text"), "")).alias("title"))
    key = F.lower(F.coalesce(attr("property"), attr("name")))
    rel = F.lower(F.coalesce(attr("rel"), F.lit("")))
    last = lambda c, w: F.max_by(F.when(w, c), F.when(w, F.col("node_id")))
    wanted = key.startswith("og:") | key.startswith("twitter:") | key.isin(*NAMED_METAS)
    heads = nodes.groupBy("page_id").agg(
        last(attr("lang"), F.col("tag") == "html").alias("lang"),
        last(attr("href"), (F.col("tag") == "link") & (rel == "canonical")).alias("canonical"),
        F.array_sort(F.collect_list(F.when((F.col("tag") == "link") & (rel == "alternate") & attr("type").rlike("rss|atom|json"), attr("href")))).alias("feeds"),
    )
    metas = nodes.where((F.col("tag") == "meta") & wanted & attr("content").isNotNull()).groupBy("page_id", key.alias("k")).agg(F.max_by(F.left(attr("content"), F.lit(300)), "node_id").alias("v"))
    maps = metas.groupBy("page_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("meta"))
    scripts = nodes.where((F.col("tag") == "script") & (F.lower(attr("type")) == "application/ld+json")).select("page_id", F.col("node_id").alias("sid"))
    blocks = nodes.where("tag = '#raw'").select("page_id", F.col("parent_id").alias("sid"), "own_text").join(scripts, ["page_id", "sid"])
    ld = blocks.groupBy("page_id").agg(F.count_if(F.try_parse_json("own_text").isNull()).alias("json_ld_invalid"), F.slice(F.array_sort(F.collect_list(F.struct("sid", F.left("own_text", F.lit(2000)).alias("t"))))["t"], 1, 8).alias("json_ld"))
    return heads.join(titles, "page_id", "left").join(maps, "page_id", "left").join(ld, "page_id", "left").na.fill(0, ["json_ld_invalid"])


def json_ld_leaves(blocks: DataFrame, depth: int = 6, most: int = 400) -> DataFrame:
    """``page_id, path, value`` of JSON-LD blocks ``(page_id, json)``: ``@graph`` is transparent, other ``@`` keys are skipped.

    Levels are unfolded one at a time by ``variant_explode`` down to ``depth``;
    scalars of an array are joined by commas; at most ``most`` leaves per page in path order.
    """
    level = blocks.select("page_id", F.try_parse_json("json").alias("v"), F.lit("").alias("path")).where("v is not null")
    leaves = None
    for _ in range(depth):
        rows = blocks.sparkSession.sql("select page_id, path, schema_of_variant(v) as kind, e.pos, e.key, e.value, schema_of_variant(e.value) as sub from {level}, lateral variant_explode(v) e", level=level)
        rows = rows.where("key is null or key = '@graph' or not startswith(key, '@')")
        step = F.when(F.col("key").isNull() | (F.col("key") == "@graph"), F.col("path")).when(F.col("path") == "", F.col("key")).otherwise(F.concat("path", F.lit("."), "key"))
        rows = rows.withColumn("next", step)
        deep = rows["sub"].rlike("^(OBJECT|ARRAY)")
        flat = rows.where(~deep & (rows["sub"] != "VOID")).select("page_id", F.col("next").alias("path"), "pos", F.expr("cast(value as string)").alias("value"))
        leaves = flat if leaves is None else leaves.union(flat)
        level = rows.where(deep).select("page_id", F.col("value").alias("v"), F.col("next").alias("path"))
    out = leaves.groupBy("page_id", "path").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "value")))["value"], ", ").alias("value"))
    return out.withColumn("n", F.row_number().over(W.partitionBy("page_id").orderBy("path"))).where(F.col("n") <= most).drop("n")


def next_link(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """The next page of each page: ``link rel=next``, then ``a rel=next``, then a link whose label is a word for it."""
    rel = F.exists(F.split(F.lower(F.coalesce(attr("rel"), F.lit(""))), r"\s+"), lambda r: r == "next")
    rows = inner_text(nodes, nodes.where(F.col("tag").isin("a", "link") & attr("href").isNotNull())).join(pages.select("page_id", "url"), "page_id")
    rank = F.when((F.col("tag") == "link") & rel, 1).when(rel, 2).when((F.col("tag") == "a") & F.lower(F.col("inner")).isin(*NEXT_WORDS), 3)
    target = U.resolve_href(F.col("url"), attr("href"))
    good = target.rlike("^https?://") & (F.regexp_replace(target, "#.*$", "") != F.regexp_replace("url", "#.*$", "")) & ~attr("href").startswith("#")
    found = rows.where(rank.isNotNull() & good).select("page_id", F.struct(rank.alias("rank"), "node_id", target.alias("target")).alias("s"))
    return found.groupBy("page_id").agg(F.min("s").alias("s")).select("page_id", F.col("s.target").alias("next_url"), F.col("s.rank").alias("source"))


MAX_SERIES = 25


def read_series(start: DataFrame, chain: DataFrame, max_pages: int = 5, max_chars: int = 8000, budget_chars: int = 40_000) -> DataFrame:
    """``series, step, url, read, chars, clipped, stop, resume``: pages from ``start(url)`` along ``chain(url, next_url, text)``, with the reason each series stopped.

    ``chain`` may also say what a page answers with: ``wall`` (its name, as of
    ``wall_for``), ``resource`` (as of ``resource_kind``) and ``failed`` (it could
    not be fetched). A page of another resource than ``html`` is not read:
    ``unreadable-resource``. A page read gives up to ``max_chars`` characters;
    then ``page-cap`` (at most 25 pages), ``char-budget``, ``end`` (no next link
    over http) and ``loop`` are looked at, in this order, and before the next page
    is read ``navigation-failed``, ``end-of-corpus`` and ``wall``, which are rows
    that are not read. ``chars`` counts from the start of the series; ``resume``
    is where a later call can go on.

    All series take a step at once, one equi-join each, and what a step found is
    stored, so that a step costs what is still under way and nothing is done twice.
    """
    most = max(1, min(max_pages, MAX_SERIES))
    have = lambda c, kind: (F.col(c) if c in chain.columns else F.lit(None)).cast(kind).alias(c)
    pages = stored(chain.select("url", "next_url", F.coalesce("text", F.lit("")).alias("text"), have("wall", "string"), have("resource", "string"), have("failed", "boolean"), F.lit(True).alias("there")))
    at = start.select(F.col("url").alias("series"), "url", F.lit(1).alias("step"), F.array("url").alias("seen"), F.lit(0).cast("long").alias("chars"))
    out: list[DataFrame] = []
    for step in range(1, most + 1):
        first = F.lit(step == 1)
        unread = F.when(~first & F.coalesce("failed", F.lit(False)), "navigation-failed").when(F.col("there").isNull(), "end-of-corpus").when(~first & F.col("wall").isNotNull(), "wall").when(F.coalesce("resource", F.lit("html")) != "html", "unreadable-resource")
        hit = at.join(pages, "url", "left").withColumn("unread", unread)
        hit = hit.withColumn("chars", F.col("chars") + F.when(F.col("unread").isNull(), F.least(F.length("text"), F.lit(max_chars))).otherwise(0))
        onward = F.when(F.col("next_url").rlike("(?i)^https?://"), F.col("next_url"))
        stop = (
            F.when(F.col("unread").isNotNull(), F.col("unread")).when(F.lit(step == most), "page-cap").when(F.col("chars") >= budget_chars, "char-budget")
            .when(onward.isNull(), "end").when(F.array_contains("seen", onward), "loop")
        )
        hit = hit.withColumn("onward", onward).withColumn("stop", stop)
        resume = F.when(F.col("stop").isin("page-cap", "char-budget"), F.col("onward")).when(F.col("stop") == "navigation-failed", F.col("url"))
        told = stored(hit.select("series", "step", "url", F.col("unread").isNull().alias("read"), "chars", (F.col("unread").isNull() & (F.length("text") > max_chars)).alias("clipped"), "stop", resume.alias("resume"), "onward", "seen"))
        out.append(told.drop("onward", "seen"))
        at = told.where("stop is null").select("series", F.col("onward").alias("url"), F.lit(step + 1).alias("step"), F.concat("seen", F.array("onward")).alias("seen"), "chars")
        if at.isEmpty():
            break
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows


def citation_meta(nodes: DataFrame) -> DataFrame:
    """Citation fields of each page, the first non-empty tag of each; at most 12 authors."""
    key, value = F.lower(attr("name")), T.squash(attr("content"))
    rank = [F.when(key == tag, F.struct(F.lit(field).alias("field"), F.lit(k).alias("k"))) for field, tags in CITATION.items() for k, tag in enumerate(tags)]
    rows = nodes.where("tag = 'meta'").select("page_id", "node_id", F.coalesce(*rank).alias("r"), value.alias("v")).where("r is not null and v <> ''").select("page_id", "node_id", "r.field", "r.k", "v")
    best = rows.withColumn("top", F.min("k").over(W.partitionBy("page_id", "field"))).where("k = top")
    return best.groupBy("page_id", "field").agg(F.slice(F.array_sort(F.collect_list(F.struct("node_id", "v")))["v"], 1, 12).alias("vs")).select("page_id", "field", F.when(F.col("field") == "author", F.array_join("vs", "; ")).otherwise(F.get("vs", F.lit(0))).alias("value"))


def resource_kind(responses: DataFrame) -> DataFrame:
    """``pdf``, ``binary`` or ``html`` for responses with ``url, content_type, readable_chars``."""
    kind = F.lower(F.trim(F.substring_index(F.coalesce("content_type", F.lit("")), ";", 1)))
    pdf = kind.isin("application/pdf", "application/x-pdf", "application/acrobat", "applications/vnd.pdf", "text/pdf", "text/x-pdf")
    binary = kind.rlike(r"^(image/|audio/|video/|font/|application/(octet-stream|zip|x-zip|gzip|x-tar|x-7z|x-rar|msword|vnd\.|java-archive|wasm|x-msdownload|epub))")
    return responses.withColumn("kind", F.when(F.col("url").startswith("blob:"), "binary").when(pdf, "pdf").when(binary & ~((F.coalesce("readable_chars", F.lit(0)) >= 200) & kind.contains("html")), "binary").otherwise("html")).withColumn("evidence", F.concat(F.lit("content-type "), kind))


def filename_for(url: Column, disposition: Column) -> Column:
    """File name from a disposition header or the URL; null for URLs that are not web ones."""
    d = F.coalesce(disposition, F.lit(""))
    star, plain = F.regexp_extract(d, r"(?i)filename\*\s*=\s*[^']*'[^']*'([^;]+)", 1), F.regexp_extract(d, r'(?i)filename\s*=\s*"?([^";]+)', 1)
    base = F.element_at(F.split(F.coalesce(U.part(url, "PATH"), F.lit("")), "/"), -1)
    name = F.when(star != "", F.try_url_decode(star)).when(plain != "", plain).otherwise(base)
    return F.when(url.rlike("^https?://"), F.nullif(F.left(F.trim(F.regexp_replace(name, r"[\p{Cntrl}]+", " ")), F.lit(160)), F.lit("")))


def find_elements(found: DataFrame, queries: DataFrame) -> DataFrame:
    """Controls whose name holds a query (``queries(query, role)``, a small broadcast table), with total and position."""
    hit = found.join(few(queries), F.contains(F.lower(found["name"]), F.lower(queries["query"])) & (queries["role"].isNull() | (queries["role"] == found["role"]))).drop(queries["role"])
    w = W.partitionBy("query", "page_id")
    return hit.withColumn("total", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy("node_id")))


def nearest_misses(found: DataFrame, query: str) -> DataFrame:
    """Distinct names that hold a word of ``query``, ranked on each page by how many."""
    words = [w for w in query.lower().split() if w]
    score = sum((F.contains(F.lower("name"), F.lit(w)).cast("int") for w in words), F.lit(0))
    names = found.select("page_id", "name").distinct().withColumn("score", score).where("score > 0")
    return names.withColumn("rank", F.row_number().over(W.partitionBy("page_id").orderBy(F.desc("score"), "name")))


def disambiguate(found: DataFrame) -> DataFrame:
    """What tells controls of equal role and name apart: nothing if their paths do, else the landmark, else the ordinal."""
    w = W.partitionBy("page_id", "role", "name")
    n, paths, marks = F.count("*").over(w), F.size(F.collect_set("path").over(w)), F.size(F.collect_set("landmark").over(w))
    return found.withColumn("hint", F.when((n == 1) | (paths == n), "").when(marks == n, F.concat(F.lit("in "), "landmark")).otherwise(F.concat(F.lit("#"), F.col("ordinal").cast("string"), F.lit(" "), "role")))


def count_selector(nodes: DataFrame, selector: str) -> DataFrame:
    """Matches per page of a simple selector: tag, ``#id``, ``.class``, ``[attr=value]`` and descendants of those."""
    import re

    def parts(compound: str) -> list[tuple[str, str, str]]:
        out, rest = [], compound
        while rest:
            m = re.match(r"^(?:([A-Za-z][\w-]*)|#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:=\"?([^\"\]]*)\"?)?\])", rest)
            if not m:
                raise ValueError(f"selector not supported: {compound}")
            tag, ident, cls, name, value = m.groups()
            out.append(("tag", tag, "") if tag else ("id", ident, "") if ident else ("cls", cls, "") if cls else ("attr", name, value))
            rest = rest[m.end() :]
        return out

    def own(kind: str, a: str, b: str | None) -> Column:
        if kind == "tag":
            return F.col("tag") == a.lower()
        if kind == "attr":
            return attr(a).isNotNull() if b is None else attr(a) == b
        return attr("id") == a if kind == "id" else F.array_contains(F.split(F.coalesce(attr("class"), F.lit("")), r"\s+"), a)

    def above(x: Column, kind: str, a: str) -> Column:
        if kind == "attr":
            raise ValueError("attributes are only supported on the last part")
        return x["tag"] == a.lower() if kind == "tag" else x["id_attr"] == a if kind == "id" else F.array_contains(F.split(F.coalesce(x["cls"], F.lit("")), r"\s+"), a)

    def inside(tests: list[tuple[str, str, str]]):
        return lambda x: F.coalesce(sum_all([above(x, t[0], t[1]) for t in tests]), F.lit(False))

    *outer, last = selector.split()
    keep = ~F.col("tag").startswith("#")
    for p in parts(last):
        keep = keep & F.coalesce(own(*p), F.lit(False))
    for k, compound in enumerate(outer):
        tests = parts(compound)
        keep = keep & F.exists("ancestors", inside(tests))
    return nodes.groupBy("page_id").agg(F.count_if(keep).alias("n"))


def sum_all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def own_prose(nodes: DataFrame) -> DataFrame:
    """Text runs that belong to the page's prose."""
    return nodes.where((F.col("tag") == "#text") & ~under(*NO_PROSE))
