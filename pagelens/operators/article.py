"""Article bodies: scoring over ancestors, what is left out, verdict and threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelens.functions import text as T
from pagelens.operators.structure import attr, inner_text, text_blocks, under

#: Class and id words for and against an article body.
GOOD, BAD = "article|body|content|entry|main|page|post|text|story", "combx|comment|community|disqus|extra|foot|header|menu|promo|related|remark|rss|share|shoutbox|sidebar|sponsor|ad-break|agegate|pagination|pager|popup|widget"


def weight(tag: Column, role: Column, names: Column) -> Column:
    base = F.when(tag == "article", 25).when((tag == "main") | (role == "main"), 20).when(tag == "div", 5).when(tag.isin("ul", "ol", "form", "aside", "nav", "footer", "header"), -10).otherwise(0)
    low = F.lower(names)
    return base + F.when(low.rlike(GOOD), 25).otherwise(0) - F.when(low.rlike(BAD), 25).otherwise(0)


def article_body(nodes: DataFrame, reach: int = 5, least: int = 25) -> DataFrame:
    """``page_id, body_id, score, chars, link_density``: the container that the paragraphs point to.

    A block of ``least`` characters or more gives one point, one for each comma
    and up to three for its length to ``reach`` ancestors, divided by the
    distance; containers add the weight of their tag and names and are
    discounted by link density. One aggregation over exploded ancestors.
    """
    blocks = text_blocks(nodes).where((F.length("text") >= least) & F.col("tag").isin("p", "pre", "blockquote", "td", "li", "dd", "div", "section", "article"))
    owner = nodes.select("page_id", F.col("node_id").alias("block_id"), "tag", "ancestors")
    points = 1 + F.regexp_count("text", F.lit(",")) + F.least(F.length("text") / 100, F.lit(3.0))
    given = blocks.drop("tag").join(owner, ["page_id", "block_id"]).select("page_id", "text", points.alias("points"), F.posexplode(F.slice(F.reverse("ancestors"), 1, reach)).alias("depth", "a"))
    scores = given.groupBy("page_id", F.col("a.id").alias("body_id")).agg(F.sum(F.col("points") / (F.col("depth") + 1)).alias("given"), F.first(weight(F.col("a.tag"), F.col("a.role"), F.concat_ws(" ", "a.cls", "a.id_attr"))).alias("weight"))
    texts = nodes.where("tag = '#text'").select("page_id", F.length(T.squash(F.col("own_text"))).alias("n"), under("a").alias("linked"), F.explode("ancestors.id").alias("body_id"))
    dense = texts.join(scores.select("page_id", "body_id"), ["page_id", "body_id"], "left_semi").groupBy("page_id", "body_id").agg(F.sum("n").cast("long").alias("chars"), F.sum(F.when(F.col("linked"), F.col("n")).otherwise(0)).alias("link_chars"))
    scored = scores.join(dense, ["page_id", "body_id"]).withColumn("link_density", F.col("link_chars") / F.greatest("chars", F.lit(1))).withColumn("score", (F.col("given") + F.col("weight")) * (1 - F.col("link_density")))
    best = scored.groupBy("page_id").agg(F.max(F.struct("score", "body_id", "chars", "link_density")).alias("b"))
    return climb(nodes, scored, best.select("page_id", "b.*"))


def climb(nodes: DataFrame, scored: DataFrame, best: DataFrame, steps: int = 2) -> DataFrame:
    """Move up to ``steps`` parents where the parent scores 0.9 of the best and holds over 15% more text."""
    parents = nodes.select("page_id", F.col("node_id").alias("body_id"), "parent_id")
    table = scored.select("page_id", F.col("body_id").alias("parent_id"), F.struct(F.col("score"), F.col("body_id"), F.col("chars"), F.col("link_density")).alias("up"))
    out = best
    for _ in range(steps):
        j = out.join(parents, ["page_id", "body_id"], "left").join(table, ["page_id", "parent_id"], "left")
        go = F.coalesce((F.col("up.score") >= 0.9 * F.col("score")) & (F.col("up.chars") > 1.15 * F.col("chars")), F.lit(False))
        out = j.select("page_id", *(F.when(go, F.col(f"up.{c}")).otherwise(F.col(c)).alias(c) for c in ("score", "body_id", "chars", "link_density")))
    return out


def article_blocks(nodes: DataFrame, body: DataFrame) -> DataFrame:
    """Text blocks inside each page's body in order, by an equi-join on the page with an interval test."""
    span = body.join(nodes.select("page_id", F.col("node_id").alias("body_id"), "last_desc"), ["page_id", "body_id"]).select("page_id", "body_id", "last_desc")
    return text_blocks(nodes).join(span, "page_id").where(F.col("start").between(F.col("body_id"), F.col("last_desc"))).drop("last_desc")


def article_excluded(nodes: DataFrame, body: DataFrame) -> DataFrame:
    """Blocks and characters outside the body by reason: nav, header, footer, sidebar, form, comments, related, share, promo, other."""
    span = body.join(nodes.select("page_id", F.col("node_id").alias("body_id"), "last_desc"), ["page_id", "body_id"]).select("page_id", "body_id", "last_desc")
    out = text_blocks(nodes).join(span, "page_id", "left").where(F.col("body_id").isNull() | ~F.col("start").between(F.col("body_id"), F.col("last_desc")))
    j = out.drop("tag").join(nodes.select("page_id", F.col("node_id").alias("start"), "ancestors"), ["page_id", "start"])
    has = lambda *t: F.exists("ancestors", lambda x: x["tag"].isin(*t))
    named = lambda p: F.exists(F.slice(F.reverse("ancestors"), 1, 8), lambda x: F.lower(F.concat_ws(" ", x["cls"], x["id_attr"])).rlike(p))
    reason = F.when(has("nav"), "nav").when(has("header"), "header").when(has("footer"), "footer").when(has("aside"), "sidebar").when(has("form"), "form").when(named("comment|disqus|repl(y|ies)"), "comments").when(named("related|recommend"), "related").when(named("share|social"), "share").when(named(r"promo|sponsor|newsletter|(^|[ _-])ads?([ _-]|$)"), "promo").otherwise("other")
    return j.groupBy("page_id", reason.alias("reason")).agg(F.count("*").alias("blocks"), F.sum(F.length("text")).cast("long").alias("chars"))


#: Types of JSON-LD nodes that describe an article.
LD_TYPES = "(?i)^(Article|NewsArticle|BlogPosting|Report|ScholarlyArticle|TechArticle|LiveBlogPosting|DiscussionForumPosting|Posting|WebPage)$"
LD_DEPTH = 4


def json_ld_article(nodes: DataFrame) -> DataFrame:
    """``page_id, title, byline, published, modified`` of the first JSON-LD node of an article's type on each page.

    Scripts in order; within one the node itself or the items of a list, then
    those of each ``@graph``, a level at a time. An author is a string, an object
    with a name, or a list of them.
    """
    scripts = nodes.where((F.col("tag") == "script") & (attr("type") == "application/ld+json")).select("page_id", F.col("node_id").alias("parent_id"))
    level = nodes.where("tag = '#raw'").join(scripts, ["page_id", "parent_id"]).select("page_id", F.array("node_id").alias("at"), F.try_parse_json("own_text").alias("v")).where("v is not null")
    kind, items = "schema_of_variant(v)", "try_variant_get({}, '$', 'array<variant>')"
    level = level.select("page_id", "at", F.posexplode(F.when(F.expr(f"{kind} like 'ARRAY%'"), F.expr(items.format("v"))).otherwise(F.array("v"))).alias("pos", "v")).select("page_id", F.concat("at", F.array("pos")).alias("at"), "v")
    found = None
    for depth in range(LD_DEPTH):
        here = level.withColumn("depth", F.lit(depth))
        found = here if found is None else found.unionByName(here)
        level = level.select("page_id", "at", F.posexplode(F.expr("""try_variant_get(v, '$["@graph"]', 'array<variant>')""")).alias("pos", "v")).select("page_id", F.concat("at", F.array("pos")).alias("at"), "v")
    types = F.expr("""case when schema_of_variant(try_variant_get(v, '$["@type"]', 'variant')) like 'ARRAY%' then try_variant_get(v, '$["@type"]', 'array<string>') else array(try_variant_get(v, '$["@type"]', 'string')) end""")
    text = lambda p: T.squash(F.expr(f"try_variant_get(v, '$.{p}', 'string')"))
    people = F.expr("case when schema_of_variant(try_variant_get(v, '$.author', 'variant')) like 'ARRAY%' then try_variant_get(v, '$.author', 'array<variant>') else array(try_variant_get(v, '$.author', 'variant')) end")
    named = F.expr("transform(people, a -> case when schema_of_variant(a) like 'OBJECT%' then try_variant_get(a, '$.name', 'string') else try_variant_get(a, '$', 'string') end)")
    rows = found.where(F.exists(types, lambda t: F.coalesce(t.rlike(LD_TYPES), F.lit(False)))).withColumn("people", people)
    names = F.filter(F.transform(named, lambda n: T.squash(n)), lambda n: F.coalesce(n != "", F.lit(False)))
    told = rows.select("page_id", F.get("at", F.lit(0)).alias("script"), "depth", "at", F.coalesce(F.nullif(text("headline"), F.lit("")), text("name")).alias("title"), F.array_join(names, ", ").alias("byline"), text("datePublished").alias("published"), text("dateModified").alias("modified"))
    return told.groupBy("page_id").agg(F.min(F.struct("script", "depth", "at", "title", "byline", "published", "modified")).alias("b")).select("page_id", *(F.nullif(f"b.{c}", F.lit("")).alias(c) for c in ("title", "byline", "published", "modified")))


def article_meta(nodes: DataFrame) -> DataFrame:
    """Title, byline, publication and modification of each page, each with its source (``title_source``, …).

    Title: JSON-LD, body h1, og:title, page title. Byline: JSON-LD, the author
    meta, the first element marked as the author's, of 120 characters at most.
    Dates: JSON-LD, metas, the first machine-readable time. Values are cut at 300
    characters. Hidden bylines are left out of ``hidden_nodes``.
    """
    text = inner_text(nodes, nodes.where("tag in ('h1', 'title')")).where("inner <> ''")
    heads = text.groupBy("page_id").agg(F.min_by(F.when(F.col("tag") == "h1", F.col("inner")), F.when(F.col("tag") == "h1", F.col("node_id"))).alias("h1"), F.min_by(F.when(F.col("tag") == "title", F.col("inner")), F.when(F.col("tag") == "title", F.col("node_id"))).alias("page_title"))
    first = lambda test: F.min_by(T.squash(attr("content")), F.when(test & (T.squash(attr("content")) != ""), F.col("node_id")))
    metas = nodes.where("tag = 'meta'").groupBy("page_id").agg(first(attr("property") == "og:title").alias("og"), first(attr("name") == "author").alias("author"), first(attr("property") == "article:published_time").alias("published_meta"), first(attr("name") == "date").alias("date_meta"), first(attr("property") == "article:modified_time").alias("modified_meta"))
    cls = F.concat(F.lit(" "), F.coalesce(attr("class"), F.lit("")), F.lit(" "))
    marks = (attr("itemprop") == "author", F.concat(F.lit(" "), attr("rel"), F.lit(" ")).contains(" author "), cls.contains(" byline "), cls.contains(" author "), cls.contains(" post-author "), cls.contains("byline"), cls.contains("author"), attr("data-testid").contains("author"))
    rank = F.coalesce(*(F.when(m, k) for k, m in enumerate(marks)))
    seen = nodes.where("hidden_reason is null") if "hidden_reason" in nodes.columns else nodes
    marked = inner_text(nodes, seen.where(rank.isNotNull() & ~F.col("tag").startswith("#"))).select("page_id", rank.alias("rank"), "node_id", T.squash(F.coalesce(attr("content"), F.col("inner"))).alias("said"))
    firsts = marked.groupBy("page_id", "rank").agg(F.min_by("said", "node_id").alias("said")).where(F.length("said").between(1, 120))
    markup = firsts.groupBy("page_id").agg(F.min_by("said", "rank").alias("markup"))
    times = nodes.where(attr("datetime").isNotNull() | ((attr("itemprop") == "datePublished") & attr("content").isNotNull())).groupBy("page_id").agg(F.min_by(T.squash(F.coalesce(attr("datetime"), attr("content"))), "node_id").alias("time"))
    ld = json_ld_article(nodes).select("page_id", *(F.col(c).alias(f"ld_{c}") for c in ("title", "byline", "published", "modified")))
    j = metas.join(heads, "page_id", "full")
    for more in (markup, times, ld):
        j = j.join(more, "page_id", "full")

    def pick(name: str, *sources: tuple[str, str]) -> list[Column]:
        some = F.get(F.filter(F.array(*(F.struct(F.left(F.col(c), F.lit(300)).alias("value"), F.lit(s).alias("source")) for c, s in sources)), lambda x: F.coalesce(x["value"] != "", F.lit(False))), F.lit(0))
        return [some["value"].alias(name), some["source"].alias(f"{name}_source")]

    return j.select(
        "page_id", *pick("title", ("ld_title", "json-ld"), ("h1", "body-h1"), ("og", "og:title"), ("page_title", "title")), *pick("byline", ("ld_byline", "json-ld"), ("author", "meta[name=author]"), ("markup", "markup")),
        *pick("published", ("ld_published", "json-ld"), ("published_meta", "meta[article:published_time]"), ("time", "time[datetime]"), ("date_meta", "meta[name=date]")), *pick("modified", ("ld_modified", "json-ld"), ("modified_meta", "meta[article:modified_time]")),
    )


def article_verdict(nodes: DataFrame, body: DataFrame, found_threads: DataFrame | None = None) -> DataFrame:
    """``article``, else ``thread`` where ``found_threads`` (of ``threads``) has the page, else ``none``, with the figures and the reasons against an article.

    Reasons: fewer than three prose blocks, under 400 characters, over half of
    the text in links, under 15% of the page's text.
    """
    inside = article_blocks(nodes, body).groupBy("page_id").agg(F.count_if(F.length("text") >= 25).alias("prose_blocks"), F.sum(F.length("text")).alias("body_chars"))
    whole = text_blocks(nodes).groupBy("page_id").agg(F.sum(F.length("text")).alias("page_chars"))
    j = whole.join(body.select("page_id", "link_density"), "page_id", "left").join(inside, "page_id", "left").na.fill(0, ["prose_blocks", "body_chars"])
    against = F.array_compact(F.array(F.when(F.col("prose_blocks") < 3, "few-blocks"), F.when(F.col("body_chars") < 400, "short"), F.when(F.col("link_density") > 0.5, "links"), F.when(F.col("body_chars") < 0.15 * F.col("page_chars"), "small-share")))
    j = j.withColumn("share_of_page", F.round(F.col("body_chars") / F.col("page_chars"), 2))
    known = F.lit(False)
    if found_threads is not None:
        j = j.join(found_threads.select("page_id", F.lit(True).alias("__thread")).distinct(), "page_id", "left")
        known = F.coalesce("__thread", F.lit(False))
    return j.withColumn("against", F.array_join(against, ",")).withColumn("verdict", F.when(F.size(against) == 0, "article").when(known, "thread").otherwise("none")).drop("__thread")


def names_author() -> Column:
    """Whether an element says who wrote what it stands in."""
    cls, rel = F.concat(F.lit(" "), F.coalesce(attr("class"), F.lit("")), F.lit(" ")), F.concat(F.lit(" "), F.coalesce(attr("rel"), F.lit("")), F.lit(" "))
    parent = F.exists("ancestors", lambda x: x["tag"].isin("h3", "h4"))
    return F.coalesce(attr("itemprop") == "author", F.lit(False)) | rel.contains(" author ") | cls.contains(" user ") | cls.contains("author") | cls.contains("username") | F.coalesce(F.contains(attr("data-testid"), F.lit("author")), F.lit(False)) | ((F.col("tag") == "a") & parent)


def threads(nodes: DataFrame, hops: int = 8, least_posts: int = 3, least_chars: int = 200, most_posts: int = 200) -> DataFrame:
    """``page_id, post, node_id, author, at, at_text, text, n_posts``: posts of the largest group of siblings that each hold a machine-readable time.

    A time climbs at most ``hops`` parents, up to the body, to the nearest one of
    which ``least_posts`` children hold a time; the child it came through is a
    post of that parent. The parent with most posts is the thread, the first in
    the page among equals; a report of its first ``most_posts`` posts. Hidden
    times and posts are left out where ``nodes`` are those of ``hidden_nodes``.
    Pages with fewer posts, or under ``least_chars`` characters in them, have none.
    """
    seen = nodes.where("hidden_reason is null") if "hidden_reason" in nodes.columns else nodes
    stamps = seen.where(attr("datetime").isNotNull() & ~F.col("tag").startswith("#"))
    stamps = stamps.select("page_id", F.col("node_id").alias("stamp"), attr("datetime").alias("at"), F.concat(F.array("node_id"), F.reverse("ancestors.id")).alias("up"), F.concat(F.array("tag"), F.reverse("ancestors.tag")).alias("tags"))
    steps = stamps.select("page_id", "stamp", "at", F.posexplode("up").alias("hop", "box"), "up", "tags").withColumn("parent", F.get("up", F.col("hop") + 1)).where("parent is not null").withColumn("top", F.get("tags", F.col("hop") + 1).isin("body", "html"))
    holds = steps.groupBy("page_id", "parent").agg(F.count_distinct("box").alias("n")).where(F.col("n") >= least_posts)
    fenced = steps.withColumn("fence", F.min(F.when(F.col("top"), F.col("hop"))).over(W.partitionBy("page_id", "stamp"))).where((F.col("hop") < hops) & (F.col("fence").isNull() | (F.col("hop") < F.col("fence"))))
    nearest = fenced.join(holds, ["page_id", "parent"]).groupBy("page_id", "stamp", "at").agg(F.min(F.struct("hop", "parent", "box")).alias("s")).select("page_id", "stamp", "at", "s.parent", "s.box")
    group = nearest.groupBy("page_id", "parent").agg(F.count_distinct("box").alias("n"), F.min("stamp").alias("first")).where(F.col("n") >= least_posts)
    best = group.groupBy("page_id").agg(F.min(F.struct(-F.col("n"), "first", "parent")).alias("b")).select("page_id", F.col("b.parent").alias("parent"))
    boxes = nearest.join(best, ["page_id", "parent"]).groupBy("page_id", "box").agg(F.min("stamp").alias("stamp"), F.min_by("at", "stamp").alias("at"))
    ranked = boxes.withColumn("post", F.row_number().over(W.partitionBy("page_id").orderBy("stamp"))).where(F.col("post") <= most_posts).withColumnRenamed("box", "node_id")
    posts = inner_text(nodes, seen.join(ranked, ["page_id", "node_id"]))
    spans = posts.select("page_id", "node_id", "last_desc")
    told = inner_text(nodes, nodes.where(names_author() & ~F.col("tag").startswith("#"))).select("page_id", F.col("node_id").alias("who"), T.squash(F.coalesce(attr("content"), F.col("inner"))).alias("author"))
    authors = spans.join(told, "page_id").where(F.col("who").between(F.col("node_id"), F.col("last_desc"))).groupBy("page_id", "node_id").agg(F.min_by("author", "who").alias("author"))
    times = inner_text(nodes, nodes.where(attr("datetime").isNotNull())).select("page_id", F.col("node_id").alias("stamp"), F.nullif(T.clip(F.col("inner"), 60), F.lit("")).alias("at_text"))
    out = posts.select("page_id", "post", "node_id", "stamp", F.nullif(T.squash(F.col("at")), F.lit("")).alias("at"), F.col("inner").alias("text")).join(authors, ["page_id", "node_id"], "left").join(times, ["page_id", "stamp"], "left")
    w = W.partitionBy("page_id")
    sized = out.withColumn("n_posts", F.count("*").over(w)).withColumn("chars", F.sum(F.length("text")).over(w)).where((F.col("n_posts") >= least_posts) & (F.col("chars") >= least_chars))
    author = F.when(F.length("author").between(1, 120), F.col("author"))
    return sized.select("page_id", "post", "node_id", author.alias("author"), "at", "at_text", T.clip(F.col("text"), 1200).alias("text"), "n_posts")


def inline_links(nodes: DataFrame, pages: DataFrame, body: DataFrame, most: float = 0.25) -> DataFrame:
    """Body text of each page with links as ``[text](path)``; plain where the markup would exceed ``most`` of it.

    Text runs are put together per block in order; a run inside a link carries
    its anchor's short path.
    """
    from pagelens.functions import urls as U

    span = body.join(nodes.select("page_id", F.col("node_id").alias("body_id"), "last_desc"), ["page_id", "body_id"]).select("page_id", "body_id", F.col("last_desc").alias("body_end"))
    anchors = nodes.where((F.col("tag") == "a") & attr("href").isNotNull()).join(pages.select("page_id", "url"), "page_id").select("page_id", F.col("node_id").alias("a_id"), U.shorten_href(F.col("url"), attr("href")).alias("path"))
    runs = nodes.where("tag = '#text'").join(span, "page_id").where(F.col("node_id").between(F.col("body_id"), F.col("body_end")))
    runs = runs.withColumn("a_id", F.get(F.filter(F.reverse("ancestors"), lambda x: x["tag"] == "a"), F.lit(0))["id"]).join(anchors, ["page_id", "a_id"], "left")
    plain = T.squash(F.col("own_text"))
    linked = F.when(F.col("path").isNotNull(), F.concat(F.lit("["), plain, F.lit("]("), F.col("path"), F.lit(")"))).otherwise(plain)
    parts = runs.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("node_id", plain.alias("p"), linked.alias("l")))).alias("x"))
    text = parts.select("page_id", F.array_join("x.p", " ").alias("p"), F.array_join("x.l", " ").alias("l"))
    heavy = (F.length("l") - F.length("p")) > most * F.length("l")
    return text.select("page_id", F.when(heavy, F.col("p")).otherwise(F.col("l")).alias("text"), (~heavy & (F.col("l") != F.col("p"))).alias("linked"))
