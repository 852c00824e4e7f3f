"""Schema-directed fields: evidence in tiers, matching, ties reported instead of guessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelens.functions import text as T
from pagelens.operators.structure import accessible_names, attr, inner_text, is_control, text_blocks
from pagelens.session import few, stored

#: Tiers, best first, and how many sources of each a page keeps.
TIERS = {"declared": 1200, "labeled": 800, "proximate": 800, "hint": 900}
KEY_CHARS, VALUE_CHARS = 90, 300


#: Longest text that a token of ``hint`` may stand for.
HINT_CHARS = 120
#: First parts of class tokens that say nothing.
HINT_SKIP = "^(col|row|is|has|js|no|ng|v|u|p|m|mt|mb|ml|mr|px|py|d|w|h|sm|md|lg|xl|xs|active|hidden|show|hide|clearfix|container|wrapper|inner|outer|left|right|center|top|bottom|first|last|odd|even)(-|$)"


def readable_text(nodes: DataFrame, of: DataFrame, read: Column | None = None) -> DataFrame:
    """``inner_text`` of ``of``, of what passes ``read`` alone; where ``nodes`` are those of ``hidden_nodes``, of what can be seen alone, with ``withheld`` for elements whose text is hidden altogether."""
    if "hidden_reason" not in nodes.columns:
        return inner_text(nodes, of, read).withColumn("withheld", F.lit(False))
    seen = inner_text(nodes.where("tag <> '#text' or hidden_reason is null"), of, read)
    every = inner_text(nodes.where("tag <> '#text' or hidden_reason is not null"), of.select("page_id", "node_id", "tag", "attrs"), read).select("page_id", "node_id", F.col("inner").alias("__hidden"))
    return seen.join(every, ["page_id", "node_id"]).withColumn("withheld", (F.col("inner") == "") & (F.col("__hidden") != "")).drop("__hidden")


def evidence(nodes: DataFrame, leaves: DataFrame | None = None, tiers: tuple[str, ...] = tuple(TIERS)) -> DataFrame:
    """``page_id, tier, seq, key, value, by, secret, withheld, styling_only`` of each page; at most ``TIERS`` per tier in document order, ``overflow`` counts the rest.

    ``declared``: JSON-LD leaves (``leaves(page_id, path, value)``), metas,
    microdata, RDFa, times, the title. ``labeled``: dt and dd, rows of two cells,
    labelled fields. ``proximate``: a short label and its next sibling.
    ``hint``: words of id, class and test id; a word on an element without a
    short text is ``styling_only``. Of ``hidden_nodes``, text that cannot be seen
    gives no value: ``withheld``. Each source is one projection. ``tiers`` leaves
    out whole tiers, and the texts that only these would read.
    """
    whole = "proximate" in tiers or "hint" in tiers
    sourced = F.col("tag").isin("dt", "dd", "th", "td", "time", "title") | attr("itemprop").isNotNull() | attr("property").isNotNull()
    texts = readable_text(nodes, nodes.where(~F.col("tag").startswith("#") & ~is_control()), None if whole else sourced)
    texts = stored(texts.select("page_id", "node_id", "parent_id", "tag", "attrs", "inner", "withheld"))  # read for every kind of source
    row = lambda d, tier, key, value, by, withheld=F.lit(False): d.select("page_id", F.lit(tier).alias("tier"), F.col("node_id").alias("seq"), key.alias("key"), value.alias("value"), F.lit(by).alias("by"), withheld.alias("withheld"))
    meta = nodes.where((F.col("tag") == "meta") & attr("content").isNotNull() & F.coalesce(attr("property"), attr("name")).isNotNull())
    micro = texts.where(attr("itemprop").isNotNull())
    rdfa = texts.where(attr("property").isNotNull() & (F.col("tag") != "meta"))
    given = F.coalesce(attr("content"), attr("datetime"))
    times = texts.where((F.col("tag") == "time") & attr("datetime").isNotNull())
    parts = [
        row(meta, "declared", F.coalesce(attr("property"), attr("name")), attr("content"), "meta"),
        row(micro, "declared", attr("itemprop"), F.coalesce(given, F.col("inner")), "microdata", given.isNull() & F.col("withheld")),
        row(rdfa, "declared", F.element_at(F.split(attr("property"), ":"), -1), F.coalesce(given, attr("href"), F.col("inner")), "rdfa", given.isNull() & F.col("withheld")),
        row(times, "declared", F.lit("time"), attr("datetime"), "time"),
        row(texts.where("tag = 'title'"), "declared", F.lit("title"), F.col("inner"), "title"),
    ]
    if leaves is not None:
        parts.append(leaves.select("page_id", F.lit("declared").alias("tier"), F.lit(-1).alias("seq"), F.element_at(F.split("path", r"\."), -1).alias("key"), "value", F.lit("json-ld").alias("by"), F.lit(False).alias("withheld")))
    sibling = W.partitionBy("page_id", "parent_id").orderBy("node_id")
    nxt = texts.withColumn("next_tag", F.lead("tag").over(sibling)).withColumn("next", F.lead("inner").over(sibling)).withColumn("gone", F.coalesce(F.lead("withheld").over(sibling), F.lit(False))).withColumn("cells", F.count("*").over(W.partitionBy("page_id", "parent_id")))
    parts.append(row(nxt.where("tag = 'dt' and next_tag = 'dd'"), "labeled", F.col("inner"), F.col("next"), "dl", F.col("gone")))
    parts.append(row(nxt.where("tag in ('th', 'td') and next_tag = 'td' and cells = 2 and length(inner) < 80"), "labeled", F.col("inner"), F.col("next"), "row", F.col("gone")))
    short = F.length("inner").between(2, 40) & F.col("inner").rlike(r"^[\p{L}][\p{L}\p{N} /-]*:?$")
    parts.append(row(nxt.where(short & ~F.col("tag").isin("dt", "th", "td") & F.col("next").isNotNull() & (F.length("next").between(1, 120) | F.col("gone"))), "proximate", F.regexp_replace("inner", ":$", ""), F.col("next"), "next-sibling", F.col("gone")))
    tokens = F.array_compact(F.array(attr("id"), attr("data-testid"), attr("class")))
    hints = texts.where(F.size(tokens) > 0).withColumn("hint", F.explode(F.slice(F.filter(F.flatten(F.transform(tokens, lambda t: F.split(t, r"\s+"))), lambda t: F.length(t).between(3, 60) & ~t.rlike(HINT_SKIP)), 1, 4)))
    parts.append(row(hints, "hint", F.col("hint"), F.when(F.length("inner") <= HINT_CHARS, F.col("inner")).otherwise(F.lit("")), "hint"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.where(F.col("tier").isin(*tiers))
    cap = F.element_at(F.create_map(*(F.lit(x) for kv in TIERS.items() for x in kv)), F.col("tier"))
    w = W.partitionBy("page_id", "tier")
    ranked = out.where("key is not null").withColumn("n", F.row_number().over(w.orderBy("seq", "key"))).withColumn("overflow", F.greatest(F.count("*").over(w) - cap, F.lit(0)))
    secret = F.lower("key").rlike("password|passwd|secret|token|one-time")
    return ranked.where(F.col("n") <= cap).select("page_id", "tier", "seq", F.left("key", F.lit(KEY_CHARS)).alias("key"), F.left(T.squash(F.col("value")), F.lit(VALUE_CHARS)).alias("value"), "by", secret.alias("secret"), "withheld", ((F.col("tier") == "hint") & (F.coalesce("value", F.lit("")) == "")).alias("styling_only"), "overflow")


def match_quality(key: Column, name: Column, description: Column) -> Column:
    """``struct<quality,extra>``: 3 for equal keys, 2 for all content words, 1 for a whole-word part of the name; null for none."""
    k, n, d = T.norm_key(key), T.norm_key(name), T.norm_key(description)
    have = T.words(key)
    inside = lambda ws: (F.size(ws) > 0) & (F.size(F.array_except(ws, have)) == 0)
    part = (F.length(k) >= 4) & (F.length(n) >= 4) & (F.array_contains(have, n) | F.array_contains(T.words(name), k))
    rank = F.when((k == n) | ((d != "") & (k == d)), 3).when(inside(T.content_words(name)) | inside(T.content_words(description)), 2).when(part, 1)
    extra = F.size(F.array_except(T.content_words(key), F.array_union(T.content_words(name), T.content_words(description))))
    return F.when(rank.isNotNull(), F.struct(rank.alias("quality"), (-extra).alias("extra")))


def extract_page(found: DataFrame, fields: DataFrame, tiers: tuple[str, ...] = ("declared", "labeled", "proximate")) -> DataFrame:
    """One row per page and field of ``fields(name, description)``: outcome, value, provenance, rivals and disagreeing lower tiers.

    The best match in the first tier with any hit decides. Outcomes in order:
    ``secret`` (nothing else matches), ``not_found`` with ``styling_only`` if only
    words of classes without text do, ``hidden`` if the value cannot be seen,
    ``empty``, ``ambiguous`` (several values; none is picked), ``found``;
    ``not_found`` where nothing matched. ``hints`` counts class words that match
    a field which was not found, of which ``styling_only`` says that none has
    text. Fields meet the distinct keys of all pages once and the pages by an
    equi-join on the key.
    """
    found = stored(found)  # read three times
    position = F.array_position(F.array(*map(F.lit, (*tiers, *(t for t in TIERS if t not in tiers)))), F.col("tier")).cast("int")
    keys = found.where(F.col("tier").isin("hint", *tiers)).select("key").distinct()
    asked = fields.select("name", F.coalesce("description", F.lit("")).alias("description"))
    matched = stored(keys.crossJoin(few(asked)).withColumn("m", match_quality(F.col("key"), F.col("name"), F.col("description"))).where("m is not null").select("key", "name", "m"))
    every = found.where(F.col("tier").isin("hint", *tiers)).join(few(matched), "key").withColumn("p", position)
    scored = every.where(F.col("tier").isin(*tiers))
    w = W.partitionBy("page_id", "name")
    first = scored.withColumn("top", F.min("p").over(w))
    best = first.where("p = top").withColumn("high", F.max("m").over(w)).where("m = high")
    value = F.when(~F.col("secret") & (F.col("value") != ""), F.col("value"))
    open_ = ~F.col("secret")
    got = best.groupBy("page_id", "name").agg(
        F.min("tier").alias("tier"), F.array_sort(F.collect_set(value)).alias("values"), F.min("secret").alias("all_secret"), F.min_by("key", "seq").alias("matched_key"), F.min_by("by", "seq").alias("by"),
        F.coalesce(F.min(F.when(open_, F.col("styling_only"))), F.lit(False)).alias("styled"), F.coalesce(F.max(F.when(open_, F.col("withheld"))), F.lit(False)).alias("unseen"),
    )
    answer = F.when(F.size("values") == 1, F.get("values", F.lit(0)))
    lower = first.where("p > top").groupBy("page_id", "name").agg(F.array_sort(F.collect_set(value)).alias("lower"))
    hints = every.where("tier = 'hint'").groupBy("page_id", "name").agg(F.count("*").alias("hints"), F.min("styling_only").alias("hint_styled"))
    out = found.select("page_id").distinct().crossJoin(few(fields.select("name"))).join(got, ["page_id", "name"], "left").join(lower, ["page_id", "name"], "left").join(hints, ["page_id", "name"], "left")
    bare = F.size("values") == 0
    outcome = F.when(F.col("tier").isNull(), "not_found").when(F.col("all_secret"), "secret").when(bare & F.col("styled"), "not_found").when(bare & F.col("unseen"), "hidden").when(bare, "empty").when(F.size("values") > 1, "ambiguous").otherwise("found")
    out = out.withColumn("outcome", outcome)
    missing = F.col("outcome") == "not_found"
    rivals = F.slice(F.filter(F.coalesce("lower", F.array().cast("array<string>")), lambda v: v != answer), 1, 4)
    return out.select(
        "page_id", "name", "outcome", F.when(F.col("outcome") == "found", answer).alias("value"), F.when(~missing, F.col("tier")).alias("tier"), F.when(~missing, F.col("matched_key")).alias("matched_key"), F.when(~missing, F.col("by")).alias("by"),
        F.when(F.col("outcome") == "ambiguous", F.slice("values", 1, 6)).alias("candidates"), F.when(F.col("outcome") == "found", rivals).alias("disagreement"),
        F.when(missing, F.coalesce("hints", F.lit(0))).cast("long").alias("hints"), (missing & F.coalesce("hint_styled", F.lit(False))).alias("styling_only"),
    )


def aggregate(urls: DataFrame, pages: DataFrame, results: DataFrame) -> DataFrame:
    """One slot per ``urls(pos, url)`` and field; a URL without a stored page has an error and no fields."""
    known = urls.join(pages.select("url", "page_id"), "url", "left")
    return known.join(results, "page_id", "left").withColumn("error", F.when(F.col("page_id").isNull(), "not in corpus"))


def rollup_fields(results: DataFrame) -> DataFrame:
    """Outcomes counted per field, with the total over all fields."""
    kinds = ["found", "not_found", "ambiguous", "hidden", "empty", "secret"]
    return results.rollup("name").agg(*(F.count_if(F.col("outcome") == k).alias(k) for k in kinds))


def lead_of(nodes: DataFrame, least: int = 120) -> DataFrame:
    """First paragraph of ``least`` characters of each page."""
    return text_blocks(nodes).where((F.col("tag") == "p") & (F.length("text") >= least)).groupBy("page_id").agg(F.min_by("text", "start").alias("lead"))


#: Least characters of both keys, and least share of the longer one that the shorter makes up, for a part to count.
PART_CHARS, PART_SHARE = 4, 0.2


def field_sources(nodes: DataFrame, leaves: DataFrame | None = None, most: int = 800) -> DataFrame:
    """``page_id, seq, key, value, by``: what a page names by itself, at most ``most`` a page.

    In order of kind: JSON-LD leaves of up to two levels, metas, microdata,
    definition lists, rows of two cells, labelled fields that hold no secret.
    """
    order = ("json-ld", "meta", "microdata", "dl", "row", "form-field")
    found = evidence(nodes, None, ("declared", "labeled")).where(F.col("by").isin(*order)).select("page_id", "seq", "key", "value", "by")
    if leaves is not None:
        found = found.unionByName(leaves.where(F.size(F.split("path", r"\.")) <= 2).select("page_id", F.lit(-1).alias("seq"), F.col("path").alias("key"), F.left("value", F.lit(VALUE_CHARS)).alias("value"), F.lit("json-ld").alias("by")))
    kind = F.lower(F.coalesce(attr("type"), F.lit("")))
    secret = kind.isin("password", "hidden") | F.coalesce(F.lower(attr("autocomplete")).rlike("current-password|new-password|one-time-code"), F.lit(False))
    fields = accessible_names(nodes, nodes.where(F.col("tag").isin("input", "textarea") & ~secret & (F.coalesce(attr("value"), F.lit("")) != "")))
    found = found.unionByName(fields.where("name <> ''").select("page_id", F.col("node_id").alias("seq"), F.col("name").alias("key"), attr("value").alias("value"), F.lit("form-field").alias("by")))
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("by"))
    ranked = found.where("key <> '' and value <> ''").withColumn("n", F.row_number().over(W.partitionBy("page_id").orderBy(rank, "seq", "key")))
    return ranked.where(F.col("n") <= most).select("page_id", F.col("n").alias("seq"), "key", "value", "by")


def extract_fields(sources: DataFrame, fields: DataFrame) -> DataFrame:
    """One row per page and field of ``fields(name, hint)``, a small broadcast table: ``found, value, by, matched_key, quality, others``.

    ``sources(page_id, seq, key, value, by)``; of keys equal in letters and
    digits the first counts. The name decides before the hint, an equal key
    before a part. A part is one key inside the other, both of ``PART_CHARS``
    or more and the shorter at least ``PART_SHARE`` of the longer; parts are
    ranked by share, then length, then key, and up to three others are named.
    A page without sources has no rows.
    """
    sources = stored(sources)  # read for its keys and for its pages
    first = sources.withColumn("norm", T.norm_key(F.col("key"))).where("norm <> ''").groupBy("page_id", "norm").agg(F.min(F.struct("seq", "key", "value", "by")).alias("s"))
    first, pages = stored(first), sources.select("page_id").distinct()
    asked = few(fields.select("name", F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.col("name").alias("text")), F.struct(F.lit(1).alias("turn"), F.coalesce("hint", F.lit("")).alias("text")))).alias("q")).select("name", "q.turn", T.norm_key(F.col("q.text")).alias("needle")).where("needle <> ''"))
    shorter, longer = F.least(F.length("norm"), F.length("needle")), F.greatest(F.length("norm"), F.length("needle"))
    share = shorter / longer
    equal = F.col("norm") == F.col("needle")
    part = (shorter >= PART_CHARS) & (share >= PART_SHARE) & (F.contains("norm", F.col("needle")) | F.contains("needle", F.col("norm")))
    matched = stored(first.select("norm").distinct().crossJoin(asked).where(equal | part))  # distinct keys meet the fields once
    hits = first.join(few(matched), "norm").select("page_id", "name", F.struct("turn", (~equal).cast("int").alias("partly"), (-share).alias("share"), (-shorter).alias("overlap"), "norm", "s").alias("m"))
    ranked = hits.withColumn("n", F.row_number().over(W.partitionBy("page_id", "name").orderBy("m.turn", "m.partly", "m.share", "m.overlap", "m.norm")))
    best = ranked.where("n = 1").select("page_id", "name", "m.turn", "m.partly", "m.s")
    others = ranked.join(best.where("partly = 1").select("page_id", "name", "turn"), ["page_id", "name"]).where((F.col("n").between(2, 4)) & (F.col("m.turn") == F.col("turn"))).groupBy("page_id", "name").agg(F.array_join(F.array_sort(F.collect_list(F.struct("n", F.col("m.s.key").alias("key"))))["key"], ",").alias("others"))
    every = pages.crossJoin(few(fields.select("name")))
    j = every.join(best, ["page_id", "name"], "left").join(others, ["page_id", "name"], "left")
    return j.select("page_id", "name", F.col("s").isNotNull().alias("found"), "s.value", "s.by", F.col("s.key").alias("matched_key"), F.when(F.col("partly") == 0, "exact").when(F.col("partly") == 1, "partial").alias("quality"), "others")
