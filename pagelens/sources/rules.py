"""Declared rules and endpoints: robots files, well-known documents, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelens.functions import text as T
from pagelens.functions import urls as U

#: Limits of a profile folder: bytes of a file, files, bytes in all.
MAX_FILE, MAX_FILES, MAX_TOTAL = 64 << 10, 500, 8 << 20
PROFILE = "slug string, source string, hosts array<string>, not_hosts array<string>, path_prefix array<string>"
ENDPOINT_KEYS = ("agents", "endpoints", "services", "tools", "apis", "resources", "routes", "capabilities")


def robots_advisory(robots: DataFrame, urls: DataFrame) -> DataFrame:
    """For each ``url`` the first ``Disallow`` rule of the ``User-agent: *`` blocks of its origin's ``robots(origin, body)`` that is a prefix of its path.

    The latest agent line decides which block a rule is in; ``Allow`` and empty
    rules are ignored. ``rule`` is null where nothing disallows.
    """
    lines = robots.select("origin", F.posexplode(F.split("body", r"\r?\n")).alias("line_no", "raw"))
    parsed = lines.select("origin", "line_no", F.trim(F.regexp_replace("raw", "#.*$", "")).alias("l")).select("origin", "line_no", F.lower(F.trim(F.substring_index("l", ":", 1))).alias("k"), F.trim(F.regexp_replace("l", "^[^:]*:", "")).alias("v"))
    w = W.partitionBy("origin").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    agent = F.last(F.when(F.col("k") == "user-agent", F.col("v")), ignorenulls=True).over(w)
    rules = parsed.withColumn("agent", agent).where("agent = '*' and k = 'disallow' and v <> ''").select("origin", "line_no", F.col("v").alias("rule"))
    asked = urls.select("url", U.url_origin(F.col("url")).alias("origin"), F.concat(F.coalesce(F.nullif(U.part(F.col("url"), "PATH"), F.lit("")), F.lit("/")), F.coalesce(F.concat(F.lit("?"), U.part(F.col("url"), "QUERY")), F.lit(""))).alias("path"))
    hit = asked.join(rules, "origin").where(F.startswith("path", F.col("rule"))).groupBy("url").agg(F.min_by("rule", "line_no").alias("rule"))
    return urls.select("url").join(hit, "url", "left").withColumn("disallowed", F.col("rule").isNotNull())


def read_wellknown(docs: DataFrame, limit: int = 25) -> DataFrame:
    """Endpoints declared by ``docs(origin, path, body)``: a list at the root or under a known key.

    Name from name, title or id; address from url, href, endpoint, path or uri,
    resolved against the origin; ``off_origin`` marks other hosts. ``total``
    counts all that were seen. Invalid JSON gives no rows.
    """
    item = "array<struct<name:string,title:string,id:string,url:string,href:string,endpoint:string,path:string,uri:string>>"
    lists = F.array(F.from_json("body", item), *(F.from_json(F.get_json_object("body", f"$.{k}"), item) for k in ENDPOINT_KEYS))
    rows = docs.select("origin", F.col("path").alias("doc"), F.posexplode(F.flatten(F.filter(lists, lambda x: x.isNotNull()))).alias("pos", "e"))
    named = rows.select("origin", "doc", "pos", F.left(F.coalesce("e.name", "e.title", "e.id", F.lit("")), F.lit(120)).alias("name"), F.coalesce("e.url", "e.href", "e.endpoint", "e.path", "e.uri").alias("address")).where("address is not null or name <> ''")
    full = U.resolve_href(F.concat("origin", F.lit("/")), F.col("address"))
    out = named.withColumn("url", F.left(full, F.lit(300))).withColumn("off_origin", F.coalesce(U.url_origin(full) != F.col("origin"), F.lit(False)))
    w = W.partitionBy("origin", "doc")
    return out.withColumn("total", F.count("*").over(w)).withColumn("n", F.row_number().over(w.orderBy("pos"))).where(F.col("n") <= limit).drop("pos", "address")


def read_profiles(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """``(profiles, problems)`` of a folder of JSON files; a bad file is a problem row with its reason, never an error."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length", F.col("content").cast("string").alias("body"))
    w = W.orderBy("path")  # at most MAX_FILES are read; the rest is listed by name alone
    few = files.orderBy("path").limit(MAX_FILES).withColumn("sofar", F.sum("length").over(w.rowsBetween(W.unboundedPreceding, 0)))
    parsed = few.withColumn("p", F.from_json("body", PROFILE))
    control = F.exists(F.coalesce("p.hosts", F.array().cast("array<string>")), lambda h: h.rlike(r"[\p{Cntrl}]"))
    reason = F.when(F.col("length") > MAX_FILE, "too large").when(F.col("sofar") > MAX_TOTAL, "folder too large").when(F.try_parse_json("body").isNull(), "not JSON").when(F.coalesce("p.slug", F.lit("")) == "", "no slug").when(F.coalesce(F.size("p.hosts"), F.lit(0)) < 1, "no hosts").when(control, "control characters")
    judged = parsed.withColumn("reason", reason)
    return judged.where("reason is null").select("p.*"), judged.where("reason is not null").select("path", "reason")


def url_preflight(urls: DataFrame) -> DataFrame:
    """Bad entries of ``urls(pos, url)`` with their reason; an empty result lets the batch pass."""
    scheme, host = F.lower(U.part(F.col("url"), "PROTOCOL")), U.part(F.col("url"), "HOST")
    reason = F.when(F.col("url").isNull() | (T.squash(F.col("url")) == ""), "empty").when(scheme.isNull(), "not a url").when(~scheme.isin("http", "https"), "scheme").when(F.coalesce(host, F.lit("")) == "", "no host")
    return urls.withColumn("reason", reason).where("reason is not null")
