"""Request, console and audit logs; budgets, loops and rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelens.functions import urls as U
from pagelens.operators.fold import ordered_fold
from pagelens.session import few

#: Session limits, console levels, header names.
LIMITS = {"action": 300, "navigation": 150, "new_origin": 30, "download": 40}
WALL_CLOCK_S = 14_400
LEVELS = ("debug", "log", "info", "warning", "error")
CREDENTIAL_HEADERS = ("authorization", "proxy-authorization", "x-api-key", "api-key", "x-auth-token", "x-csrf-token", "x-xsrf-token", "x-amz-security-token")
FORBIDDEN_HEADERS = ("host", "connection", "content-length", "transfer-encoding", "upgrade", "keep-alive", "te", "trailer", "expect")
MASK = "[masked]"


def list_requests(requests: DataFrame, contains: str | None = None, resource_type: str | None = None, include_analytics: bool = False, start: int = 0, limit: int = 40) -> DataFrame:
    """A page of matching requests by ``id`` with the totals recorded, matched and hidden as analytics."""
    mark = requests.withColumn("analytics", U.is_analytics(F.col("url")))
    hit = (F.contains("url", F.lit(contains)) if contains else F.lit(True)) & (F.col("resource_type") == resource_type if resource_type else F.lit(True))
    shown = hit if include_analytics else hit & ~F.col("analytics")
    totals = mark.agg(F.count("*").alias("recorded"), F.count_if(shown).alias("matched"), F.count_if(hit & F.col("analytics")).alias("analytics_hidden"))
    return page_slice(mark.where(shown), ["id"], start, limit).crossJoin(F.broadcast(totals))


def page_slice(df: DataFrame, order: list[str], start: int = 0, limit: int = 40) -> DataFrame:
    """Rows ``start`` to ``start + limit`` by ``order`` as ``pos``, with ``total`` and ``next_start``.

    A global top-k: each partition keeps its first ``start + limit`` rows, so
    only those meet in one task; the total is a separate count.
    """
    top = df.orderBy(*order).limit(start + limit)
    numbered = top.withColumn("pos", F.row_number().over(W.orderBy(*order)) - 1).where(F.col("pos") >= start)
    total = df.agg(F.count("*").alias("total"))
    return numbered.crossJoin(F.broadcast(total)).withColumn("next_start", F.when(F.col("total") > start + limit, F.lit(start + limit)))


def seconds(ts: str) -> Column:
    """Epoch seconds of a timestamp with or without a time zone, or of a number."""
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def header_class(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.isin("cookie", "set-cookie"), "cookie").when(n.isin(*FORBIDDEN_HEADERS) | n.startswith("sec-"), "forbidden").when(n.isin(*CREDENTIAL_HEADERS) | n.rlike("token|secret|password|session"), "credential").otherwise("ordinary")


def redact_headers(headers: Column) -> Column:
    return F.transform_values(headers, lambda k, v: F.when(header_class(k).isin("cookie", "credential"), F.lit(MASK)).otherwise(v))


def export_har(requests: DataFrame, include_analytics: bool = False) -> DataFrame:
    """One HAR 1.2 entry per request as JSON; bodies left out, credential headers masked, unknown times -1."""
    rows = requests if include_analytics else requests.where(~U.is_analytics(F.col("url")))
    pairs = F.transform(F.map_entries(redact_headers(F.coalesce("headers", F.create_map().cast("map<string,string>")))), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    entry = F.struct(
        F.col("started").alias("startedDateTime"), F.lit(-1).alias("time"),
        F.struct(F.col("method"), F.col("url"), F.lit("HTTP/1.1").alias("httpVersion"), pairs.alias("headers"), F.lit(-1).alias("headersSize"), F.lit(-1).alias("bodySize")).alias("request"),
        F.struct(F.coalesce("status", F.lit(0)).alias("status"), F.coalesce("failure", F.lit("")).alias("statusText"), F.lit(-1).alias("headersSize"), F.lit(-1).alias("bodySize")).alias("response"),
    )
    return rows.select("session", "id", F.to_json(entry).alias("entry"))


def console_shape(text: Column) -> Column:
    """The message with ids and numbers blanked, at most 200 characters."""
    ids = F.regexp_replace(text, r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<id>")
    return F.left(F.trim(F.regexp_replace(F.regexp_replace(ids, r"(?i)\b0x[0-9a-f]+\b|\b[0-9]+(\.[0-9]+)?\b", "#"), r"\s+", " ")), F.lit(200))


def console_shapes(console: DataFrame, level: str = "error", limit: int = 40) -> DataFrame:
    """Messages at or above ``level`` by shape: count and first sample, commonest first, with totals."""
    shaped = console.where(F.col("level").isin(*LEVELS[LEVELS.index(level) :])).withColumn("shape", console_shape(F.col("text")))
    groups = shaped.groupBy("level", "shape").agg(F.count("*").alias("n"), F.min_by("text", "seq").alias("sample"), F.min("seq").alias("first_seq"))
    totals = groups.agg(F.sum("n").alias("lines_at_level"), F.count("*").alias("unique_shapes"), (F.sum("n") - F.count("*")).alias("collapsed"))
    return groups.orderBy(F.desc("n"), "first_seq").limit(limit).crossJoin(F.broadcast(totals))


def newest(df: DataFrame, order: str = "seq", limit: int = 20) -> DataFrame:
    """The newest rows, oldest of them first (a top-k report)."""
    return df.orderBy(F.desc(order)).limit(limit).orderBy(order)


def audit_page(audit: DataFrame, tool: str | None = None, session: str | None = None, start: int = 0, limit: int = 40) -> DataFrame:
    rows = audit
    for name, value in (("tool", tool), ("session", session)):
        rows = rows if value is None else rows.where(F.col(name) == value)
    return page_slice(rows, ["seq"], start, min(limit, 500))


def compact_audit(audit: DataFrame, keep: int = 5000) -> DataFrame:
    """The newest ``keep`` records."""
    return audit.orderBy(F.desc("seq")).limit(keep)


def scrub_args(args: Column, denied: tuple[str, ...] = ("password", "secret", "token", "value", "text")) -> Column:
    """Denied arguments as length and digest; others clipped at 200 characters with their length."""
    secret = lambda v: F.concat(F.lit("len="), F.length(v).cast("string"), F.lit(" sha256="), F.left(F.sha2(v, 256), F.lit(8)))
    clipped = lambda v: F.when(F.length(v) > 200, F.concat(F.left(v, F.lit(200)), F.lit("... ("), F.length(v).cast("string"), F.lit(" chars)"))).otherwise(v)
    return F.transform_values(args, lambda k, v: F.when(F.lower(k).isin(*denied), secret(v)).otherwise(clipped(v)))


def redact_secrets(text: Column, secrets: list[str], mask: str = MASK) -> Column:
    """Every observed secret replaced, longest first; the list is the caller's own bounded vault."""
    out = text
    for s in sorted({x for x in secrets if x}, key=lambda x: (-len(x), x)):
        out = F.replace(out, F.lit(s), F.lit(mask))
    return out


def workflow_steps(audit: DataFrame, first: int, last: int) -> DataFrame:
    """Replayable steps of a slice of the audit log in order; a list of steps wins over a single one."""
    steps = F.coalesce("replay_steps", F.when(F.col("replay").isNotNull(), F.array("replay")))
    rows = audit.where(F.col("seq").between(first, last)).select("session", "seq", F.posexplode(steps).alias("part", "step"))
    return rows.withColumn("number", F.row_number().over(W.partitionBy("session").orderBy("seq", "part"))).select("session", "number", "seq", "step.tool", "step.args")


def list_workflows(flows: DataFrame, origin_host: str) -> DataFrame:
    """Workflows recorded on a host or on a subdomain of it."""
    host = F.lower("host")
    return flows.where((host == origin_host.lower()) | F.endswith(host, F.lit("." + origin_host.lower())))


class Budget:
    """What a session has spent so far."""

    def __init__(self, limits: dict[str, int], wall_clock: float):
        self.limits, self.wall_clock, self.began = limits, wall_clock, None
        self.action = self.navigation = self.download = 0
        self.origins: set[str] = set()  # no more than the limit of new ones

    def charge(self, ts: float | None, kind: str | None, origin: str | None) -> str | None:
        """The limit that refuses the call, or null after it is billed. All checks come before all increments."""
        self.began = ts if self.began is None else self.began
        fresh = origin is not None and origin not in self.origins
        if ts is not None and self.began is not None and ts - self.began > self.wall_clock:
            return "wall_clock"
        if self.action >= self.limits["action"]:
            return "action"
        if kind == "navigation" and self.navigation >= self.limits["navigation"]:
            return "navigation"
        if kind == "download" and self.download >= self.limits["download"]:
            return "download"
        if fresh and len(self.origins) >= self.limits["new_origin"]:
            return "new_origin"
        self.action += 1
        self.navigation += kind == "navigation"
        self.download += kind == "download"
        if fresh:
            self.origins.add(origin)
        return None


def charge_budget(calls: DataFrame, limits: dict[str, int] | None = None, wall_clock: float = WALL_CLOCK_S) -> DataFrame:
    """Each call of ``calls(session, seq, ts, kind, origin)`` with ``refused``, the spent limit or null.

    Refused calls are not billed and do not add their origin, so each verdict
    rests on those before it: an ordered fold with a bounded state.
    """
    lim = {**LIMITS, **(limits or {})}
    rows = calls.select("session", F.col("seq").cast("long").alias("seq"), seconds("ts").alias("ts"), "kind", "origin")
    kind = calls.select("session").schema[0].dataType.simpleString()
    return ordered_fold(rows, "session", ["seq"], lambda: Budget(lim, wall_clock), lambda b, r: (r[0], r[1], b.charge(*r[2:])), f"session {kind}, seq long, refused string")


def budget_snapshot(calls: DataFrame) -> DataFrame:
    """Counters, distinct origins and wall clock of each session."""
    kind = lambda k: F.count_if(F.col("kind") == k).alias(f"n_{k}")
    return calls.groupBy("session").agg(F.count("*").alias("n_calls"), kind("navigation"), kind("download"), F.count_distinct("origin").alias("origins"), (F.max(seconds("ts")) - F.min(seconds("ts"))).alias("wall_s"))


def loop_detect(calls: DataFrame, same: int = 5, window: int = 20, alternate: int = 8) -> DataFrame:
    """Calls of ``calls(session, seq, sig)`` that close a loop: ``repeat`` or ``alternation``."""
    w = W.partitionBy("session").orderBy("seq")
    recent = F.collect_list("sig").over(w.rowsBetween(1 - window, 0))
    last = F.slice(F.col("recent"), F.greatest(F.size("recent") - alternate + 1, F.lit(1)), F.lit(alternate))
    flips = (F.size("recent") >= alternate) & F.forall(F.transform("last", lambda x, i: x == F.get("last", i % 2)), lambda b: b) & (F.get("last", F.lit(0)) != F.get("last", F.lit(1)))
    rows = calls.withColumn("recent", recent).withColumn("last", last)
    n = F.size(F.filter("recent", lambda x: x == F.col("sig")))
    return rows.withColumn("loop", F.when(n >= same, "repeat").when(flips, "alternation")).drop("recent", "last")


def parse_retry_after(raw: Column, now: Column, most: float = 86_400.0) -> Column:
    """Seconds to wait (0 to ``most``) from a number or an HTTP date; null for anything else. ``now`` is a timestamp."""
    text = F.trim(raw)
    n = text.try_cast("double")
    number = F.when(F.isnan(n) | (F.abs(n) == float("inf")), F.lit(None)).otherwise(n)
    date = F.try_to_timestamp(F.regexp_extract(text, r"^[A-Za-z]{3}, ([0-9]{2} [A-Za-z]{3} [0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.when(n.isNotNull(), number).otherwise((F.unix_micros(date.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / 1e6)
    return F.when(wait.isNotNull(), F.least(F.greatest(wait, F.lit(0.0)), F.lit(most)))


def backoff_windows(responses: DataFrame, default_s: float = 60.0) -> DataFrame:
    """Requests of ``responses(domain, ts, status, wait)`` refused because an earlier 429 or 503 asked to wait until later.

    A running maximum per domain; a wait of 0 opens nothing and never shortens.
    """
    t = seconds("ts")
    wait = F.when(F.col("status").isin(429, 503), F.coalesce("wait", F.lit(default_s)))
    w = W.partitionBy("domain").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, -1)
    opened = F.when(wait > 0, F.struct((t + wait).alias("until"), F.col("status").alias("owner")))
    rows = responses.withColumn("open", F.max(opened).over(w))
    return rows.withColumn("refused", F.coalesce(F.col("open.until") > t, F.lit(False))).withColumn("owner_status", F.when(F.col("refused"), F.col("open.owner"))).drop("open")


def origin_verdict(urls: DataFrame, deny: list[str], allow: list[str]) -> DataFrame:
    """``allowed``, ``denied``, ``denied-scheme`` or ``off-list`` for each ``url``; patterns are origins, ``*.host`` (apex included) or hosts."""
    origin, host = U.url_origin(F.col("url")), F.lower(U.part(F.col("url"), "HOST"))

    def matches(patterns: list[str]) -> Column:
        out = F.lit(False)
        for p in (x.lower() for x in patterns):
            out = out | ((origin == p) if "://" in p else ((host == p[2:]) | F.endswith(host, F.lit("." + p[2:]))) if p.startswith("*.") else (host == p))
        return F.coalesce(out, F.lit(False))

    verdict = F.when(origin.isNull() & ~F.coalesce(F.col("url").rlike("^(about|chrome|edge):"), F.lit(False)), "denied-scheme").when(matches(deny), "denied").when(F.lit(bool(allow)) & ~matches(allow), "off-list").otherwise("allowed")
    return urls.withColumn("verdict", verdict)


def list_cookies(cookies: DataFrame, name: str | None = None) -> DataFrame:
    rows = cookies if name is None else cookies.where(F.contains(F.lower("name"), F.lit(name.lower())))
    return rows.withColumn("value", F.lit(MASK)) if "value" in rows.columns else rows


def auth_expiry(cookies: DataFrame, now_s: float) -> DataFrame:
    """Earliest expiry among each state's credential cookies and a note; values in milliseconds are recognised."""
    seconds = F.when(F.col("expires") > 1e11, F.col("expires") / 1000).otherwise(F.col("expires"))
    rows = cookies.where(F.lower("name").rlike("sess|auth|token|sid|login|jwt")).withColumn("at", F.when(seconds > 0, seconds))
    out = rows.groupBy("state").agg(F.min("at").alias("expires_at"), F.min_by("name", "at").alias("cookie"), F.count_if(F.col("at").isNull()).alias("session_cookies"))
    left = F.col("expires_at") - now_s
    return out.withColumn("note", F.when(left <= 0, "expired").when(left < 86_400, "under 24 h").when(left.isNull(), "none").otherwise("valid"))


def a11y_rollup(results: DataFrame, examples: int = 3) -> DataFrame:
    """Accessibility results of all frames by bucket and rule, worst impact and most nodes first.

    ``results(page_id, frame, violations, incomplete)`` holds arrays of ``struct<id,impact,nodes:array<struct<target:string,message:string>>>``.
    """
    one = lambda c, b: results.select("page_id", "frame", F.lit(b).alias("bucket"), F.explode(c).alias("r"))
    flat = one("violations", "violations").unionByName(one("incomplete", "needs_review")).select("page_id", "frame", "bucket", F.col("r.id").alias("rule"), "r.impact", F.posexplode_outer("r.nodes").alias("pos", "node"))
    order = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in (("critical", 0), ("serious", 1), ("moderate", 2), ("minor", 3)) for x in kv)), F.col("impact")), F.lit(4))
    picked = flat.withColumn("n", F.row_number().over(W.partitionBy("page_id", "bucket", "rule").orderBy("frame", "pos")))
    out = picked.groupBy("page_id", "bucket", "rule").agg(F.min(order).alias("impact_rank"), F.count("node").alias("nodes"), F.array_sort(F.collect_list(F.when((F.col("n") <= examples) & F.col("node").isNotNull(), F.struct("n", "node.target", "node.message")))).alias("examples"))
    return out.withColumn("rank", F.row_number().over(W.partitionBy("page_id", "bucket").orderBy("impact_rank", F.desc("nodes"), "rule")))


def bind_parameters(steps: DataFrame, parameters: DataFrame) -> DataFrame:
    """Where each declared value of ``parameters(param, declared)`` stands in the arguments of ``steps(session, number, args)``: a row for each place, from 1, with the value's length.

    Places of one value do not overlap. ``origin_slot`` marks an argument whose
    value begins with a web origin. Empty values bind nothing. ``parameters`` is
    the caller's short list; it is broadcast if it is counted to be small.
    """
    flat = steps.select("session", "number", F.explode("args").alias("arg", "value"))
    wanted = few(parameters.where("declared <> ''"))
    hit = flat.join(wanted, F.contains(flat["value"], wanted["declared"]))
    quoted = F.concat(F.lit("\\Q"), F.replace(F.col("declared"), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    size = F.length("declared")
    sizes = F.transform(F.split("value", quoted, -1), lambda x: F.length(x))
    begin = lambda i: F.aggregate(F.slice("sizes", 1, i), F.lit(1), lambda total, n: total + n) + (i - 1) * size
    placed = hit.withColumn("sizes", sizes).withColumn("at", F.explode(F.transform(F.sequence(F.lit(1), F.size("sizes") - 1), begin)))
    return placed.select("session", "number", "arg", "param", "at", size.alias("size"), "value", F.coalesce(F.col("value").rlike("^https?://"), F.lit(False)).alias("origin_slot"))


def apply_parameters(bound: DataFrame, supplied: DataFrame) -> DataFrame:
    """``session, number, arg, param, value, refused``: each argument with ``supplied(param, given)`` in all places of a parameter.

    Places are filled from the last to the first, so that none moves another. A
    slot that carries an origin must keep its scheme, host and port, else
    ``refused`` is true and the value stays; a parameter that is not supplied
    leaves its value.
    """
    slots = bound.groupBy("session", "number", "arg", "param", "value", "origin_slot").agg(F.reverse(F.array_sort(F.collect_set(F.struct("at", "size")))).alias("places"))
    j = slots.join(few(supplied), "param", "left")
    filled = F.aggregate("places", F.col("value"), lambda v, x: F.concat(F.left(v, x["at"] - 1), F.col("given"), F.substr(v, x["at"] + x["size"])))
    j = j.withColumn("filled", F.when(F.col("given").isNotNull(), filled).otherwise(F.col("value")))
    moved = F.col("origin_slot") & ~U.url_origin(F.col("filled")).eqNullSafe(U.url_origin(F.col("value")))
    return j.select("session", "number", "arg", "param", F.when(moved, F.col("value")).otherwise(F.col("filled")).alias("value"), moved.alias("refused"))
