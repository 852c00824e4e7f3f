"""Classification of stored responses, form submissions and site profiles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelens.functions import submission_words as named
from pagelens.functions import urls as U
from pagelens.functions.normal import folded
from pagelens.session import few

#: Labels from most to least severe.
SEVERITY = ("captcha", "botwall", "rate_limited", "login_required", "geo_blocked", "age_gated", "paywall_academic", "paywall_news", "paywall_saas", "maintenance", "http_500", "http_404", "soft_404", "gdpr_consent")
WALLS = {"captcha": "captcha", "botwall": "botwall", "rate_limited": "rate-limit", "login_required": "login", "geo_blocked": "geo"}
REFUSING = (401, 403, 405, 406, 429, 503)
READABLE = 200
#: Response headers (name, part of the value) that name a vendor on any response.
EDGE_HEADERS = (
    ("server", "cloudflare", "Cloudflare"), ("cf-ray", "", "Cloudflare"), ("server", "akamaighost", "Akamai"), ("akamai-grn", "", "Akamai"), ("x-akamai-transformed", "", "Akamai"),
    ("x-datadome", "", "DataDome"), ("x-cdn", "imperva", "Imperva"), ("x-iinfo", "", "Imperva"), ("server", "cloudfront", "AWS CloudFront"), ("x-amz-cf-id", "", "AWS CloudFront"),
)
#: Headers that are set only with a challenge or block; their presence decides alone.
BLOCK_HEADERS = (("cf-mitigated", "Cloudflare"), ("x-dd-b", "DataDome"), ("x-px-blocked", "HUMAN (PerimeterX)"), ("x-amzn-waf-action", "AWS WAF"))
#: Texts and sources of block pages; they count where the status refuses.
BLOCK_TEXT = (("request unsuccessful. incapsula incident id", "Imperva"), ("please enable js and disable any ad blocker", "DataDome"), ("press & hold", "HUMAN (PerimeterX)"), ("before we continue...", "HUMAN (PerimeterX)"))
BLOCK_SOURCE = (("/* perimeterx assignments */", "HUMAN (PerimeterX)"), ("window._pxappid", "HUMAN (PerimeterX)"), ("px-captcha", "HUMAN (PerimeterX)"), ("captcha-delivery.com", "DataDome"), ("var dd={", "DataDome"))
#: Words of our own choice.
BLOCK_WORDS = r"access denied|request blocked|unusual traffic|automated (requests|queries)|verify you are (a )?human|are you a robot|security check|checking your browser"
CHALLENGE = r"captcha|challenge|just a moment|attention required|verify|robot"
CAPTCHA_WORDS = r"g-recaptcha|h-captcha|cf-turnstile|captcha|i am not a robot|i'm not a robot"
LOGIN_WORDS = r"(please )?(log|sign) ?in to (continue|view|access)|login required|you must be logged in"
LOGIN_PATH = r"(?i)/(login|log-in|signin|sign-in|sso|auth|account/login|session/new)(/|$|\?|\.)"
CONTINUE = r"[?&](next|return|returnto|return_to|redirect|redirect_uri|continue|url|service|destination)="
MAINTENANCE_WORDS = r"maintenance|temporarily (down|unavailable)|be back (soon|shortly)|scheduled (down|maint)"
MISSING_WORDS = r"not found|page (doesn.t|does not) exist|no longer (available|exists)|404"
RATE_WORDS = r"too many requests|rate limit|slow down|try again later"
PAYWALL_WORDS = r"subscribe to (continue|read)|subscribers? only|already a subscriber|to continue reading|free articles? (left|remaining)"
SAAS_WORDS = r"upgrade (your plan|to (continue|pro))|free trial (has )?ended|choose a plan"
GEO_WORDS = r"not available in your (country|region)|geo.?restricted|unavailable for legal reasons"
AGE_WORDS = r"(are you|you must be) (over |at least )?(18|21)|age verification|date of birth"
CONSENT_VENDORS = r"onetrust|cookiebot|trustarc|didomi|quantcast|usercentrics|sourcepoint"


def header(name: str) -> Column:
    return F.col("headers")[name]


def refuses() -> Column:
    return F.coalesce(F.col("status").isin(*REFUSING), F.lit(False))


def page_signs(signs: tuple[tuple[str, str], ...], *columns: str) -> list[Column]:
    """The vendor of each sign that these columns hold on a refused response, else null."""
    text = F.lower(F.concat_ws("\n", *columns))
    return [F.when(refuses() & F.contains(text, F.lit(sign)), F.lit(vendor)) for sign, vendor in signs]


def all_vendors() -> Column:
    """Every vendor that headers, texts or sources name, in rule order, once each."""
    edge = [F.when(F.contains(F.lower(header(h)), F.lit(part)), F.lit(v)) for h, part, v in EDGE_HEADERS]
    block = [F.when(header(h).isNotNull(), F.lit(v)) for h, v in BLOCK_HEADERS]
    return F.array_distinct(F.array_compact(F.array(*block, *edge, *page_signs(BLOCK_TEXT, "title", "body"), *page_signs(BLOCK_SOURCE, "source"))))


def header_block() -> Column:
    """The vendor whose block header decides alone."""
    return F.coalesce(*(F.when(header(h).isNotNull(), F.lit(v)) for h, v in BLOCK_HEADERS))


def reference_ids(text: Column) -> Column:
    """Reference numbers that pass a token charset, by vendor."""
    found = {"ray": F.regexp_extract(text, r"(?i)ray id:?\s*([0-9a-f]{12,20})\b", 1), "akamai": F.regexp_extract(text, r"(?i)reference\s*#?\s*([0-9a-f]{1,4}(?:\.[0-9a-f]+){2,4})\b", 1), "incapsula": F.regexp_extract(text, r"(?i)incident id:?\s*([0-9-]{8,64})\b", 1), "datadome": F.regexp_extract(text, r"(?i)[?&'\"]cid['\"]?[=:]['\"]?([A-Za-z0-9~_-]{20,200})", 1)}
    return F.map_filter(F.create_map(*(x for k, v in found.items() for x in (F.lit(k), v))), lambda k, v: v != "")


def access_for_free(jsonld: Column) -> Column:
    """False if any declaration of free access is false, true if all are true, else null."""
    said = F.transform(F.regexp_extract_all(jsonld, F.lit(r'(?i)"isAccessibleForFree"\s*:\s*"?(true|false|yes|no|0|1)'), F.lit(1)), lambda v: F.lower(v).isin("true", "yes", "1"))
    return F.when(F.coalesce(F.size(said), F.lit(0)) > 0, F.forall(said, lambda v: v))


def classify_response(responses: DataFrame) -> DataFrame:
    """One row per label of each response: ``label, confidence, blocks, corroborating``.

    ``responses`` needs ``url, landed_url, status, headers (lower-case names),
    title, body, source``; ``structural`` (struct) and ``chain`` (structs with a
    ``url`` per redirect) are used where present. Any block signal confirms, two corroborating ones make a label
    probable, one possible (geo never above possible without a block). Without
    any label and with under 200 readable characters at status 200 or null, the
    label is ``insufficient_evidence``. Rows stay where they are: all rules are
    expressions, and nothing is shuffled.
    """
    s = {f.name for f in responses.schema["structural"].dataType.fields} if "structural" in responses.columns else set()
    flag = lambda n: F.coalesce(F.col(f"structural.{n}"), F.lit(False)) if n in s else F.lit(False)
    low = responses.withColumn("__t", F.lower(F.coalesce("title", F.lit("")))).withColumn("__b", F.lower(F.coalesce("body", F.lit("")))).withColumn("__s", F.lower(F.coalesce("source", F.lit(""))))
    readable = F.coalesce(F.col("structural.visible_chars"), F.length("__b")) if "visible_chars" in s else F.length("__b")
    low = low.withColumn("__e", readable < READABLE).withColumn("__r", F.coalesce(F.col("status").isin(*REFUSING), F.lit(False))).withColumn("__v", header_block()).withColumn("__n", F.coalesce("status", F.lit(0)))
    t, b, src, empty, refusing, n = F.col("__t"), F.col("__b"), F.col("__s"), F.col("__e"), F.col("__r"), F.col("__n")
    loginish = F.coalesce(F.col("landed_url").rlike(LOGIN_PATH), F.lit(False))
    continued = loginish & ~F.coalesce(F.col("url").rlike(LOGIN_PATH), F.lit(False)) & F.coalesce(F.lower("landed_url").rlike(CONTINUE), F.lit(False))
    if "chain" in responses.columns:
        hop = F.exists("chain", lambda x: x["url"].rlike(LOGIN_PATH) & F.lower(x["url"]).rlike(CONTINUE))
        continued = continued | (F.coalesce(hop, F.lit(False)) & ~F.coalesce(F.col("url").rlike(LOGIN_PATH), F.lit(False)))
    page_block = F.coalesce(*page_signs(BLOCK_TEXT, "title", "body"), *page_signs(BLOCK_SOURCE, "source")).isNotNull()
    soft = (n < 400) & (n != 202) & empty & (t.rlike(CHALLENGE) | b.rlike(CHALLENGE) | F.coalesce(F.lower("landed_url").rlike("captcha|challenge"), F.lit(False)))
    widget = src.rlike(CAPTCHA_WORDS) | b.rlike(CAPTCHA_WORDS)
    academic = src.rlike("citation_|scholarlyarticle") | b.rlike("institutional access|purchase (pdf|article)")
    paywalled = flag("paywall_container") | b.rlike(PAYWALL_WORDS)
    rules = [
        ("botwall", "B", F.col("__v").isNotNull()), ("botwall", "B", page_block), ("botwall", "B", n == 202), ("botwall", "B", soft), ("botwall", "C", refusing & b.rlike(BLOCK_WORDS)), ("botwall", "C", refusing & (F.size(all_vendors()) > 0) & src.rlike("challenge|captcha|blocked")), ("botwall", "C", refusing & t.rlike(CHALLENGE)),
        ("captcha", "B", F.coalesce(F.lower(header("x-amzn-waf-action")).contains("captcha"), F.lit(False))), ("captcha", "B", src.contains("px-captcha")), ("captcha", "C", empty & t.contains("captcha")), ("captcha", "C", (refusing | empty) & widget),
        ("rate_limited", "B", n == 429), ("rate_limited", "B", header("retry-after").isNotNull() & (n >= 400) & (n != 503)), ("rate_limited", "C", (n >= 400) & b.rlike(RATE_WORDS)),
        ("login_required", "B", n == 401), ("login_required", "B", continued), ("login_required", "C", flag("has_password_field") & (loginish | empty | refusing)), ("login_required", "C", b.rlike(LOGIN_WORDS)),
        ("maintenance", "B", (n == 503) & F.col("__v").isNull() & (t.rlike(MAINTENANCE_WORDS) | b.rlike(MAINTENANCE_WORDS))), ("maintenance", "C", (n == 503) & F.col("__v").isNull() & ~(t.rlike(MAINTENANCE_WORDS) | b.rlike(MAINTENANCE_WORDS))),
        ("http_500", "B", (n >= 500) & (n != 503)), ("http_404", "B", n == 404), ("http_404", "C", (n >= 400) & (n < 500) & ~n.isin(401, 402, 403, 404, 405, 406, 429)),
        ("soft_404", "C", (n == 200) & t.rlike(MISSING_WORDS)), ("soft_404", "C", (n == 200) & t.rlike(MISSING_WORDS) & ~flag("has_main_content")),
        ("paywall_academic", "C", academic & paywalled), ("paywall_academic", "C", academic & src.rlike(r'isaccessibleforfree"\s*:\s*"?(false|no|0)')), ("paywall_news", "C", ~academic & src.contains("newsarticle") & paywalled), ("paywall_news", "C", ~academic & src.contains("newsarticle") & src.rlike(r'isaccessibleforfree"\s*:\s*"?(false|no|0)')), ("paywall_saas", "C", n == 402), ("paywall_saas", "C", b.rlike(SAAS_WORDS)),
        ("geo_blocked", "C", n == 451), ("geo_blocked", "C", (n == 451) & b.rlike(GEO_WORDS)), ("age_gated", "B", flag("dob_form")), ("age_gated", "C", flag("blocking_overlay") & b.rlike(AGE_WORDS)),
        ("gdpr_consent", "B", flag("blocking_overlay") & src.rlike(CONSENT_VENDORS)), ("gdpr_consent", "C", flag("blocking_overlay") & b.rlike("cookies?|consent")),
    ]
    signals = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(label).alias("label"), F.lit(tier).alias("tier"))) for label, tier, c in rules)))
    held = low.withColumn("__sig", signals)
    labels = F.transform(F.array_distinct(F.transform("__sig", lambda x: x["label"])), lambda lab: F.struct(lab.alias("label"), F.size(F.filter("__sig", lambda x: (x["label"] == lab) & (x["tier"] == "B"))).alias("blocks"), F.size(F.filter("__sig", lambda x: (x["label"] == lab) & (x["tier"] == "C"))).alias("corroborating")))
    none = F.array(F.struct(F.when(F.col("__e") & (F.col("status").isNull() | (F.col("status") == 200)), "insufficient_evidence").otherwise("none").alias("label"), F.lit(0).alias("blocks"), F.lit(0).alias("corroborating")))
    out = held.withColumn("__l", F.when(F.size("__sig") > 0, labels).otherwise(none)).select(*responses.columns, F.explode_outer("__l").alias("__x"))  # never empty; after explode Spark would test for that first, by all rules once more for each use
    x = F.col("__x")
    confidence = F.when(x["label"].isin("none", "insufficient_evidence"), x["label"]).when(x["blocks"] > 0, "confirmed").when(x["label"] == "geo_blocked", "possible").when(x["corroborating"] >= 2, "probable").otherwise("possible")
    return out.select(*responses.columns, x["label"].alias("label"), confidence.alias("confidence"), x["blocks"].alias("blocks"), x["corroborating"].alias("corroborating"))


def wall_for(labels: DataFrame, key: str) -> DataFrame:
    """The wall of each response: its most severe confirmed label among the mapped ones."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("label"))
    wall = F.element_at(F.create_map(*(F.lit(x) for kv in WALLS.items() for x in kv)), F.col("label"))
    return labels.where((F.col("confidence") == "confirmed") & wall.isNotNull()).groupBy(key).agg(F.min_by(wall, rank).alias("wall"))


def has_amount(text: Column) -> Column:
    """A currency sign or code next to a digit."""
    return text.rlike(r"[$€£¥]\s?[0-9]|[0-9]\s?([$€£¥]|(USD|EUR|GBP)\b)|\b(USD|EUR|GBP)\s?[0-9]")


def pan_shape(value: Column) -> Column:
    """Shaped like a card number: 13 to 19 digits or mask signs among blanks and hyphens."""
    bare = F.regexp_replace(value, "[ -]", "")
    return F.length(value).between(13, 32) & bare.rlike(r"^[0-9*•xX]{13,19}$")


#: Letters of scripts that set no blanks between words.
UNSPACED = r"[\u1100-\u11ff\u3040-\u30ff\u3130-\u318f\u3400-\u4dbf\u4e00-\u9fff\ua960-\ua97f\uac00-\ud7ff\uf900-\ufaff]+"
#: An amount of money as pages print it.
AMOUNT = r"(?i)[$€£¥₩₹¢]\s?\d|\d\s?[€£¥₩₹¢]|\b(?:usd|eur|gbp|jpy|krw|cny|rmb|cad|aud|chf|inr|brl|mxn)\s?\d|\d\s?(?:usd|eur|gbp|jpy|krw|cny|rmb|cad|aud|chf|inr|brl|mxn)\b|\d\s?(?:원|円|元|€)"


def squashed(text: Column) -> Column:
    """Lower-case words between blanks, camel case parted, diacritics folded; of the first 400 characters."""
    parted = F.left(F.regexp_replace(F.coalesce(text, F.lit("")), r"(\p{Ll}|\p{N})(\p{Lu})", "$1 $2"), F.lit(400))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(folded(parted), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def first_term(hay: Column, terms: tuple[str, ...]) -> Column:
    """The first of ``terms`` in ``hay``: as words of their own, but anywhere for terms of unspaced scripts. Null without one."""
    alone = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(t if re.fullmatch(UNSPACED, t) else f" {t} ").alias("w")) for t in terms))
    return F.get(F.filter(alone, lambda x: F.contains(hay, x["w"])), F.lit(0))["t"]


def action_path(action: Column) -> Column:
    """The path of a form's action; the host, the query and the fragment say nothing."""
    bare = F.regexp_replace(F.coalesce(action, F.lit("")), r"[?#].*$", "")
    return F.when(F.contains(bare, F.lit("://")), F.regexp_extract(bare, r"://[^/]*(/.*)$", 1)).otherwise(bare)


def with_hays(census: DataFrame) -> DataFrame:
    """``census`` with the squashed submitter, path and checkbox labels, in one pass through Python."""
    return census.withColumns({"__submitter": squashed(F.col("submitter")), "__path": squashed(action_path(F.col("action"))), "__labels": squashed(F.col("checkbox_labels"))})


def is_search(name: Column) -> Column:
    """Whether a form of ``with_hays`` only searches: one field, by GET, nothing paid or secret, a search word in its path, its submitter or the field's ``name``."""
    word = F.coalesce(first_term(F.col("__path"), named.SEARCH), first_term(F.col("__submitter"), named.SEARCH), first_term(name, named.SEARCH)).isNotNull()
    return (F.upper(F.coalesce("method", F.lit("GET"))) == "GET") & F.coalesce(F.col("field_count") == 1, F.lit(False)) & ~F.coalesce("payment", F.lit(False)) & ~F.coalesce("secret", F.lit(False)) & word


def classify_submission(census: DataFrame) -> DataFrame:
    """``census`` with ``cls`` (``payment``, ``credential``, ``destructive``, ``legal``, ``broadcast`` or ``none``), ``reason`` and ``term`` of each form.

    The worst class that holds decides, in this order. ``census`` has
    ``submitter, action, checkbox_labels, method, field_count, payment, secret,
    textarea, recipient``. Payment: a field, the submitter's words, the path's
    words unless the form only searches, or a printed amount with a word that
    confirms. Words are compared whole in scripts with blanks and anywhere in
    those without, after case and diacritics are folded (NFKD).
    """
    f = with_hays(census)
    sub, path, labels = F.col("__submitter"), F.col("__path"), F.col("__labels")
    flag = lambda c: F.coalesce(c, F.lit(False))
    amount = F.coalesce(F.col("submitter").rlike(AMOUNT), F.lit(False))
    free = flag("textarea") | flag("recipient")
    found = lambda cls, reason, term: F.when(term.isNotNull(), F.struct(F.lit(cls).alias("cls"), F.lit(reason).alias("reason"), term.alias("term")))
    given = lambda cls, reason, test: F.when(test, F.struct(F.lit(cls).alias("cls"), F.lit(reason).alias("reason"), F.lit(None).cast("string").alias("term")))
    rules = (
        given("payment", "field", flag("payment")), found("payment", "words", first_term(sub, named.PAYMENT)),
        found("payment", "words", F.when(~is_search(F.lit("")), first_term(path, named.PAYMENT))),
        found("payment", "amount", F.when(amount, F.coalesce(first_term(sub, named.PAYMENT_CONFIRM), first_term(path, named.PAYMENT_PATHS)))),
        given("credential", "field", flag("secret")),
        found("destructive", "words", F.coalesce(first_term(sub, named.DESTRUCTIVE), first_term(path, named.DESTRUCTIVE))),
        found("legal", "checkbox", F.when(F.col("submitter").isNotNull(), first_term(labels, named.ASSENT_LABELS))), found("legal", "words", first_term(sub, named.ASSENT)),
        found("broadcast", "words", F.coalesce(first_term(sub, named.BROADCAST_STRONG), first_term(path, named.BROADCAST_STRONG))),
        given("broadcast", "recipient", flag("textarea") & flag("recipient")),
        found("broadcast", "send", F.when(free, F.coalesce(first_term(sub, named.BROADCAST_SEND), first_term(path, named.BROADCAST_SEND)))),
    )
    return f.withColumn("__c", F.coalesce(*rules)).withColumn("cls", F.coalesce("__c.cls", F.lit("none"))).withColumn("reason", F.col("__c.reason")).withColumn("term", F.col("__c.term")).drop("__c", "__submitter", "__path", "__labels")


def search_shaped(census: DataFrame) -> DataFrame:
    """``census`` with ``search_shaped``: forms that only search; ``field_name``, where the census has it, may say so too."""
    name = squashed(F.col("field_name")) if "field_name" in census.columns else F.lit("")
    f = with_hays(census).withColumn("__name", name)
    return f.withColumn("search_shaped", is_search(F.col("__name"))).drop("__submitter", "__path", "__labels", "__name")


def match_profile(urls: DataFrame, profiles: DataFrame) -> DataFrame:
    """The best profile of each ``url`` and up to five runners-up.

    ``profiles(slug, source, hosts, not_hosts, path_prefix)`` is a small rule
    table, broadcast. Exact hosts beat wildcards, longer path prefixes shorter
    ones, local beats community beats shipped, then the slug decides.
    """
    host, path = F.lower(U.part(F.col("url"), "HOST")), F.coalesce(U.part(F.col("url"), "PATH"), F.lit("/"))
    wild = lambda pattern: pattern.startswith("*.") & ((host == F.substr(pattern, F.lit(3))) | F.endswith(host, F.substr(pattern, F.lit(2))))
    hit = lambda patterns: F.exists(patterns, lambda x: (x == host) | wild(x))
    prefix = F.array_max(F.transform(F.filter("path_prefix", lambda x: F.startswith(path, x)), lambda x: F.length(x)))
    fine = hit(F.col("hosts")) & ~F.coalesce(hit(F.col("not_hosts")), F.lit(False)) & ((F.coalesce(F.size("path_prefix"), F.lit(0)) <= 0) | prefix.isNotNull())
    j = urls.select("url").distinct().join(few(profiles), fine)
    score = F.struct(F.when(F.array_contains("hosts", host), 0).otherwise(1).alias("wild"), (-F.coalesce(prefix, F.lit(-1))).alias("short"), F.when(F.col("source") == "local", 0).when(F.col("source") == "community", 1).otherwise(2).alias("rank"), "slug")
    ranked = j.withColumn("n", F.row_number().over(W.partitionBy("url").orderBy(score)))
    return ranked.groupBy("url").agg(F.max(F.when(F.col("n") == 1, F.col("slug"))).alias("profile"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("n").between(2, 6), F.struct("n", "slug"))))["slug"], ",").alias("runners_up"))


def access_note(responses: DataFrame, access: DataFrame) -> DataFrame:
    """The first access entry of each response's profile whose every stated condition holds; advisory.

    ``access(slug, pos, note, status, text, meta_present, meta_absent)`` is a
    small broadcast table; a null condition is not stated. ``responses`` needs
    ``url, profile, status, body, metas`` (array of meta names).
    """
    said = lambda c, test: F.col(c).isNull() | F.coalesce(test, F.lit(False))
    rules = access.select("slug", "pos", "note", F.col("status").alias("want_status"), "text", "meta_present", "meta_absent")
    holds = said("want_status", F.col("status") == F.col("want_status")) & said("text", F.contains(F.lower("body"), F.lower("text"))) & said("meta_present", F.array_contains("metas", F.col("meta_present"))) & said("meta_absent", ~F.array_contains("metas", F.col("meta_absent")))
    hit = responses.join(few(rules), responses["profile"] == rules["slug"]).where(holds).groupBy("url").agg(F.min_by("note", "pos").alias("note"))
    return responses.select("url", "profile").join(hit, "url", "left")
