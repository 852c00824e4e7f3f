"""Personal data by regular expressions, checksums and context, in DataFrame functions alone.

Patterns are possessive and start only where a longer match cannot have begun,
so a pathological text costs linear time; they find the same leftmost,
non-overlapping matches as the plain patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The contract's kinds in order, as possessive patterns.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}){2,7}+(?:\x20[A-Z0-9]{1,3}+)?)(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
#: What a text must hold for a kind to be searched at all; each follows from the pattern.
HINT = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}"}
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "iban": IBAN, "ssn": SSN}
BASE = ("email", "ip", "card", "phone")
#: Score before context, words that raise it, and how far before the span they count (characters, back to the second match before).
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4}
CONTEXT = {"email": "mail|contact|kontakt|correo", "ip": r"\bip\b|address|host|server", "card": "card|visa|credit|karte|tarjeta|carte", "phone": "phone|call|tel|mobile|fax", "iban": "iban|bank|konto|account", "ssn": "ssn|social|security"}
CONTEXT_CHARS, CONTEXT_GAIN = 48, 0.1
#: Values of an array that are gone through at a time.
PART = 256
#: An added kind stays only at this score.
LEAST_SCORE = 0.5


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def mod97(iban: Column) -> Column:
    """Remainder by 97 of the rearranged account number."""
    plain = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    code = lambda ch: F.when(ch.between("0", "9"), ch.cast("long")).otherwise(F.ascii(ch).cast("long") - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0).cast("long"), lambda acc, ch: F.when(ch == "", acc).otherwise(F.when(code(ch) > 9, acc * 100 + code(ch)).otherwise(acc * 10 + code(ch)) % 97))


def valid(kind: str, s: Column) -> Column:
    """Whether a match of ``kind`` passes its checks; a match that fails is dropped, not retried."""
    n = F.length(digits(s))
    if kind == "ip":
        part = r"0*+(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9]|)"
        return s.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return n.between(16, 19) & F.call_function("luhn_check", digits(s))
    if kind == "phone":
        return n.between(8, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(s, " ", "")).between(15, 34) & (mod97(s) == 1)
    if kind == "ssn":
        return ~s.rlike("^(?:000|666|9..)|-00-|-0000$")
    return F.lit(True)


def once(value: Column, use) -> Column:
    """``use`` of a value that is computed a single time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, join, kind: str) -> Column:
    """For each place what ``join`` makes of 0 and all values before it, as an array.

    An array that grows by one at a time is copied each time, so parts of
    ``PART`` values are gone through alone and then shifted by what stands
    before them.
    """
    none = F.array().cast(f"array<{kind}>")
    start = F.struct(F.lit(0).cast(kind).alias("at"), none.alias("all"))
    step = lambda acc, v: F.struct(join(acc["at"], v).cast(kind).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all"))
    cut = lambda vs: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(vs) / PART).cast("int") - 1, F.lit(0))), lambda k: F.slice(vs, k * PART + 1, F.lit(PART)))
    inside = lambda parts: F.transform(parts, lambda part: F.aggregate(part, start, step))
    before = lambda done: F.aggregate(done, start, lambda acc, x: step(acc, x["at"]), lambda acc: acc["all"])
    shifted = lambda done: F.flatten(F.zip_with(done, before(done), lambda x, o: F.transform(x["all"], lambda v: join(o, v).cast(kind))))
    return once(values, lambda vs: F.when(F.size(vs) == 0, none).otherwise(once(inside(cut(vs)), shifted)))


def spans_of(kind: str, text: Column) -> Column:
    """``array<struct<kind,start,end,score>>`` of one kind, in code points, end exclusive."""
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    gaps = F.split(text, PATTERNS[kind], -1)  # one more than matches: gap, match, gap, ...
    last = lambda s: F.substring(s, -CONTEXT_CHARS, CONTEXT_CHARS)
    pairs = once(found, lambda ms: F.zip_with(ms, F.slice(gaps, F.lit(1), F.size(ms)), lambda m, g: F.struct(m.alias("m"), F.length(m).alias("n"), F.length(g).alias("g"), last(g).alias("t"))))

    def scored(x: Column, at: Column, i: Column, all_pairs: Column) -> Column:
        back = lambda k: F.get(all_pairs, i - k)
        said = F.concat_ws("", back(2)["t"], back(2)["m"], back(1)["t"], back(1)["m"], x["t"])
        score = F.least(F.lit(1.0), F.lit(PRIOR[kind]) + F.when(F.lower(last(said)).rlike(CONTEXT[kind]), CONTEXT_GAIN).otherwise(0.0))
        start = at + x["g"]
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + x["n"]).alias("end"), score.alias("score"))

    def spans(ps: Column) -> Column:
        begun = running(F.transform(ps, lambda x: x["g"] + x["n"]), lambda a, b: a + b, "int")
        both = F.zip_with(ps, begun, lambda x, at: F.struct(x.alias("x"), at.alias("at")))
        return F.filter(F.transform(both, lambda y, i: F.when(valid(kind, y["x"]["m"]), scored(y["x"], y["at"], i, ps))), lambda s: s.isNotNull())

    out = once(pairs, spans)
    if kind not in BASE:
        out = F.filter(out, lambda x: x["score"] >= LEAST_SCORE)
    return F.when(text.rlike(HINT[kind]), out).otherwise(empty)


def find_pii(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Add ``out``: all spans of each whole text by kind, then start.

    Null texts count as empty and give an empty array. The four base kinds are
    kept whatever their score; ``iban`` (mod-97) and ``ssn`` (context) are added
    at a score of ``LEAST_SCORE`` or more. Spans of different kinds may overlap.
    A column named ``out`` is replaced. A narrow map: nothing is shuffled.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    return df.withColumn(out, F.concat(*(spans_of(k, t) for k in PATTERNS)))


def redact_pii(df: DataFrame, text: str = "text", spans: str = "pii", out: str = "redacted") -> DataFrame:
    """Add ``out``: the text with each span replaced by its kind in brackets; overlapping spans merge into the first.

    Null texts count as empty, null spans as none. A column named ``out`` is
    replaced, all others stay.
    """
    units = F.encode(F.coalesce(F.col(f"`{text}`"), F.lit("")), "UTF-32")  # four bytes a code point, so any part is reached at once
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    ordered = F.array_sort(F.transform(F.coalesce(F.col(f"`{spans}`"), F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    part = lambda u, a, b: F.decode(F.substring(u, a * 4 + 1, (b - a) * 4), "UTF-32")

    def pieces(u: Column, all_spans: Column) -> Column:
        ends = running(F.transform(all_spans, lambda x: x["end"]), F.greatest, "int")
        each = F.zip_with(all_spans, ends, lambda x, e: F.when(x["start"] >= e, F.concat(part(u, e, x["start"]), F.lit("["), x["kind"], F.lit("]"))))
        rest = F.coalesce(F.array_max(F.transform(all_spans, lambda x: x["end"])), F.lit(0))
        return F.concat(F.array_join(each, ""), part(u, rest, (F.octet_length(u) / 4).cast("int")))

    return df.withColumn(out, once(units, lambda u: once(F.coalesce(ordered, none), lambda s: pieces(u, s))))
