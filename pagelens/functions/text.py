"""Shared scalar expressions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English words that say nothing about a field.
STOP_WORDS = tuple("a an and are as at be by for from in is it its my of on or our that the their these this those to was were with your".split())
ZERO_WIDTH = "[​‌‍⁠﻿]"
MARK = "page-data"


def squash(text: Column) -> Column:
    """White space runs to one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def clip(text: Column, n: int) -> Column:
    """Squashed and cut to ``n`` characters, with dots where something was cut."""
    s = squash(text)
    return F.when(F.length(s) > n, F.concat(F.left(s, F.lit(n)), F.lit("..."))).otherwise(s)


def clip_words(text: Column, n: int) -> Column:
    """As ``clip``, but cut at the last blank if that keeps over 60% of ``n``."""
    s = squash(text)
    head = F.left(s, F.lit(n))
    tidy = F.regexp_replace(head, r" [^ ]*$", "")
    cut = F.when(F.length(tidy) > 0.6 * n, tidy).otherwise(head)
    return F.when(F.length(s) > n, F.concat(cut, F.lit("..."))).otherwise(s)


def norm_key(text: Column) -> Column:
    """Lower-case letters and digits alone."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def words(text: Column) -> Column:
    """Lower-case words; a change from lower to upper case also parts them."""
    parted = F.regexp_replace(text, r"(\p{Ll}|\p{N})(\p{Lu})", "$1 $2")
    return F.filter(F.split(F.lower(parted), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def content_words(text: Column) -> Column:
    return F.array_except(words(text), F.array(*map(F.lit, STOP_WORDS)))


def wrap_untrusted(text: Column, url: Column, nonce: Column | None = None) -> Column:
    """Page text between two lines that carry a nonce the text cannot know."""
    nonce = F.substring(F.sha2(F.uuid().cast("binary"), 256), 1, 16) if nonce is None else nonce
    return F.concat(F.lit(f"<<{MARK} "), nonce, F.lit(" "), F.coalesce(url, F.lit("-")), F.lit(">>\n"), F.coalesce(text, F.lit("")), F.lit("\n<</"), F.lit(f"{MARK} "), nonce, F.lit(">>"))


def unwrap_untrusted(wrapped: Column) -> Column:
    """The text that ``wrap_untrusted`` got; null where the two nonces differ or a line is missing."""
    pattern = rf"(?s)^<<{MARK} ([0-9a-f]+) [^\n]*>>\n(.*)\n<</{MARK} \1>>$"
    return F.when(wrapped.rlike(pattern), F.regexp_extract(wrapped, pattern, 2))


def sanitize(text: Column) -> Column:
    """Invalid UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(text)


def visual_tokens(width: Column, height: Column) -> Column:
    """Tiles of 28 by 28 pixels."""
    return F.ceil(width / 28) * F.ceil(height / 28)


def fingerprint(payload: Column) -> Column:
    return F.left(F.sha1(payload), F.lit(12))


def human_span(seconds: Column) -> Column:
    """Seconds up to 90, minutes up to 90, hours up to 36, then days."""
    return (
        F.when(seconds < 90, F.concat(F.round(seconds).cast("long").cast("string"), F.lit(" s")))
        .when(seconds < 90 * 60, F.concat(F.round(seconds / 60).cast("long").cast("string"), F.lit(" min")))
        .when(seconds < 36 * 3600, F.concat(F.round(seconds / 3600).cast("long").cast("string"), F.lit(" h")))
        .otherwise(F.concat(F.round(seconds / 86400).cast("long").cast("string"), F.lit(" days")))
    )


def token_cost(text: Column, chars_per_token: float = 3.7) -> Column:
    """Tokens a text is priced at, from its length."""
    return F.ceil(F.length(text) / F.lit(chars_per_token)).cast("long")
