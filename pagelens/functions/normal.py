"""Unicode normal forms, for which Spark has no function; batches of strings in Arrow."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_form(text: Column, form: str) -> Column:
    """``text`` in one of NFC, NFD, NFKC and NFKD; null stays null."""
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"{form} is no normal form")

    @F.pandas_udf("string")
    def turn(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize(form, t))

    return turn(text)


def folded(text: Column) -> Column:
    """Lower case without diacritics and compatibility forms (full width, ligatures); Hangul syllables and kana with their marks stay whole."""

    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None or t.isascii():
                return t and t.lower()
            bare = "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if unicodedata.category(c) != "Mn" or c in "゙゚")
            return unicodedata.normalize("NFC", bare)

        return texts.map(one)

    return fold(text)
