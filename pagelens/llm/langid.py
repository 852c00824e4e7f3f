"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import bounded_batches, unused

#: Buckets of the hash and the longest n-gram.
BUCKETS, LONGEST = 1 << 16, 3
#: The model is fitted on about this many labelled rows at most, chosen by hash.
TRAIN_ROWS = 20_000
#: The matrix of log-probabilities is broadcast, so the languages are counted first.
MAX_LANGUAGES = 500
#: Characters hashed at a time.
BLOCK_CHARS = 1 << 18


def grams(text: str) -> np.ndarray:
    """Bucket of every n-gram of 1 to ``LONGEST`` characters."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
    out, h = [], np.zeros(len(c), np.uint64)
    for n in range(LONGEST):
        if len(c) <= n:
            break
        h = (h[: len(c) - n] * np.uint64(0x9E3779B97F4A7C15) + c[n:] + np.uint64(n + 1)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        out.append((h & np.uint64(BUCKETS - 1)).astype(np.int32))
    return np.concatenate(out) if out else np.empty(0, np.int32)


def blocks(text: str) -> Iterator[np.ndarray]:
    """Grams of a whole text, lower-cased; blocks overlap so that no gram is lost or doubled."""
    text = text.lower()
    for at in range(0, max(1, len(text)), BLOCK_CHARS):
        g = grams(more := text[at : at + BLOCK_CHARS + LONGEST - 1])
        if at + BLOCK_CHARS < len(text):  # grams that begin in the overlap belong to the next block
            ends = np.cumsum([0] + [max(0, len(more) - n) for n in range(LONGEST)])
            g = np.concatenate([g[ends[n] : ends[n] + min(BLOCK_CHARS, ends[n + 1] - ends[n])] for n in range(LONGEST)])
        yield g


def fit_language_model(labelled: DataFrame, text: str = "text", lang: str = "lang", train_rows: int = TRAIN_ROWS) -> dict:
    """Log-probabilities of each bucket for each language.

    At most about ``train_rows`` labelled rows are used, those whose hashed text
    falls below a threshold (the one documented bound; scoring covers all rows).
    Rows with a null text or label teach nothing. Counts are summed by Spark;
    the driver gets one row per language and bucket seen, and no more than
    ``MAX_LANGUAGES`` languages. No rows give a model without languages.
    """
    spark = labelled.sparkSession
    bounded_batches(spark)
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    total = rows.count()
    langs = sorted(r[0] for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    if total > train_rows:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int((1 << 20) * train_rows / total))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for pdf in batches:
            for t, lng in zip(pdf["text"], pdf["lang"]):
                c = seen.setdefault(lng, np.zeros(BUCKETS, np.int64))
                docs[lng] = docs.get(lng, 0) + 1
                for g in blocks(t):
                    c += np.bincount(g, minlength=BUCKETS)
        for lng, c in seen.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"lang": lng, "bucket": np.r_[at, -1].astype(np.int32), "n": np.r_[c[at], docs[lng]]})

    sums = rows.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    matrix = np.full((BUCKETS, len(langs)), 0.5)
    prior = np.full(len(langs), 1.0)
    for k, lng in enumerate(langs):
        own = sums[sums["lang"] == lng]
        real = own["bucket"] >= 0
        matrix[own.loc[real, "bucket"], k] += own.loc[real, "n"]
        prior[k] += own.loc[~real, "n"].sum()
    return {"langs": langs, "logp": np.log(matrix / matrix.sum(axis=0)).astype(np.float32), "prior": np.log(prior / prior.sum())}


def predict_language(df: DataFrame, model: dict, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """Add the likeliest language and its posterior probability for each whole text.

    The posterior is of the mean log-probability of an n-gram, scaled to
    at most 200 n-grams, so a long text does not always score exactly 1.
    ``und`` with score 0 where the text is null or has no letter, or where the
    model knows no language. Existing columns of the output names are replaced.
    """
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            names, scores = [], []
            for t in texts:
                if not t or not m["langs"] or not any(map(str.isalpha, t)):
                    names.append("und")
                    scores.append(0.0)
                    continue
                total, n = np.zeros(len(m["langs"])), 0
                for g in blocks(t):
                    at, times = np.unique(g, return_counts=True)  # the text's sparse row
                    total += times @ m["logp"][at]
                    n += len(g)
                z = m["prior"] + total * min(1.0, 200 / n)
                p = np.exp(z - z.max())
                best = int(p.argmax())
                names.append(m["langs"][best])
                scores.append(float(p[best] / p.sum()))
            yield pd.DataFrame({"lang": names, "score": scores})

    keep = [c for c in df.columns if c.lower() not in (lang_out.lower(), score_out.lower())]
    made = unused("judged", df)
    return df.select(*(f"`{c}`" for c in keep), predict(F.col(text)).alias(made)).select(*(f"`{c}`" for c in keep), F.col(f"{made}.lang").alias(lang_out), F.col(f"{made}.score").alias(score_out))
