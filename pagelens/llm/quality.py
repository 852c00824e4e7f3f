"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import bounded_batches, cut
from pagelens.llm.wordhash import mix, words

#: Weights of the model, labelled rows it is fitted on at most, shards and passes of the training.
BUCKETS, TRAIN_ROWS, SHARDS, PASSES = 1 << 18, 20_000, 8, 4
#: FTRL's learning rate, smoothing, L1 and L2.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1e-4, 1e-4


def features(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Bucket ids and values of each whole text, ids ascending.

    Words are runs without white space. Their hashes give word unigrams and
    bigrams; their shapes (case, digits, last character, length class, equal to
    the word before) give unigrams, bigrams and trigrams. Each kind's values
    sum to 1, so long and short texts have the same scale. A text without words
    has the bias alone.
    """
    w = words([(t or "").encode() for t in texts])
    b = w.data
    first, last = b[w.start].astype(np.uint64), b[w.end - 1].astype(np.uint64)
    length = w.end - w.start
    upper = np.cumsum(np.r_[0, (b >= 65) & (b <= 90)])
    digit = np.cumsum(np.r_[0, (b >= 48) & (b <= 57)])
    other = np.cumsum(np.r_[0, (b < 128) & ~(((b | 32) >= 97) & ((b | 32) <= 122)) & ~((b >= 48) & (b <= 57))])
    count = lambda c: c[w.end] - c[w.start]
    same = np.r_[False, (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])] if len(w.hash) else np.empty(0, bool)
    letter = ((last | np.uint64(32)) >= 97) & ((last | np.uint64(32)) <= 122) | (last >= 128)
    shape = np.where(letter, np.uint64(1), last + np.uint64(2))
    for k, flag in enumerate((count(upper) > 1, count(digit) > 0, same, (first >= 65) & (first <= 90), count(other) > 1)):
        shape = shape | (flag.astype(np.uint64) << np.uint64(10 + k))
    shape = mix(shape | (np.minimum(length // 4, 15).astype(np.uint64) << np.uint64(20)))
    kinds = []
    for salt, (h, n) in enumerate(((w.hash, 1), (w.hash, 2), (shape, 1), (shape, 2), (shape, 3))):
        g, ok = h.copy(), np.ones(len(h), bool)
        for k in range(1, n):
            g[:-k] = mix(g[:-k] + h[k:] * np.uint64(2 * k + 1)) if len(g) > k else g[:-k]
            ok[-k:] = False
            ok[:-k] &= w.doc[k:] == w.doc[:-k]
        kinds.append((((mix(g + np.uint64(salt)) >> np.uint64(40)) % np.uint64(BUCKETS - 1) + np.uint64(1)).astype(np.int64), ok))
    edge = np.searchsorted(w.doc, np.arange(len(texts) + 1))
    out = []
    for d in range(len(texts)):
        ids, values = [np.zeros(1, np.int64)], [np.ones(1)]
        for g, ok in kinds:
            own = g[edge[d] : edge[d + 1]][ok[edge[d] : edge[d + 1]]]
            if len(own):
                u, n = np.unique(own, return_counts=True)
                ids.append(u)
                values.append(n / len(own))
        u, inverse = np.unique(np.concatenate(ids), return_inverse=True)
        out.append((u, np.bincount(inverse, np.concatenate(values))))
    return out


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def fit_quality_model(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights of ``BUCKETS`` buckets, by follow-the-regularised-leader updates.

    At most about ``train_rows`` labelled rows are used, chosen by a hash of the
    key (the documented bound, which also bounds the broadcast join with the
    texts). They are dealt to ``SHARDS`` shards; in each of ``PASSES`` passes
    every shard updates a copy of the state row by row and the states are
    averaged, weighted by rows. The driver gets at most one row per bucket.
    Rows with a null key or label teach nothing; no rows give zero weights.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("double").alias("y")).where("key is not null and y is not null")
    total = known.count()
    if total > train_rows:
        known = known.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int((1 << 20) * train_rows / total))
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(known), "key").withColumn("h", F.xxhash64("key", "text"))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 64):
                part = pdf.iloc[at : at + 64]
                f = features(list(part["text"]))
                yield pd.DataFrame({"y": part["y"].to_numpy(), "h": part["h"].to_numpy(), "ids": [x.astype("<i4").tobytes() for x, _ in f], "x": [x.astype("<f4").tobytes() for _, x in f]})

    table = cut(rows.select("text", "y", "h").mapInPandas(extract, "y double, h long, ids binary, x binary").repartition(SHARDS, F.pmod("h", F.lit(SHARDS))))
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for _ in range(PASSES):
        state = spark.sparkContext.broadcast((z, n))

        def train(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            z, n = (a.copy() for a in state.value)  # noqa: B023
            count = 0
            for pdf in groups:
                pdf = pdf.sort_values("h", kind="stable")
                for y, ids, x in zip(pdf["y"], pdf["ids"], pdf["x"]):
                    i, v = np.frombuffer(ids, "<i4"), np.frombuffer(x, "<f4").astype(np.float64)
                    w = weights(z[i], n[i])
                    g = (1 / (1 + np.exp(-np.clip(w @ v, -35, 35))) - y) * v
                    z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
                    n[i] += g * g
                    count += 1
            at = np.flatnonzero(n)
            if count:
                yield pd.DataFrame({"at": at.astype(np.int32), "z": z[at] * count, "n": n[at] * count, "rows": count})

        found = table.mapInPandas(train, "at int, z double, n double, rows long").groupBy("at").agg(F.sum("z").alias("z"), F.sum("n").alias("n"), F.sum("rows").alias("rows")).toPandas()
        z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
        z[found["at"]], n[found["at"]] = found["z"] / found["rows"], found["n"] / found["rows"]
    return weights(z, n)


def score_quality(df: DataFrame, model: np.ndarray, text: str = "text", out: str = "score") -> DataFrame:
    """Add the probability of label 1 for each whole text, a sparse dot product.

    Null and empty texts score by the bias. A column named ``out`` is replaced.
    """
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model.astype(np.float32))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = shared.value.astype(np.float64)
        for texts in batches:
            out: list[float] = []
            for at in range(0, len(texts), 64):
                out += [1 / (1 + np.exp(-np.clip(w[i] @ v, -35, 35))) for i, v in features(list(texts.iloc[at : at + 64]))]
            yield pd.Series(out, dtype=float)

    return df.withColumn(out, score(F.col(text)))
