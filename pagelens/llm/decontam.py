"""Benchmark decontamination by latent semantic retrieval and longest common subsequences."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import bounded_batches
from pagelens.llm.ngram_join import slices
from pagelens.llm.wordhash import Words, words


@dataclass(frozen=True)
class LeakParams:
    """``block``: words of half a passage. ``buckets``: of the counts of words.
    ``common``: a word's weight is its inverse document frequency less this, at
    least ``floor``. ``rank``: latent dimensions, which is also how many item
    passages are searched at a time, so that the factors can tell them apart.
    ``item_weight``: least weight of an item's passage among those the factors
    are fitted on; ``item_energy``: least energy of all of them, as a multiple of the texts'.
    ``cosine``: least latent similarity of a candidate. ``bag``: least share of
    an item passage's words that a candidate holds. ``verbatim``: share of an
    item's words in common order that is a leak by itself; ``paraphrase``: the
    share that is one if the item's last sentence is found to ``answer``.
    ``item_bytes``: largest benchmark broadcast. ``square``: most words of a
    block whose pairs are counted; ``cells``: pairs counted in one pass."""

    block: int = 16
    buckets: int = 1 << 17
    common: float = 2.0
    floor: float = 0.05
    rank: int = 256
    oversample: int = 8
    item_weight: float = 30.0
    item_energy: float = 10.0
    cosine: float = 0.4
    bag: float = 0.5
    verbatim: float = 0.75
    paraphrase: float = 0.55
    answer: float = 0.8
    item_bytes: int = 32 << 20
    square: int = 4096
    cells: int = 1 << 24


def tokens(texts: list[str | None]) -> Words:
    """Words lower-cased, cut at every ASCII character that is no letter or digit."""
    return words([(t or "").lower().encode() for t in texts], fold=False, plain=True)


def bucket(h: np.ndarray, p: LeakParams) -> np.ndarray:
    return (h >> np.uint64(20)).astype(np.int64) & (p.buckets - 1)


def half_passages(w: Words, n_texts: int, p: LeakParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of blocks of ``block`` words that never cross a text; each block's text; whether another block of the text follows."""
    edge = np.searchsorted(w.doc, np.arange(n_texts + 1))
    size = np.diff(edge)
    n = -(-size // p.block)
    doc = np.repeat(np.arange(n_texts), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    start = edge[doc] + k * p.block
    return start, doc, np.r_[doc[1:] == doc[:-1], False] if len(doc) else np.empty(0, bool)


def passages(values: np.ndarray, start: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Sums over each block and the one after it in its text."""
    s = np.add.reduceat(values, start, axis=0)
    s[:-1][follows[:-1]] += np.add.reduceat(values, start, axis=0)[1:][follows[:-1]]
    return s


def document_frequencies(docs: DataFrame, p: LeakParams) -> tuple[np.ndarray, int]:
    """How many texts hold each bucket, over all texts: at most ``buckets`` rows reach the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(p.buckets, np.int64), 0
        for pdf in batches:
            for part in slices(pdf):
                w = tokens(list(part["text"]))
                total += np.bincount(np.unique(w.doc * p.buckets + bucket(w.hash, p)) % p.buckets, minlength=p.buckets)
                n += len(part)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": np.r_[at, -1].astype(np.int32), "n": np.r_[total[at], n]})

    got = docs.select("text").mapInPandas(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out, real = np.zeros(p.buckets), got["at"] >= 0
    out[got.loc[real, "at"]] = got.loc[real, "n"]
    return out, int(got.loc[~real, "n"].sum())


def product(texts: list[str | None], m: np.ndarray, known: np.ndarray, weight: np.ndarray, p: LeakParams) -> np.ndarray:
    """``A'(A m)`` of the texts' passages, rows of length 1, columns the words of ``known``."""
    w = tokens(texts)
    out = np.zeros((len(known), m.shape[1]))
    if not len(w.hash):
        return out
    at = np.minimum(np.searchsorted(known, w.hash), len(known) - 1)
    inside = np.flatnonzero(known[at] == w.hash)
    value = weight[bucket(w.hash, p)].astype(np.float32)
    start, _, follows = half_passages(w, len(texts), p)
    scale = 1 / np.maximum(passages(value**2, start, follows), 1e-9)
    block = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(w.hash)]))[inside]
    at, value = at[inside], value[inside, None]
    if not len(at):
        return out
    y = np.zeros((len(start), m.shape[1]), np.float32)
    u, first = np.unique(block, return_index=True)
    y[u] = np.add.reduceat(m.astype(np.float32)[at] * value, first, axis=0)
    y[:-1][follows[:-1]] += y[1:][follows[:-1]].copy()
    y *= scale[:, None]
    y[1:][follows[:-1]] += y[:-1][follows[:-1]].copy()  # a block lies in its own passage and in the one before
    order = np.argsort(at, kind="stable")
    u, first = np.unique(at[order], return_index=True)
    out[u] = np.add.reduceat(y[block[order]] * value[order], first, axis=0)
    return out


class Lookup:
    """Places of words in several sorted lists of them, with one search for all lists."""

    def __init__(self, known: list[np.ndarray]):
        self.every = np.unique(np.concatenate(known))
        self.place = []
        for k in known:
            self.place.append(np.full(len(self.every) + 1, -1, np.int32))
            self.place[-1][np.searchsorted(self.every, k)] = np.arange(len(k))

    def found(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.every, h), len(self.every) - 1)
        return np.where(self.every[at] == h, at, len(self.every))


def add_pairs(total: np.ndarray, at: np.ndarray, value: np.ndarray, block: np.ndarray, follows: np.ndarray, scale: np.ndarray) -> None:
    """Add half of ``A'A`` of the texts' passages to ``total``: each two known words that share a passage once, in either order.

    ``at`` is each word's place among the known ones, negative for others, and ``block`` its block.
    Two words of a block share its own passage and the one before; words of
    blocks that follow each other share the first one's. Pairs are taken by
    their distance among the known words, so that no passage is laid out.
    """
    inside = np.flatnonzero(at >= 0)
    if not len(inside):
        return
    at, value, block = at[inside].astype(np.int64), value[inside].astype(total.dtype), block[inside]  # one type: numpy adds mixed ones slowly
    next_to = np.where(follows, scale, 0)
    own = scale.copy()
    own[1:] += next_to[:-1]
    cells = total.reshape(-1)
    np.add.at(cells, at * (len(total) + 1), value * value * own[block] / 2)
    own, next_to, left = own[block] * value, next_to[block] * value, at * len(total)
    k = np.arange(len(at) - 1)
    for d in range(1, len(at)):
        k = k[: np.searchsorted(k, len(at) - d)]
        step = block[k + d] - block[k]
        k, step = k[step <= 1], step[step <= 1]  # words further on are no nearer
        if not len(k):
            return
        np.add.at(cells, left[k] + at[k + d], np.where(step == 0, own[k], next_to[k]) * value[k + d])


def co_occurrences(docs: DataFrame, known: list[np.ndarray], weight: np.ndarray, p: LeakParams) -> list[np.ndarray]:
    """``A'A`` of all texts' passages for each of several sets of words, in one pass over the texts.

    Rows of words that a task has met leave it, from the diagonal on; no passages do.
    """
    sizes, shared = [len(k) for k in known], docs.sparkSession.sparkContext.broadcast((Lookup(known), weight.astype(np.float32)))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lookup, weight = shared.value
        totals = [np.zeros((n, n)) for n in sizes]
        for pdf in batches:
            for rows in slices(pdf, 1 << 18):
                w = tokens(list(rows["text"]))
                if len(w.hash):
                    value = weight[bucket(w.hash, p)]
                    start, _, follows = half_passages(w, len(rows), p)
                    scale = 1 / np.maximum(passages(value**2, start, follows), 1e-9)
                    block = np.repeat(np.arange(len(start), dtype=np.int32), np.diff(np.r_[start, len(w.hash)]))
                    found = lookup.found(w.hash)
                    for total, place in zip(totals, lookup.place):
                        add_pairs(total, place[found], value, block, follows, scale)
        for b, total in enumerate(totals):
            for k in range(0, len(total), 256):
                rows = np.stack([total[k + i] + total[:, k + i] for i in range(min(256, len(total) - k))])
                met = [i for i in range(len(rows)) if rows[i].any()]
                yield pd.DataFrame({"block": np.full(len(met), b, np.int32), "word": np.array([k + i for i in met], np.int32), "row": [rows[i, k + i :].astype("<f4").tobytes() for i in met]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(pdf["row"].iloc[0]) // 4)
        for x in pdf["row"]:
            total += np.frombuffer(x, "<f4")
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "word": pdf["word"].iloc[:1], "row": [total.astype("<f4").tobytes()]})

    kind = "block int, word int, row binary"
    cells = docs.where("text is not null").mapInPandas(part, kind).groupBy("block", "word").applyInPandas(add, kind).toPandas()
    out = [np.zeros((len(k), len(k)), np.float32) for k in known]
    for b, word, row in zip(cells["block"], cells["word"], cells["row"]):
        out[b][word, word:] = out[b][word:, word] = np.frombuffer(row, "<f4")
    return out


def corpus_products(docs: DataFrame, m: np.ndarray, known: np.ndarray, weight: np.ndarray, p: LeakParams) -> np.ndarray:
    """``A'(A m)`` of all texts' passages, by a pass over the texts: for more words than a square of them may have."""
    shared = docs.sparkSession.sparkContext.broadcast((m, known, weight))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, known, weight = shared.value
        total = np.zeros(m.shape)
        for pdf in batches:
            for rows in slices(pdf, 1 << 18):
                total += product(list(rows["text"]), m, known, weight, p)
        at = np.flatnonzero(total.any(axis=1))
        for k in range(0, len(at), 1024):
            yield pd.DataFrame({"word": at[k : k + 1024].astype(np.int32), "row": [x.astype("<f4").tobytes() for x in total[at[k : k + 1024]]]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"word": pdf["word"].iloc[:1], "row": [np.sum([np.frombuffer(x, "<f4") for x in pdf["row"]], axis=0, dtype=np.float64).tobytes()]})

    cells = docs.where("text is not null").mapInPandas(part, "word int, row binary").groupBy("word").applyInPandas(add, "word int, row binary").toPandas()
    out = np.zeros(m.shape)
    if len(cells):
        out[cells["word"]] = np.stack([np.frombuffer(x) for x in cells["row"]])
    return out


def fit_factors(docs: DataFrame, items: list[str], known: np.ndarray, weight: np.ndarray, gram: np.ndarray | None, p: LeakParams) -> np.ndarray:
    """Right singular vectors of the passages' weighted TF-IDF matrix over the items' words, by the randomised method.

    ``gram`` is ``A'A`` over all texts; without one, Spark sums ``A'(A W)`` once
    for the range and once for the small matrix. The items' own passages are
    added with a weight that follows the texts': with a fixed one a growing
    corpus would take the factors for itself, and items would be lost.
    """
    width = min(len(known), p.rank + p.oversample)
    corpus = lambda m: corpus_products(docs, m, known, weight, p) if gram is None else gram @ m
    own = lambda m: product(items, m, known, weight, p)
    m = np.random.default_rng(11).standard_normal((len(known), width))
    c, o = corpus(m), own(m)
    k = max(p.item_weight**2, p.item_energy * (m * c).sum() / max((m * o).sum(), 1e-9))  # the ratio of the traces, by Hutchinson's estimate
    q, _ = np.linalg.qr(c + k * o)
    small = q.T @ (corpus(q) + k * own(q))
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return (q @ vectors[:, np.argsort(-values)[: p.rank]]).astype(np.float32)


def common_subsequence(item: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over the item's words."""
    where: dict[int, int] = {}
    for k, x in enumerate(item.tolist()):
        where[x] = where.get(x, 0) | 1 << k
    full = (1 << len(item)) - 1
    v = full
    for x in text.tolist():
        m = where.get(x, 0)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


class Items:
    """The items' words, passages, bags and last sentences."""

    def __init__(self, ids: list[int], texts: list[str], p: LeakParams):
        w = tokens(texts)
        edge = np.searchsorted(w.doc, np.arange(len(texts) + 1))
        self.ids = ids
        self.words = [w.hash[a:b] for a, b in zip(edge[:-1], edge[1:])]
        last = [re.split(r"[.!?]+\s+", t.strip())[-1] for t in texts]
        a = tokens(last)
        ends = np.searchsorted(a.doc, np.arange(len(texts) + 1))
        self.answers = [a.hash[x:y] for x, y in zip(ends[:-1], ends[1:])]
        self.known = np.unique(w.hash)
        self.start, self.doc, self.follows = half_passages(w, len(texts), p)
        self.hash = w.hash
        stop = np.r_[self.start[1:], len(w.hash)]
        stop = np.where(self.follows, np.r_[stop[1:], len(w.hash)], stop)
        self.bags = np.zeros((len(self.known) + 1, len(self.start)), np.uint8)  # the last row is for other words
        for k, (x, y) in enumerate(zip(self.start, stop)):
            self.bags[np.searchsorted(self.known, w.hash[x:y]), k] = 1
        self.least = np.ceil(p.bag * np.maximum(1, self.bags.sum(axis=0))).astype(np.uint8)


def normed(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


def add_leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", out: str = "leaks", params: LeakParams = LeakParams()) -> DataFrame:
    """Add ``out``: ``array<struct<item_id, share, start, stop>>``, the items found in each whole text.

    A text leaks an item when at least ``verbatim`` of the item's words occur in
    order within a stretch of the text, or ``paraphrase`` of them together with
    ``answer`` of the item's last sentence. ``start`` and ``stop`` are words of
    the stretch searched. Null and empty texts, and items without words, leak
    nothing; an empty benchmark gives empty arrays; items that repeat are all
    reported. A column named ``out`` is replaced. The benchmark is a stated
    query set, searched in blocks of ``rank`` passages against all rows in one
    pass; it is broadcast, and one over ``item_bytes`` is refused.
    """
    spark, p = df.sparkSession, params
    bounded_batches(spark)
    kind = "array<struct<item_id:bigint,share:double,start:int,stop:int>>"
    rows = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    if size > p.item_bytes:
        raise ValueError(f"the benchmark has {size} bytes; call once for each part of at most {p.item_bytes}")
    own = rows.toPandas().sort_values(["i", "t"])
    docs = df.select(F.col(text).alias("text"))
    counts, total = document_frequencies(docs, p)
    weight = np.maximum(np.log((total + 1) / (counts + 1)) - p.common, p.floor)
    every, at = [], 0
    while at < len(own):
        to, n = at, 0
        while to < len(own) and (to == at or n < p.rank):
            n += max(1, -(-len(own["t"].iloc[to].split()) // p.block))
            to += to == at or n <= p.rank
        items = Items(own["i"].tolist()[at:to], own["t"].tolist()[at:to], p)
        if len(items.start):
            every.append((items, own["t"].tolist()[at:to]))
        at = to
    blocks, at = [], 0
    while at < len(every):
        to, n = at, 0
        while to < len(every) and (size := len(every[to][0].known) ** 2) <= p.square**2 and (to == at or n + size <= p.cells):
            n, to = n + size, to + 1
        grams = co_occurrences(docs, [x.known for x, _ in every[at:to]], weight, p) if to > at else [None]
        for (items, texts), gram in zip(every[at:], grams):
            factors = fit_factors(docs, texts, items.known, weight, gram, p)
            own_weight = weight[bucket(items.known, p)][:, None]
            table = np.r_[(factors * own_weight).astype(np.float32), np.zeros((1, factors.shape[1]), np.float32)]
            blocks.append((items, table, normed(passages(table[np.searchsorted(items.known, items.hash)], items.start, items.follows)).T))
        at += len(grams)
    shared = spark.sparkContext.broadcast((blocks, Lookup([x.known for x, _, _ in blocks]) if blocks else None, weight.astype(np.float32)))

    @F.pandas_udf(kind)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            result: list[list[dict]] = []
            for part in slices(pd.DataFrame({"text": series}), 1 << 19):
                result += leaks_of(list(part["text"]), *shared.value, p)
            yield pd.Series(result, dtype=object)

    return df.withColumn(out, search(F.col(text)))


def leaks_of(texts: list[str | None], blocks: list[tuple[Items, np.ndarray, np.ndarray]], lookup: Lookup | None, weight: np.ndarray, p: LeakParams) -> list[list[dict]]:
    """Passages that hold enough of an item passage's words, and could reach the cosine at all, are projected and compared with it."""
    out: list[dict[tuple[int, int], dict]] = [{} for _ in texts]
    w = tokens(texts)
    if len(w.hash) and blocks:
        found = lookup.found(w.hash)
        start, doc, follows = half_passages(w, len(texts), p)
        edge = np.searchsorted(w.doc, np.arange(len(texts) + 1))
        stop = np.r_[start[1:], len(w.hash)]
        stop = np.where(follows, np.r_[stop[1:], len(w.hash)], stop)
        square = weight[bucket(w.hash, p)] ** 2
        energy = passages(square, start, follows)
        for number, (items, table, queries) in enumerate(blocks):
            at = lookup.place[number][found]
            inside = at >= 0
            known = np.append(np.where(inside, at, len(items.known)), len(items.known))
            held = passages(inside.astype(np.int32), start, follows)
            maybe = np.flatnonzero((held >= items.least.min()) & (passages(square * inside, start, follows) >= p.cosine**2 * energy))  # the cosine's bound
            for a in range(0, len(maybe), 1024):
                rows = maybe[a : a + 1024]
                cols = start[rows][:, None] + np.arange(2 * p.block)
                ids = np.where(cols < stop[rows][:, None], known[np.minimum(cols, len(known) - 1)], len(items.known))
                share = np.zeros((len(rows), len(items.least)), np.uint8)
                for k in range(ids.shape[1]):
                    share += items.bags[ids[:, k]]
                r, q = np.nonzero(share >= items.least)
                if not len(r):
                    continue
                rows, ids, r = rows[u := np.unique(r)], ids[u], np.searchsorted(u, r)
                latent = sum(table[ids[:, k]] for k in range(ids.shape[1])) / np.sqrt(energy[rows])[:, None]
                near = (latent @ queries)[r, q] >= p.cosine
                for r1, q1 in zip(rows[r[near]], q[near]):
                    confirm(out[doc[r1]], items, number, int(items.doc[q1]), w.hash, int(edge[doc[r1]]), int(edge[doc[r1] + 1]), int(start[r1]), int(stop[r1]), p)
    return [sorted(x.values(), key=lambda y: (y["item_id"], y["start"])) for x in out]


def confirm(seen: dict[tuple[int, int], dict], items: Items, number: int, item: int, h: np.ndarray, low: int, high: int, start: int, stop: int, p: LeakParams) -> None:
    """Check an item against the candidate passage and the words around it; keep its best stretch."""
    target = items.words[item]
    a, b = max(low, start - len(target)), min(high, stop + len(target))
    key = (number, item)
    if key in seen and seen[key]["share"] == 1.0:
        return
    share = common_subsequence(target, h[a:b]) / len(target)
    if share < p.paraphrase:
        return
    if share < p.verbatim:
        answer = items.answers[item]
        if not len(answer) or common_subsequence(answer, h[a:b]) < p.answer * len(answer):
            return
    if key not in seen or share > seen[key]["share"]:
        seen[key] = {"item_id": items.ids[item], "share": share, "start": a - low, "stop": b - low}
