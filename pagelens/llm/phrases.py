"""Phrases that occur together more than their parts would: counts kept in order and merged in lockstep."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import bounded_batches, cut, drop_cut, free_shuffles
from pagelens.llm.wordhash import STEP, mix

#: A word, or what parts two pieces.
TOKEN = re.compile(rb"[^ \t.,;:!?\n-\r]+|[.,;:!?\n-\r]+")
APART = frozenset(b".,;:!?\n\v\f\r")


@dataclass(frozen=True)
class PhraseParams:
    """``words``: of a phrase at most, two or more. ``least``: occurrences of a
    candidate. ``inside``: a candidate goes if a longer one around it has so many
    hundredths of its occurrences. ``top``: phrases reported for each language.
    ``chunk``: bytes of text counted at a time in a task. ``filter_bits``: the
    logarithm of the bits of the filter of frequent phrases, whose size is fixed."""

    words: int = 3
    least: int = 10
    inside: int = 50
    top: int = 2000
    chunk: int = 8 << 20
    filter_bits: int = 26


class Tokens:
    """The texts of one language as numbers of words; -1 parts pieces. Words are compared themselves, not by hashes."""

    def __init__(self, texts: list[bytes]):
        found = TOKEN.findall(b"\n".join(texts).lower())  # bytes.lower() turns A-Z alone
        codes, words = pd.factorize(np.array([*found, b"\n"], object))
        apart = np.array([w[0] in APART for w in words])
        number = np.where(apart, -1, np.cumsum(~apart) - 1)
        self.code = number[codes]
        self.words = pa.array(words[~apart].tolist(), pa.binary())

    def hashes(self) -> np.ndarray:
        """A hash of every token's word."""
        each = np.array([xxhash.xxh64_intdigest(w.as_py()) for w in self.words] or [0], np.uint64)
        return each[self.code]

    def grams(self, n: int, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The distinct phrases of ``n`` words that start at the places ``at``, and their counts."""
        size = max(1, len(self.words))
        ids = self.code[at]
        for k in range(1, n):
            if k > 1:  # the words before by one number, that two numbers always fit
                _, ids = np.unique(ids, return_inverse=True)
            ids = ids * size + self.code[at + k]
        _, first, count = np.unique(ids, return_index=True, return_counts=True)
        return [self.code[at[first] + k] for k in range(n)], count

    def spelled(self, columns: list[np.ndarray], lang: str) -> pa.Array:
        taken = [self.words.take(pa.array(c)) for c in columns]
        joined = taken[0] if len(taken) == 1 else pc.binary_join_element_wise(*taken, b" ")
        return pc.binary_join_element_wise(pa.scalar(lang.encode(), pa.binary()), joined, b"\n").cast(pa.string())


def chains(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each place on."""
    h = hashes
    for k in range(1, n):
        h = mix(h[: len(hashes) - k] * STEP + hashes[k:])
    return h


def whole(code: np.ndarray, n: int) -> np.ndarray:
    """Places where ``n`` words of one piece start."""
    word = (code >= 0).astype(np.int32)
    return np.flatnonzero(np.convolve(word, np.ones(n, np.int32), "valid") == n) if len(code) >= n else np.empty(0, np.int64)


def by_language(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of a language, about ``size`` bytes at a time."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    total = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            held.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text)
            total += len(text)
            if total >= size:
                most = max(sizes, key=sizes.get)
                total -= sizes.pop(most)
                yield most, held.pop(most)
    yield from held.items()


ROW = pa.schema([("key", pa.string()), ("f", pa.int64())])


def counted(columns: pa.Array, count: np.ndarray, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    yield from pa.table([columns, pa.array(count.astype(np.int64))], schema=ROW).to_batches(rows)


def frequent_filter(often: DataFrame, n: int, p: PhraseParams) -> np.ndarray:
    """Bits of the frequent phrases of ``n`` words: a filter of fixed size that lets all of them through, and few others while they are few."""

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h = np.array([xxhash.xxh64_intdigest(w.encode()) for s in pdf["phrase"] for w in s.split(" ")], np.uint64).reshape(-1, n)
            out = h[:, 0]
            for k in range(1, n):
                out = mix(out * STEP + h[:, k])
            slot = (out >> np.uint64(64 - p.filter_bits)).astype(np.int64)
            yield pd.DataFrame({"cell": slot >> 5, "bit": np.int64(1) << (slot & 31)})

    cells = often.where(F.col("n") == n).select("phrase").mapInPandas(slots, "cell long, bit long").groupBy("cell").agg(F.expr("bit_or(bit)").alias("bits")).toPandas()
    table = np.zeros(1 << (p.filter_bits - 5), np.uint32)
    table[cells["cell"].to_numpy(np.int64)] = cells["bits"].to_numpy(np.int64).astype(np.uint32)
    return table


def frequent_phrases(df: DataFrame, text: str, lang: str, p: PhraseParams) -> DataFrame:
    """``(lang, phrase, n, f)`` of all phrases of up to ``words`` words that occur ``least`` times; the empty phrase counts all words of its language.

    One pass counts words and pairs; each longer length takes a pass of its
    own and counts only where both phrases one word shorter may be frequent: an
    occurrence of a frequent phrase always is.
    """
    texts = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spark = df.sparkSession

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in by_language(batches, p.chunk):
            t = Tokens(texts)
            if len(t.words):
                yield from counted(pa.array([lang + "\n"]), np.array([(t.code >= 0).sum()]))
                for n in (1, 2):
                    columns, count = t.grams(n, whole(t.code, n))
                    yield from counted(t.spelled(columns, lang), count)

    def frequent(rows: DataFrame) -> DataFrame:
        phrase = F.substring_index("key", "\n", -1)
        sums = rows.groupBy("key").agg(F.sum("f").alias("f")).where((F.col("f") >= p.least) | F.col("key").endswith("\n"))
        named = sums.select(F.expr("left(key, length(key) - length(substring_index(key, '\n', -1)) - 1)").alias("lang"), phrase.alias("phrase"), "f")
        return cut(named.select("lang", "phrase", F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " "))).alias("n"), "f"))

    tables = [frequent(texts.mapInArrow(short, "key string, f long"))]
    free_shuffles(spark)
    for n in range(3, p.words + 1):
        bits = spark.sparkContext.broadcast(frequent_filter(tables[-1], n - 1, p))

        def long(batches: Iterator[pa.RecordBatch], n: int = n, bits=bits) -> Iterator[pa.RecordBatch]:
            table = bits.value
            for lang, texts in by_language(batches, p.chunk):
                t = Tokens(texts)
                at = whole(t.code, n)
                if not len(at):
                    continue
                slot = chains(t.hashes(), n - 1) >> np.uint64(64 - p.filter_bits)
                may = (table[slot >> np.uint64(5)] >> (slot & np.uint64(31)).astype(np.uint32)) & np.uint32(1)
                at = at[(may[at] & may[at + 1]).astype(bool)]
                if len(at):
                    columns, count = t.grams(n, at)
                    yield from counted(t.spelled(columns, lang), count)

        tables.append(frequent(texts.mapInArrow(long, "key string, f long")))
        free_shuffles(spark)
    out = tables[0]
    for more in tables[1:]:
        out = out.union(more)
    out.scratch_tables = tables
    return out


def in_order(df: DataFrame, top: int, schema: str) -> DataFrame:
    """The first ``top`` rows of each language of a frame with ``lang, score, a, phrase``, numbered from 1 in ``rank``.

    The rows are dealt by ranges of the order itself, so a large language lies
    in as many tasks as it fills; each task numbers its own rows and a table of
    counts, one row for each task and language, shifts the numbers.
    """
    ordered = df.repartitionByRange(F.col("lang"), F.col("score").desc(), F.col("a").desc(), F.col("phrase")).sortWithinPartitions(F.col("lang"), F.col("score").desc(), F.col("a").desc(), F.col("phrase"))

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, now, done = TaskContext.get().partitionId(), None, 0
        for pdf in batches:
            own = pdf.groupby("lang", sort=False).cumcount().to_numpy() + 1
            if now is not None:
                own[pdf["lang"].to_numpy() == now] += done
            now, done = pdf["lang"].iloc[-1], int(own[-1])
            pdf = pdf.assign(part=part, own=own.astype(np.int64))
            yield pdf[own <= top]

    numbered = cut(ordered.mapInPandas(number, f"{schema}, part int, own long"))
    counts = numbered.groupBy("lang", "part").agg(F.max("own").alias("m"))
    later = counts.select("lang", F.col("part").alias("before"), "m")
    shift = counts.select("lang", "part").join(later, "lang").where("before < part").groupBy("lang", "part").agg(F.sum("m").alias("shift"))
    ranked = numbered.join(shift, ["lang", "part"], "left").withColumn("rank", F.col("own") + F.coalesce("shift", F.lit(0)))
    return ranked.where(F.col("rank") <= top).drop("part", "own", "shift")


def mine_phrases(df: DataFrame, text: str = "text", lang: str = "lang", params: PhraseParams = PhraseParams()) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language.

    A-Z is lower-cased; ``.,;:!?`` and line ends part pieces, blanks and tabs
    words. Counts are of a language, a null one being ``und``; null texts count
    as empty, repeated rows as texts of their own, and a language without a
    candidate has no row. Other columns are not read.

    The frequent phrases are a stream of counts that is kept in two orders: by
    the first words of each phrase for the counts of its heads and of its
    extensions to the right, by the last words for those of its ends and of its
    extensions to the left. Merge joins read them in lockstep. Scores are exact
    (decimals of 38 digits, for counts below 10**15).
    """
    p = params
    if p.words < 2:
        raise ValueError("a phrase has two words at least")
    bounded_batches(df.sparkSession)
    often = frequent_phrases(df, text, lang, p)
    w = F.split("phrase", " ")
    cuts = often.where("n >= 2").select("lang", "phrase", "n", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    cuts = cuts.select("*", F.array_join(F.slice(w, 1, F.col("k")), " ").alias("head"), F.array_join(F.slice(w, F.col("k") + 1, F.col("n") - F.col("k")), " ").alias("rest"))
    side = lambda name, f: often.where("n > 0").select("lang", F.col("phrase").alias(name), F.col("f").alias(f)).hint("merge")
    both = cuts.join(side("head", "l"), ["lang", "head"]).join(side("rest", "r"), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    both = both.select("*", wide("a").alias("x"), wide("l").alias("y"), wide("r").alias("z")).withColumn("score", F.expr("(x * x * cast(1000000 as decimal(7,0))) div (y * z)"))
    best = both.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"), F.min("a").alias("a"))
    around = cuts.where("n >= 3 and k = n - 1").select("lang", F.col("head").alias("phrase"), "a").union(cuts.where("n >= 3 and k = 1").select("lang", "rest", "a"))
    around = around.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = best.join(around.hint("merge"), ["lang", "phrase"], "left").where(F.coalesce(F.col("longer"), F.lit(0)) * 100 < F.col("a") * p.inside)
    scored = cut(left.select("lang", "phrase", "a", "b.l", "b.r", "b.score"))
    total = often.where("n = 0").select("lang", F.col("f").alias("n"))
    ranked = in_order(scored, p.top, "lang string, phrase string, a long, l long, r long, score long")
    out = cut(ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    for done in (scored, *often.scratch_tables):
        drop_cut(done)
    return out
