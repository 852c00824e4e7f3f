"""Removal of word passages that occur more than once, by suffix automata of reference shards."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import bounded_batches, cut, drop_cut, free_shuffles, unused
from pagelens.llm.ngram_join import slices
from pagelens.llm.suffix_dedup import anchors, run_hashes


@dataclass(frozen=True)
class PassageParams:
    """``length``: words of a repeated passage at least. ``gram``: words of an
    anchor, the smallest hash among the grams of such a passage. ``shard``:
    reference segments of one automaton, about. ``crowd``: segments of an anchor
    beyond which its passages are counted one by one. ``broadcast_ids``: rows of
    a short key that are broadcast rather than shuffled."""

    length: int = 35
    gram: int = 20
    shard: int = 256
    crowd: int = 2048
    broadcast_ids: int = 2_000_000

    @property
    def window(self) -> int:
        return self.length - self.gram + 1

    @property
    def extra(self) -> int:
        """Words of a passage besides its anchor."""
        return self.length - self.gram


class SuffixAutomaton:
    """The substrings of a shard's segments as states, and how often each ends in them.

    ``ends[v]``: weighted occurrences of the strings of state ``v``;
    ``known[v]``: length of the longest suffix of its strings that occurs twice.
    """

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.size = [0]
        self.ends = [0]
        self.known: list[int] = []

    def add(self, segment: list[int], weight: int) -> None:
        nxt, link, size, ends = self.next, self.link, self.size, self.ends
        last = 0
        for c in segment:
            q = nxt[last].get(c)
            if q is not None and size[q] == size[last] + 1:
                last = q
            elif q is not None:
                last = self._split(last, c, q)
            else:
                new = len(nxt)
                nxt.append({})
                size.append(size[last] + 1)
                ends.append(0)
                link.append(0)
                p = last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    link[new] = q if size[q] == size[p] + 1 else self._split(p, c, q)
                last = new
            ends[last] += weight

    def _split(self, p: int, c: int, q: int) -> int:
        """The strings of ``q`` that are no longer than those of ``p`` with ``c`` get a state of their own."""
        nxt, link, size = self.next, self.link, self.size
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        size.append(size[p] + 1)
        self.ends.append(0)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def finish(self) -> None:
        """Carry the occurrences to the suffixes, longest states first."""
        order = sorted(range(1, len(self.size)), key=self.size.__getitem__)
        for v in reversed(order):
            if self.link[v] > 0:
                self.ends[self.link[v]] += self.ends[v]
        self.known = [0] * len(self.size)
        for v in order:
            self.known[v] = self.size[v] if self.ends[v] >= 2 else self.known[self.link[v]]

    def statistics(self, text: list[int]) -> Iterator[int]:
        """For each place of ``text`` the length of the longest string that ends there and occurs twice in the shard."""
        v = matched = 0
        for c in text:
            while v and c not in self.next[v]:
                v = self.link[v]
                matched = self.size[v]
            if c in self.next[v]:
                v, matched = self.next[v][c], matched + 1
            yield matched if self.ends[v] >= 2 else self.known[v]


def in_shard(rows: pd.DataFrame, p: PassageParams) -> pd.DataFrame:
    """``(key, a, z)``: passages of the rows of weight one that also stand elsewhere in the shard.

    An anchor is one symbol, told by its words; a passage of ``length`` words is
    a string of ``length - gram + 1`` symbols around it.
    """
    symbols: dict = {}
    machine = SuffixAutomaton()
    texts = []
    for lead, b, weight in zip(rows["lead"].tolist(), rows["words"], rows["weight"].tolist()):
        w = b.split(b" ")
        core = tuple(w[lead : lead + p.gram])
        text = [symbols.setdefault(x, len(symbols)) for x in (*w[:lead], core, *w[lead + p.gram :])]
        machine.add(text, weight)
        texts.append(text)
    machine.finish()
    need = p.extra + 1
    out = []
    for key, at, lead, weight, text in zip(rows["key"], rows["at"].tolist(), rows["lead"].tolist(), rows["weight"].tolist(), texts):
        if weight > 1:
            continue  # equal segments are covered as they stand
        first = None
        for i, s in enumerate(machine.statistics(text)):
            if s >= need:
                begin = at - lead + i - need + 1
                if first is None:
                    first = begin
                last = begin
            elif first is not None:
                out.append((key, first, last + p.length))
                first = None
        if first is not None:
            out.append((key, first, last + p.length))
    return pd.DataFrame(out, columns=["key", "a", "z"])


def few(df: DataFrame, p: PassageParams) -> DataFrame:
    """``df``, of up to two numbers or a key a row, broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() <= p.broadcast_ids else df


def text_key(text: str) -> Column:
    """128 bits of a text's SHA-256."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def word_hashes(texts: list[list[bytes]]) -> np.ndarray:
    """Hashes of all words of some texts, one after the other."""
    codes, distinct = pd.factorize(np.array([*(w for t in texts for w in t), b""], object))
    return np.array([xxhash.xxh64_intdigest(w) for w in distinct], np.uint64)[codes[:-1]]


def remove_repeated_passages(df: DataFrame, id_col: str = "doc_id", text: str = "text", params: PassageParams = PassageParams()) -> DataFrame:
    """``id_col, n_words, n_removed, kept, spans`` for each row of ``df``.

    Words are runs of bytes other than ``\\x20`` and ``\\x09``-``\\x0D``. A word goes
    if a window of ``length`` words that covers it stands anywhere else too, in
    any row or at another place of the same text; all occurrences go, and
    windows are judged on the input. ``kept`` joins the words left by blanks;
    ``spans`` are the maximal runs removed, as word positions, end exclusive.
    Null and short texts lose nothing; rows that repeat, null ids included, are
    rows of their own. Other columns are not read.

    Whole copies go by the SHA-256 of the text and one of them stands for all.
    Equal windows have equal anchors at equal places; segments around anchors
    that occur twice are the reference. Equal segments (128 bits of BLAKE2) are
    repeats as they stand; where an anchor has different ones, they meet in a
    shard, whose suffix automaton counts every string of their words; each
    segment is then streamed through it for its matching statistics. A shard
    has a bounded number of segments, so its automaton has a bounded size; it
    is built in the task that reads its segments. An anchor with over ``crowd``
    different segments (a passage in very many different surroundings) has its
    windows counted one by one, by 128 bits of BLAKE2.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    p = params
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("key", text_key("text"))
    ranks = docs.select("key", F.xxhash64("id").alias("h"))
    copied = cut(ranks.groupBy("key").agg(F.min("h").alias("h"), F.count("*").alias("n")).where("n > 1").select("key", "h"))
    one = few(copied.withColumnRenamed("h", "lead"), p)
    sources = docs.join(one, "key", "left").where(F.col("lead").isNull() | (F.col("lead") == F.xxhash64("id"))).select("key", "text")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in slices(pdf):
                split = [t.encode().split() for t in part["text"]]
                hashes, begin = word_hashes(split), 0
                keys, places, found = [], [], []
                for key, words in zip(part["key"], split):
                    if len(words) >= p.length:
                        at, h = anchors(hashes[begin : begin + len(words)], p)
                        keys += [key] * len(at)
                        places.append(at)
                        found.append(h.view(np.int64))
                    begin += len(words)
                if keys:
                    yield pd.DataFrame({"f": np.concatenate(found), "key": keys, "at": np.concatenate(places).astype(np.int32)})

    found = cut(sources.mapInPandas(find, "f long, key binary, at int"))
    twice = cut(found.groupBy("f").agg(F.count("*").alias("n")).where("n > 1").select("f"))
    own = lambda rows, *fields: rows.groupBy("key").agg(F.collect_list(F.struct(*fields)).alias("own")).select("key", *(F.col(f"own.{f}") for f in fields))  # noqa: E731  of one text at most
    wanted = cut(own(found.join(few(twice, p), "f"), "at", "f"))
    for done in (found, twice):
        drop_cut(done)
    free_shuffles(spark)

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The digest of the segment around each anchor."""
        for pdf in batches:
            for part in slices(pdf, 1 << 18):
                out = []
                for key, t, at, f in zip(part["key"], part["text"], part["at"], part["f"]):
                    words = t.encode().split()
                    for x, g in zip(at.tolist(), f.tolist()):
                        a, z = max(0, x - p.extra), min(len(words), x + p.length)
                        if z - a >= p.length:
                            # the anchor's place is part of the name
                            out.append((g, blake2b(b" ".join(words[a:z]), digest_size=16, salt=(x - a).to_bytes(2, "little")).digest(), key, a, z, x))
                yield pd.DataFrame(out, columns=["f", "segment", "key", "a", "z", "at"])

    segments = cut(sources.join(wanted, "key").mapInPandas(name, "f long, segment binary, key binary, a int, z int, at int"))
    drop_cut(wanted)
    free_shuffles(spark)
    distinct = cut(segments.groupBy("f", "segment").agg(F.count("*").alias("n"), F.min(F.struct("key", "at")).alias("first")).select("f", "segment", F.least("n", F.lit(2)).cast("int").alias("weight"), "first.key", "first.at"))
    bins = cut(distinct.groupBy("f").agg(F.count("*").alias("n"), F.min("weight").alias("w")).where("n > 1 and w = 1").select("f", (F.col("n") > p.crowd).alias("crowded")))
    equal = segments.join(distinct.where("weight > 1").select("f", "segment"), ["f", "segment"]).select("key", "a", "z")
    found_spans = [cut(equal.distinct())]
    drop_cut(segments)
    free_shuffles(spark)
    places = cut(own(distinct.join(few(bins, p), "f"), "at", "f", "weight", "crowded"))

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in slices(pdf, 1 << 18):
                out = []
                for key, t, at, f, weight, crowded in zip(part["key"], part["text"], part["at"], part["f"], part["weight"], part["crowded"]):
                    words = t.encode().split()
                    for x, g, w, c in zip(at.tolist(), f.tolist(), weight.tolist(), crowded.tolist()):
                        a = max(0, x - p.extra)
                        out.append((g, c, w, key, x, x - a, b" ".join(words[a : x + p.length])))
                yield pd.DataFrame(out, columns=["f", "crowded", "weight", "key", "at", "lead", "words"])

    reference = cut(sources.join(places, "key").mapInPandas(fetch, "f long, crowded boolean, weight int, key binary, at int, lead int, words binary"))
    for done in (places, distinct, bins):
        drop_cut(done)
    free_shuffles(spark)

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whole anchors, about ``shard`` segments at a time."""
        held: list[pd.DataFrame] = []
        rows = 0
        for pdf in batches:
            held.append(pdf)
            rows += len(pdf)
            if rows >= p.shard + p.crowd:  # the open anchor has at most ``crowd`` rows
                both = pd.concat(held, ignore_index=True)
                unfinished = both["f"].to_numpy() == both["f"].iloc[-1]
                yield from (in_shard(x, p) for x in shards(both[~unfinished], p))
                held, rows = [both[unfinished]], int(unfinished.sum())
        if rows:
            yield from (in_shard(x, p) for x in shards(pd.concat(held, ignore_index=True), p))

    span = "key binary, a int, z int"
    found_spans.append(cut(reference.where("not crowded").repartition("f").sortWithinPartitions("f").mapInPandas(stream, span)))
    crowds = reference.where("crowded")
    if not crowds.isEmpty():

        def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Each window once: under the first of its grams of the smallest hash, as all windows of these words are."""
            for pdf in batches:
                out = []
                split = [b.split(b" ") for b in pdf["words"]]
                hashes, begin = word_hashes(split), 0
                for key, at, lead, weight, w in zip(pdf["key"], pdf["at"].tolist(), pdf["lead"].tolist(), pdf["weight"].tolist(), split):
                    grams = run_hashes(hashes[begin : begin + len(w)], p.gram)
                    begin += len(w)
                    for s in range(len(w) - p.length + 1):
                        if s <= lead < s + p.window and int(grams[s : s + p.window].argmin()) == lead - s:
                            out.append((blake2b(b" ".join(w[s : s + p.length]), digest_size=16).digest(), key, at - lead + s, weight))
                yield pd.DataFrame(out, columns=["window", "key", "a", "weight"])

        each = cut(crowds.mapInPandas(windows, "window binary, key binary, a int, weight int"))
        often = cut(each.groupBy("window").agg(F.sum("weight").alias("n")).where("n > 1").select("window"))
        found_spans.append(cut(each.where("weight = 1").join(few(often, p), "window").select("key", "a", (F.col("a") + p.length).alias("z")).distinct()))
        for done in (each, often):
            drop_cut(done)
    drop_cut(reference)
    free_shuffles(spark)
    spans = found_spans[0]
    for more in found_spans[1:]:
        spans = spans.union(more)
    gone = own(spans, "a", "z").select("key", F.lit(False).alias("copied"), "a", "z")
    nothing = F.lit(None).cast("array<int>")
    fate = gone.join(copied, "key", "left_anti").union(copied.select("key", F.lit(True), nothing, nothing))

    @F.pandas_udf("struct<n_words:bigint,n_removed:bigint,kept:string,spans:array<struct<a:bigint,z:bigint>>>")
    def carve(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for texts, copied, starts, stops in batches:
            yield pd.DataFrame([carved(t.encode().split(), c, a, z, p) for t, c, a, z in zip(texts, copied, starts, stops)], columns=["n_words", "n_removed", "kept", "spans"])

    out = unused("carved", df)
    marked = docs.join(fate, "key", "left").select("id", carve("text", F.coalesce("copied", F.lit(False)), "a", "z").alias(out))
    return marked.select(F.col("id").alias(id_col), f"{out}.n_words", f"{out}.n_removed", f"{out}.kept", f"{out}.spans")


def shards(pdf: pd.DataFrame, p: PassageParams) -> Iterator[pd.DataFrame]:
    """Runs of whole anchors with about ``shard`` segments each."""
    key = pdf["f"].to_numpy()
    if not len(key):
        return
    ends = np.flatnonzero(np.r_[key[1:] != key[:-1], True]) + 1
    at = 0
    while at < len(key):
        to = int(ends[min(len(ends) - 1, np.searchsorted(ends, at + p.shard))])
        yield pdf.iloc[at:to]
        at = to


def carved(words: list[bytes], copied: bool, starts, stops, p: PassageParams) -> tuple[int, int, str, list[dict]]:
    n = len(words)
    if copied and n >= p.length:
        return n, n, "", [{"a": 0, "z": n}]
    if starts is None or not len(starts):
        return n, 0, b" ".join(words).decode(), []
    turns = np.zeros(n + 1, np.int64)
    np.add.at(turns, starts, 1)
    np.add.at(turns, stops, -1)
    covered = np.cumsum(turns[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.r_[False, covered, False].astype(np.int8)))
    kept = b" ".join([words[k] for k in np.flatnonzero(~covered).tolist()])
    return n, int(covered.sum()), kept.decode(), [{"a": int(a), "z": int(z)} for a, z in edges.reshape(-1, 2)]
