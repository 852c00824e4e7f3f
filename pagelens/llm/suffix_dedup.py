"""Removal of repeated byte strings by merging Burrows-Wheeler transforms of text shards."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import bounded_batches, cut, drop_cut, free_shuffles
from pagelens.llm.ngram_join import slices
from pagelens.llm.wordhash import BACK, STEP, mix, powers


@dataclass(frozen=True)
class RepeatParams:
    """``length``: bytes of a repeated string. ``gram``: bytes of an anchor, the
    smallest hash among the grams of such a string. ``shard``: segments of a
    shard whose transform is built alone, more in a large bin (16 shards at most). ``bin``: segments merged at a time.
    ``crowd``: segments of a bin beyond which it is split by more of the bytes
    around its core. ``broadcast_ids``: rows of one or two numbers that are
    broadcast rather than shuffled."""

    length: int = 100
    gram: int = 32
    shard: int = 128
    bin: int = 512
    crowd: int = 16_384
    broadcast_ids: int = 2_000_000

    @property
    def window(self) -> int:
        return self.length - self.gram + 1

    @property
    def extra(self) -> int:
        """Bytes of a string besides its anchor."""
        return self.length - self.gram


def larger(extra: int) -> int:
    """Bytes by which a core grows: of a string's ``extra`` bytes so many stand at one side of the core at least."""
    return extra - extra // 2


def run_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` bytes."""
    if len(data) < n:
        return np.empty(0, np.uint64)
    total = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(STEP, len(data)), dtype=np.uint64)]
    return mix((total[n:] - total[:-n]) * powers(BACK, len(data) - n + 1))


def sliding(x: np.ndarray, w: int, pick: np.ufunc, fill: int) -> np.ndarray:
    """Least or greatest of every ``w`` neighbours, from running values of blocks of ``w``."""
    full = np.r_[x, np.full(-len(x) % w, fill, np.uint64)].reshape(-1, w)
    ahead = pick.accumulate(full, axis=1).ravel()
    behind = pick.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[: len(x) - w + 1], ahead[w - 1 : len(x)])


def anchors(data: np.ndarray, p: RepeatParams) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors: for each string of ``length`` bytes its grams of the smallest hash."""
    h = run_hashes(data, p.gram)
    w = p.window
    if len(h) < w:
        return np.empty(0, np.int64), h[:0]
    least = sliding(h, w, np.minimum, np.iinfo(np.uint64).max)
    edge = np.zeros(w - 1, np.uint64)
    # no window around a place has a least hash above the place's own; one that reaches it makes the place an anchor
    at = np.flatnonzero(sliding(np.r_[edge, least, edge], w, np.maximum, 0) == h)
    return at, h[at]


def shard_transform(symbols: np.ndarray, pred: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of one shard in the order of their first ``rounds`` symbols, and the symbol before each (the transform)."""
    order = np.arange(len(symbols), dtype=np.int32)
    for _ in range(rounds):
        before = pred[order]
        order = before[np.argsort(symbols[before], kind="stable")]
    return order, symbols[pred[order]]


def merge_transforms(transforms: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' suffixes and, for each, the block that shares its first ``rounds`` symbols.

    Each round reads the transforms once in the present interleave and deals
    the shard numbers to the symbols read: after round ``h`` the interleave is
    right for ``h`` symbols, and a border that appears in it marks a common
    prefix of ``h - 1``. The suffixes themselves are never sorted again.
    """
    z = np.repeat(np.arange(len(transforms), dtype=np.uint16), [len(t) for t in transforms])
    block = np.zeros(len(z), np.int32)
    for _ in range(rounds):
        read = np.empty(len(z), transforms[0].dtype)
        for s, t in enumerate(transforms):
            read[z == s] = t
        deal = np.argsort(read, kind="stable")
        z, old, c = z[deal], block[deal], read[deal]
        block = np.r_[0, np.cumsum((c[1:] != c[:-1]) | (old[1:] != old[:-1]), dtype=np.int32)].astype(np.int32)
    return z, block


def equal_strings(grid: np.ndarray, low: np.ndarray, high: np.ndarray, length: int, shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, offset, block)`` of every run of ``length`` symbols in the rows' parts from ``low`` to ``high``; equal runs share a block.

    Symbols are named by hashes; should two strings of a block differ, the
    blocks are made from the symbols themselves.
    """
    n, width = grid.shape
    g = max(k for k in range(1, 11) if length % k == 0)
    rounds = length // g
    flat = grid.ravel()
    h = run_hashes(flat, g)
    h = np.r_[h, np.zeros(len(flat) - len(h), np.uint64)].reshape(grid.shape)[:, : width - g + 1]
    _, names = np.unique(h, return_inverse=True)
    names = names.reshape(h.shape).astype(np.int32) + 1
    del h
    cells = names.shape[1] + g  # each residue of g is a chain of symbols that ends in symbol 0
    sym = np.zeros((n, cells), np.uint16 if names.max() < 65535 else np.int32)
    sym[:, : names.shape[1]] = names
    place = np.arange(cells)
    before = place - g
    before[:g] = [np.flatnonzero(place % g == r)[-1] for r in range(g)]  # before a chain's first symbol stands its end
    orders, transforms = [], []
    for a in range(0, n, shard):
        m = min(shard, n - a)
        pred = (np.arange(m)[:, None] * cells + before).ravel().astype(np.int32)
        order, bwt = shard_transform(sym[a : a + m].ravel(), pred, rounds)
        orders.append(order + a * cells)
        transforms.append(bwt)
    z, block = merge_transforms(transforms, rounds)
    suffix = np.empty(len(z), np.int32)
    for k, o in enumerate(orders):
        suffix[z == k] = o
    row, off = suffix // cells, suffix % cells
    whole = (off >= low[row]) & (off + length <= high[row])
    row, off, block = row[whole], off[whole], block[whole]
    if len(row):
        runs = np.lib.stride_tricks.sliding_window_view(grid, length, axis=1)
        lead = np.maximum.accumulate(np.where(np.r_[True, block[1:] != block[:-1]], np.arange(len(block)), 0))
        two = np.flatnonzero(lead != np.arange(len(block)))
        if any((runs[row[k], off[k]] != runs[row[lead[k]], off[lead[k]]]).any() for k in np.array_split(two, len(two) // 4096 + 1)):
            _, block = np.unique(np.ascontiguousarray(runs[row, off]), axis=0, return_inverse=True)
    return row, off, block


def repeated_in(rows: pd.DataFrame, extra: int, p: RepeatParams) -> pd.DataFrame:
    """Intervals of the texts' strings that start earlier in another row.

    A row has ``bytes``: a core and up to ``extra`` bytes at its sides, ``lead``
    of them before it. Every string looked for holds the core, so a core is one
    symbol, and a string of ``length`` bytes is one of ``extra + 1`` symbols.
    """
    size = p.length - extra
    n, texts, lead = len(rows), rows["bytes"].tolist(), rows["lead"].to_numpy()
    grid = np.zeros((n, 2 * extra + 1), np.uint32)
    cores: dict[bytes, int] = {}
    stop = np.empty(n, np.int64)
    for k, (b, x) in enumerate(zip(texts, lead.tolist())):
        grid[k, extra - x : extra] = np.frombuffer(b, np.uint8, x)
        grid[k, extra] = 256 + cores.setdefault(b[x : x + size], len(cores))
        stop[k] = extra + 1 + len(b) - x - size
        grid[k, extra + 1 : stop[k]] = np.frombuffer(b, np.uint8, len(b) - x - size, x + size)
    row, off, block = equal_strings(grid, extra - lead, stop, extra + 1, max(p.shard, -(-n // 16)))
    doc, th, start = rows["doc"].to_numpy()[row], rows["th"].to_numpy()[row], rows["core"].to_numpy()[row] - extra + off
    order = np.lexsort((start, doc, block))
    doc, th, start, block = doc[order], th[order], start[order], block[order]
    source = np.maximum.accumulate(np.where(np.r_[True, block[1:] != block[:-1]], np.arange(len(block)), 0))
    later = (doc != doc[source]) | (start != start[source])
    doc, th, start = doc[later], th[later], start[later]
    if not len(doc):
        return pd.DataFrame({"doc": doc, "th": th, "a": start, "z": start})
    order = np.lexsort((start, th, doc))
    doc, th, start = doc[order], th[order], start[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (start[1:] > start[:-1] + p.length)]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(doc) - 1]
    return pd.DataFrame({"doc": doc[new], "th": th[new], "a": start[new], "z": start[last] + p.length})


#: A second base of run hashes; two make a name of 128 bits.
OTHER = np.uint64(0xC2B2AE3D27D4EB4F)
UNDO = np.uint64(pow(int(OTHER), -1, 1 << 64))


class Runs:
    """Hashes of any runs of one text's bytes, from running sums."""

    def __init__(self, data: np.ndarray, base: np.uint64 = STEP, undo: np.uint64 = BACK):
        self.sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, len(data)), dtype=np.uint64)]
        self.undo = powers(undo, len(data) + 1)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.undo[start])


def placed(column: str, *fields: str) -> list:
    """A list of structs as one array for each field."""
    return [F.col(f"{column}.{f}") for f in fields]


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", params: RepeatParams = RepeatParams()) -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept``: each whole text as UTF-8 without its repeated bytes.

    A byte goes if a string of ``length`` bytes that covers it also starts
    earlier: in a document with a smaller id, or earlier in the same one;
    strings are judged on the input and may overlap. Null texts count as empty.
    Rows that repeat an id should repeat its text; they are one document. A row
    with a null id is neither source nor target of a repeat. Other columns of
    ``df`` are not read.

    Anchors name the strings: equal strings have equal anchors at equal places,
    so only anchors that occur twice, with the bytes around them, are looked at
    further. Two groups never pass through the transforms: whole copies of a
    text (equal MD5), and equal segments around an anchor (128 bits), of which
    the first stands for all. The others meet in bins by the anchor and the
    bytes at one side of it, which are real bytes again there, and the
    transforms of a bin's shards are merged. A crowded bin is split by half of
    what a string has besides the bin's core, before or after it, as often as
    need be; at last the core is the string and its first place is a minimum.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    p = params
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    named = cut(docs.select("id", "th", F.md5("text").alias("name")).where("id is not null").distinct())
    firsts = named.groupBy("name").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("name", "first")
    copied = cut(named.join(firsts, "name").where("first < id").select("id", "th"))
    sources = docs.where("id is not null").join(bounded(copied, p), ["id", "th"], "left_anti")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in slices(pdf):
                ths, places, hashes = [], [], []
                for th, t in zip(part["th"], part["text"]):
                    at, h = anchors(np.frombuffer(t.encode(), np.uint8), p)
                    ths.append(np.full(len(at), th))
                    places.append(at)
                    hashes.append(h.view(np.int64))
                yield pd.DataFrame({"f": np.concatenate(hashes), "th": np.concatenate(ths), "at": np.concatenate(places).astype(np.int32)})

    found = cut(sources.select("th", "text").mapInPandas(find, "f long, th long, at int"))
    twice = cut(found.groupBy("f").agg(F.count("*").alias("n")).where("n > 1").select("f"))
    wanted = cut(found.join(bounded(twice, p), "f").groupBy("th").agg(F.collect_set(F.struct("at", "f")).alias("own")).select("th", *placed("own", "at", "f")))  # a text's own anchors at most
    for done in (found, twice):
        drop_cut(done)
    free_shuffles(spark)

    side = larger(p.extra)  # bytes of a string at one side of its anchor at least

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Around each anchor: the name of the bytes with its place in them, and bins of the anchor with the bytes at either side."""
        for pdf in batches:
            for part in slices(pdf, 1 << 17):
                out: list[tuple[np.ndarray, ...]] = []
                for doc, th, t, at, f in zip(part["id"], part["th"], part["text"], part["at"], part["f"]):
                    data = np.frombuffer(t.encode(), np.uint8)
                    one = Runs(data)
                    real = at + p.gram <= len(data)  # two texts of one hash may have mixed their anchors
                    at, f = at[real].astype(np.int64), f[real]
                    at = at[one.of(at, at + p.gram).view(np.int64) == f]
                    a, z = np.maximum(0, at - p.extra), np.minimum(len(data), at + p.length)
                    left, right = at - side, at + p.gram + side
                    no_left, no_right = left < 0, right > len(data)
                    before = one.of(np.where(no_left, 0, left), at + p.gram) ^ np.uint64(1)
                    after = one.of(at, np.where(no_right, at, right)) ^ np.uint64(2)
                    out.append((one.of(a, z) + ((z - a) << 16 | (at - a)).astype(np.uint64), Runs(data, OTHER, UNDO).of(a, z), np.full(len(at), doc), np.full(len(at), th), at, z - a, before, no_left, after, no_right))
                k1, k2, doc, th, at, size, before, no_left, after, no_right = map(np.concatenate, zip(*out))
                yield pd.DataFrame(
                    {"k1": k1.view(np.int64), "k2": k2.view(np.int64), "doc": doc, "th": th, "at": at, "size": size, "left": pd.arrays.IntegerArray(before.view(np.int64), no_left), "right": pd.arrays.IntegerArray(after.view(np.int64), no_right)}
                )

    around = sources.join(wanted, "th").select("id", "th", "text", "at", "f").mapInPandas(segments, "k1 long, k2 long, doc long, th long, at int, size int, left long, right long")
    cutouts = cut(around.where(F.col("size") >= p.length))
    drop_cut(wanted)
    free_shuffles(spark)
    distinct = cut(cutouts.groupBy("k1", "k2").agg(F.min(F.struct("doc", "at", "th", "size")).alias("first"), F.count("*").alias("n"), F.first("left").alias("left"), F.first("right").alias("right")))
    free_shuffles(spark)
    same = cutouts.select("k1", "k2", "doc", "th", "at", "size").join(bounded(distinct.where("n > 1").select("k1", "k2", "first"), p, 4), ["k1", "k2"]).where(F.struct("doc", "at", "th", "size") != F.col("first"))
    begin = F.greatest(F.lit(0), F.col("at") - p.extra)
    found_spans = [cut(same.select("doc", "th", begin.alias("a"), (begin + F.col("size")).alias("z")))]
    drop_cut(cutouts)
    sides = distinct.select(F.explode(F.array(F.struct(F.col("left").alias("bin"), (F.col("first.at") - side).alias("core")), F.struct(F.col("right").alias("bin"), F.col("first.at").alias("core")))).alias("s"), "first.doc", "first.th")
    sides = sides.select("s.bin", "doc", "th", "s.core").where("bin is not null").distinct()
    shared = cut(sides.groupBy("bin").agg(F.count("*").alias("n")).where("n > 1").select("bin"))
    own = cut(sides.join(bounded(shared, p), "bin").groupBy("doc", "th").agg(F.collect_list(F.struct("bin", "core")).alias("own")).select("doc", "th", *placed("own", "bin", "core")))  # a document's own segments
    drop_cut(shared)
    drop_cut(distinct)
    free_shuffles(spark)
    extra = p.extra - side

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = p.length - extra
        for pdf in batches:
            for part in slices(pdf, 1 << 17):
                rows = []
                for doc, th, t, names, cores in zip(part["doc"], part["th"], part["text"], part["bin"], part["core"]):
                    b = t.encode()
                    for name, c in zip(names.tolist(), cores.tolist()):
                        a = max(0, c - extra)
                        rows.append((name, doc, th, c, c - a, b[a : c + size + extra]))
                yield pd.DataFrame(rows, columns=["bin", "doc", "th", "core", "lead", "bytes"])

    kind = "bin long, doc long, th long, core int, lead int, bytes binary"
    fetched = docs.withColumnRenamed("id", "doc").join(own, ["doc", "th"]).select("doc", "th", "text", "bin", "core").mapInPandas(take, kind)
    held = cut(fetched)
    drop_cut(own)
    while True:
        crowds = cut(held.groupBy("bin").agg(F.count("*").alias("n")).where(F.col("n") > p.crowd).select("bin", "n"))
        none = crowds.isEmpty()
        marked = held if none else held.join(bounded(crowds, p), "bin", "left")
        if extra:
            calm = held if none else marked.where("n is null").drop("n")
            found_spans.append(cut(calm.repartition("bin").sortWithinPartitions("bin").mapInPandas(merging(extra, p), "doc long, th long, a int, z int")))
        if none and extra:
            break
        busy = marked.where("n is not null").drop("n")
        if not extra:  # a core is a string
            source = held.groupBy("bytes").agg(F.min(F.struct("doc", "core")).alias("first"))
            again = held.join(source, "bytes").where(F.struct("doc", "core") != F.col("first"))
            found_spans.append(cut(again.select("doc", "th", F.col("core").alias("a"), (F.col("core") + p.length).alias("z")).distinct()))
            break
        after = cut(busy.mapInPandas(splitting(extra, p), kind).distinct())
        drop_cut(held)
        alone = cut(after.groupBy("bin").agg(F.count("*").alias("n")).where("n = 1").select("bin"))
        held = cut(after.join(bounded(alone, p), "bin", "left_anti"))
        for done in (after, alone, crowds):
            drop_cut(done)
        extra //= 2
    drop_cut(held)
    free_shuffles(spark)
    spans = found_spans[0]
    for more in found_spans[1:]:
        spans = spans.union(more)
    spans = spans.groupBy("doc", "th").agg(F.collect_set(F.struct("a", "z")).alias("own")).select("doc", "th", *placed("own", "a", "z"))  # a document's own spans
    nothing = F.lit(None).cast("array<int>")
    fate = copied.select("id", "th", F.lit(True).alias("copied"), nothing.alias("a"), nothing.alias("z")).union(spans.select("doc", "th", F.lit(False), "a", "z"))

    @F.pandas_udf("struct<n_removed:bigint,n_spans:bigint,kept:binary>")
    def carve(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for texts, copied, starts, stops in batches:
            yield pd.DataFrame([carved(t.encode(), c, a, z, p) for t, c, a, z in zip(texts, copied, starts, stops)], columns=["n_removed", "n_spans", "kept"])

    marked = docs.join(fate, ["id", "th"], "left").select("id", "text", F.coalesce("copied", F.lit(False)).alias("copied"), "a", "z")
    done = marked.select("id", F.octet_length("text").cast("long").alias("n_bytes"), carve("text", "copied", "a", "z").alias("r"))
    return done.select(F.col("id").alias(id_col), "n_bytes", "r.n_removed", "r.n_spans", "r.kept")


def bounded(df: DataFrame, p: RepeatParams, wide: int = 1) -> DataFrame:
    """``df``, of up to two numbers (``wide`` times as many) a row, broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() * wide <= p.broadcast_ids else df


def merging(extra: int, p: RepeatParams):
    """A map over rows sorted by bin: whole bins, about ``bin`` segments at a time, merged."""

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0
        for pdf in batches:
            held.append(pdf)
            rows += len(pdf)
            if rows >= p.bin + p.crowd:  # the open bin has at most ``crowd`` rows
                both = pd.concat(held)
                open_bin = both["bin"].to_numpy() == both["bin"].iloc[-1]
                yield from (repeated_in(x, extra, p) for x in whole_bins(both[~open_bin], p))
                held, rows = [both[open_bin]], int(open_bin.sum())
        if rows:
            yield from (repeated_in(x, extra, p) for x in whole_bins(pd.concat(held), p))

    return merge


def splitting(extra: int, p: RepeatParams):
    """A map over rows of crowded bins: each goes on with more of the bytes before its core, and with more after it."""
    size, grow, left = p.length - extra, larger(extra), extra // 2

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, doc, th, core, lead, b in pdf[["bin", "doc", "th", "core", "lead", "bytes"]].itertuples(index=False, name=None):
                for at in (lead - grow, lead):
                    if at < 0 or at + size + grow > len(b):
                        continue
                    a = max(0, at - left)
                    inside = b[at : at + size + grow]
                    rows.append((int.from_bytes(blake2b(inside, digest_size=8, salt=b"l" if at < lead else b"r").digest(), "little", signed=True), doc, th, core - lead + at, at - a, b[a : at + size + grow + left]))
            yield pd.DataFrame(rows, columns=["bin", "doc", "th", "core", "lead", "bytes"])

    return split


def whole_bins(pdf: pd.DataFrame, p: RepeatParams) -> Iterator[pd.DataFrame]:
    """Runs of whole bins with about ``bin`` segments each."""
    key = pdf["bin"].to_numpy()
    ends = np.flatnonzero(np.r_[key[1:] != key[:-1], True]) + 1 if len(key) else np.empty(0, int)
    at = 0
    while at < len(key):
        to = ends[min(len(ends) - 1, np.searchsorted(ends, at + p.bin))]
        yield pdf.iloc[at:to]
        at = to


def carved(b: bytes, copied: bool, starts, stops, p: RepeatParams) -> tuple[int, int, bytes]:
    if copied and len(b) >= p.length:
        return len(b), 1, b""
    if starts is None or not len(starts):
        return 0, 0, b
    gone = np.zeros(len(b) + 1, np.int32)
    np.add.at(gone, starts, 1)
    np.add.at(gone, stops, -1)
    covered = np.cumsum(gone[:-1]) > 0
    return int(covered.sum()), int((np.diff(np.r_[0, covered.astype(np.int8)]) == 1).sum()), np.frombuffer(b, np.uint8)[~covered].tobytes()
