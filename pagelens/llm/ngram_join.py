"""Self-join of texts by the Jaccard similarity of word n-gram sets, with token-combination prefixes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import bounded_batches, components, cut, drop_cut, free_shuffles
from pagelens.llm.wordhash import mix, words


@dataclass(frozen=True)
class JoinParams:
    """``words``: of a shingle. ``percent``: least similarity, in hundredths.
    ``common``: share of a block of texts from which a shingle counts as common
    and is ordered last. ``frequent``: share of all texts from which shingles are
    indexed as pairs. ``block``: shingles counted at a time. ``table``: common
    shingles whose order is broadcast, the commonest first; others are ordered
    by hash, which changes the cost and never the result. ``broadcast_ids``:
    candidates up to which their ids (16 bytes each) are broadcast to the texts;
    more are joined by a shuffle. ``small``: texts that share a signature and are
    paired by a plain join; more are dealt to parts of ``square`` texts, and each
    two parts meet in a task's group of their own. ``leaders``: texts of a part
    with which the others are compared before all are."""

    words: int = 4
    percent: int = 85
    common: float = 0.0005
    frequent: float = 0.05
    block: int = 2_000_000
    table: int = 2_000_000
    broadcast_ids: int = 1_000_000
    small: int = 32
    square: int = 1024
    leaders: int = 256


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``k``-word shingles of each text; fewer words give one, none give none."""
    w = words([(t or "").encode() for t in texts])
    h, edge = w.hash, np.searchsorted(w.doc, np.arange(len(texts) + 1))
    n = np.diff(edge)
    g = mix(h + np.uint64(1))
    for i in range(1, k):
        g[: max(0, len(h) - i)] = mix(g[: max(0, len(h) - i)] * np.uint64(3) + h[i:])
    out = []
    for d in range(len(texts)):
        a, b = edge[d], edge[d + 1]
        if n[d] >= k:
            out.append(np.unique(g[a : b - k + 1]))
        elif n[d]:
            short = np.array([n[d]], np.uint64)
            for x in h[a:b]:
                short = mix(short * np.uint64(5) + x)
            out.append(short)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def slices(pdf: pd.DataFrame, chars: int = 1 << 19) -> Iterator[pd.DataFrame]:
    """Parts of a batch of about ``chars`` characters, at least a row each."""
    size = pdf["text"].str.len().fillna(0).to_numpy().cumsum()
    at = 0
    while at < len(pdf):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + chars)))
        yield pdf.iloc[at:to]
        at = to


def set_keys(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, whatever its order."""
    a = np.add.reduce(mix(s)) if len(s) else np.uint64(0)
    b = np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))) if len(s) else np.uint64(0)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def ngram_jaccard_join(df: DataFrame, id_col: str = "doc_id", text: str = "text", params: JoinParams = JoinParams()) -> DataFrame:
    """One row per row of ``df``: ``id_col, n_shingles, component_id``.

    Two texts link when ``100 * |A and B| >= percent * |A or B|`` over their sets
    of shingles (words are lower-cased in A-Z and cut at ASCII white space). Null
    and empty texts have no shingles and link with nothing. ``component_id`` is
    the smallest id reachable by links. Rows that repeat an id are one document
    that has the links of each of its texts; a row with a null id links with
    nothing and has a null component. Other columns of ``df`` are not read.

    Equal sets are merged first. Shingles are ordered from rare to common; any
    two similar sets then share a shingle, or two frequent ones, among their
    first few, which are shuffled as signatures. Texts first meet a few leaders
    of their signatures; then the texts of different components that share a
    signature meet each other, a crowded signature in parts. Sizes and parity
    sketches rule pairs out before any set is fetched; what they leave is
    compared whole. Nothing is dropped: a pair within one component can add no
    link that matters, and a sketch never counts more differences than there are.
    """
    spark, p = df.sparkSession, params
    bounded_batches(spark)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))

    def survey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sets' names and sketches, and shingles common in a block of texts."""
        held: list[np.ndarray] = []
        size, seen = 0, set()

        def common() -> pd.DataFrame:
            u, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= max(4, p.common * len(held))
            return pd.DataFrame({"id": pd.array([], "Int64"), "n": pd.array([], "Int64")}).reindex(range(int(often.sum()))).assign(k1=u[often].astype(np.int64), k2=n[often], sketch=None)

        for pdf in batches:
            for part in slices(pdf):
                sets = shingle_sets(list(part["text"]), p.words)
                keys = [set_keys(s) for s in sets]
                yield pd.DataFrame({"id": part["id"].astype("Int64").array, "n": pd.array([len(s) for s in sets], "Int64"), "k1": [k[0] for k in keys], "k2": [k[1] for k in keys], "sketch": [sketch(s) for s in sets]})
                for s, k in zip(sets, keys):
                    if k not in seen:
                        seen.add(k)
                        held.append(s)
                        size += len(s)
                if size >= p.block:
                    yield common()
                    held, size = [], 0
        if held:
            yield common()

    surveyed = cut(docs.mapInPandas(survey, "id long, n long, k1 long, k2 long, sketch binary"))
    named = surveyed.where("n is not null")
    counts = cut(named.groupBy("k1", "k2", "n").agg(F.min("id").alias("rep"), F.first("sketch").alias("sketch")))
    texts = counts.count()
    table = surveyed.where("n is null").groupBy("k1").agg(F.sum("k2").alias("f")).orderBy(F.desc("f"), "k1").limit(p.table).toPandas()
    table = table.sort_values(["f", "k1"])  # rank = place in this order
    common = table["k1"].to_numpy().astype(np.int64).view(np.uint64)
    by_hash = np.argsort(common)
    first_frequent = int(np.searchsorted(table["f"].to_numpy(), max(2, p.frequent * texts)))
    shared = spark.sparkContext.broadcast((common[by_hash], by_hash.astype(np.uint64), first_frequent))

    def signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, rank, frequent = shared.value
        top, seen = np.uint64(1 << 63), set()
        for pdf in batches:
            for part in slices(pdf[pdf["id"].notna()]):
                ids, sigs, sizes = [], [], []
                for i, s in zip(part["id"], shingle_sets(list(part["text"]), p.words)):
                    k = set_keys(s)
                    if not len(s) or k in seen:
                        continue
                    seen.add(k)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        s = np.sort(np.where(known[at] == s, top | rank[at], s >> np.uint64(1)))
                    else:
                        s = s >> np.uint64(1)
                    n = len(s)
                    least = -(-p.percent * n // 100)
                    longer = s[: n - least + 2]
                    often = longer[longer >= top + np.uint64(frequent)]
                    single = longer[: len(longer) - len(often)] if len(often) else s[: n - least + 1]
                    if len(often) > 1:
                        a, b = np.triu_indices(len(often), 1)
                        single = np.r_[single, mix(often[a] * np.uint64(7) + often[b]) | np.uint64(1)]
                    ids.append(np.full(len(single), int(i)))
                    sigs.append(single.view(np.int64))
                    sizes.append(np.full(len(single), n, np.int32))
                if ids:
                    yield pd.DataFrame({"sig": np.concatenate(sigs), "id": np.concatenate(ids), "n": np.concatenate(sizes)})

    reps = cut(named.where("id is not null and n > 0").join(counts.drop("sketch"), ["k1", "k2", "n"]).select("id", "rep", "n"))
    spoken = cut(reps.groupBy("id").agg(F.min(F.col("id") != F.col("rep")).alias("copy")).where("copy").select("id"))  # another document stands for each of its sets
    sigs = cut(docs.join(bounded(spoken, p), "id", "left_anti").mapInPandas(signatures, "sig long, id long, n int").where("sig is not null"))
    twice = cut(sigs.groupBy("sig").agg(F.count("*").alias("m")).where("m > 1").select("sig"))
    rows = cut(sigs.join(bounded(twice, p), "sig").join(reps, ["id", "n"]).groupBy("sig", F.col("rep").alias("id")).agg(F.min("n").alias("n")))
    marks = cut(counts.where("n > 0").select(F.col("rep").alias("id"), "n", "sketch").join(rows.select("id", "n").distinct(), ["id", "n"]))
    for done in (sigs, twice, counts, spoken):
        drop_cut(done)
    free_shuffles(spark)

    lead = rows.groupBy("sig").agg(F.min(F.struct("n", "id")).alias("lead"), F.count("*").alias("m")).where("m > 1").select("sig", F.col("lead.id").alias("a"), F.col("lead.n").alias("na"), "m")
    lead = cut(lead)
    ends = F.struct("id", "n").alias("y")
    stars = rows.join(lead, "sig").where("id <> a").where(close("na", "n", p)).groupBy(F.struct(F.col("a").alias("id"), F.col("na").alias("n")).alias("x"), ends).agg(F.count("*").alias("votes"))
    best = possible(stars.groupBy("y").agg(F.max(F.struct("votes", "x")).alias("l")).select("l.x", "y"), marks, p)
    crowded = rows.join(lead.where(F.col("m") > p.small).select("sig", "m"), "sig").withColumn("r", F.col("id"))
    first = cut(best.union(met(crowded, marks, p, p.leaders)).distinct())
    links = verified(first, docs, p)
    drop_cut(lead)
    drop_cut(first)

    roots = components(links)
    labelled = cut(rows.join(roots.withColumnRenamed("root", "r"), "id", "left").withColumn("r", F.coalesce("r", "id")))
    mixed = labelled.groupBy("sig").agg(F.min("r").alias("x"), F.max("r").alias("y"), F.count("*").alias("m")).where("x < y").select("sig", "m")
    rest = cut(labelled.join(bounded(cut(mixed), p), "sig"))
    few = rest.where(F.col("m") <= p.small).select("sig", "id", "n", "r")
    other = few.select("sig", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("r").alias("rb"))
    across = few.join(other, "sig").where("r < rb").where(close("n", "nb", p)).select(F.struct("id", "n").alias("x"), F.struct(F.col("b").alias("id"), F.col("nb").alias("n")).alias("y")).distinct()
    near = cut(possible(across, marks, p).union(met(rest.where(F.col("m") > p.small), marks, p)).distinct())
    more = verified(near, docs, p)
    same = reps.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    final = components(links.union(more).union(same))
    for done in (rows, marks, roots, labelled, rest, near, links, more, reps):
        drop_cut(done)
    out = named.select("id", F.col("n").alias("n_shingles")).join(final, "id", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("root", "id").alias("component_id"))


def bounded(df: DataFrame, p: JoinParams) -> DataFrame:
    """``df``, of at most 16 bytes a row, broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() <= p.broadcast_ids else df


def close(n: str, m: str, p: JoinParams):
    """Sizes that a link allows."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * p.percent


def sketch(s: np.ndarray) -> bytes:
    """Parities of how many of the set's hashes fall into each cell, a bit a cell; a power of two of cells, one to two for each hash."""
    cells = 1 << min(13, max(7, int(len(s)).bit_length()))
    odd = np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def halved(x: np.ndarray) -> np.ndarray:
    """Sketches of half as many cells."""
    return x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]


def differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many hashes two sets differ at least: the odd cells of both sketches."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def apart(least: np.ndarray, n: np.ndarray, m: np.ndarray, p: JoinParams) -> np.ndarray:
    """Whether sets of sizes ``n`` and ``m`` differ in too many hashes for a link."""
    return least * (100 + p.percent) > (n + m) * (100 - p.percent)


#: Leaders, the most similar, that each text is compared with before all texts are.
NEAREST = 1


def met(rows: DataFrame, marks: DataFrame, p: JoinParams, leaders: int | None = None) -> DataFrame:
    """``a, b``: texts of a signature, in different components ``r``, that sizes and sketches allow to link.

    ``rows(sig, id, n, r, m)``: ``m`` texts share the signature and are dealt to
    parts by hash; each two parts meet in one group, whose size is bounded.
    ``leaders`` limits one side to the first of a part, in hash order, and then
    to the nearest of them: a first step that merges most, never the last.
    """
    parts = F.ceil(F.col("m") / p.square).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts")).cast("int")
    dealt = rows.join(marks, ["id", "n"]).withColumn("parts", parts).withColumn("part", own)
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda t: F.struct(F.least("part", t).alias("i"), F.greatest("part", t).alias("j")))
    cells = dealt.select("sig", F.inline(meets), "part", "id", "n", "r", F.xxhash64("id").alias("h"), "sketch")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h", kind="stable").reset_index(drop=True)
        one = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        size = pdf["sketch"].map(len).to_numpy()
        part, ids, n, r = (pdf[c].to_numpy() for c in ("part", "id", "n", "r"))
        place = np.zeros(len(pdf), np.int64)  # in its part
        for k in np.unique(part):
            place[part == k] = np.arange((part == k).sum())
        a, b, odd = [], [], []
        for length in np.unique(size):
            left = np.flatnonzero((size == length) & (place < (leaders or len(pdf))))
            for other in (length, 2 * length) if leaders is None else (length // 2, length, 2 * length):
                right = np.flatnonzero(size == other)
                if not len(left) or not len(right):
                    continue
                x, y = (np.frombuffer(b"".join(pdf["sketch"].iloc[k]), np.uint8).reshape(len(k), -1) for k in (left, right))
                x, y = (halved(x) if other < length else x).view(np.uint64), (halved(y) if other > length else y).view(np.uint64)
                for at in range(0, len(left), step := max(1, (1 << 21) // y.size)):
                    u = left[at : at + step]
                    least = differ(x[at : at + step, None], y[None])
                    fine = ~apart(least, n[u][:, None], n[right][None], p)
                    fine &= (r[u][:, None] != r[right]) & (100 * np.minimum(n[u][:, None], n[right]) >= p.percent * np.maximum(n[u][:, None], n[right]))
                    if not one:
                        fine &= part[u][:, None] != part[right]
                    i, j = np.nonzero(fine)
                    a.append(ids[u[i]])
                    b.append(ids[right[j]])
                    odd.append(least[i, j])
        if not a:
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        a, b = np.concatenate(a), np.concatenate(b)
        if leaders:
            order = np.lexsort((np.concatenate(odd), b))
            a, b = a[order], b[order]
            near = np.arange(len(b)) - np.searchsorted(b, b) < NEAREST
            a, b = a[near], b[near]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    return cells.groupBy("sig", "i", "j").applyInPandas(compare, "a long, b long")


def possible(pairs: DataFrame, marks: DataFrame, p: JoinParams) -> DataFrame:
    """``a, b``: those of ``pairs(x, y)``, texts with their sizes, that the sketches allow to link."""

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lx, ly = pdf["sx"].map(len).to_numpy(), pdf["sy"].map(len).to_numpy()
            fine = np.ones(len(pdf), bool)
            for u, v in {*zip(lx.tolist(), ly.tolist())}:
                k = np.flatnonzero((lx == u) & (ly == v))
                if max(u, v) <= 2 * min(u, v):
                    x, y = (np.frombuffer(b"".join(pdf[c].iloc[k]), np.uint8).reshape(len(k), -1) for c in ("sx", "sy"))
                    x, y = (halved(x) if u > v else x).view(np.uint64), (halved(y) if v > u else y).view(np.uint64)
                    fine[k] = ~apart(differ(x, y), pdf["nx"].to_numpy()[k], pdf["ny"].to_numpy()[k], p)
            yield pdf.loc[fine, ["a", "b"]]

    ends = marks.select("id", "n", "sketch")
    both = pairs.select(F.col("x.id").alias("a"), F.col("x.n").alias("nx"), F.col("y.id").alias("b"), F.col("y.n").alias("ny")).join(ends.toDF("a", "nx", "sx"), ["a", "nx"]).join(ends.toDF("b", "ny", "sy"), ["b", "ny"])
    return both.select("a", "b", "nx", "ny", "sx", "sy").mapInPandas(test, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def verified(pairs: DataFrame, docs: DataFrame, p: JoinParams) -> DataFrame:
    """Those of the table ``pairs(a, b)`` whose whole sets are similar enough, as a table."""
    wanted = cut(pairs.select("a").union(pairs.select("b")).distinct().toDF("id"))

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in slices(pdf):
                yield pd.DataFrame({"id": part["id"], "set": [s.tobytes() for s in shingle_sets(list(part["text"]), p.words)]})

    sets = cut(docs.join(bounded(wanted, p), "id", "left_semi").mapInPandas(fetch, "id long, set binary"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["x"], pdf["y"]):
                both = np.frombuffer(x + y, np.uint64).copy()
                both.sort(kind="stable")
                i = int((both[1:] == both[:-1]).sum())
                keep.append(100 * i >= p.percent * (len(both) - i))
            yield pdf.loc[keep, ["a", "b"]]

    left = pairs.join(sets.toDF("a", "x"), "a")
    links = cut(left.join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y").mapInPandas(compare, "a long, b long"))
    drop_cut(wanted)
    drop_cut(sets)
    free_shuffles(docs.sparkSession)
    return links
