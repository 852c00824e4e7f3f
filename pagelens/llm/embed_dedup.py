"""Near-duplicate embeddings by robust-pruned flat graphs on overlapping cluster shards."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import bounded_batches, components, cut


@dataclass(frozen=True)
class GraphParams:
    """``shard_rows``: vectors of one label a centroid stands for. ``block_rows``: the
    most a task holds, beyond which a shard is split. ``overlap``: shards of each
    vector. ``near_degree`` and ``far_degree``: edges kept inside and outside the
    range. ``alpha``: slack of the robust pruning. ``beam``: width of the greedy
    search. ``sample_rows`` and ``max_centroids`` bound what the driver fits;
    ``audit_rows`` the queries of the recall audit."""

    threshold: float = 0.93
    shard_rows: int = 1000
    block_rows: int = 3000
    overlap: int = 2
    near_degree: int = 16
    far_degree: int = 12
    alpha: float = 1.2
    beam: int = 8
    steps: int = 64
    sample_rows: int = 10_000
    max_centroids: int = 4096
    audit_rows: int = 200
    least_recall: float = 0.9


def unit(packed: pd.Series) -> np.ndarray:
    """Packed doubles as rows of length 1."""
    x = np.stack([np.frombuffer(b, "<f8") for b in packed])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def robust_prune(sims: np.ndarray, me: int, pool: np.ndarray, degree: int, alpha: float) -> list[int]:
    """Nearest of ``pool`` first; each one kept removes those ``alpha`` times nearer to it than to ``me``."""
    pool = pool[np.argsort(-sims[me, pool], kind="stable")]
    far = np.sqrt(np.maximum(0, 2 - 2 * sims[me, pool]))
    kept: list[int] = []
    while len(pool) and len(kept) < degree:
        p = pool[0]
        kept.append(int(p))
        stay = alpha * np.sqrt(np.maximum(0, 2 - 2 * sims[p, pool])) > far
        stay[0] = False
        pool, far = pool[stay], far[stay]
    return kept


def build_graph(x: np.ndarray, p: GraphParams) -> list[list[int]]:
    """Adjacency of one shard: pruned edges inside the range, pruned edges to the rest, and their reverses."""
    sims = (x @ x.T).astype(np.float32)
    n = len(x)
    adjacent: list[list[int]] = []
    for i in range(n):
        near = sims[i] >= p.threshold - 1e-4
        near[i] = False
        rest = ~near
        rest[i] = False
        pool = np.flatnonzero(rest)
        if len(pool) > 256:  # the nearest, where pruning chooses from
            pool = pool[np.argpartition(-sims[i, pool], 255)[:256]]
        adjacent.append(robust_prune(sims, i, np.flatnonzero(near), p.near_degree, p.alpha) + robust_prune(sims, i, pool, p.far_degree, p.alpha))
    for i, own in enumerate([list(a) for a in adjacent]):
        for j in own:
            if len(adjacent[j]) < 2 * (p.near_degree + p.far_degree):
                adjacent[j].append(i)
    return [sorted(set(a)) for a in adjacent]


def medoids(x: np.ndarray, k: int = 4) -> np.ndarray:
    """Start points: the vector nearest to the mean, then those farthest from the ones chosen."""
    chosen = [int(np.argmax(x @ x.mean(axis=0)))]
    nearest = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    return np.unique(chosen)


def range_search(x: np.ndarray, offsets: np.ndarray, targets: np.ndarray, q: np.ndarray, own: np.ndarray, p: GraphParams) -> Iterator[tuple[int, np.ndarray]]:
    """For each query row its neighbours in range: greedy search from the medoids, then expansion of whatever lies in range.

    ``own`` is the query's place in the graph or -1; its node is a further start
    for the expansion should the greedy walk have missed it.
    """
    starts, n = medoids(x), len(x)
    degree = np.diff(offsets)

    for at in range(0, len(q), 128):
        qs = q[at : at + 128]
        m = len(qs)
        seen = np.full((m, n), -np.inf)
        opened = np.zeros((m, n), bool)

        def look(rows: np.ndarray, nodes: np.ndarray) -> None:
            flat = np.unique(rows * n + nodes)
            rows, nodes = flat // n, flat % n
            new = np.isneginf(seen[rows, nodes])
            rows, nodes = rows[new], nodes[new]
            for a in range(0, len(rows), 1 << 16):
                r, c = rows[a : a + (1 << 16)], nodes[a : a + (1 << 16)]
                seen[r, c] = np.einsum("ij,ij->i", qs[r], x[c])

        def expand(rows: np.ndarray, nodes: np.ndarray) -> None:
            opened[rows, nodes] = True
            d = degree[nodes]
            first = np.repeat(offsets[nodes] - np.r_[0, np.cumsum(d)[:-1]], d)
            look(np.repeat(rows, d), targets[first + np.arange(d.sum())])

        look(np.repeat(np.arange(m), len(starts)), np.tile(starts, m))
        live = np.arange(m)
        for _ in range(p.steps):
            scores = seen[live]
            fresh = np.where(opened[live], -np.inf, scores)
            best = fresh.argmax(axis=1)
            top = fresh[np.arange(len(live)), best]
            limit = -np.partition(-scores, min(p.beam, n) - 1, axis=1)[:, min(p.beam, n) - 1]
            go = (top > -np.inf) & (top >= limit)
            live, best = live[go], best[go]
            if not len(live):
                break
            expand(live, best)
        mine = own[at : at + m]
        look(np.flatnonzero(mine >= 0), mine[mine >= 0])
        while True:
            rows, nodes = np.nonzero((seen >= p.threshold) & ~opened)
            if not len(rows):
                break
            expand(rows, nodes)
        for k in range(m):
            hits = np.flatnonzero(seen[k] >= p.threshold)
            yield at + k, hits[hits != mine[k]]


def fit_centroids(vectors: DataFrame, p: GraphParams, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on a bounded sample; as many centroids as the largest label needs, at most ``max_centroids``."""
    sizes = vectors.groupBy("label", "dim").count().agg(F.max("count"), F.sum("count")).first()
    k = min(p.max_centroids, -(-(sizes[0] or 0) // p.shard_rows))
    if k < 2:
        return np.empty((0, 0))
    share = min(1.0, p.sample_rows / sizes[1])
    sample = vectors.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < int((1 << 20) * share)).select("rep", "dim", "vec").toPandas().sort_values("rep")
    sample = sample[sample["dim"] == sample["dim"].mode()[0]] if len(sample) else sample
    if len(sample) < k:
        return np.empty((0, 0))
    x = unit(sample["vec"])
    c = x[np.random.default_rng(7).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[a : a + 2048] @ c.T).argmax(axis=1) for a in range(0, len(x), 2048)])
        for j in range(k):
            if (near == j).any():
                mean = x[near == j].sum(axis=0)
                c[j] = mean / max(np.linalg.norm(mean), 1e-12)
    return c


def doubles(embedding: Column) -> Column:
    return F.transform(embedding, lambda v: v.cast("double"))


def packed_vectors(df: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """``id, label, dim, vec``: usable vectors packed as doubles, others with a null ``vec``."""
    v = doubles(F.col(vector))
    fine = F.col(id_col).isNotNull() & F.col(label).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = df.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.when(F.coalesce(fine, F.lit(False)), v).alias("v"))

    @F.pandas_udf("binary")
    def pack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vs in batches:
            yield pd.Series([None if x is None else np.asarray(x, "<f8").tobytes() for x in vs], dtype=object)

    return rows.select("id", "label", F.size("v").alias("dim"), pack("v").alias("vec"))


def near_duplicate_embeddings(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", params: GraphParams = GraphParams()) -> DataFrame:
    """One row per vector: ``id, n_links, component_id, kept``.

    Two vectors of equal, non-null label and dimension are linked when their
    cosine in double precision is at least ``threshold``. A vector that is null,
    empty, zero or holds null or non-finite components, or whose id or label is
    null, links with nothing and is its own component. Equal vectors are
    collapsed to one node with a count first, so a hot vector costs one node.

    Each node joins the shards of its ``overlap`` nearest centroids; shards over
    ``block_rows`` are split into blocks whose queries visit every block. Every
    shard gives pruned adjacency lists; the lists of a node are united; each
    node is searched in its home shard. Links are verified by exact cosines and
    leave a task as counts and a spanning forest, never as pairs. A bounded
    audit always compares with brute force; below ``least_recall`` the overlap
    doubles, and where every vector is in every shard already the call fails.
    """
    bounded_batches(df.sparkSession)
    p = params
    rows = cut(packed_vectors(df, id_col, vector, label).withColumn("key", F.when(F.col("vec").isNotNull(), F.sha2(F.concat_ws("|", F.col("label").cast("string"), F.hex("vec")), 256))))
    nodes = cut(rows.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("vec").alias("vec")))
    centroids = fit_centroids(nodes, p)
    overlap = p.overlap
    while True:
        linked, forest = search_shards(nodes, centroids, overlap, p)
        recall = audit_recall(nodes, linked, p)
        if recall >= p.least_recall:
            break
        if overlap >= len(centroids):
            raise RuntimeError(f"the graph search finds {recall:.3f} of the links, less than {p.least_recall}")
        overlap *= 2
    roots = components(forest)
    per_node = nodes.select("key", "rep", "copies").join(linked, "rep", "left").join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    per_node = per_node.select("key", (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    joined = rows.select("id", "key").join(per_node, "key", "left")
    return joined.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").cast("long").alias("component_id")).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def assign_shards(nodes: DataFrame, centroids: np.ndarray, overlap: int) -> DataFrame:
    """``nodes`` with ``shards``, the nearest centroids, the home shard first."""
    shared = nodes.sparkSession.sparkContext.broadcast(centroids)

    @F.pandas_udf("array<int>")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = shared.value
        for vs in batches:
            out = []
            for a in range(0, len(vs), 512):
                for b in vs.iloc[a : a + 512]:
                    if not len(c) or len(b) != 8 * c.shape[1]:
                        out.append([0])
                        continue
                    x = np.frombuffer(b, "<f8")
                    s = c @ (x / np.abs(x).max())
                    k = min(overlap, len(s))
                    top = np.argpartition(-s, k - 1)[:k]
                    out.append(top[np.argsort(-s[top], kind="stable")].tolist())
            yield pd.Series(out, dtype=object)

    return nodes.withColumn("shards", nearest("vec"))


def search_shards(nodes: DataFrame, centroids: np.ndarray, overlap: int, p: GraphParams) -> tuple[DataFrame, DataFrame]:
    """``(rep, found)``: linked copies of other vectors; ``(a, b)``: a spanning forest of the links."""
    placed = cut(assign_shards(nodes.select("rep", "label", "dim", "copies", "vec"), centroids, overlap))
    member = placed.select("*", F.posexplode("shards").alias("rank", "shard")).drop("shards")
    sizes = member.groupBy("label", "dim", "shard").agg(F.ceil(F.count("*") / p.block_rows).cast("int").alias("blocks"))
    member = cut(member.join(sizes, ["label", "dim", "shard"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")))
    block = ["label", "dim", "shard", "block"]

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        ids = pdf["rep"].to_numpy()
        graph = build_graph(unit(pdf["vec"]), p)
        return pd.DataFrame({"rep": ids, "near": [ids[a].tolist() for a in graph]})

    lists = member.groupBy(*block).applyInPandas(build, "rep long, near array<long>")
    united = lists.groupBy("rep").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"))  # overlap lists a node at most
    graph = member.join(united, "rep")
    as_node = graph.select(*block, "rep", "copies", "vec", "near", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("query_block"))
    nothing = F.array().cast("array<bigint>")
    as_query = member.where("rank = 0").select("label", "dim", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "rep", "copies", "vec", nothing.alias("near"), F.lit(True).alias("asks"), F.col("block").alias("query_block"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf[~pdf["asks"]].sort_values("rep")
        q = pdf[pdf["asks"]].sort_values("rep")
        ids, qids = g["rep"].to_numpy(), q["rep"].to_numpy()
        if not len(g) or not len(q):
            return pd.DataFrame({"rep": [], "found": [], "a": [], "b": []})
        x, copies = unit(g["vec"]), g["copies"].to_numpy()
        local = [np.searchsorted(ids, near) for near in g["near"]]
        local = [t[(t < len(ids)) & (ids[np.minimum(t, len(ids) - 1)] == np.asarray(near))] for t, near in zip(local, g["near"])]
        offsets = np.r_[0, np.cumsum([len(t) for t in local])]
        own = np.searchsorted(ids, qids)
        own = np.where(ids[np.minimum(own, len(ids) - 1)] == qids, np.minimum(own, len(ids) - 1), -1)
        names = np.union1d(ids, qids)
        parent = np.arange(len(names))
        spot, qspot = np.searchsorted(names, ids), np.searchsorted(names, qids)

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        found = np.zeros(len(q), np.int64)
        for k, hits in range_search(x, offsets, np.concatenate(local).astype(np.int64), unit(q["vec"]), own, p):
            found[k] = copies[hits].sum()
            roots = {root(qspot[k])} | {root(i) for i in np.unique(parent[spot[hits]])}
            for r in roots:
                parent[r] = min(roots)
        top = np.array([root(i) for i in range(len(names))])
        moved = np.flatnonzero(top != np.arange(len(names)))
        return pd.concat([pd.DataFrame({"rep": qids, "found": found}), pd.DataFrame({"a": names[moved], "b": names[top[moved]]})]).astype({"rep": "Int64", "found": "Int64", "a": "Int64", "b": "Int64"})

    result = cut(as_node.unionByName(as_query).groupBy("label", "dim", "shard", "block", "query_block").applyInPandas(search, "rep long, found long, a long, b long"))
    return result.where("rep is not null").groupBy("rep").agg(F.sum("found").alias("found")), result.where("a is not null").select("a", "b")


def audit_recall(nodes: DataFrame, linked: DataFrame, p: GraphParams) -> float:
    """Links found by the search over those that brute force finds, for a bounded set of queries against all rows."""
    picked = nodes.where("rep % 20 = 0").orderBy(F.xxhash64("rep")).limit(p.audit_rows).select("rep", "label", "vec").toPandas()
    if not len(picked):
        return 1.0
    shared = nodes.sparkSession.sparkContext.broadcast(picked)

    def brute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qs = shared.value
        for pdf in batches:
            for (lab, size), group in qs.groupby(["label", qs["vec"].map(len)]):
                rows = pdf[(pdf["label"] == lab) & (pdf["vec"].map(len) == size)]
                if len(rows):
                    hit = (unit(group["vec"]) @ unit(rows["vec"]).T >= p.threshold) & (group["rep"].to_numpy()[:, None] != rows["rep"].to_numpy())
                    yield pd.DataFrame({"rep": group["rep"], "true": hit @ rows["copies"].to_numpy()})

    true = nodes.select("rep", "label", "vec", "copies").mapInPandas(brute, "rep long, true long").groupBy("rep").agg(F.sum("true").alias("true"))
    got = true.join(linked, "rep", "left").agg(F.sum(F.least("found", "true")), F.sum("true")).first()
    return 1.0 if not got[1] else (got[0] or 0) / got[1]
