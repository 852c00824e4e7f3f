"""Phrases, repeated passages and whitening against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagelens.llm import phrases, substring_dedup, whitening

CLASHES = "key f n a l r lang rank phrase score head rest k part own shift words lead at carved v d i j p s both id copied first weight".split()


def with_clashes(df, *own):
    return df.withColumns({c: F.lit(7) for c in CLASHES if c not in own})


# phrases


def phrases_by_hand(rows, words, least, inside, top):
    counts = defaultdict(Counter)
    totals = Counter()
    for text, lang in rows:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            totals[lang or "und"] += len(w)
            for n in range(1, words + 1):
                counts[lang or "und"].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        good = {p: a for p, a in f.items() if len(p) >= 2 and a >= least}
        held = []
        for p, a in good.items():
            if any(len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in good.items()):
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            held.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(held)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def phrase_rows():
    rng = random.Random(3)
    vocabulary = ["alpha", "Beta", "gamma", "délta", "É", "x y", "zeta"]
    rows = []
    for k in range(120):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t ", ", ", ".\r\n", "\x0b"]) for _ in range(rng.randrange(0, 40)))
        rows.append((text, rng.choice(["en", "de", None, "a\nb"])))
    return [*rows, (None, "en"), ("", "en"), rows[0], rows[0], ("alpha gamma " * 4000, "en"), ("!?.,", "fr")]


@pytest.mark.parametrize("words,top", [(2, 1000), (3, 25), (4, 1000)])
def test_phrases_agree_with_brute_force(spark, words, top):
    rows = phrase_rows()
    df = with_clashes(spark.createDataFrame([(t, g) for t, g in rows], "text string, lang string"), "lang")
    got = phrases.mine_phrases(df, params=phrases.PhraseParams(words=words, least=4, top=top, chunk=2000))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == phrases_by_hand(rows, words, 4, 50, top)


def test_a_saturated_filter_changes_nothing(spark):
    rows = phrase_rows()
    df = spark.createDataFrame(rows, "text string, lang string")
    got = phrases.mine_phrases(df, params=phrases.PhraseParams(least=4, filter_bits=5))
    assert sorted(map(tuple, got.collect())) == phrases_by_hand(rows, 3, 4, 50, 2000)


def test_phrases_of_nothing(spark):
    assert phrases.mine_phrases(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert phrases.mine_phrases(spark.createDataFrame([("a b", "en")], "text string, lang string")).count() == 0


def test_scores_beyond_64_bits(spark):
    """A million squared occurrences times a million: the product needs 80 bits."""
    df = spark.range(40).select(F.repeat(F.lit("p q. "), 50_000).alias("text"), F.lit("en").alias("lang"))
    (row,) = phrases.mine_phrases(df).collect()
    assert (row.phrase, row.a, row.l, row.r, row.n, row.score) == ("p q", 2_000_000, 2_000_000, 2_000_000, 4_000_000, 1_000_000)


# repeated passages


def passages_by_hand(texts, length):
    split = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in split for i in range(len(w) - length + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        out.append((len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def passage_texts():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)] + ["É", "x y"]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = [some(n) for n in (34, 35, 36, 60, 120)]
    texts = []
    for k in range(150):
        words = some(rng.randrange(0, 60))
        for _ in range(rng.randrange(0, 3)):
            words += rng.choice(shared) + some(rng.randrange(0, 30))
        texts.append(" \n\t".join(words))
    near = some(200)
    for k in range(20):
        copy = list(near)
        copy[rng.randrange(200)] = "edit"
        texts.append(" ".join(copy))
    return [*texts, None, "", texts[3], texts[3], texts[3], "tick tock " * 400, "same " * 34, "other " * 36, " ".join(some(40) * 2), " ".join(shared[1]), " ".join(shared[0])]


@pytest.mark.parametrize("crowd", [4096, 3])
def test_passages_agree_with_brute_force(spark, crowd):
    """Also where almost every anchor is crowded, and where shards are small."""
    texts = passage_texts()
    df = with_clashes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    done = substring_dedup.remove_repeated_passages(df, params=substring_dedup.PassageParams(crowd=crowd, shard=16))
    got = {r["doc_id"]: r for r in done.collect()}
    want = passages_by_hand(texts, 35)
    assert [(got[k].n_words, got[k].n_removed, got[k].kept) for k in range(len(texts))] == want
    assert all(sum(s.z - s.a for s in r.spans) == r.n_removed for r in got.values())


def test_passages_of_repeated_and_null_ids(spark):
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(1, text), (1, text), (None, text + " end"), (None, None), (2, "start " + text), (2, "a b")]
    got = substring_dedup.remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(1, 50, 50, ""), (1, 50, 50, ""), (None, 51, 50, "end"), (None, 0, 0, ""), (2, 51, 50, "start"), (2, 2, 0, "a b")]))
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.remove_repeated_passages(none).count() == 0


def test_automaton_counts_every_string():
    rng = random.Random(1)
    for _ in range(200):
        texts = [[rng.randrange(3) for _ in range(rng.randrange(1, 12))] for _ in range(rng.randrange(1, 5))]
        weights = [rng.randrange(1, 3) for _ in texts]
        machine = substring_dedup.SuffixAutomaton()
        for t, w in zip(texts, weights):
            machine.add(t, w)
        machine.finish()
        times = Counter()
        for t, w in zip(texts, weights):
            for a in range(len(t)):
                for z in range(a + 1, len(t) + 1):
                    times[tuple(t[a:z])] += w
        probe = [rng.randrange(4) for _ in range(15)]
        for t in (*texts, probe):
            want = [max((n for n in range(z + 1) if times[tuple(t[z - n : z])] >= 2), default=0) for z in range(1, len(t) + 1)]
            assert list(machine.statistics(t)) == want


# whitening


def vectors():
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 12)) * np.linspace(3, 0.2, 12) @ rng.standard_normal((12, 12))
    return base.astype(np.float32)


def test_whitening_against_numpy(spark):
    v = vectors()
    odd = [None, [], [float("nan")] * 12, [float("inf")] + [0.0] * 11, [None] + [0.0] * 11, [1.0, 2.0]]
    rows = [(k, x) for k, x in enumerate([*v.tolist(), *odd, v[0].tolist()])]
    df = with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    fit = whitening.fit_whitening(df)
    done = whitening.whiten(df, fit)
    got = {r.vec_id: r for r in done.collect()}
    used = [*range(300), 306]
    assert sorted(got) == used
    x = np.floor(1024 * np.array([rows[k][1] for k in used], np.float32).astype(float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    y = (n * x - s) / n
    cov = y.T @ y / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1][:8], q[:, ::-1][:, :8]
    assert fit.n == n and fit.total == s.tolist() and np.isclose(fit.trace, np.trace(cov), rtol=1e-12)
    assert np.allclose(fit.values, e, rtol=1e-12)
    want = y @ q / np.sqrt(e)
    have = np.array([got[k].whitened for k in used])
    signs = np.sign((want * have).sum(0))
    assert np.allclose(have * signs, want, atol=1e-9)
    assert [int(got[k].deviation) for k in used] == [sum(int(t) ** 2 for t in row) for row in (n * x - s).tolist()]
    assert whitening.identity_error(done) < 1e-9


def test_whitening_without_variance(spark):
    """A constant dimension has no component; equal rows have none at all; nothing stays nothing."""
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(5)], "vec_id long, embedding array<double>")
    rows = whitening.whiten(same, whitening.fit_whitening(same)).collect()
    assert all(r.whitened == [None, None] and r.deviation == 0 for r in rows)
    flat = spark.createDataFrame([(k, [float(k), 2.0]) for k in range(5)], "vec_id long, embedding array<double>")
    rows = whitening.whiten(flat, whitening.fit_whitening(flat)).collect()
    assert all(r.whitened[0] is not None and r.whitened[1] is None for r in rows)
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert whitening.fit_whitening(none) is None and whitening.whiten(none, None).count() == 0


def test_deviation_beyond_64_bits(spark):
    rows = [(0, [2.0**39]), (1, [-(2.0**39)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whiten(df, whitening.fit_whitening(df)).collect()
    x = [1024 * int(v[0]) + 100_000 for _, v in rows]
    assert sorted(int(r.deviation) for r in got) == sorted((2 * t - sum(x)) ** 2 for t in x)


@pytest.mark.parametrize("d", [1, 2, 3, 40])
@pytest.mark.parametrize("kind", ["random", "identity", "zero", "clusters"])
def test_components_against_numpy(d, kind):
    rng = np.random.default_rng(d)
    a = rng.standard_normal((d, d))
    q, _ = np.linalg.qr(a)
    v = {"random": a @ a.T, "identity": 3 * np.eye(d), "zero": np.zeros((d, d)), "clusters": (q * np.r_[np.full(min(5, d), 7.0), np.full(max(0, d - 5), 1.0)]) @ q.T}[kind]
    v = (v + v.T) / 2
    values, vectors = whitening.leading_components(v, 8)
    size = max(1.0, np.abs(v).max())
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:8], atol=1e-12 * size * d)
    assert np.allclose(vectors @ vectors.T, np.eye(len(vectors)), atol=1e-12)
    assert np.allclose(v @ vectors.T, vectors.T * values, atol=1e-11 * size)
