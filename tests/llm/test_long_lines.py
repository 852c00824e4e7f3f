"""Texts of very many lines: time follows their number."""

from __future__ import annotations

import hashlib
import random
import time

from pagelens.llm import line_dedup


def test_a_hundred_thousand_lines(spark):
    """Each line stands twice in one text: the second of each goes, blank lines stay."""
    n = 50_000
    digests = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(n)]
    lines = [" ".join(d[i : i + 6] for i in range(0, 42, 6)) for d in digests]
    df = spark.createDataFrame([(1, "\n".join([*lines, "", *lines])), (2, "a line of its own that nothing repeats at all")], "doc_id long, text string")
    line_dedup.dedup_lines(df.limit(1)).count()
    began = time.time()
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert time.time() - began < 120
    assert got[1].n_lines == 2 * n + 1 and got[1].n_removed == n and got[2].n_removed == 0
    assert got[1].text == "\n".join([*lines, ""])


def test_unlike_lines_are_not_compared_whole(spark, monkeypatch):
    """Lines of hundreds or thousands of characters that share frequent words: sketches tell them apart, near copies are still found."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(5, 9)))
    often = ["considerable", "furthermore", "nevertheless", "government", "population", "university"]
    lines = [" ".join(w for _ in range(40 if k % 2 else 150) for w in (word(), word(), *rng.choices(often, k=3))) for k in range(60)]
    lines += [line.replace(line[300:303], "xyz", 1) for line in lines[:10]]
    whole, compare = [], line_dedup.linked
    monkeypatch.setattr(line_dedup, "linked", lambda pairs, texts, p: whole.append(pairs.count()) or compare(pairs, texts, p))
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id for r in line_dedup.dedup_lines(df, params=line_dedup.LineParams(minima=12)).where("n_removed = 1").collect()}
    assert got == set(range(60, 70))
    assert sum(whole) <= 30, whole
