"""Decontamination: passes over the texts, and what they count."""

import numpy as np
import pandas as pd

from pagelens.llm import decontam


def some_texts(n: int) -> list[str]:
    rng = np.random.default_rng(5)
    return [" ".join(f"w{k}" for k in rng.zipf(1.4, rng.integers(0, 90)) % 60) for _ in range(n)]


def test_pairs_of_words_equal_passages_multiplied(spark):
    p, texts = decontam.LeakParams(), some_texts(40)
    weight = np.linspace(0.1, 3, p.buckets)
    known = [np.unique(decontam.tokens([" ".join(f"w{k}" for k in range(a, b))]).hash) for a, b in ((0, 30), (20, 61))]
    got = decontam.co_occurrences(spark.createDataFrame([(t,) for t in [*texts, None, ""]], "text string").repartition(3), known, weight, p)
    for k, square in zip(known, got):
        np.testing.assert_allclose(square, decontam.product(texts, np.eye(len(k)), k, weight, p), rtol=1e-4, atol=1e-6)


def test_passes_do_not_follow_the_items(spark, monkeypatch):
    items = [t for t in some_texts(30) if len(t.split()) > 40]
    docs = spark.createDataFrame(pd.DataFrame({"doc_id": range(len(items)), "text": [f"before {t} after" for t in items]}))
    bench = spark.createDataFrame(pd.DataFrame({"item_id": range(len(items)), "text": items}))
    passes, real = [], type(docs).mapInPandas
    monkeypatch.setattr(type(docs), "mapInPandas", lambda self, *a, **b: passes.append(1) or real(self, *a, **b))
    done = decontam.add_leaks(docs, bench, params=decontam.LeakParams(rank=8)).collect()
    assert len(passes) == 2
    assert all(r["doc_id"] in [x["item_id"] for x in r["leaks"]] for r in done)


def test_items_are_found_in_a_large_corpus(spark, monkeypatch):
    """The texts' products as those of a corpus 1,000,000 times as large: their structure must not crowd the items out."""
    items = [t for t in some_texts(30) if len(t.split()) > 40]
    docs = spark.createDataFrame(pd.DataFrame({"doc_id": range(60), "text": [f"{a} {b}" for a, b in zip(items * 9, some_texts(60))]}))
    bench = spark.createDataFrame(pd.DataFrame({"item_id": range(len(items)), "text": items}))
    real = decontam.co_occurrences
    monkeypatch.setattr(decontam, "co_occurrences", lambda *a: [1e6 * x for x in real(*a)])
    done = decontam.add_leaks(docs, bench, params=decontam.LeakParams(rank=12)).orderBy("doc_id").collect()
    assert all(r["doc_id"] % len(items) in [x["item_id"] for x in r["leaks"]] for r in done)
