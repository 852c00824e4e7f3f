"""Nulls, empty and repeated rows, ties, empty tables and clashing columns, for every operator."""

from __future__ import annotations

import hashlib
import os
import sys

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pagelens.llm import bpe, decontam, embed_dedup, html_extract, langid, line_dedup, ngram_join, pii, quality, suffix_dedup

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
#: Names that the operators use inside, or that their outputs bear.
CLASHES = "id th h f a b n r m sig rep pos line band judged bpe score lang_pred n_lines n_removed line_id line_th line_gone leaks p y __id __th __p __r".split()
TEXT = "the quick brown fox jumps over the lazy dog while the sun sets behind the far blue hills of the north"


def frame(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit(7) for c in CLASHES})


def rows():
    return [(1, TEXT), (1, TEXT), (2, TEXT), (3, None), (4, ""), (None, TEXT), (5, TEXT + " " + TEXT), (6, "\n\n" + TEXT + "\n" + TEXT), (7, "x")]


OPERATORS = {
    "bpe": lambda df: bpe.bpe_round_trip(df, RANKS, PATTERN),
    "ngram": lambda df: ngram_join.ngram_jaccard_join(df),
    "html": lambda df: html_extract.extract_main_text(df, html="text", out="main"),
    "leaks": lambda df: decontam.add_leaks(df, df.sparkSession.createDataFrame([(1, TEXT), (1, TEXT), (2, None), (None, "y"), (3, "")], "item_id long, text string"), out="found"),
    "pii": lambda df: pii.redact_pii(pii.find_pii(df)),
    "lines": lambda df: line_dedup.dedup_lines(df),
    "quality": lambda df: quality.score_quality(df, quality.fit_quality_model(df.select("doc_id", "text"), df.select("doc_id", F.lit(1).alias("quality")))),
    "language": lambda df: langid.predict_language(df, langid.fit_language_model(df.withColumn("lang", F.lit("en")))),
    "repeats": lambda df: suffix_dedup.remove_repeats(df),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_clashing_columns(spark, name):
    """Every row comes back, whatever other columns are called; rows that repeat get equal results."""
    out = OPERATORS[name](frame(spark, rows()))
    got = [r.asDict() for r in out.collect()]
    assert len(got) == len(rows())
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows())
    same = [{k: str(v) for k, v in r.items()} for r in got if r["doc_id"] == 1]
    assert same[0] == same[1]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    df = frame(spark, rows()).where("doc_id > 100")
    assert OPERATORS[name](df).count() == 0


def test_embeddings_edges(spark):
    schema = "vec_id long, embedding array<float>, label int, id int, key string"
    v = [1.0, 0.0]
    df = spark.createDataFrame([(1, v, 0, 9, "k"), (2, v, 0, 9, "k"), (3, None, 0, 9, "k"), (4, [], 0, 9, "k"), (5, [0.0, 0.0], 0, 9, "k"), (6, v, None, 9, "k"), (7, [None, 1.0], 0, 9, "k"), (8, [1.0, 0.0, 0.0], 0, 9, "k")], schema)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicate_embeddings(df).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), **{i: (0, i, True) for i in range(3, 9)}}
    assert embed_dedup.near_duplicate_embeddings(df.where("vec_id > 100")).count() == 0


def test_line_recall(spark):
    """Lines of 14 words with one word changed, against brute force over 5-character shingles."""
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 10))) for _ in range(800)]
    lines = []
    for _ in range(120):
        base = list(rng.choice(vocabulary, 14))
        lines.append(" ".join(base))
        for _ in range(2):
            other = list(base)
            other[rng.integers(14)] = rng.choice(vocabulary)
            lines.append(" ".join(other))
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} for t in lines]
    root = list(range(len(lines)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = {i for i in range(len(lines)) if find(i) != i}
    done = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    got = {r.doc_id for r in done.where("n_removed > 0").collect()}
    assert got <= want and len(got) >= 0.95 * len(want)


def test_crowded_group_of_near_copies(spark):
    """A signature that many near copies share, of which only some link: cells of small squares lose none."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 7))
    base = [word() for _ in range(80)]
    texts = []
    for _ in range(150):
        t = list(base)
        for k in rng.choice(80, rng.integers(0, 4), replace=False):
            t[k] = word()
        texts.append(" ".join(t))
    from tests.llm.test_llm import jaccard_components

    n, root = jaccard_components(texts, 4, 85)
    assert 10 < len(set(root)) < 140
    p = ngram_join.JoinParams(small=4, square=16, leaders=2)
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), params=p).orderBy("doc_id").collect()
    assert [r.n_shingles for r in got] == n and [r.component_id for r in got] == root


def removed(texts, length=100):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if b[k : k + length] in seen:
                gone[k : k + length] = True
            seen.add(b[k : k + length])
        out.append((len(b), int(gone.sum()), np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


@pytest.mark.parametrize("crowd", [3, 2048])
def test_hot_passage_in_many_surroundings(spark, crowd):
    """A passage of 70 bytes is no repeat by itself, but crowds bins; longer ones are, with or without a shared neighbour."""
    rng = np.random.default_rng(3)
    text = lambda n: "".join(rng.choice(list("abcdefghij "), n))
    hot, long = text(70), text(130)
    texts = [text(60) + hot + text(60) for _ in range(40)] + [text(30) + long + text(40) for _ in range(6)] + ["z" * 400, "y" * 40 + hot + "q" * 60, "y" * 40 + hot + "q" * 60 + "!"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df, params=suffix_dedup.RepeatParams(crowd=crowd)).collect()}
    assert got == dict(enumerate(removed(texts)))


def test_long_texts(spark):
    """A text of a megabyte goes through whole."""
    rng = np.random.default_rng(1)
    long = " ".join("".join(x) for x in rng.choice(list("abcdefghijklm"), (150_000, 6)))
    df = spark.createDataFrame([(1, long), (2, long + " tail"), (3, "mail a@b.de " * 20_000), (4, "short text of a few plain words")], "doc_id long, text string")
    coded = {r.doc_id: r for r in bpe.bpe_round_trip(df, RANKS, PATTERN).select("doc_id", "decoded").collect()}
    assert hashlib.sha256(bytes(coded[2].decoded)).hexdigest() == hashlib.sha256((long + " tail").encode()).hexdigest()
    assert {r.doc_id: r.n for r in pii.find_pii(df).select("doc_id", F.size("pii").alias("n")).collect()} == {1: 0, 2: 0, 3: 20_000, 4: 0}
    assert [r.component_id for r in ngram_join.ngram_jaccard_join(df.where("doc_id <> 3")).orderBy("doc_id").collect()] == [1, 1, 4]
    kept = {r.doc_id: len(r.kept) for r in suffix_dedup.remove_repeats(df.where("doc_id <> 3")).collect()}
    assert kept == {1: len(long), 2: 5, 4: 31}


def test_paraphrased_leaks(spark):
    """Items of 40 words with every fifth word replaced, in long texts, and clean texts."""
    rng = np.random.default_rng(2)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(4000)]
    word = lambda n: list(rng.choice(vocabulary, n))
    items = [word(40) for _ in range(30)]
    texts = []
    for item in items:
        other = [rng.choice(vocabulary) if rng.random() < 0.2 else w for w in item[:32]] + item[32:]
        texts.append(" ".join(word(120) + other + word(90)))
    clean = [" ".join(word(200)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts + clean)), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    found = {r.doc_id: [x.item_id for x in r.leaks] for r in decontam.add_leaks(df, bench).collect()}
    assert sum(found[i] == [i] for i in range(30)) >= 28
    assert all(found[i] == [] for i in range(30, 90))


def test_deep_and_odd_pages():
    for page, want in (("<div>" * 50_000 + "<p>in the deep" + "</div>" * 50_000, "in the deep"), ("<b>" * 20_000 + "<p>x y" + "</i>" * 20_000, "x y"), ("&lt;a&gt; &eacute;&#8364;", "<a> é€"), ("<!-- no --><script>no</script>", ""), ("  \n ", "")):
        assert html_extract.main_text(page) == want
    long = "A long sentence of the article, with commas, and with more words than a menu has."
    assert html_extract.main_text(f"<article><h1>T</h1><p>{long}</p><p class='related-note'>{long} Two</p><div class='comments'><p>{long} Three</p></div></article>") == f"T\n\n{long}\n\n{long} Two"
    assert html_extract.main_text(f"<body><div class='post-content widget'><p>{long}</p><p>{long} Two</p></div><aside><p>{long} Three</p></aside></body>") == f"{long}\n\n{long} Two"


def test_pipeline(spark, tmp_path):
    """Each stage on a small folder, against plain Python."""
    import corpus_pipeline

    rng = np.random.default_rng(4)
    english = "the of and to in that is was for with as on at by from they this have not are but were".split()
    german = "der die und nicht ist das ein eine mit auf dem sich auch als nach wie wir bei aus noch".split()
    said = lambda words, n: " ".join(rng.choice(words, n)) + " " + " ".join("".join(x) for x in rng.choice(list("abcdefgh"), (n, 6)))
    texts = [said(english if i % 2 else german, 40) for i in range(40)]
    item = " ".join("".join(x) for x in rng.choice(list("klmnopqr"), (30, 6)))
    license_line = "this line of the license is found in many of the documents here"
    docs = [(i, t + ("\n" + license_line if i in (3, 9) else ""), "en" if i % 2 else "de", "s", len(t)) for i, t in enumerate(texts)]
    docs += [(40, None, None, "s", 0), (41, "12345 !!", "en", "s", 8), (42, texts[5] + " tail", "en", "s", 1), (43, texts[7][:200] + " " + item + " " + said(english, 30), "en", "s", 1), (44, texts[11].replace(" ", "\n"), "en", "s", 1)]
    folder = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    seen, at = [], spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, folder)
        at.write.parquet(f"{folder}/{name}")
        at = spark.read.parquet(f"{folder}/{name}")
        seen.append({r.doc_id: r for r in at.collect()})
    language, lines, near, clean, coded = seen
    assert set(language) == set(range(40)) | {42, 43, 44}
    assert license_line in lines[3].text and lines[9].text == texts[9] and lines[9].n_chars == len(texts[9])
    assert set(lines) == set(language) - {42}  # its only line is nearly that of another document
    assert set(near) == set(lines) - {44} and set(clean) == set(near) - {43} and set(coded) == set(clean)
    enc = bpe.encoding(bpe.read_ranks(RANKS), PATTERN)
    assert all(np.frombuffer(bytes(r.token_ids), "<u4").tolist() == enc.encode_ordinary(clean[i].text) for i, r in coded.items())
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()) == sorted(coded)
