"""Operators on small inputs, against brute force, round trips and held-out rows."""

from __future__ import annotations

import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pagelens.llm import bpe, decontam, embed_dedup, html_extract, langid, line_dedup, ngram_join, pii, quality, suffix_dedup
from pagelens.llm.common import components

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
ODD = [None, "", " ", "a", "naïve — 日本語 🙂\n\n  x", "word " * 30_000, " " * 9000 + "x", "x" * 70_000]


def docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_bpe_round_trip(spark):
    enc = bpe.encoding(bpe.read_ranks(RANKS), PATTERN)
    rows = bpe.bpe_decode(bpe.bpe_encode(docs(spark, ODD), RANKS, PATTERN), RANKS, PATTERN).withColumn("ids", bpe.unpack_ids(F.col("token_ids"))).orderBy("doc_id").collect()
    for r, t in zip(rows, ODD):
        assert bytes(r.decoded) == (t or "").encode()
        if t and len(t) < 100:
            assert list(r.ids) == enc.encode_ordinary(t)
    assert bpe.encode_text(enc, PATTERN, ODD[5]) == enc.encode_ordinary(ODD[5])


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (None, 5), (7, 7)], "a long, b long")
    got = {r.id: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components(edges.where("a < 0")).count() == 0


def jaccard_components(texts, k, percent):
    sets = []
    for t in texts:
        w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    return [len(s) for s in sets], root


def test_ngram_join(spark):
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice(["alpha", "beta", "gam", "de", "eps", "zeta", "eta"], 60)) for _ in range(12)]
    texts = [None, "", "one two", "ONE two"] + base + [b + " tail" for b in base[:5]] + [b.replace("alpha", "other", 1) for b in base[:5]] + base[:3]
    got = ngram_join.ngram_jaccard_join(docs(spark, texts)).orderBy("doc_id").collect()
    n, root = jaccard_components(texts, 4, 85)
    assert [r.n_shingles for r in got] == n
    assert [r.component_id for r in got] == root


def test_html_extraction():
    page = "<html><head><title>t</title></head><body><nav><a href='/'>Home</a></nav><div class='ad'>Buy, buy, buy now, it is cheap, really, friends.</div><article><h1>Head</h1><p><b>One &amp; two.<br><p>Three  four.</article><div class='comments'><p>me too, me too, me too</p></div><footer>&copy; x</footer></body></html>"
    assert html_extract.main_text(page) == "Head\n\nOne & two.\n\nThree four."
    assert html_extract.main_text(None) == html_extract.main_text("") == ""


def test_pii(spark):
    texts = [None, "", "mail a.b@c-d.example.com, and x@y", "at 10.0.0.256 or 10.0.0.255.1", "card 4111 1111 1111 1111 or 4111111111111112", "call +1 (275) 555-2469 now", "IBAN DE89370400440532013000 ok", "é a@b.de", "x" * 50_000 + "@b.de"]
    got = {r.doc_id: [(x.kind, x.start, x.end) for x in r.pii] for r in pii.find_pii(docs(spark, texts)).collect()}
    assert got[0] == got[1] == []
    assert got[2] == [("email", 5, 24)]
    assert got[3] == [("ip", 17, 27)]
    assert got[4] == [("card", 5, 24)]
    assert got[5] == [("phone", 5, 22)]
    assert got[6] == [("iban", 5, 27)]
    assert got[7] == [("email", 2, 8)]
    assert got[8] == [("email", 0, 50_005)]


def test_line_dedup(spark):
    long = "the quick brown fox jumps over the lazy dog while the sun sets behind the far blue hills"
    texts = [f"{long}\nunique line number one here", f"other first line of text\n{long.upper()}", f"{long.replace('lazy', 'hazy')}\nshort", "short", None, ""]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert got[0] == (texts[0], 2, 0)
    assert got[1] == ("other first line of text", 2, 1)
    assert got[2] == ("short", 2, 1)
    assert got[3] == ("short", 1, 0)
    assert got[4] == (None, 0, 0)
    assert got[5] == ("", 1, 0)


def test_decontamination(spark):
    rng = np.random.default_rng(5)
    word = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(n))
    items = [word(30), word(16), word(45)]
    texts = [word(200), word(90) + " " + items[0] + " " + word(50), items[1], word(31) + " " + items[2].upper() + ".", None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: [x.item_id for x in r.leaks] for r in decontam.add_leaks(docs(spark, texts), bench).collect()}
    assert got == {0: [], 1: [0], 2: [1], 3: [2], 4: [], 5: []}
    assert decontam.add_leaks(docs(spark, texts), bench.where("item_id < 0")).where(F.size("leaks") > 0).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((150, 16))
    x[50:90] = x[:40] + 0.1 * rng.standard_normal((40, 16))
    x[90:95] = x[0]
    label = [i % 2 if i < 50 else (i - 50) % 2 if i < 90 else 0 for i in range(150)]
    rows = [(i, x[i].tolist(), label[i]) for i in range(150)] + [(150, None, 0), (151, [0.0] * 16, 0), (152, [float("nan")] * 16, 0), (153, x[0].tolist(), None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicate_embeddings(df).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = (u @ u.T >= 0.93) & (np.array(label)[:, None] == np.array(label))
    assert [got[i][0] for i in range(150)] == (link.sum(axis=1) - 1).tolist()
    assert all(got[i][0] == 0 and got[i][1] == i and got[i][2] for i in range(150, 154))


def test_language_and_quality(spark):
    rows = [(i, ("der die und nicht " if i % 2 else "the and of with ") * 5 + str(i), "de" if i % 2 else "en", int(i % 3 > 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    model = langid.fit_language_model(df.where("doc_id < 40"))
    got = {r.doc_id: r.lang_pred for r in langid.predict_language(df.union(spark.createDataFrame([(99, None, None, None), (98, "123 !", None, None)], df.schema)), model).collect()}
    assert all(got[i] == ("de" if i % 2 else "en") for i in range(60)) and got[99] == got[98] == "und"
    junk = spark.createDataFrame([(i, "BUY!! NOW!! " * 9 if i % 3 == 0 else "a calm text of plain words " * 4, None, int(i % 3 > 0)) for i in range(90)], df.schema)
    weights = quality.fit_quality_model(junk.select("doc_id", "text"), junk.select("doc_id", "quality"))
    scored = {r.doc_id: r.score for r in quality.score_quality(junk, weights).collect()}
    assert min(s for i, s in scored.items() if i % 3) > max(s for i, s in scored.items() if i % 3 == 0)


@pytest.mark.parametrize("shards", [1, 3])
def test_transforms_merge(shards):
    rng = np.random.default_rng(shards)
    parts = [rng.integers(97, 99, 160, dtype=np.uint8).tobytes() for _ in range(9)] + [b"ab" * 80, b"ab" * 80]
    grid = np.stack([np.frombuffer(x, np.uint8) for x in parts]).astype(np.uint32)
    seg, off, block = suffix_dedup.equal_strings(grid, np.zeros(len(parts), int), np.full(len(parts), 160), 20, -(-len(parts) // shards))
    by_block, by_bytes = {}, {}
    for s, o, b in zip(seg.tolist(), off.tolist(), block.tolist()):
        by_block.setdefault(b, set()).add((s, o))
        by_bytes.setdefault(parts[s][o : o + 20], set()).add((s, o))
    assert sorted(map(sorted, by_block.values())) == sorted(map(sorted, by_bytes.values()))


def test_repeats(spark):
    rng = np.random.default_rng(2)
    text = lambda n: "".join(rng.choice(list("abcdefghij é"), n))
    shared = text(150)
    texts = [text(300) + shared, shared + text(200), None, "", text(90), "ab" * 120, text(50) + shared[20:140] + text(10)]
    texts += [texts[0], texts[4]]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs(spark, texts)).collect()}
    seen: set[bytes] = set()
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(b[k : k + 100])
        assert (got[i].n_bytes, got[i].n_removed, bytes(got[i].kept)) == (len(b), gone.sum(), np.frombuffer(b, np.uint8)[~gone].tobytes())


def test_line_dedup_within_a_band(spark):
    """Near duplicates whose bands are all led by a dissimilar line of the same template."""
    rng = np.random.default_rng(4)
    word = lambda n: ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(n)]
    texts = []
    for _ in range(3):
        shared = word(10)
        for _ in range(60):
            own = word(10)
            texts += [" ".join(shared + own), " ".join(shared + own[:-1] + word(1))]
    grams = [{t[i : i + 5] for i in range(len(t) - 4)} for t in texts]
    link = lambda i, j: len(grams[i] & grams[j]) * 100 >= 80 * len(grams[i] | grams[j])
    twice = {i for i in range(len(texts)) if any(link(i, j) for j in range(i))}
    assert len(twice) == 180
    for square in (1024, 16):
        p = line_dedup.LineParams(square=square)
        got = {r.doc_id for r in line_dedup.dedup_lines(docs(spark, texts), params=p).where("n_removed = 1").collect()}
        assert got <= twice and len(got) >= 178


def test_html_wrappers():
    """Wrappers whose class names what stands beside them, or a headline, are no chrome; chrome with a content word is."""
    text = "A long sentence of the article, with commas, and with more words than a menu has."
    for name in ("content with-sidebar", "page has-header", "social-story", "main no-footer"):
        assert html_extract.main_text(f"<body><div class='{name}'><h1>Head</h1><p>{text}</p><div class='sidebar'><p>{text[2:]}</p></div></div></body>") == f"Head\n\n{text}"
    assert html_extract.main_text(f"<body><div class='wrap sidebar'><article><div class='article-header'><h1>Head</h1></div><p>{text}</p></article><div class='related'><article><p>{text[2:]}</p></article></div></div></body>") == f"Head\n\n{text}"
    chrome = "<div class='{}'><p>me too, me too, me too</p></div>"
    for name in ("comment-body", "page-header", "post-comments", "main-nav", "sidebar-content"):
        assert html_extract.main_text(f"<body><div class='story'><h1>Head</h1><p>{text}</p></div>{chrome.format(name)}</body>") == f"Head\n\n{text}"


def test_factors_of_all_texts(spark):
    """The factors come from the passages of every text, however many there are."""
    rng = np.random.default_rng(6)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(40)]
    texts = [" ".join(rng.choice(vocabulary, 20)) for _ in range(1500)]
    items = [" ".join(vocabulary[:20]), " ".join(vocabulary[20:])]
    p = decontam.LeakParams(rank=4, oversample=2, item_weight=1.0)
    known, weight = np.unique(decontam.tokens(items).hash), np.ones(p.buckets)
    got = decontam.fit_factors(docs(spark, texts), items, known, weight, p)
    sums = lambda m: decontam.product(texts + items, m, known, weight, p)
    q, _ = np.linalg.qr(sums(np.random.default_rng(11).standard_normal((len(known), 6))))
    small = q.T @ sums(q)
    want = q @ np.linalg.eigh((small + small.T) / 2)[1][:, -4:]
    assert np.abs(got @ got.T - want @ want.T).max() < 0.01
