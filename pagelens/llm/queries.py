"""The registered queries of this subpackage: thin digests of the operators' outputs."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm import bpe, decontam, embed_dedup, html_extract, langid, line_dedup, ngram_join, phrases, pii, quality, substring_dedup, suffix_dedup, whitening

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every whole text, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.bpe_round_trip(docs, RANKS, public_tokenizers.PATTERN)
    return coded.select("doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document by links of 85 hundredths over 4-word shingles."""
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item it leaks."""
    leaks = decontam.add_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.item_id", "l.share", "l.start", "l.stop")


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector among those of its label."""
    return embed_dedup.near_duplicate_embeddings(table(spark, sf_dir, "embeddings"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data in every whole text."""
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda k: F.size(F.filter("pii", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("pii", lambda x: x["kind"].isin(*pii.BASE))
    return found.select("doc_id", *map(of, pii.BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, lines removed from it and the digest of what is left."""
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by a model that never saw the held-out labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality_model(docs, table(spark, sf_dir, "labels").where(~held_out()))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a model that never saw the held-out ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit_language_model(docs.where(~held_out()))
    return langid.predict_language(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document left once repeated strings of 100 bytes are removed."""
    done = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_phrase_collocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of each language that score highest, with their counts."""
    return phrases.mine_phrases(table(spark, sf_dir, "documents").select("text", "lang"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, regexp_extract_all(part, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS part
        FROM documents)),
words AS (SELECT lang, piece, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM pieces WHERE len(w) > 0),
nearby AS (SELECT lang, w1, lead(w1, 1) OVER (PARTITION BY piece ORDER BY i) AS w2, lead(w1, 2) OVER (PARTITION BY piece ORDER BY i) AS w3 FROM words),
grams AS (
  SELECT lang, 1 AS n, w1 AS phrase, count(*) AS f FROM nearby GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM nearby WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM nearby WHERE w3 IS NOT NULL GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE n = 1 GROUP BY lang),
candidates AS (SELECT lang, n, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE n >= 2 AND f >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k.k, l.f AS l, r.f AS r,
         CAST(CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM candidates c JOIN (VALUES (1), (2)) AS k(k) ON k.k < c.n
  JOIN grams l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : k.k], ' ')
  JOIN grams r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k.k + 1 :], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, part, max(a) AS a
  FROM (SELECT lang, a, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) AS part FROM candidates WHERE n = 3) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, t.n, b.score
FROM best b JOIN totals t USING (lang) LEFT JOIN longer g ON g.lang = b.lang AND g.part = b.phrase
WHERE coalesce(g.a, 0) * 100 < b.a * 50
QUALIFY rank <= 2000
"""


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document left once windows of 35 words that stand elsewhere too are removed."""
    done = substring_dedup.remove_repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT row, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs WHERE len(w) > 0),
windows AS (
  SELECT row, word, i, count(*) OVER ahead AS many, string_agg(word, ' ') OVER ahead AS text
  FROM words WINDOW ahead AS (PARTITION BY row ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
repeated AS (SELECT text FROM windows WHERE many = 35 GROUP BY text HAVING count(*) > 1),
marked AS (
  SELECT v.row, v.word, v.i,
         coalesce(bool_or(v.many = 35 AND r.text IS NOT NULL) OVER (PARTITION BY v.row ORDER BY v.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), false) AS gone
  FROM windows v LEFT JOIN repeated r ON v.text = r.text),
left_over AS (
  SELECT row, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM marked GROUP BY row)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM docs d LEFT JOIN left_over k USING (row)
"""


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates of every usable vector on the eight leading components, scaled to unit variance."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    fit = whitening.fit_whitening(rows)
    white = whitening.whiten(rows, fit)
    n, trace, values = (fit.n, fit.trace, fit.values.tolist()) if fit else (0, 0.0, [])
    share = F.array(*(F.lit(v / trace if trace else 0.0) for v in values)) if values else F.lit(None).cast("array<double>")
    each = white.select("vec_id", F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    wrong = whitening.identity_error(white) if fit else 0.0
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(wrong).alias("identity_error"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_byte_bpe, op2_ngram_jaccard, op3_html_extraction, op4_decontamination, op5_embedding_near_dedup, op6_pii, op7_line_dedup, op8_quality, op9_language_id, op10_suffix_dedup, op11_phrase_collocation, op12_substring_dedup, op13_embedding_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op11_phrase_collocation": OP11_SQL, "op12_substring_dedup": OP12_SQL}
