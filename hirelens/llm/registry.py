"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from hirelens.llm import alignment, embeddings, chunks, language, lines, packing, quality, secrets, sentences, simhash, spelling, templates, urls

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = [
    urls.Rule(urls.ALLOW, "com", "/"),
    urls.Rule(urls.BLOCK, "example.com", "/en/"),
    urls.Rule(urls.ALLOW, "www.example.com", "/en/"),
    urls.Rule(urls.BLOCK, "net", "/es/"),
    urls.Rule(urls.BLOCK, "net", "/fr/"),
]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_groups(table(spark, sf_dir, "embeddings"), min_cosine=0.95)


def op2_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.edited_likeness(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many ids, their CRC-32, the score, and what decoding gives back."""
    return sentences.round_trip(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.train(docs)).select("doc_id", "posterior", "score", "kept")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = lines.kept_lines(docs.select("doc_id", "text"), lines.lost_lines(docs))
    return kept.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    docs = docs.withColumn("held_out", held_out)
    learned = docs.where(~F.col("held_out")).select("text", "lang")
    return language.predict(docs.select("doc_id", "held_out", "text"), language.train(learned)).select(
        "doc_id", "held_out", "lang_pred", "score"
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"), words=3, max_bits=2).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_documents(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(
            F.regexp_count("spans", F.lit(f"{kind}:")).cast("long").alias(f"n_{kind}")
            for kind in ("assign", "access", "hex")
        ),
        F.sha2("spans", 256).alias("base_sha256"),  # the rules are the base, no more
        "spans",
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model learns from URLs that a rule decides: at most 2000, by hash."""
    pages = table(spark, sf_dir, "pages")
    ruled = urls.judged(pages, URL_RULES).where("rule_verdict is not null")
    model = urls.train(
        ruled.select("url", (F.col("rule_verdict") == urls.BLOCK).cast("int").alias("blocked")), rows=2000
    )
    return urls.filter_urls(pages, URL_RULES, model)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return alignment.align(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), min_length=5, min_count=3, times=2)


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.main_text(table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "op1_embedding_dedup": op1_embedding_dedup,
        "op2_chunk_fingerprints": op2_chunk_fingerprints,
        "op3_packing": op3_packing,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_quality": op5_quality,
        "op6_line_dedup": op6_line_dedup,
        "op7_language": op7_language,
        "op8_simhash": op8_simhash,
        "op9_secrets": op9_secrets,
        "op10_url_filter": op10_url_filter,
        "op11_alignment": op11_alignment,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_main_text": op13_main_text,
        "pipeline": pipeline,
    }


LINE_DEDUP_SQL = r"""
WITH split AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), numbered AS (
    SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split
), keyed AS (
    SELECT *, translate(
        trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM numbered
), owners AS (
    SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key
)
SELECT k.doc_id,
       count(*) AS n_lines,
       count(*) FILTER (o.owner < k.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos)
           FILTER (o.owner IS NULL OR o.owner >= k.doc_id), '')) AS kept_sha256
FROM keyed k LEFT JOIN owners o ON k.key = o.key
GROUP BY k.doc_id
"""


# CRC-32 byte by byte; neighbours by the word without one letter; forms followed by recursion.
SPELLING_SQL = r"""
WITH RECURSIVE crc AS (
    SELECT list(v ORDER BY i) AS tab FROM (
        SELECT i, list_reduce(list_prepend(i::BIGINT, list_transform(range(8), lambda z: 0::BIGINT)),
            lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
        FROM range(256) t(i))
), found AS (
    SELECT coalesce(doc_id::VARCHAR, '') AS doc,
           unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run
    FROM documents
), counted AS (
    SELECT doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run,
           count(*) AS k
    FROM found GROUP BY 1, 2
), coded AS (
    SELECT run, k, flatten(list_transform(string_split(doc || ':' || run, ''), lambda x:
        CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT]
             ELSE [192 + (unicode(x) >> 6)::BIGINT, 128 + (unicode(x) & 63)::BIGINT] END)) AS bytes
    FROM counted
), hashed AS (
    SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295, bytes),
        lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS h
    FROM coded, crc
), words AS (
    SELECT CASE WHEN h % 97 = 0
                THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
                ELSE run END AS word,
           sum(k)::BIGINT AS n
    FROM hashed GROUP BY 1 HAVING sum(k) >= 3 AND length(word) >= 5
), without AS (
    SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
    FROM words, unnest(range(1, length(word) + 1)) t(i)
), pairs AS (
    SELECT u.word, v.word AS near, v.n AS near_n
    FROM without u JOIN without v ON u.i = v.i AND u.rest = v.rest AND u.word <> v.word
    UNION
    SELECT u.word, v.word, v.n FROM words u JOIN without v ON u.word = v.rest
    UNION
    SELECT v.word, u.word, u.n FROM words u JOIN without v ON u.word = v.rest
), ranked AS (
    SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near,
           row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place
    FROM pairs
), formed AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
           CASE WHEN near_n >= 2 * w.n THEN near END AS form,
           CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
    FROM words w LEFT JOIN ranked r ON w.word = r.word AND place = 1
), chain AS (
    SELECT word, word AS root FROM formed
    UNION
    SELECT c.word, f.form FROM chain c JOIN formed f ON c.root = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM formed f JOIN chain c ON f.word = c.word JOIN formed e ON c.root = e.word AND e.form IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": LINE_DEDUP_SQL, "op12_spelling_variants": SPELLING_SQL}
