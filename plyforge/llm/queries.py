"""The registered queries of the corpus operators, and their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import compress_quality, decontaminate, divergence, hilbert, kneser_ney, langid, licenses, packing, simhash, token_store, warc, webp, whitening
from .common import materialize, scratch


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(n: int, key: str = "doc_id"):
    """crc32 of the key's decimal text, modulo n; a null key counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def warc_rows(captures: DataFrame) -> DataFrame:
    """The digest columns of assembled captures, with the request and metadata that they met."""
    return captures.select(
        F.col("response.page_id").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        "record_type", F.col("refers_to_page").alias("refers_to"),
        "n_requests", "n_metadata",
    )


def op1_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through WARC archives and back, one row a capture."""
    return warc_rows(warc.captures(table(spark, sf_dir, "pages"), scratch(spark, "warc")))


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log probability of every document under a model of six sevenths of them."""
    return kneser_ney.train_and_score(table(spark, sf_dir, "documents"), known=remainder(7) != 2)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document lies inside benchmark windows."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, learned from labels outside the held-out third."""
    docs = table(spark, sf_dir, "documents")
    model = compress_quality.fit(docs, table(spark, sf_dir, "labels"), known=remainder(3) != 1)
    return compress_quality.score(docs.select("doc_id", (remainder(3) == 1).alias("held_out"), "text"), model).drop("text")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of each document among fingerprints linked at two bits or fewer."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a lossless WebP column, written, read back and decoded to its pixel array."""
    media = materialize(webp.store(table(spark, sf_dir, "documents")), "media")
    return webp.read(media, with_pixels=True)


def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of equal row counts along a Hilbert curve over language, source, size and id."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")
    )
    dims = {"lang": hilbert.text_rank(F.col("lang")), "source": hilbert.text_rank(F.col("source")), "size": F.col("size"), "id": F.col("doc_id")}
    placed = hilbert.hilbert_shards(docs, dims, "doc_id", shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, known=remainder(5) != 0)
    return langid.identify(docs.select("doc_id", (remainder(5) == 0).alias("held_out"), "text"), model).drop("text")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids in shard files, read back through the perfect hash index."""
    store = token_store.TokenStore.write(table(spark, sf_dir, "documents"), scratch(spark, "tokens"), vocabulary("word_bpe_49k.json"), end_id=1)
    return store.rows().select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens by sums of squares."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source of a language is from each other one, and its fifty most telling terms."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license phrases of every document, and the labels of templates that a block of it holds."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable embedding on the 32 leading components, at unit variance."""
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {f.__name__: f for f in (op1_warc_transactions, op2_kneser_ney, op3_decontamination, op4_compression_quality, op5_simhash_near_dedup, op6_lossless_webp, op7_hilbert_shards, op8_language_id, op9_token_store, op10_best_fit_packing, op11_source_divergence, op12_license_scan, op13_embedding_whitening)}

#: Lower-cased words of a text in DuckDB.
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def listed(rows: list[tuple[str, str]]) -> str:
    """(id, label, text) rows of a VALUES list."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({i}, {quote(label)}, {quote(text)})" for i, (label, text) in enumerate(rows))


ORACLES: dict[str, str] = {
    "op11_source_divergence": r"""
        WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
             g AS (SELECT DISTINCT lang, source FROM d),
             kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY 1, 2 HAVING count(*) >= 30),
             v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
             c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
             total AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2),
             p AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 5)) // (coalesce(total, 0) + 5 * v) AS p
                   FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN total USING (lang, source) LEFT JOIN c USING (lang, source, term)),
             whole AS (SELECT lang, sum(total) AS total FROM total GROUP BY 1),
             q AS (SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (sum(n) + 5)) // (any_value(whole.total) + 5 * any_value(v)) AS q FROM c JOIN v USING (lang) JOIN whole USING (lang) GROUP BY 1, 2),
             f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
             pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
             term AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
             ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
        SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50""",
    "op12_license_scan": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
             t AS (SELECT id, label, len(w) AS l, list_distinct(w) AS tokens FROM (SELECT id, label, {WORDS} AS w FROM (VALUES {listed(licenses.TEMPLATES)}) AS v(id, label, text))),
             p AS (SELECT label, w FROM (SELECT label, {WORDS} AS w FROM (VALUES {listed(licenses.PHRASES)}) AS v(id, label, text))),
             each AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
             base AS (SELECT e.r, e.pos, label FROM each e JOIN p ON p.w[1] = e.word JOIN d ON d.r = e.r WHERE d.w[e.pos + 1 : e.pos + len(p.w)] = p.w),
             told AS (SELECT id, label, l, len(tokens) AS n, unnest(tokens) AS token FROM t),
             block AS (SELECT r, label, count(DISTINCT token) OVER (PARTITION BY r, id ORDER BY pos RANGE BETWEEN CURRENT ROW AND l - 1 FOLLOWING) / n AS share FROM each JOIN told ON token = word),
             met AS (SELECT r, label, share FROM block WHERE share >= CAST(0.85 AS DOUBLE)),
             b AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY r),
             m AS (SELECT r, max(share) AS share FROM met GROUP BY r),
             a AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM base UNION ALL SELECT r, label FROM met) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
               CASE WHEN n_base > 0 THEN CAST(1 AS DOUBLE) ELSE coalesce(share, 0) END AS score
        FROM d LEFT JOIN b USING (r) LEFT JOIN m USING (r) LEFT JOIN a USING (r)""",
    "op1_warc_transactions": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS size FROM pages),
             m AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS original FROM p)
        SELECT page_id, size AS payload_bytes, sha1(body) AS payload_digest,
               CASE WHEN size >= 1000 AND original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN size >= 1000 AND original <> page_id THEN original END AS refers_to,
               CAST(1 AS BIGINT) AS n_requests, CAST(1 AS BIGINT) AS n_metadata
        FROM m""",
    "op3_decontamination": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
             b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
             s AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0),
             win AS (SELECT DISTINCT item_id, least(len(w), 13) AS l, array_to_string(w[i : i + 12], ' ') AS t FROM s),
             spot AS (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT l FROM win) WHERE len(w) >= l),
             hit AS (SELECT spot.r, i, spot.l, item_id FROM spot JOIN win ON spot.l = win.l AND array_to_string(spot.w[i : i + spot.l - 1], ' ') = win.t),
             places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS p FROM hit) GROUP BY r),
             items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)""",
}
