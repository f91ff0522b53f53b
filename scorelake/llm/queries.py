"""The operators' queries over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm.common import shared_path

#: Public tokenisers, by name: their files are looked up where they are read.
PIECES, WORDS = "piece_bpe_32k.model", "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorelake.llm.pieces import encode_documents

    out = encode_documents(table(spark, sf_dir, "documents"), PIECES)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.crc32("spans").alias("spans_crc32"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorelake.llm.token_counts import token_counts

    out = token_counts(table(spark, sf_dir, "documents"), WORDS)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"), F.crc32("prefix_deltas").alias("prefix_crc32"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorelake.llm.huffman import read_ids, write_ids

    path = shared_path(spark, "token-files")
    write_ids(table(spark, sf_dir, "documents"), path, WORDS, end_id=1)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorelake.llm.hilbert import read_shards, write_shards

    path = shared_path(spark, "shards")
    write_shards(table(spark, sf_dir, "documents"), path, ("n_chars", "lang", "source"), "doc_id", "text")
    text = F.coalesce(F.col("row.text"), F.lit("")).cast("binary")
    return read_shards(spark, path, 8).select("row.doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorelake.llm.simhash import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=2)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorelake.llm.gam import fit_quality, held_out, quality_score

    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out("doc_id").alias("held_out"), quality_score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorelake.llm.gam import held_out
    from scorelake.llm.langid import fit_languages, language

    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs, PIECES)
    return docs.select("doc_id", held_out("doc_id").alias("held_out"), language(model, F.col("text")).alias("found")).select("doc_id", "held_out", "found.lang_pred", "found.score")


def op8_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorelake.llm.repetition import repetition

    return repetition(table(spark, sf_dir, "documents"))


#: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorelake.llm.url_rules import judge_urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorelake.llm.decontam import match_items, n_hit

    out = match_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = n_hit(F.col("spans"))
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorelake.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"), min_count=10, cover_percent=50, top=2000)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorelake.llm.warc import archive_pages, archived_pages

    path = shared_path(spark, "warc")
    archive_pages(table(spark, sf_dir, "pages"), path)
    return archived_pages(spark, path)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scorelake.llm.whiten import whiten

    return whiten(table(spark, sf_dir, "embeddings"), components=4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pieces, op2_hilbert_shards, op3_simhash, op4_token_counts, op5_token_files, op6_quality, op7_language, op8_repetition, op9_url_rules,
        op10_decontamination, op11_collocations, op12_warc, op13_whitening,
    )
}

#: Where DuckDB can give the whole result.
SQL: dict[str, str] = {
    "op9_url_rules": r"""
        WITH rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        urls AS (
            SELECT row_number() OVER () AS k, page_id,
                   translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
            FROM pages),
        best AS (
            SELECT k, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
            FROM urls u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY k)
        SELECT page_id, host, path, rule, coalesce(b.verdict, 'allow') AS verdict FROM urls LEFT JOIN best b USING (k)
    """,
    "op10_decontamination": r"""
        WITH docs AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        starts AS (SELECT item, w, least(len(w), 10) AS m, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM items WHERE len(w) > 0),
        windows AS (SELECT DISTINCT item, m, array_to_string(w[s : s + m - 1], ' ') AS g FROM starts),
        grams AS (SELECT k, m, p, array_to_string(w[p : p + m - 1], ' ') AS g FROM (SELECT k, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM docs, (SELECT DISTINCT m FROM windows) WHERE len(w) >= m)),
        hits AS (SELECT k, p, m, item FROM grams JOIN windows USING (m, g)),
        words AS (SELECT k, count(DISTINCT q) AS n_hit FROM (SELECT k, unnest(range(p, p + m)) AS q FROM (SELECT DISTINCT k, p, m FROM hits)) GROUP BY k),
        found AS (SELECT k, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY encode(item))) AS items_sha256 FROM (SELECT DISTINCT k, item FROM hits) GROUP BY k)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN words USING (k) LEFT JOIN found USING (k)
    """,
    "op11_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents),
        words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        singles AS (SELECT lang, x, count(*) AS f FROM (SELECT lang, unnest(w) AS x FROM words) GROUP BY ALL),
        totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM singles GROUP BY lang),
        two AS (SELECT lang, x, y, count(*) AS f FROM (SELECT lang, unnest(w[:-2]) AS x, unnest(w[2:]) AS y FROM words WHERE len(w) > 1) GROUP BY ALL HAVING count(*) >= 10),
        three AS (SELECT lang, x, y, z, count(*) AS f FROM (SELECT lang, unnest(w[:-3]) AS x, unnest(w[2:-2]) AS y, unnest(w[3:]) AS z FROM words WHERE len(w) > 2) GROUP BY ALL HAVING count(*) >= 10),
        longer AS (SELECT lang, x, y, max(f) AS f FROM (SELECT lang, x, y, f FROM three UNION ALL SELECT lang, y, z, f FROM three) GROUP BY ALL),
        cuts AS (
            SELECT two.lang, two.x || ' ' || two.y AS phrase, two.f AS a, 1 AS k, p.f AS l, q.f AS r
            FROM two JOIN singles p ON p.lang = two.lang AND p.x = two.x JOIN singles q ON q.lang = two.lang AND q.x = two.y
                 LEFT JOIN longer ON longer.lang = two.lang AND longer.x = two.x AND longer.y = two.y
            WHERE longer.f IS NULL OR 100 * longer.f < 50 * two.f
            UNION ALL
            SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, 1, p.f, q.f
            FROM three t JOIN singles p ON p.lang = t.lang AND p.x = t.x JOIN two q ON q.lang = t.lang AND q.x = t.y AND q.y = t.z
            UNION ALL
            SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, 2, p.f, q.f
            FROM three t JOIN two p ON p.lang = t.lang AND p.x = t.x AND p.y = t.y JOIN singles q ON q.lang = t.lang AND q.x = t.z),
        scored AS (SELECT *, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM best)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
    "op12_warc": """
        WITH rows AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST) AS k, max(page_id) OVER (PARTITION BY html) AS first FROM rows)
        SELECT page_id, payload_bytes, sha1(html) AS payload_digest, CASE WHEN payload_bytes >= 1000 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND k > 1 THEN first END AS refers_to
        FROM placed
    """,
}
