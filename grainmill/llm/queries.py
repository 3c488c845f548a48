"""The contract's queries: each applies one operator with production parameters to its whole table and returns every row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm import exact_dedup, jaccard_join, license_scan, media, packing, quality, substring_dedup, tokens, toxicity, warc
from grainmill.llm.common import fold, table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every licence that a document contains."""
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def _judged(scores: DataFrame, held_out, threshold: float) -> DataFrame:
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold("doc_id", 5) == 0
    return _judged(quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out), held_out, 0.3)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_bundles(warc.write_bundles(table(spark, sf_dir, "pages")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold("doc_id", 3) == 1
    return _judged(toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out), held_out, 0.7)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_join(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), short_first=True)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.bpe_digests(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select(F.col("row").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_quality, op3_media, op4_warc, op5_toxicity, op6_jaccard_join, op7_best_fit_packing, op8_bpe, op9_exact_dedup, op10_substring_dedup)}

# Fixed value: the letters of base 32.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Base 32 of a hexadecimal SHA-1: every five hexadecimal digits are four letters.
_SHA1_32 = "array_to_string(list_transform(range(0, 32), lambda i: substr('" + _BASE32 + "', 1 + CAST((('0x' || substr(h, 1 + 5 * (i // 4), 5))::INTEGER >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '')"
#: Ids of 4-word shingles and the pairs of documents that link.
_LINKS = """
    w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS s FROM w),
    g AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS g FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*)))
"""

#: DuckDB SQL over the whole tables; the other queries are held against brute force in tests/llm.
ORACLE_SQL = {
    "op4_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
        SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes, {_SHA1_32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to FROM p
    """,
    "op6_jaccard_join": f"""
        WITH RECURSIVE {_LINKS},
        c AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT p.b, c.root FROM c JOIN p ON p.a = c.doc_id WHERE c.root < p.b),
        r AS (SELECT doc_id, min(root) AS component_id FROM c GROUP BY 1), k AS (SELECT a AS doc_id, count(*) AS k FROM p GROUP BY 1)
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, component_id, CAST(coalesce(k.k, 0) AS BIGINT) AS n_links FROM s JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
    """,
    "op10_substring_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents), l AS (SELECT doc_id, x, length(x) // 2 AS n FROM d),
        w AS (SELECT doc_id, i, hash(substr(x, 2 * i + 1, 100)) AS a, hash(substr(x, 2 * i + 1, 100) || '.') AS b FROM (SELECT doc_id, x, unnest(range(0, n - 49)) AS i FROM l)),
        f AS (SELECT a, b, min(doc_id) AS first FROM w GROUP BY ALL HAVING min(doc_id) < max(doc_id)), g AS (SELECT doc_id, i FROM w JOIN f USING (a, b) WHERE doc_id > first),
        o AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM g),
        r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o), s AS (SELECT doc_id, run, min(i) AS lo, max(i) + 50 AS hi FROM r GROUP BY ALL),
        e AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_spans, CAST(sum(hi - lo) AS BIGINT) AS n_removed, list([lo, hi] ORDER BY lo) AS cut FROM s GROUP BY 1)
        SELECT l.doc_id, l.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(CASE WHEN cut IS NULL THEN x ELSE array_to_string(list_transform(range(0, len(cut) + 1), lambda k:
                   substr(x, 1 + 2 * CASE WHEN k = 0 THEN 0 ELSE cut[k][2] END, 2 * (CASE WHEN k = len(cut) THEN l.n ELSE cut[k + 1][1] END - CASE WHEN k = 0 THEN 0 ELSE cut[k][2] END))), '') END)) AS kept_sha256
        FROM l LEFT JOIN e USING (doc_id)
    """,
    "op1_license_scan": license_scan.oracle_sql(),
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
}
