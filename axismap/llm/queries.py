"""The thin queries over the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from axismap.llm import chat, decontaminate, langid, ogg, packing, quality, shard, simhash, suffix, warc
from axismap.llm.tables import read


def op1_media_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an Ogg container, read back: digests and features."""
    return ogg.read_media(ogg.to_media(read(spark, sf_dir, "documents")))


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived by content and read back from the archive."""
    headers, store = warc.write_archive(read(spark, sf_dir, "pages"))
    return warc.read_archive(headers, store, with_records=False).withColumnRenamed("key", "page_id").drop("record")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces packed into sequences of at most 1,024 tokens."""
    return packing.best_fit_packing(read(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component of fingerprints within 4 bits."""
    return simhash.components(read(spark, sf_dir, "documents"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation written out as a plain transcript and parsed back into turns, rendered."""
    return chat.recover(chat.as_transcripts(read(spark, sf_dir, "conversations")))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside windows of the benchmark."""
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 100-byte strings that start earlier."""
    return suffix.report(read(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; a quarter of the documents is held out."""
    return langid.predict(read(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards of near-equal bytes."""
    return shard.shard(read(spark, sf_dir, "documents"), n_shards=40)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score; a fifth of the documents is held out."""
    return quality.predict(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_media_ogg": op1_media_ogg,
        "op2_warc_archive": op2_warc_archive,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_simhash_near_dedup": op4_simhash_near_dedup,
        "op5_chat_formatting": op5_chat_formatting,
        "op6_benchmark_decontamination": op6_benchmark_decontamination,
        "op7_suffix_array_dedup": op7_suffix_array_dedup,
        "op8_language_id": op8_language_id,
        "op9_sharding": op9_sharding,
        "op10_quality_classifier": op10_quality_classifier,
    }


#: Base32 of a SHA-1, five hexadecimal digits (20 bits) to four letters at a time.
_BASE32 = """array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '')"""

ORACLE_SQL = {
    "op2_warc_archive": f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex,
        min(page_id) OVER (PARTITION BY body) AS first_id FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM d""",
    "op6_benchmark_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 10) AS k, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0),
bk AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM bw),
ks AS (SELECT DISTINCT k FROM bk),
dw AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k),
h AS (SELECT doc_id, i, x.k, item_id FROM (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM dw) x JOIN bk ON bk.k = x.k AND bk.win = x.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) y GROUP BY doc_id),
its AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op7_suffix_array_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 200) AS win FROM (SELECT doc_id, x, unnest(range(0, n - 99)) AS i FROM d WHERE n >= 100) y),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS nth FROM w),
g AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM f WHERE nth > 1),
r AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM r GROUP BY doc_id, run),
k AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM s GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN starts IS NULL THEN x ELSE array_to_string(list_transform(range(1, len(starts) + 2),
    lambda j: substr(x, 2 * coalesce(ends[j - 1], 0) + 1, 2 * (coalesce(starts[j], n) - coalesce(ends[j - 1], 0)))), '') END)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
}
