"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, decontaminate, language, licenses, mixing, near_dedup, phrases, pii, quality, relative_parse, sharding, suffix_dedup, warc
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": lambda spark, d: suffix_dedup.repeats(read(spark, d, "documents")),
    "op2_pii": lambda spark, d: pii.scan(read(spark, d, "documents")),
    "op3_decontamination": lambda spark, d: decontaminate.scan(read(spark, d, "documents"), read(spark, d, "benchmark")),
    "op4_license_scan": lambda spark, d: licenses.scan(read(spark, d, "documents")),
    "op5_near_dedup": lambda spark, d: near_dedup.near_duplicates(read(spark, d, "documents")).drop("set_key"),
    "op6_mixing": lambda spark, d: mixing.mixed_documents(read(spark, d, "documents")),
    "op7_sharding": lambda spark, d: sharding.shard(read(spark, d, "documents")),
    "op8_language_id": lambda spark, d: language.identify(read(spark, d, "documents")),
    "op9_warc": lambda spark, d: warc.round_trip(read(spark, d, "pages")),
    "op10_quality_rules": lambda spark, d: quality.judge(read(spark, d, "documents"), read(spark, d, "labels")),
    "op11_centroids": lambda spark, d: centroids.clusters(read(spark, d, "embeddings")),
    "op12_relative_parse": lambda spark, d: relative_parse.earlier(read(spark, d, "documents")),
    "op13_phrases": lambda spark, d: phrases.collocations(read(spark, d, "documents")),
}

SQL: dict[str, str] = {
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        k AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest,
                     max(page_id) OVER (PARTITION BY body) AS largest FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND largest <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND largest <> page_id THEN largest END AS refers_to,
               true AS intact
        FROM k""",
}
