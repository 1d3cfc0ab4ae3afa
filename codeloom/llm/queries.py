"""One query for each operator, over its whole table, and the SQL that states the result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import bpe, exact_dedup, kneser_ney, line_dedup, mixing, pii, revisit, shard, simhash, topk
from codeloom.llm.common import table


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.v, v.v) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.v) = len(v.v) WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op2_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: A stated key, so that reruns agree; a real one is secret.
PII_KEY = "codeloom"


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_pii(docs, PII_KEY)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.removals(table(spark, sf_dir, "documents"))


def op6_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisit.resolve(revisit.captures_of(table(spark, sf_dir, "pages")))
    flat = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return found.select(F.col("record_id").alias("revisit_id"), "canonical_url", "response_id", "response_digest", "status", flat.alias("headers"))


OP6_SQL = rf"""
WITH cut AS (
  SELECT page_id, sha256(coalesce(html, '')) AS digest, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM pages
), parted AS (
  SELECT page_id, digest, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^www\.', ''), ':(80|443)$', '')
      || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS place,
    list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))) AS params
  FROM cut
), named AS (
  SELECT page_id, digest, place || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical_url FROM parted
), found AS (
  SELECT r.page_id * 2 + 1 AS revisit_id, r.canonical_url, r.digest AS own, f.page_id AS of_page, f.digest AS of_digest,
    row_number() OVER (PARTITION BY r.page_id ORDER BY f.page_id DESC NULLS LAST) AS place
  FROM named r LEFT JOIN named f ON f.canonical_url = r.canonical_url AND f.page_id * 2 < r.page_id * 2 + {revisit.LATER}
)
SELECT revisit_id, canonical_url, of_page * 2 AS response_id, of_digest AS response_digest,
  CASE WHEN of_page IS NULL THEN 'no_response' WHEN own = of_digest THEN 'resolved' ELSE 'mismatch' END AS status,
  CASE WHEN own = of_digest THEN 'cache-control=no-cache;content-type=text/html;etag=W/' || own || ';last-modified=day ' || of_page END AS headers
FROM found WHERE place = 1
"""


def op7_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content
  FROM documents
), ranked AS (
  SELECT doc_id, content, count(*) OVER (PARTITION BY content) AS group_size,
         first_value(doc_id) OVER (PARTITION BY content ORDER BY n DESC, doc_id) AS keep_id,
         row_number() OVER (PARTITION BY content ORDER BY n DESC, doc_id) AS place
  FROM rows
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(content) AS text_sha256 FROM ranked
"""


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


OP10_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM sources
), leveled AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER (ORDER BY cap / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level,
    row_number() OVER (ORDER BY cap / CAST(weight AS DOUBLE), source NULLS LAST) AS turn
  FROM weighed
), water AS (
  SELECT level FROM leveled WHERE level * weight <= cap ORDER BY turn LIMIT 1
), goals AS (
  SELECT source, source_size, least(water.level * weight, CAST(cap AS DOUBLE)) AS target FROM leveled, water
), placed AS (
  SELECT s.*, g.source_size, g.target, CAST(floor(target + 0.5) AS BIGINT) AS want,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, source, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE (want // source_size) * size + CAST(least(size, greatest(0, want % source_size - before)) AS BIGINT) END AS taken
FROM placed
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_topk": op1_exact_topk,
        "op2_histogram_shards": op2_histogram_shards,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_pii_surrogates": op4_pii_surrogates,
        "op5_line_dedup": op5_line_dedup,
        "op6_revisit_resolution": op6_revisit_resolution,
        "op7_byte_level_bpe": op7_byte_level_bpe,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_simhash_near_dedup": op9_simhash_near_dedup,
        "op10_mix_sources": op10_mix_sources,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_topk": OP1_SQL, "op6_revisit_resolution": OP6_SQL, "op8_exact_dedup": OP8_SQL, "op10_mix_sources": OP10_SQL}
