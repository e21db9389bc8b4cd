"""The registered query of each operator, applied to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import ann, decontamination, html_text, packing, pii, quality, resampling, simhash, substring_dedup, suffix_dedup, toxicity, url_filter, whitening

#: The queries are a demonstration; whoever publishes texts takes a key of their own.
DEMO_KEY = "demonstration"

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in as few sequences of 1024 tokens as can be found."""
    return packing.report(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return quality.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allow or block every page's URL."""
    model = url_filter.train(url_filter.labelled_urls(spark))
    return url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), model, url_filter.RULES).drop("url")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of repeated passages removed from every document."""
    return substring_dedup.report(_table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.report(_table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for its personal data."""
    return pii.report(_table(spark, sf_dir, "documents"), DEMO_KEY)


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest neighbours of every hundredth vector."""
    return ann.search(_table(spark, sf_dir, "embeddings"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test passages in every document."""
    return decontamination.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of repeated passages removed from every document."""
    return suffix_dedup.report(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents drawn towards the benchmark's texts; every document's weight."""
    return resampling.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.report(_table(spark, sf_dir, "pages"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First four whitened components of every vector."""
    return whitening.report(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    """All of them by name."""
    first = (op1_packing, op2_quality, op3_url_filter, op4_substring_dedup, op5_simhash, op6_pii, op7_ann, op8_decontamination, op9_suffix_dedup, op10_toxicity)
    return {f.__name__: f for f in (*first, op11_resampling, op12_html_text, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where it can express the whole query."""
    return {"op8_decontamination": DECONTAMINATION_SQL, "op11_resampling": RESAMPLING_SQL}


DECONTAMINATION_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), g AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS gram
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)
), hits AS (
  SELECT doc_id, i, n, item_id
  FROM (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
        FROM (SELECT doc_id, w, s.n, unnest(generate_series(1, len(w) - s.n + 1)) AS i FROM d, (SELECT DISTINCT n FROM g) s WHERE len(w) >= s.n)) AS c
  JOIN g USING (gram, n)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY 1
), items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY 1
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

# CRC-32 by its rule: each byte of a word is shifted out of the sum, eight steps a byte
RESAMPLING_SQL = r"""
WITH steps AS (
  SELECT list(v ORDER BY b) AS crc_of FROM (
    SELECT b, list_reduce(list_concat([b], range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
    FROM (SELECT unnest(range(256)) AS b))
), words AS (
  SELECT 's' AS side, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 't', NULL, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') FROM benchmark
), each AS (
  SELECT side, doc_id, unnest(w) AS word FROM words
), bytes AS (
  SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM each)
), buckets AS (
  SELECT word, xor(list_reduce(list_concat([4294967295], list_transform(range(len(h) // 2), lambda i: CAST(concat('0x', h[2 * i + 1 : 2 * i + 2]) AS BIGINT))),
    lambda c, b: xor(c // 256, crc_of[xor(c % 256, b) + 1])), 4294967295) % 10000 AS bucket
  FROM bytes, steps
), counts AS (
  SELECT bucket, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t FROM each JOIN buckets USING (word) GROUP BY 1
), totals AS (
  SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM counts
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t + 1 AS DOUBLE) * CAST(s_all + 10000 AS DOUBLE)) / (CAST(s + 1 AS DOUBLE) * CAST(t_all + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM counts, totals
), weights AS (
  SELECT doc_id, sum(gain) AS weight FROM each JOIN buckets USING (word) JOIN gains USING (bucket) WHERE side = 's' GROUP BY 1
), scored AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST(concat('0x', sha256(concat('2024:', doc_id))[1:8]) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM words LEFT JOIN weights USING (doc_id) WHERE side = 's'
), ranks AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM scored LEFT JOIN ranks USING (doc_id)
"""
