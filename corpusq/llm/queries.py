"""One query for each operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, forest, html, jaccard, licenses, mixing, pieces, quality, repeats, resampling, runs, templates, warc
from .common import documents, pages


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = repeats.cut_repeats(documents(spark, sf_dir))
    left = F.octet_length("kept").cast("long")
    return d.select("doc_id", "n_bytes", (F.col("n_bytes") - left).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(pages(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.drop_recurring(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", "text")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = warc.archive_round_trip(pages(spark, sf_dir))
    return d.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality.quality_rules(documents(spark, sf_dir))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pieces.encode(documents(spark, sf_dir).select("doc_id", "text"))
    d = pieces.decode(d)
    same = F.coalesce("text", F.lit("")).eqNullSafe(F.coalesce("decoded", F.lit("")))
    return d.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.size("token_ids").cast("long").alias("n_tokens"), same.alias("round_trip"), "token_ids")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir))


def with_planted_period(doc_id, words: list[bytes]) -> list[bytes]:
    """One in ten ids: from a word on, the text repeats the words that stand there. Texts without id stay as they are."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    unit = words[a : a + 1 + (n - a) // (3 + g % 8)]
    return words[:a] + (unit * -(-(n - a) // len(unit)))[: n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_summary(runs.word_runs(documents(spark, sf_dir), edit=with_planted_period))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OPERATORS = (
    op1_suffix_array_dedup, op2_mixing, op3_license_scans, op4_html_extraction, op5_line_dedup, op6_fingerprints, op7_warc, op8_quality_rules, op9_sentencepiece, op10_ngram_jaccard_join,
    op11_periodic_runs, op12_importance_resampling, op13_lsh_forest, pipeline,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


WORD_SQL = r"[^\x20\x09-\x0D]+"

MIXING_SQL = rf"""
WITH own AS (
  SELECT doc_id, source AS s, len(regexp_extract_all(coalesce(text, ''), '{WORD_SQL}'))::BIGINT AS n FROM documents
), hashed AS (
  SELECT *, (('0x' || substr(md5('0|' || coalesce(doc_id::VARCHAR, '') || '|' || n::VARCHAR), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM own
), sizes AS (SELECT s, sum(n)::BIGINT AS source_size, avg(n) AS mean FROM own GROUP BY s
), weighed AS (
  SELECT *, ((row_number() OVER (ORDER BY s IS NULL, s) - 1) % 3 + 1)::DOUBLE AS w, 3::DOUBLE * source_size AS most FROM sizes
), levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE
      - coalesce(sum(most) OVER (ORDER BY most / w, s IS NULL, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE))
      / sum(w) OVER (ORDER BY most / w, s IS NULL, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed
), targets AS (SELECT s, source_size, mean, least(most, max(level) OVER () * w) AS target FROM levels
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets
), shares AS (
  SELECT o.s, sum(CASE WHEN n > 0 THEN n * (n / (n + mean)) ELSE 0 END) / any_value(source_size) AS share FROM own o JOIN sizes z ON o.s IS NOT DISTINCT FROM z.s GROUP BY o.s
), d0 AS (
  SELECT h.*, source_size, target, floor(rate)::BIGINT AS whole, rate - floor(rate) AS p0, (rate - floor(rate)) * source_size AS rest,
    CASE WHEN n > 0 THEN n / (n + mean) ELSE 0 END - share AS tilt
  FROM hashed h JOIN rates r ON h.s IS NOT DISTINCT FROM r.s JOIN shares z ON h.s IS NOT DISTINCT FROM z.s
), d AS (SELECT *, p0 + least(p0, 1 - p0) * tilt / 2 AS p FROM d0
), ranked AS (
  SELECT *, CASE WHEN p > 0 THEN ((u / (1 - u)) / (p / (1 - p))) / (1 + (u / (1 - u)) / (p / (1 - p))) ELSE 1 END AS q FROM d
), cumulated AS (SELECT *, sum(n) OVER (PARTITION BY s ORDER BY q, doc_id, n) AS upto FROM ranked
), gaps AS (
  SELECT *, p > 0 AND upto <= rest AS drawn, rest - coalesce(max(CASE WHEN upto <= rest THEN upto END) OVER (PARTITION BY s), 0) AS gap FROM cumulated
), spare AS (
  SELECT s, q, doc_id, n, abs(sum(n)::DOUBLE - any_value(gap)) AS off, any_value(gap) AS gap FROM gaps WHERE NOT drawn AND p > 0 AND n > 0 GROUP BY s, q, doc_id, n
), nearest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY off, q, doc_id, n) AS k FROM spare WHERE off < gap) WHERE k = 1
)
SELECT g.doc_id, g.n AS size, g.source_size, g.target,
  CASE WHEN g.n > 0 THEN g.n * (g.whole + g.drawn::BIGINT + (NOT g.drawn AND b.k IS NOT NULL)::BIGINT) ELSE 0 END::BIGINT AS taken
FROM gaps g LEFT JOIN nearest b ON g.s IS NOT DISTINCT FROM b.s AND g.q = b.q AND g.doc_id IS NOT DISTINCT FROM b.doc_id AND g.n = b.n
"""

WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to FROM f
"""

QUALITY_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD_SQL}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD_SQL}')) AS lines FROM documents
), grams AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM d
), twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1
), repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id
), base AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN repeated r USING (doc_id)
), l AS (
  SELECT doc_id, source, trim(regexp_replace(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g'), ' ') AS line,
    len(regexp_extract_all(x, '{WORD_SQL}')) AS n FROM (SELECT doc_id, source, unnest(lines) AS x FROM d)
), common AS (
  SELECT u.source, u.line FROM (SELECT source, line, count(DISTINCT doc_id) AS c FROM l GROUP BY source, line) u
  JOIN (SELECT source, count(*) AS docs FROM documents GROUP BY source) h ON u.source IS NOT DISTINCT FROM h.source WHERE c > 10 AND c > 0.02 * docs
), gone AS (
  SELECT doc_id, sum(n) AS n FROM l x JOIN common c ON x.source IS NOT DISTINCT FROM c.source AND x.line = c.line GROUP BY doc_id
), judged AS (
  SELECT base.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(gone.n, 0) AS removed FROM base LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND removed <= 0.5 * n_words AS kept FROM judged
"""

QUOTED = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in licenses.TEMPLATES.items())
LICENSES_SQL = rf"""
WITH t(license, body) AS (VALUES {QUOTED}),
every_text AS (
  SELECT 't' || license AS k, regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}]+') AS w FROM t
  UNION ALL SELECT 'd' || doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') FROM documents
), shingles AS (
  SELECT DISTINCT k, unnest(list_transform(range(1, greatest(len(w) - 3, least(len(w), 1) + 1)), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM every_text
), size AS (SELECT k, count(*) AS n FROM shingles WHERE k[1] = 't' GROUP BY k
), found AS (
  SELECT a.k AS d, b.k AS t, count(*) AS n FROM shingles a JOIN shingles b USING (g) WHERE a.k[1] = 'd' AND b.k[1] = 't' GROUP BY ALL
)
SELECT substr(d, 2)::BIGINT AS doc_id, substr(t, 2) AS license, size.n::BIGINT AS n_shingles, found.n::BIGINT AS n_found, found.n / size.n AS containment
FROM found JOIN size ON found.t = size.k WHERE found.n >= 0.8 * size.n
"""


#: A CRC-32 is folded over the bytes of each distinct word, by a table made from the polynomial.
RESAMPLING_SQL = r"""
WITH byte AS (
  SELECT list(c ORDER BY i) AS crc FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS i)
  )
), texts AS (
  SELECT doc_id, text, false AS target FROM documents UNION ALL SELECT NULL, text, true FROM benchmark
), split AS (
  SELECT *, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts
), features AS (SELECT r, target, unnest(words) AS w FROM split
), spelt AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM features)
), hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c // 256, crc[xor(c, b) % 256 + 1])), 4294967295) % 10000 AS bucket FROM spelt, byte
), counts AS (SELECT bucket, count(*) FILTER (NOT target) AS s, count(*) FILTER (target) AS t FROM features JOIN hashed USING (w) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((sum(s) OVER ())::DOUBLE + 10000) / ((s + 1)::DOUBLE * ((sum(t) OVER ())::DOUBLE + 10000))))::BIGINT AS gain FROM counts
), sums AS (SELECT r, sum(gain)::BIGINT AS total FROM features JOIN hashed USING (w) JOIN gains USING (bucket) WHERE NOT target GROUP BY r
), scored AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, CASE WHEN len(words) > 0 THEN (total - ((total % len(words)) + len(words)) % len(words)) // len(words) ELSE 0 END::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS g
  FROM split LEFT JOIN sums USING (r) WHERE NOT target
), placed AS (
  SELECT *, weight + g AS score, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + g DESC, doc_id NULLS LAST, n_features) AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END::BIGINT AS rank FROM placed
"""


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    sql = {op2_mixing: MIXING_SQL, op3_license_scans: LICENSES_SQL, op7_warc: WARC_SQL, op8_quality_rules: QUALITY_SQL, op12_importance_resampling: RESAMPLING_SQL, pipeline: corpus_pipeline.ORACLE_SQL}
    return {f.__name__: s for f, s in sql.items() if s}
