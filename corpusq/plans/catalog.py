"""All registered queries and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusq import shared
from corpusq.functions import text
from corpusq.operators import chat, chunking, evaluation, retrieval
from corpusq.plans import answers, ingest
from corpusq.sources import tables
from corpusq.sources.snapshots import ChunkTable


def table(spark, sf_dir, name):
    d = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return shared.spread(d) if name in ("documents", "pages") else d  # their texts are worth a task each core


def quality_profile_by_source(spark, sf_dir):
    d = text.signals(table(spark, sf_dir, "documents"))
    return text.mean_in_order(d, ["source", "profile"], "doc_id", "quality_score", docs=F.count(F.lit(1))).select("source", "profile", "docs", text.rounded(F.col("_mean"), 4).alias("score"))


def quality_signals(spark, sf_dir):
    d = text.signals(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "alpha_ratio", "ocr_noise_ratio", "broken_line_ratio", "header_footer_ratio", "table_density", "code_delimiter_ratio", "avg_sentence_length", "repeated_char_ratio", "script_changes", F.array_join("issue_tags", ",").alias("issue_tags"), "quality_score", "profile")


def estimate_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.estimate_tokens().alias("tokens"))


def split(spark, sf_dir):
    """Every vector whose id is divisible by 20 as a query, all vectors as the corpus."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.col("embedding").alias("v"), "label")
    return v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), v.withColumnRenamed("vec_id", "chunk_id")


def dense_topk(spark, sf_dir):
    q, c = split(spark, sf_dir)
    return retrieval.dense_topk(q, c, 10)


def sparse_topk(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id")
    return retrieval.sparse_topk(q, table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "chunk_id"), 10)


def retrieval_summary(spark, sf_dir):
    """Over all other vectors: a query's own row, always first and relevant, is left out."""
    q, c = split(spark, sf_dir)
    hits = retrieval.dense_topk(q, c, 10, own=False).join(q.select("query_id", F.col("label").alias("ql")), "query_id").join(c.select("chunk_id", "label"), "chunk_id")
    return retrieval.summary(hits.withColumn("relevant", (F.col("ql") == F.col("label")).cast("int")), 5)


def session_stats(spark, sf_dir):
    return chat.session_stats(table(spark, sf_dir, "conversations"))


def last_turns(spark, sf_dir):
    return chat.last_turns(table(spark, sf_dir, "conversations"), 2)


def history_block(spark, sf_dir):
    return chat.history_block(table(spark, sf_dir, "conversations"))


def derive_title(spark, sf_dir):
    return chat.derive_title(table(spark, sf_dir, "conversations"))


def l2_norms(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return v.select("vec_id", F.size("embedding").alias("dims"), text.rounded(norm, 6).alias("norm"), (F.abs(norm - 1) > 0.01).alias("off"))


def split_sentences(spark, sf_dir):
    return chunking.sentences(table(spark, sf_dir, "documents"))


def pack_chunks(spark, sf_dir):
    return chunking.pack_chunks(table(spark, sf_dir, "documents"))


def latency_percentiles(spark, sf_dir):
    return evaluation.latency_percentiles(table(spark, sf_dir, "events"), "event_type", "value")


def latest_status(spark, sf_dir):
    return evaluation.latest_status(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type", "value"])


def stage_durations(spark, sf_dir):
    return evaluation.stage_durations(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").drop("ts")


def feedback_summary(spark, sf_dir):
    rated = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return evaluation.feedback_summary(rated, "source", "quality")


def build_context(spark, sf_dir):
    """The ten best documents of each benchmark item by shared terms, as a context block with their quality and profile."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("file"), "text")
    hits = shared.written(sparse_topk(spark, sf_dir), "hits")
    of_hits = shared.written(text.signals(d.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi")), "hit-signals")  # once for each document
    return evaluation.build_context(hits.join(of_hits, "chunk_id"), quality="quality_score")


def upsert_chunks(spark, sf_dir):
    """A table of the documents; those with a label come again with it and take the place of what is there."""
    t = ChunkTable(spark, shared.new_path(spark, "chunks"), "doc_id")
    t.merge(table(spark, sf_dir, "documents").select("doc_id", "source", F.lit(0).alias("version")))
    t.merge(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("version"), "quality"), 1)
    return t.read().select("doc_id", "source", "version", "quality")


def delete_chunks(spark, sf_dir):
    """A table of the documents after those of a label are taken away."""
    t = ChunkTable(spark, shared.new_path(spark, "chunks"), "doc_id")
    t.merge(table(spark, sf_dir, "documents").select("doc_id", "source"))
    t.delete(table(spark, sf_dir, "labels").where("toxic = 1"), 1)
    return t.read()


def collection_info(spark, sf_dir):
    return tables.collection_info(table(spark, sf_dir, "embeddings"), "label", "embedding")


def dataset_bytes(spark, sf_dir):
    d = tables.dataset_bytes(table(spark, sf_dir, "documents"), "source", "text", "doc_id")
    return d.withColumn("size", text.human_size(F.col("bytes")))


def profile_columns(spark, sf_dir):
    return tables.profile_columns(table(spark, sf_dir, "documents"))


def truncate_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate(F.col("text"), 600).alias("text"))


def minmax_scores(spark, sf_dir):
    return retrieval.minmax(sparse_topk(spark, sf_dir)).select("query_id", "chunk_id", "score", "normalized")


def rrf_fusion(spark, sf_dir):
    """Two lists of each benchmark item: by weights of shared terms, and by how many terms are shared."""
    q, d = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id"), table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "chunk_id")
    return retrieval.rrf_fuse([retrieval.sparse_topk(q, d, 10), retrieval.shared_terms_topk(q, d, 10)], 10)


QUERIES = (
    upsert_chunks, delete_chunks, collection_info, dataset_bytes, profile_columns, truncate_text, minmax_scores, rrf_fusion,
    split_sentences, pack_chunks, latency_percentiles, latest_status, stage_durations, feedback_summary, build_context,
    quality_profile_by_source, quality_signals, estimate_tokens, dense_topk, sparse_topk, retrieval_summary, session_stats, last_turns, history_block, derive_title, l2_norms,
)


def queries() -> dict:
    return {f.__name__: f for f in (*QUERIES, *ingest.QUERIES, *answers.QUERIES)}


def r(x: str, places: int = 4) -> str:
    return f"floor(({x}) * {10**places} + 0.5::DOUBLE) / {10**places}::DOUBLE"


def counted(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


LINE = "(len(list_filter(l, lambda x: regexp_matches(x, '{}'))) / len(l))"
REPEATED = "|".join(f"{c}{{5,}}" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
SIGNALS = f"""
s0 AS (SELECT doc_id, source, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS l, greatest(length(coalesce(text, '')), 1)::DOUBLE AS n,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?。！？]+'), lambda x: regexp_matches(x, '{text.NW}')) AS s FROM documents),
s1 AS (SELECT doc_id, source, t, {counted("t", text.LETTERS)} / n AS a, {counted("t", text.NOISE)} / n AS o, {LINE.format(text.BROKEN)} AS b, {LINE.format("(?i)" + text.HEADER)} AS h, {LINE.format(text.TABLE)} AS d,
  {counted("t", REPEATED)} / n AS c, ({counted("t", "[{}\\[]")} + {counted("t", " {4,}")}) / n AS k,
  CASE WHEN len(s) > 0 THEN {r(f"list_sum(list_transform(s, lambda x: {counted('x', text.NW + '+')})) / len(s)", 2)} ELSE 0 END AS w,
  greatest({counted(f"regexp_replace(t, '{text.WS}', '', 'g')", text.script_runs().replace("Is", ""))} - 1, 0)::INT AS script_changes FROM s0),
s2 AS (SELECT *, {r("a")} AS alpha_ratio, {r("o")} AS ocr_noise_ratio, {r("b")} AS broken_line_ratio, {r("h")} AS header_footer_ratio, {r("d")} AS table_density, {r("k")} AS code_delimiter_ratio, {r("c")} AS repeated, w AS avg_sentence_length,
  o > 0.01 OR b > 0.25 OR d > 0.05 OR h > 0.1 OR c > 0.005 OR k > 0.03 OR script_changes > 10 OR t = '' AS tagged,
  CASE WHEN t = '' THEN 'empty' ELSE array_to_string(list_filter([CASE WHEN o > 0.01 THEN 'ocr_noise' END, CASE WHEN b > 0.25 THEN 'broken_lines' END, CASE WHEN d > 0.05 THEN 'table_heavy' END, CASE WHEN h > 0.1 THEN 'header_footer_noise' END,
    CASE WHEN c > 0.005 THEN 'repeated_chars' END, CASE WHEN k > 0.03 THEN 'code_delimiters' END, CASE WHEN script_changes > 10 THEN 'mixed_scripts' END], lambda x: x IS NOT NULL), ',') END AS issue_tags FROM s1),
s3 AS (SELECT *, greatest(0::DOUBLE, least(1::DOUBLE, {r("1::DOUBLE - 0.4::DOUBLE * ocr_noise_ratio - 0.15::DOUBLE * broken_line_ratio - 0.1::DOUBLE * header_footer_ratio - CASE WHEN w < 5 THEN 0.1::DOUBLE ELSE 0 END - 0.3::DOUBLE * repeated")})) AS score FROM s2)"""
PROFILED = """profiled AS (SELECT *, score AS quality_score, CASE WHEN table_density > 0.05 THEN 'table_heavy' WHEN code_delimiter_ratio > 0.03 THEN 'code_mixed' WHEN ocr_noise_ratio > 0.005 OR repeated > 0.002 THEN 'ocr_noisy' WHEN score >= 0.85 AND NOT tagged THEN 'clean_text' ELSE 'general' END AS profile FROM s3)"""
DENSE = f"""
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v, label AS ql FROM embeddings WHERE vec_id % 20 = 0), c AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS v, label FROM embeddings),
scored AS (SELECT query_id, chunk_id, ql, label, {r("list_cosine_similarity(q.v, c.v)", 6)} AS score FROM q, c WHERE {{}}),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= 10)"""


def oracle_sql() -> dict:
    w = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')"
    turns = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= {}"
    sparse = f"WITH a AS (SELECT item_id AS query_id, term, count(*) AS n FROM (SELECT item_id, unnest({w}) AS term FROM benchmark) GROUP BY ALL), b AS (SELECT doc_id AS chunk_id, term, count(*) AS m FROM (SELECT doc_id, unnest({w}) AS term FROM documents) GROUP BY ALL), s AS (SELECT query_id, chunk_id, sum(n * m)::DOUBLE AS score FROM a JOIN b USING (term) GROUP BY ALL) SELECT query_id, chunk_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10"
    last = lambda c: f"arg_max({c}, (ts, event_id)) FILTER ({c} IS NOT NULL) AS {c}"
    at = lambda p: f"min(CASE WHEN k > floor(n * {p}::DOUBLE) THEN value END) AS p{round(p * 100)}"
    shared = sparse.replace("sum(n * m)::DOUBLE", "count(*)::DOUBLE")
    size = lambda k, p, unit: f"printf('%.{p}f', {r(f'bytes / {1024**k}::DOUBLE', p)}) || ' {unit}'"
    profiled = [("doc_id", "numeric"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "numeric")]
    own = {
        "upsert_chunks": "SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN d.source END AS source, (l.doc_id IS NOT NULL)::INT AS version, l.quality FROM documents d FULL JOIN labels l USING (doc_id)",
        "delete_chunks": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
        "collection_info": "SELECT label, count(*) AS points, count(embedding) AS vectors, CASE WHEN count(embedding) > 0 THEN 'green' ELSE 'empty' END AS status FROM embeddings GROUP BY label",
        "dataset_bytes": f"SELECT *, CASE WHEN bytes < 1024 THEN bytes || ' B' WHEN bytes < {1024**2} THEN {size(1, 1, 'KB')} WHEN bytes < {1024**3} THEN {size(2, 1, 'MB')} ELSE {size(3, 2, 'GB')} END AS size "
        "FROM (SELECT source, coalesce(sum(octet_length(encode(text))), 0)::BIGINT AS bytes, max(doc_id) AS last_update FROM documents GROUP BY source)",
        "profile_columns": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{k}' AS kind, count(*) FILTER ({c} IS NULL) AS n_nulls, {r(f'avg(length({c}))') if k == 'string' else 'NULL::DOUBLE'} AS mean_length FROM documents" for c, k in profiled),
        "truncate_text": "SELECT doc_id, CASE WHEN length(text) > 600 THEN substr(text, 1, 600) || '...' ELSE text END AS text FROM documents",
        "minmax_scores": f"SELECT query_id, chunk_id, score, CASE WHEN hi = lo THEN 0.5 ELSE {r('(score - lo) / (hi - lo)', 6)} END AS normalized FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM ({sparse}))",
        "rrf_fusion": f"SELECT query_id, chunk_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, {r('sum(1 / (60 + rank))', 6)} AS score FROM (SELECT * FROM ({sparse}) UNION ALL SELECT * FROM ({shared})) GROUP BY ALL)) WHERE rank <= 10",
        "split_sentences": "WITH m AS (SELECT doc_id, regexp_replace(text, '([.!?。！？])\\s+', '\\1' || chr(1), 'g') AS t FROM documents), "
        "p AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM m) "
        "SELECT doc_id, unnest(range(len(l)))::INT AS sentence_index, unnest(l) AS sentence FROM p",
        "latency_percentiles": f"SELECT event_type, max(n) AS n, {at(0.5)}, {at(0.9)}, {at(0.99)} FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) GROUP BY event_type",
        "latest_status": f"SELECT user_id, {last('event_type')}, {last('value')} FROM events GROUP BY user_id",
        "stage_durations": "WITH c AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) "
        "SELECT user_id, event_id, event_type, (floor(epoch(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) - floor(epoch(ts)))::BIGINT AS seconds FROM c WHERE was IS NULL OR was <> event_type",
        "feedback_summary": "SELECT source, count(*) FILTER (quality = 1) AS up, count(*) FILTER (quality = 0) AS down, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source",
        "build_context": f"WITH {SIGNALS}, {PROFILED} SELECT query_id, string_agg('[Source ' || rank || ' | Dataset: unknown | Split: unknown | Quality: ' || printf('%.3f', quality_score) || ' | Profile: ' || profile || CASE WHEN source <> '' THEN ' | File: ' || source ELSE '' END || ']' || chr(10) || t || chr(10), chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM ({sparse}) h JOIN profiled d ON h.chunk_id = d.doc_id GROUP BY query_id",
        "quality_profile_by_source": f"WITH {SIGNALS}, {PROFILED} SELECT source, profile, count(*) AS docs, {r('avg(score)')} AS score FROM profiled GROUP BY ALL",
        "quality_signals": f"WITH {SIGNALS}, {PROFILED} SELECT doc_id, alpha_ratio, ocr_noise_ratio, broken_line_ratio, header_footer_ratio, table_density, code_delimiter_ratio, avg_sentence_length, repeated AS repeated_char_ratio, script_changes, issue_tags, quality_score, profile FROM profiled",
        "estimate_tokens": "SELECT doc_id, greatest(1, length(coalesce(text, '')) // 4)::BIGINT AS tokens FROM documents",
        "dense_topk": f"WITH {DENSE.format('true')} SELECT query_id, chunk_id, score, rank::INT AS rank FROM hits",
        "sparse_topk": sparse,
        "retrieval_summary": f"WITH {DENSE.format('query_id <> chunk_id')}, e AS (SELECT query_id, sum(CASE WHEN rank <= 5 AND ql = label THEN 1 ELSE 0 END) / 5 AS p, coalesce(sum(CASE WHEN rank <= 5 AND ql = label THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN ql = label THEN 1 ELSE 0 END), 0), 0) AS rc, coalesce(1 / min(CASE WHEN rank <= 5 AND ql = label THEN rank END), 0) AS m, sum(CASE WHEN rank <= 5 AND ql = label THEN 1 / log2(rank + 1) ELSE 0 END) / sum(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END) AS g FROM hits GROUP BY query_id) SELECT count(*) AS n, {r('avg(p)')} AS precision, {r('avg(rc)')} AS recall, {r('avg(m)')} AS mrr, {r('avg(g)')} AS ndcg FROM e",
        "session_stats": "SELECT conv_id, count(*) AS message_count, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations GROUP BY conv_id",
        "last_turns": f"SELECT conv_id, turn, role, text FROM ({turns.format(4)})",
        "history_block": f"SELECT conv_id, string_agg(upper(role[1]) || role[2:] || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS history FROM ({turns.format(12)}) GROUP BY conv_id",
        "derive_title": "SELECT conv_id, trim(substr(arg_min(text, turn), 1, 80), ' ') AS title FROM conversations WHERE role = 'user' GROUP BY conv_id",
        "l2_norms": f"SELECT vec_id, len(embedding)::INT AS dims, {r('sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))', 6)} AS norm, abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) - 1) > 0.01 AS off FROM embeddings",
    }
    return own | ingest.oracle_sql(SIGNALS, PROFILED, r, own["split_sentences"]) | answers.oracle_sql(r, own["split_sentences"], sparse)
