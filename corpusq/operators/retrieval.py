"""Top-k retrieval and fusion for all queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusq.functions.text import rounded
from corpusq.operators import topk
from corpusq.shared import written


def top(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def arrow_kind(df: DataFrame, column: str):
    return to_arrow_type(df.schema[column].dataType)


def of_dims(df: DataFrame, dims: int) -> DataFrame:
    return df.where(F.size("v") == dims)


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int, threshold: float | None = None, own: bool = True) -> DataFrame:
    """(query_id, v) x (chunk_id, v) -> the k nearest by cosine, ties by chunk_id.

    Batches of the corpus are multiplied with the matrix of the queries, and each task hands on the k best of each query.
    own=False leaves out chunks whose id is the query's. Queries must have one number of dimensions; chunks of another, and
    vectors that are null or without length, are in no list.
    """
    q = queries.select("query_id", "v").where("v is not null")
    n, least, most = q.agg(F.count(F.lit(1)), F.min(F.size("v")), F.max(F.size("v"))).first()
    if least != most:
        raise ValueError(f"queries of {least} to {most} dimensions")
    c = of_dims(corpus.select("chunk_id", "v"), most or 0)
    kind = arrow_kind(c, "chunk_id")
    return top(topk.best_in_blocks(q, c, lambda t: topk.Dense(t, kind, k, threshold, own), n * ((most or 0) * 8 + 16)), k)


def words_of(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    return df.select(key, F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("words"))


def sparse_topk(queries: DataFrame, corpus: DataFrame, k: int, once: bool = False) -> DataFrame:
    """(query_id, text) x (chunk_id, text) -> the k best by the dot product of their word counts, ties by chunk_id; with
    `once` by how many different words they share. Chunks that share no word are in no list.

    Chunks are scored in the task that has their text, in order of impact, and blocks of them are skipped whose highest
    weights cannot reach a query's k-th score; no word is a key, so a frequent one is no task of its own.
    """
    q, c = words_of(queries, "query_id"), words_of(corpus, "chunk_id")
    size = q.agg(F.sum(F.length(F.array_join("words", " ")) * 2 + 16)).first()[0] or 0
    kind = arrow_kind(c, "chunk_id")
    return top(topk.best_in_blocks(q, c, lambda t: topk.Sparse(t, kind, k, once), size), k)


def shared_terms_topk(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """How many different terms a query and a chunk share."""
    return sparse_topk(queries, corpus, k, once=True)


def rrf_fuse(lists: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    all_lists = lists[0].select("query_id", "chunk_id", "rank")
    for x in lists[1:]:
        all_lists = all_lists.unionByName(x.select("query_id", "chunk_id", "rank"))
    return top(all_lists.groupBy("query_id", "chunk_id").agg(rounded(F.sum(1 / (F.lit(constant) + F.col("rank"))), 6).alias("score")), k)


def minmax(hits: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return hits.withColumn("normalized", F.when(high == low, 0.5).otherwise(rounded((F.col("score") - low) / (high - low), 6)))


def summary(hits: DataFrame, k: int) -> DataFrame:
    """rank and relevance (0, 1) of each hit -> means over queries of precision, recall, MRR and NDCG at k."""
    rel = F.when(F.col("rank") <= k, F.col("relevant")).otherwise(0)
    gain = rel / F.log2(F.col("rank") + 1)
    ideal = F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    q = hits.groupBy("query_id").agg(
        (F.sum(rel) / k).alias("p"), F.coalesce(F.sum(rel) / F.nullif(F.sum("relevant"), F.lit(0)), F.lit(0.0)).alias("r"), F.coalesce(1 / F.min(F.when(rel == 1, F.col("rank"))), F.lit(0.0)).alias("m"), (F.sum(gain) / ideal).alias("g")
    )
    return q.agg(F.count(F.lit(1)).alias("n"), *[rounded(F.avg(c), 4).alias(n) for c, n in (("p", "precision"), ("r", "recall"), ("m", "mrr"), ("g", "ndcg"))])


def rerank(hits: DataFrame, k: int, scorer=None) -> DataFrame:
    """(query_id, query, chunk_id, text, score) -> the k best by a scorer of (query, text) columns, the earlier score kept
    as cosine_score. By default the share of the query's different words that the text has."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    d = hits.withColumns({"_q": words(F.col("query")), "_t": words(F.col("text"))})
    own = F.when(F.size("_q") > 0, F.size(F.array_intersect("_q", "_t")) / F.size("_q")).otherwise(0.0)
    score = rounded(own if scorer is None else scorer(F.col("query"), F.col("text")), 6)
    return top(d.withColumnRenamed("score", "cosine_score").withColumn("score", score).drop("rank", "_q", "_t"), k)


def hybrid_topk(queries: DataFrame, corpus: DataFrame, k: int, prefetch: int = 60, constant: int = 60) -> DataFrame:
    """Dense and sparse lists of `prefetch` each, fused by rank. (query_id, v, text) x (chunk_id, v, text)."""
    dense = dense_topk(queries, corpus, prefetch)
    return rrf_fuse([dense, sparse_topk(queries.select("query_id", "text"), corpus.select("chunk_id", "text"), prefetch)], k, constant)


#: How many hits each mode of search fetches before it is cut.
FETCH = {"basic": 5, "hybrid": 15, "hybrid_rerank": 15, "rerank": 15}


def search(queries: DataFrame, corpus: DataFrame, modes: str | list[str], k: int, prefetch: int = 60, constant: int = 60, scorer=None) -> DataFrame:
    """(query_id, chunk_id, score, rank, mode) in one or several of the modes of FETCH.

    All modes share one dense and one sparse list: the n nearest are the first n of a longer list.
    """
    modes = [modes] if isinstance(modes, str) else list(modes)
    if unknown := set(modes) - set(FETCH):
        raise ValueError(f"unknown modes {sorted(unknown)}")
    hybrid = any(m.startswith("hybrid") for m in modes)
    depth = max(prefetch if hybrid else 0, *(max(FETCH[m], k) for m in modes))
    dense = written(dense_topk(queries, corpus, depth), "dense-list")
    fused = written(rrf_fuse([dense.where(F.col("rank") <= prefetch), sparse_topk(queries.select("query_id", "text"), corpus.select("chunk_id", "text"), prefetch)], depth, constant), "fused-list") if hybrid else None
    texts = queries.select("query_id", F.col("text").alias("query")), corpus.select("chunk_id", "text")
    out = None
    for m in modes:
        hits = (fused if m.startswith("hybrid") else dense).where(F.col("rank") <= max(FETCH[m], k))
        if m.endswith("rerank"):
            hits = rerank(hits.join(texts[0], "query_id").join(texts[1], "chunk_id"), k, scorer)
        hits = hits.where(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank", F.lit(m).alias("mode"))
        out = hits if out is None else out.unionByName(hits)
    return out


def retrieve(queries: DataFrame, corpus: DataFrame, k: int, hybrid: bool = False) -> DataFrame:
    """Three times as many hits as wanted, then cut."""
    hits = hybrid_topk(queries, corpus, 3 * k) if hybrid else dense_topk(queries, corpus, 3 * k)
    return hits.where(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank")


def to_sources(dense: DataFrame, sparse: DataFrame, corpus: DataFrame, search_type: str) -> DataFrame:
    """Hits of either list with text, file and the score in each: 0 where it is not in the sparse one, the other score
    where it is not in the dense one."""
    d = dense.select("query_id", "chunk_id", F.col("score").alias("cosine")).join(sparse.select("query_id", "chunk_id", F.col("score").alias("sparse")), ["query_id", "chunk_id"], "full")
    d = d.withColumns({"score": F.coalesce("cosine", "sparse"), "sparse": F.coalesce("sparse", F.lit(0.0))}).withColumn("cosine", F.coalesce(F.nullif("cosine", F.lit(0.0)), "score"))
    return d.join(corpus.select("chunk_id", "text", "source_file"), "chunk_id").withColumn("search_type", F.lit(search_type))


def binary_relevance(hits: DataFrame, answer: str, text: str) -> DataFrame:
    """Adds `relevant`: 1 if the text holds a word of the answer with three characters or more."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(answer), F.lit(""))), r"\s+", -1), lambda w: F.length(w) >= 3)
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    return hits.withColumn("relevant", F.exists(words, lambda w: F.contains(low, w)).cast("int"))


def per_query(queries: DataFrame, hits: DataFrame, k: int, truth: DataFrame | None = None) -> DataFrame:
    """Precision, recall, reciprocal rank, DCG and NDCG at k of every query, those without hits included. Recall is over
    what was retrieved, or over `truth` (query_id, n_relevant)."""
    rel = F.when(F.col("rank") <= k, F.col("relevant")).otherwise(0)
    discount = F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    d = hits.groupBy("query_id").agg(F.sum(rel).alias("_rel"), F.sum("relevant").alias("_all"), F.min(F.when(rel == 1, F.col("rank"))).alias("_first"), F.sum(rel * discount).alias("_dcg"), F.sum(discount).alias("_ideal"))
    d = queries.select("query_id").join(d, "query_id", "left")
    d = d.join(truth, "query_id", "left").withColumn("_all", F.col("n_relevant")) if truth is not None else d
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return d.select("query_id", rounded(F.coalesce(F.col("_rel"), F.lit(0)) / k, 4).alias("precision"), rounded(share("_rel", "_all"), 4).alias("recall"), rounded(F.coalesce(1 / F.col("_first"), F.lit(0.0)), 4).alias("mrr"), rounded(F.coalesce("_dcg", F.lit(0.0)), 4).alias("dcg"), rounded(share("_dcg", "_ideal"), 4).alias("ndcg"))


def spread(detail: DataFrame) -> DataFrame:
    """Mean and population deviation of each metric over queries."""
    names = ("precision", "recall", "mrr", "ndcg")
    return detail.agg(F.count(F.lit(1)).alias("n"), *[rounded(F.avg(c), 3).alias(c) for c in names], *[rounded(F.stddev_pop(c), 3).alias(f"{c}_std") for c in names])
