"""Semantic, full-text and hybrid search as DataFrame pipelines.

The order of steps matters: path filter, top-k, tag filter, rerank of the head, truncation, minimum score, context.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakequill.operators.embed import vectors_of, with_retry
from lakequill.operators.segments import SegmentIndex, postings, query_terms, tokens, weight  # noqa: F401  postings: for callers
from lakequill.runtime import stored
from lakequill.schema import POOL_FACTOR, POOL_MAX, POOL_MIN, RRF_K, TAG_OVERFETCH


@dataclass
class SearchOptions:
    query: str = ""
    limit: int = 10
    min_score: float | None = None
    mode: str = "hybrid"
    path_filter: str | None = None
    tag_filter: str | None = None
    context: int = 0
    rerank: object | None = None
    vector: list[float] = field(default_factory=list)
    embed: object | None = None

    def query_vector(self) -> list[float]:
        """The vector, or else the query's own by embed, a function from texts to vectors, which is asked once, with retries."""
        if not self.vector and self.embed is not None:
            self.vector = list(vectors_of(with_retry(self.embed, [self.query]))[0])
        return self.vector

    def pool(self) -> int:
        """Rows that are fetched for the reranker."""
        return min(max(POOL_FACTOR * self.limit, POOL_MIN), POOL_MAX)

    def fetch_limit(self) -> int:
        return (self.pool() if self.rerank else self.limit) * (TAG_OVERFETCH if self.tag_filter else 1)


def path_filter(df: DataFrame, prefix: str | None) -> DataFrame:
    """LIKE 'prefix%': % and _ in the prefix are wildcards; a backslash is itself."""
    return df if prefix is None else df.where(F.col("file_path").like(prefix.replace("\\", "\\\\") + "%"))


def has_tag(frontmatter, tag: str):
    """Whether tags of a frontmatter JSON hold tag exactly; false without tags or where they aren't a list."""
    return F.coalesce(F.array_contains(F.from_json(frontmatter, "tags array<string>").getField("tags"), tag), F.lit(False))


def _norm(v):
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def cosine_distance(v, query: list[float]):
    """1 - cosine of a vector column and a query, in double precision; null for a zero vector."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = v.cast("array<double>")
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    size = sum(x * x for x in map(float, query)) ** 0.5
    return 1 - dot / F.nullif(_norm(v) * F.lit(size), F.lit(0.0))


def similarity(distance):
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance / 2))


def semantic(chunks: DataFrame, query: list[float], limit: int, key: str = "chunk_id", vector: str = "vector") -> DataFrame:
    """The limit nearest rows with semantic_score; ties go to the smaller key. Each partition keeps limit rows."""
    near = chunks.withColumn("_d", cosine_distance(F.col(vector), query)).where(F.col("_d").isNotNull())
    return near.orderBy("_d", key).limit(limit).withColumn("semantic_score", similarity(F.col("_d"))).drop("_d")


def write_index(chunks: DataFrame, root: str, key: str = "chunk_id", text: str = "body", source=None) -> None:
    """Store a full-text index of these rows in place of the one below root; source: what they are, such as a table's version."""
    SegmentIndex(chunks.sparkSession, root, key, chunks.schema[key].dataType.simpleString()).rebuild(chunks, text, source)


def bm25_indexed(spark, root: str, query: str, limit: int, key: str = "chunk_id", key_type: str = "string") -> DataFrame:
    """(key, fts_raw) of the limit best rows of a stored index; the same as bm25 over its rows."""
    return SegmentIndex(spark, root, key, key_type).search(query, limit)


def bm25(chunks: DataFrame, query: str, limit: int, key: str = "chunk_id", text: str = "body") -> DataFrame:
    """(key, fts_raw) of the limit best rows. Texts are read once, into a narrow table of lengths and term counts; statistics of the corpus are one aggregate of it, and only its rows that hold a term go on."""
    terms = query_terms(query)
    if not terms:
        return chunks.select(key, F.lit(0.0).alias("fts_raw")).where("false")
    words = chunks.select(key, tokens(F.col(text)).alias("w")).withColumn("dl", F.size("w"))
    arr = F.array(*map(F.lit, terms))
    tf = words.select(key, "dl", F.transform(arr, lambda t: F.size(F.filter("w", lambda x: x == t))).alias("tf"))
    tf = stored(tf, "term-counts")
    stats = tf.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(terms))))
    hit = tf.where(F.exists("tf", lambda x: x > 0)).crossJoin(F.broadcast(stats))  # stats: one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        f = F.col("tf")[i]
        score = score + F.when(f > 0, weight(f, F.col("dl"), F.col(f"df{i}"), F.col("n"), F.col("avgdl"))).otherwise(0.0)
    return hit.select(key, score.alias("fts_raw")).orderBy(F.desc("fts_raw"), key).limit(limit)


def by_maximum(score: str):
    """score over the largest score of the set, 0 where that is not positive."""
    top = F.greatest(F.lit(0.0), F.max(score).over(Window.partitionBy(F.lit(0))))
    return F.when(top > 0, F.col(score) / top).otherwise(0.0)


def fuse(semantic_rows: DataFrame, fts_rows: DataFrame, limit: int, key: str = "chunk_id", k: int = RRF_K) -> DataFrame:
    """(key, relevance, semantic_score, fts_raw): reciprocal-rank fusion of two top lists of bounded length."""
    one = lambda *order: F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))  # noqa: E731  lists of limit rows
    a = semantic_rows.select(key, "semantic_score", one(F.desc("semantic_score"), F.col(key)).alias("r1"))
    b = fts_rows.select(key, "fts_raw", one(F.desc("fts_raw"), F.col(key)).alias("r2"))
    both = a.join(b, key, "full_outer")
    rel = F.coalesce(1.0 / (k + F.col("r1")), F.lit(0.0)) + F.coalesce(1.0 / (k + F.col("r2")), F.lit(0.0))
    return both.select(key, rel.alias("relevance"), "semantic_score", "fts_raw").orderBy(F.desc("relevance"), key).limit(limit)


def ordinals(chunks: DataFrame, tie: str = "chunk_id") -> DataFrame:
    """chunks with `at`, their place in their file from 1."""
    return chunks.withColumn("at", F.row_number().over(Window.partitionBy("file_path").orderBy("line_start", "line_end", tie)))


def context(chunks: DataFrame, results: DataFrame, n: int, tie: str = "chunk_id") -> DataFrame:
    """Neighbours of each result: n chunks before and after it in its file, by line; result_index is the parent's. Neighbours may repeat results and each other."""
    wanted = results.select("file_path").distinct()
    own = chunks.join(wanted, "file_path", "left_semi")
    placed = ordinals(own, tie)
    match = placed.select("file_path", "line_start", "line_end", "at").groupBy("file_path", "line_start", "line_end").agg(F.min("at").alias("mid"))
    mid = results.select("file_path", "line_start", "line_end", "result_index").join(match, ["file_path", "line_start", "line_end"]).select("file_path", "mid", "result_index")
    near = placed.join(mid, "file_path").where((F.abs(F.col("at") - F.col("mid")) <= n) & (F.col("at") != F.col("mid")))
    return near.withColumn("context_for_index", F.col("result_index"))


def rerank_scores(results: DataFrame, order: DataFrame) -> DataFrame:
    """results (result_index) in the order given (position, result_index), the rest behind in their own; score 1 - rank / (n - 1)."""
    n = results.agg(F.count("*").alias("_n"))
    placed = results.join(order.select("result_index", "position"), "result_index", "left").crossJoin(F.broadcast(n))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.coalesce("position", F.lit(2**31)), "result_index")) - 1
    return placed.withColumn("rank", rank).withColumn("similarity_score", 1 - F.col("rank") / F.greatest(F.col("_n") - 1, F.lit(1))).drop("_n", "position")


def is_permutation(indices, n):
    """Whether an array column holds every number from 0 to n - 1 once."""
    return F.coalesce((F.size(indices) == n) & (F.array_sort(indices) == F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))), F.lit(False))


def search(chunks: DataFrame, options: SearchOptions, index_root: str | None = None, metrics=None, source=None) -> DataFrame:
    """Results with similarity_score, semantic_score, fts_score, is_context and context_for_index, in order of `ordinal`.

    rerank of the options: a function from the query and the pool's bodies to their order, or an object whose order()
    takes the query and the pool's rows. A pool of one row isn't reranked; an order that isn't whole fails the search.

    index_root: a full-text index of these chunks; it serves searches without a path filter. source: what the chunks are,
    such as their table's version; an index of another source isn't used, the rows are then read instead.
    """

    def full_text(rows, fetch):
        if index_root and options.path_filter is None and (source is None or SegmentIndex(chunks.sparkSession, index_root).state()["source"] == source):
            return bm25_indexed(chunks.sparkSession, index_root, options.query, fetch)
        return bm25(rows, options.query, fetch)

    if metrics is not None:
        metrics.add("search_queries_total")
    o = options
    rows, fetch = path_filter(chunks, o.path_filter), o.fetch_limit()
    none = F.lit(None).cast("double")
    if o.mode == "semantic":
        top = semantic(rows, o.query_vector(), fetch).withColumn("fts_score", none).withColumn("similarity_score", F.col("semantic_score"))
    elif o.mode == "fts":
        got = full_text(rows, fetch)
        top = rows.join(F.broadcast(got), "chunk_id").withColumn("semantic_score", none).withColumn("fts_score", by_maximum("fts_raw")).withColumn("similarity_score", F.col("fts_score")).drop("fts_raw")
    elif o.mode == "hybrid":
        got = fuse(semantic(rows.select("chunk_id", "vector"), o.query_vector(), fetch), full_text(rows, fetch), fetch)
        top = rows.join(F.broadcast(got), "chunk_id").withColumn("fts_score", by_maximum("fts_raw")).withColumn("fts_score", F.when(F.col("fts_raw").isNotNull(), F.col("fts_score"))).withColumn("similarity_score", by_maximum("relevance")).drop("fts_raw", "relevance")
    else:
        raise ValueError(f"unknown mode {o.mode}")
    if o.tag_filter:
        top = top.where(has_tag(F.col("frontmatter_json"), o.tag_filter))
    index = lambda df: df.withColumn("result_index", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("similarity_score"), "chunk_id")) - 1)
    top = index(top)
    if o.rerank:
        top = top.where(F.col("result_index") < o.pool())
        top = top.persist()
        texts = [(r["result_index"], r["body"]) for r in top.orderBy("result_index").select("result_index", "body").collect()]  # the pool: POOL_MAX rows at most
        if len(texts) > 1:
            order = o.rerank.order(o.query, top) if hasattr(o.rerank, "order") else list(o.rerank(o.query, [t for _, t in texts]))
            if sorted(order) != list(range(len(texts))):
                raise ValueError("the reranker didn't return a permutation")
            given = chunks.sparkSession.createDataFrame([(p, texts[i][0]) for p, i in enumerate(order)], "position int, result_index int")
            top = rerank_scores(top, given).withColumn("result_index", F.col("rank")).drop("rank")
    top = top.where(F.col("result_index") < o.limit)
    if o.min_score is not None:
        top = top.where(F.col("similarity_score") >= o.min_score)
    top = top.withColumn("is_context", F.lit(False)).withColumn("context_for_index", F.lit(None).cast("int")).withColumn("ordinal", F.struct(F.lit(0).alias("c"), F.col("result_index").alias("i"), F.lit(0).alias("at")))
    cols = [*chunks.columns, "similarity_score", "semantic_score", "fts_score", "is_context", "context_for_index", "ordinal"]
    out = top.select(cols)
    if o.context > 0:
        more = context(chunks, top, o.context).withColumn("similarity_score", F.lit(0.0)).withColumn("semantic_score", none).withColumn("fts_score", none).withColumn("is_context", F.lit(True))
        out = out.unionByName(more.withColumn("ordinal", F.struct(F.lit(1).alias("c"), F.col("result_index").alias("i"), F.col("at").alias("at"))).select(cols))
    return out.orderBy("ordinal")
