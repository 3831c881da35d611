"""Queries over the chunk table, the asset cache, composed assets, embedding and whole searches, and an independent SQL statement for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakequill.functions.format import to_json_rows
from lakequill.operators import assets, chunking, search
from lakequill.operators.embed import Embedded, embed_chunks
from lakequill.operators.store import ChunkStore
from lakequill.runtime import shared_path
from lakequill.sources import files
from lakequill.streaming.apply import apply_batch


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _files(spark, d):
    return _t(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"), "doc_id", "text")


def _sizes(texts):
    """An embedder whose vectors say how many characters and how many letters e a text has; its service counts characters as tokens."""
    return Embedded([[float(len(t)), float(t.count("e"))] for t in texts], sum(map(len, texts)))


def _embedded(rows):
    return embed_chunks(chunking.with_id(chunking.with_hash(chunking.chunk_files(rows))), _sizes, "sizes", 2)


def k1_append_delete(spark, d):
    """Two appends into an empty table, a deletion by files, and what is then orphaned."""
    rows, store = _files(spark, d), ChunkStore(spark, shared_path(spark, "store"))
    empty = store.read().count()
    store.append(_embedded(rows.where("doc_id % 2 = 0")))
    store.append(_embedded(rows.where("doc_id % 2 = 1")))
    store.append(_embedded(rows.where("false")))
    store.delete_files(rows.where("doc_id % 4 = 0").select("file_path"))
    pruned = store.prune(rows.where("doc_id % 5 <> 1").select("file_path"))
    got = store.read().select("file_path", "line_start", "line_end", "content_hash")
    return got.withColumn("empty_at_first", F.lit(empty == 0)).withColumn("pruned_files", F.lit(pruned))


def k3_delete_all(spark, d):
    """A table that is emptied and filled with other files."""
    rows, store = _files(spark, d), ChunkStore(spark, shared_path(spark, "store"))
    store.append(_embedded(rows))
    store.delete_all()
    left = store.read().count()
    store.append(_embedded(rows.where("doc_id % 3 = 0")))
    return store.read().groupBy("file_path").agg(F.count("*").alias("chunks")).withColumn("left_over", F.lit(left))


def r3_apply(spark, d):
    """The table of the documents as they were, after the events that made them what they are: files that came, went and changed."""
    rows, store = _files(spark, d), ChunkStore(spark, shared_path(spark, "store"))
    old = rows.where("doc_id % 5 <> 0").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.lit("an older text")).otherwise(F.col("text")))
    store.append(_embedded(old))
    kind = F.when(F.col("doc_id") % 7 == 0, "remove").when(F.col("doc_id") % 5 == 0, "create").when(F.col("doc_id") % 3 == 0, "modify").otherwise("access")
    events = rows.select(F.col("doc_id").alias("seq"), kind.alias("kind"), F.col("file_path").alias("path"), F.lit(None).cast("string").alias("new_path"))
    read = lambda paths: rows.join(paths, "file_path").select("file_path", "text", F.lit(None).cast("string").alias("error"))
    n, gone = apply_batch(events, store, read, _embedded)
    return store.read().select("file_path", "line_start", "line_end", "content_hash").withColumn("files_indexed", F.lit(n)).withColumn("files_deleted", F.lit(gone))


def s9_asset_cache(spark, d):
    """Documents as assets: some texts are in the cache by their bytes' hash, a blank one counts as missing."""
    rows = _files(spark, d).where("text is not null").select("file_path", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), "doc_id", "text")
    cache = assets.AssetCache(spark, shared_path(spark, "cache"))
    cache.add(rows.where("doc_id % 3 = 0").select("sha256", F.concat(F.lit("# "), F.substring("text", 1, 20)).alias("text")).distinct())
    cache.add(rows.where("doc_id % 3 = 1").select("sha256", F.lit(" \n").alias("text")).distinct())
    return files.cached(rows.select("file_path", "sha256"), cache.read()).select("file_path", F.md5("synthetic").alias("synthetic_md5"))


def e2_compose(spark, d):
    """Parts as extracted assets: documents with text and an image, scanned ones, and images."""
    p = _t(spark, d, "part").withColumn("k", F.col("p_partkey") % 3)
    name = F.concat(F.lit("in/"), F.regexp_replace("p_name", " ", "_"), F.col("p_partkey").cast("string"), F.when(F.col("k") == 2, ".png").otherwise(".pdf"))
    image = lambda page, n, text: F.struct(F.lit(page).alias("page"), F.lit(n).alias("n"), text.alias("text"))
    images = F.when(F.col("k") == 0, F.array(image(2, 1, F.col("p_type")))).when(F.col("k") == 1, F.array(image(1, 1, F.col("p_name")), image(2, 1, F.concat_ws("\n", "p_brand", "p_type")))).otherwise(F.array(image(1, 1, F.col("p_brand"))))
    rows = p.select(name.alias("file_path"), F.lit("x").alias("sha256"), F.element_at(F.array(F.lit("text_first"), F.lit("needs_vision"), F.lit("image")), (F.col("k") + 1).cast("int")).alias("kind"), F.when(F.col("k") == 0, F.array("p_name", F.lit(""))).otherwise(F.array().cast("array<string>")).alias("pages"), images.alias("images"), F.when(F.col("p_partkey") % 10 == 0, "failed").alias("error"))
    return assets.compose(rows).select("file_path", "text")


def p1_embed(spark, d):
    """Vectors of texts in requests of fifty, and the tokens that the requests were counted."""
    rows = _t(spark, d, "documents").where("text is not null").select("doc_id", F.col("text").alias("body"))
    got = embed_chunks(rows, _sizes, "sizes", 2)
    return got.select("doc_id", F.col("vector")[0].cast("long").alias("n_chars"), F.col("vector")[1].cast("long").alias("n_e"), "embedding_model", F.lit(got.agg(F.sum("request_tokens")).first()[0]).alias("all_tokens"))


def _vectors(spark, d):
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"), F.lit("# H").alias("heading_breadcrumb"), F.substring("text", 1, 60).alias("body"), F.col("doc_id").alias("line_start"), (F.col("doc_id") + 3).alias("line_end"), F.to_json(F.struct(F.array("lang").alias("tags"))).alias("frontmatter_json"))
    return e.join(docs, "chunk_id")


def _first_vector(spark, d):
    return list(_t(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0])


def q6_rerank(spark, d):
    """A search whose reranker turns the pool round: the pool is larger than the limit, and its size sets the scores."""
    vector = _first_vector(spark, d)
    options = search.SearchOptions(query="any", mode="semantic", limit=5, embed=lambda texts: [vector] * len(texts), rerank=lambda q, texts: list(range(len(texts)))[::-1])
    return search.search(_vectors(spark, d), options).select("chunk_id", F.round("similarity_score", 6).alias("score"), F.round("semantic_score", 6).alias("semantic_score"))


def u1_context_rows(spark, d):
    """A search with a tag, which takes three times the limit first, and neighbours of each result after all results."""
    rows = _vectors(spark, d).withColumn("file_path", F.concat(F.lit("f"), (F.col("chunk_id") % 50).cast("string")))
    options = search.SearchOptions(mode="semantic", limit=4, tag_filter="en", context=1, vector=_first_vector(spark, d))
    got = search.search(rows, options)
    return got.select("chunk_id", "is_context", F.col("context_for_index").cast("int").alias("context_for_index"), F.round("similarity_score", 6).alias("score"))


def k7_json_output(spark, d):
    """The JSON lines of a search, read again."""
    options = search.SearchOptions(mode="semantic", limit=6, vector=_first_vector(spark, d))
    lines = to_json_rows(search.search(_vectors(spark, d), options))
    one = "struct<body:string,file_path:string,heading_breadcrumb:string,similarity_score:double,fts_score:double,line_range:struct<start:bigint,end:bigint>,is_context:boolean>"
    back = lines.select("json", F.from_json("json", one).alias("x"))
    return back.select("x.file_path", "x.body", F.round("x.similarity_score", 6).alias("score"), "x.line_range.start", "x.line_range.end", F.array_join(F.json_object_keys("json"), ",").alias("keys"))


def queries():
    return {f.__name__: f for f in (k1_append_delete, k3_delete_all, r3_apply, s9_asset_cache, e2_compose, p1_embed, q6_rerank, u1_context_rows, k7_json_output)}


_PATH = "source || '/' || doc_id || '.md'"


def oracle_sql(chunks: str, similarity: str, front: str):
    """chunks: a WITH clause that ends with k, the chunks of the documents; similarity: of e and q; front: the JSON of no front matter."""
    hashed = f"sha256(body || '{front}') AS content_hash"
    doc = "split_part(split_part(file_path, '/', 2), '.', 1)::BIGINT"
    ranked = f"t AS (SELECT e.vec_id, {similarity} AS s, row_number() OVER (ORDER BY {similarity} DESC, e.vec_id) - 1 AS at_ FROM embeddings e JOIN documents ON doc_id = e.vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"
    base = "p_partkey, p_partkey % 3 AS k, replace(p_name, ' ', '_') || p_partkey AS stem, p_name, p_brand, p_type FROM part WHERE p_partkey % 10 <> 0"
    return {
        "k1_append_delete": chunks + f", g AS (SELECT *, {doc} AS d FROM k) SELECT file_path, line_start::BIGINT AS line_start, line_end::BIGINT AS line_end, {hashed}, true AS empty_at_first, (SELECT count(DISTINCT file_path) FROM g WHERE d % 4 <> 0 AND d % 5 = 1)::INT AS pruned_files FROM g WHERE d % 4 <> 0 AND d % 5 <> 1",
        "k3_delete_all": chunks + f"SELECT file_path, count(*) AS chunks, 0 AS left_over FROM k WHERE {doc} % 3 = 0 GROUP BY 1",
        "r3_apply": chunks + f", n AS (SELECT count(*) FILTER (doc_id % 7 <> 0 AND (doc_id % 5 = 0 OR doc_id % 3 = 0))::INT AS i, count(*) FILTER (doc_id % 7 = 0)::INT AS d FROM documents) SELECT file_path, line_start::BIGINT AS line_start, line_end::BIGINT AS line_end, {hashed}, i AS files_indexed, n.d AS files_deleted FROM k, n WHERE {doc} % 7 <> 0",
        "s9_asset_cache": f"WITH r AS (SELECT {_PATH} AS file_path, doc_id, text FROM documents WHERE text IS NOT NULL), c AS (SELECT text, min('# ' || substr(text, 1, 20)) AS s FROM r WHERE doc_id % 3 = 0 GROUP BY 1) SELECT file_path, md5(s) AS synthetic_md5 FROM r LEFT JOIN c USING (text)",
        "e2_compose": f"""SELECT 'in/' || stem || CASE WHEN k = 2 THEN '.png' ELSE '.pdf' END AS file_path, CASE k WHEN 0 THEN '# Source: ' || stem || '.pdf' || chr(10) || chr(10) || '## Page 1' || chr(10) || chr(10) || p_name || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Page 2' || chr(10) || chr(10) || '> **[Image: ' || stem || '_page_2_image_1.png]** ' || p_type
WHEN 1 THEN '# Source: ' || stem || '.pdf' || chr(10) || chr(10) || '> **[Image: ' || stem || '_page_1.png]** ' || p_name || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '> **[Image: ' || stem || '_page_2.png]** ' || p_brand || chr(10) || '> ' || p_type
ELSE '# ' || stem || '.png' || chr(10) || chr(10) || '> **[Image: ' || stem || '.png]** ' || p_brand || chr(10) END AS text FROM (SELECT {base})""",
        "p1_embed": "SELECT doc_id, length(text) AS n_chars, length(text) - length(replace(text, 'e', '')) AS n_e, 'sizes' AS embedding_model, (sum(length(text)) OVER ())::BIGINT AS all_tokens FROM documents WHERE text IS NOT NULL",
        "q6_rerank": f"WITH {ranked} SELECT vec_id AS chunk_id, round(1 - (19 - at_) / 19.0::DOUBLE, 6) AS score, round(s, 6) AS semantic_score FROM t WHERE at_ BETWEEN 15 AND 19",
        "u1_context_rows": f"""WITH {ranked}, h AS (SELECT vec_id, s, row_number() OVER (ORDER BY s DESC, vec_id) - 1 AS ix FROM t JOIN documents ON doc_id = vec_id WHERE at_ < 12 AND lang = 'en' QUALIFY ix < 4),
o AS (SELECT vec_id, vec_id % 50 AS f, row_number() OVER (PARTITION BY vec_id % 50 ORDER BY vec_id) AS at_ FROM t), m AS (SELECT o.f, o.at_, ix FROM h JOIN o USING (vec_id))
SELECT vec_id AS chunk_id, false AS is_context, NULL::INT AS context_for_index, round(s, 6) AS score FROM h UNION ALL SELECT o.vec_id, true, ix::INT, 0.0 FROM o JOIN m ON m.f = o.f AND abs(m.at_ - o.at_) = 1""",
        "k7_json_output": f"WITH {ranked} SELECT {_PATH} AS file_path, substr(text, 1, 60) AS body, round(s, 6) AS score, doc_id AS start, doc_id + 3 AS \"end\", 'body,file_path,heading_breadcrumb,similarity_score,semantic_score,line_range' AS keys FROM t JOIN documents ON doc_id = vec_id WHERE at_ < 6",
    }
