"""The retrieval engine's queries over the test tables, and an independent SQL statement for each.

`documents` stands for files (source/doc_id.md), `embeddings` for vectors with vec_id as the key of a document,
`events` for a log of file operations. Scores are rounded to six places on both sides.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakequill.functions import text as fx
from lakequill.functions.format import pretty_rows
from lakequill.operators import chunking, search, store
from lakequill.operators.assets import classify
from lakequill.operators.embed import Embedded, embed_chunks, token_usage
from lakequill.operators.metrics import bucket_counts
from lakequill.plans import pages, stores, upkeep
from lakequill.plans.index import run_counters
from lakequill.runtime import ship
from lakequill.schema import EMPTY_FRONTMATTER
from lakequill.sources import files
from lakequill.streaming.apply import last_operations

TERMS = "worthless token thorreou"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _files(spark, d):
    return _t(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"), "text", "doc_id")


def _chunks(spark, d):
    return chunking.with_id(chunking.with_hash(chunking.chunk_files(_files(spark, d))))


def _query_vector(spark, d, vec_id=0):
    row = _t(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return list(row[0])


def _vectors(spark, d):
    """Documents that have a vector, as rows of the search table."""
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"), F.col("text").alias("body"), "lang")
    return e.join(docs, "chunk_id")


def q1_semantic_topk(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return search.semantic(e, _query_vector(spark, d), 10, key="vec_id").select("vec_id", F.round("semantic_score", 6).alias("score"))


def q1_semantic_path_filter(spark, d):
    rows = search.path_filter(_vectors(spark, d), "src1")
    return search.semantic(rows.select("chunk_id", "file_path", "vector"), _query_vector(spark, d), 10).select("chunk_id", "file_path", F.round("semantic_score", 6).alias("score"))


def _docs_as_chunks(spark, d):
    return _t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("body"))


def q2_bm25_topk(spark, d):
    got = search.bm25(_docs_as_chunks(spark, d), TERMS, 20)
    return got.select("chunk_id", F.round("fts_raw", 6).alias("fts_raw"), F.round(search.by_maximum("fts_raw"), 6).alias("score"))


def q3_hybrid_rrf(spark, d):
    rows = _vectors(spark, d)
    a = search.semantic(rows.select("chunk_id", "vector"), _query_vector(spark, d), 20)
    b = search.bm25(rows.select("chunk_id", "body"), TERMS, 20)
    got = search.fuse(a, b, 20)
    return got.select("chunk_id", F.round("relevance", 6).alias("relevance"), F.round(search.by_maximum("relevance"), 6).alias("score"), F.round("semantic_score", 6).alias("semantic_score"), F.round("fts_raw", 6).alias("fts_raw"))


def f3_tag_postfilter(spark, d):
    rows = _vectors(spark, d).withColumn("frontmatter_json", F.to_json(F.struct(F.array("lang").alias("tags"))))
    top = search.semantic(rows.select("chunk_id", "vector", "frontmatter_json"), _query_vector(spark, d), 30)
    kept = top.where(search.has_tag(F.col("frontmatter_json"), "en"))
    return kept.select("chunk_id", F.round("semantic_score", 6).alias("score"))


def f4_min_score(spark, d):
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    got = search.search(e, search.SearchOptions(mode="semantic", limit=10, min_score=0.7, vector=_query_vector(spark, d)))
    return got.select(F.col("chunk_id").alias("vec_id"), F.round("similarity_score", 6).alias("score"))


def q5_context(spark, d):
    chunks = _chunks(spark, d)
    hits = chunks.where(F.col("byte_start") > 0).groupBy("file_path").agg(F.min(F.struct("line_start", "line_end")).alias("r")).select("file_path", "r.line_start", "r.line_end")
    hits = hits.withColumn("result_index", F.col("line_start") * 0)
    got = search.context(chunks, hits, 1, tie="byte_start")
    return got.select("file_path", "line_start", "line_end", F.col("byte_start"), "context_for_index")


def w4_rerank_scores(spark, d):
    top = q1_semantic_topk(spark, d).withColumn("result_index", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "vec_id")) - 1)
    order = top.where("vec_id % 2 = 0").select("result_index", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("vec_id"))).alias("position"))
    return search.rerank_scores(top, order).select("vec_id", F.col("rank").cast("long").alias("rank"), F.round("similarity_score", 6).alias("score"))


def t2_pool_size(spark, d):
    """The pool and the rows fetched for searches whose limits are the parts' sizes; every third has a tag."""
    ship(spark)

    @F.pandas_udf("pool long, fetched long")
    def sizes(limit, tagged):
        options = [search.SearchOptions(limit=n, tag_filter="t" if t else None, rerank=len) for n, t in zip(limit, tagged)]
        return pd.DataFrame({"pool": [o.pool() for o in options], "fetched": [o.fetch_limit() for o in options]})

    return _t(spark, d, "part").select("p_partkey", sizes(F.col("p_size").cast("int"), F.col("p_partkey") % 3 == 0).alias("x")).select("p_partkey", "x.*")


#: Texts that reach every break-point rule, made from orders: the test documents have plain lines alone.
_MARKS = "element_at(array('# One', '## Two', '####### no', '```', '---', '***x', '- item', '12. item', '', 'plain', '+ plus', '______', '#x'), cast(l_linenumber + l_partkey % 7 as int))"


def _marked(spark, d):
    lines = _t(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", f"{_MARKS} AS line")
    got = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "line"))).alias("x"))
    return got.select(F.col("l_orderkey").cast("string").alias("file_path"), F.array_join(F.transform("x", lambda s: s["line"]), "\n").alias("text"))


def c1_breakpoints(spark, d):
    return chunking.points_of(_marked(spark, d))


def c4_fences(spark, d):
    return chunking.fences_of(_marked(spark, d))


def c7_chunks(spark, d):
    return _chunks(spark, d).select("file_path", "byte_start", "byte_end")


def _headed(spark, d):
    """Headings of three levels among plain lines, one file for each order."""
    line = "element_at(array('# One', '## Two', '### Three', 'plain', '', '#none', '- item'), cast(1 + l_partkey % 7 as int))"
    lines = _t(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", f"{line} AS line")
    got = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "line"))).alias("x"))
    return got.select(F.col("l_orderkey").cast("string").alias("file_path"), F.array_join(F.transform("x", lambda s: s["line"]), "\n").alias("text"))


def c9_heading_stack(spark, d):
    return chunking.headings_of(_headed(spark, d))


def c10_active_heading(spark, d):
    """The heading at the start of a chunk: files of one chunk whose first line may be one."""
    return chunking.chunk_files(_headed(spark, d)).select("file_path", "heading_breadcrumb", F.col("heading_level").cast("long").alias("heading_level"))


def c11_line_numbers(spark, d):
    return _chunks(spark, d).select("file_path", "byte_start", "line_start", "line_end")


def c2_content_hash(spark, d):
    return _chunks(spark, d).select("file_path", "byte_start", "content_hash")


def c12_chunk_bodies(spark, d):
    return _chunks(spark, d).select("file_path", "byte_start", F.md5("body").alias("body_md5"), "heading_breadcrumb")


def _hashes(spark, d):
    o = _t(spark, d, "lineitem")
    return o.select(F.col("l_orderkey").cast("string").alias("file_path"), F.sha2(F.col("l_partkey").cast("string"), 256).alias("content_hash"), "l_linenumber", "l_returnflag")


def j1_change_detection(spark, d):
    o = _hashes(spark, d)
    new, old = o.where("l_linenumber > 1 or l_returnflag <> 'R'"), o.where("l_returnflag <> 'A' or l_linenumber < 3")
    return store.change_status(new, old)


def _stored_files(spark, d):
    return _files(spark, d).select(F.when(F.col("doc_id") % 5 == 0, F.regexp_replace("file_path", "md$", "png")).when(F.col("doc_id") % 5 == 1, F.regexp_replace("file_path", "md$", "MD")).otherwise(F.col("file_path")).alias("file_path"), "doc_id")


def j2_prune_orphans(spark, d):
    kept = _stored_files(spark, d).where("doc_id % 3 <> 0")
    return store.orphans(_stored_files(spark, d), kept)


def k4_upsert(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("file_path"), F.col("o_orderkey").alias("v"))
    return store.upsert(o.where("v % 2 = 0"), o.where("v % 7 = 0").withColumn("v", F.col("v") + 1000000))


def f9_model_guard(spark, d):
    o = _t(spark, d, "orders").select(F.when(F.col("o_orderkey") % 100 == 1, "b").otherwise("a").alias("embedding_model"))
    return store.other_models(o, "a").withColumn("mismatch", F.lit(store.model_guard(o, "a", force=True)))


def a1_total_chunks(spark, d):
    return store.total_chunks(_chunks(spark, d))


def a2_distinct_files(spark, d):
    return store.distinct_files(_chunks(spark, d))


def a3_chunks_per_file(spark, d):
    return store.chunks_per_file(_chunks(spark, d))


def a4_status(spark, d):
    return store.status(_chunks(spark, d)).select("total_chunks", "total_files", "queue_depth", "stale_files")


def a6_corpus_stats(spark, d):
    return search.postings(_docs_as_chunks(spark, d)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def a9_run_counters(spark, d):
    return run_counters(j1_change_detection(spark, d).withColumn("file_path", F.concat("file_path", F.lit(".md"))))


def w2_ordinals(spark, d):
    return search.ordinals(_chunks(spark, d), "byte_start").select("file_path", "byte_start", F.col("at").cast("long").alias("ordinal"))


def x4_json_tags(spark, d):
    e = _t(spark, d, "events").select("event_id", F.to_json(F.struct(F.array("event_type").alias("tags"))).alias("j"), "props")
    return e.select("event_id", search.has_tag(F.col("j"), "click").alias("is_click"), search.has_tag(F.col("props"), "click").alias("has_tag"), F.get_json_object("props", "$.k").cast("long").alias("k"))


def x6_excerpt(spark, d):
    return _files(spark, d).select("doc_id", F.md5(fx.excerpt(F.col("text"))).alias("excerpt_md5"))


def x7_preview(spark, d):
    return _files(spark, d).select("doc_id", F.md5(fx.preview(F.col("text"))).alias("preview_md5"))


def x10_highlight(spark, d):
    return _t(spark, d, "part").select("p_partkey", fx.highlight(F.concat("p_name", F.lit(" <b> & "), "p_brand"), "brand steel b lt").alias("marked"))


def x12_blockquote(spark, d):
    return _t(spark, d, "part").select("p_partkey", fx.image_blockquote(F.concat("p_name", F.lit(".png")), F.concat_ws("\n", "p_brand", "p_type")).alias("quote"))


def x13_media_type(spark, d):
    f = _stored_files(spark, d)
    return f.select("file_path", fx.media_type(F.col("file_path")).alias("media_type"))


def x14_cache_path(spark, d):
    return _t(spark, d, "part").select("p_partkey", fx.cache_path(F.sha2("p_name", 256)).alias("path"), fx.cache_path(F.substring("p_name", 1, 3)).alias("short_path"))


def x16_permutation_check(spark, d):
    o = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list((F.col("l_linenumber") - 1 - (F.col("l_partkey") % 9 == 0).cast("int")).cast("int"))).alias("x"))
    return o.select("l_orderkey", search.is_permutation(F.col("x"), F.size("x")).alias("ok"))


def x18_pdf_classify(spark, d):
    p = _t(spark, d, "orders").select("o_orderkey", F.transform(F.sequence(F.lit(1), (F.col("o_orderkey") % 4 + 1).cast("int")), lambda i: F.substring(F.concat(F.lit("a\x07b\n\t"), F.col("o_orderpriority"), F.lit(" pages of text")), F.lit(1), ((F.col("o_orderkey") * i) % 21).cast("int"))).alias("pages"))
    return classify(p).select("o_orderkey", "kind")


def k8_pretty(spark, d):
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.concat(F.lit("v"), "vec_id").alias("file_path"), F.lit("# V").alias("heading_breadcrumb"), F.repeat(F.concat(F.col("vec_id").cast("string"), F.lit(" word ")), 30).alias("body"))
    return pretty_rows(search.search(e, search.SearchOptions(mode="semantic", limit=10, vector=_query_vector(spark, d)))).select("block")


def r2_event_apply(spark, d):
    kinds = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "purchase", "rename_both").when(F.col("event_type") == "view", "modify").when(F.col("event_type") == "click", "remove").otherwise("access")
    e = _t(spark, d, "events").select(F.col("event_id").alias("seq"), kinds.alias("kind"), F.concat(F.col("user_id").cast("string"), F.lit(".md")).alias("path"), F.concat((F.col("user_id") + 1).cast("string"), F.lit(".md")).alias("new_path"))
    return last_operations(e)


def s3_exclude_globs(spark, d):
    return _files(spark, d).select("file_path", files.excluded(F.col("file_path"), ["src1/**", "*5.md"]).alias("gone"))


def f7_inside_root(spark, d):
    path = F.concat(F.lit("/"), F.col("file_path"))
    return _files(spark, d).select("file_path", files.inside(path, "/src1").alias("under"))


def f8_web_results(spark, d):
    rows = _t(spark, d, "part").select(F.col("p_name").alias("file_path"), F.col("p_brand").alias("heading_breadcrumb"), F.repeat(F.concat("p_name", F.lit(" & "), "p_brand", F.lit("; ")), 9).alias("body"), (F.col("p_partkey") / 8).alias("similarity_score"), (F.col("p_partkey") % 3 == 0).alias("is_context"))
    return pages.result_rows(rows, "brand steel")


def k11_histogram(spark, d):
    return bucket_counts(_t(spark, d, "events"), "value", "indexing_throughput_chunks_per_second")


def k12_index_page(spark, d):
    return pages.index_rows(_chunks(spark, d))


def a7_token_usage(spark, d):
    rows = _t(spark, d, "documents").where("text is not null").select(F.col("text").alias("body"))
    return token_usage(embed_chunks(rows, lambda texts: Embedded([[1.0]] * len(texts), sum(len(t.encode()) for t in texts)), "m", 1))


def x1_sql_quote(spark, d):
    return _t(spark, d, "part").select("p_partkey", fx.sql_quote(F.concat("p_name", F.lit("'s '"), "p_brand")).alias("quoted"))


def x5_json_or_empty(spark, d):
    broken = F.when(F.col("event_id") % 3 == 0, F.expr("substring(props, 1, length(props) - 1)")).when(F.col("event_id") % 3 == 1, F.col("props"))
    return _t(spark, d, "events").select("event_id", fx.json_or_empty(broken).alias("json"))


def x15_rerank_extract(spark, d):
    k = F.col("o_orderkey")
    own = F.format_string('{"indices": [%d,%d,0]}', k % 3, k % 5)
    answer = F.when(k % 4 == 0, own).when(k % 4 == 1, F.concat(F.lit("Sure:\n"), own, F.lit(" done"))).when(k % 4 == 2, F.lit("none")).otherwise('{"other": 1}')
    return _t(spark, d, "orders").select("o_orderkey", F.array_join(fx.rerank_indices(answer).cast("array<string>"), ",").alias("indices"))


_NAMES = """s3_exclude_globs f7_inside_root f8_web_results k11_histogram k12_index_page a7_token_usage x1_sql_quote x5_json_or_empty x15_rerank_extract
q1_semantic_topk q1_semantic_path_filter q2_bm25_topk q3_hybrid_rrf f3_tag_postfilter f4_min_score q5_context w4_rerank_scores t2_pool_size c1_breakpoints
c4_fences c7_chunks c9_heading_stack c10_active_heading c11_line_numbers c2_content_hash c12_chunk_bodies j1_change_detection j2_prune_orphans k4_upsert f9_model_guard a1_total_chunks a2_distinct_files
a3_chunks_per_file a4_status a6_corpus_stats a9_run_counters w2_ordinals x4_json_tags x6_excerpt x7_preview x10_highlight x12_blockquote x13_media_type x14_cache_path x16_permutation_check x18_pdf_classify k8_pretty r2_event_apply""".split()


def queries():
    return {n: globals()[n] for n in _NAMES} | upkeep.queries() | stores.queries()


# --- SQL -------------------------------------------------------------------------------------------------------

_DOT = "list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"
_COS = "greatest(0, least(1, 1 - (1 - " + _DOT + " / (sqrt(" + _DOT.format(a="{a}", b="{a}") + ") * sqrt(" + _DOT.format(a="{b}", b="{b}") + "))) / 2))"
_SIM = _COS.format(a="e.embedding", b="q.embedding")
_PATH = "source || '/' || doc_id || '.md'"
_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 0) q"
_TOPK = f"SELECT vec_id, round({_SIM}, 6) AS score FROM embeddings e, {_Q} ORDER BY {_SIM} DESC, vec_id LIMIT 10"
_WORDS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_BM25 = f"""
t AS (SELECT chunk_id, {_WORDS.format("coalesce(body, '')")} AS w FROM rows_),
s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
f AS (SELECT chunk_id, len(w) AS dl, term, len(list_filter(w, lambda x: x = term)) AS tf FROM t, unnest({TERMS.split()!r}) u(term)),
i AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM f, s WHERE tf > 0 GROUP BY term, n),
b AS (SELECT chunk_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS fts_raw FROM f JOIN i USING (term), s WHERE tf > 0 GROUP BY chunk_id ORDER BY fts_raw DESC, chunk_id LIMIT 20)
"""
_FLOOR = "({x} - CASE WHEN {x} >= n OR substr(h, 2 * ({x}) + 1, 1) NOT IN ('8', '9', 'A', 'B') THEN 0 WHEN substr(h, 2 * ({x}) - 1, 1) NOT IN ('8', '9', 'A', 'B') THEN 1 WHEN substr(h, 2 * ({x}) - 3, 1) NOT IN ('8', '9', 'A', 'B') THEN 2 ELSE 3 END)"


def _step(of: str) -> str:
    """SQL for the chunk that begins at s, of a relation that has file_path, h, n, nl and s. Holds for texts whose line feeds all score alike, as the test documents' do."""
    t = _FLOOR.format(x="least(s + 3600, n)")
    inner = f"SELECT file_path, h, n, nl, s, CASE WHEN n <= 3600 THEN n ELSE {t} END AS t FROM ({of})"
    return f"SELECT file_path, s, CASE WHEN t >= n THEN n ELSE coalesce(list_max(list_filter(nl, lambda p: p >= t - 800 AND p <= t AND p > s)), t) END AS e FROM ({inner})"


_NEXT = "greatest(c.e - 540, 0)"
_CUTS = f"""
d AS (SELECT {_PATH} AS file_path, hex(encode(text)) AS h, strlen(text) AS n, list_filter(range(strlen(text)), lambda p: substr(hex(encode(text)), 2 * p + 1, 2) = '0A') AS nl FROM documents WHERE text IS NOT NULL),
c AS ({_step("SELECT file_path, h, n, nl, 0::BIGINT AS s FROM d")}
  UNION ALL {_step(f"SELECT c.file_path, h, n, nl, CASE WHEN {_FLOOR.format(x=_NEXT)} <= c.s THEN c.e ELSE {_FLOOR.format(x=_NEXT)} END AS s FROM c JOIN d ON d.file_path = c.file_path WHERE c.e < n")}),
k AS (SELECT c.file_path, s AS byte_start, e AS byte_end, decode(unhex(substr(h, 2 * s + 1, 2 * (e - s)))) AS body, 1 + len(list_filter(nl, lambda p: p < s)) AS line_start, 1 + len(list_filter(nl, lambda p: p < greatest(e - 1, 0))) AS line_end
      FROM c JOIN d ON d.file_path = c.file_path WHERE regexp_matches(decode(unhex(substr(h, 2 * s + 1, 2 * (e - s)))), '[^\\s]'))
"""
_K = f"WITH RECURSIVE {_CUTS} "
_MARK_SQL = "(['# One', '## Two', '####### no', '```', '---', '***x', '- item', '12. item', '', 'plain', '+ plus', '______', '#x'])[l_linenumber + l_partkey % 7]"
_POINTS = f"""
l AS (SELECT l_orderkey::VARCHAR AS file_path, {_MARK_SQL} AS line, row_number() OVER w AS rn, count(*) OVER (PARTITION BY l_orderkey) AS cnt,
      sum(strlen({_MARK_SQL}) + 1) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, {_MARK_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 AS pos
      FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, {_MARK_SQL})),
p AS (SELECT file_path, pos::BIGINT AS pos, CASE WHEN line = '# One' THEN 'h1' WHEN line = '## Two' THEN 'h2' WHEN line = '```' THEN 'codeblock' WHEN line = '---' THEN 'hr' WHEN line = '- item' THEN 'list'
      WHEN line = '12. item' THEN 'numlist' WHEN line = '' AND rn < cnt THEN 'blank' ELSE 'newline' END AS kind FROM l WHERE rn > 1)
"""
_HEADED = """
l AS (SELECT l_orderkey::VARCHAR AS file_path, (['# One', '## Two', '### Three', 'plain', '', '#none', '- item'])[1 + l_partkey % 7] AS line, l_linenumber, l_partkey, l_suppkey FROM lineitem),
n AS (SELECT *, row_number() OVER w AS rn, (coalesce(sum(strlen(line) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS pos FROM l WINDOW w AS (PARTITION BY file_path ORDER BY l_linenumber, l_partkey, l_suppkey, line))
"""
_CHANGE = """
o AS (SELECT l_orderkey::VARCHAR AS file_path, sha256(l_partkey::VARCHAR) AS hsh, l_linenumber, l_returnflag FROM lineitem),
a AS (SELECT file_path, list_sort(list(DISTINCT hsh)) AS h, count(*) AS c FROM o WHERE l_linenumber > 1 OR l_returnflag <> 'R' GROUP BY 1),
b AS (SELECT file_path, list_sort(list(DISTINCT hsh)) AS h, count(*) AS c FROM o WHERE l_returnflag <> 'A' OR l_linenumber < 3 GROUP BY 1),
s AS (SELECT coalesce(a.file_path, b.file_path) AS file_path, CASE WHEN b.c IS NULL THEN 'new' WHEN a.c IS NULL THEN 'missing' WHEN a.h = b.h AND a.c = b.c THEN 'unchanged' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.file_path = b.file_path)
"""
_STORED = f"f AS (SELECT CASE doc_id % 5 WHEN 0 THEN regexp_replace({_PATH}, 'md$', 'png') WHEN 1 THEN regexp_replace({_PATH}, 'md$', 'MD') ELSE {_PATH} END AS file_path, doc_id FROM documents)"


def _prefix(bytes_: int, up: bool, mark: str) -> str:
    h = "hex(encode(text))"
    cont = "substr(" + h + ", 2 * {} + 1, 1) IN ('8', '9', 'A', 'B')"
    steps = [bytes_ + (k if up else -k) for k in range(4)]
    at = "CASE " + " ".join(f"WHEN NOT {cont.format(x)} THEN {x}" for x in steps[:3]) + f" ELSE {steps[3]} END"
    return f"SELECT doc_id, md5(CASE WHEN strlen(text) <= {bytes_} THEN text ELSE decode(unhex(substr({h}, 1, 2 * ({at})))) || '{mark}' END)"


def oracle_sql():
    rows = f"rows_ AS (SELECT vec_id AS chunk_id, embedding, {_PATH} AS file_path, text AS body, lang FROM embeddings JOIN documents ON doc_id = vec_id)"
    sem = f"SELECT chunk_id, {_COS.format(a='e.embedding', b='q.embedding')} AS semantic_score"
    return upkeep.oracle_sql() | stores.oracle_sql(_K, _SIM, EMPTY_FRONTMATTER) | {
        "s3_exclude_globs": f"SELECT file_path, file_path LIKE 'src1/%' OR file_path LIKE '%5.md' AS gone FROM (SELECT {_PATH} AS file_path FROM documents)",
        "f7_inside_root": f"SELECT {_PATH} AS file_path, source = 'src1' AS under FROM documents",
        "f8_web_results": "WITH b AS (SELECT *, repeat(p_name || ' & ' || p_brand || '; ', 9) AS body FROM part WHERE p_partkey % 3 <> 0), c AS (SELECT *, CASE WHEN length(body) <= 300 THEN body ELSE substr(body, 1, 300) || '...' END AS cut FROM b) SELECT p_name AS file_path, p_brand AS heading_breadcrumb, regexp_replace(replace(cut, '&', '&amp;'), '\\b(brand|steel)\\b', '<mark>\\1</mark>', 'gi') AS chunk_html, round(p_partkey / 8.0::DOUBLE, 2) AS similarity_score FROM c",
        "k11_histogram": "SELECT le, count(*) FILTER (value <= (CASE le WHEN '+Inf' THEN 'inf' ELSE le END)::DOUBLE) AS n FROM events, (SELECT unnest(['1', '5', '10', '25', '50', '100', '250', '500', '+Inf']) AS le) GROUP BY le",
        "k12_index_page": _K + "SELECT file_path, count(*) AS chunk_count, '—' AS last_indexed FROM k GROUP BY 1",
        "a7_token_usage": "SELECT sum(strlen(text))::BIGINT AS total_tokens FROM documents",
        "x1_sql_quote": "SELECT p_partkey, replace(p_name || chr(39) || 's ' || chr(39) || p_brand, chr(39), chr(39) || chr(39)) AS quoted FROM part",
        "x5_json_or_empty": "WITH t AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN substr(props, 1, length(props) - 1) WHEN 1 THEN props END AS j FROM events) SELECT event_id, CASE WHEN json_valid(j) THEN j ELSE '{}' END AS json FROM t",
        "x15_rerank_extract": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN (o_orderkey % 3) || ',' || (o_orderkey % 5) || ',0' END AS indices FROM orders",
        "q1_semantic_topk": _TOPK,
        "q1_semantic_path_filter": f"WITH {rows} SELECT chunk_id, file_path, round({_SIM}, 6) AS score FROM rows_ e, {_Q} WHERE file_path LIKE 'src1%' ORDER BY {_SIM} DESC, chunk_id LIMIT 10",
        "q2_bm25_topk": f"WITH rows_ AS (SELECT doc_id AS chunk_id, text AS body FROM documents), {_BM25} SELECT chunk_id, round(fts_raw, 6) AS fts_raw, round(fts_raw / max(fts_raw) OVER (), 6) AS score FROM b",
        "q3_hybrid_rrf": f"""WITH {rows}, {_BM25}, a AS ({sem} FROM rows_ e, {_Q} ORDER BY 2 DESC, 1 LIMIT 20),
ra AS (SELECT *, row_number() OVER (ORDER BY semantic_score DESC, chunk_id) AS r1 FROM a), rb AS (SELECT *, row_number() OVER (ORDER BY fts_raw DESC, chunk_id) AS r2 FROM b),
g AS (SELECT coalesce(ra.chunk_id, rb.chunk_id) AS chunk_id, coalesce(1.0::DOUBLE / (60 + r1), 0) + coalesce(1.0::DOUBLE / (60 + r2), 0) AS rel, semantic_score, fts_raw FROM ra FULL JOIN rb ON ra.chunk_id = rb.chunk_id ORDER BY rel DESC, 1 LIMIT 20)
SELECT chunk_id, round(rel, 6) AS relevance, round(rel / max(rel) OVER (), 6) AS score, round(semantic_score, 6) AS semantic_score, round(fts_raw, 6) AS fts_raw FROM g""",
        "f3_tag_postfilter": f"WITH {rows}, a AS (SELECT chunk_id, lang, {_SIM} AS s FROM rows_ e, {_Q} ORDER BY s DESC, chunk_id LIMIT 30) SELECT chunk_id, round(s, 6) AS score FROM a WHERE lang = 'en'",
        "f4_min_score": f"SELECT * FROM ({_TOPK}) WHERE score >= 0.7",
        "q5_context": _K + """, o AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY line_start, line_end, byte_start) AS at_ FROM k),
h AS (SELECT file_path, min(struct_pack(line_start, line_end)) AS r FROM k WHERE byte_start > 0 GROUP BY 1),
m AS (SELECT h.file_path, min(at_) AS mid FROM h JOIN o ON o.file_path = h.file_path AND o.line_start = r.line_start AND o.line_end = r.line_end GROUP BY 1)
SELECT o.file_path, line_start::BIGINT AS line_start, line_end::BIGINT AS line_end, byte_start, 0::BIGINT AS context_for_index FROM o JOIN m ON m.file_path = o.file_path WHERE abs(at_ - mid) <= 1 AND at_ <> mid""",
        "w4_rerank_scores": f"""WITH t AS ({_TOPK}), i AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS ix FROM t),
p AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id DESC) AS pos FROM i WHERE vec_id % 2 = 0),
r AS (SELECT i.vec_id, row_number() OVER (ORDER BY coalesce(pos, 1000000), ix) - 1 AS rank, count(*) OVER () AS n FROM i LEFT JOIN p ON p.vec_id = i.vec_id)
SELECT vec_id, rank, round(1 - rank / greatest(n - 1, 1)::DOUBLE, 6) AS score FROM r""",
        "t2_pool_size": "SELECT p_partkey, least(48, greatest(12, 4 * p_size))::BIGINT AS pool, least(48, greatest(12, 4 * p_size))::BIGINT * CASE WHEN p_partkey % 3 = 0 THEN 3 ELSE 1 END AS fetched FROM part",
        "c1_breakpoints": f"WITH {_POINTS} SELECT file_path, pos, CASE kind WHEN 'h1' THEN 100 WHEN 'h2' THEN 90 WHEN 'codeblock' THEN 80 WHEN 'hr' THEN 60 WHEN 'blank' THEN 20 WHEN 'list' THEN 5 WHEN 'numlist' THEN 5 ELSE 1 END::DOUBLE AS score, kind FROM p",
        "c4_fences": f"""WITH {_POINTS}, z AS (SELECT file_path, sum(strlen(line) + 1) - 1 AS size FROM l GROUP BY 1),
q AS (SELECT file_path, pos, row_number() OVER (PARTITION BY file_path ORDER BY pos) AS n, lead(pos) OVER (PARTITION BY file_path ORDER BY pos) AS nxt FROM p WHERE kind = 'codeblock')
SELECT q.file_path, pos AS fence_start, coalesce(nxt + 4, size)::BIGINT AS fence_end FROM q JOIN z ON z.file_path = q.file_path WHERE n % 2 = 1""",
        "c7_chunks": _K + "SELECT file_path, byte_start, byte_end FROM k",
        "c9_heading_stack": f"""WITH {_HEADED},
h AS (SELECT file_path, pos, rn, CASE line WHEN '# One' THEN 1 WHEN '## Two' THEN 2 ELSE 3 END AS lv FROM n WHERE line IN ('# One', '## Two', '### Three')),
m AS (SELECT *, coalesce(max(rn) FILTER (lv = 1) OVER w, 0) AS a, coalesce(max(rn) FILTER (lv = 2) OVER w, 0) AS b FROM h WINDOW w AS (PARTITION BY file_path ORDER BY rn))
SELECT file_path, pos, lv AS heading_level, array_to_string(list_filter([CASE WHEN a > 0 THEN '# One' END, CASE WHEN lv >= 2 AND b > a THEN '## Two' END, CASE WHEN lv = 3 THEN '### Three' END], lambda x: x IS NOT NULL), ' > ') AS heading_breadcrumb FROM m""",
        "c10_active_heading": f"""WITH {_HEADED}, f AS (SELECT file_path, string_agg(line, chr(10) ORDER BY rn) AS text, max(line) FILTER (rn = 1) AS top FROM n GROUP BY 1)
SELECT file_path, CASE WHEN top IN ('# One', '## Two', '### Three') THEN top ELSE '' END AS heading_breadcrumb, CASE top WHEN '# One' THEN 1 WHEN '## Two' THEN 2 WHEN '### Three' THEN 3 ELSE 0 END::BIGINT AS heading_level FROM f WHERE regexp_matches(text, '[^\\s]')""",
        "c11_line_numbers": _K + "SELECT file_path, byte_start, line_start::BIGINT AS line_start, line_end::BIGINT AS line_end FROM k",
        "c2_content_hash": _K + f"SELECT file_path, byte_start, sha256(body || '{EMPTY_FRONTMATTER}') AS content_hash FROM k",
        "c12_chunk_bodies": _K + "SELECT file_path, byte_start, md5(body) AS body_md5, '' AS heading_breadcrumb FROM k",
        "j1_change_detection": f"WITH {_CHANGE} SELECT file_path, status FROM s",
        "j2_prune_orphans": f"WITH {_STORED} SELECT DISTINCT file_path FROM f WHERE lower(regexp_extract(file_path, '\\.([^./]+)$', 1)) = 'md' AND file_path NOT IN (SELECT file_path FROM f WHERE doc_id % 3 <> 0)",
        "k4_upsert": "WITH o AS (SELECT o_custkey::VARCHAR AS file_path, o_orderkey AS v FROM orders) SELECT * FROM o WHERE v % 2 = 0 AND file_path NOT IN (SELECT file_path FROM o WHERE v % 7 = 0) UNION ALL SELECT file_path, v + 1000000 FROM o WHERE v % 7 = 0",
        "f9_model_guard": "SELECT count(*) FILTER (o_orderkey % 100 = 1) AS rows_of_other_models, count(*) FILTER (o_orderkey % 100 = 1) > 0 AS mismatch FROM orders",
        "a1_total_chunks": _K + "SELECT count(*) AS total_chunks FROM k",
        "a2_distinct_files": _K + "SELECT count(DISTINCT file_path) AS distinct_files FROM k",
        "a3_chunks_per_file": _K + "SELECT file_path, count(*) AS chunks FROM k GROUP BY 1",
        "a4_status": _K + "SELECT count(*) AS total_chunks, count(DISTINCT file_path) AS total_files, 0 AS queue_depth, 0 AS stale_files FROM k",
        "a6_corpus_stats": f"WITH t AS (SELECT doc_id, unnest({_WORDS.format('text')}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM t GROUP BY 1",
        "a9_run_counters": f"WITH {_CHANGE} SELECT count(*) FILTER (status IN ('new', 'changed')) AS files_indexed, count(*) FILTER (status = 'unchanged') AS files_skipped, count(*) FILTER (status = 'missing') AS files_missing FROM s",
        "w2_ordinals": _K + "SELECT file_path, byte_start, row_number() OVER (PARTITION BY file_path ORDER BY line_start, line_end, byte_start) AS ordinal FROM k",
        "x4_json_tags": "SELECT event_id, event_type = 'click' AS is_click, false AS has_tag, (props ->> '$.k')::BIGINT AS k FROM events",
        "x6_excerpt": _prefix(800, False, "…") + " AS excerpt_md5 FROM documents",
        "x7_preview": _prefix(300, True, "...") + " AS preview_md5 FROM documents",
        "x10_highlight": "SELECT p_partkey, replace(replace(replace(replace(replace(regexp_replace(p_name || ' <b> & ' || p_brand, '\\b(brand|steel|b|lt)\\b', chr(1) || '\\1' || chr(2), 'gi'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(1), '<mark>'), chr(2), '</mark>') AS marked FROM part",
        "x12_blockquote": "SELECT p_partkey, '> **[Image: ' || p_name || '.png]** ' || p_brand || chr(10) || '> ' || p_type AS quote FROM part",
        "x13_media_type": f"WITH {_STORED} SELECT file_path, CASE WHEN file_path LIKE '%.png' THEN 'image/png' ELSE 'application/octet-stream' END AS media_type FROM f",
        "x14_cache_path": "SELECT p_partkey, 'asset-cache/' || substr(sha256(p_name), 1, 2) || '/' || substr(sha256(p_name), 3, 2) || '/' || sha256(p_name) || '.txt' AS path, 'asset-cache/_/_/' || substr(p_name, 1, 3) || '.txt' AS short_path FROM part",
        "x16_permutation_check": "WITH o AS (SELECT l_orderkey, list_sort(list(l_linenumber - 1 - (l_partkey % 9 = 0)::INT)) AS x FROM lineitem GROUP BY 1) SELECT l_orderkey, x = range(len(x)) AS ok FROM o",
        "x18_pdf_classify": """WITH t AS (SELECT o_orderkey, o_orderkey % 4 + 1 AS n, unnest(range(1, o_orderkey % 4 + 2)) AS i, 'a' || chr(7) || 'b' || chr(10) || chr(9) || o_orderpriority || ' pages of text' AS s FROM orders)
SELECT o_orderkey, CASE WHEN sum(length(replace(substr(s, 1, (o_orderkey * i) % 21), chr(7), ''))) >= 12 * max(n) THEN 'text_first' ELSE 'needs_vision' END AS kind FROM t GROUP BY 1""",
        "k8_pretty": f"""WITH t AS (SELECT vec_id, {_SIM} AS score FROM embeddings e, {_Q} ORDER BY 2 DESC, 1 LIMIT 10), u AS (SELECT *, repeat(vec_id || ' word ', 30) AS body, row_number() OVER (ORDER BY score DESC, vec_id) AS n FROM t)
SELECT format('[{{}}] v{{}} -- # V  (score: {{:.2f}})', n, vec_id, score) || chr(10) || repeat('═', 40) || chr(10) || '# V' || chr(10) || CASE WHEN length(body) <= 200 THEN body ELSE substr(body, 1, 200) || chr(10) || '[truncated]' END AS block FROM u""",
        "r2_event_apply": """WITH e AS (SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'rename_both' WHEN 'view' THEN 'modify' WHEN 'click' THEN 'remove' ELSE 'access' END AS kind, user_id FROM events),
f AS (SELECT seq, user_id || '.md' AS path, CASE WHEN kind IN ('rename_both', 'remove') THEN 'delete' ELSE 'index' END AS op, 0 AS sub FROM e WHERE kind <> 'access' UNION ALL SELECT seq, (user_id + 1) || '.md', 'index', 1 FROM e WHERE kind = 'rename_both')
SELECT path, arg_max(op, seq * 2 + sub) AS op, max(seq) AS seq FROM f GROUP BY 1""",
    }
