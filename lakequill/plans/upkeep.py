"""Queries over change detection, upkeep, batch searches and marked-up files, and an independent SQL statement for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakequill.functions import text as fx
from lakequill.operators import assets, batch, chunking
from lakequill.operators.segments import SegmentIndex
from lakequill.runtime import shared_path
from lakequill.sources import files
from lakequill.streaming.apply import operations
from lakequill.streaming.debounce import debounced
from lakequill.streaming.folder import listing_diff

TERMS = "worthless token thorreou"


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _paths(spark, d):
    return _t(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file_path"), "doc_id", "text")


def s8_listing_diff(spark, d):
    """The documents as files: one listing before some went, some came and some grew, and one after."""
    rows = _paths(spark, d).select(F.col("file_path").alias("path"), F.octet_length("text").cast("long").alias("size"), F.col("doc_id").alias("modified"))
    before = rows.where("modified % 5 <> 0")
    after = rows.where("modified % 7 <> 0").withColumn("size", F.col("size") + (F.col("modified") % 3 == 0).cast("long"))
    return listing_diff(before, after)


def r1_debounce(spark, d):
    """The events of a user as those of a file, quiet for six hours."""
    kinds = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "purchase", "rename_from").when(F.col("event_type") == "view", "modify").when(F.col("event_type") == "click", "remove").otherwise("access")
    events = _t(spark, d, "events").select(F.col("event_id").alias("seq"), "ts", kinds.alias("kind"), F.concat(F.col("user_id").cast("string"), F.lit(".md")).alias("path"), F.lit(None).cast("string").alias("new_path"))
    us = lambda c: F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({c} as timestamp_ntz))")
    return debounced(operations(events), "6 hours").select("path", "op", "seq", us("first_ts").alias("first_us"), us("last_ts").alias("last_us"), "n")


def r5_segments(spark, d):
    """BM25 over an index that took in the documents in three changes: all but some, the rest with others anew, and a deletion."""
    rows = _t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("body"))
    index = SegmentIndex(spark, shared_path(spark, "fts"), key_type="long")
    index.apply(rows.where("chunk_id % 3 <> 0").withColumn("body", F.when(F.col("chunk_id") % 4 == 1, F.lit("an older text, replaced below")).otherwise(F.col("body"))))
    index.apply(rows.where("chunk_id % 3 = 0 or chunk_id % 4 = 1"))
    index.apply(rows.where("false"), rows.where("chunk_id % 11 = 0").select("chunk_id"))
    return index.search(TERMS, 20).select("chunk_id", F.round("fts_raw", 6).alias("fts_raw"))


def s2_ignored(spark, d):
    """Ignore files at the root and in each source's folder, over the documents as files."""
    paths = _paths(spark, d).select("file_path")
    own = _t(spark, d, "documents").select(F.concat("source", F.lit("/.gitignore")).alias("file_path")).distinct().withColumn("text", F.lit("# numbers\n*7.md\n\n!*77.md\n/1*.md\n"))
    root = spark.range(1).select(F.lit(".gitignore").alias("file_path"), F.lit("*0.md\n!src1/\n").alias("text"))
    return files.ignored(paths, files.ignore_rules(root.unionAll(own)))


def j3_batch_search(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    got = batch.batch_semantic(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector"), 10, "vec_id")
    return got.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.round("score", 6).alias("score"))


def j9_batch_bm25(spark, d):
    """Every benchmark item's text as a query over the documents."""
    docs = _t(spark, d, "documents").select("doc_id", F.col("text").alias("body"))
    asked = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    got = batch.batch_bm25(docs, asked, 5, "doc_id")
    return got.select("query_id", F.col("rank").cast("int").alias("rank"), "doc_id", F.round("fts_raw", 6).alias("fts_raw"))


#: Lines that reach every rule of cutting and of headings; files of several chunks, one for each supplier.
LINES = ["# One", "## Two", "### Three", "```", "***", "- item of a list", "12. numbered", "", "plain words of a line that goes on for a while", "other plain words", "#none", "plain again, and longer than most of the lines are"]


def _marked(spark, d):
    which = "element_at(array({}), cast(1 + case when l_partkey % 9 = 0 then l_orderkey % 8 else 7 + l_partkey % 5 end as int))".format(", ".join(f"'{x}'" for x in LINES))
    lines = _t(spark, d, "lineitem").selectExpr("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", f"{which} AS line")
    got = lines.groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", "line"))).alias("x"))
    return got.select(F.concat(F.col("l_suppkey").cast("string"), F.lit(".md")).alias("file_path"), F.concat(F.lit("top\n"), F.array_join(F.transform("x", lambda s: s["line"]), "\n")).alias("text"))


def c12_marked_chunks(spark, d):
    got = chunking.chunk_files(_marked(spark, d))
    return got.select("file_path", "byte_start", "byte_end", "line_start", "line_end", "heading_breadcrumb", F.col("heading_level").cast("int").alias("heading_level"), F.md5("body").alias("body_md5"))


def j6_asof(spark, d):
    """The heading at each chunk's start, by the join over ranges of files instead of within the chunker."""
    marked = _marked(spark, d)
    chunks = chunking.chunk_files(marked).select("file_path", "byte_start", "byte_end")
    return chunking.active_headings(chunks, chunking.headings_of(marked)).select("file_path", "byte_start", "heading_breadcrumb", F.col("heading_level").cast("int").alias("heading_level"))


def e9_pages(spark, d):
    """The web pages' html in parts of 700 characters as the pages of documents; a part without a letter a fails."""
    html = _t(spark, d, "pages").where("html <> ''").select(F.concat(F.col("page_id").cast("string"), F.lit(".pdf")).alias("file_path"), "html")
    cut = html.select("file_path", "html", F.explode(F.expr("sequence(0, cast((length(html) - 1) div 700 as int))")).alias("p"))
    parts = cut.select("file_path", (F.col("p") + 1).alias("page"), F.expr("encode(substring(html, p * 700 + 1, 700), 'UTF-8')").alias("image"))

    def read(image, name):
        text = image.decode()
        if "a" not in text:
            raise ValueError(f"{name}: no text")
        return f"{text}|"

    got = assets.read_pages(parts, read)
    return got.select("file_path", F.size("texts").alias("n_pages"), F.md5(F.array_join("texts", "")).alias("text_md5"), "error")


def x4_variant(spark, d):
    """Values of a JSON column by path and type: one that is there, one as another type, one that is missing, and texts that are no JSON."""
    json = F.when(F.col("event_id") % 4 == 0, F.expr("substring(props, 1, length(props) - 1)")).when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"k": "w'), F.col("event_id").cast("string"), F.lit('", "tags": ["a", "b"]}'))).otherwise(F.col("props"))
    return _t(spark, d, "events").select("event_id", fx.json_value(json, "$.k", "bigint", -1).alias("k"), fx.json_value(json, "$.k", "string", "none").alias("k_text"), fx.json_value(json, "$.tags[1]", "string").alias("tag"), fx.json_value(json, "$.none", "boolean", False).alias("flag"))


def queries():
    return {f.__name__: f for f in (s8_listing_diff, r1_debounce, r5_segments, s2_ignored, j3_batch_search, j9_batch_bm25, c12_marked_chunks, j6_asof, e9_pages, x4_variant)}


# --- SQL -------------------------------------------------------------------------------------------------------

_PATH = "source || '/' || doc_id || '.md'"
_DOT = "list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"
_COS = "greatest(0, least(1, 1 - (1 - " + _DOT + " / (sqrt(" + _DOT.format(a="{a}", b="{a}") + ") * sqrt(" + _DOT.format(a="{b}", b="{b}") + "))) / 2))"
_WORDS = "list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_LINE = "([{}])[1 + CASE WHEN l_partkey % 9 = 0 THEN l_orderkey % 8 ELSE 7 + l_partkey % 5 END]".format(", ".join(f"'{x}'" for x in LINES))
#: Lines with their places; break points with scores and fences; cuts, of texts of single-byte characters, by a recursive query.
_FILES = f"""
a AS (SELECT l_suppkey || '.md' AS f, {_LINE} AS line, l_orderkey, l_linenumber, l_partkey FROM lineitem),
o AS (SELECT f, line, row_number() OVER (PARTITION BY f ORDER BY l_orderkey, l_linenumber, l_partkey, line) AS rn FROM a UNION ALL SELECT DISTINCT f, 'top', 0 FROM a),
l AS (SELECT f, line, rn, max(rn) OVER (PARTITION BY f) AS last, (coalesce(sum(strlen(line) + 1) OVER (PARTITION BY f ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS pos FROM o),
t AS (SELECT f, string_agg(line, chr(10) ORDER BY rn) AS text FROM l GROUP BY f),
p AS (SELECT f, pos - 1 AS pos, line, CASE WHEN line = '# One' THEN 100.0 WHEN line = '## Two' THEN 90.0 WHEN line = '### Three' THEN 80.0 WHEN line = '```' THEN 80.0 WHEN line = '***' THEN 60.0 WHEN line IN ('- item of a list', '12. numbered') THEN 5.0 WHEN line = '' AND rn < last THEN 20.0 ELSE 1.0 END::DOUBLE AS score FROM l WHERE rn > 0),
q AS (SELECT f, pos, row_number() OVER (PARTITION BY f ORDER BY pos) AS n, lead(pos) OVER (PARTITION BY f ORDER BY pos) AS nxt FROM p WHERE line = '```'),
z AS (SELECT q.f, list({{'a': pos, 'b': coalesce(nxt + 4, strlen(text))}}) AS zs FROM q JOIN t ON t.f = q.f WHERE n % 2 = 1 GROUP BY 1),
b AS (SELECT p.f, list({{'pos': pos, 'score': score}}) AS ps FROM p LEFT JOIN z ON z.f = p.f WHERE len(list_filter(coalesce(zs, []), lambda x: x.a < pos AND pos < x.b)) = 0 GROUP BY 1),
w AS (SELECT t.f, text, strlen(text) AS n, ps, list_filter(range(strlen(text)), lambda i: text[i + 1] = chr(10)) AS nl FROM t JOIN b ON b.f = t.f)
"""


def _cut(of: str) -> str:
    """SQL for (f, s, e), the chunk that begins at s, of a relation with f, n, ps and s."""
    best = "list_sort(list_transform(list_filter(ps, lambda x: x.pos >= t - 800 AND x.pos <= t), lambda x: {'o': -x.score * (1 - ((t - x.pos) / 800.0::DOUBLE) ** 2 * 0.7::DOUBLE), 'p': x.pos}))[1].p"
    return f"SELECT f, s, CASE WHEN t >= n OR n <= 3600 THEN n WHEN {best} > s THEN {best} ELSE t END AS e FROM (SELECT *, least(s + 3600, n) AS t FROM ({of}))"


_NEXT = "CASE WHEN greatest(c.e - 540, 0) <= c.s THEN c.e ELSE greatest(c.e - 540, 0) END"
_MARKED = f"""WITH RECURSIVE {_FILES},
c AS ({_cut("SELECT f, n, ps, 0::BIGINT AS s FROM w")} UNION ALL {_cut(f"SELECT c.f, n, ps, {_NEXT} AS s FROM c JOIN w ON w.f = c.f WHERE c.e < n")}),
g AS (SELECT f, pos, rn, CASE line WHEN '# One' THEN 1 WHEN '## Two' THEN 2 ELSE 3 END AS lv FROM (SELECT *, sum((line = '```')::INT) OVER (PARTITION BY f ORDER BY rn) AS fence FROM l) WHERE line IN ('# One', '## Two', '### Three') AND fence % 2 = 0),
m AS (SELECT *, coalesce(max(rn) FILTER (lv = 1) OVER v, 0) AS one, coalesce(max(rn) FILTER (lv = 2) OVER v, 0) AS two FROM g WINDOW v AS (PARTITION BY f ORDER BY rn)),
h AS (SELECT f, pos, lv, array_to_string(list_filter([CASE WHEN one > 0 THEN '# One' END, CASE WHEN lv >= 2 AND two > one THEN '## Two' END, CASE WHEN lv = 3 THEN '### Three' END], lambda x: x IS NOT NULL), ' > ') AS crumb FROM m),
k AS (SELECT c.f AS file_path, s AS byte_start, e AS byte_end, coalesce(crumb, '') AS heading_breadcrumb, coalesce(lv, 0) AS heading_level FROM c ASOF LEFT JOIN h ON h.f = c.f AND h.pos <= c.s)
"""


def oracle_sql():
    one = _COS.format(a="e.embedding", b="q.embedding")
    return {
        "s8_listing_diff": f"""WITH r AS (SELECT {_PATH} AS path, strlen(text) AS size, doc_id FROM documents), a AS (SELECT * FROM r WHERE doc_id % 5 <> 0), b AS (SELECT path, size + (doc_id % 3 = 0)::INT AS size, doc_id FROM r WHERE doc_id % 7 <> 0)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'create' WHEN b.path IS NULL THEN 'remove' ELSE 'modify' END AS kind FROM a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.size <> b.size""",
        "r1_debounce": """WITH e AS (SELECT user_id || '.md' AS path, event_id AS seq, epoch_us(ts) AS us, CASE WHEN event_type IN ('purchase', 'click') THEN 'delete' ELSE 'index' END AS op FROM events WHERE event_type IN ('signup', 'purchase', 'view', 'click')),
g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY path ORDER BY us, seq) < 21600000000 THEN 0 ELSE 1 END AS new FROM e), i AS (SELECT *, sum(new) OVER (PARTITION BY path ORDER BY us, seq) AS run FROM g)
SELECT path, arg_max(op, {'u': us, 's': seq}) AS op, arg_max(seq, {'u': us, 's': seq}) AS seq, min(us) AS first_us, max(us) AS last_us, count(*) AS n FROM i GROUP BY path, run""",
        "r5_segments": f"""WITH t AS (SELECT doc_id AS chunk_id, {_WORDS.format('text')} AS w FROM documents WHERE doc_id % 11 <> 0),
s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t), f AS (SELECT chunk_id, len(w) AS dl, term, len(list_filter(w, lambda x: x = term)) AS tf FROM t, unnest({TERMS.split()!r}) u(term)),
i AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM f, s WHERE tf > 0 GROUP BY term, n)
SELECT chunk_id, round(fts_raw, 6) AS fts_raw FROM (SELECT chunk_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS fts_raw FROM f JOIN i USING (term), s WHERE tf > 0 GROUP BY chunk_id ORDER BY fts_raw DESC, chunk_id LIMIT 20)""",
        "s2_ignored": f"SELECT DISTINCT {_PATH} AS file_path, CASE WHEN doc_id::VARCHAR LIKE '1%' THEN true WHEN doc_id::VARCHAR LIKE '%77' THEN false WHEN doc_id::VARCHAR LIKE '%7' THEN true WHEN source = 'src1' THEN false ELSE doc_id::VARCHAR LIKE '%0' END AS ignored FROM documents",
        "j3_batch_search": f"SELECT query_id, rank::INT AS rank, vec_id, round(score, 6) AS score FROM (SELECT q.vec_id AS query_id, e.vec_id, {one} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {one} DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) WHERE rank <= 10",
        "j9_batch_bm25": f"""WITH t AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
a AS (SELECT DISTINCT item_id AS query_id, unnest({_WORDS.format('text')}) AS term FROM benchmark),
p AS (SELECT doc_id, term, dl, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM t) WHERE term IN (SELECT term FROM a) GROUP BY ALL),
i AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, s GROUP BY term, n),
r AS (SELECT query_id, doc_id, sum((idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)))::DECIMAL(38, 15)) AS x FROM a JOIN p USING (term) JOIN i USING (term), s GROUP BY ALL)
SELECT query_id, rank::INT AS rank, doc_id, round(x::DOUBLE, 6) AS fts_raw FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, doc_id) AS rank FROM r) WHERE rank <= 5""",
        "c12_marked_chunks": _MARKED + "SELECT file_path, byte_start, byte_end, (1 + len(list_filter(nl, lambda i: i < byte_start)))::BIGINT AS line_start, (1 + len(list_filter(nl, lambda i: i < byte_end - 1)))::BIGINT AS line_end, heading_breadcrumb, heading_level, md5(substr(text, byte_start + 1, byte_end - byte_start)) AS body_md5 FROM k JOIN w ON w.f = k.file_path",
        "j6_asof": _MARKED + "SELECT file_path, byte_start, heading_breadcrumb, heading_level FROM k",
        "e9_pages": """WITH h AS (SELECT page_id || '.pdf' AS file_path, html, unnest(range((length(html) - 1) // 700 + 1)) AS p FROM pages WHERE html <> ''), c AS (SELECT file_path, p, substr(html, p * 700 + 1, 700) AS x FROM h)
SELECT file_path, CASE WHEN bool_and(contains(x, 'a')) THEN count(*)::INT END AS n_pages, CASE WHEN bool_and(contains(x, 'a')) THEN md5(string_agg(x || '|', '' ORDER BY p)) END AS text_md5, replace(file_path, '.pdf', '') || '_page_' || (min(p) FILTER (NOT contains(x, 'a')) + 1) || '.png: no text' AS error FROM c GROUP BY 1""",
        "x4_variant": """SELECT event_id, CASE WHEN event_id % 4 < 2 THEN -1 ELSE (props ->> '$.k')::BIGINT END AS k, CASE event_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'w' || event_id ELSE props ->> '$.k' END AS k_text, CASE WHEN event_id % 4 = 1 THEN 'b' END AS tag, false AS flag FROM events""",
    }
