"""Words counted within rows, and searches by many queries over blocks of rows."""

from pyspark.sql import functions as F

from lakequill.operators import batch, search
from lakequill.operators.segments import n_tokens, postings


def test_batch_bm25_over_many_blocks(spark, monkeypatch):
    """Small blocks of rows and of queries, with rows that tie: the same as one search for each query."""
    monkeypatch.setattr(batch, "POSTING_BLOCK", 40)
    monkeypatch.setattr(batch, "QUERY_BLOCK", 2)
    docs = spark.createDataFrame([(f"k{i:02d}", " ".join(f"w{(i * j) % 7}" for j in range(i % 5 + 1)) if i % 9 else None) for i in range(60)], "chunk_id string, body string")
    asked = spark.createDataFrame([(q, f"W{q} w{q + 1}, w{q}" if q else None) for q in range(6)], "query_id int, query string")
    got = {}
    for r in sorted(batch.batch_bm25(docs, asked, 7).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["chunk_id"], round(r["fts_raw"], 9)))
    for q in range(1, 6):
        want = search.bm25(docs, f"w{q} w{q + 1}", 7).collect()
        assert got.get(q, []) == [(r["chunk_id"], round(r["fts_raw"], 9)) for r in want]
    assert 0 not in got


def test_words_are_counted_without_a_shuffle(spark):
    df = spark.createDataFrame([(1, "b A b, a b!"), (2, ""), (3, None), (4, "ß²é x x")], "chunk_id int, body string")
    got = postings(df)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.select("chunk_id", "term", "tf", "dl").collect())) == [(1, "a", 2, 5), (1, "b", 3, 5), (4, "x", 2, 3), (4, "ß²é", 1, 3)]
    assert [r[0] for r in df.orderBy("chunk_id").select(n_tokens(F.col("body"))).collect()] == [5, 0, 0, 3]
