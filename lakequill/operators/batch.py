"""Searches by a table of queries: k rows for each query, from one pass over the rows or the postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakequill.operators.segments import n_tokens, postings, tokens, weight
from lakequill.runtime import ship, stored

#: Rows and queries of one block; a block of either side is what a task holds.
ROW_BLOCK, QUERY_BLOCK, POSTING_BLOCK = 20_000, 1_024, 500_000


def batch_semantic(chunks: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", vector: str = "vector") -> DataFrame:
    """(query_id, rank, key, score): the k rows nearest to each query by cosine similarity, from 1; ties go to the smaller key.

    queries: query_id, vector, ids not null and distinct. Scores are those of semantic(). Blocks of rows meet blocks of queries, each pair of blocks in
    one matrix product that keeps k rows for each query; these are shuffled by query and ranked. Null and zero vectors take no part.
    """
    ship(chunks.sparkSession)
    kind = chunks.schema[key].dataType.simpleString()
    rows = chunks.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    asked = queries.where(F.col("vector").isNotNull()).select("query_id", F.col("vector").cast("array<double>").alias("v"))
    # two counts size the grid
    parts, blocks = max(1, -(-rows.count() // ROW_BLOCK)), max(1, -(-asked.count() // QUERY_BLOCK))
    number = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("part", number("key", parts)).withColumn("block", every(blocks))
    right = asked.withColumn("block", number("query_id", blocks)).withColumn("part", every(parts))

    def best(a, b):
        import numpy as np
        import pyarrow as pa

        def matrix(t):
            v = t.column("v").combine_chunks()
            m = np.asarray(v.flatten()).reshape(len(t), -1) if len(t) else np.zeros((0, 1))
            n = np.sqrt((m * m).sum(1))
            good = n > 0
            return m[good] / n[good, None], t.filter(pa.array(good))

        if not len(a) or not len(b):
            return pa.table([pa.array([], b.schema.field("query_id").type), pa.array([], a.schema.field("key").type), pa.array([], pa.float64())], names=["query_id", "key", "d"])
        (x, a), (y, b) = matrix(a), matrix(b)
        keys = a.column("key").to_pylist()
        d = 1 - y @ x.T
        out = ([], [], [])
        for q, row in zip(b.column("query_id").to_pylist(), d):
            at = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1]) if len(row) > k else range(len(row))  # with all that tie with the last
            for i in sorted(at, key=lambda i: (row[i], keys[i]))[:k]:
                out[0].append(q)
                out[1].append(keys[i])
                out[2].append(float(row[i]))
        return pa.table([pa.array(out[0], b.schema.field("query_id").type), pa.array(out[1], a.schema.field("key").type), pa.array(out[2], pa.float64())], names=["query_id", "key", "d"])

    found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(best, f"query_id {queries.schema['query_id'].dataType.simpleString()}, key {kind}, d double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "key"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("d") / 2))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("key").alias(key), score.alias("score"))


def batch_bm25(chunks: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", text: str = "body") -> DataFrame:
    """(query_id, rank, key, fts_raw): the k best rows for each query, from 1; ties go to the smaller key; scores are those of bm25().

    queries: query_id, query, ids not null and distinct; no two rows share a key. The postings of the asked terms alone are stored, then dealt to
    blocks of rows. Each block meets each block of queries and keeps k rows for each of them; these are shuffled by query and ranked, so what is
    shuffled grows with the postings and not with rows times queries. Null queries and those without words have no rows.
    """
    ship(chunks.sparkSession)
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    every = chunks.select(F.col(key).alias("key"), F.col(text).alias("text"))
    stats = every.agg(F.count("*").alias("n"), F.avg(n_tokens(F.col("text"))).alias("avgdl")).first()
    held = stored(postings(every, "key", "text").join(asked.select("term").distinct(), "term", "left_semi"), "postings")
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    # two counts size the grid
    parts, blocks = max(1, -(-held.count() // POSTING_BLOCK)), max(1, -(-queries.count() // QUERY_BLOCK))
    number = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    s = weight(F.col("tf"), F.col("dl"), F.col("df"), F.lit(stats["n"]), F.lit(stats["avgdl"]).cast("double"))
    left = held.join(df, "term").select("key", "term", s.alias("s")).withColumn("part", number("key", parts)).withColumn("block", every_of(blocks))
    right = asked.withColumn("block", number("query_id", blocks)).withColumn("part", every_of(parts))

    def best(a, b):
        import heapq

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def coded(column):
            c = column.combine_chunks().dictionary_encode()
            return c.dictionary, c.indices.to_numpy(zero_copy_only=False)

        out = ([], [], [])
        if len(a) and len(b):
            keys, row = coded(a.column("key"))
            terms, term = coded(a.column("term"))
            order = np.argsort(term, kind="stable")
            row, begin = row[order], np.searchsorted(term[order], np.arange(len(terms) + 1))
            # sums of whole 1e-15ths, in two parts that don't overflow: the same in any order, so equal rows tie
            unit = np.rint(a.column("s").to_numpy()[order] * 1e15).astype(np.int64)
            high, low = unit >> 30, unit & (1 << 30) - 1
            ids, query = coded(b.column("query_id"))
            wanted = pc.index_in(b.column("term").combine_chunks(), value_set=terms).to_numpy(zero_copy_only=False)
            for q, name in enumerate(ids.to_pylist()):
                sums, hit = np.zeros((2, len(keys)), np.int64), np.zeros(len(keys), bool)
                for t in wanted[query == q]:
                    if t == t:  # else no row of the block has the term
                        x = slice(begin[int(t)], begin[int(t) + 1])
                        np.add.at(sums[0], row[x], high[x])
                        np.add.at(sums[1], row[x], low[x])
                        hit[row[x]] = True
                at = np.flatnonzero(hit)
                score = (sums[0][at].astype(np.float64) * (1 << 30) + sums[1][at]) / 1e15
                if len(at) > k:
                    good = score >= np.partition(score, len(at) - k)[len(at) - k]  # with all that tie with the last
                    at, score = at[good], score[good]
                for x, key_ in heapq.nsmallest(k, zip((-score).tolist(), keys.take(pa.array(at)).to_pylist())):
                    out[0].append(name)
                    out[1].append(key_)
                    out[2].append(-x)
        types = (b.schema.field("query_id").type, a.schema.field("key").type, pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(out, types)], names=["query_id", "key", "fts_raw"])

    found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(best, f"query_id {queries.schema['query_id'].dataType.simpleString()}, key {chunks.schema[key].dataType.simpleString()}, fts_raw double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fts_raw"), "key"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("key").alias(key), "fts_raw")
