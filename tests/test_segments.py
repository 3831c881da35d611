"""The segment index after any changes against BM25 over the final rows."""

import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from lakequill.operators.search import bm25
from lakequill.operators.segments import SegmentIndex, _count, counts

WORDS = ["kiln", "ash", "wool", "Clay", "é1", "feldspar", "loom"]


def size_of(path):
    return sum(f.stat().st_size for f in path.rglob("*.parquet"))


def test_segments_equal_the_rows(spark, tmp_path):
    r = random.Random(6)
    index = SegmentIndex(spark, f"file://{tmp_path}/fts")
    text = lambda: r.choice([None, "", " ".join(r.choice(WORDS) for _ in range(r.randint(1, 12)))])
    rows, frame = {}, lambda x: spark.createDataFrame(list(x), "chunk_id string, body string")
    keys = [f"k{i:03d}" for i in range(60)]

    def same():
        table = frame(rows.items())
        for q in ("kiln ash", "CLAY é1 nothing"):
            want = [(x[0], round(x[1], 9)) for x in bm25(table, q, 15).collect()]
            assert [(x[0], round(x[1], 9)) for x in index.search(q, 15).collect()] == want

    assert index.search("kiln", 5).count() == 0
    for step in range(6):
        added = {k: text() for k in r.sample(keys, 12)}
        removed = [k for k in r.sample(keys, 5) if k not in added]
        for k in removed:
            rows.pop(k, None)
        rows |= added
        state = index.apply(frame(added.items()), spark.createDataFrame([(k,) for k in removed], "chunk_id string"), source=step)
        assert state["n"] == len(rows) and index.state() == state and state["source"] == step
        if step == 1 or step == 4:
            same()
    assert len(index.state()["segments"]) < 6  # some were merged
    index.apply(frame([]), spark.createDataFrame([(k,) for k in keys], "chunk_id string"))
    assert index.state()["n"] == 0 and index.search("kiln", 5).count() == 0
    index.rebuild(frame(rows.items()))
    same()


def test_a_change_writes_in_step_with_itself(spark, tmp_path):
    index = SegmentIndex(spark, f"file://{tmp_path}/fts")
    many = spark.range(6000).select(F.concat(F.lit("k"), "id").alias("chunk_id"), F.concat_ws(" ", *(F.concat(F.lit(f"w{j}x"), (F.col("id") * (j + 3) % 997).cast("string")) for j in range(20))).alias("body"))
    index.rebuild(many)
    whole = size_of(tmp_path)
    index.apply(many.where("chunk_id in ('k1', 'k2')").withColumn("body", F.lit("kiln")), spark.createDataFrame([("k3",)], "chunk_id string"))
    assert size_of(tmp_path) - whole < whole / 10
    assert [x.chunk_id for x in index.search("kiln", 5).collect()] == ["k1", "k2"] and index.state()["n"] == 5999


def test_a_change_takes_its_texts_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(300).select(F.concat(F.lit("k"), "id").alias("chunk_id"), F.concat(F.lit("kiln w"), "id").alias("body"))
    state = SegmentIndex(spark, f"file://{tmp_path}/fts").apply(rows.mapInArrow(passed, rows.schema))
    assert (state["n"], state["words"], seen.value) == (300, 600, 300)


def test_counts_of_rows(spark):
    texts = ["b a b", "", None, "É é\tx1 b", "b"]
    got = {tuple(r) for r in counts(spark.createDataFrame(list(enumerate(texts)), "chunk_id long, body string").coalesce(1)).collect()}
    words = [(t or "").lower().split() for t in texts]
    assert got == {(i, w, n, len(x)) for i, x in enumerate(words) for w, n in Counter(x).items()} | {(i, None, 0, len(x)) for i, x in enumerate(words)}
    cut = pa.RecordBatch.from_pydict({"k": [1, 2, 3], "w": [["a", "a"], ["b"], ["c", "b"]]}).slice(1)
    assert sorted(tuple(r.values()) for b in _count([cut]) for r in b.to_pylist() if r["term"]) == [(2, "b", 1, 1), (3, "b", 1, 2), (3, "c", 1, 2)]
    assert [b.num_rows for b in _count([pa.RecordBatch.from_pydict({"k": pa.array([], pa.int64()), "w": pa.array([], pa.list_(pa.string()))})])] == [0]
