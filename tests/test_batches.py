"""What a Python worker holds at once doesn't grow with the input."""

import pyarrow as pa
from pyspark.sql import functions as F

from lakequill.operators import chunking
from lakequill.operators.embed import embed_chunks
from lakequill.operators.store import ChunkStore
from lakequill.runtime import BATCH_BYTES


def test_embedder_gets_small_batches(spark):
    """Requests end with their Arrow batch: one request for each shows how much text a worker gets at once."""
    rows = spark.range(0, 3000, 1, 1).select(F.col("id"), F.repeat(F.lit("x"), 4000).alias("body"))
    got = embed_chunks(rows, lambda texts: [[float(sum(map(len, texts)))]] * len(texts), "sizes", 1, batch=10**9)
    n, most, used = got.agg(F.count("vector"), F.max(F.col("vector")[0]), F.sum("request_tokens")).first()
    assert n == 3000 and used == 0 and most <= BATCH_BYTES + 4000


def test_embedded_values_and_types(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "bcd")], "id int, body string").coalesce(1)
    got = embed_chunks(rows, lambda texts: [[len(t), 0.5] for t in texts], "m", 2)
    assert dict(got.dtypes)["vector"] == "array<float>" and sorted(map(tuple, got.select("id", "vector", "request_tokens").collect())) == [(1, [1.0, 0.5], 0), (2, [3.0, 0.5], 0)]
    assert embed_chunks(rows.where("false"), lambda texts: [[0.0, 0.0]] * len(texts), "m", 2).count() == 0


def test_chunks_leave_as_they_are_made():
    texts = [f"# {i}\n" + "some words of a line\n" * 1000 for i in range(400)]
    taken = []

    def of(text):
        taken.append(text)
        return chunking.chunk_file(text)

    schema = pa.schema([("file_path", pa.string()), ("crumb", pa.string()), ("level", pa.int32()), ("body", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("fm", pa.string()), ("s", pa.int64()), ("e", pa.int64())])
    given = pa.RecordBatch.from_pydict({"file_path": [f"{i}.md" for i in range(401)], "text": [*texts, None]})
    got = chunking.in_batches(iter([given]), of, schema)
    first = next(got)
    assert len(taken) < 150 and first.nbytes < 2 * BATCH_BYTES
    rest = list(got)
    assert max(b.nbytes for b in rest) < 2 * BATCH_BYTES
    whole = [r for b in (first, *rest) for r in b.to_pylist()]
    assert [tuple(r.values()) for r in whole] == [(f"{i}.md", *r) for i, t in enumerate(texts) for r in chunking.chunk_file(t)]


def test_headings_leave_as_they_are_made():
    given = pa.RecordBatch.from_pydict({"file_path": [f"{i}.md" for i in range(200)], "text": ["# One of some length\n" * 500] * 200})
    schema = pa.schema([("file_path", pa.string()), ("pos", pa.int64()), ("heading_breadcrumb", pa.string()), ("heading_level", pa.int32())])
    got = list(chunking.in_batches(iter([given]), chunking.headings, schema))
    assert len(got) > 3 and sum(map(len, got)) == 100_000 and max(b.nbytes for b in got) < 2 * BATCH_BYTES


def test_chunker_gets_small_batches(spark):
    session = spark.newSession()
    files = session.range(0, 3000, 1, 1).select(F.col("id").cast("string").alias("file_path"), F.repeat(F.lit("x"), 4000).alias("text"))
    assert chunking.chunk_files(files).count() == 6000
    given = files.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long")
    assert given.agg(F.max("n")).first()[0] < 2 * BATCH_BYTES


def test_appending_embeds_in_small_batches(spark, tmp_path):
    """A vector is the text of its request, which ends with its Arrow batch."""
    session = spark.newSession()
    files = session.range(0, 3000, 1, 1).select(F.concat("id", F.lit(".md")).alias("file_path"), F.repeat(F.lit("x"), 3000).alias("text"))
    store = ChunkStore(session, f"file://{tmp_path}/store")
    chunks = chunking.with_id(chunking.with_hash(chunking.chunk_files(files)))
    store.append(embed_chunks(chunks, lambda texts: [[float(sum(map(len, texts)))]] * len(texts), "sizes", 1, batch=10**9))
    store.delete_files(files.where("id % 4 = 0").select("file_path"))
    n, most = store.read().agg(F.count("*"), F.max(F.col("vector")[0])).first()
    assert n == 2250 and most <= BATCH_BYTES + 3000
