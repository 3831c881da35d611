"""Batch searches against single ones, headings by ranges of files, pages dealt over tasks, typed JSON values."""

import random

from pyspark.sql import functions as F

from lakequill.functions import text as fx
from lakequill.operators import assets, batch, chunking, search


def test_batch_searches_equal_single_ones(spark, monkeypatch):
    r = random.Random(3)
    words = ["kiln", "ash", "wool", "Clay", "é1"]
    rows = [(i, [round(r.gauss(0, 1), 2) for _ in range(4)] if i % 17 else None, " ".join(r.choice(words) for _ in range(r.randint(0, 9)))) for i in range(300)]
    rows += [(300 + i, rows[5][1], rows[5][2]) for i in range(5)] + [(400, [0.0] * 4, None)]
    df = spark.createDataFrame(rows, "chunk_id long, vector array<double>, body string").repartition(3)
    asked = spark.createDataFrame([(i, rows[i + 1][1], q) for i, q in enumerate(("kiln ash", "CLAY!", "", None, "absent é1"))] + [(9, None, None)], "query_id int, vector array<double>, query string")
    monkeypatch.setattr(batch, "ROW_BLOCK", 70)
    monkeypatch.setattr(batch, "QUERY_BLOCK", 2)
    near, text = batch.batch_semantic(df, asked, 6).collect(), batch.batch_bm25(df, asked, 6).collect()
    for q in asked.collect():
        got = [(x.chunk_id, round(x.score, 9)) for x in sorted(near, key=lambda x: x.rank) if x.query_id == q.query_id]
        want = search.semantic(df, q.vector, 6).collect() if q.vector else []
        assert got == [(x.chunk_id, round(x.semantic_score, 9)) for x in want]
        got = [(x.chunk_id, round(x.fts_raw, 6)) for x in sorted(text, key=lambda x: x.rank) if x.query_id == q.query_id]
        assert got == [(x.chunk_id, round(x.fts_raw, 6)) for x in search.bm25(df, q.query or "", 6).collect()]
    assert batch.batch_semantic(df.where("false"), asked, 3).count() == 0 and batch.batch_bm25(df, asked.where("false"), 3).count() == 0


def test_headings_by_ranges_equal_the_chunkers(spark):
    r = random.Random(1)
    lines = ["# A", "## B `c`", "### C", "plain words " * 9, "```", "", "under\n===", "- item"]
    rows = [(f"f{i}.md", "\n".join(r.choice(lines) for _ in range(n))) for i, n in enumerate((1, 40, 900, 2000))] + [("e.md", ""), ("n.md", None), ("m.md", "---\ntags: [a]\n---\n" + "# T\nwords\n" * 900)]
    files = spark.createDataFrame(rows, "file_path string, text string")
    chunks = chunking.chunk_files(files)
    want = {(x.file_path, x.byte_start): (x.heading_breadcrumb, x.heading_level) for x in chunks.collect()}
    got = chunking.active_headings(chunks.select("file_path", "byte_start", F.lit("kept").alias("sub")), chunking.headings_of(files), parts=5)
    assert {(x.file_path, x.byte_start): (x.heading_breadcrumb, x.heading_level) for x in got.collect()} == want
    assert len(want) > 20 and got.where("sub = 'kept'").count() == len(want)


def test_pages_of_one_document_are_read_by_several_tasks(spark, tmp_path):
    pages = spark.range(1, 31).select(F.lit("d/long.pdf").alias("file_path"), F.col("id").cast("int").alias("page"), F.concat(F.lit("p"), "id").cast("binary").alias("image"))

    def read(image, name):
        from pyspark import TaskContext

        (tmp_path / f"{TaskContext.get().partitionId()}-{name}").write_text("")
        if image in (b"p7", b"p20"):
            raise ValueError(f"bad {name}")
        return image.decode()

    good = assets.read_pages(pages.where("page not in (7, 20)"), read, 8).first()
    assert list(good.texts) == [f"p{i}" for i in range(1, 31) if i not in (7, 20)] and good.error is None
    assert len({f.name.split("-")[0] for f in tmp_path.iterdir()}) >= 4
    bad = assets.read_pages(pages, read, 8).first()
    assert bad.texts is None and bad.error == "bad long_page_7.png"
    assert assets.read_pages(pages.where("page = 1").withColumn("image", F.lit(None).cast("binary")), read).first().error == "no image"
    assert assets.read_pages(pages.where("false"), read).count() == 0


def test_json_values(spark):
    rows = [('{"a": 1, "t": ["x"], "n": null}',), ('{"a": "7"}',), ('{"a": "b"}',), ("[1]",), ("{bad",), (None,)]
    df = spark.createDataFrame(rows, "j string")
    assert [x[0] for x in df.select(fx.json_value(F.col("j"), "$.a", "int", -1)).collect()] == [1, 7, -1, -1, -1, -1]
    assert [x[0] for x in df.select(fx.json_value(F.col("j"), "$.t[0]", "string")).collect()] == ["x"] + [None] * 5
    assert fx.json_schema(df.where("j like '{\"%'"), "j").startswith("OBJECT<a: ")
