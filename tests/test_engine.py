import json

import pytest

from lakequill.functions import format as fmt
from lakequill.functions import text as fx
from lakequill.operators import search as s
from lakequill.operators.embed import EmbeddingError, hash_embedder, with_retry
from lakequill.operators.store import ChunkStore, ModelMismatch, change_status, model_guard
from lakequill.plans.index import index
from lakequill.sources import files
from lakequill.streaming.apply import EVENTS, apply_batch, last_operations, reader, watch
from pyspark.sql import functions as F


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(col.alias("x")).first()["x"]


def test_highlight(spark):
    assert one(spark, fx.highlight(F.col("t"), "kiln ash"), t="Ash & kilns: the KILN") == "<mark>Ash</mark> &amp; kilns: the <mark>KILN</mark>"
    assert one(spark, fx.highlight(F.col("t"), "ash"), t="washed ash,ashes") == "washed <mark>ash</mark>,ashes"
    assert one(spark, fx.highlight(F.col("t"), "\t "), t="1 < 2 & 3 > 2") == "1 &lt; 2 &amp; 3 &gt; 2"


def test_similarity_and_tags(spark):
    assert [one(spark, s.similarity(F.col("d")), d=d) for d in (0.25, 1.0, 1.5, 2.5, -0.5)] == [0.875, 0.5, 0.25, 0.0, 1.0]
    assert one(spark, s.has_tag(F.col("j"), "clay"), j='{"tags":["wool","clay"]}')
    assert not one(spark, s.has_tag(F.col("j"), "cla"), j='{"tags":["clay"]}') and not one(spark, s.has_tag(F.col("j"), "a"), j='{"tags":"a"}')


def test_cut_between_characters(spark):
    for text, n in (("aé€😀" * 50, 100), ("x" * 99 + "😀z", 100), ("é" * 60, 101), ("ab", 100)):
        data = text.encode()
        down = next(k for k in range(min(n, len(data)), -1, -1) if k == len(data) or data[k] & 0xC0 != 0x80)
        up = next(k for k in range(n, n + 4) if k >= len(data) or data[k] & 0xC0 != 0x80)
        whole = len(data) <= n
        assert one(spark, fx.excerpt(F.col("t"), n), t=text) == (text if whole else data[:down].decode() + "…")
        assert one(spark, fx.preview(F.col("t"), n), t=text) == (text if whole else data[:up].decode() + "...")


def test_stored_index_searches_alike(spark, tmp_path):
    rows = [(f"k{i:02d}", " ".join(["kiln", "ash", "wool", "Clay", "é1"][(i * j) % 5] for j in range(i % 9))) for i in range(40)]
    chunks = spark.createDataFrame(rows, "chunk_id string, body string")
    s.write_index(chunks, f"file://{tmp_path}/fts")
    for query in ("kiln ash", "CLAY!", "é1 wool nothing", "", "absent"):
        a = [(r[0], round(r[1], 9)) for r in s.bm25(chunks, query, 12).collect()]
        b = [(r[0], round(r[1], 9)) for r in s.bm25_indexed(spark, f"file://{tmp_path}/fts", query, 12).collect()]
        assert a == b
    opts = s.SearchOptions(query="kiln", mode="fts", limit=3)
    full = chunks.selectExpr("*", "'f' file_path")
    assert [r.chunk_id for r in s.search(full, opts).collect()] == [r.chunk_id for r in s.search(full, opts, f"file://{tmp_path}/fts").collect()]


def test_discovery(spark, tmp_path):
    for p in ("a.md", "b.MD", "_c.md", "x/y/z.md", ".hidden/s.md", ".d.md", "t.txt", "p.PNG", "skip/q.pdf", "x/r.jpg"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    (tmp_path / ".gitignore").write_text("skip/\n")
    for root in (str(tmp_path), f"file://{tmp_path}"):
        assert sorted(r.file_path for r in files.markdown_paths(files.listed(spark, root)).collect()) == ["_c.md", "a.md", "x/y/z.md"]
    assert files.read_texts(spark, f"file://{tmp_path}", ["_c.md"]).first().text == "x" and files.listed(spark, str(tmp_path / "none")).count() == 0
    assets = lambda **more: sorted(r.file_path for r in files.asset_paths(spark, str(tmp_path), **more).collect())
    assert assets() == ["p.PNG", "x/r.jpg"] and assets(exclude=["x/**"]) == ["p.PNG"]
    (tmp_path / "x/.gitignore").write_text("# none\n\n*.jpg\n!r.jpg\n/s*\n")
    (tmp_path / "x/s.png").write_text("x")
    (tmp_path / "x/t.jpg").write_text("x")
    assert assets() == ["p.PNG", "x/r.jpg"]
    (tmp_path / ".gitignore").write_text("skip/\n*.png\n")
    (tmp_path / "x/.gitignore").write_text("!*.png\n")
    assert assets() == ["p.PNG", "x/r.jpg", "x/s.png", "x/t.jpg"]


def test_retry():
    calls = []

    def embed(texts):
        calls.append(1)
        if len(calls) < 3:
            raise EmbeddingError("busy", 429)
        return [[1.0]]

    assert with_retry(embed, ["a"], wait=lambda _: None) == [[1.0]]
    with pytest.raises(EmbeddingError):
        with_retry(lambda t: (_ for _ in ()).throw(EmbeddingError("no", 401)), ["a"], wait=lambda _: pytest.fail("waited"))


def test_index_search_and_stream(spark, tmp_path):
    root = tmp_path / "notes"
    root.mkdir()
    (root / "clay.md").write_text("---\ntags: [clay]\n---\n# Clay\n" + "glaze recipes from wood ash and feldspar\n" * 300)
    (root / "wool.md").write_text("# Wool\ncarding before spinning\n")
    (root / "bad.md").write_bytes(b"\xff\xfe\xff")
    store = ChunkStore(spark, f"file://{tmp_path}/store")
    run = lambda: index(spark, str(root), store, hash_embedder(16), "m1", 16)
    first = run()
    assert first["files_indexed"] == 2 and first["errors"] == 1 and first["chunks_embedded"] == store.read().count() > 3
    again = run()
    assert again["chunks_embedded"] == 0 and again["chunks_skipped"] == first["chunks_embedded"]
    with pytest.raises(ModelMismatch):
        model_guard(store.read(), "m2")
    assert model_guard(store.read(), "m2", force=True) and not model_guard(store.read(), "m1")
    got = s.search(store.read(), s.SearchOptions(query="wood ash", mode="fts", limit=2, context=1)).collect()
    assert [r["is_context"] for r in got][:2] == [False, False] and any(r["is_context"] for r in got) and got[0]["similarity_score"] == 1.0
    tagged = s.search(store.read(), s.SearchOptions(query="carding", mode="hybrid", vector=hash_embedder(16)(["carding"])[0], tag_filter="clay")).collect()
    assert tagged and all(r["file_path"] == "clay.md" for r in tagged)
    order = s.search(store.read(), s.SearchOptions(query="feldspar", mode="fts", limit=2, rerank=lambda q, t: list(range(len(t)))[::-1])).collect()
    assert order[0]["similarity_score"] == 1.0
    lines = [json.loads(r["json"]) for r in fmt.to_json_rows(s.search(store.read(), s.SearchOptions(query="carding", mode="fts"))).collect()]
    assert len(lines) == 1 and "semantic_score" not in lines[0] and "is_context" not in lines[0]
    assert fmt.pretty_rows(s.search(store.read(), s.SearchOptions(query="carding", mode="fts"))).first()["block"].startswith("[1] wool.md -- # Wool  (score: 1.00)")

    log = tmp_path / "log"
    log.mkdir()
    (root / "new.md").write_text("# New\nfresh words\n")
    (log / "1.json").write_text('{"seq":1,"kind":"create","path":"new.md"}\n{"seq":2,"kind":"remove","path":"wool.md"}\n')
    from lakequill.operators.chunking import chunk_files, with_hash, with_id
    from lakequill.operators.embed import embed_chunks

    q = watch(spark, str(log), store, lambda p: files.read_texts(spark, str(root), p), lambda f: embed_chunks(with_id(with_hash(chunk_files(f))), hash_embedder(16), "m1", 16), str(tmp_path / "ck"), None)
    q.awaitTermination(120)
    assert {r[0] for r in store.read().select("file_path").distinct().collect()} == {"clay.md", "new.md"}
    (root / "new.md").unlink()
    assert run()["orphan_files_removed"] == 1


def test_changes_and_operations(spark):
    rows = lambda x: spark.createDataFrame(x, "file_path string, content_hash string")
    got = dict(map(tuple, change_status(rows([("a", "1"), ("b", "1"), ("b", "1"), ("b", "2"), ("c", "1")]), rows([("a", "1"), ("b", "1"), ("b", "2"), ("b", "2"), ("d", "1")])).collect()))
    assert got == {"a": "unchanged", "b": "unchanged", "c": "new", "d": "missing"}
    e = spark.createDataFrame([(1, "create", "a.md", None), (2, "rename_both", "a.md", "b.md"), (3, "access", "b.md", None), (4, "create", "x.txt", None)], EVENTS)
    assert {(r.path, r.op) for r in last_operations(e).collect()} == {("a.md", "delete"), ("b.md", "index")}


def test_assets(spark):
    from lakequill.operators.assets import compose, extract

    class Fake:
        def page_texts(self, content, n):
            return ["first page of some text", "second"] if content == b"t" else [""]

        def page_images(self, content, n):
            return [[b"i"], []]

        def rasterise(self, content, n):
            return [b"r"]

        def describe(self, image, name):
            return "a\nb"

    rows = spark.createDataFrame([("d/t.pdf", "1", bytearray(b"t")), ("s.pdf", "2", bytearray(b"s")), ("p.png", "3", bytearray(b"p"))], "file_path string, sha256 string, content binary")
    got = {r.file_path: r.text for r in compose(extract(rows, Fake())).collect()}
    assert got["p.png"] == "# p.png\n\n> **[Image: p.png]** a\n> b\n"
    assert got["s.pdf"] == "# Source: s.pdf\n\n> **[Image: s_page_1.png]** a\n> b"
    assert got["d/t.pdf"] == "# Source: t.pdf\n\n## Page 1\n\nfirst page of some text\n\n> **[Image: t_page_1_image_1.png]** a\n> b\n\n---\n\n## Page 2\n\nsecond"


def chunk(path, i, model="m"):
    return (f"{path}-{i}", path, "", f"body {i}", i, i, None, f"h{i}", model, [1.0])


def test_store_changes_only_the_buckets_of_its_files(spark, tmp_path):
    from lakequill.operators.store import MOST_FOLDERS, ConcurrentChange
    from lakequill.schema import CHUNKS

    rows = lambda *x: spark.createDataFrame([chunk(p, i) for p, i in x], CHUNKS)
    paths = lambda *x: spark.createDataFrame([(p,) for p in x], "file_path string")
    store, held = ChunkStore(spark, f"file://{tmp_path}/s", buckets=4), set()
    have = lambda: {(r.file_path, r.line_start) for r in store.read().collect()}
    assert have() == set()
    store.append(rows())
    store.delete_files(paths("x"))
    assert store._versions() == []
    for i in range(MOST_FOLDERS + 2):
        store.append(rows(("a", i), ("b", i)))
        held |= {("a", i), ("b", i)}
    assert have() == held and all(len(f) <= MOST_FOLDERS for f in store._current()[1]["folders"].values())
    before = store._current()[1]["folders"]
    store.replace(rows(("a", 99)), paths("a", "nowhere"))
    after, held = store._current()[1]["folders"], {x for x in held if x[0] == "b"} | {("a", 99)}
    a, nowhere = (str(spark.sql(f"SELECT pmod(xxhash64('{p}'), 4)").first()[0]) for p in ("a", "nowhere"))
    assert have() == held and all(after.get(b) == before.get(b) for b in set(before) - {a, nowhere})
    store.delete_files(paths("b"))
    assert have() == {("a", 99)} and len(store._versions()) == 2
    version, manifest = store._current()
    store.append(rows(("c", 1)))
    with pytest.raises(ConcurrentChange):
        store._write(version, manifest, rows(("c", 2)), set(), {0, 1, 2, 3})
    assert have() == {("a", 99), ("c", 1)}
    store.delete_all()
    assert have() == set()


def test_asset_cache_and_events(spark, tmp_path):
    from lakequill.operators.assets import AssetCache, synthetic_texts
    from lakequill.operators.chunking import chunk_files, with_hash, with_id
    from lakequill.operators.embed import embed_chunks
    from lakequill.operators.metrics import Metrics

    class Counting:
        """Extracts the bytes as a page's text; every call leaves a file."""

        def __init__(self, log):
            self.log = log

        def page_texts(self, content, n):
            import uuid

            open(f"{self.log}/{uuid.uuid4().hex}", "w").close()
            if content == b"broken":
                raise ValueError("no document")
            return [content.decode()]

        def page_images(self, content, n):
            return [[], [], [b"i"]]

        def describe(self, image, name):
            return "seen"

    root, log = tmp_path / "notes", tmp_path / "calls"
    root.mkdir()
    log.mkdir()
    calls = lambda: len(list(log.iterdir()))
    for name, data in (("a.pdf", b"some page text here"), ("b.pdf", b"some page text here"), ("bad.pdf", b"broken"), ("out/x.pdf", b"left out of the index")):
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_bytes(data)
    cache = AssetCache(spark, f"file://{tmp_path}/cache")
    read = lambda *p, c=cache: {r.file_path: (r.text, r.error) for r in synthetic_texts(spark, str(root), list(p), Counting(str(log)), c).collect()}
    first = read("a.pdf", "b.pdf", "../no.pdf", "gone.pdf")
    text = "# Source: a.pdf\n\n## Page 1\n\nsome page text here\n\n---\n\n## Page 2\n\n---\n\n## Page 3\n\n> **[Image: a_page_3_image_1.png]** seen"
    assert first["a.pdf"] == first["b.pdf"] == (text, None) and first["../no.pdf"][1] and first["gone.pdf"][1] and calls() == 1
    assert read("b.pdf")["b.pdf"] == (text, None) and calls() == 1
    assert read("bad.pdf")["bad.pdf"] == (None, "no document") and calls() == 2 and read() == {}
    assert cache.add(spark.createDataFrame([("f" * 64, " \n")], "sha256 string, text string"))
    assert files.cached(spark.createDataFrame([("f" * 64,)], "sha256 string"), cache.read()).first()["synthetic"] is None

    store, metrics = ChunkStore(spark, f"file://{tmp_path}/store"), Metrics()
    chunked = lambda f: embed_chunks(with_id(with_hash(chunk_files(f))), hash_embedder(8), "m", 8)
    (root / "n.md").write_text("plain words\n")
    batch = spark.createDataFrame([(i, "create", p, None) for i, p in enumerate(("a.pdf", "bad.pdf", "out/x.pdf", "n.md", "t.txt"))], EVENTS)
    got = apply_batch(batch, store, reader(spark, str(root), Counting(str(log)), cache, ["out/**"]), chunked, metrics, f"file://{tmp_path}/fts")
    held = {r[0] for r in store.read().select("file_path").distinct().collect()}
    assert got == (2, 0) and held == {"a.pdf", "n.md"} and calls() == 3
    assert metrics.values["file_events_processed_total"] == 5 and metrics.values["embedding_errors_total"] == 1 and metrics.values["files_total"] == 2
    assert "embedding_latency_seconds_count 1\n" in metrics.render()
    found = s.bm25_indexed(spark, f"file://{tmp_path}/fts", "page", 5).join(store.read(), "chunk_id")
    assert {r.file_path for r in found.collect()} == {"a.pdf"}
    assert apply_batch(batch, store, reader(spark, str(root)), chunked) == (1, 0)

    (root / "bad.pdf").unlink()
    run = index(spark, str(root), store, hash_embedder(8), "m", 8, extractor=Counting(str(log)), exclude=["out/**"], cache=cache, metrics=metrics)
    assert run["assets_indexed"] == 2 and calls() == 3 and metrics.values["files_total"] == 3


def test_scanned_pages():
    from lakequill.operators.assets import Ocr, RateLimited

    now, tokens, answers, waits = [0.0], [], [], []

    def call(image, token):
        got = answers.pop(0)
        if got is None:
            raise RateLimited
        return f"{token}{got}"

    ocr = Ocr(call, lambda: tokens.append(1) or f"t{len(tokens)}", waits.append, lambda: now[0])
    answers += [" page ", None, "again", None, None]
    assert ocr(b"") == "t1 page" and ocr(b"") == "t1again" and waits == [0.5]
    with pytest.raises(RateLimited):
        ocr(b"")
    now[0], answers[:] = 3000.0, ["x"]
    assert ocr(b"") == "t2x"
    with pytest.raises(ValueError):
        Ocr(lambda i, t: " ", lambda: "t")(b"")


def test_reranker_prompt_and_answer(spark):
    from lakequill.operators.rerank import PromptReranker, RerankError
    from lakequill.schema import CHUNKS

    chunks = spark.createDataFrame([(f"k{i}", f"f{i}.md", "# H", "kiln " * (i + 1) + "é" * 900, i, i, None, "h", "m", [1.0]) for i in range(3)], CHUNKS)
    asked = []

    def search(answer, **more):
        opts = s.SearchOptions(query="kiln", mode="fts", limit=2, rerank=PromptReranker(lambda p: asked.append(p) or answer), **more)
        return [(r.chunk_id, r.similarity_score) for r in s.search(chunks, opts).collect()]

    plain = [r.chunk_id for r in s.search(chunks, s.SearchOptions(query="kiln", mode="fts")).collect()]
    assert search('Here:\n```json\n{"indices": [2, 0, 1]}\n```') == [(plain[2], 1.0), (plain[0], 0.5)]
    assert f"note 0\nfile: f{plain[0][1:]}.md\nheading: # H\n" in asked[0] and "é…" in asked[0] and "é" * 400 not in asked[0]
    for bad in ('{"indices": [0, 1]}', '{"indices": [0, 1, 1]}', '{"indices": [0, 1, 3]}', '{"indices": [0, 1, null]}', "no", "{}"):
        with pytest.raises(RerankError):
            search(bad)
    asked.clear()
    assert len(search("unused", path_filter="f1.md")) == 1 and not asked
    with pytest.raises(ValueError):
        s.search(chunks, s.SearchOptions(query="kiln", mode="fts", rerank=lambda q, t: [0]))


def test_metrics():
    from lakequill.operators.metrics import Metrics

    m = Metrics()
    m.add("search_queries_total", 2)
    m.set("queue_depth", 3)
    for x in (0.005, 0.3, 7):
        m.observe("search_latency_seconds", x)
    with m.timed("embedding_latency_seconds"):
        pass
    text = m.render()
    assert "# TYPE search_queries_total counter\nsearch_queries_total 2\n" in text and "queue_depth 3\n" in text
    assert 'search_latency_seconds_bucket{le="0.005"} 1\n' in text and 'le="0.5"} 2\n' in text and 'search_latency_seconds_bucket{le="+Inf"} 3\nsearch_latency_seconds_sum 7.305\nsearch_latency_seconds_count 3\n' in text
    with pytest.raises(ValueError):
        m.add("queue_depth")


def test_pages_and_command_line(spark, tmp_path, monkeypatch):
    from lakequill.__main__ import parser, run
    from lakequill.plans import pages

    (tmp_path / "clay.md").write_text("# Clay\nwood ash & feldspar\n")
    (tmp_path / "wool.md").write_text("# Wool\ncarding\n")
    said = []
    go = lambda *a: run(spark, parser().parse_args(a), said.append)
    go("index", str(tmp_path))
    monkeypatch.chdir(tmp_path)
    go("search", "ash", "--mode", "fts", "--format", "pretty")
    go("search", "carding", "--limit", "1")
    go("status")
    assert json.loads(said[0])["files_indexed"] == 2 and said[1].startswith("[1] clay.md -- # Clay  (score: 1.00)") and "wool.md" in said[2]
    assert json.loads(said[3])["total_files"] == 2
    chunks = ChunkStore(spark, f"file://{tmp_path}/.lakequill/chunks").read()
    shown = pages.search_rows(chunks, "ash", "odd", hash_embedder(64)).collect()
    assert len(shown) == 2 and "wood <mark>ash</mark> &amp; feldspar" in shown[0].chunk_html and pages.search_rows(chunks).count() == 0
    assert pages.status_row(chunks, "m", 64).first()["total_embeddings"] == 2 and [r.chunk_count for r in pages.index_rows(chunks).collect()] == [1, 1]
    assert pages.settings_row(spark, "d", "b", "p", "env", "INFO").first()["credential_source"] == "env"
