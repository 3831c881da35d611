"""A folder's changes as a stream, listings' differences, and debouncing."""

import os
import time

from lakequill.streaming.apply import EVENTS, operations
from lakequill.streaming.debounce import PROVIDER, debounced, debounced_stream
from lakequill.streaming.folder import LISTING, folder_events, listing_diff


def test_listing_diff(spark):
    a = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", None, 1), ("d", 1, 1), ("e", 1, 1)], LISTING)
    b = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("c", None, 1), ("d", 1, 2), ("n", 1, 1)], LISTING)
    assert sorted(tuple(r) for r in listing_diff(a, b).collect()) == [("b", "modify"), ("d", "modify"), ("e", "remove"), ("n", "create")]
    assert listing_diff(a.where("false"), a).count() == 5 and listing_diff(a, a).count() == 0


def test_folder_changes_show_once_across_a_restart(spark, tmp_path):
    root, state, out = tmp_path / "notes", tmp_path / "state", []
    (root / "x").mkdir(parents=True)
    (root / ".hidden").mkdir()
    for p in ("a.md", "x/_b.md", ".hidden/c.md", ".d.md"):
        (root / p).write_text("one")

    def start():
        return folder_events(spark, str(root), str(state)).writeStream.foreachBatch(lambda df, _: out.append(sorted((r.kind, r.path) for r in df.collect()))).option("checkpointLocation", str(tmp_path / "ck")).start()

    def wait(q, n):
        end = time.time() + 90
        while len(out) < n and time.time() < end:
            time.sleep(0.2)
            assert q.exception() is None
        return out[n - 1]

    q = start()
    try:
        assert wait(q, 1) == [("create", "a.md"), ("create", "x/_b.md")]
        (root / "a.md").write_text("other words")
        (root / "n.md").write_text("new")
        changed = [*wait(q, 2), *(wait(q, 3) if len(out[1]) < 2 else [])]
        assert sorted(changed) == [("create", "n.md"), ("modify", "a.md")]
    finally:
        q.stop()
    n = len(out)
    os.remove(root / "x/_b.md")
    (root / "late.md").write_text("written while nothing ran")
    q = start()
    try:
        assert wait(q, n + 1) == [("create", "late.md"), ("remove", "x/_b.md")]
        time.sleep(3)
        assert len(out) == n + 1  # nothing changed, so nothing shows
    finally:
        q.stop()
    assert len(os.listdir(state)) <= 3  # what was taken goes once the batch after it begins


def test_debounced_table(spark):
    rows = [(1, "create", "a.md", 0.0), (2, "modify", "a.md", 0.3), (3, "remove", "a.md", 0.6), (4, "create", "a.md", 2.0), (5, "modify", "b.md", 0.1), (6, "modify", "t.txt", 0.1), (7, "rename_both", "b.md", 0.2)]
    df = spark.createDataFrame([(s, k, p, "c.md" if k == "rename_both" else None, t) for s, k, p, t in rows], EVENTS + ", t double").selectExpr("*", "timestamp_micros(cast(t * 1000000 as bigint)) ts")
    got = sorted((r.path, r.op, r.seq, r.n) for r in debounced(operations(df)).collect())
    assert got == [("a.md", "delete", 3, 3), ("a.md", "index", 4, 1), ("b.md", "delete", 7, 2), ("c.md", "index", 7, 1)]
    assert debounced(operations(df.where("false"))).count() == 0


def test_debounced_stream_over_batches(spark, tmp_path):
    log, out = tmp_path / "log", []
    log.mkdir()
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        events = spark.readStream.schema(EVENTS).json(str(log))
        q = debounced_stream(operations(events), 12_000).writeStream.foreachBatch(lambda df, i: out.append((i, [tuple(r) for r in df.collect()]))).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="500 milliseconds").start()
        try:
            for i, kind in enumerate(("create", "modify", "remove")):
                (log / f"{i}.tmp").write_text(f'{{"seq":{i},"kind":"{kind}","path":"a.md"}}\n')
                os.rename(log / f"{i}.tmp", log / f"{i}.json")
                began = time.time()
                while sum(p["numInputRows"] for p in q.recentProgress) <= i and time.time() < began + 60:
                    time.sleep(0.1)
            end = time.time() + 60
            while not any(rows for _, rows in out) and time.time() < end:
                time.sleep(0.3)
                assert q.exception() is None
        finally:
            q.stop()
        assert [rows for _, rows in out if rows] == [[("a.md", "delete", 2)]]
        assert time.time() - began >= 12  # its own quiet time, counted from the last event
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_a_watched_folder_keeps_table_and_index(spark, tmp_path):
    from lakequill.operators.chunking import chunk_files, with_hash, with_id
    from lakequill.operators.embed import embed_chunks, hash_embedder
    from lakequill.operators.segments import SegmentIndex
    from lakequill.operators.store import ChunkStore
    from lakequill.streaming.apply import reader, watch

    root = tmp_path / "notes"
    root.mkdir()
    (root / "a.md").write_text("# A\nkiln ash\n")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    store = ChunkStore(spark, f"file://{tmp_path}/store")
    chunked = lambda f: embed_chunks(with_id(with_hash(chunk_files(f))), hash_embedder(8), "m", 8)
    events = folder_events(spark, str(root), str(tmp_path / "listings"))
    q = watch(spark, events, store, reader(spark, str(root)), chunked, str(tmp_path / "ck"), index_root=f"file://{tmp_path}/fts", quiet_ms=500)

    def until(wanted):
        end = time.time() + 80
        while time.time() < end:
            assert q.exception() is None
            if {r.file_path for r in store.read().select("file_path").distinct().collect()} == wanted:
                return True
            time.sleep(1)
        return False

    try:
        assert until({"a.md"})
        (root / "b.md").write_text("wool and ash\n")
        os.remove(root / "a.md")
        assert until({"b.md"})
        end = time.time() + 30
        while SegmentIndex(spark, f"file://{tmp_path}/fts").state()["source"] != store.version and time.time() < end:
            time.sleep(0.5)
        found = SegmentIndex(spark, f"file://{tmp_path}/fts").search("ash", 5).join(store.read(), "chunk_id").collect()
        assert [r.file_path for r in found] == ["b.md"]
    finally:
        q.stop()
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
