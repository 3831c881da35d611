"""Records of archives: ids of their own, urls of any characters, thresholds, large groups, and frames as they lie in the file."""

import struct

import pytest
import zstandard

from lakequill.llm import decontam, warc

SCHEMA = "page_id long, url string, html string, sha string, keeper int, rid long"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, 2) for i, u, h in rows], SCHEMA).repartition(3)


ROWS = [(None, "a", "one"), (None, "b", "two"), (5, "c", "three"), (5, "d", "four"), (7, "e", "same"), (7, "e", "same"), (7, "f", "same"), (6, "g", "same"), (None, "h", "same"), (None, "i", "alone"), (None, "j", "alone")]
ROWS += [(20 + i, u, f"u{i}") for i, u in enumerate([None, "", "http://x/a%0D", "http://x/a\r", "a\nb", " lead", "é  %zz ", "x: y"])] + [(40, "k", None), (41, "l", "")]


def heads(manifest):
    return [h for r in manifest.collect() for h, _ in warc.read_records(warc.open_archive(r.uri))]


@pytest.mark.parametrize("few", [0, 100_000])
def test_records_have_ids_of_their_own(spark, monkeypatch, few):
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", few)
    manifest = warc.write_archives(pages(spark, ROWS))
    found = heads(manifest)
    ids = [h["WARC-Record-ID"] for h in found]
    assert len(ids) == len(ROWS) == len(set(ids))
    responses = {h["WARC-Record-ID"]: h for h in found if h["WARC-Type"] == "response"}
    for h in found:
        if h["WARC-Type"] == "revisit":
            kept = responses[h["WARC-Refers-To"]]
            assert kept["WARC-Payload-Digest"] == h["WARC-Payload-Digest"] and kept["X-Page"] == h["X-Refers-To-Page"]
    got = warc.read_archives(manifest).collect()
    same = sorted((r.record_type, r.refers_to) for r in got if r.url in ("e", "f", "g", "h"))
    assert same == [("response", None)] + [("revisit", 7)] * 4
    assert [r.record_type for r in got if r.url in ("i", "j")] == ["response"] * 2
    assert {r.page_id: r.url for r in got if r.page_id and 20 <= r.page_id < 40} == {i: u for i, u, _ in ROWS if i and 20 <= i < 40}
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got if r.payload_bytes == 0) == [(40, "revisit", 41), (41, "response", None)]


def test_small_payloads_are_all_responses(spark):
    got = warc.read_archives(warc.write_archives(pages(spark, ROWS), min_bytes=5)).collect()
    assert all(r.record_type == "response" and r.refers_to is None for r in got)
    got = warc.read_archives(warc.write_archives(pages(spark, ROWS), min_bytes=4)).collect()
    revisits = [r.url for r in got if r.record_type == "revisit"]
    assert len(revisits) == 4 and set(revisits) <= set("efgh")


def test_a_dictionary_frame_then_a_frame_for_each_record(spark):
    manifest = warc.write_archives(pages(spark, ROWS)).collect()
    for r in manifest:
        data = open(r.uri.removeprefix("file://").removeprefix("file:"), "rb").read()
        magic, n = struct.unpack("<II", data[:8])
        assert magic == warc.SKIPPABLE and len(data) == r.n_bytes
        unit, at, frames = zstandard.ZstdDecompressor(dict_data=warc._dict(data[8 : 8 + n])), 8 + n, 0
        while at < len(data):
            one = unit.decompressobj()
            record = one.decompress(data[at:])
            assert record.startswith(b"WARC/1.1\r\n") and record.count(b"WARC/1.1\r\n") == 1
            at, frames = len(data) - len(one.unused_data), frames + 1
        assert frames == r.n_records
    assert warc.write_archives(pages(spark, ROWS).where("false")).count() == 0


@pytest.mark.parametrize("few", [0, 200_000])
def test_items_without_an_id(spark, monkeypatch, few):
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", few)
    docs = spark.createDataFrame([(1, "a b c d"), (None, "x a b y"), (None, "x a b y"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(None, "a b"), (3, "A, b!"), (4, "c"), (5, None), (6, "")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontam.contamination(docs, items).collect())
    assert got == [(0, 4, 2, 1, True), (0, 4, 2, 1, True), (1, 4, 3, 2, True), (2, 0, 0, 0, False)]
    assert [r.contaminated for r in decontam.contamination(docs, items.where("false")).collect()] == [False] * 4
