"""WARC archives compressed record by record with a Zstandard dictionary.

The dictionary is built from archived records and embedded in a leading skippable frame; every record is a frame of
its own. Records of equal payloads are written once as response; the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.llm.common import put_file, shared_path, ship, spread_join, stored, worker_fs

SKIPPABLE = 0x184D2A5D  # fixed value: the skippable frame that holds a dictionary
DICT_BYTES, SAMPLES, SAMPLE_BYTES, LEVEL = 65_536, 1_000, 16_384, 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Duplicate groups up to which their table is broadcast; more are joined by a shuffle, in which large groups are dealt to several tasks.
BROADCAST_GROUPS = 100_000


def build_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary, or the samples' own bytes where they are too few to train on."""
    import zstandard

    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if samples else b""
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _dict(data: bytes):
    import zstandard

    if not data:
        return None
    trained = data[:4] == b"\x37\xa4\x30\xec"
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)


def _url_headers(url: str) -> list[tuple[str, str]]:
    """A url as header lines; one that a line can't hold as it is comes percent-escaped, and a line of its own says so."""
    if not re.search(r"[\r\n]|^\s|\s$", url):
        return [("WARC-Target-URI", url)]
    return [("WARC-Target-URI", re.sub(r"[%\s]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)), ("X-Target-URI-Escaped", "1")]


def _url_of(head: dict[str, str]) -> str | None:
    url = head.get("WARC-Target-URI")
    return unquote(url, errors="strict") if head.get("X-Target-URI-Escaped") else url


def kept_key(page_id, digest: str) -> str:
    """What names the record that others revisit: of a payload there is one."""
    return f"kept:{page_id}:{digest}"


def record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool, date: str, key: str) -> bytes:
    """The bytes of one record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(SPACE, key)}>"), ("WARC-Date", date)]
    if url is not None:
        head += _url_headers(url)
    head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(SPACE, kept_key(refers_to, digest))}>"), ("X-Refers-To-Page", str(refers_to))]
    if page_id is not None:
        head.append(("X-Page", str(page_id)))
    head += [("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def read_records(stream):
    """(headers, block) of every record of an uncompressed stream."""
    f = io.BufferedReader(stream, 1 << 20)
    while line := f.readline():
        if not line.startswith(b"WARC/1."):
            raise ValueError("not a WARC record")
        head = {}
        while (line := f.readline().rstrip(b"\r\n")):
            k, _, v = line.decode().partition(": ")
            head[k] = v
        block = f.read(int(head["Content-Length"]))
        if f.read(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        yield head, block


def open_archive(uri: str):
    """The uncompressed stream of an archive, by the dictionary of its first frame."""
    import zstandard

    fs, path = worker_fs(uri)
    f = fs.open_input_file(path)
    magic, n = struct.unpack("<II", f.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    data = f.read(n)
    return zstandard.ZstdDecompressor(dict_data=_dict(data)).stream_reader(f, read_across_frames=True)


def _write(root: str, dictionary, date: str):
    def run(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        dict_data = dictionary.value
        shard = TaskContext.get().partitionId()
        zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dict(dict_data), write_content_size=True, write_dict_id=True)
        n = [0]

        def parts(first):
            yield struct.pack("<II", SKIPPABLE, len(dict_data)) + dict_data
            for batch in first:
                for k, (page, url, html, sha, low, revisit) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "sha", "keeper", "revisit")))):
                    payload = html.encode("utf-8", "surrogatepass")
                    digest = base64.b32encode(bytes.fromhex(sha)).decode()
                    key = kept_key(page, digest) if low is not None and not revisit else f"own:{page}:{digest}:{shard}:{n[0]}"
                    n[0] += 1
                    yield zstd.compress(record(page, url, payload, digest, low, revisit, date, key))

        batches = (b for b in batches if len(b))
        first = next(batches, None)
        if first is not None:
            uri = f"{root}/part-{shard:06d}.warc.zst"
            size = put_file(uri, parts(b for some in ([first], batches) for b in some))
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n[0]], pa.int64()), pa.array([size], pa.int64())], names=["uri", "n_records", "n_bytes"])

    return run


def write_archives(pages: DataFrame, root: str | None = None, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write one archive for each task; the manifest: uri, n_records, n_bytes (stored).

    pages: page_id, url, html; further columns are ignored. Null html is empty, null url is left out. Of records with
    equal payloads of at least min_bytes bytes, those of the largest page_id are response and the others revisit it;
    rows without a page_id revisit it too, and are response where no row of their payload has one. Of rows that repeat both one is
    response. No two records of a run share a WARC-Record-ID, whatever rows repeat; urls of any characters come back. The
    dictionary is built from at most SAMPLES records, SAMPLE_BYTES of each, and embedded in every file.
    """
    spark = pages.sparkSession
    ship(spark)
    root = root or shared_path(spark, "warc")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha"))
    copies = rows.where(F.octet_length("html") >= min_bytes).select("page_id", "sha").groupBy("sha", "page_id").agg(F.count("*").alias("n"))
    groups = copies.groupBy("sha").agg(F.max("page_id").alias("keeper"), F.sum("n").alias("rows"), F.max_by("n", "page_id").alias("of_keeper"))
    groups = stored(groups.where("rows > 1 and keeper is not null"), "groups")
    own = F.lit(True)
    if groups.where("of_keeper > 1").limit(1).count():
        # rows that repeat a payload and its largest page_id: one of them is kept, so rows need a number that stays
        rows = stored(rows.withColumn("rid", F.monotonically_increasing_id()), "pages")
        one = rows.select("sha", "page_id", "rid").join(groups.where("of_keeper > 1").select("sha", F.col("keeper").alias("page_id")), ["sha", "page_id"], "left_semi")
        groups = groups.join(one.groupBy("sha").agg(F.min("rid").alias("kept_rid")), "sha", "left")
        groups, own = stored(groups, "groups"), F.col("kept_rid").isNull() | (F.col("rid") == F.col("kept_rid"))
    kept = groups.drop("rows", "of_keeper")
    if groups.count() <= BROADCAST_GROUPS:
        joined = rows.join(F.broadcast(kept), "sha", "left")
    else:
        joined = spread_join(rows, kept, "sha", groups.select("sha", "rows"), "left")
    keeps = F.octet_length("html") >= min_bytes
    is_kept = F.col("page_id").eqNullSafe(F.col("keeper")) & own
    marked = joined.select("page_id", "url", "html", "sha", F.when(keeps, F.col("keeper")).alias("keeper"), F.coalesce(keeps & F.col("keeper").isNotNull() & ~is_kept, F.lit(False)).alias("revisit"))
    share = (SAMPLES + 6 * SAMPLES**0.5) / max(1, rows.count())  # so tasks send hardly more than SAMPLES rows in all
    sample = rows.where(F.rand(7) < share).select("page_id", "url", "sha", F.expr(f"substring(html, 1, {SAMPLE_BYTES})").alias("html")).limit(SAMPLES).collect()
    texts = [record(r["page_id"], r["url"], r["html"].encode("utf-8", "surrogatepass"), base64.b32encode(bytes.fromhex(r["sha"])).decode(), None, False, date, str(k)) for k, r in enumerate(sample)]
    dictionary = spark.sparkContext.broadcast(build_dictionary(texts))
    return stored(marked.mapInArrow(_write(root, dictionary, date), "uri string, n_records long, n_bytes long"), "warc-manifest")


def _read(batches):
    import pyarrow as pa

    for batch in batches:
        for uri in batch.column("uri").to_pylist():
            rows: list[tuple] = []

            def out():
                c = list(zip(*rows))
                types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(c, types)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

            for head, block in read_records(open_archive(uri)):
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                n = int(head["X-Payload-Length"])
                if head["WARC-Type"] == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    if len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{uri}: a payload differs from its digest")
                page, refers = head.get("X-Page"), head.get("X-Refers-To-Page")
                rows.append((None if page is None else int(page), _url_of(head), n, digest, head["WARC-Type"], None if refers is None else int(refers)))
                if len(rows) == 5_000:
                    yield out()
                    rows = []
            if rows:
                yield out()


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record of the archives; payloads are checked against their digests."""
    n = max(1, manifest.count())
    return manifest.select("uri").repartition(n, "uri").mapInArrow(_read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")
