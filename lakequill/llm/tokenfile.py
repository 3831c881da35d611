"""Token ids in files of fixed-width bits.

A file is a magic, blocks of BLOCK ids each packed in `bits` bits (the fewest that the vocabulary needs), and a
footer: document ids, their first tokens, the byte offset of every block, and counts. Sixty-four ids fill exactly
`bits` words of 64 bits, so packing and unpacking are a fixed number of numpy operations, and any id is found from
its block's offset alone.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.llm.common import put_file, shared_path, ship, shuffle_parts, stored, text_or_empty, worker_fs

MAGIC, BLOCK = b"LQTOKEN1", 1 << 16
_TAIL = struct.Struct("<IIQQQ8s")  # bits, block size, tokens, documents, footer's offset, magic
NO_ID = -(2**63)


#: How much larger than usual the encoding memos of the writing workers are; nothing else of size lies in their memory.
ROOM = 2


def bits_for(vocabulary: int) -> int:
    return max(1, (max(1, vocabulary) - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """ids in bits bits each, padded with zeros to a multiple of 64 ids; an id that needs more raises ValueError."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} needs more than {bits} bits")
    rows = -(-len(ids) // 64)
    x = np.zeros(rows * 64, np.uint64)
    x[: len(ids)] = ids
    x = x.reshape(rows, 64)
    out = np.zeros((rows, bits), np.uint64)
    for lane in range(64):
        word, shift = divmod(lane * bits, 64)
        out[:, word] |= x[:, lane] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= x[:, lane] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()


def unpack_ids(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first n ids of packed data."""
    words = np.frombuffer(data, "<u8").reshape(-1, bits)
    out = np.empty((len(words), 64), np.uint64)
    mask = np.uint64((1 << bits) - 1)
    for lane in range(64):
        word, shift = divmod(lane * bits, 64)
        v = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            v = v | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, lane] = v & mask
    return out.reshape(-1)[:n].astype(np.uint32)


class TokenFile:
    """Reads one file: its tables at once, ids on demand."""

    def __init__(self, uri: str):
        fs, path = worker_fs(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.bits, self.block, self.n_tokens, self.n_docs, at, magic = _TAIL.unpack(self._read(size - _TAIL.size, _TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        n_blocks = -(-self.n_tokens // self.block)
        table = np.frombuffer(self._read(at, 8 * (self.n_docs + self.n_docs + 1 + n_blocks + 1)), "<i8")
        self.doc_ids, self.starts, self.offsets = np.split(table, [self.n_docs, 2 * self.n_docs + 1])

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def read_block(self, k: int) -> np.ndarray:
        a, b = int(self.offsets[k]), int(self.offsets[k + 1])
        return unpack_ids(self._read(a, b - a), self.bits, min(self.block, self.n_tokens - k * self.block))

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start to end of the file, from their blocks alone."""
        if end <= start:
            return np.zeros(0, np.uint32)
        first = start // self.block
        x = np.concatenate([self.read_block(k) for k in range(first, -(-end // self.block))])
        return x[start - first * self.block : end - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))

    def documents(self):
        """(doc_id, start, length, crc32 of the ids as little-endian unsigned 32-bit integers), one block in memory at a time."""
        crc, i = 0, 0
        for k in range(-(-self.n_tokens // self.block)):
            x, base = self.read_block(k).astype("<u4"), k * self.block
            while i < self.n_docs:
                a, b = int(self.starts[i]), int(self.starts[i + 1])
                if a >= base + len(x):
                    break
                crc = zlib.crc32(x[max(a - base, 0) : b - base], crc)
                if b > base + len(x):
                    break
                yield int(self.doc_ids[i]), a, b - a, crc
                crc, i = 0, i + 1
        self.file.close()


def write_token_file(uri: str, docs, bits: int) -> tuple[int, int]:
    """Write (doc_id, little-endian unsigned 32-bit ids) pairs in order; (documents, tokens)."""
    ids, starts, offsets, total = [], [0], [len(MAGIC)], [0]

    def parts():
        yield MAGIC
        held, n = [], 0

        def block(x):
            data = pack_ids(x, bits)
            offsets.append(offsets[-1] + len(data))
            return data

        for doc, data in docs:
            ids.append(NO_ID if doc is None else doc)
            x = np.frombuffer(data, "<u4")
            starts.append(starts[-1] + len(x))
            held.append(x)
            n += len(x)
            if n >= BLOCK:
                x = np.concatenate(held)
                full = n // BLOCK * BLOCK
                for k in range(0, full, BLOCK):
                    yield block(x[k : k + BLOCK])
                held, n = [x[full:].copy()], n - full
        if n:
            yield block(np.concatenate(held))
        total[0] = starts[-1]
        yield np.array([*ids, *starts, *offsets], "<i8").tobytes()
        yield _TAIL.pack(bits, BLOCK, total[0], len(ids), offsets[-1], MAGIC)

    put_file(uri, parts())
    return len(ids), total[0]


def _write(root: str, tokenizer: str, bits: int, end_id: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from lakequill.llm.coder import coder

        encode, end = coder(tokenizer, ROOM).encode, np.array([end_id], "<u4").tobytes()

        def docs():
            for batch in batches:
                for i, t in zip(batch.column("_lq_id").to_pylist(), batch.column("_lq_text").to_pylist()):
                    yield i, encode(t) + end

        shard = TaskContext.get().partitionId()
        rows = iter(docs())
        first = next(rows, None)
        if first is not None:
            uri = f"{root}/shard-{shard:06d}.lqtok"
            n, tokens = write_token_file(uri, (x for part in ([first], rows) for x in part), bits)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([uri]), pa.array([n], pa.int64()), pa.array([tokens], pa.int64())], names=["shard", "uri", "n_docs", "n_tokens"])

    return run


def vocabulary_of(tokenizer: str) -> int:
    """Ids of a tokenizers file, added tokens included."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values(), default=0) + 1


def write_tokens(docs: DataFrame, tokenizer: str, vocabulary: int | None = None, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", root: str | None = None) -> DataFrame:
    """Write the ids of every whole text, end_id after each, in ascending doc_id order; the manifest: shard, uri, n_docs, n_tokens, base (tokens of the shards before).

    vocabulary: number of ids; None asks the tokenizer. Shards hold ranges of doc_id. Null texts are empty; null ids come first; rows of one doc_id go by text. Further
    columns are ignored; an empty table gives no files. A repeated task replaces its own file.
    """
    spark = docs.sparkSession
    ship(spark)
    root = root or shared_path(spark, "tokens")
    bits = bits_for(max(vocabulary_of(tokenizer) if vocabulary is None else vocabulary, end_id + 1))
    read = docs.select(F.col(doc_id).cast("long").alias("_lq_id"), text_or_empty(text).alias("_lq_text"))
    dealt = read.repartitionByRange(shuffle_parts(spark), "_lq_id").sortWithinPartitions("_lq_id", "_lq_text")
    manifest = stored(dealt.mapInArrow(_write(root, tokenizer, bits, end_id), "shard int, uri string, n_docs long, n_tokens long"), "manifest")
    rows, base = [], 0
    for r in manifest.orderBy("shard").collect():  # one row for each file
        rows.append((*r, base))
        base += r["n_tokens"]
    return spark.createDataFrame(rows, "shard int, uri string, n_docs long, n_tokens long, base long")


def _documents(batches):
    import pyarrow as pa

    def table(rows):
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array([None if x == NO_ID else x for x in cols[0]], pa.int64()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    for batch in batches:
        for uri, base in zip(batch.column("uri").to_pylist(), batch.column("base").to_pylist()):
            rows = []
            for i, s, n, crc in TokenFile(uri).documents():
                rows.append((i, base + s, n, crc))
                if len(rows) == 10_000:
                    yield table(rows)
                    rows = []
            if rows:
                yield table(rows)


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (long) of every document, from the files of a manifest."""
    n = max(1, manifest.count())
    return manifest.select("uri", "base").repartition(n, "uri").mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
