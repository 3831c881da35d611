"""A folder as a stream of file events: listings, their differences, and a streaming source made of both.

The source's offset names a listing, which is stored before the offset is given out. A batch is the full outer join of the
listings at its two ends, so it can be read again after a restart and gives the same events; each change shows once.
"""

from __future__ import annotations

import json
import os
import time
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from lakequill.runtime import ship

LISTING = "path string, size long, modified long"
EVENTS = "seq long, kind string, path string, new_path string"
#: Parts that a listing is dealt to by path; each is a task of a batch.
PARTS = 16
#: Rows of a part that are held before they are written.
ROWS = 50_000


def listing_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, kind): create, modify or remove, of the paths that differ between two listings (path, size, modified).

    Paths are distinct and not null in each listing. Null sizes and times equal each other. One full outer join.
    """
    a = before.select("path", F.struct(F.col("size"), F.col("modified")).alias("x"))
    b = after.select("path", F.struct(F.col("size"), F.col("modified")).alias("y"))
    kind = F.when(F.col("x").isNull(), "create").when(F.col("y").isNull(), "remove").when(~F.col("x").eqNullSafe(F.col("y")), "modify")
    return a.join(b, "path", "full_outer").select("path", kind.alias("kind")).where(F.col("kind").isNotNull())


def _walked(root: str):
    """(path, size, modified in nanoseconds) of the files below root that no dot entry hides, folder by folder, from any file system that Arrow knows. What vanishes meanwhile is left out."""
    from pyarrow import fs

    where, base = fs.FileSystem.from_uri(root if "://" in root else "file://" + os.path.abspath(root))
    folders = [base]
    while folders:
        folder = folders.pop()
        try:
            found = where.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        except OSError:
            continue
        for f in found:
            if f.base_name.startswith(".") or (where.type_name == "local" and os.path.islink(f.path)):
                continue
            if f.type == fs.FileType.Directory:
                folders.append(f.path)
            elif f.type == fs.FileType.File:
                yield os.path.relpath(f.path, base).replace(os.sep, "/"), f.size, f.mtime_ns


class _Listings:
    """Stored listings below a folder: one file for each part, and a digest of all rows."""

    def __init__(self, state: str):
        from pyarrow import fs

        self.fs, self.base = fs.FileSystem.from_uri(state if "://" in state else "file://" + os.path.abspath(state))

    def part(self, name: str, i: int) -> str:
        return f"{self.base}/{name}/part-{i:04d}.parquet"

    def write(self, name: str, rows) -> str:
        """Store a listing; its digest, which doesn't depend on the order of the rows. PARTS * ROWS rows at most are held."""
        import pyarrow as pa
        import pyarrow.parquet as pq

        schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("modified", pa.int64())])
        self.fs.create_dir(f"{self.base}/{name}", recursive=True)
        files = [pq.ParquetWriter(self.part(name, i), schema, filesystem=self.fs) for i in range(PARTS)]
        held: list[list] = [[] for _ in range(PARTS)]
        digest, n = 0, 0

        def flush(i):
            if held[i]:
                files[i].write_table(pa.Table.from_arrays([pa.array(c) for c in zip(*held[i])], schema=schema))
                held[i].clear()

        for row in rows:
            h = zlib.crc32(row[0].encode("utf-8", "surrogatepass"))
            digest, n = (digest + int.from_bytes(_hash(row), "little")) % (1 << 64), n + 1
            held[h % PARTS].append(row)
            if len(held[h % PARTS]) >= ROWS:
                flush(h % PARTS)
        for i, f in enumerate(files):
            flush(i)
            f.close()
        return f"{digest:016x}-{n}"

    def read(self, name: str, i: int):
        import pyarrow.parquet as pq

        return pq.read_table(self.part(name, i), filesystem=self.fs) if name else None

    def names(self) -> list[str]:
        from pyarrow import fs

        return sorted(f.base_name for f in self.fs.get_file_info(fs.FileSelector(self.base, allow_not_found=True)) if f.base_name.startswith("listing-"))

    def drop(self, name: str) -> None:
        self.fs.delete_dir(f"{self.base}/{name}")


def _hash(row) -> bytes:
    import hashlib

    return hashlib.blake2b(repr(row).encode("utf-8", "surrogatepass"), digest_size=8).digest()


class _Part(InputPartition):
    def __init__(self, before: str, after: str, seq: int, i: int):
        self.before, self.after, self.seq, self.i = before, after, seq, i


class _Reader(DataSourceStreamReader):
    def __init__(self, options):
        self.root, self.pause = options["path"], float(options.get("interval", "0"))
        self.listings = options["state"]
        self.last: dict | None = None
        self.looked = 0.0

    def initialOffset(self):
        return {"listing": "", "digest": "", "seq": 0}

    def latestOffset(self):
        """The folder as it is now: the offset before, if no file was made, changed or removed since."""
        store = _Listings(self.listings)
        if self.last is None:
            self.last = self._stored(store) or self.initialOffset()
        if time.monotonic() - self.looked < self.pause:
            return self.last
        seq = self.last["seq"] + 1
        name = f"listing-{seq:012d}-{time.time_ns():x}"
        digest = store.write(name, _walked(self.root))
        self.looked = time.monotonic()
        if digest == self.last["digest"] or (not self.last["digest"] and digest.endswith("-0")):
            store.drop(name)
            return self.last
        self.last = {"listing": name, "digest": digest, "seq": seq}
        with store.fs.open_output_stream(f"{store.base}/{name}/offset.json") as out:
            out.write(json.dumps(self.last).encode())
        return self.last

    def _stored(self, store) -> dict | None:
        """The newest listing that is whole, for a source that starts again. An offset that was given out but not taken is given out again."""
        for name in reversed(store.names()):
            try:
                with store.fs.open_input_stream(f"{store.base}/{name}/offset.json") as f:
                    return json.loads(f.read())
            except OSError:
                continue
        return None

    def partitions(self, start, end):
        return [_Part(start["listing"], end["listing"], end["seq"], i) for i in range(PARTS)] if start["listing"] != end["listing"] else []

    def read(self, partition):
        import pyarrow as pa
        import pyarrow.compute as pc

        store = _Listings(self.listings)
        b = store.read(partition.after, partition.i)
        a = store.read(partition.before, partition.i)
        a = b.slice(0, 0) if a is None else a
        both = a.append_column("old", pa.array([True] * len(a), pa.bool_())).join(b.append_column("new", pa.array([True] * len(b), pa.bool_())), "path", join_type="full outer", right_suffix="_new")
        old, new = pc.fill_null(both["old"], False), pc.fill_null(both["new"], False)
        same = pc.and_(pc.equal(both["size"], both["size_new"]), pc.equal(both["modified"], both["modified_new"]))
        kind = pc.if_else(pc.invert(old), "create", pc.if_else(pc.invert(new), "remove", "modify"))
        changed = both.append_column("kind", kind).filter(pc.invert(pc.fill_null(same, False)))
        n = len(changed)
        out = pa.table([pa.array([partition.seq] * n, pa.int64()), changed["kind"], changed["path"], pa.nulls(n, pa.string())], names=["seq", "kind", "path", "new_path"])
        yield from out.to_batches()

    def commit(self, end):
        """Listings before the one that has been taken are not asked for again."""
        store = _Listings(self.listings)
        for name in store.names():
            if name < end["listing"]:
                store.drop(name)


class FolderEvents(DataSource):
    """Format lakequill_folder: path (the folder), state (a folder for listings), interval (seconds between two looks at least)."""

    @classmethod
    def name(cls):
        return "lakequill_folder"

    def schema(self):
        return EVENTS

    def streamReader(self, schema):
        return _Reader(self.options)


def folder_events(spark: SparkSession, root: str, state: str, interval: float = 0.0) -> DataFrame:
    """The stream of events (seq, kind, path, new_path) of the files below root; the first batch creates what is there. state: a folder that the driver and all tasks reach, kept with the query's checkpoint."""
    ship(spark)
    spark.dataSource.register(FolderEvents)
    return spark.readStream.format("lakequill_folder").option("path", root).option("state", state).option("interval", str(interval)).load()
