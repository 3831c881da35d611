"""The chunk table: append, delete, replace, prune, counts, change detection and the model guard.

A table is a folder of row files and numbered manifests, of which the last counts. Rows are dealt to buckets by a hash
of their file's path. A change writes the buckets that it touches, then the next manifest, so readers never meet half a
change and the other buckets aren't read or written.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakequill.schema import CHUNKS


class ModelMismatch(ValueError):
    """The table holds vectors of another embedding model."""


class ConcurrentChange(RuntimeError):
    """Another writer has published the version that this change would have become."""


#: Buckets of a new table. A change rewrites the buckets of its files, so tables of many TB want thousands.
BUCKETS = 32
#: Folders that appending leaves in a bucket before it is written anew, and files that a written bucket is dealt to.
MOST_FOLDERS, SPREAD = 8, 4


class ChunkStore:
    """The chunk table under a folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self._buckets = spark, root.rstrip("/"), buckets
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        p = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def _versions(self) -> list[int]:
        return [int(n[1:-5]) for n in self._names(self.root) if n.startswith("m") and n.endswith(".json")]

    def _manifest(self, version: int) -> dict:
        """buckets: their number; folders: the folders that hold each bucket's rows."""
        stream = self._fs.open(self._path(f"{self.root}/m{version:09d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _current(self) -> tuple[int, dict]:
        v = self._versions()
        return (v[-1], self._manifest(v[-1])) if v else (0, {"buckets": self._buckets, "folders": {}})

    @property
    def version(self) -> int:
        """The number of the current version; 0 where nothing was written."""
        return self._current()[0]

    def _rows(self, manifest: dict, only=None) -> DataFrame:
        paths = [f"{self.root}/data/{f}/bucket={b}" for b, fs in manifest["folders"].items() if only is None or int(b) in only for f in fs]
        return self.spark.read.schema(CHUNKS).parquet(*paths) if paths else self.spark.createDataFrame([], CHUNKS)

    def read(self) -> DataFrame:
        """The current rows; an empty table where nothing was written."""
        return self._rows(self._current()[1])

    @staticmethod
    def _bucket(manifest: dict):
        return F.pmod(F.xxhash64("file_path"), F.lit(manifest["buckets"])).cast("int")

    def _touched(self, manifest: dict, paths: DataFrame) -> set[int]:
        return {r[0] for r in paths.select(self._bucket(manifest)).distinct().collect()}  # a row for each bucket at most

    def _write(self, version: int, manifest: dict, rows: DataFrame, rewritten: set[int], added: set[int] = frozenset()) -> None:
        """Publish version + 1: rows are all that the rewritten buckets hold and what the added ones get besides."""
        folder = f"v{version + 1}-{uuid.uuid4().hex[:8]}"
        dealt = rows.select([f.name for f in CHUNKS]).withColumn("bucket", self._bucket(manifest)).repartition("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(SPREAD)))
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/{folder}")
        written = {int(n[7:]) for n in self._names(f"{self.root}/data/{folder}") if n.startswith("bucket=")}
        folders = {b: fs for b, fs in manifest["folders"].items() if int(b) not in rewritten}
        for b in written & (rewritten | added):
            folders[str(b)] = folders.get(str(b), []) + [folder]
        self._publish(version + 1, {"buckets": manifest["buckets"], "folders": folders})

    def _publish(self, version: int, manifest: dict) -> None:
        """The manifest makes its version current. The version before stays for running readers; what only older ones hold goes."""
        final, draft = self._path(f"{self.root}/m{version:09d}.json"), self._path(f"{self.root}/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise ConcurrentChange(f"version {version} was published by another writer")
        v = self._versions()
        held = {(f, b) for x in v[-2:] for b, fs in self._manifest(x)["folders"].items() for f in fs}
        for old in v[:-2]:
            for b, fs in self._manifest(old)["folders"].items():
                for f in fs:
                    if (f, b) not in held:
                        self._fs.delete(self._path(f"{self.root}/data/{f}/bucket={b}"), True)
            self._fs.delete(self._path(f"{self.root}/m{old:09d}.json"), False)

    def append(self, rows: DataFrame) -> None:
        """Add rows without reading others, but for buckets of many folders, which are written anew; nothing for no rows."""
        version, manifest = self._current()
        touched = self._touched(manifest, rows)
        full = {b for b in touched if len(manifest["folders"].get(str(b), [])) >= MOST_FOLDERS}
        if touched:
            fresh = rows.select([f.name for f in CHUNKS])
            self._write(version, manifest, self._rows(manifest, full).unionByName(fresh) if full else fresh, full, touched - full)

    def delete_files(self, paths: DataFrame) -> None:
        self.replace(self.spark.createDataFrame([], CHUNKS), paths)

    def delete_all(self) -> None:
        version, manifest = self._current()
        self._publish(version + 1, {"buckets": manifest["buckets"], "folders": {}})

    def replace(self, rows: DataFrame, paths: DataFrame | None = None) -> None:
        """Put rows in place of all rows of the same files, and of the files in paths."""
        version, manifest = self._current()
        touched = self._touched(manifest, rows)
        if paths is not None:
            touched |= {b for b in self._touched(manifest, paths) if str(b) in manifest["folders"]}
        if touched:
            self._write(version, manifest, upsert(self._rows(manifest, touched), rows, paths), touched)

    def prune(self, discovered: DataFrame) -> int:
        """Delete markdown files that weren't discovered; how many went."""
        gone = orphans(self.read(), discovered)
        n = gone.count()
        if n:
            self.delete_files(gone)
        return n


def upsert(old: DataFrame, new: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    keys = new.select("file_path")
    keys = (keys if paths is None else keys.unionAll(paths.select("file_path"))).distinct()
    return old.join(keys, "file_path", "left_anti").unionByName(new.select(old.columns))


def orphans(stored: DataFrame, discovered: DataFrame) -> DataFrame:
    """Stored markdown paths (extension in any case) that were not discovered."""
    md = F.lower(F.regexp_extract("file_path", r"\.([^./]+)$", 1)) == "md"
    return stored.where(md).select("file_path").distinct().join(discovered.select("file_path"), "file_path", "left_anti")


def change_status(computed: DataFrame, stored: DataFrame) -> DataFrame:
    """(file_path, status) of every file on either side: new, changed, unchanged or missing. Unchanged means equal sets of hashes and equal counts."""
    def side(df, n):
        return df.groupBy("file_path").agg(F.array_sort(F.collect_set("content_hash")).alias(f"h{n}"), F.count("*").alias(f"c{n}"))

    both = side(computed, 1).join(side(stored, 2), "file_path", "full_outer")
    same = (F.col("h1") == F.col("h2")) & (F.col("c1") == F.col("c2"))
    status = F.when(F.col("c2").isNull(), "new").when(F.col("c1").isNull(), "missing").when(same, "unchanged").otherwise("changed")
    return both.select("file_path", status.alias("status"))


def other_models(stored: DataFrame, model: str) -> DataFrame:
    """One row: how many rows another model than this one wrote."""
    return stored.agg(F.count_if(F.col("embedding_model") != model).alias("rows_of_other_models"))


def model_guard(stored: DataFrame, model: str, force: bool = False) -> bool:
    """Whether the table must be cleared first; raises ModelMismatch if another model wrote it and force is off."""
    other = other_models(stored, model).first()[0]
    if other and not force:
        raise ModelMismatch(f"the index was built with another embedding model than {model}")
    return bool(other)


def total_chunks(stored: DataFrame) -> DataFrame:
    return stored.agg(F.count("*").alias("total_chunks"))


def distinct_files(stored: DataFrame) -> DataFrame:
    return stored.agg(F.countDistinct("file_path").alias("distinct_files"))


def chunks_per_file(stored: DataFrame) -> DataFrame:
    return stored.groupBy("file_path").agg(F.count("*").alias("chunks")).orderBy("file_path")


def status(stored: DataFrame) -> DataFrame:
    """The status report's fields; what isn't tracked is null or zero."""
    return chunks_per_file(stored).agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("total_chunks"), F.count("*").alias("total_files")).select(
        "total_chunks", "total_files", F.lit(None).cast("string").alias("last_index_time"), F.lit(0).alias("queue_depth"), F.lit(0).alias("stale_files")
    )
