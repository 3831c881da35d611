"""Discovery and reading of markdown files and assets, on any file system that Arrow knows.

Spark's own lister drops names that begin with an underscore, so tasks list folders, one level of them after the other;
paths stay a table, and files are opened by tasks alone. A root is a path that all machines mount, or a URI.
"""

from __future__ import annotations

import fnmatch
import os
import posixpath
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakequill.runtime import ship, stored

ASSET_EXTENSIONS = ("pdf", "png", "jpg", "jpeg", "webp")  # fixed values
MAX_ASSET_BYTES = int(os.environ.get("LAKEQUILL_MAX_ASSET_BYTES", 50 * 1024 * 1024))


def file_system(root: str):
    """(file system, folder) of a root."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root else "file://" + os.path.abspath(root))


def listed(spark: SparkSession, root: str, strict: bool = False) -> DataFrame:
    """(file_path, length) of the files below root that no dot entry hides; symlinks aren't followed. strict: a folder that can't be read raises, else it is left out.

    A round for each level of folders, which are dealt to the tasks by path; the driver holds no path.
    """
    ship(spark)
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def look(batches):
        import pandas as pd
        from pyarrow import fs

        where, base = file_system(root)
        for pdf in batches:
            rows = []
            for folder in pdf["file_path"]:
                try:
                    found = where.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/")))
                except OSError:
                    if strict:
                        raise
                    continue
                for f in found:
                    if not f.base_name.startswith(".") and not (where.type_name == "local" and os.path.islink(f.path)):
                        rows.append((f"{folder}/{f.base_name}".lstrip("/"), f.type == fs.FileType.Directory, None if f.size is None else int(f.size)))
                if where.get_file_info(f"{base}/{folder}/.gitignore".replace("//", "/")).type == fs.FileType.File:
                    rows.append((f"{folder}/.gitignore".lstrip("/"), False, -1))
            yield pd.DataFrame(rows, columns=["file_path", "folder", "length"]).astype({"folder": bool, "length": "Int64"})

    level, out = spark.createDataFrame([("",)], "file_path string"), None
    while True:
        found = stored(level.repartition(n, "file_path").mapInPandas(look, "file_path string, folder boolean, length long"), "listing")
        files = found.where("not folder").select("file_path", "length")
        out = files if out is None else out.unionAll(files)
        level = found.where("folder").select("file_path")
        if not level.limit(1).count():
            return out


def _ignore_files(rows: DataFrame) -> DataFrame:
    return rows.where("length = -1").select("file_path")


def markdown_paths(rows: DataFrame) -> DataFrame:
    """(file_path) of the rows of listed() that end in .md, in lower case alone."""
    return rows.where(F.col("file_path").rlike(r"[^/]\.md$") & (F.col("length") != -1)).select("file_path")


def glob_regex(glob: str) -> str:
    """An ignore-style glob as a regular expression over relative paths: ** crosses folders, * doesn't; a glob without a slash matches at any depth, one that names a folder all below it."""
    anchored = "/" in glob.rstrip("/")
    g, out, i = glob.strip("/"), "", 0
    while i < len(g):
        if g.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif g.startswith("**", i):
            out, i = out + ".*", i + 2
        elif g[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif g[i] == "?":
            out, i = out + "[^/]", i + 1
        elif g[i] == "[" and "]" in g[i + 2 :]:
            j = g.index("]", i + 2)
            out, i = out + fnmatch.translate(g[i : j + 1])[4:-3], j + 1
        else:
            out, i = out + re.escape(g[i]), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + "(?:/.*)?$"


def ignore_rules(texts: DataFrame) -> DataFrame:
    """(folder, n, keeps, pattern) of the ignore files (file_path, text): the folder that a rule holds in, with a slash behind it, its line, whether it takes back, and a regular expression over paths below the folder. Blank lines and comments are no rules."""
    ship(texts.sparkSession)

    @F.pandas_udf("string")
    def regex(globs):
        return globs.map(glob_regex)

    lines = texts.where("text is not null").select(F.regexp_extract("file_path", r"^(.*/)?[^/]*$", 1).alias("folder"), F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("n", "line"))
    rules = lines.withColumn("line", F.trim("line")).where("line <> '' and not startswith(line, '#')")
    return rules.select("folder", "n", F.col("line").startswith("!").alias("keeps"), regex(F.regexp_replace("line", "^!+", "")).alias("pattern"))


#: Rules up to which they are sent to all tasks; more are joined by their folders' hash.
BROADCAST_RULES = 50_000


def ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(file_path, ignored) of each distinct path, null ones left out: the last matching rule decides, those of deeper folders after those above, without one the path stays.

    A path is joined with the rules of its ancestor folders alone, so the work is in step with paths, depth and the
    rules of a folder, not with paths times rules.
    """
    one = paths.where("file_path is not null").select("file_path").distinct()
    above = F.expr("transform(sequence(0, size(split(file_path, '/')) - 1), i -> if(i = 0, '', concat(substring_index(file_path, '/', i), '/')))")
    folders = one.select("file_path", F.posexplode(above).alias("d", "folder"))
    small = rules.count() <= BROADCAST_RULES
    met = folders.join(F.broadcast(rules) if small else rules, "folder").where(F.rlike(F.expr("substring(file_path, length(folder) + 1)"), F.col("pattern")))
    last = met.groupBy("file_path").agg(F.max_by("keeps", F.struct("d", "n")).alias("keeps"))
    return one.join(last, "file_path", "left").select("file_path", F.coalesce(~F.col("keeps"), F.lit(False)).alias("ignored"))


def asset_paths(spark: SparkSession, root: str, rows: DataFrame | None = None, extensions=ASSET_EXTENSIONS, exclude=()) -> DataFrame:
    """(file_path) of the assets by extension in any case, without what ignore files or the exclude globs name. rows: listed(strict=True) of root, if the caller has it; else a folder that can't be read raises."""
    rows = listed(spark, root, strict=True) if rows is None else rows
    names = rows.select("file_path").where(F.lower("file_path").rlike(r"[^/]\.(" + "|".join(extensions) + ")$") & ~excluded(F.col("file_path"), exclude))
    return ignored(names, ignore_rules(read_texts(spark, root, _ignore_files(rows)))).where(~F.col("ignored")).select("file_path")


def is_tracked(path):
    """Whether a path column is markdown (exact case) or an asset (any case)."""
    return path.rlike(r"\.md$") | F.lower(path).rlike(r"\.(" + "|".join(ASSET_EXTENSIONS) + ")$")


def inside(path, root: str):
    return path.startswith(root.rstrip("/") + "/")


def excluded(path, globs):
    """Whether a column of relative paths matches one of the exclude globs."""
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_regex(g))
    return out


def _dealt(spark: SparkSession, paths) -> DataFrame:
    """(file_path) of a list, dealt to tasks of some 64 files, or of a DataFrame, dealt by path."""
    if isinstance(paths, DataFrame):
        return paths.select("file_path").repartition(spark.sparkContext.defaultParallelism, "file_path")
    return spark.createDataFrame([(p,) for p in paths], "file_path string").repartition(max(1, min(len(paths), 1 + len(paths) // 64)))


def read_texts(spark: SparkSession, root: str, paths) -> DataFrame:
    """(file_path, text, error) of a list or a DataFrame of paths: strictly decoded UTF-8; files that can't be read or decoded have an error and no text."""
    ship(spark)

    def run(batches):
        where, base = file_system(root)
        for pdf in batches:
            texts, errors = [], []
            for p in pdf["file_path"]:
                try:
                    with where.open_input_stream(f"{base}/{p}") as f:
                        texts.append(f.read().decode("utf-8"))
                    errors.append(None)
                except (OSError, UnicodeDecodeError) as e:
                    texts.append(None)
                    errors.append(str(e))
            yield pdf.assign(text=texts, error=errors)

    return _dealt(spark, paths).mapInPandas(run, "file_path string, text string, error string")


def read_bytes(spark: SparkSession, root: str, paths, max_bytes: int = MAX_ASSET_BYTES, content: bool = True) -> DataFrame:
    """(file_path, length, sha256, content, error) of a list or a DataFrame of paths: a file that lies outside root or is longer than max_bytes isn't opened. Without content that column is null."""
    ship(spark)

    def run(batches):
        import hashlib

        where, base = file_system(root)
        local = where.type_name == "local"
        top = os.path.realpath(base) if local else base
        for pdf in batches:
            rows = []
            for p in pdf["file_path"]:
                full = os.path.realpath(os.path.join(base, p)) if local else posixpath.normpath(f"{base}/{p}")
                try:
                    if posixpath.commonpath([top, full]) != top:
                        raise ValueError("outside the root")
                    n = where.get_file_info(full).size
                    if n is not None and n > max_bytes:
                        raise ValueError(f"{n} bytes exceed {max_bytes}")
                    with where.open_input_stream(full) as f:
                        data = f.read()
                    rows.append((len(data), hashlib.sha256(data).hexdigest(), data if content else None, None))
                except (OSError, ValueError) as e:
                    rows.append((None, None, None, str(e)))
            yield pdf.assign(**{k: [r[i] for r in rows] for i, k in enumerate(("length", "sha256", "content", "error"))})

    return _dealt(spark, paths).mapInPandas(run, "file_path string, length long, sha256 string, content binary, error string")


def cached(assets: DataFrame, cache: DataFrame) -> DataFrame:
    """assets with the synthetic text that cache (sha256, synthetic) holds; blank entries count as missing."""
    kept = cache.where(F.col("synthetic").rlike(r"\S")).groupBy("sha256").agg(F.min("synthetic").alias("synthetic"))
    return assets.join(kept, "sha256", "left")
