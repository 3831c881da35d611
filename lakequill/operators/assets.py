"""Assets as synthetic markdown. Text extraction, rasterising and vision are plug-ins; composing is Spark's."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakequill.functions.text import image_blockquote, pdf_class
from lakequill.runtime import ship, stored
from lakequill.sources import files

LOG = logging.getLogger(__name__)

PAGE_BREAK = "\n\n---\n\n"
MAX_PDF_PAGES = 30


class Extractor(Protocol):
    """What a deployment plugs in: page texts of a document, and descriptions of its images or pages. With an attribute ocr, an Ocr or any function from a page's image to its text, scanned pages go there instead of to describe."""

    def page_texts(self, content: bytes, max_pages: int) -> list[str]: ...
    def page_images(self, content: bytes, max_pages: int) -> list[list[bytes]]: ...
    def rasterise(self, content: bytes, max_pages: int) -> list[bytes]: ...
    def describe(self, image: bytes, name: str) -> str: ...


class RateLimited(RuntimeError):
    """The service asks for a pause."""


class Ocr:
    """Text of a scanned page from a service that wants a token: the token is kept for 50 minutes, a call that is rate-limited is tried once more after half a second, and an empty answer is an error."""

    KEEP, PAUSE = 50 * 60, 0.5

    def __init__(self, call: Callable[[bytes, str], str], fetch_token: Callable[[], str], wait=time.sleep, clock=time.monotonic):
        self.call, self.fetch_token, self.wait, self.clock, self.held = call, fetch_token, wait, clock, None

    def token(self) -> str:
        if self.held is None or self.clock() - self.held[1] >= self.KEEP:
            self.held = (self.fetch_token(), self.clock())
        return self.held[0]

    def __call__(self, image: bytes) -> str:
        try:
            text = self.call(image, self.token())
        except RateLimited:
            self.wait(self.PAUSE)
            text = self.call(image, self.token())
        if not text.strip():
            raise ValueError("the page's text is empty")
        return text.strip()


def extract(assets: DataFrame, extractor: Extractor, max_pages: int = MAX_PDF_PAGES) -> DataFrame:
    """(file_path, sha256, kind, pages, images, error) of (file_path, sha256, content) rows, by the plug-in. images: array of (page, n, description). Where a column error is given, a row that has one passes with it."""
    def run(batches):
        for pdf in batches:
            rows = []
            for path, data, failed in zip(pdf["file_path"], pdf["content"], pdf["error"]):
                name = path.rsplit("/", 1)[-1]
                try:
                    if failed:
                        raise ValueError(failed)
                    if not name.lower().endswith(".pdf"):
                        text = extractor.describe(bytes(data), name)
                        if not text.strip():
                            raise ValueError("empty description")
                        rows.append(("image", [], [(1, 1, text)], None))
                        continue
                    pages = [p.strip() for p in extractor.page_texts(bytes(data), max_pages)][:max_pages]
                    shown = sum(sum(c in "\n\r\t" or not (ord(c) < 32 or 127 <= ord(c) < 160) for c in p) for p in pages)
                    if shown >= 12 * max(len(pages), 1):
                        images, found_in = [], extractor.page_images(bytes(data), max_pages)
                        pages += [""] * (len(found_in) - len(pages))
                        for p, found in enumerate(found_in, 1):
                            for i, x in enumerate(found, 1):
                                try:
                                    images.append((p, i, extractor.describe(x, f"{name.rsplit('.', 1)[0]}_page_{p}_image_{i}.png")))
                                except Exception:  # an image that fails is left out
                                    continue
                        rows.append(("text_first", pages, images, None))
                    else:
                        shots = extractor.rasterise(bytes(data), max_pages)
                        if not shots:
                            raise ValueError("no pages")
                        rows.append(("needs_vision", [], [], None, [(p, bytes(x)) for p, x in enumerate(shots, 1)]))
                except Exception as e:
                    rows.append((None, [], [], str(e)))
            rows = [r if len(r) == 5 else (*r, []) for r in rows]
            yield pdf[["file_path", "sha256"]].assign(**{k: [r[i] for r in rows] for i, k in enumerate(("kind", "pages", "images", "error", "shots"))})

    ship(assets.sparkSession)
    error = F.col("error") if "error" in assets.columns else F.lit(None).cast("string")
    found = assets.select("file_path", "sha256", "content", error.alias("error")).mapInPandas(run, "file_path string, sha256 string, kind string, pages array<string>, images array<struct<page:int,n:int,text:string>>, error string, shots array<struct<page:int,image:binary>>")
    found = stored(found, "extracted")  # read twice; pages of scanned documents lie in it
    ocr = getattr(extractor, "ocr", None)
    shots = found.where("kind = 'needs_vision'").select("file_path", F.inline("shots"))
    seen = read_pages(shots, (lambda image, name: ocr(image)) if ocr else extractor.describe)
    images = F.transform("texts", lambda t, i: F.struct((i + 1).alias("page"), F.lit(1).alias("n"), t.alias("text")))
    scanned = seen.select("file_path", images.alias("scans"), F.col("error").alias("scan_error"))
    joined = found.drop("shots").join(scanned, "file_path", "left")
    failed = F.col("scan_error").isNotNull()
    return joined.select("file_path", "sha256", F.when(~failed, F.col("kind")).alias("kind"), "pages", F.coalesce(F.when(failed, F.array().cast("array<struct<page:int,n:int,text:string>>")), F.when(F.col("kind") == "needs_vision", F.col("scans")), F.col("images")).alias("images"), F.coalesce("error", "scan_error").alias("error"))


def read_pages(pages: DataFrame, read: Callable[[bytes, str], str], parts: int | None = None) -> DataFrame:
    """(file_path, texts, error) of page rows (file_path, page, image): what read makes of each image and its name, in the order of pages, or the error of the first page that fails and no texts.

    Pages are dealt over the tasks one by one, so a long document is read by many; what comes back is put together by file.
    Null images fail. Repeated page numbers keep each row, by their texts.
    """
    def run(batches):
        for pdf in batches:
            texts, errors = [], []
            for path, page, image in zip(pdf["file_path"], pdf["page"], pdf["image"]):
                try:
                    if image is None:
                        raise ValueError("no image")
                    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                    texts.append(read(bytes(image), f"{stem}_page_{page}.png"))
                    errors.append(None)
                except Exception as e:
                    texts.append(None)
                    errors.append(str(e) or type(e).__name__)
            yield pdf[["file_path", "page"]].assign(text=texts, error=errors)

    spark = pages.sparkSession
    ship(spark)
    n = parts or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    each = pages.select("file_path", F.col("page").cast("int").alias("page"), "image").repartition(n, "file_path", "page").mapInPandas(run, "file_path string, page int, text string, error string")
    whole = each.groupBy("file_path").agg(F.array_sort(F.collect_list(F.when(F.col("error").isNull(), F.struct("page", "text")))).alias("x"), F.min(F.when(F.col("error").isNotNull(), F.struct("page", "error")))["error"].alias("error"))
    return whole.select("file_path", F.when(F.col("error").isNull(), F.transform("x", lambda p: p["text"])).alias("texts"), "error")


def compose(extracted: DataFrame) -> DataFrame:
    """(file_path, sha256, text): the synthetic markdown of extracted assets that have no error."""
    name = F.regexp_extract("file_path", r"([^/]+)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")

    def page(text, i):
        own = F.filter("images", lambda x: x["page"] == i + 1)
        quotes = F.transform(own, lambda x: image_blockquote(F.concat(stem, F.lit("_page_"), x["page"].cast("string"), F.lit("_image_"), x["n"].cast("string"), F.lit(".png")), x["text"]))
        return F.regexp_replace(F.concat_ws("\n\n", F.concat(F.lit("## Page "), (i + 1).cast("string")), F.when(text != "", text), F.when(F.size(quotes) > 0, F.array_join(quotes, "\n\n"))), r"\s+\z", "")

    first = F.concat(F.lit("# Source: "), name, F.lit("\n\n"), F.array_join(F.transform("pages", page), PAGE_BREAK))
    shots = F.transform("images", lambda x: image_blockquote(F.concat(stem, F.lit("_page_"), x["page"].cast("string"), F.lit(".png")), x["text"]))
    scan = F.concat(F.lit("# Source: "), name, F.lit("\n\n"), F.array_join(shots, PAGE_BREAK))
    image = F.concat(F.lit("# "), name, F.lit("\n\n"), image_blockquote(name, F.col("images")[0]["text"]), F.lit("\n"))
    text = F.when(F.col("kind") == "text_first", first).when(F.col("kind") == "needs_vision", scan).when(F.col("kind") == "image", image)
    return extracted.where(F.col("error").isNull()).select("file_path", "sha256", text.alias("text"))


def classify(pages: DataFrame) -> DataFrame:
    return pages.withColumn("kind", pdf_class(F.col("pages")))


CACHED = "sha256 string, synthetic string"


class AssetCache:
    """Synthetic texts by the hash of an asset's bytes, in a folder of any file system that Spark reads. Rows are only added; what can't be read counts as missing."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def read(self) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], CACHED)
        return self.spark.read.schema(CACHED).option("ignoreCorruptFiles", "true").parquet(self.root).select("sha256", "synthetic")

    def add(self, texts: DataFrame) -> bool:
        """Add (sha256, text) rows; a failure is logged, since the texts can be made again. They get a folder of their own: writing into a folder that is being read would drop what was computed from it."""
        try:
            texts.select("sha256", F.col("text").alias("synthetic")).write.parquet(f"{self.root}/run={uuid.uuid4().hex}")
            return True
        except Exception as e:
            LOG.debug("asset cache write skipped: %s", e)
            return False


def synthetic_texts(spark: SparkSession, root: str, paths, extractor: Extractor, cache: AssetCache | None = None, max_bytes: int = files.MAX_ASSET_BYTES, max_pages: int = MAX_PDF_PAGES) -> DataFrame:
    """(file_path, text, error) of the assets in paths, a list or a DataFrame, kept in memory for the caller to unpersist.

    Assets are first read for their hashes alone. Texts that the cache holds are taken from it; of files with equal
    bytes that it doesn't hold the smallest path is extracted for all, and its text is added to the cache.
    """
    seen = files.read_bytes(spark, root, paths, max_bytes, content=False).persist()
    good = seen.where("error is null").select("file_path", "sha256")
    known = (files.cached(good, cache.read()) if cache else good.withColumn("synthetic", F.lit(None).cast("string"))).persist()
    first = known.where("synthetic is null").groupBy("sha256").agg(F.min("file_path").alias("first"))
    found = extract(files.read_bytes(spark, root, first.select(F.col("first").alias("file_path")), max_bytes), extractor, max_pages).persist()
    found.count()  # in full before it is used twice: stages that run side by side would each extract
    texts = compose(found)
    made = first.join(texts.select(F.col("file_path").alias("first"), "text"), "first", "left").join(found.select(F.col("file_path").alias("first"), "error"), "first", "left")
    out = known.join(made.drop("first"), "sha256", "left").select("file_path", F.coalesce("synthetic", "text").alias("text"), "error")
    out = out.unionByName(seen.where("error is not null").select("file_path", F.lit(None).cast("string").alias("text"), "error")).persist()
    out.count()
    if cache:
        cache.add(texts)
    for df in (seen, known, found):
        df.unpersist()
    return out
