"""Shipping this package to Python workers, and tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parents[1]
_SHIPPED: set[str] = set()
_OWN: list[str] = []
#: Bytes of texts that one Arrow batch hands to Python, and that a worker's batch of results has.
BATCH_BYTES = 2 << 20


def ship(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    out = Path(tempfile.mkdtemp(prefix="lakequill-")) / "lakequill_pkg.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted((_ROOT / "lakequill").rglob("*.py")):
            z.write(p, p.relative_to(_ROOT))
    sc.addPyFile(str(out))
    _SHIPPED.add(sc.applicationId)


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session have BATCH_BYTES at most, or one row, where the user hasn't set their size. By Spark's own 10,000 rows or 64 MB a worker's memory grows with the input up to several hundred MB."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on a local master without it (tests), an own one."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(f"file://{tempfile.mkdtemp(prefix='lakequill-shared-')}")
        d = _OWN[0]
    return d.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lakequill-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder as Parquet and reread: lineage ends here and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lq_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_lq_path", None)
        if path:
            drop_path(t.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
