"""Shared scratch space for written intermediate tables.

A written table cuts lineage and fixes row positions, so a later stage that
re-reads it after an executor was lost sees the very same rows.  The folder is
the one the cluster names in ``spark.checkpoint.dir``; only where that is unset
(tests, a laptop) a local folder is chosen.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[object, str]] = []
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.  Where none is named one is created in local mode;
    on a cluster, whose machines would each write to a disk of their own, that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="skein-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder name in the shared folder, deleted with the written tables."""
    path = f"{shared_dir(spark)}/skein-{label}-{uuid.uuid4().hex}"
    _written.append((weakref.ref(spark), path))
    return path


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, unless their Python
    workers find it already."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = Path(__file__).resolve().parent
    name = root.name
    found = context.parallelize([name], 1).map(lambda x: __import__("importlib.util").util.find_spec(x) is not None).first()
    if found or not root.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="skein-code-")) / "skein.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a frame over the written files."""
    spark = df.sparkSession
    path = scratch_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def freeing() -> Iterator[None]:
    """Delete at the end what was written inside; results must have been collected by then."""
    before = len(_written)
    try:
        yield
    finally:
        forget_written(before)


def forget_written(keep: int = 0) -> None:
    """Delete every table written by :func:`materialise` in this process, but for the first ``keep``."""
    while len(_written) > keep:
        ref, path = _written.pop()
        spark = ref()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone already
            continue


atexit.register(forget_written)
