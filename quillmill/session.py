"""Session helpers: tables, the shared folder and written stages."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in ``spark.checkpoint.dir``.

    Where none is named, a session in local mode, whose executor is the driver, gets a temporary one; on a cluster this is an
    error, since a folder of one machine would lose the rows that others write.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared one, removed like a written stage."""
    path = f"{shared_dir(spark)}/quillmill/{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(release)
    _WRITTEN.append((spark, path))
    return path


def cut(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back.

    This ends the lineage: an executor lost later costs no recomputation of what lies before. Shuffle files of the write go
    when it is done. The table is removed by the ``scope`` it was written in, by ``release``, or when the driver ends. With
    ``by`` the table has one bucket per shuffle partition, so that joins on this column don't move its rows again; ``df`` should
    be partitioned so already.
    """
    spark = df.sparkSession
    path = folder(spark, name)
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        if by:
            stored = f"quillmill_{path[-32:]}"
            df.write.bucketBy(partitions(spark), by).option("path", path).saveAsTable(stored)
        else:
            df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)
    return spark.table(stored) if by else spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the stages that were written within it; their results must have been read by then."""
    kept = list(_WRITTEN)
    try:
        yield
    finally:
        for entry in [x for x in _WRITTEN if x[0] is spark and x not in kept]:
            _remove(*entry)
            _WRITTEN.remove(entry)


def release(spark: SparkSession | None = None) -> None:
    """Removes all written stages, or those of one session."""
    for entry in [x for x in _WRITTEN if spark is None or x[0] is spark]:
        _remove(*entry)
        _WRITTEN.remove(entry)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS quillmill_{path[-32:]}")
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    except Exception:  # noqa: BLE001 - the session may be gone at exit
        pass

