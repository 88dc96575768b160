"""Intermediate tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

FILE_ROWS = 1 << 16

_folders: dict[str, str] = {}
_scopes: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a private folder only where none is named and all runs in one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if app not in _folders:
        if not base and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        root = (base or f"file://{tempfile.mkdtemp(prefix='brindle-')}").rstrip("/")
        _folders[app] = f"{root}/brindle-{uuid.uuid4().hex}"
        atexit.register(remove, spark, _folders[app])
    return f"{_folders[app]}/{_scopes[-1]}" if _scopes else _folders[app]


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that are made inside go when it ends: write out what they serve before."""
    _scopes.append(f"scope-{uuid.uuid4().hex}")
    folder = shared_dir(spark)
    try:
        yield
    finally:
        _scopes.pop()
        remove(spark, folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder, if the session still stands."""
    jvm = getattr(spark.sparkContext, "_jvm", None)
    if jvm is None or spark.sparkContext._jsc is None:
        return
    try:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  at the driver's exit the JVM may be gone already
        return


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialize` that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/brindle-" in folder:
            remove(df.sparkSession, folder)


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    ``rows``: a bound of its rows, where that is known: no more files are written than it takes, one
    for FILE_ROWS. The order of partitions is not kept then.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
