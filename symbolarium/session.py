"""Session helpers: settings for local runs, and the package for Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting to delete the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()
_stored: dict[str, list[str]] = {}
_built: dict[str, dict[tuple, tuple[DataFrame, ...]]] = {}


def _local_folder() -> str:
    """A folder of the driver that is removed when Python ends."""
    folder = tempfile.mkdtemp(prefix="symbolarium")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def local_session(cpus: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("symbolarium")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable for the Python workers of ``spark``; does nothing where it is already.

    Workers see the driver's PYTHONPATH. If that doesn't hold the package, Spark's own file
    service hands an archive of it to every executor.
    """
    app = spark.sparkContext.applicationId
    on_path = str(_ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if on_path or app in _shipped:
        return spark
    archive = Path(_local_folder()) / "symbolarium.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, p.relative_to(_ROOT.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a folder of this machine only where none is set and the master is local.

    On a cluster without that setting executors would write to their own disks, so that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or _local_folder())
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder.

    For a result that is read several times: it is computed once, survives the loss of executors,
    and Spark knows its size when it chooses how to join it. Shuffle files of that computation are deleted at its
    end, not when the driver happens to collect its garbage. The table stays until :func:`release`
    is called or the session ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    at, fs = _file(spark, path)
    fs.deleteOnExit(at)
    _stored.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def built(spark: SparkSession, key: tuple, make: Callable[[], tuple[DataFrame, ...]]) -> tuple[DataFrame, ...]:
    """The tables that ``make`` gives, stored once for each ``key`` and session until :func:`release` is called.

    ``key`` must tell apart all states of the inputs.
    """
    known = _built.setdefault(spark.sparkContext.applicationId, {})
    if key not in known:
        known[key] = tuple(stored(df) for df in make())
    return known[key]


def release(spark: SparkSession) -> None:
    """Delete the tables that :func:`stored` has made so far; results that read them can't be read after that."""
    _built.pop(spark.sparkContext.applicationId, None)
    for path in _stored.pop(spark.sparkContext.applicationId, []):
        at, fs = _file(spark, path)
        fs.delete(at, True)


def _file(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())
