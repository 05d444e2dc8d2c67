"""Session and shared-storage helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables that ``stored`` wrote, by application.
_STORED: dict[str, list[str]] = {}
#: Used only where the session names no shared folder, as in tests on one machine.
_OWN_FOLDER: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach: the one of ``setCheckpointDir``,
    else the one that the session names in ``spark.checkpoint.dir``.  Only on a
    local master, where neither is set, is a temporary folder made; on a
    cluster that raises, since executors would write to their own disks."""
    global _OWN_FOLDER
    context = spark.sparkContext
    named = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {context.master} share")
    if _OWN_FOLDER is None:
        _OWN_FOLDER = tempfile.mkdtemp(prefix="quarrymill-")
        atexit.register(shutil.rmtree, _OWN_FOLDER, ignore_errors=True)
    return _OWN_FOLDER


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _drop_at_exit() -> None:
    """Delete what is left of the running application's tables before Python ends it."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        drop_stored(spark)


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; deleted by ``drop_stored`` or when the
    driver's process ends."""
    if not _STORED:
        atexit.register(_drop_at_exit)
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _STORED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def is_stored(spark: SparkSession, path: str | None) -> bool:
    """Was a path made by ``shared_path`` and not dropped since?"""
    return path in _STORED.get(spark.sparkContext.applicationId, ())


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return it read back.

    Cuts the lineage with a copy that outlives any executor, so that several
    consumers read the result instead of computing it again."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> int:
    """Delete the tables that this application stored; frames built on them
    can't be read afterwards.  Returns how many there were."""
    paths = _STORED.pop(spark.sparkContext.applicationId, [])
    _delete(spark, paths)
    return len(paths)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir() -> str:
    """Spill space of the running task: the disks that Spark itself spills to."""
    return (os.environ.get("SPARK_LOCAL_DIRS") or os.environ.get("LOCAL_DIRS") or tempfile.gettempdir()).split(",")[0]


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application."""
    import pathlib
    import zipfile

    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = pathlib.Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="quarrymill-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = pathlib.Path(folder) / "quarrymill.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))  # served to every executor by the driver
    _SHIPPED.add(app)
