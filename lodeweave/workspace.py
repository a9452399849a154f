"""What a job needs of the cluster: tables that cut lineage, and this package on the workers.

A job that reads one intermediate result several times writes it once as
Parquet and reads it back, so a lost executor costs a re-read and not a
recomputation.  The folder is the one the cluster names in
``spark.checkpoint.dir``; a session that names none (a test on one machine)
gets a folder of its own.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import weakref
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_own: dict[str, str] = {}
_shipped: set[str] = set()
_written: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, which need not have it installed; once per application.

    Every function that gives Spark Python code to run calls this first.
    """
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="lodeweave-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "lodeweave_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for at, _, names in os.walk(home):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(at, name)
                out.write(path, os.path.join(os.path.basename(home), os.path.relpath(path, home)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(application)


def shared_dir(spark: SparkSession) -> str:
    """Folder of this application's intermediate tables, below ``spark.checkpoint.dir`` if the session names one."""
    application = spark.sparkContext.applicationId
    named = spark.conf.get(_SETTING, None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{_SETTING} names no folder that all executors share")
        if application not in _own:
            folder = tempfile.mkdtemp(prefix="lodeweave-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _own[application] = f"file://{folder}"
        named = _own[application]
    return f"{named.rstrip('/')}/lodeweave/{application}"


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of the written table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    _written[written] = path
    return written


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` returned and nothing reads any more; other DataFrames are left alone."""
    for table in tables:
        path = _written.pop(table, None)
        if path:
            delete(table.sparkSession, path)


def _at(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def touch(spark: SparkSession, path: str) -> None:
    """An empty file, for marking that what lies beside it is whole."""
    fs, at = _at(spark, path)
    fs.create(at, True).close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, at = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def clear(spark: SparkSession) -> None:
    """Delete every intermediate table of this application."""
    delete(spark, shared_dir(spark))
