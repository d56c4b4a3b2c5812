"""Sessions, table access and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory (a file or a directory of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, read from ``spark.checkpoint.dir``.

    Only a local session that names no folder gets one of its own; a cluster
    without the setting is refused, since a machine-local folder would not
    survive the loss of an executor.
    """
    sc = spark.sparkContext
    set_dir = sc._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="shelfmark-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers of the session, once; they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_shelfmark_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="shelfmark-ship-")  # the driver's own; Spark serves the file to the executors
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/shelfmark.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(at, n), os.path.join("shelfmark", os.path.relpath(os.path.join(at, n), root)))
    sc.addPyFile(f"{folder}/shelfmark.zip")
    sc._shelfmark_shipped = True


_SCOPE: contextvars.ContextVar[list | None] = contextvars.ContextVar("shelfmark_scope", default=None)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that ``cut`` writes inside are deleted at the end of the scope: read or write the results within it."""
    made: list = []
    token = _SCOPE.set(made)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for at in made:
            at.getFileSystem(conf).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared checkpoint folder and read again; its lineage is cut.

    Unlike ``DataFrame.checkpoint`` this computes the plan once. The table
    outlives executors and is deleted at the end of the ``scope`` around the
    call, without one when the application ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(jsc.hadoopConfiguration()).deleteOnExit(at)
    if (made := _SCOPE.get()) is not None:
        made.append(at)
    return spark.read.schema(df.schema).parquet(path)


def width(spark: SparkSession) -> int:
    """The session's shuffle partitions, at least the default parallelism."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` repartitioned over the session's width, by ``keys`` if given."""
    n = width(df.sparkSession)
    return df.repartition(n, *[F.col(k) for k in keys]) if keys else df.repartition(n)


def scratch_dir() -> str:
    """A task's scratch folder inside Spark's own local directory (as shuffle spill uses).

    It holds only what the running task needs; a lost executor's task is
    recomputed elsewhere from its shuffled input.
    """
    for var in ("LOCAL_DIRS", "SPARK_LOCAL_DIRS"):
        if os.environ.get(var):
            return os.environ[var].split(",")[0]
    from pyspark import SparkFiles

    return SparkFiles.getRootDirectory()
