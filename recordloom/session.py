"""Makes this package importable in Python workers, wherever the driver found it, and names the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: dict[str, str] = {}
_LOCAL: dict[str, str] = {}
_FOLDERS: dict[str, str] = {}


def ship(spark: SparkSession) -> SparkSession:
    """Hand the package's sources to all workers of the session's application, once."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="recordloom-"), "recordloom.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, files in os.walk(package):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(folder, f)
                        z.write(full, os.path.relpath(full, os.path.dirname(package)))
        spark.sparkContext.addPyFile(path)
        _SHIPPED[app] = path
    return spark


def spread(df: DataFrame) -> DataFrame:
    """A table read from files, dealt over as many partitions as there are cores where its files give fewer: a kernel then runs on all of them.

    Tables of a cluster's size have more splits than there are cores and stay as they are.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a folder of our own, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='recordloom-')}")


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, below a folder of the application that goes when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        folder = f"{scratch_root(spark)}/recordloom/{app}-{uuid.uuid4().hex}"
        fs, p = _file_system(spark, folder)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _FOLDERS[app] = folder
    return f"{_FOLDERS[app]}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later stages start from files that outlive any executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what materialize() wrote for these before the application ends; nothing may read them any more."""
    for df in frames:
        fs, p = _file_system(df.sparkSession, df._scratch)
        fs.delete(p, True)
