"""Tables kept in the folder that driver and executors share, built once for each state of their sources."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of its own for a local session that has none, an error on a cluster."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="loomkb-"))
        base = sc.getCheckpointDir()
    return base.rstrip("/")


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _path(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _path(spark, path)
    fs.delete(at, True)


class Folder:
    """A folder of written tables; it goes when the driver's Python ends, after the session's jobs are cancelled."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def write(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """``df`` run once and read again from the folder, partitioned by the columns ``by``."""
        df.write.option("compression", "zstd").partitionBy(*by).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def clear(self) -> None:
        try:
            self.spark.sparkContext.cancelAllJobs()
            delete(self.spark, self.path)
        except Exception:  # the session may be closed by then
            pass


def signature(spark: SparkSession, df: DataFrame) -> tuple:
    """What changes when any file below ``df`` does: names, lengths and times, without reading contents."""
    files = df.inputFiles()
    if not files:
        return (uuid.uuid4().hex,)  # nothing to go by
    known = spark.read.format("binaryFile").load(files).select(F.xxhash64("path", "length", "modificationTime").alias("h"))
    return tuple(known.agg(F.count("*"), F.bit_xor("h")).first())


_BUILT: dict[tuple, tuple[str, object]] = {}


def built_once(spark: SparkSession, name: str, source: DataFrame, build: Callable[[Folder], object]):
    """What ``build`` makes in a folder, made again only if the source's files have changed or the folder is gone."""
    key = (spark.sparkContext.applicationId, name, signature(spark, source))
    if key in _BUILT and exists(spark, _BUILT[key][0]):
        return _BUILT[key][1]
    folder = Folder(spark, name)
    _BUILT[key] = (folder.path, build(folder))
    return _BUILT[key][1]
