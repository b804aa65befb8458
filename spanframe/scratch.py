"""Intermediate tables in the folder that driver and executors share.

The folder is the one named in ``spark.checkpoint.dir``. Only a local master may go without it: a
temporary folder then serves, because driver and executors are one process.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a URI without a trailing slash."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spanframe-")
    return _own[app]


class Scratch:
    """A folder of Parquet tables that belong to one run of an operator.

    ``keep`` writes a frame and returns a reader of the copy, which cuts the lineage and survives lost
    executors. ``drop`` removes a table that nothing reads any more; what is left goes when the
    application ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        path = self._path(self.root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)

    def _path(self, where: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(where)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        where = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, name: str) -> None:
        path = self._path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def free_shuffles(self) -> None:
        """Let Spark delete the shuffle files of finished jobs now; it does so when frames are collected."""
        import gc

        gc.collect()
        self.spark._jvm.System.gc()
