"""Shared scratch tables.

Iterative operators cut their lineage through the folder that the cluster names in
``spark.checkpoint.dir``. It is read from the session and set only where it is unset
(single-machine tests), never replaced.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder. Where none is configured, a local one on a single machine; on a
    cluster, whose executors could not see it, that raises."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found:
        return found
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="meshlark-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir() or named


def checkpoint(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of a merge join. Rows that ``inline`` or ``explode`` makes are estimated at the
    size of the row they come from, so that Spark would send a table of many millions to the driver
    and broadcast it because the table behind it is small."""
    return df.hint("merge")


class Scratch:
    """Parquet tables in the shared folder, for intermediates read more than once. A result may read
    them until the session ends, so what has not been dropped goes then."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        self._files(self.root, "deleteOnExit")
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str | None = None) -> None:
        self._files(self.root if name is None else f"{self.root}/{name}", "delete", True)

    def _files(self, path: str, method: str, *rest) -> None:
        sc = self.spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        getattr(at.getFileSystem(sc._jsc.hadoopConfiguration()), method)(at, *rest)
