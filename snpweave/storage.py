"""Scratch tables in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """The shared folder.  A local one is made only where the setting is absent and driver and executors are one process, as
    in tests; on a cluster without the setting there is no folder that all executors see, which is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="snpweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Folders that :func:`materialize` wrote and nobody has discarded yet.
_written: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back: lineage is cut, and a lost executor costs a re-read of a shared file."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/snpweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    if path in _written:
        _written.remove(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def discard(df: DataFrame) -> None:
    """Delete a table that :func:`materialize` wrote, once nothing reads it any more."""
    for file in df.inputFiles()[:1]:
        folder = file.rsplit("/", 1)[0]
        name = folder.rsplit("/", 1)[1]
        for path in [p for p in _written if p.endswith("/" + name)]:
            delete(df.sparkSession, path)


class Scope:
    """The scratch tables written inside a ``with`` block; :meth:`release` deletes those that are still there.

    Results are lazy and read scratch tables, so the tables of a block can go only when its
    result has been written elsewhere.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scope:
        self.before = set(_written)
        return self

    def __exit__(self, *error) -> None:
        self.paths = [p for p in _written if p not in self.before]

    def release(self) -> None:
        for path in self.paths:
            if path in _written:
                delete(self.spark, path)
