"""Intermediate tables in the folder that all executors of a cluster share.

A long lineage is cut by writing a table below ``spark.checkpoint.dir`` and reading it again, so a
lost executor costs a re-read and never a recomputation of everything before it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DEFAULT = "/tmp/checkpoints/tideline"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local default only where it is unset on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.conf.set("spark.checkpoint.dir", _LOCAL_DEFAULT)
    return _LOCAL_DEFAULT


class Scratch:
    """Written tables of one operator call.

    ``keep`` writes a frame and returns the reread table; ``drop`` removes tables that no later
    plan reads any more.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._paths: dict[str, str] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        self._paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_but(self, *names: str) -> None:
        """Removes all tables but these."""
        self.drop(*(n for n in self._paths if n not in names))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self._paths.pop(name))
            path.getFileSystem(conf).delete(path, True)
