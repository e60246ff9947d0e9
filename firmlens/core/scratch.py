"""Written tables in the cluster's shared folder, used to cut lineage.

A table that is read more than once, or that an iteration carries forward, is written
as Parquet below ``spark.checkpoint.dir`` and read back. Every executor sees that
folder, so a lost executor costs at most the tasks it was running. Shuffle files of a
write are removed when it ends: nothing reads them again.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="firmlens-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir()


class Scratch:
    """A folder of intermediate tables of one job."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        self._saved: dict[int, DataFrame] = {}

    @property
    def made(self) -> int:
        """How many paths this folder has given so far."""
        return self._n

    def where(self, name: str) -> str:
        """A fresh path for a table of this name."""
        self._n += 1
        return f"{self.path}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the written table."""
        path = self.where(name)
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(_CLEANUP)
            else:
                self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self._saved[self._n] = out
        return out

    def drop_since(self, made: int, *but: DataFrame) -> None:
        """Delete the tables saved after the first ``made`` paths, except ``but``."""
        kept = {df._scratch_path for df in but}
        for df in [x for n, x in self._saved.items() if n > made and x._scratch_path not in kept]:
            self.drop(df)

    def drop(self, df: DataFrame) -> None:
        """Delete a table that ``save`` returned and nothing reads any more."""
        self._saved = {n: x for n, x in self._saved.items() if x._scratch_path != df._scratch_path}
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
