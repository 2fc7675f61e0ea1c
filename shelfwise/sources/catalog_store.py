"""A catalogue kept as numbered versions of one Parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MAX_SNAPSHOTS = 10


class CatalogStore:
    """``version=N`` folders below ``path``; the highest number is current, the ones below are snapshots.

    A version is written whole and only then visible (its ``_SUCCESS`` file), so a failed commit leaves
    the old version current.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = MAX_SNAPSHOTS):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        root = self._path(self.path)
        if not self._fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        found = [int(n.split("=")[1]) for n in names if n.startswith("version=")]
        return sorted(v for v in found if self._fs.exists(self._path(f"{self._folder(v)}/_SUCCESS")))

    def _folder(self, version: int) -> str:
        return f"{self.path}/version={version}"

    def current(self) -> DataFrame:
        versions = self.versions()
        if not versions:
            raise ValueError("the catalogue has no version yet")
        return self.spark.read.parquet(self._folder(versions[-1]))

    def commit(self, df: DataFrame) -> int:
        """Write a new current version and keep the newest ``keep`` older ones for undo."""
        versions = self.versions()
        new = versions[-1] + 1 if versions else 1
        df.write.mode("overwrite").parquet(self._folder(new))
        for old in versions[:-self.keep]:
            self._fs.delete(self._path(self._folder(old)), True)
        return new

    def undo(self) -> DataFrame:
        """Drop the current version, so the one before the last commit is current again."""
        versions = self.versions()
        if len(versions) < 2:
            raise ValueError("no snapshot to undo")
        self._fs.delete(self._path(self._folder(versions[-1])), True)
        return self.current()
