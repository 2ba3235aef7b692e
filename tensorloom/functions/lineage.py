"""Tables in the folder that driver and executors share: they end a lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where none is set, a temporary folder serves a session of one machine; a cluster needs the setting."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="tensorloom-")
    return _own_dirs[app]


#: Spark removes the shuffle files of an execution at its end, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def own_shuffles(spark: SparkSession):
    """Shuffle files of the writes inside go when each is done. Nothing is run twice on one plan there."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


class Tables:
    """Tables of one computation; they go when the application ends, or earlier by ``drop``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.held = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", []

    def write(self, df: DataFrame) -> DataFrame:
        """``df`` as a table, read back."""
        path = f"{self.base}-{len(self.held)}"
        self._file_system(path)[0].deleteOnExit(self._file_system(path)[1])
        with own_shuffles(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        self.held.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, before: int) -> None:
        """Delete all but the last ``before`` tables, which no plan in use reads any more."""
        for k, path in enumerate(self.held[: len(self.held) - before]):
            if path is not None:
                system, place = self._file_system(path)
                system.delete(place, True)
                self.held[k] = None

    def _file_system(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place


def settle(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder."""
    return Tables(df.sparkSession, name).write(df)
