"""Intermediate tables that survive the loss of an executor.

Iterative operators cut their lineage by writing each step as Parquet below the folder the
cluster names in ``spark.checkpoint.dir`` (shared by all executors) and reading it again. Unlike
``DataFrame.checkpoint`` this computes the step once, keeps columns prunable, and tells its row
count. A folder of our own is made only where the setting is absent and the master is local, as in
tests; on a cluster executors would write to their own disks, so a missing setting is an error there.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one for this process where none is set."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
    return _FALLBACK[app]


class Scratch:
    """A folder of intermediate tables of one operator call.

    Results are lazy and read the last tables, so these stay until the process exits, or until the ``with``
    block ends for callers that use one; ``discard`` deletes earlier ones.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.steps = 0
        atexit.register(self.clear)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.clear()

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return a reader of what was written."""
        path = f"{self.root}/{self.steps}"
        self.steps += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def discard(self, *dfs: DataFrame) -> None:
        """Delete tables of earlier steps that nothing reads any more."""
        for df in dfs:
            if path := getattr(df, "_scratch_path", None):
                self._delete(path)

    def clear(self) -> None:
        """Delete the whole folder; called at exit, as results are lazy and may still read it."""
        try:
            self._delete(self.root)
        except Exception:  # the session is gone already
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
