"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or the context's checkpoint folder.

    Only a local session without either gets a temporary folder of this machine: there the
    driver and the executors are one process. On a cluster a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(own)
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside send Python workers so many rows at a time; for rows that may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class SharedTables:
    """Parquet tables that cut a long lineage; a lost executor only costs a reread.

    drop() deletes a table that nothing lazy reads any more, so that loops don't pile up files.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, frame: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
        """frame as written and read again; by names columns that get folders of their own."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        frame.write.partitionBy(*by).parquet(path)
        kept = self.spark.read.schema(frame.schema).parquet(path)
        kept._shared_path = path
        return kept

    def drop(self, kept: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(kept._shared_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
