"""Materialised intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared working folder: ``spark.checkpoint.dir`` where it is set.

    Only a local session (as in tests) without that setting gets a folder of its own, which is
    then kept in the session for later calls; on a cluster no executor would find it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.quillmask.workDir", None)
    if not root:
        if not (spark.sparkContext.master or "").startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillmask-")
        spark.conf.set("spark.quillmask.workDir", root)
    return root.rstrip("/")


class Workspace:
    """One run's folder of Parquet tables, which cut lineage.

    A table written here is replicated by the shared file system, so a lost
    executor costs a re-read and never the work that made the table.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/quillmask/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def settle(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quillmask_path = path
        return out

    def settle_bucketed(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """Like ``settle``, in buckets of ``key``: a later join or cogroup by it need not deal these rows again."""
        self._n += 1
        table = f"quillmask_{uuid.uuid4().hex}"
        df.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", f"{self.root}/{self._n:03d}-{name}").saveAsTable(table)
        out = self.spark.table(table)
        out.schema  # noqa: B018 - resolved while the catalog has its name
        self.spark.sql(f"DROP TABLE {table}")  # the name only: an external table's files stay
        return out

    def release(self) -> None:
        """Lets Spark remove shuffle files of plans that are no longer held.

        Its cleaner follows the driver JVM's garbage collection, which may not come
        for long between two phases of one job.
        """
        gc.collect()
        self.spark._jvm.System.gc()

    def discard(self, df: DataFrame | None) -> None:
        """Deletes a settled table that no later plan reads."""
        path = getattr(df, "_quillmask_path", None)
        if path:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
