"""Tables between the jobs of one operator, in the folder that all executors share.

An operator that needs several jobs writes what the next job reads as Parquet below
``spark.checkpoint.dir``. That cuts lineage and survives lost executors, since a later job reads
files and never an executor's local copy.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windgrid.runtime import ship

#: Rows and bytes per Arrow batch, so that a batch of long texts stays small.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small in this session, unless it has set its own size, and sends the package to workers.

    The setting stays for later queries of the session: a plan reads it when it runs, which is after the
    operator has returned it.
    """
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a fresh folder only where it is unset (local runs)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="windgrid-")
    spark.sparkContext.setCheckpointDir(folder)
    spark.conf.set("spark.checkpoint.dir", folder)
    atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


class Scratch:
    """A folder for one run of an operator. What the run's result may still read goes when the program ends."""

    def __init__(self, spark: SparkSession, label: str):
        bounded_batches(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Writes df and returns the written table; by: a column that splits it into folders."""
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name)).select(*[F.col(c) for c in like.columns])

    def drop(self, *names: str) -> None:
        """Removes tables that no later job reads."""
        for name in names:
            _remove(self.spark, self.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
