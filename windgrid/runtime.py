"""What Python workers need: the package itself, wherever the driver has it from."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application; call it before a Python function is planned."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="windgrid-ship-")
    atexit.register(shutil.rmtree, folder, True)
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(folder, "windgrid_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for at, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    out.write(full, os.path.join("windgrid", os.path.relpath(full, root)))
    context.addPyFile(path)
    _shipped[context.applicationId] = path


def saver(spark: SparkSession, label: str) -> Callable[[DataFrame, str], DataFrame]:
    """save(df, name): df as a Parquet table below spark.checkpoint.dir, for later jobs; removed when the program ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix=f"windgrid-{label}-")
        atexit.register(shutil.rmtree, folder, True)
        base = f"file://{folder}"
    root = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, root)

    def save(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    return save


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass
