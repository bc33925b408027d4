"""Sessions, and how Python workers get this package."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors' Python workers this package, once an application: they need not have it installed."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as z:
            for path in sorted(root.rglob("*.py")):
                z.write(path, path.relative_to(root.parent))
        handle, name = tempfile.mkstemp(prefix="scrubjay-", suffix=".zip")
        os.write(handle, packed.getvalue())
        os.close(handle)
        spark.sparkContext.addPyFile(name)  # copied to the application's own file server, which reads it as long as the driver runs
        atexit.register(Path(name).unlink, missing_ok=True)
        _shipped.add(app)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all run on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = os.path.join(tempfile.gettempdir(), "scrubjay-shared")
    os.makedirs(own, exist_ok=True)
    return own


def hadoop_path(spark: SparkSession, folder: str):
    """(file system, path) of a folder, as Spark sees it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared root, deleted at the latest when the application ends: results in it last as long."""
    folder = f"{shared_root(spark)}/scrubjay-{name}-{uuid.uuid4().hex}"
    system, path = hadoop_path(spark, folder)
    system.mkdirs(path)
    system.deleteOnExit(path)
    return folder


def removed(spark: SparkSession, *folders: str) -> None:
    """Delete scratch folders; absent ones are fine."""
    for folder in folders:
        system, path = hadoop_path(spark, folder)
        system.delete(path, True)


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write df as Parquet under the shared root and read it back, which cuts its lineage."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, limit: int = 1 << 20) -> None:
    """From now on the session hands rows to Python workers in batches of about `limit` bytes, one row at least.

    Else a batch may have 64 MB, which the executor and the worker both hold, some in two copies, for each task. A limit that was set
    before holds. It stays set, for a query runs after the function that makes it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(limit))


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session on this machine, as tests and the benchmark use it."""
    settings = {"spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"} | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName("scrubjay")
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)
