"""Sessions for local work, and shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: The state store that typed streaming state needs.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROOT = Path(__file__).resolve().parent


def local_session(cores: str = "8", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session on this machine, as the tests and the benchmark use it."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, which the cluster names in spark.checkpoint.dir; on one machine a temporary folder may take its place.

    What is written there goes when the application ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/tidemark"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}")
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return f"{at.toString()}/t"


def typed_state(spark: SparkSession) -> None:
    """Let streams that are started from now on keep typed state, which the default store cannot."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, computed once however often it is read."""
    at = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, once for each Spark application.

    Python workers import the functions of a plan by name; on a cluster the
    package need not be installed there.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    fd, path = tempfile.mkstemp(prefix="tidemark-", suffix=".zip")
    with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, str(p.relative_to(ROOT.parent)))
    sc.addPyFile(path)
    sc._tidemark_shipped = True
