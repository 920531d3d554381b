"""The Spark session that the queries expect."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that results depend on, or that plans of this library profit from.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS; keys of `more` use __ for dots."""
    builder = SparkSession.builder.config(map=SETTINGS | {k.replace("__", "."): v for k, v in more.items()})
    return (builder.master(master) if master else builder).getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for a session, so that Arrow functions find it wherever
    it lies on the driver."""
    sc = spark.sparkContext
    if getattr(sc, "_noteforge_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="noteforge-zip-")) / "noteforge.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._noteforge_shipped = True


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that spark.checkpoint.dir names, deleted when the driver exits. Where it is unset, a
    temporary folder in local mode; on a cluster an error, as no other folder is known to be shared."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir is unset: name a folder there that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="noteforge-")
        spark.conf.set("spark.checkpoint.dir", shared)
    path = f"{shared.rstrip('/')}/noteforge/{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def _forget(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended: its owner clears the folder
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to scratch() as Parquet and read back: computed once, with a short lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
