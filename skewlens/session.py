"""Session settings the library relies on, and the shared folder for written results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

# Only when a session is built: the time to build a plan is mostly calls to the
# JVM, and noting the Python line of each call adds to every one of them.
STATIC_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


# The folder of local sessions that name none, by application.
_LOCAL: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the results depend on to a running session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, the folder all executors share.

    Where the session names none, a local session gets a temporary folder for
    good (there is one machine); on a cluster it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get(spark.sparkContext.applicationId)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        root = _LOCAL[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="skewlens-")
    return f"{root.rstrip('/')}/skewlens-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read back: cuts the lineage, survives lost executors, has a known size."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
