"""The folder that the driver and all executors share, and tables written there to cut a lineage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_run = uuid.uuid4().hex
_made: dict[str, SparkSession] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, with its file system; a temporary one only where none is set and all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="hemicycle-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get()
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """This process's folder under the shared one; it is deleted when the process ends."""
    folder = f"{shared_root(spark)}/hemicycle/run-{_run}"
    _made.setdefault(folder, spark)
    return folder


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the run's folder, read back: lineage is cut, lost executors cost nothing."""
    path = f"{run_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


@atexit.register
def sweep() -> None:
    """Delete what this process has written to its folders."""
    for folder, spark in list(_made.items()):
        with contextlib.suppress(Exception):  # the JVM may be gone by now
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _made.pop(folder, None)
