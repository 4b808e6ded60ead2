"""The folder that the driver and all executors share, and tables kept there."""

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, deleted when the program ends; a local folder only where that is unset and the master is local, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.conf.get("spark.master", "").split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base}/{uuid.uuid4().hex}"
    _results.append((spark, path))
    return path


_results: list[tuple[SparkSession, str]] = []


@atexit.register
def _clear() -> None:
    for spark, path in _results:
        with contextlib.suppress(Exception):  # the session may be gone
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df):
    """``df`` written once to the shared folder and read again."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
