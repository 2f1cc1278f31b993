"""Where intermediate tables go: the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_within: list[str] = []
_RUN = f"run-{uuid.uuid4().hex[:12]}"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder of our own, removed at exit, only where that is unset and Spark runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "dir" not in _own:
            _own["dir"] = tempfile.mkdtemp(prefix="spark-")
            atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
        path = f"file://{_own['dir']}"
    return path.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The part of the shared folder that this process fills."""
    return f"{shared_dir(spark)}/{_RUN}"


def scratch(spark: SparkSession, label: str) -> str:
    """A path that nothing else uses."""
    return f"{_within[-1] if _within else run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder once and read from there."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder in any store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete all that this process stored, once its results are written elsewhere."""
    dropped(spark, run_dir(spark))


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """What is stored inside is deleted at the end, so results must be written elsewhere by then."""
    path = scratch(spark, "temporary")
    _within.append(path)
    try:
        yield
    finally:
        _within.pop()
        dropped(spark, path)
