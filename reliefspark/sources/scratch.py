"""Tables and files that a job keeps in the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[tempfile.TemporaryDirectory] = []
_written: list[tuple[SparkSession, str]] = []


def work_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where that is unset, a local session gets one of its own; a cluster gets an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        if not _local:
            _local.append(tempfile.TemporaryDirectory(prefix="grids-", ignore_cleanup_errors=True))
        base = f"file://{_local[0].name}"
    return f"{base.rstrip('/')}/grids/{spark.sparkContext.applicationId}"


def fresh(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is there goes when the application ends."""
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, reread: lineage ends here, and lost executors lose nothing."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(since: int = 0) -> None:
    """Deletes what fresh() and written() have made after the first `since`."""
    gone, _written[since:] = _written[since:], []
    for spark, path in gone:
        if spark.sparkContext._jsc is not None:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


atexit.register(release)
