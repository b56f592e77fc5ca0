"""Helpers shared by the corpus operators: the shared work folder, written tables and size-checked broadcasts."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of a few plain columns (at most about 40 bytes a row) may be broadcast.
BROADCAST_ROWS = 1_000_000
#: Bytes up to which a table of wider rows may be.
BROADCAST_BYTES = 40_000_000
#: Rows of texts in a batch that goes to Python.
ARROW_ROWS = 500
#: Spark's setting by which the files of a query's shuffles are deleted when it ends, and not when the driver's garbage is collected.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Letters that the contracts fold; other letters keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_held: dict[str, object] = {}


def held(name: str, make):
    """What a Python worker keeps between tasks, such as memories of words; those of one kind only, whatever runs later."""
    if name not in _held:
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _held[name] = make()
    return _held[name]


_written: list[tuple[SparkSession, str]] = []
_local: list[tempfile.TemporaryDirectory] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; the path may be any that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """df; whole texts go to Python in batches of ARROW_ROWS, unless the session's number was set to another than Spark's."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key) == "10000":
        df.sparkSession.conf.set(key, str(ARROW_ROWS))
    return df


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a local session gets one of its own; a cluster gets an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        if not _local:
            _local.append(tempfile.TemporaryDirectory(prefix="corpus-", ignore_cleanup_errors=True))
        base = f"file://{_local[0].name}"
    return f"{base.rstrip('/')}/corpus/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, reread: lineage ends here and lost executors lose nothing.

    The table goes when the application ends, or when release() is called. The shuffles that made it go at once.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANED, "false")
    spark.conf.set(CLEANED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANED, before)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def tables() -> int:
    """How many written tables there are now: release(tables()) later deletes those written since."""
    return len(_written)


def release(since: int = 0, keep: int = 0) -> None:
    """Deletes the tables that written() has made after the first `since`, but for the last `keep` of them."""
    last = len(_written) - keep
    gone, _written[since:last] = _written[since:last], []
    for spark, path in gone:
        if spark.sparkContext._jsc is None:
            continue
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


atexit.register(release)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, width=None) -> DataFrame:
    """df (a written table), marked for broadcast if it has at most `rows` rows and, by `width` (bytes a row), BROADCAST_BYTES; else Spark shuffles both sides.

    Without `width`, rows are narrow ones of plain columns.
    """
    if df.limit(rows + 1).count() > rows:
        return df
    wide = width is not None and (df.agg(F.sum(width)).first()[0] or 0) > BROADCAST_BYTES
    return df if wide else F.broadcast(df)


def free(df: DataFrame) -> None:
    """Deletes a written table that nothing reads any more."""
    path = getattr(df, "written_at", None)
    for k, (_, at) in enumerate(_written):
        if at == path:
            release(k, len(_written) - k - 1)
            return


def folded(text):
    """A text column with null as empty and A-Z, only these, lower-cased."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
