"""Work tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, or under the warehouse where the session leaves that unset (tests, local mode).

    The folder goes when it is discarded or released, or when the driver ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    path = f"{base.rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex[:12]}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system layer."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            if path:
                delete(spark, path)
        except Exception:  # the session has ended, and its owner clears the folder
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.work_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more; others are left alone."""
    for table in tables:
        _drop(lambda path, own=getattr(table, "work_path", None): path == own)


def mark() -> int:
    """A point in time for release()."""
    return len(_made)


def release(since: int, *keep: DataFrame) -> None:
    """Delete all folders that were made since mark(), but for those of the tables to keep."""
    kept = {getattr(t, "work_path", None) for t in keep}
    late = {path for _, path in _made[since:]} - kept
    _drop(lambda path: path in late)


def _drop(gone: Callable[[str], bool]) -> None:
    for spark, path in [x for x in _made if x[1] and gone(x[1])]:
        delete(spark, path)
    # places stay, as marks count them
    _made[:] = [(spark, "" if gone(path) else path) for spark, path in _made]
