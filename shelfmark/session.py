"""Where shared working files go."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session (tests) may do without the setting.
    """
    global _local_root
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="shelfmark-")
    return _local_root


def new_shared_path(spark: SparkSession, purpose: str) -> str:
    return f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


_staged: list[str] | None = None


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Owns what is staged inside: it is removed at the end, so results must have been written by then."""
    global _staged
    outer, _staged = _staged, []
    try:
        yield
    finally:
        for path in _staged:
            remove(spark, path)
        _staged = outer


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever it is stored."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stage(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame once and read it back.

    Several later uses then share one evaluation, a lost executor costs only its
    own tasks, and the optimizer knows the true size of what it joins.  Inside
    ``staging`` the folder is removed at the end.
    """
    spark = df.sparkSession
    path = new_shared_path(spark, purpose)
    if _staged is not None:
        _staged.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
