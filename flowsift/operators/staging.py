"""Intermediate tables that several branches of a job read."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
_records: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a temporary one only on a local master."""
    named = spark.conf.get(CHECKPOINT_SETTING, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="flowsift-")
    spark.conf.set(CHECKPOINT_SETTING, folder)
    return folder


def _path_and_store(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path, jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())


def delete_at_exit(spark: SparkSession, path: str) -> None:
    jvm_path, store = _path_and_store(spark, path)
    store.deleteOnExit(jvm_path)


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete tables nobody reads any more."""
    for path in paths:
        jvm_path, store = _path_and_store(spark, path)
        store.delete(jvm_path, True)
        store.cancelDeleteOnExit(jvm_path)


@contextlib.contextmanager
def recorded(paths: list[str]) -> Iterator[list[str]]:
    """Note in ``paths`` the tables staged inside, so that ``remove`` can drop them before the application ends."""
    _records.append(paths)
    try:
        yield paths
    finally:
        _records.remove(paths)


def staged(df: DataFrame) -> DataFrame:
    """Write df once as a columnar table in the shared folder and read it back.

    Every reader then scans only its own columns, and lost executors cost no recomputation. The
    table is removed when the application ends, or by ``remove`` if it was ``recorded``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/flowsift-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_exit(spark, path)
    for paths in _records:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)
