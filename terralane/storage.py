"""Tables written to the folder that driver and executors share, used to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_folder: str | None = None
_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where that is unset and all tasks run on this machine."""
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_folder is None:
        _own_folder = "file://" + tempfile.mkdtemp(prefix="terralane-")
    return _own_folder


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _scopes:
        made.append(path)
    return path


@contextmanager
def scope() -> Iterator[list[str]]:
    """The paths of all tables that are made inside."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes[:] = [s for s in _scopes if s is not made]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[set[str]]:
    """Delete the tables that are made inside, but for paths that are added to the set."""
    kept: set[str] = set()
    with scope() as made:
        yield kept
    remove(spark, *(p for p in made if p not in kept))


def settle(build: Callable[[], DataFrame], name: str) -> tuple[DataFrame, str]:
    """Write what ``build`` gives, then delete every table that was made on the way; return the table and its path.

    Operators return plans over tables in the shared folder, which must stay while a plan may still run.
    """
    with scope() as made:
        out, path = materialize(build(), name)
    remove(out.sparkSession, *(p for p in made if p != path))
    return out, path


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet to the shared folder; return the table as read again, and its path."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables of :func:`materialize` that nothing reads any more."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
