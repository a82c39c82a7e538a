"""Tables written to the folder that all executors share.

Iterative operators cut their lineage with a written Parquet table: a lost
executor then costs a re-read, never a recomputation of the whole history.
Tables are dropped as soon as nothing reads them; what a returned DataFrame
still reads goes with the Python process.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession

#: Tables that are there, by path, with the session that wrote them; and those made in each scope that is open.
_THERE: dict[str, SparkSession] = {}
_SCOPES: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a temporary one in local mode, else an error: executors wouldn't share it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="inkveil-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/inkveil/{name}-{uuid.uuid4().hex}"
    _THERE[path] = spark
    for scope in _SCOPES[-1:]:
        scope.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def _delete(path: str) -> None:
    spark = _THERE.pop(path, None)
    if spark:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def drop(*tables: DataFrame | None) -> None:
    """Delete tables made by :func:`stash` that nothing reads any more."""
    for df in tables:
        if df is not None:
            _delete(df.stash_path)


@contextmanager
def scope() -> Iterator[list[str]]:
    """Deletes, at its end, the tables made inside it whose paths are still in the list that it gives."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield made
    finally:
        _SCOPES.remove(made)
        for path in made:
            _delete(path)


@atexit.register
def _clear() -> None:
    for path in list(_THERE):
        with suppress(Exception):  # the session may have ended
            _delete(path)


def slots(spark: SparkSession) -> int:
    """Partitions that a shuffle of this session makes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
