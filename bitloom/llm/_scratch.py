"""Shared-storage tables that cut lineage between the steps of a job."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_made: list[Scratch] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; only with a local master, where that is unset, a folder is made and set.

    On a cluster a folder made here would be another one on each machine, so
    there the setting must be given.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="bitloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """A folder of Parquet tables below the shared checkpoint folder.

    ``keep`` writes a frame and reads it back, so that later steps and retries
    after a lost executor start from files every executor can see. ``drop``
    removes tables that no later step reads; those that a result still reads
    stay until ``removed_after`` or ``remove_all`` takes the whole folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/bitloom-{name}-{uuid.uuid4().hex}"
        self.tables: list[str] = []
        _made.append(self)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        self.tables.append(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")
        self.tables = [t for t in self.tables if t not in names]

    def drop_all_but(self, *names: str) -> None:
        self.drop(*(t for t in self.tables if t not in names))

    def remove(self) -> None:
        self._delete(self.root)
        if self in _made:
            _made.remove(self)

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def removed_after() -> Iterator[None]:
    """Removes the tables of all Scratch folders made inside, once nothing reads them any more."""
    before = list(_made)
    try:
        yield
    finally:
        for scratch in [s for s in _made if s not in before]:
            scratch.remove()


def remove_all() -> None:
    """Removes all Scratch folders of this process: to be called when no result of the operators is read any more."""
    for scratch in list(_made):
        scratch.remove()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def schema(fields: list[T.StructField], ddl: str) -> T.StructType:
    """Given fields followed by those of a DDL string."""
    return T.StructType([*fields, *T.StructType.fromDDL(ddl).fields])
