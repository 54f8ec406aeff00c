"""Helpers shared by the training-data operators: scratch tables in the cluster's shared folder, worker tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a Java/RE2 pattern.
WS = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Only where neither is set and all runs on this machine (tests) a temporary folder is used; on a cluster that
    would be a folder which executors can't read, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not base:
        current = context._jsc.sc().getCheckpointDir()
        base = current.get() if current.isDefined() else None
    if not base:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="wovenlake-")
        context.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder."""
    path = f"{shared_folder(spark)}/wovenlake/{name}-{uuid.uuid4().hex}"
    for scope in _scopes:
        scope.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's file system for it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


#: Open scopes: each gets the folders made while it is open.
_scopes: list[list[str]] = []


def materialise(df: DataFrame, name: str, release: bool = False, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors.

    release: also have the driver drop its references to finished shuffles, so that executors delete their files
    before the next large shuffle begins (Spark does so only when the driver happens to collect garbage).
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path, compression=compression)
    if release:
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path  # for Scratch.drop
    return out


class Scratch:
    """Tables of one run that are dropped as soon as nothing needs them any more.

    ``keep`` writes a table, ``drop`` deletes tables whose successor is written; leaving the scope deletes all that is
    left, so what a run returns has to be written outside of it or be kept by ``release``.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, name: str, release: bool = False, compression: str = "snappy") -> DataFrame:
        out = materialise(df, name, release, compression)
        self.paths[id(out)] = (out, out._scratch_path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _, path = self.paths.pop(id(t))
            remove(self.spark, path)

    def release(self, table: DataFrame) -> DataFrame:
        """The table stays when the scope ends: the result reads it."""
        self.paths.pop(id(table))
        return table

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop(*[t for t, _ in list(self.paths.values())])


@contextmanager
def scratch_of() -> Iterator[list[str]]:
    """Collects the folders made while it is open, for a caller that knows when they are no longer read."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes.remove(made)


def base_columns(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, renamed: extra columns of the caller can't clash with internal names."""
    return df.select(*[F.col(f"`{v}`").alias(k) for k, v in columns.items()])


_tables: dict[str, object] = {}


def worker_table(name: str, make: Callable[[], object]) -> object:
    """The one large table of this Python worker. A worker is used again by later operators: a table under another
    name takes the place of the one before, so tables of several operators never add up."""
    if name not in _tables:
        _tables.clear()
        _tables[name] = make()
    return _tables[name]
