"""Tables kept as immutable versions: readers name a version, so a page sequence never sees later writes.

A version is a folder ``v=<n>`` written by Spark's committer; it counts once its ``_SUCCESS`` file is there. Commits
carry an idempotency key: the same key and content replays the first outcome, other content under it is a conflict.
The log of commits is a small table of its own (one row a commit).
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Conflict, InvalidRequest, NotFound

LOG = "version bigint, key string, digest string, n_rows bigint"


class VersionedTable:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _there(self, name: str) -> bool:
        return self._fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}"))

    def log(self) -> DataFrame:
        """Commits so far; empty before the first."""
        return self.spark.read.schema(LOG).json(f"{self.folder}/log") if self._there("log") else self.spark.createDataFrame([], LOG)

    def version(self) -> int:
        return self.log().agg(F.max("version")).first()[0] or 0

    def read(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        if v <= 0 or not self._there(f"v={v}/_SUCCESS"):
            raise NotFound("ENTITY_NOT_FOUND", f"version {v}")
        return self.spark.read.parquet(f"{self.folder}/v={v}")

    def commit(self, state: DataFrame, key: str, request: object, expected: int | None = None) -> int:
        """Write state as the next version and return its number. request identifies the content for the key."""
        if not key or len(key.encode()) > 512:
            raise InvalidRequest("IDEMPOTENCY_KEY_REQUIRED", "1 to 512 bytes")
        digest = hashlib.sha256(json.dumps(request, sort_keys=True, default=str).encode()).hexdigest()
        before = self.log().filter(F.col("key") == key).first()
        if before:
            if before["digest"] != digest:
                raise Conflict("IDEMPOTENCY_KEY_CONFLICT", key)
            return before["version"]
        now = self.version()
        if expected is not None and expected != now:
            raise Conflict("PRECONDITION_FAILED", f"version {now}, not {expected}")
        state.write.mode("overwrite").parquet(f"{self.folder}/v={now + 1}")
        n = self.spark.read.parquet(f"{self.folder}/v={now + 1}").count()
        self.spark.createDataFrame([(now + 1, key, digest, n)], LOG).coalesce(1).write.mode("append").json(f"{self.folder}/log")
        return now + 1


def spool_pages(result: DataFrame, folder: str, order: list[str], size: int) -> int:
    """Write an ordered result as numbered pages (column page) and return their number.

    Rows are range-sorted; each range learns its first row number from the counts of the ranges before it, so no task
    sees all rows. A page is then one partition folder, and reading it reads only that.
    """
    spark = result.sparkSession
    ranged = result.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id())
    ranged.write.parquet(f"{folder}/sorted")
    kept = spark.read.parquet(f"{folder}/sorted")
    starts = kept.groupBy("__part").agg(F.count("*").alias("n"), F.min("__row").alias("first")).collect()  # one row per range
    at, rows = 0, []
    for r in sorted(starts, key=lambda r: r["__part"]):
        rows.append((r["__part"], at - r["first"]))
        at += r["n"]
    shift = spark.createDataFrame(rows, "__part int, shift bigint")
    paged = kept.join(F.broadcast(shift), "__part").withColumn("position", F.col("__row") + F.col("shift"))
    paged.withColumn("page", F.expr(f"position div {size}")).drop("__part", "__row", "shift").write.partitionBy("page").parquet(f"{folder}/pages")
    return -(-at // size)


def read_page(spark: SparkSession, folder: str, page: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/pages").filter(F.col("page") == page).drop("page")
