"""Sources: entity tables, other file formats and RDF documents in N-Triples or N-Quads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidRequest
from ..functions import terms


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def files(spark: SparkSession, path: str, form: str, schema: str | None = None, **options: str) -> DataFrame:
    """CSV, JSON, ORC, text or Parquet files; a given schema saves the pass that infers one."""
    reader = spark.read.format(form).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


_TERM = r'(<[^>]*>|_:[A-Za-z0-9_.-]+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)'
_LINE = rf"^\s*{_TERM}\s+{_TERM}\s+{_TERM}\s*(?:{_TERM}\s*)?\.\s*(?:#.*)?$"


def rdf_lines(spark: SparkSession, path: str, scope: str = "", graph: str | None = None, strict: bool = True) -> DataFrame:
    """Quads of N-Triples or N-Quads files, split among tasks by lines. Blank labels are made anew for ``scope``."""
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(#.*)?$"))
    if strict and not lines.filter(~F.col("value").rlike(_LINE)).isEmpty():
        raise InvalidRequest("RDF_DOCUMENT_INVALID", path)
    part = lambda i: F.regexp_extract("value", _LINE, i)
    rows = lines.filter(F.col("value").rlike(_LINE)).select(part(1).alias("s"), part(2).alias("p"), part(3).alias("o"), F.when(part(4) != "", part(4)).otherwise(F.lit(graph)).alias("g"))
    fresh = lambda c: F.when(terms.is_blank(F.col(c)), terms.blank(scope, F.col(c))).otherwise(F.col(c))
    return rows.select(fresh("s").alias("s"), "p", fresh("o").alias("o"), fresh("g").alias("g")).distinct()


def write_rdf_lines(quads: DataFrame, path: str) -> None:
    """N-Quads text, one file per task."""
    quads.select(F.concat_ws(" ", "s", "p", "o", "g", F.lit(".")).alias("value")).write.text(path)


def partitions(df: DataFrame, columns: list[str]) -> DataFrame:
    """The partition catalogue: distinct values of the partition columns and their rows."""
    return df.groupBy(*columns).agg(F.count("*").alias("n_rows"))
