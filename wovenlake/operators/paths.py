"""Property paths as DataFrame operations: every path is a table of its pairs (s, o).

Links, inverses, sequences and alternatives keep repeated pairs; the three closures give each pair once. Closures are
semi-naive: a round extends new pairs only and is written to the shared folder, until nothing new is found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written


def link(quads: DataFrame, predicate: str) -> DataFrame:
    return quads.filter(F.col("p") == predicate).select("s", "o")


def inverse(path: DataFrame) -> DataFrame:
    """^path"""
    return path.select(F.col("o").alias("s"), F.col("s").alias("o"))


def sequence(first: DataFrame, *others: DataFrame) -> DataFrame:
    """a/b/...: one row for each way through the inner nodes."""

    def then(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.withColumnRenamed("o", "via").join(b.select(F.col("s").alias("via"), "o"), "via").select("s", "o")

    return reduce(then, others, first)


def alternative(first: DataFrame, *others: DataFrame) -> DataFrame:
    """a|b|..."""
    return reduce(DataFrame.unionByName, others, first)


def nodes(quads: DataFrame) -> DataFrame:
    """(s) of all subjects and objects: where a path of no step can stand."""
    return quads.select(F.explode(F.array("s", "o")).alias("s")).distinct()


def zero_or_one(path: DataFrame, where: DataFrame) -> DataFrame:
    """path? over the nodes ``where`` (s)."""
    return where.select("s", F.col("s").alias("o")).unionByName(path.join(where.select("s").distinct(), "s", "left_semi").select("s", "o")).distinct()


def one_or_more(path: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """path+, from the nodes ``starts`` (s) only if given; ends by itself, on cycles too."""
    step = written(path.select("s", "o").distinct(), "path")
    new = known = step if starts is None else written(step.join(starts.select("s").distinct(), "s", "left_semi").select("s", "o"), "path")
    while not new.isEmpty():
        new = written(sequence(new, step).distinct().join(known, ["s", "o"], "left_anti"), "path")
        known = written(known.unionByName(new), "path")
    return known


def zero_or_more(path: DataFrame, where: DataFrame) -> DataFrame:
    """path* over the nodes ``where`` (s)."""
    return where.select("s", F.col("s").alias("o")).unionByName(one_or_more(path, where)).distinct()
