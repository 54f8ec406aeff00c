"""Relational operators that need more than a DataFrame method: checks, paging and provenance."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidRequest


def limited(df: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """LIMIT and OFFSET; negative ones are an error of the request."""
    if (limit is not None and limit < 0) or offset < 0:
        raise InvalidRequest("SOLUTION_MODIFIER_MUST_BE_NON_NEGATIVE")
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)


def after_key(keys: Sequence[tuple[str, bool]], last: Sequence[object]) -> Column:
    """Rows behind ``last`` in the order of keys (column, ascending): a filter that reaches the scan."""
    out, equal = F.lit(False), F.lit(True)
    for (name, ascending), value in zip(keys, last, strict=True):
        c, v = F.col(name), F.lit(value)
        out = out | (equal & ((c > v) if ascending else (c < v)))
        equal = equal & (c == v)
    return out


def page(df: DataFrame, keys: Sequence[tuple[str, bool]], size: int, last: Sequence[object] | None = None) -> DataFrame:
    """One page in the order of keys, which must be unique together, and one lookahead row to tell if more follow."""
    if size <= 0:
        raise InvalidRequest("INVALID_PAGE_LIMIT", "a page has at least one row")
    rows = df if last is None else df.filter(after_key(keys, last))
    return rows.orderBy(*[F.col(k).asc() if up else F.col(k).desc() for k, up in keys]).limit(size + 1)


def sorted_columns(df: DataFrame) -> DataFrame:
    return df.select(*sorted(df.columns))


def check_numeric(df: DataFrame, columns: Sequence[str]) -> None:
    """Typed failure at analysis, where the engine would fail only at run time."""
    for c in columns:
        if not isinstance(df.schema[c].dataType, T.NumericType):
            raise InvalidRequest("COMPOSITION_AGGREGATE_FAILED", f"Aggregate operand is not numeric: {c}")


def union_members(members: dict[str, DataFrame], base: str = "base_id") -> DataFrame:
    """All rows of all Bases with their Base; columns must match exactly."""
    shapes = {tuple((f.name, f.dataType) for f in d.schema.fields) for d in members.values()}
    if len(shapes) != 1:
        raise InvalidRequest("COMPOSITION_PLAN_UNSUPPORTED", "members differ in their columns")
    return reduce(DataFrame.unionByName, [d.withColumn(base, F.lit(k)) for k, d in sorted(members.items())])


def distinct_with_contributors(df: DataFrame, base: str = "base_id") -> DataFrame:
    """Equal rows of several Bases merge; ``origins`` lists the Bases, ``derived`` tells if there are several.

    The list holds Base names, of which there are few, however many rows merge.
    """
    merged = df.groupBy(*[c for c in df.columns if c != base]).agg(F.array_sort(F.collect_set(base)).alias("origins"))
    return merged.withColumn("derived", F.size("origins") > 1)
