"""All registered queries of the engine's own operators, with their SQL, by family."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_graph, queries_index, queries_rdf, queries_relational

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _family in (queries_relational, queries_index, queries_graph, queries_rdf):
    QUERIES |= _family.QUERIES
    ORACLES |= _family.ORACLES
