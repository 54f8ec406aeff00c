"""SPARQL graph patterns and query forms as DataFrame operations over quads (s, p, o, g).

Terms are canonical text (see functions.terms); g is null in the default graph. A solution table has one column per
variable, null where unbound. Patterns join on shared variables by equality, so Catalyst chooses and orders the joins.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import InvalidRequest, ResourceLimit
from ..functions import terms
from ..sources.scratch import written

QUAD = ("s", "p", "o", "g")


def is_variable(x: str) -> bool:
    return x.startswith("?")


def match(quads: DataFrame, s: str, p: str, o: str, g: str | None = None) -> DataFrame:
    """Solutions of one triple pattern; '?x' is a variable, anything else a term. g: None takes all given quads."""
    places = [(c, x) for c, x in zip(QUAD, (s, p, o, g), strict=True) if x is not None]
    first: dict[str, str] = {}
    rows = quads
    for c, x in places:
        if not is_variable(x):
            rows = rows.filter(F.col(c) == x)
        elif x in first:
            rows = rows.filter(F.col(c) == F.col(first[x]))
        else:
            first[x] = c
    return rows.select(*[F.col(c).alias(v[1:]) for v, c in first.items()])


def default_graph(quads: DataFrame) -> DataFrame:
    return quads.filter("g is null")


def named(quads: DataFrame, graph: str) -> DataFrame:
    """Quads for GRAPH <iri> or, for a variable, all named graphs."""
    return quads.filter("g is not null") if is_variable(graph) else quads.filter(F.col("g") == graph)


def dataset(quads: DataFrame, default: Sequence[str] = (), named_graphs: Sequence[str] = ()) -> DataFrame:
    """FROM and FROM NAMED: the default graph is the merge of the listed graphs, without repeated triples."""
    merged = quads.filter(F.col("g").isin(*default)).select("s", "p", "o").distinct().withColumn("g", F.lit(None).cast("string"))
    return merged.unionByName(quads.filter(F.col("g").isin(*named_graphs)).select(*QUAD))


def compatible_join(left: DataFrame, right: DataFrame, optional: bool = False, nullable: Sequence[str] = ()) -> DataFrame:
    """Natural join on shared variables. ``nullable`` names shared variables that may be unbound on a side: those are
    compatible with anything; the others give equality keys that Spark can hash."""
    shared = [c for c in left.columns if c in right.columns]
    r = right.select(*[F.col(c).alias(f"__r_{c}" if c in shared else c) for c in right.columns])
    on = F.lit(True)
    for c in shared:
        a, b = F.col(c), F.col(f"__r_{c}")
        on = on & (((a == b) | a.isNull() | b.isNull()) if c in nullable else (a == b))
    if not shared:
        raise InvalidRequest("QUERY_PLAN_UNSUPPORTED", "patterns without a shared variable would pair all rows")
    j = left.join(r, on, "left" if optional else "inner")
    return j.select(*[F.coalesce(c, f"__r_{c}").alias(c) if c in nullable else F.col(c) for c in left.columns], *[c for c in right.columns if c not in shared])


def basic(quads: DataFrame, patterns: Sequence[tuple[str, str, str]], graph: str | None = None) -> DataFrame:
    """A basic graph pattern: natural joins, connected patterns first; an empty one has one empty solution."""
    if not patterns:
        return quads.sparkSession.range(1).select()
    todo = [match(quads, *t, graph) for t in patterns]
    out = todo.pop(0)
    while todo:
        k = next((i for i, t in enumerate(todo) if set(t.columns) & set(out.columns)), None)
        if k is None:
            raise InvalidRequest("QUERY_PLAN_UNSUPPORTED", "disconnected triple patterns")
        out = compatible_join(out, todo.pop(k))
    return out


def union(*solutions: DataFrame) -> DataFrame:
    """Bag union; variables that a side lacks are unbound."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), solutions)


def minus(left: DataFrame, right: DataFrame) -> DataFrame:
    """MINUS on always-bound shared variables; without any, nothing is removed."""
    shared = [c for c in left.columns if c in right.columns]
    return left.join(right.select(*shared).distinct(), shared, "left_anti") if shared else left


def values(spark: SparkSession, variables: Sequence[str], rows: Sequence[Sequence[str | None]]) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"`{v.lstrip('?')}` string" for v in variables))


def keep(solutions: DataFrame, condition: Column) -> DataFrame:
    """FILTER: an error or unbound operand (null) is no solution."""
    return solutions.filter(F.coalesce(condition, F.lit(False)))


def ask(solutions: DataFrame) -> DataFrame:
    """One row (answer): is there any solution? Modifiers have to be applied before."""
    return solutions.limit(1).agg((F.count("*") > 0).alias("answer"))


def first_per_group(solutions: DataFrame, group: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """A LATERAL sub-SELECT with its own ORDER BY and LIMIT: the first rows for each outer binding."""
    w = Window.partitionBy(*group).orderBy(*order)
    return solutions.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= limit).drop("__k")


def construct(solutions: DataFrame, template: Sequence[tuple[str, str, str]], scope: str = "", graph: str | None = None) -> DataFrame:
    """Quads of a template for all solutions, each once. '_:x' in a template is a fresh blank node per solution.

    Solutions are numbered inside groups of equal ones, so duplicates get nodes of their own and the labels depend on
    scope and solution only. A triple with an unbound or misplaced term is left out, not the solution.
    """
    rows = solutions
    if any(x.startswith("_:") for t in template for x in t):
        copies = Window.partitionBy(*solutions.columns).orderBy(F.lit(0)) if solutions.columns else Window.orderBy(F.lit(0))
        rows = rows.withColumn("__copy", F.row_number().over(copies))

    def term(x: str) -> Column:
        if is_variable(x):
            return F.col(x[1:])
        if x.startswith("_:"):
            return terms.blank(scope, x, F.to_json(F.struct(*solutions.columns, "__copy"), {"ignoreNullFields": "false"}))
        return F.lit(x)

    triples = F.array(*[F.struct(*[term(x).alias(c) for c, x in zip("spo", t, strict=True)]) for t in template])
    out = rows.select(F.explode(triples).alias("t")).select("t.*").filter("s is not null and p is not null and o is not null")
    out = out.filter(~terms.is_literal(F.col("s")) & terms.is_iri(F.col("p")))
    return out.distinct().withColumn("g", F.lit(graph).cast("string"))


def describe(quads: DataFrame, solutions: DataFrame | None = None, variables: Sequence[str] = (), resources: Sequence[str] = ()) -> DataFrame:
    """Outgoing quads of the named resources and of all values of the variables."""
    spark = quads.sparkSession
    wanted = spark.createDataFrame([(r,) for r in resources], "s string")
    if solutions is not None and variables:
        wanted = wanted.unionByName(solutions.select(F.explode(F.array(*[F.col(v.lstrip("?")) for v in variables])).alias("s")).filter("s is not null"))
    return quads.join(wanted.distinct(), "s", "left_semi").select(*QUAD).distinct()


def path_closure(quads: DataFrame, predicate: str, starts: DataFrame, most_steps: int = 64) -> DataFrame:
    """predicate+ from start nodes (s): distinct pairs (s, o). Semi-naive: each step extends new pairs only."""
    step = quads.filter(F.col("p") == predicate).select(F.col("s").alias("via"), F.col("o").alias("next")).distinct()
    new = starts.select("s").distinct().join(step, F.col("s") == F.col("via")).select("s", F.col("next").alias("o")).distinct()
    new = written(new, "path")
    known = new
    for _ in range(most_steps):
        found = new.join(step, F.col("o") == F.col("via")).select("s", F.col("next").alias("o")).distinct()
        new = written(found.join(known, ["s", "o"], "left_anti"), "path")
        if new.isEmpty():
            return known
        known = written(known.unionByName(new), "path")
    raise ResourceLimit("QUERY_RESOURCE_LIMIT", f"a path is longer than {most_steps} steps")
