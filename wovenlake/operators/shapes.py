"""Shape validation: each constraint is one DataFrame of issues (focus, path, code, value, severity, shape)."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidRequest
from ..functions import terms
from . import reasoning

ISSUE = ("focus", "path", "code", "value", "severity", "shape")


@dataclass(frozen=True)
class Shape:
    """One property shape. Targets add up; constraints that are None aren't checked."""

    name: str
    path: str
    target_class: str | None = None
    target_nodes: tuple[str, ...] = ()
    subjects_of: str | None = None
    objects_of: str | None = None
    min_count: int | None = None
    max_count: int | None = None
    class_: str | None = None
    datatype: str | None = None
    node_kind: str | None = None
    pattern: str | None = None
    allowed: tuple[str, ...] | None = None
    min_inclusive: float | None = None
    max_inclusive: float | None = None
    severity: str = "violation"
    sparql: str | None = field(default=None)


def focus_nodes(triples: DataFrame, shape: Shape, only: DataFrame | None = None) -> DataFrame:
    """(focus): the shape's targets, each once; ``only`` (focus) restricts them, and an empty one leaves none."""
    spark = triples.sparkSession
    parts = [spark.createDataFrame([(n,) for n in shape.target_nodes], "focus string")]
    if shape.target_class:
        parts.append(triples.filter((F.col("p") == terms.TYPE) & (F.col("o") == shape.target_class)).select(F.col("s").alias("focus")))
    if shape.subjects_of:
        parts.append(triples.filter(F.col("p") == shape.subjects_of).select(F.col("s").alias("focus")))
    if shape.objects_of:
        parts.append(triples.filter(F.col("p") == shape.objects_of).select(F.col("o").alias("focus")))
    out = reduce(DataFrame.unionByName, parts).distinct()
    return out if only is None else out.join(only.select("focus").distinct(), "focus", "left_semi")


def _component(name: str) -> str:
    return f"sh:{name}ConstraintComponent"


def issues(triples: DataFrame, shape: Shape, only: DataFrame | None = None) -> DataFrame:
    if shape.sparql is not None:
        raise InvalidRequest("SHACL_FEATURE_UNSUPPORTED", "sh:sparql")
    focus = focus_nodes(triples, shape, only)
    values = focus.join(triples.filter(F.col("p") == shape.path).select(F.col("s").alias("focus"), F.col("o").alias("value")).distinct(), "focus")

    def found(rows: DataFrame, code: str, value: Column) -> DataFrame:
        return rows.select("focus", F.lit(shape.path).alias("path"), F.lit(_component(code)).alias("code"), value.cast("string").alias("value"), F.lit(shape.severity).alias("severity"), F.lit(shape.name).alias("shape"))

    out = []
    none = F.lit(None)
    if shape.min_count is not None or shape.max_count is not None:
        counts = focus.join(values.groupBy("focus").agg(F.count("*").alias("n")), "focus", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        if shape.min_count is not None:
            out.append(found(counts.filter(F.col("n") < shape.min_count), "MinCount", none))
        if shape.max_count is not None:
            out.append(found(counts.filter(F.col("n") > shape.max_count), "MaxCount", none))
    if shape.class_ is not None:
        members = triples.filter((F.col("p") == terms.TYPE) & (F.col("o") == shape.class_)).select(F.col("s").alias("value")).distinct()
        out.append(found(values.join(members, "value", "left_anti"), "Class", F.col("value")))
    v = F.col("value")
    failing: list[tuple[str, Column]] = []
    if shape.datatype is not None:
        failing.append(("Datatype", ~F.coalesce(terms.datatype(v) == shape.datatype, F.lit(False))))
    if shape.node_kind is not None:
        kinds = {"iri": terms.is_iri(v), "blankNode": terms.is_blank(v), "literal": terms.is_literal(v)}
        failing.append(("NodeKind", ~kinds[shape.node_kind]))
    if shape.pattern is not None:
        failing.append(("Pattern", ~F.coalesce(terms.regex(v, shape.pattern), F.lit(False))))
    if shape.allowed is not None:
        failing.append(("In", ~v.isin(*shape.allowed)))
    if shape.min_inclusive is not None:
        failing.append(("MinInclusive", ~F.coalesce(terms.number(v) >= shape.min_inclusive, F.lit(False))))
    if shape.max_inclusive is not None:
        failing.append(("MaxInclusive", ~F.coalesce(terms.number(v) <= shape.max_inclusive, F.lit(False))))
    out += [found(values.filter(bad), code, v) for code, bad in failing]
    if not out:
        return found(focus.filter("false"), "None", none)
    return reduce(DataFrame.unionByName, out)


def validate(triples: DataFrame, shapes: list[Shape], only: DataFrame | None = None, entailment: str = "none") -> DataFrame:
    """Issues of all shapes; entailment 'rdfs' or 'owl' first adds what the rules infer."""
    data = triples.select("s", "p", "o")
    if entailment != "none":
        owl = entailment == "owl"
        data = data.unionByName(reasoning.closure(data, reasoning.OWL_RULES if owl else reasoning.RDFS_RULES, transitive=owl))
    return reduce(DataFrame.unionByName, [issues(data, s, only) for s in shapes]).select(*ISSUE)
