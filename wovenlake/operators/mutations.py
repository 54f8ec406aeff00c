"""Changes as set operations: the new state of a table is one join of the old state with the changes."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Conflict, ConstraintViolation, InvalidRequest
from ..sources.scratch import written
from .patterns import QUAD


def apply_changes(base: DataFrame, changes: DataFrame, key: str, action: str = "action") -> DataFrame:
    """base with changes (all columns of base and action: insert, update, upsert or delete), one change a key."""
    if not changes.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        raise InvalidRequest("DUPLICATE_MUTATION")
    c = changes.select(*[F.col(x).alias(f"__n_{x}") for x in base.columns], F.col(action).alias("__a"))
    j = base.withColumn("__old", F.lit(True)).join(c, F.col(key) == F.col(f"__n_{key}"), "full")
    bad = j.agg(F.count_if((F.col("__a") == "insert") & F.col("__old").isNotNull()).alias("there"), F.count_if(F.col("__a").isin("update", "delete") & F.col("__old").isNull()).alias("missing")).first()
    if bad["there"]:
        raise Conflict("ENTITY_ALREADY_EXISTS")
    if bad["missing"]:
        raise Conflict("ENTITY_NOT_FOUND")
    new = F.col("__a").isNotNull()
    return j.filter(~F.coalesce(F.col("__a") == "delete", F.lit(False))).select(*[F.when(new, F.col(f"__n_{x}")).otherwise(F.col(x)).alias(x) for x in base.columns])


def update_where(base: DataFrame, condition: Column, assignments: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(condition, F.lit(False))
    return base.select(*[F.when(hit, assignments[c]).otherwise(F.col(c)).alias(c) if c in assignments else F.col(c) for c in base.columns])


def delete_where(base: DataFrame, condition: Column) -> DataFrame:
    return base.filter(~F.coalesce(condition, F.lit(False)))


def same_quad(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Join of quads by identity; a null graph equals a null graph."""
    r = b.select(*[F.col(c).alias(f"__{c}") for c in QUAD])
    return a.join(r, (F.col("s") == F.col("__s")) & (F.col("p") == F.col("__p")) & (F.col("o") == F.col("__o")) & F.col("g").eqNullSafe(F.col("__g")), how)


def modify(quads: DataFrame, delete: DataFrame | None = None, insert: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new state, deleted, inserted): deletion first, then insertion, both taken from the old state by the caller."""
    none = quads.filter("false")
    gone = same_quad(quads, delete.select(*QUAD).distinct(), "left_semi") if delete is not None else none
    left = same_quad(quads, gone, "left_anti") if delete is not None else quads
    new = same_quad(insert.select(*QUAD).distinct(), left, "left_anti") if insert is not None else none
    return left.unionByName(new), gone, new


def clear(quads: DataFrame, graph: str | None) -> DataFrame:
    return quads.filter(~F.col("g").eqNullSafe(F.lit(graph)))


def transfer(quads: DataFrame, source: str | None, target: str | None, how: str = "copy") -> DataFrame:
    """add: source's quads join target's. copy: they replace them. move: and the source is emptied."""
    if how not in ("add", "copy", "move"):
        raise InvalidRequest("INVALID_GRAPH_TRANSFER", how)
    if source == target:
        return quads
    moved = quads.filter(F.col("g").eqNullSafe(F.lit(source))).withColumn("g", F.lit(target).cast("string"))
    rest = quads if how == "add" else clear(quads, target)
    rest = clear(rest, source) if how == "move" else rest
    return rest.unionByName(moved).distinct()


def cascade(references: DataFrame, roots: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(node, depth): everything that refers to the roots (node), step by step, over references (child, parent).

    Beyond most_rounds steps it is an error: rows that should be deleted would stay.
    """
    level = seen = written(roots.select("node").distinct().withColumn("depth", F.lit(0)), "cascade")
    for k in itertools.count(1):
        if most_rounds is not None and k > most_rounds:
            raise ConstraintViolation("RELATIONSHIP_CASCADE_INCOMPLETE", f"references are deeper than {most_rounds}")
        new = references.join(level, F.col("parent") == F.col("node")).select(F.col("child").alias("node")).distinct().join(seen, "node", "left_anti")
        level = written(new.withColumn("depth", F.lit(k)), "cascade")
        if level.isEmpty():
            break
        seen = written(seen.unionByName(level), "cascade")
    return seen


def delete_with_rule(targets: DataFrame, key: str, gone: DataFrame, referrers: DataFrame, reference: str, rule: str) -> tuple[DataFrame, DataFrame]:
    """(targets, referrers) after deleting the keys of ``gone``: nullify, cascade, deny or noAction for referrers."""
    ids = gone.select(F.col(key).alias("__gone")).distinct()
    hit = referrers.join(ids, F.col(reference) == F.col("__gone"), "left")
    if rule == "deny" and not hit.filter("__gone is not null").isEmpty():
        raise ConstraintViolation("RELATIONSHIP_DELETE_DENIED")
    left = targets.join(ids, F.col(key) == F.col("__gone"), "left_anti")
    if rule == "cascade":
        return left, hit.filter("__gone is null").drop("__gone")
    if rule == "nullify":
        return left, hit.withColumn(reference, F.when(F.col("__gone").isNull(), F.col(reference))).select(*referrers.columns)
    if rule in ("deny", "noAction"):
        return left, referrers
    raise InvalidRequest("INVALID_DELETE_RULE", rule)


def dangling(referrers: DataFrame, reference: str, targets: DataFrame, key: str) -> DataFrame:
    """Rows whose reference has no target; null references are none."""
    return referrers.filter(F.col(reference).isNotNull()).join(targets.select(F.col(key).alias(reference)), reference, "left_anti")


def schema_changes(old: DataFrame, new: DataFrame, renamed: Sequence[tuple[str, str]] = ()) -> list[tuple[str, str, bool]]:
    """(change, column, compatible) of a schema step: added columns are compatible, dropped or retyped ones aren't,
    unless the type only grows wider."""
    # fixed values: type changes that keep every value
    wider = {("int", "bigint"), ("smallint", "int"), ("smallint", "bigint"), ("float", "double"), ("int", "double"), ("date", "timestamp_ntz")}
    names = dict(renamed)
    a = {names.get(f.name, f.name): f.dataType.simpleString() for f in old.schema.fields}
    b = {f.name: f.dataType.simpleString() for f in new.schema.fields}
    out = [("added", c, True) for c in b if c not in a] + [("dropped", c, False) for c in a if c not in b]
    out += [("retyped", c, (a[c], b[c]) in wider) for c in a if c in b and a[c] != b[c]]
    return sorted(out)
