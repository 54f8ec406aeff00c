"""Rule closures over triples (s, p, o): RDFS, a set of OWL 2 RL rules, hierarchies and schema checks.

Closures are semi-naive: each round joins the rules with the triples found in the round before and drops known ones by
an anti join. Schema triples are few, but they aren't collected; Spark broadcasts them where their size allows.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Conflict, ResourceLimit
from ..functions.terms import DOMAIN, OWL, RANGE, SUBCLASS, SUBPROPERTY, TYPE
from ..sources.scratch import written

INVERSE, EQUIVALENT_CLASS, EQUIVALENT_PROPERTY, SAME = (f"<{OWL}{x}>" for x in ("inverseOf", "equivalentClass", "equivalentProperty", "sameAs"))
TRANSITIVE, SYMMETRIC = f"<{OWL}TransitiveProperty>", f"<{OWL}SymmetricProperty>"

# fixed values: RDFS rules as (first triple, second triple, conclusion); variables start with '?'
RDFS_RULES = (
    (("?x", TYPE, "?c"), ("?c", SUBCLASS, "?d"), ("?x", TYPE, "?d")),
    (("?a", SUBCLASS, "?b"), ("?b", SUBCLASS, "?c"), ("?a", SUBCLASS, "?c")),
    (("?x", "?p", "?y"), ("?p", SUBPROPERTY, "?q"), ("?x", "?q", "?y")),
    (("?p", SUBPROPERTY, "?q"), ("?q", SUBPROPERTY, "?r"), ("?p", SUBPROPERTY, "?r")),
    (("?x", "?p", "?y"), ("?p", DOMAIN, "?c"), ("?x", TYPE, "?c")),
    (("?x", "?p", "?y"), ("?p", RANGE, "?c"), ("?y", TYPE, "?c")),
    (("?p", DOMAIN, "?c"), ("?c", SUBCLASS, "?d"), ("?p", DOMAIN, "?d")),
    (("?p", RANGE, "?c"), ("?c", SUBCLASS, "?d"), ("?p", RANGE, "?d")),
    (("?q", DOMAIN, "?c"), ("?p", SUBPROPERTY, "?q"), ("?p", DOMAIN, "?c")),
    (("?q", RANGE, "?c"), ("?p", SUBPROPERTY, "?q"), ("?p", RANGE, "?c")),
)
# fixed values: OWL 2 RL rules with one or two premises
OWL_RULES = (
    *RDFS_RULES,
    (("?x", "?p", "?y"), ("?p", INVERSE, "?q"), ("?y", "?q", "?x")),
    (("?x", "?q", "?y"), ("?p", INVERSE, "?q"), ("?y", "?p", "?x")),
    (("?x", "?p", "?y"), ("?p", TYPE, SYMMETRIC), ("?y", "?p", "?x")),
    (("?a", EQUIVALENT_CLASS, "?b"), None, ("?a", SUBCLASS, "?b")),
    (("?a", EQUIVALENT_CLASS, "?b"), None, ("?b", SUBCLASS, "?a")),
    (("?a", EQUIVALENT_PROPERTY, "?b"), None, ("?a", SUBPROPERTY, "?b")),
    (("?a", EQUIVALENT_PROPERTY, "?b"), None, ("?b", SUBPROPERTY, "?a")),
    (("?x", SAME, "?y"), None, ("?y", SAME, "?x")),
    (("?x", SAME, "?y"), ("?y", SAME, "?z"), ("?x", SAME, "?z")),
    (("?x", SAME, "?y"), ("?x", "?p", "?o"), ("?y", "?p", "?o")),
    (("?y", SAME, "?z"), ("?x", "?p", "?y"), ("?x", "?p", "?z")),
)


def _bind(triples: DataFrame, pattern: tuple[str, str, str], mark: str) -> DataFrame:
    rows, names = triples, {}
    for c, x in zip("spo", pattern, strict=True):
        if x.startswith("?"):
            names[x] = c
        else:
            rows = rows.filter(F.col(c) == x)
    return rows.select(*[F.col(c).alias(mark + v[1:]) for v, c in names.items()])


def _conclude(left: DataFrame, right: DataFrame | None, rule) -> DataFrame:
    first, second, then = rule
    a = _bind(left, first, "a_")
    if second is None:
        rows = a
    else:
        b = _bind(right, second, "b_")
        shared = [c[2:] for c in a.columns if "b_" + c[2:] in b.columns]
        rows = a.join(b, [F.col("a_" + v) == F.col("b_" + v) for v in shared])
    pick = lambda x: F.lit(x) if not x.startswith("?") else F.col(("a_" if "a_" + x[1:] in rows.columns else "b_") + x[1:])
    return rows.select(*[pick(x).alias(c) for c, x in zip("spo", then, strict=True)])


def transitive_pairs(triples: DataFrame) -> DataFrame:
    """x p y, y p z for transitive p."""
    p = triples.filter((F.col("p") == TYPE) & (F.col("o") == TRANSITIVE)).select(F.col("s").alias("p")).distinct()
    return triples.join(p, "p", "left_semi")


def closure(triples: DataFrame, rules: Sequence = RDFS_RULES, most_rounds: int = 64, transitive: bool = False) -> DataFrame:
    """All (s, p, o) that the rules infer beyond the given ones. A literal never becomes a subject."""
    known = delta = written(triples.select("s", "p", "o").distinct(), "closure")
    start = known
    for _ in range(most_rounds):
        found = []
        for rule in rules:
            found.append(_conclude(delta, known, rule))
            if rule[1] is not None:
                found.append(_conclude(known, delta, rule))
        if transitive:
            step = transitive_pairs(known)
            fresh = delta.join(step.select("p").distinct(), "p", "left_semi")
            for one, two in ((fresh, step), (step, fresh)):
                found.append(one.alias("x").join(two.alias("y"), (F.col("x.o") == F.col("y.s")) & (F.col("x.p") == F.col("y.p"))).select("x.s", "x.p", "y.o"))
        new = reduce(DataFrame.unionByName, found).filter(~F.col("s").startswith('"')).distinct().join(known, ["s", "p", "o"], "left_anti")
        delta = written(new, "closure")
        if delta.isEmpty():
            return known.join(start, ["s", "p", "o"], "left_anti")
        known = written(known.unionByName(delta), "closure")
    raise ResourceLimit("ONTOLOGY_WORK_LIMIT", f"no fixed point within {most_rounds} rounds")


def hierarchy(triples: DataFrame, root: str, predicate: str = SUBCLASS, ancestors: bool = True, most_depth: int | None = None) -> DataFrame:
    """(iri, depth) of all ancestors or descendants over direct links; the first depth wins. most_depth asks for those
    up to that depth only; without it all are found."""
    up, down = ("s", "o") if ancestors else ("o", "s")
    step = triples.filter((F.col("p") == predicate) & (F.col("s") != F.col("o"))).select(F.col(up).alias("at"), F.col(down).alias("next")).distinct()
    level = written(step.filter(F.col("at") == root).select(F.col("next").alias("iri"), F.lit(1).alias("depth")).distinct(), "hierarchy")
    seen = level
    for k in itertools.count(2) if most_depth is None else range(2, most_depth + 1):
        new = level.join(step, F.col("iri") == F.col("at")).select(F.col("next").alias("iri")).distinct().filter(F.col("iri") != root)
        level = written(new.join(seen, "iri", "left_anti").withColumn("depth", F.lit(k)), "hierarchy")
        if level.isEmpty():
            break
        seen = written(seen.unionByName(level), "hierarchy")
    return seen.filter(F.col("iri") != root)


def import_closure(imports: DataFrame, documents: DataFrame, root: str) -> DataFrame:
    """(iri, revision, depth) of a document and all that it imports; a missing document is a conflict."""
    found = hierarchy(imports.select(F.col("document").alias("s"), F.lit("imports").alias("p"), F.col("imported").alias("o")), root, "imports")
    every = found.unionByName(imports.sparkSession.createDataFrame([(root, 0)], "iri string, depth int"))
    j = every.join(documents, "iri", "left")
    if not j.filter("revision is null").isEmpty():
        raise Conflict("ONTOLOGY_IMPORT_MISSING")
    return j.select("iri", "revision", "depth")


def undeclared(triples: DataFrame) -> DataFrame:
    """(code, message): classes and properties in use without a declaration, and terms declared both as a class and as
    a property."""
    declared = triples.filter(F.col("p") == TYPE).select(F.col("s").alias("iri"), F.col("o").alias("kind"))
    classes = triples.filter(F.col("p") == SUBCLASS).select(F.explode(F.array("s", "o")).alias("iri")).unionByName(triples.filter(F.col("p").isin(DOMAIN, RANGE)).select(F.col("o").alias("iri"))).distinct()
    properties = triples.filter(F.col("p") == SUBPROPERTY).select(F.explode(F.array("s", "o")).alias("iri")).unionByName(triples.filter(F.col("p").isin(DOMAIN, RANGE)).select(F.col("s").alias("iri"))).distinct()
    missing = lambda used, kinds, code: used.join(declared.filter(F.col("kind").isin(*kinds)), "iri", "left_anti").select(F.lit(code).alias("code"), F.col("iri").alias("message"))
    kinds = {"class": (f"<{OWL}Class>",), "property": (f"<{OWL}ObjectProperty>", f"<{OWL}DatatypeProperty>")}
    of = lambda k: declared.filter(F.col("kind").isin(*kinds[k])).select("iri").distinct()
    both = of("class").join(of("property"), "iri").select(F.lit("DECLARED_TWICE").alias("code"), F.col("iri").alias("message"))
    return missing(classes, kinds["class"], "UNDECLARED_CLASS").unionByName(missing(properties, kinds["property"], "UNDECLARED_PROPERTY")).unionByName(both)


def project_entities(rows: DataFrame, individual_base: str, class_iri: str, id_col: str, properties: dict[str, str], graph: str | None = None) -> DataFrame:
    """Quads of entity rows: a type quad each and one quad per property with a value."""
    who = F.concat(F.lit(f"<{individual_base}"), F.col(id_col).cast("string"), F.lit(">"))
    facts = [F.struct(F.lit(TYPE).alias("p"), F.lit(class_iri).alias("o"))]
    facts += [F.struct(F.lit(p).alias("p"), F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"')).alias("o")) for c, p in properties.items()]
    return rows.select(who.alias("s"), F.explode(F.array(*facts)).alias("x")).select("s", "x.p", "x.o", F.lit(graph).cast("string").alias("g")).filter("o is not null")
