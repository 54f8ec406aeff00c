"""Literal fixtures with known answers, errors, and cases without rows."""

from __future__ import annotations

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from wovenlake import errors
from wovenlake.functions import terms
from wovenlake.operators import graph_algorithms as graph
from wovenlake.operators import indexes, mutations, patterns, reasoning, relational, shapes
from wovenlake.plans import inspect
from wovenlake.sources import readers, versioned
from wovenlake.streaming import windows

CHAIN = [("A", "B", 2.0), ("B", "C", 1.0), ("C", "D", 1.0)]


def edges(spark, rows=CHAIN):
    return spark.createDataFrame(rows, "src string, dst string, weight double")


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_chain_graph(spark):
    e = edges(spark, [*CHAIN, ("A", "D", 10.0)])
    path = graph.weighted_path(e, "A", "D").orderBy("position")
    assert values(path, "vertex", "distance") == [("A", 0.0), ("B", 2.0), ("C", 3.0), ("D", 4.0)]
    assert values(graph.shortest_path(edges(spark), "A", "D").orderBy("position"), "vertex") == [("A",), ("B",), ("C",), ("D",)]
    assert graph.shortest_path(edges(spark), "D", "A").count() == 0
    assert graph.cycles(edges(spark), 4).count() == 0
    assert sorted(values(graph.components_strong(edges(spark)), "vertex", "component")) == [(x, x) for x in "ABCD"]
    assert sorted(values(graph.topological_levels(edges(spark)), "level", "vertex")) == [(i, x) for i, x in enumerate("ABCD")]
    assert graph.pagerank(edges(spark), most_iterations=3).count() == 4


def test_graph_with_cycles(spark):
    e = edges(spark, [("A", "B", 1.0), ("B", "C", 1.0), ("C", "A", 1.0), ("C", "D", 1.0), ("D", "D", 1.0)])
    assert sorted(map(tuple, (r["cycle"] for r in graph.cycles(e, 3).collect()))) == [("A", "B", "C", "A"), ("D", "D")]
    assert sorted(values(graph.components_strong(e), "vertex", "component")) == [("A", "A"), ("B", "A"), ("C", "A"), ("D", "D")]
    assert {r["vertex"] for r in graph.topological_levels(e).filter("cyclic").collect()} == set("ABCD")


def test_graph_errors_and_empty(spark):
    with pytest.raises(errors.ConstraintViolation):
        graph.weighted_distances(edges(spark, [("A", "B", float("nan"))]), "A")
    with pytest.raises(errors.InvalidRequest):
        graph.pagerank(edges(spark), damping=2.0)
    none = edges(spark, [])
    for out in (graph.pagerank(none), graph.communities(none, 1), graph.components_strong(none), graph.topological_levels(none), graph.cycles(none)):
        assert out.count() == 0


def test_paging_and_limits(spark):
    df = spark.range(100)
    assert [r["id"] for r in relational.page(df, [("id", True)], 2, [9]).collect()] == [10, 11, 12]
    with pytest.raises(errors.InvalidRequest):
        relational.limited(df, -1)
    with pytest.raises(errors.InvalidRequest):
        relational.page(df, [("id", True)], 0)
    with pytest.raises(errors.InvalidRequest):
        relational.check_numeric(spark.createDataFrame([("a",)], "s string"), ["s"])
    with pytest.raises(errors.InvalidRequest):
        relational.union_members({"a": df, "b": df.withColumn("x", F.lit(1))})


def test_distinct_contributors(spark):
    m = relational.union_members({"primary": spark.createDataFrame([(1,), (3,)], "p int"), "secondary": spark.createDataFrame([(1,), (2,)], "p int")})
    assert sorted(values(relational.distinct_with_contributors(m), "p", "origins", "derived")) == [(1, ["primary", "secondary"], True), (2, ["secondary"], False), (3, ["primary"], False)]


def test_terms(spark):
    rows = [("<urn:a>",), ('"5"^^<http://www.w3.org/2001/XMLSchema#integer>',), ('"x \\" y"@en',), ("_:b",), ('"plain"',), (None,)]
    df = spark.createDataFrame(rows, "t string")
    t = F.col("t")
    got = values(df.select(terms.lexical(t).alias("l"), terms.lang(t).alias("g"), terms.number(t).alias("n"), terms.effective_boolean(t).alias("b")), "l", "g", "n", "b")
    assert got == [("urn:a", None, None, None), ("5", "", 5.0, True), ('x " y', "en", None, True), (None, None, None, None), ("plain", "", None, True), (None, None, None, None)]


def test_patterns(spark):
    q = spark.createDataFrame([("<s1>", "<p>", "<o>", None), ("<s2>", "<p>", "<o>", None), ("<s1>", "<p>", "<o>", "<g>")], "s string, p string, o string, g string")
    d = patterns.match(patterns.default_graph(q), "?s", "<p>", "?o")
    out = patterns.construct(patterns.union(d, d), [("_:x", "<q>", "?s")], "k")
    assert out.count() == 4 and out.select("s").distinct().count() == 4
    assert patterns.basic(q, []).count() == 1
    assert patterns.match(q, "?x", "<p>", "?x").count() == 0
    with pytest.raises(errors.InvalidRequest):
        patterns.basic(q, [("?a", "<p>", "?b"), ("?c", "<p>", "?d")])


def test_reasoning_and_shapes(spark):
    rows = [("<Employee>", terms.SUBCLASS, "<Person>"), ("<manages>", terms.SUBPROPERTY, "<knows>"), ("<worksFor>", terms.DOMAIN, "<Employee>"), ("<Dave>", "<worksFor>", "<Acme>"), ("<Dave>", "<manages>", "<Bob>"), ("<Eve>", terms.TYPE, "<Person>"), ("<Eve>", "<name>", '"Eve"')]
    t = spark.createDataFrame(rows, "s string, p string, o string")
    inferred = {tuple(r) for r in reasoning.closure(t).collect()}
    assert ("<Dave>", terms.TYPE, "<Person>") in inferred and ("<Dave>", "<knows>", "<Bob>") in inferred
    named = shapes.Shape("named", "<name>", target_class="<Person>", min_count=1)
    knows = shapes.Shape("knows", "<knows>", subjects_of="<knows>", class_="<Person>")
    assert {(r["focus"], r["code"]) for r in shapes.validate(t, [named, knows], entailment="rdfs").collect()} == {("<Dave>", "sh:MinCountConstraintComponent"), ("<Dave>", "sh:ClassConstraintComponent")}
    assert shapes.validate(t, [named], only=spark.createDataFrame([], "focus string"), entailment="rdfs").count() == 0
    with pytest.raises(errors.InvalidRequest):
        shapes.issues(t, shapes.Shape("s", "<p>", sparql="SELECT"))


def test_mutations(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    change = lambda rows: spark.createDataFrame(rows, "id int, v string, action string")
    assert sorted(values(mutations.apply_changes(base, change([(1, "x", "update"), (2, None, "delete"), (3, "c", "insert")]), "id"), "id", "v")) == [(1, "x"), (3, "c")]
    with pytest.raises(errors.Conflict):
        mutations.apply_changes(base, change([(1, "x", "insert")]), "id")
    with pytest.raises(errors.Conflict):
        mutations.apply_changes(base, change([(9, "x", "update")]), "id")
    with pytest.raises(errors.InvalidRequest):
        mutations.apply_changes(base, change([(1, "x", "update"), (1, "y", "update")]), "id")
    with pytest.raises(errors.ConstraintViolation):
        mutations.delete_with_rule(base, "id", base.filter("id = 1"), spark.createDataFrame([(7, 1)], "k int, ref int"), "ref", "deny")


def test_versioned_table(spark, tmp_path):
    t = versioned.VersionedTable(spark, f"file://{tmp_path}/t")
    df = spark.createDataFrame([(1,)], "id int")
    assert t.version() == 0 and t.commit(df, "k1", {"a": 1}) == 1
    assert t.commit(df, "k1", {"a": 1}) == 1
    with pytest.raises(errors.Conflict):
        t.commit(df, "k1", {"a": 2})
    assert t.commit(df.union(df), "k2", {}) == 2
    assert t.read(1).count() == 1 and t.read().count() == 2
    with pytest.raises(errors.Conflict):
        t.commit(df, "k3", {}, expected=1)
    with pytest.raises(errors.NotFound):
        t.read(7)


def test_rdf_lines(spark, tmp_path):
    f = tmp_path / "a.nq"
    f.write_text('<urn:a> <urn:p> "x y"@en .\n# note\n_:b <urn:p> <urn:a> <urn:g> .\n\n')
    got = readers.rdf_lines(spark, f"file://{f}", "k")
    assert {(r["p"], r["o"], r["g"]) for r in got.collect()} == {("<urn:p>", '"x y"@en', None), ("<urn:p>", "<urn:a>", "<urn:g>")}
    f.write_text("not a line\n")
    with pytest.raises(errors.InvalidRequest):
        readers.rdf_lines(spark, f"file://{f}")


def test_stream(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    s = windows.event_stream(spark, f"{tmp_path}/in", events.schema.simpleString()[7:-1].replace(":", " "))
    windows.run_once(windows.window_counts(s, width="1 day"), "counts", f"{tmp_path}/cp", "complete")
    assert spark.table("counts").agg(F.sum("n")).first()[0] == events.count()


def test_plans(spark, data):
    plan = inspect.summary(indexes.key_range(spark.read.parquet(f"{data}/orders.parquet"), "o_totalprice", 1000.0).select("o_orderkey"))
    assert plan["exchanges"] == 0 and "o_totalprice" in plan["pushed"][0] and not plan["python"] and "o_comment" not in plan["read"][0]


def test_spark_errors_are_typed(spark):
    with pytest.raises(PySparkException) as e:
        spark.sql("SELECT * FROM none_such").collect()
    assert isinstance(errors.from_spark(e.value), errors.NotFound)


def test_percentiles_are_exact_where_a_sketch_is_not(spark):
    n = 100_000
    rows = spark.range(0, n, 1, 4).select(F.lit("R").alias("g"), F.when(F.pmod(F.col("id") * 7919, F.lit(n)) < n // 2 - 1, 1.0).otherwise(2.0).alias("v"))
    few = spark.createDataFrame([(None, float(v)) for v in range(1, 101)] + [(None, None), ("none", None), ("one", float("nan"))], "g string, v double")
    got = {r["g"]: r["percentiles"] for r in indexes.exact_percentiles(rows.unionByName(few), "v", ["g"], [0.5, 0.07, 1.0]).collect()}
    assert got["R"] == [2.0, 1.0, 2.0]  # one row short of the half; the sketch says 1.0
    assert got[None] == [50.0, 7.0, 100.0]
    assert got["none"] is None and all(math.isnan(x) for x in got["one"])
