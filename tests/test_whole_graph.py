"""The graph queries on all edges, light ones and far ones too, against brute force."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wovenlake.errors import ConstraintViolation
from wovenlake.operators import graph_algorithms as graph
from wovenlake.operators import mutations

CHAIN = [7, *range(100, 117), 11]
EDGES = [*zip(CHAIN, CHAIN[1:], strict=False), (11, 7), (11, 200), (200, 201), (300, 301), (301, 302), (300, 302)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = [(o, k + 1, part, 1, 3.0, "R") for o, e in enumerate(EDGES) for k, part in enumerate(e)]
    rows += [(1000, 1, 7, 1, 50.0, "N"), (1000, 2, 11, 1, 50.0, "N")]
    d = str(tmp_path_factory.mktemp("graph"))
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_returnflag string").write.parquet(f"{d}/lineitem.parquet")
    return d


def reach(v):
    level, seen = [v], {v: 0}
    while level:
        level = list(dict.fromkeys(b for a in level for x, b in EDGES if x == a and b not in seen))
        seen |= {b: 1 + max(seen.values()) for b in level}
    return seen


def rows(spark, folder, name, *columns):
    return sorted(tuple(r) for r in entry.queries()[name](spark, folder).select(*columns).collect())


def test_whole_graph(spark, folder):
    assert rows(spark, folder, "graph_edges", "src", "dst", "weight") == sorted((a, b, 3.0) for a, b in EDGES)
    far = reach(7)
    assert max(far.values()) > 14
    assert rows(spark, folder, "graph_distances", "vertex", "distance") == sorted(far.items())
    assert [v for _, v in rows(spark, folder, "shortest_path", "position", "vertex")] == CHAIN
    assert rows(spark, folder, "weighted_distances", "vertex", "distance") == sorted((v, 3.0 * k) for v, k in far.items())


def test_whole_components_and_order(spark, folder):
    vertices = sorted({v for e in EDGES for v in e})
    to = {v: reach(v) for v in vertices}
    assert rows(spark, folder, "scc", "vertex", "component") == [(v, min(u for u in to[v] if v in to[u])) for v in vertices]
    levels = {300: 0, 301: 1, 302: 2}
    got = {r[0]: r[1:] for r in map(tuple, entry.queries()["toposort"](spark, folder).select("vertex", "level", "cyclic").collect())}
    assert got == {v: (levels.get(v), v not in levels) for v in vertices}


def test_whole_communities(spark, folder):
    near = {v: {b for a, b in EDGES if a == v} | {a for a, b in EDGES if b == v} for e in EDGES for v in e}
    label = {v: v for v in near}
    for _ in range(5):
        votes = {v: Counter(label[u] for u in near[v]) for v in near}
        label = {v: min(c, key=lambda x: (-c[x], x)) for v, c in votes.items()}
    assert rows(spark, folder, "community", "vertex", "community") == sorted(label.items())
    m = len({frozenset(e) for e in EDGES})
    inside = Counter(label[a] for a, b in EDGES if label[a] == label[b])
    degree = Counter(label[v] for e in EDGES for v in e)
    want = sum(inside[c] / m - (degree[c] / (2 * m)) ** 2 for c in degree)
    assert rows(spark, folder, "community_modularity", "modularity")[0][0] == pytest.approx(want)


def test_caps_are_errors_not_partial_results(spark):
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(7)], "src bigint, dst bigint, weight double")
    for f in (lambda: graph.weighted_distances(chain, 0, most_rounds=3), lambda: graph.topological_levels(chain, most_rounds=3), lambda: graph.components_strong(chain, most_rounds=2)):
        with pytest.raises(ConstraintViolation):
            f().collect()
    assert graph.weighted_distances(chain, 0).count() == 8 and graph.topological_levels(chain).filter("not cyclic").count() == 8
    with pytest.raises(ConstraintViolation):
        mutations.cascade(chain.select(F.col("dst").alias("child"), F.col("src").alias("parent")), spark.range(1).select(F.col("id").alias("node")), most_rounds=3).collect()


def test_loops_broadcast_no_table_that_grows(spark, monkeypatch):
    plans, write = [], graph.written

    def written(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(graph, "written", written)
    monkeypatch.setattr(graph, "FEW_ROWS", 0)  # each level counts as large
    e = spark.createDataFrame([(a, b, 3.0) for a, b in EDGES], "src bigint, dst bigint, weight double")
    for f in (lambda: graph.weighted_distances(e, 7), lambda: graph.components_strong(e), lambda: graph.reachable(e, 7), lambda: graph.topological_levels(e)):
        plans.clear()
        assert f().count()
        assert any("SortMergeJoin" in x for x in plans) and not any("Broadcast" in x for x in plans)
