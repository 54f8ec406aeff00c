"""Closures of property paths on a cyclic graph against a walk over all pairs."""

from __future__ import annotations

from wovenlake.operators import paths

EDGES = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e"), ("a", "b")]


def closure(pairs: set[tuple[str, str]]) -> set[tuple[str, str]]:
    while True:
        more = pairs | {(s, y) for s, o in pairs for x, y in pairs if o == x}
        if more == pairs:
            return pairs
        pairs = more


def test_closures_end_on_cycles(spark):
    path = spark.createDataFrame(EDGES, "s string, o string")
    pairs = lambda df: sorted(map(tuple, df.collect()))
    want = closure(set(EDGES))
    self = {(x, x) for e in EDGES for x in e}
    assert pairs(paths.one_or_more(path)) == sorted(want)
    assert pairs(paths.one_or_more(path, spark.createDataFrame([("c",)], "s string"))) == sorted(p for p in want if p[0] == "c")
    assert pairs(paths.zero_or_more(path, paths.nodes(path))) == sorted(want | self)
    assert pairs(paths.zero_or_one(path, paths.nodes(path))) == sorted(set(EDGES) | self)
    assert pairs(paths.one_or_more(path.filter("s = 'none'"))) == []
    assert pairs(paths.sequence(path, paths.inverse(path))) == sorted((s, x) for s, o in EDGES for x, y in EDGES if o == y)
