"""Iterative graph algorithms over edges (src, dst[, weight]) as DataFrame loops.

Each step is a join and an aggregate with partial results; its table is written to the shared folder, so plans stay
short and a lost executor costs one step. Only flags and counts come to the driver. A hub's edges are aggregated
before the shuffle and its joins can be split by Spark, as no step collects the neighbours of a vertex in one row.

Tables that grow with the graph are never broadcast, as each broadcast passes the driver and a loop makes many: they
meet in sort-merge joins. Only a level that was counted and has at most ``FEW_ROWS`` rows is broadcast to the edges.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..errors import ConstraintViolation, InvalidRequest
from ..sources.scratch import written


#: Rows that may be broadcast in one step of a loop.
FEW_ROWS = 10_000


def _apart(df: DataFrame) -> DataFrame:
    """df for a join in which neither side is broadcast."""
    return df.hint("merge")


def _level(df: DataFrame, rows: int) -> DataFrame:
    """A counted level for a join with a larger table."""
    return F.broadcast(df) if rows <= FEW_ROWS else _apart(df)


def _positive(**limits: int) -> None:
    for name, value in limits.items():
        if value <= 0:
            raise InvalidRequest("INVALID_GRAPH_REQUEST", f"{name} must be above 0")


def _rounds(most: int | None, first: int = 0) -> Iterator[int]:
    """Numbers of the rounds of a loop that ends by itself; an error, not a partial result, beyond ``most`` of them."""
    yield from itertools.count(first) if most is None else range(first, first + most)
    raise ConstraintViolation("GRAPH_RESULT_INCOMPLETE", "maximumIterations")


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("vertex")).distinct()


def reachable(edges: DataFrame, source: object, most_depth: int | None = None, target: object | None = None) -> DataFrame:
    """(vertex, distance, parent): breadth first from source; parent is the smallest of the last level. most_depth
    asks for vertices up to that distance only; without it all are found."""
    _positive(maximumDepth=1 if most_depth is None else most_depth)
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    step = written(edges.select("src", "dst").distinct(), "bfs")
    level = spark.range(1).select(F.lit(source).cast(kind).alias("vertex"), F.lit(0).alias("distance"), F.lit(None).cast(kind).alias("parent"))
    seen = level = written(level, "bfs")
    rows = 1
    for k in itertools.count(1) if most_depth is None else range(1, most_depth + 1):
        found = step.join(_level(level, rows), F.col("vertex") == F.col("src")).groupBy("dst").agg(F.min("src").alias("parent"))
        fresh = found.join(_apart(seen), F.col("dst") == F.col("vertex"), "left_anti").select(F.col("dst").alias("vertex"), F.lit(k).alias("distance"), "parent")
        level = written(fresh, "bfs")
        rows = level.count()
        if not rows:
            break
        seen = written(seen.unionByName(level), "bfs")
        if target is not None and not level.filter(F.col("vertex") == target).isEmpty():
            break
    return seen


def trace(found: DataFrame, target: object, distance: str = "distance") -> DataFrame:
    """(position, vertex, distance) of the path that ends at target, following parents; no row if it isn't there."""
    at = found.filter(F.col("vertex") == target).select("vertex", "parent", F.col(distance).cast("double").alias("distance")).collect()  # one vertex
    steps = []
    while at:
        steps.append((at[0]["vertex"], at[0]["distance"]))
        up = at[0]["parent"]
        at = [] if up is None else found.filter(F.col("vertex") == up).select("vertex", "parent", F.col(distance).cast("double").alias("distance")).collect()
    kind = found.schema["vertex"].dataType.simpleString()
    rows = [(i, v, d) for i, (v, d) in enumerate(reversed(steps))]
    return found.sparkSession.createDataFrame(rows, f"position int, vertex {kind}, distance double")


def shortest_path(edges: DataFrame, source: object, target: object, most_depth: int | None = None) -> DataFrame:
    return trace(reachable(edges, source, most_depth, target), target)


def weighted_distances(edges: DataFrame, source: object, most_rounds: int | None = None, most_weight: float | None = None) -> DataFrame:
    """(vertex, distance, parent): relaxation of the vertices that became nearer, until none does."""
    bad = edges.filter("weight is null or isnan(weight) or abs(weight) = double('infinity') or weight < 0")
    if not bad.isEmpty():
        raise ConstraintViolation("GRAPH_WEIGHT_INVALID", "weights must be finite and not negative")
    spark, kind = edges.sparkSession, edges.schema["src"].dataType.simpleString()
    step = written(edges.groupBy("src", "dst").agg(F.min("weight").alias("weight")), "relax")
    active = best = written(spark.range(1).select(F.lit(source).cast(kind).alias("vertex"), F.lit(0.0).alias("distance"), F.lit(None).cast(kind).alias("parent")), "relax")
    rows = 1
    for _ in _rounds(most_rounds):
        offer = step.join(_level(active, rows), F.col("vertex") == F.col("src")).select(F.col("dst").alias("v"), (F.col("distance") + F.col("weight")).alias("d"), F.col("src").alias("u"))
        if most_weight is not None:
            offer = offer.filter(F.col("d") <= most_weight)
        offer = offer.groupBy("v").agg(F.min(F.struct("d", "u")).alias("x")).select("v", "x.d", "x.u")
        nearer = offer.join(_apart(best), F.col("v") == F.col("vertex"), "left").filter("distance is null or d < distance").select(F.col("v").alias("vertex"), F.col("d").alias("distance"), F.col("u").alias("parent"))
        active = written(nearer, "relax")
        rows = active.count()
        if not rows:
            break
        best = written(best.join(_level(active.select("vertex"), rows), "vertex", "left_anti").unionByName(active), "relax")
    return best


def weighted_path(edges: DataFrame, source: object, target: object, most_weight: float | None = None) -> DataFrame:
    return trace(weighted_distances(edges, source, most_weight=most_weight), target)


def pagerank(edges: DataFrame, damping: float = 0.85, most_iterations: int = 20, threshold: float = 0.0, personal: object | None = None) -> DataFrame:
    """(vertex, score). Mass of vertices without out-edges goes where the random jump goes."""
    if not 0 <= damping <= 1 or not threshold >= 0:
        raise InvalidRequest("INVALID_GRAPH_REQUEST", "damping lies in [0, 1], the threshold is at least 0")
    _positive(maximumIterations=most_iterations)
    e = edges.select("src", "dst").distinct()
    out = e.groupBy("src").agg(F.count("*").alias("out"))
    links = written(e.join(_apart(out), "src"), "links")
    v = written(vertices(e).join(_apart(out), F.col("vertex") == F.col("src"), "left").select("vertex", F.col("out").isNull().alias("dangling")), "vertices")
    n = v.count()
    if not n:
        return v.select("vertex", F.lit(0.0).alias("score"))
    jump = F.lit(1.0 / n) if personal is None else F.when(F.col("vertex") == personal, 1.0).otherwise(0.0)
    rank = written(v.select("vertex", "dangling", jump.alias("score")), "rank")
    for _ in range(most_iterations):
        lost = rank.filter("dangling").agg(F.sum("score")).first()[0] or 0.0
        given = links.join(_apart(rank), F.col("src") == F.col("vertex")).groupBy("dst").agg(F.sum(F.col("score") / F.col("out")).alias("got"))
        now = (1 - damping) * jump + damping * (F.coalesce("got", F.lit(0.0)) + lost * jump)
        seen = Observation()
        new = rank.join(_apart(given), F.col("vertex") == F.col("dst"), "left").select("vertex", "dangling", now.alias("score"), F.abs(now - F.col("score")).alias("moved")).observe(seen, F.sum("moved").alias("delta"))
        rank = written(new, "rank").drop("moved")
        if seen.get["delta"] <= threshold:
            break
    return rank.select("vertex", "score")


def communities(edges: DataFrame, most_iterations: int = 10) -> DataFrame:
    """(vertex, community): synchronous label propagation over both directions; ties go to the smallest label."""
    _positive(maximumIterations=most_iterations)
    both = edges.filter("src <> dst").select(F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))).alias("x")).select("x.*").distinct()
    both = written(both, "neighbours")
    label = vertices(edges).select("vertex", F.col("vertex").alias("community"))
    for _ in range(most_iterations):
        votes = both.join(_apart(label), F.col("b") == F.col("vertex")).groupBy("a", "community").agg(F.count("*").alias("n"))
        best = votes.groupBy("a").agg(F.min(F.struct(-F.col("n"), "community")).alias("x")).select("a", F.col("x.community").alias("voted"))
        seen = Observation()
        new = label.join(_apart(best), F.col("vertex") == F.col("a"), "left").select("vertex", F.coalesce("voted", "community").alias("community"), (F.col("voted") != F.col("community")).cast("long").alias("moved")).observe(seen, F.sum("moved").alias("n"))
        label = written(new, "label").drop("moved")
        if not seen.get["n"]:
            break
    return label


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (modularity) of a partition of the undirected simple graph."""
    e = edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    la, lb = labels.select(F.col("vertex").alias("a"), F.col("community").alias("ca")), labels.select(F.col("vertex").alias("b"), F.col("community").alias("cb"))
    j = e.join(la, "a").join(lb, "b")
    inside = j.filter("ca = cb").groupBy(F.col("ca").alias("c")).agg(F.count("*").alias("within"))
    degree = j.select(F.explode(F.array("ca", "cb")).alias("c")).groupBy("c").agg(F.count("*").alias("degree"))
    total = e.agg(F.count("*").alias("m"))
    per = degree.join(inside, "c", "left").crossJoin(F.broadcast(total))  # total is one row
    return per.agg(F.sum(F.coalesce("within", F.lit(0)) / F.col("m") - F.pow(F.col("degree") / (2 * F.col("m")), F.lit(2.0))).alias("modularity"))


def cycles(edges: DataFrame, most_length: int = 4) -> DataFrame:
    """(length, cycle) for simple cycles of at most most_length edges, each once, from its smallest vertex and closed.

    A path grows only through vertices above its start, so no rotation is found twice.
    """
    _positive(maximumLength=most_length)
    e = edges.select("src", "dst").distinct()
    closed = [e.filter("src = dst").select(F.lit(1).alias("length"), F.array("src", "dst").alias("cycle"))]
    paths = e.filter("dst > src").select(F.array("src", "dst").alias("path"), F.col("src").alias("start"), F.col("dst").alias("last"))
    for k in range(2, most_length + 1):
        back = e.select(F.col("src").alias("last"), F.col("dst").alias("start"))
        closed.append(paths.join(back, ["last", "start"]).select(F.lit(k).alias("length"), F.concat("path", F.array("start")).alias("cycle")))
        if k < most_length:
            paths = paths.join(e, F.col("last") == F.col("src")).filter("dst > start and not array_contains(path, dst)").select(F.concat("path", F.array("dst")).alias("path"), "start", F.col("dst").alias("last"))
    out = closed[0]
    for c in closed[1:]:
        out = out.unionByName(c)
    return out


def _spread_minimum(edges: DataFrame, start: DataFrame, most_rounds: int | None) -> DataFrame:
    """(vertex, low): the smallest start value of any vertex from which a path leads to this one."""
    low = start
    for _ in _rounds(most_rounds):
        offer = edges.join(_apart(low), F.col("src") == F.col("vertex")).groupBy("dst").agg(F.min("low").alias("offer"))
        seen = Observation()
        new = low.join(_apart(offer), F.col("vertex") == F.col("dst"), "left").select("vertex", F.least("low", F.coalesce("offer", "low")).alias("low"), (F.col("offer") < F.col("low")).cast("long").alias("moved")).observe(seen, F.sum("moved").alias("n"))
        low = written(new, "spread").drop("moved")
        if not seen.get["n"]:
            return low


def components_strong(edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(vertex, component): strongly connected components, named by their smallest vertex.

    Colouring: each vertex takes the smallest vertex that reaches it as colour; those that reach back to their colour
    inside it are one component. The rest goes on until nothing is left; vertices that can't lie on a cycle are peeled
    off first.
    """
    todo_e = written(edges.select("src", "dst").filter("src <> dst").distinct(), "scc")
    rest = written(vertices(edges), "scc")
    done = None
    for _ in _rounds(most_rounds):
        for _ in _rounds(most_rounds):  # peel: no in-edge or no out-edge left
            live = todo_e.select(F.col("src").alias("vertex")).distinct().join(_apart(todo_e.select(F.col("dst").alias("vertex")).distinct()), "vertex")
            kept = written(rest.join(_apart(live), "vertex", "left_semi"), "scc")
            gone = rest.join(_apart(kept), "vertex", "left_anti").select("vertex", F.col("vertex").alias("component"))
            if gone.isEmpty():
                break
            done = written(gone if done is None else done.unionByName(gone), "scc")
            rest = kept
            todo_e = written(todo_e.join(_apart(rest), F.col("src") == F.col("vertex"), "left_semi").join(_apart(rest), F.col("dst") == F.col("vertex"), "left_semi"), "scc")
        if rest.isEmpty():
            break
        colour = _spread_minimum(todo_e, rest.select("vertex", F.col("vertex").alias("low")), most_rounds)
        same = todo_e.join(_apart(colour.select(F.col("vertex").alias("src"), F.col("low").alias("cs"))), "src").join(_apart(colour.select(F.col("vertex").alias("dst"), F.col("low").alias("cd"))), "dst").filter("cs = cd").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        same = written(same, "scc")
        reached = colour.select("vertex", F.when(F.col("vertex") == F.col("low"), 0).otherwise(1).alias("low"))
        back = _spread_minimum(same, reached, most_rounds).filter("low = 0").select("vertex")
        found = colour.join(_apart(back), "vertex", "left_semi").select("vertex", F.col("low").alias("component"))
        done = written(found if done is None else done.unionByName(found), "scc")
        rest = written(rest.join(_apart(done), "vertex", "left_anti"), "scc")
        todo_e = written(todo_e.join(_apart(rest), F.col("src") == F.col("vertex"), "left_semi").join(_apart(rest), F.col("dst") == F.col("vertex"), "left_semi"), "scc")
    return done if done is not None else rest.select("vertex", F.col("vertex").alias("component"))


def topological_levels(edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(vertex, level, cyclic): order by level, then vertex. Vertices behind a cycle have no level and are cyclic."""
    todo = written(edges.select("src", "dst").distinct(), "topo")
    rest = written(vertices(edges), "topo")
    done = None
    for k in _rounds(most_rounds):
        ready = written(rest.join(_apart(todo), F.col("vertex") == F.col("dst"), "left_anti").select("vertex", F.lit(k).alias("level")), "topo")
        if ready.isEmpty():
            break
        done = written(ready if done is None else done.unionByName(ready), "topo")
        rest = written(rest.join(_apart(ready), "vertex", "left_anti"), "topo")
        todo = written(todo.join(_apart(ready), F.col("src") == F.col("vertex"), "left_anti"), "topo")
    stuck = rest.select("vertex", F.lit(None).cast("int").alias("level"), F.lit(True).alias("cyclic"))
    return stuck if done is None else done.withColumn("cyclic", F.lit(False)).unionByName(stuck)


def degree_checked(edges: DataFrame) -> DataFrame:
    """(vertex, out_degree, in_degree) of every vertex."""
    both = edges.select(F.explode(F.array(F.struct(F.col("src").alias("vertex"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("vertex"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return both.groupBy("x.vertex").agg(F.sum("x.o").alias("out_degree"), F.sum("x.i").alias("in_degree"))


def first_per_vertex(edges: DataFrame, limit: int) -> DataFrame:
    """The first edges of each vertex in order of (weight, dst): an edge scan with a limit per source."""
    w = Window.partitionBy("src").orderBy("weight", "dst")
    return edges.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= limit).drop("k")
