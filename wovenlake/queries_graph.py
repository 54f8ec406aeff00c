"""Queries of the graph algorithms over a graph of parts: an edge leads from a part to the next line's part of an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import graph_algorithms as graph
from .registry import Registry
from .sources.readers import table
from .sources.scratch import written

query = Registry()

SOURCE, TARGET = 7, 11
#: Steps after which the SQL of paths ends; the queries themselves go on until nothing changes.
SQL_STEPS = 64
_EDGES = """edges AS (SELECT src, dst, min(weight) AS weight FROM (SELECT l_partkey AS src,
    lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst, l_quantity AS weight, l_returnflag AS label FROM lineitem)
    WHERE label = 'R' AND src <> dst GROUP BY 1, 2)"""


def part_edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, weight) of all edges labelled R; the window runs inside single orders."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    e = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"), F.col("l_quantity").alias("weight"), F.col("l_returnflag").alias("label")
    )
    real = (F.col("label") == "R") & (F.col("src") != F.col("dst"))
    return written(e.filter(real).groupBy("src", "dst").agg(F.min("weight").alias("weight")), "edges")


@query(f"WITH {_EDGES} SELECT * FROM edges")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return part_edges(spark, d)


@query(f"WITH {_EDGES} SELECT vertex, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS vertex, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY 1")
def graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degree_checked(part_edges(spark, d))


_BFS = f"""WITH RECURSIVE {_EDGES}, walk AS (SELECT {SOURCE}::BIGINT AS vertex, 0 AS distance UNION SELECT dst, distance + 1 FROM walk JOIN edges ON src = vertex WHERE distance < {SQL_STEPS}),
    dist AS (SELECT vertex, min(distance) AS distance FROM walk GROUP BY 1)"""


@query(f"""{_BFS} SELECT vertex, distance, coalesce((SELECT min(e.src) FROM edges e JOIN dist x ON x.vertex = e.src WHERE e.dst = d.vertex AND x.distance = d.distance - 1), -1) AS parent FROM dist d""")
def graph_distances(spark: SparkSession, d: str) -> DataFrame:
    return graph.reachable(part_edges(spark, d), SOURCE).fillna(-1, ["parent"])


@query(f"""{_BFS}, up AS (SELECT vertex, distance, (SELECT min(e.src) FROM edges e JOIN dist x ON x.vertex = e.src WHERE e.dst = d.vertex AND x.distance = d.distance - 1) AS parent FROM dist d),
    path AS (SELECT vertex, distance, parent FROM up WHERE vertex = {TARGET} UNION ALL SELECT up.vertex, up.distance, up.parent FROM path JOIN up ON up.vertex = path.parent)
    SELECT distance AS position, vertex, distance::DOUBLE AS distance FROM path""")
def shortest_path(spark: SparkSession, d: str) -> DataFrame:
    return graph.shortest_path(part_edges(spark, d), SOURCE, TARGET)


@query(f"""WITH RECURSIVE {_EDGES}, walk AS (SELECT {SOURCE}::BIGINT AS vertex, 0.0::DOUBLE AS distance, 0 AS k
    UNION ALL SELECT dst, min(distance + weight), k + 1 FROM walk JOIN edges ON src = vertex WHERE k < {SQL_STEPS} GROUP BY dst, k)
    SELECT vertex, min(distance) AS distance FROM walk GROUP BY 1""")
def weighted_distances(spark: SparkSession, d: str) -> DataFrame:
    return graph.weighted_distances(part_edges(spark, d), SOURCE).select("vertex", "distance")


@query(f"""WITH RECURSIVE {_EDGES}, walk AS (SELECT {SOURCE}::BIGINT AS vertex, 0.0::DOUBLE AS distance, 0 AS k
    UNION ALL SELECT dst, min(distance + weight), k + 1 FROM walk JOIN edges ON src = vertex WHERE k < {SQL_STEPS} GROUP BY dst, k)
    SELECT min(distance) AS total_weight FROM walk WHERE vertex = {TARGET}""")
def weighted_path(spark: SparkSession, d: str) -> DataFrame:
    return graph.weighted_path(part_edges(spark, d), SOURCE, TARGET).agg(F.max("distance").alias("total_weight"))


@query(f"""{_BFS}, up AS (SELECT vertex, distance, (SELECT min(e.src) FROM edges e JOIN dist x ON x.vertex = e.src WHERE e.dst = d.vertex AND x.distance = d.distance - 1) AS parent FROM dist d),
    path AS (SELECT vertex, distance, parent FROM up WHERE vertex = {TARGET} UNION ALL SELECT up.vertex, up.distance, up.parent FROM path JOIN up ON up.vertex = path.parent)
    SELECT distance AS position, vertex FROM path WHERE distance BETWEEN 1 AND 2""")
def path_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of a path in pages of two vertices that overlap by one."""
    return graph.shortest_path(part_edges(spark, d), SOURCE, TARGET).filter("position between 1 and 2").select("position", "vertex")


def _pagerank_sql(rounds: int, personal: int | None) -> str:
    jump = "1.0 / n" if personal is None else f"CASE WHEN v.vertex = {personal} THEN 1.0 ELSE 0.0 END"
    parts = [f"WITH {_EDGES}, deg AS (SELECT src, count(*) AS out FROM edges GROUP BY 1), vs AS (SELECT src AS vertex FROM edges UNION SELECT dst FROM edges), v AS (SELECT vertex, out, (SELECT count(*) FROM vs) AS n FROM vs LEFT JOIN deg ON src = vertex)"]
    parts.append(f"r0 AS MATERIALIZED (SELECT v.vertex, ({jump})::DOUBLE AS score FROM v)")
    for k in range(rounds):
        parts.append(f"""r{k + 1} AS MATERIALIZED (SELECT v.vertex, 0.15 * ({jump}) + 0.85 * (coalesce(got, 0) + coalesce((SELECT sum(score) FROM r{k} JOIN v USING (vertex) WHERE out IS NULL), 0) * ({jump})) AS score
            FROM v LEFT JOIN (SELECT dst, sum(score / out) AS got FROM edges JOIN r{k} ON src = vertex JOIN deg USING (src) GROUP BY 1) ON dst = v.vertex)""")
    return ", ".join(parts) + f" SELECT vertex, round(score, 9) AS score FROM r{rounds}"


@query(_pagerank_sql(8, None))
def pagerank(spark: SparkSession, d: str) -> DataFrame:
    return graph.pagerank(part_edges(spark, d), most_iterations=8).withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "vertex")


@query(_pagerank_sql(8, SOURCE))
def pagerank_personal(spark: SparkSession, d: str) -> DataFrame:
    return graph.pagerank(part_edges(spark, d), most_iterations=8, personal=SOURCE).withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "vertex")


def _community_sql(rounds: int) -> str:
    parts = [f"WITH {_EDGES}, nb AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), c0 AS (SELECT DISTINCT a AS vertex, a AS community FROM nb)"]
    for k in range(rounds):
        parts.append(f"""c{k + 1} AS MATERIALIZED (SELECT a AS vertex, community FROM (SELECT a, community, row_number() OVER (PARTITION BY a ORDER BY count(*) DESC, community) AS r
            FROM nb JOIN c{k} ON b = vertex GROUP BY a, community) WHERE r = 1)""")
    return ", ".join(parts)


@query(_community_sql(5) + " SELECT vertex, community FROM c5")
def community(spark: SparkSession, d: str) -> DataFrame:
    return graph.communities(part_edges(spark, d), 5)


@query(_community_sql(5) + """, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges), j AS (SELECT x.community AS ca, y.community AS cb FROM u JOIN c5 x ON x.vertex = a JOIN c5 y ON y.vertex = b),
    g AS (SELECT c, count(*) AS degree FROM (SELECT ca AS c FROM j UNION ALL SELECT cb FROM j) GROUP BY 1), i AS (SELECT ca AS c, count(*) AS w FROM j WHERE ca = cb GROUP BY 1)
    SELECT round(sum(coalesce(w, 0) / m - (degree / (2.0 * m)) ** 2), 9) AS modularity FROM g LEFT JOIN i USING (c), (SELECT count(*) AS m FROM u)""")
def community_modularity(spark: SparkSession, d: str) -> DataFrame:
    e = part_edges(spark, d)
    return graph.modularity(e, graph.communities(e, 5)).select(F.round("modularity", 9).alias("modularity"))


@query(f"""WITH {_EDGES}, p2 AS (SELECT a.src AS s, a.dst AS x FROM edges a WHERE a.dst > a.src), p3 AS (SELECT s, x, e.dst AS y FROM p2 JOIN edges e ON e.src = x WHERE e.dst > s AND e.dst <> x)
    SELECT 2 AS length, array_to_string([s, x, s], '-') AS cycle FROM p2 JOIN edges e ON e.src = x AND e.dst = s
    UNION ALL SELECT 3, array_to_string([s, x, y, s], '-') FROM p3 JOIN edges e ON e.src = y AND e.dst = s""")
def cycles(spark: SparkSession, d: str) -> DataFrame:
    return graph.cycles(part_edges(spark, d), 3).select("length", F.array_join("cycle", "-").alias("cycle"))


@query(f"""WITH RECURSIVE {_EDGES}, reach AS (SELECT src AS a, dst AS b FROM edges UNION SELECT a, dst FROM reach JOIN edges ON src = b),
    v AS (SELECT src AS vertex FROM edges UNION SELECT dst FROM edges)
    SELECT vertex, coalesce(least(vertex, (SELECT min(r.b) FROM reach r JOIN reach q ON q.a = r.b AND q.b = r.a WHERE r.a = vertex)), vertex) AS component FROM v""")
def scc(spark: SparkSession, d: str) -> DataFrame:
    return graph.components_strong(part_edges(spark, d))


@query(f"""WITH RECURSIVE {_EDGES}, reach AS (SELECT src AS a, dst AS b FROM edges UNION SELECT a, dst FROM reach JOIN edges ON src = b),
    looped AS (SELECT a FROM reach WHERE a = b), stuck AS (SELECT a AS vertex FROM looped UNION SELECT b FROM reach JOIN looped USING (a)),
    free AS (SELECT vertex FROM (SELECT src AS vertex FROM edges UNION SELECT dst FROM edges) ANTI JOIN stuck USING (vertex)),
    walk AS (SELECT vertex, 0 AS level FROM free UNION SELECT dst, level + 1 FROM walk JOIN edges ON src = walk.vertex JOIN free ON dst = free.vertex)
    SELECT vertex, max(level) AS level, FALSE AS cyclic FROM walk GROUP BY 1 UNION ALL SELECT vertex, NULL::INTEGER, TRUE FROM stuck""")
def toposort(spark: SparkSession, d: str) -> DataFrame:
    """Levels of the parts that no cycle leads to; all others are cyclic."""
    return graph.topological_levels(part_edges(spark, d))


@query(f"WITH {_EDGES} SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight, dst) AS k FROM edges) WHERE k <= 2")
def graph_first_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.first_per_vertex(part_edges(spark, d), 2)


QUERIES, ORACLES = query.queries, query.oracles
