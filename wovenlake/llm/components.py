"""Connected components by alternating large-star and small-star steps (DataFrame shuffles only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .shared import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "components", most_rounds: int = 100) -> DataFrame:
    """(node, root) for every end of edges (a, b), both longs: root is the smallest node reachable.

    A large star moves each node's larger neighbours to its smallest one, a small star its smaller neighbours and
    itself; the number of rounds is logarithmic in practice, and it is an error if they don't come to an end. The
    smallest neighbour comes from an aggregate with partial sums and is joined back, so Spark can split a hub. Each
    round is written to the shared folder, and the one before is deleted.
    """
    # written first: the first round reads the edges several times, and what makes them may be costly
    ordered = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, last = scratch.keep(ordered, name), None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pair = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))
        small = large.join(low, "a").select(F.explode(pair).alias("x")).select("x.a", "x.b").filter("a <> b").distinct()
        seen = Observation()
        found = small.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
        before, e = e, scratch.keep(found, name)
        scratch.drop(before)
        now = (seen.get["n"], seen.get["h"])
        if now == last:
            roots = e.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
            out = scratch.keep(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), name)
            scratch.drop(e)
            return out
        last = now
    raise RuntimeError(f"components of {name} are not final after {most_rounds} rounds")
