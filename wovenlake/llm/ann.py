"""Nearest neighbours through low-dimensional stable projections, kd-trees and a chi-square stopping test.

Vectors are projected on ``dimensions`` Gaussian (2-stable) directions, so the squared projected distance of two
vectors is their squared true distance times a chi-square variable with that many degrees of freedom. The projected
space is cut into cells by a kd-tree fitted on a bounded sample; every vector is dealt to its cell once. A query first
searches its own cell. With r the projected distance to another cell's box (of all vectors in it, not of the sample)
and d the distance of the k-th best so far, a vector in that cell nearer than d has to have a chi-square value above
(r / d) squared; the query goes to the cells for which the chi-square distribution doesn't put at least ``confidence``
below that value. Only queries travel to several cells. Inside a cell a kd-tree over the projections gives leaves in
order of projected distance; their vectors are verified exactly until the same test stops the search. The best of all
cells are merged by a window whose per-task limit comes before the shuffle. A cell that holds more vectors than a
block (equal vectors, or a sample that missed them) is dealt to several blocks, and its queries go to each.

Equal vectors are stored once per block, with the smallest ids that could still appear in an answer: others of the
group lose every tie, so thousands of copies cost one entry and lose no result.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, neither as query
nor as candidate. A query finds candidates of its own dimension only. Fewer candidates than k give fewer rows. Ties go
to the smaller id. A repeated row is a candidate like others; rows with a query's own id are not, and a repeated query
row is one query. Queries without candidates give no rows. Rows with a null id take no part. An empty table gives an
empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, base_columns


@dataclass(frozen=True)
class AnnParameters:
    """dimensions must be even (closed form of the chi-square distribution). fit_rows bounds the sample that cuts the
    cells; every vector is dealt to one, whether in the sample or not."""

    k: int = 10
    dimensions: int = 8
    confidence: float = 0.98
    leaf: int = 32
    block_rows: int = 4_096
    fit_rows: int = 20_000
    seed: int = 5


def chi_square_cdf(x: float, degrees: int) -> float:
    """For even degrees: 1 - exp(-x/2) * sum of (x/2)^i / i! below degrees / 2."""
    half = x / 2
    if half > 700:
        return 1.0
    term = total = 1.0
    for i in range(1, degrees // 2):
        term *= half / i
        total += term
    return 1 - math.exp(-half) * total


def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1.0
    while chi_square_cdf(high, degrees) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, degrees) < p else (low, mid)
    return high


class ProjectedTree:
    """kd-tree over projected points: leaves as ranges of a permutation, with bounding boxes."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.points, self.order, self.leaf = points, np.arange(len(points)), leaf
        ranges, stack = [], [(0, len(points))]
        while stack:
            a, b = stack.pop()
            if b - a <= leaf:
                ranges.append((a, b))
                continue
            own = self.order[a:b]
            box = points[own]
            axis = int((box.max(0) - box.min(0)).argmax())
            mid = (b - a) // 2
            self.order[a:b] = own[np.argpartition(box[:, axis], mid)]
            stack += [(a, a + mid), (a + mid, b)]
        self.ranges = ranges
        self.low = np.array([points[self.order[a:b]].min(0) for a, b in ranges])
        self.high = np.array([points[self.order[a:b]].max(0) for a, b in ranges])

    def leaves(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves by growing squared projected distance of their box, and those distances."""
        gap = np.maximum(0, np.maximum(self.low - q, q - self.high))
        d = (gap * gap).sum(1)
        order = np.argsort(d, kind="stable")
        return order, d[order]


def directions(size: int, p: AnnParameters) -> np.ndarray:
    return np.random.default_rng([p.seed, size]).standard_normal((size, p.dimensions))


class CellTree:
    """The kd cuts of the projected space, from a sample: inner nodes in heap order, leaves are the cells."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.cut = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
        parts = [np.arange(len(sample))]
        for node in range((1 << depth) - 1):
            own = parts[node]
            if len(own):
                box = sample[own]
                self.axis[node] = (box.max(0) - box.min(0)).argmax()
                self.cut[node] = np.median(box[:, self.axis[node]])
            low = sample[own, self.axis[node]] < self.cut[node]
            parts += [own[low], own[~low]]

    def cells(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (points[np.arange(len(points)), self.axis[at]] >= self.cut[at])
        return at - ((1 << self.depth) - 1)


def search_block(vectors: np.ndarray, ids: list[np.ndarray], queries: np.ndarray, query_ids: np.ndarray, limits: np.ndarray, p: AnnParameters) -> list[tuple[int, int, float]]:
    """(query row, candidate, distance) of the k nearest of one block, per query, none needed beyond the query's limit.
    ids[i] are the ids of vector i, rising."""
    project = directions(vectors.shape[1], p)
    tree, stop, out = ProjectedTree(vectors @ project, p.leaf), chi_square_quantile(p.confidence, p.dimensions), []
    for row, (q, qid, limit, pq) in enumerate(zip(queries, query_ids.tolist(), limits.tolist(), queries @ project, strict=True)):
        order, reach = tree.leaves(pq)
        best_d, best_id, at, step = np.zeros(0), np.zeros(0, np.int64), 0, 2
        while at < len(order):
            if reach[at] >= stop * min(limit, best_d[p.k - 1] if len(best_d) >= p.k else math.inf) ** 2:
                break
            rows = np.concatenate([tree.order[slice(*tree.ranges[i])] for i in order[at : at + step]])
            diff = vectors[rows] - q
            d = np.sqrt((diff * diff).sum(1))
            near = np.argsort(d, kind="stable")[: p.k + 1]
            if len(d) > p.k + 1:
                near = np.flatnonzero(d <= d[near[-1]])
            cand_id = np.concatenate([ids[r] for r in rows[near]])
            cand_d = np.repeat(d[near], [len(ids[r]) for r in rows[near]])
            other = cand_id != qid
            best_d, best_id = np.concatenate([best_d, cand_d[other]]), np.concatenate([best_id, cand_id[other]])
            keep = np.lexsort((best_id, best_d))[: p.k]
            best_d, best_id = best_d[keep], best_id[keep]
            at, step = at + step, step * 2
        out += [(row, int(i), float(x)) for i, x in zip(best_id, best_d, strict=True)]
    return out


def useful_ids(ids: np.ndarray, k: int) -> np.ndarray:
    """Of the rising ids of equal vectors those that can be in an answer: up to k rows that may be the query's own id
    and k others."""
    _, first = np.unique(ids, return_index=True)
    times = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
    return ids[times < k][: 2 * k]


def nearest(vectors: DataFrame, query_filter: str = "vec_id % 100 = 0", parameters: AnnParameters | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of every row that query_filter (on vec_id) selects."""
    p = parameters or AnnParameters()
    v = base_columns(vectors, vec_id=id_col, vec=vector_col).withColumn("vec_id", F.col("vec_id").cast("long"))
    x = v.filter("vec_id is not null and vec is not null and size(vec) > 0").withColumn("vec", F.col("vec").cast("array<double>"))
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))
    x = x.filter(F.forall("vec", finite) & F.exists("vec", lambda e: e != 0)).withColumn("dim", F.size("vec"))
    with Scratch(x.sparkSession) as scratch:
        sizes = {r["dim"]: r["n"] for r in x.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one row a dimension
        share = max(1, sum(sizes.values()) // p.fit_rows)
        sample: dict[int, list] = {d: [] for d in sizes}
        for r in x.filter(F.pmod(F.xxhash64("vec_id", "vec"), F.lit(share)) == 0).select("dim", "vec").limit(2 * p.fit_rows).toLocalIterator():
            sample[r["dim"]].append(r["vec"])
        trees = {}
        for d, n in sizes.items():
            points = np.array(sample[d], np.float64).reshape(-1, d) @ directions(d, p)
            deepest = max(0, int(math.log2(max(1, len(points) / 8))))  # a cell has 8 rows of the sample
            trees[d] = CellTree(points, min(deepest, max(0, math.ceil(math.log2(max(1, n / p.block_rows))))))
        shared = x.sparkSession.sparkContext.broadcast(trees)  # at most fit_rows / 4 cuts

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = np.array(batch.column("dim").to_pylist(), np.int64)
                vecs = batch.column("vec").to_pylist()
                cell, place = np.zeros(len(dims), np.int64), np.zeros((len(dims), p.dimensions))
                for d in np.unique(dims).tolist():
                    own = np.flatnonzero(dims == d)
                    place[own] = np.array([vecs[i] for i in own], np.float64) @ directions(d, p)
                    cell[own] = shared.value[d].cells(place[own])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(list(place), pa.list_(pa.float64()))], [*batch.schema.names, "cell", "place"])

        dealt = scratch.keep(x.select("vec_id", "vec", "dim").mapInArrow(deal, "vec_id bigint, vec array<double>, dim int, cell bigint, place array<double>"), "vectors")
        edges = [f(F.get("place", F.lit(i))).alias(f"{n}{i}") for i in range(p.dimensions) for n, f in (("low", F.min), ("high", F.max))]
        boxes = dealt.groupBy("dim", "cell").agg(F.count("*").alias("n"), *edges).collect()  # a row a cell, at most fit_rows / 4
        held: dict[int, dict] = {}
        for d in sizes:
            own = [r for r in boxes if r["dim"] == d]
            side = lambda n, own=own: np.array([[r[f"{n}{i}"] for i in range(p.dimensions)] for r in own])
            held[d] = {"cell": [r["cell"] for r in own], "blocks": [-(-r["n"] // (2 * p.block_rows)) for r in own], "low": side("low"), "high": side("high")}
        known = x.sparkSession.sparkContext.broadcast(held)
        stop = chi_square_quantile(p.confidence, p.dimensions)

        def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The blocks a query goes to: those of its own cell while it has no limit, else those of the other cells that
            the test doesn't rule out."""
            for batch in batches:
                cells, blocks = [], []
                for d, place, own, limit in zip(*(batch.column(c).to_pylist() for c in ("dim", "place", "cell", "limit")), strict=True):
                    k = known.value[d]
                    if limit is None:
                        pick = [k["cell"].index(own)]
                    else:
                        gap = np.maximum(0, np.maximum(k["low"] - place, place - k["high"]))
                        pick = [i for i in np.flatnonzero((gap * gap).sum(1) < stop * limit**2).tolist() if k["cell"][i] != own]
                    cells.append([k["cell"][i] for i in pick for _ in range(k["blocks"][i])])
                    blocks.append([b for i in pick for b in range(k["blocks"][i])])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int64())), pa.array(blocks, pa.list_(pa.int64()))], [*batch.schema.names, "cells", "blocks"])

        def run(cand: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
            rows: list[tuple[int, int, float]] = []
            if len(cand) and len(query):
                m, ids = np.array(cand["vec"].tolist(), np.float64), cand["vec_id"].to_numpy()
                order = np.argsort(ids, kind="stable")
                m, ids = m[order] + 0.0, ids[order]
                _, first, group = np.unique(m.view([("", m.dtype)] * m.shape[1]).ravel(), return_index=True, return_inverse=True)
                by = np.argsort(group, kind="stable")
                members = [useful_ids(g, p.k) for g in np.split(ids[by], np.cumsum(np.bincount(group))[:-1])]
                limits = query["limit"].fillna(math.inf).to_numpy(np.float64)
                rows = search_block(m[first], members, np.array(query["vec"].tolist(), np.float64), query["query_id"].to_numpy(), limits, p)
            at = [r[0] for r in rows]
            return pd.DataFrame({"query_id": query["query_id"].to_numpy()[at], "version": query["version"].to_numpy()[at], "vec_id": [r[1] for r in rows], "score": [r[2] for r in rows]}).astype({"query_id": "int64", "version": "int64", "vec_id": "int64", "score": "float64"})

        rank = F.row_number().over(Window.partitionBy("query_id", "version").orderBy("score", "vec_id"))

        def search(queries: DataFrame) -> DataFrame:
            kinds = "query_id bigint, version bigint, vec array<double>, dim int, cell bigint, place array<double>, limit double, cells array<bigint>, blocks array<bigint>"
            sent = queries.mapInArrow(visits, kinds).select("query_id", "version", "vec", "dim", "limit", F.explode(F.arrays_zip("cells", "blocks")).alias("to"))
            sent = sent.select("query_id", "version", "vec", "limit", F.col("dim").alias("q_dim"), F.col("to.cells").alias("q_cell"), F.col("to.blocks").alias("q_block"))
            several = F.create_map(*[F.lit(y) for d, k in held.items() for c, b in zip(k["cell"], k["blocks"], strict=True) if b > 1 for y in (f"{d}:{c}", b)]) if any(b > 1 for k in held.values() for b in k["blocks"]) else None
            n = F.lit(1) if several is None else F.coalesce(F.element_at(several, F.concat_ws(":", "dim", "cell")), F.lit(1))
            block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), n).cast("long")
            cand = dealt.select("vec_id", "vec", "dim", "cell").withColumn("block", block)
            found = cand.groupBy("dim", "cell", "block").cogroup(sent.groupBy("q_dim", "q_cell", "q_block")).applyInPandas(run, "query_id bigint, version bigint, vec_id bigint, score double")
            return found.withColumn("rank", rank).filter(F.col("rank") <= p.k)

        q = dealt.filter(query_filter).dropDuplicates(["vec_id", "vec"]).select(F.col("vec_id").alias("query_id"), F.xxhash64("vec").alias("version"), "vec", "dim", "cell", "place")
        q = scratch.keep(q, "queries")
        home = scratch.keep(search(q.withColumn("limit", F.lit(None).cast("double"))).drop("rank"), "home")
        # fewer than k found: no limit yet, all other cells are searched
        kth = home.groupBy("query_id", "version").agg(F.when(F.count("*") >= p.k, F.max("score")).otherwise(float("inf")).alias("limit"))
        kth = kth.withColumnsRenamed({"query_id": "of", "version": "of_version"})
        again = q.join(kth, (F.col("query_id") == F.col("of")) & (F.col("version") == F.col("of_version")), "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
        more = search(again.select(*q.columns, "limit")).drop("rank")
        best = home.unionByName(more).withColumn("rank", rank).filter(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")
        return scratch.release(scratch.keep(best, "nearest"))
