"""Packing of token pieces into sequences of fixed capacity: bulk-synchronous best fit.

Pieces are placed in bands of falling length. In each round of a band, pieces and gaps (free ends of open sequences)
are put in one order by size, gaps first among equals, and one sweep gives every piece its successor: the smallest gap
that still fits and that no other piece of the round takes. Taking the sweep from large to small, a gap opens a
bracket and a piece closes the innermost open one, so the bracket depth is the rank that resolves conflicts; depths
are prefix sums, and a piece belongs to the gap before it at the same depth. Matched gaps shrink, and the round
repeats until no gap of the band can take a piece. Pieces left over then open new sequences among themselves, longest
first and each filled with whatever still fits. That layout needs only the number of pieces of each length (at most
capacity numbers): it is a list of fillings, each repeated many times, and a piece finds its own by its rank in its
length.

Everything runs as shuffles on (size, kind, salt) and on depth. The salt splits a length that holds a large part of
all rows; one depth holds at most two rows per size, so no group grows with the input. Only counts per class (at most
two per token of capacity and salt) meet in one window. Each round is written to the shared folder, which cuts
lineage and lets a lost executor cost one round at most.

Defined results: null or empty text has no ids and packs as one piece, the end id alone. Repeated rows are packed like
others, each by itself. An empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .shared import base_columns, materialise, new_folder
from .subwords import library_table, small_batches

CAPACITY = 2048
#: Rows of one size that one task ranks at most, about.
ROWS_PER_SALT = 200_000


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut at multiples of capacity."""
    source = base_columns(docs, doc_id=id_col, text=text_col)
    id_type = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = library_table(vocabulary)
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            row, piece, start, length, crc = [], [], [], [], []
            end = np.array([end_id], "<u4").tobytes()
            for a, b in small_batches(texts):
                ids, at = table.ids(texts[a:b])
                at = at.tolist()
                for i in range(b - a):
                    raw = ids[at[i] : at[i + 1]].astype("<u4").tobytes() + end
                    for p, s in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[s : s + 4 * capacity]
                        row.append(a + i)
                        piece.append(p)
                        start.append(s // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return source.mapInArrow(run, f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint")


def bands(capacity: int) -> list[tuple[int, int]]:
    """(shortest, longest) length of each band: capacity over 1, 2, 3, 6 and 16.

    Each round of each band is a few Spark jobs, so bands are few; more of them don't pack more tightly.
    """
    longest = [h for h in dict.fromkeys(capacity // k for k in (1, 2, 3, 6, 16)) if h > 0]
    return [(b + 1, a) for a, b in zip(longest, [*longest[1:], 0], strict=True)]


def _rank(rows: DataFrame, by: list[Column], salts: int) -> tuple[DataFrame, DataFrame]:
    """rows with salt and 0-based place among the rows of the same (size, kind), and the classes' counts.

    by: order of classes for the depth before each class, as a running sum of ``sign``.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    cells = salted.groupBy("size", "kind", "salt").agg(F.count("*").alias("n"))
    in_class = Window.partitionBy("size", "kind").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(in_class), F.lit(0))).select(F.col("size").alias("size_"), F.col("kind").alias("kind_"), F.col("salt").alias("salt_"), "n", "before")
    # at most two classes per token of capacity
    classes = cells.groupBy("size_", "kind_").agg(F.sum("n").alias("n")).withColumn("signed", F.when(F.col("kind_") == 0, F.col("n")).otherwise(-F.col("n")))
    running = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.select("size_", "kind_", F.coalesce(F.sum("signed").over(running), F.lit(0)).alias("depth"))
    starts = cells.drop("n").join(classes, ["size_", "kind_"])
    place = F.row_number().over(Window.partitionBy("size", "kind", "salt").orderBy("id")) - 1
    j = salted.withColumn("place", place).join(starts, (F.col("size") == F.col("size_")) & (F.col("kind") == F.col("kind_")) & (F.col("salt") == F.col("salt_")))
    return j.withColumn("place", F.col("place") + F.col("before")), classes


def sweep(rows: DataFrame, capacity: int, salts: int) -> DataFrame:
    """One round. rows: (kind 0 gap / 1 piece, id, size). Returns (kind, id, size, piece, offset): a gap that took a
    piece has the rest of its size, the piece and the piece's offset; a piece that was taken has size 0."""
    ranked, _ = _rank(rows, [F.desc("size_"), F.asc("kind_")], salts)
    depth = F.when(F.col("kind") == 0, F.col("depth") + F.col("place") + 1).otherwise(F.col("depth") - F.col("place"))
    level = Window.partitionBy("level").orderBy(F.desc("size"), F.asc("kind"))
    here = F.struct("kind", "id", "size")
    near = ranked.withColumn("level", depth).withColumns({"prev": F.lag(here).over(level), "next": F.lead(here).over(level)})
    takes = (F.col("kind") == 0) & (F.col("next.kind") == 1)
    taken = (F.col("kind") == 1) & (F.col("prev.kind") == 0)
    return near.select(
        "kind",
        "id",
        F.when(takes, F.col("size") - F.col("next.size")).when(taken, F.lit(0)).otherwise(F.col("size")).cast("long").alias("size"),
        F.when(takes, F.col("next.id")).alias("piece"),
        F.when(takes, F.lit(capacity) - F.col("size")).cast("long").alias("offset"),
    )


def fillings(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """First fit by falling size: (size, first, end, bin, each, offset). The pieces of a size with ranks first to end - 1
    lie ``each`` to a sequence, from sequence ``bin`` on and from ``offset`` in it."""
    left, used, rows, bins = dict(counts), dict.fromkeys(counts, 0), [], 0
    sizes = sorted(counts, reverse=True)
    while sizes:
        room, filling = capacity, []
        for s in sizes:
            n = min(room // s, left[s])
            if n:
                filling.append((s, n))
                room -= n * s
            if room < sizes[-1]:
                break
        times, offset = min(left[s] // n for s, n in filling), 0
        for s, n in filling:
            rows.append((s, used[s], used[s] + n * times, bins, n, offset))
            used[s] += n * times
            left[s] -= n * times
            offset += n * s
        bins += times
        sizes = [s for s in sizes if left[s]]
    return rows


def open_sequences(pieces: DataFrame, capacity: int, alone: bool, salts: int) -> DataFrame:
    """New sequences that hold all pieces, one each if ``alone``: (kind, id, size, piece, offset), a row per piece; the
    first of a sequence has its gap as size, others 0. The sequence's id is that of its first piece."""
    if alone:
        return pieces.select(F.lit(0).alias("kind"), "id", (F.lit(capacity) - F.col("size")).cast("long").alias("size"), F.col("id").alias("piece"), F.lit(0).cast("long").alias("offset"))
    counts = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    plan = pieces.sparkSession.createDataFrame(fillings(counts, capacity), "of bigint, first bigint, end bigint, bin bigint, each bigint, start bigint")
    ranked, _ = _rank(pieces.withColumn("kind", F.lit(1)), [F.desc("size_")], salts)
    # the plan depends on the numbers per size only, at most capacity of them
    n = ranked.join(F.broadcast(plan), (F.col("size") == F.col("of")) & (F.col("place") >= F.col("first")) & (F.col("place") < F.col("end")))
    n = n.select("id", "size", F.expr("bin + (place - first) div each").alias("bin"), F.expr("start + (place - first) % each * size").alias("offset"))
    n = n.withColumns({"opener": F.min_by("id", "offset").over(Window.partitionBy("bin")), "all": F.sum("size").over(Window.partitionBy("bin"))})
    gap = F.when(F.col("offset") == 0, F.lit(capacity) - F.col("all")).otherwise(0)
    return n.select(F.lit(0).alias("kind"), F.col("opener").alias("id"), gap.cast("long").alias("size"), F.col("id").alias("piece"), F.col("offset").cast("long").alias("offset"))


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(piece, sequence_id, offset) for pieces (id, size), size from 1 to capacity; ids are distinct longs."""
    spark = pieces.sparkSession
    folder = new_folder(spark, "packing")
    step = [0]

    def write(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
        step[0] += 1
        seen = Observation()
        path = f"{folder}/{step[0]}"
        df.observe(seen, *[c.alias(k) for k, c in metrics.items()]).write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), seen.get

    plan = bands(capacity)
    band_of = F.lit(len(plan) - 1)
    for i, (low, _) in reversed(list(enumerate(plan[:-1]))):
        band_of = F.when(F.col("size") >= low, i).otherwise(band_of)
    counts = {r["band"]: r["n"] for r in pieces.groupBy(band_of.alias("band")).agg(F.count("*").alias("n")).collect()}  # one row per band
    salts = max(1, min(1024, -(-sum(counts.values()) // ROWS_PER_SALT)))
    done: list[DataFrame] = []
    gaps: DataFrame | None = None
    for i, (low, high) in enumerate(plan):
        if not counts.get(i):
            continue
        todo = pieces.filter((F.col("size") >= low) & (F.col("size") <= high)).select(F.lit(1).alias("kind"), "id", "size")
        left, idle = counts[i], None
        if gaps is not None:
            idle = gaps.filter(F.col("size") < low)
            active = gaps.filter(F.col("size") >= low)
            while left:
                gap, rest = F.col("kind") == 0, (F.col("kind") == 1) & (F.col("size") > 0)
                state, seen = write(sweep(active.unionByName(todo), capacity, salts), placed=F.count("piece"), left=F.sum(rest.cast("long")), widest=F.max(F.when(gap, F.col("size"))), shortest=F.min(F.when(rest, F.col("size"))))
                done.append(state.filter("piece is not null"))
                left = seen["left"] or 0
                todo = state.filter(rest).select("kind", "id", "size")
                active = state.filter(gap & (F.col("size") > 0)).select("kind", "id", "size")
                if not seen["placed"] or not left or seen["widest"] < seen["shortest"]:
                    break
            gaps = idle.unionByName(active)
        if left:
            opened, _ = write(open_sequences(todo.drop("kind"), capacity, capacity // low == 1, salts), n=F.count("*"))
            done.append(opened)
            new = opened.filter("size > 0").select("kind", "id", "size")
            gaps = new if gaps is None else gaps.unionByName(new)
        # one table of gaps for the next band, without those that the shortest piece left can't use
        needed = [plan[j][0] for j in range(i + 1, len(plan)) if counts.get(j)]
        if needed:
            gaps, _ = write(gaps.filter(F.col("size") >= min(needed)), n=F.count("*"))
    out = [d.select("piece", F.col("id").alias("sequence_id"), "offset") for d in done]
    return reduce(DataFrame.unionByName, out) if out else pieces.select(F.col("id").alias("piece"), F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every document."""
    cut = token_pieces(docs, vocabulary, capacity, 0, id_col, text_col).withColumn("pid", F.monotonically_increasing_id())
    cut = materialise(cut, "pieces")
    placed = place(cut.select(F.col("pid").alias("id"), F.col("length").alias("size")), capacity).withColumnRenamed("piece", "pid")
    return cut.join(placed, "pid").drop("pid")
