"""Index recipes: the query that each kind of index exists for, as a DataFrame; nothing here is a physical index."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConstraintViolation, InvalidRequest


def key_range(df: DataFrame, column: str, low: object | None = None, high: object | None = None) -> DataFrame:
    """Ordered index: rows of [low, high); both bounds reach the scan as pushed filters."""
    out = df if low is None else df.filter(F.col(column) >= F.lit(low))
    return out if high is None else out.filter(F.col(column) < F.lit(high))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that a unique index would refuse, with their number of rows. Null keys aren't compared."""
    full = df.dropna(subset=list(keys))
    return full.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def check_unique(df: DataFrame, keys: Sequence[str]) -> None:
    if not duplicates(df, keys).isEmpty():
        raise ConstraintViolation("INDEX_UNIQUENESS_VIOLATION", ", ".join(keys))


def aggregate_index(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The materialised aggregates of a group: count, non-null count, sum, minimum, maximum and average."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count(value).alias("non_null"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"))


def rank_within(df: DataFrame, score: str, group: Sequence[str], key: str, most: int | None = None) -> DataFrame:
    """Rank by falling score inside each group, equal scores sharing a rank; ``most`` keeps the first ranks.

    With a limit Spark drops rows per task before the shuffle.
    """
    w = Window.partitionBy(*group).orderBy(F.desc(score))
    out = df.select(*group, key, score, F.rank().over(w).alias("rank"))
    return out if most is None else out.filter(F.col("rank") <= most)


def rank_of(df: DataFrame, score: str, key: str) -> DataFrame:
    """(key, score, rank) over all rows without one task for all: rank = 1 + rows with a higher score.

    Rows are counted per score; counts per range of scores come from a bounded histogram, and only rows of one range
    meet in a window.
    """
    scored = df.filter(F.col(score).isNotNull())
    lo, hi = scored.agg(F.min(score), F.max(score)).first()
    if lo is None:
        return scored.select(key, score, F.lit(0).cast("long").alias("rank"))
    cells = 1024
    width = (float(hi) - float(lo)) / cells or 1.0
    cell = F.least(F.floor((F.col(score) - F.lit(lo)) / F.lit(width)), F.lit(cells - 1)).cast("int")
    per_score = scored.groupBy(cell.alias("cell"), score).agg(F.count("*").alias("n"))
    per_cell = per_score.groupBy("cell").agg(F.sum("n").alias("n"))  # at most ``cells`` rows
    above = per_cell.select("cell", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("cell").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = per_score.withColumn("inside", inside).join(F.broadcast(above), "cell").select(F.col(score).alias("__s"), (F.col("above") + F.col("inside") + 1).alias("rank"))
    return scored.join(ranks, F.col(score) == F.col("__s")).select(key, score, "rank")


# fixed values: leaderboard windows by name
WINDOWS = {"hourly": "hour", "daily": "day", "weekly": "week", "monthly": "month"}


def leaderboard(df: DataFrame, ts: str, player: str, score: str, window: str = "daily", most: int = 3, last_windows: int | None = None) -> DataFrame:
    """Best score of each player per time bucket and its first ranks; ``last_windows`` keeps the newest buckets."""
    if window not in WINDOWS:
        raise InvalidRequest("INVALID_INDEX_OPTION", window)
    best = df.groupBy(F.date_trunc(WINDOWS[window], ts).cast("timestamp_ntz").alias("bucket"), player).agg(F.max(score).alias("best"))
    if last_windows is not None:
        keep = best.select("bucket").distinct().orderBy(F.desc("bucket")).limit(last_windows)
        best = best.join(F.broadcast(keep), "bucket", "left_semi")  # last_windows rows
    w = Window.partitionBy("bucket").orderBy(F.desc("best"), F.asc(player))
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def keep_last(df: DataFrame, key: str, order: Sequence[str], versions: int) -> DataFrame:
    """History that keeps the newest ``versions`` rows of a key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("version_rank", F.row_number().over(w)).filter(F.col("version_rank") <= versions)


def keep_for(df: DataFrame, ts: str, now: Column, duration: str) -> DataFrame:
    """History that keeps rows not older than a duration, as '7 days'."""
    return df.filter(F.col(ts) >= now - F.expr(f"INTERVAL {duration}"))


def update_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("updates"))


def bitmap_counts(df: DataFrame, value: str, group: Sequence[str]) -> DataFrame:
    """Exact distinct counts of a non-negative integer per group by bitmaps, one per bucket of 32768 values."""
    cells = df.groupBy(*group, F.bitmap_bucket_number(value).alias("bucket")).agg(F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(value))).alias("n"))
    return cells.groupBy(*group).agg(F.sum("n").alias("n_distinct"))


def approximate_distinct(df: DataFrame, value: str, group: Sequence[str], precision: float = 0.02) -> DataFrame:
    return df.groupBy(*group).agg(F.approx_count_distinct(value, precision).alias("n_distinct"))


def approximate_percentiles(df: DataFrame, value: str, group: Sequence[str], shares: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    return df.groupBy(*group).agg(F.percentile_approx(value, list(shares), accuracy).alias("percentiles"))


def exact_percentiles(df: DataFrame, value: str, group: Sequence[str], shares: Sequence[float], cells: int = 64) -> DataFrame:
    """(group, percentiles): the smallest value that a share of the group's non-null values doesn't exceed; null if the
    group has none.

    A sketch only cuts each group into cells of values. Rows are counted per value, and values of one cell meet in a
    window, so the result is exact however good the cuts are and no task holds a whole group.
    """
    keys = [f"__k{i}" for i in range(len(group))]
    named = df.select(*[F.col(g).alias(k) for g, k in zip(group, keys, strict=True)], F.col(value).alias("__v"))
    cuts = approximate_percentiles(named, "__v", keys, [i / cells for i in range(1, cells)]).withColumnRenamed("percentiles", "__cuts")
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    counted = named.filter("__v is not null").groupBy(*keys, "__v").agg(F.count("*").alias("__n")).alias("c")
    placed = counted.join(cuts.alias("s"), same("c", "s")).select("c.*", F.size(F.filter("__cuts", lambda x: x < F.col("__v"))).alias("__cell"))
    per_cell = placed.groupBy(*keys, "__cell").agg(F.sum("__n").alias("__n"))  # at most ``cells`` rows a group
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_cell = per_cell.select(*keys, "__cell", before.alias("__before"), F.sum("__n").over(Window.partitionBy(*keys)).alias("__all")).alias("b")
    inside = F.sum("__n").over(Window.partitionBy(*keys, "__cell").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = placed.withColumn("__upto", inside).alias("p").join(per_cell, [*same("p", "b"), F.col("p.__cell") == F.col("b.__cell")])
    rank = lambda share: F.ceil(F.lit(Decimal(str(share))) * F.col("__all"))
    found = ranked.groupBy(*[F.col(f"p.{k}").alias(k) for k in keys]).agg(F.array(*[F.min(F.when(F.col("__before") + F.col("__upto") >= rank(s), F.col("__v"))) for s in shares]).alias("percentiles"))
    every = cuts.select(*keys).alias("e").join(found.alias("f"), same("e", "f"), "left")
    return every.select(*[F.col(f"e.{k}").alias(g) for g, k in zip(group, keys, strict=True)], "percentiles")


def distance(a: Column, b: Column, metric: str = "euclidean") -> Column:
    """Distance of two arrays in double precision: euclidean, cosine, dot (negated) or manhattan."""
    fold = lambda f: F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    if metric == "euclidean":
        return F.sqrt(fold(lambda x, y: (x - y) * (x - y)))
    if metric == "manhattan":
        return fold(lambda x, y: F.abs(x - y))
    if metric == "dot":
        return -fold(lambda x, y: x * y)
    if metric == "cosine":
        norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        return 1 - fold(lambda x, y: x * y) / (norm(a) * norm(b))
    raise InvalidRequest("INVALID_INDEX_OPTION", metric)


def exact_nearest(df: DataFrame, key: str, vector: str, query: Sequence[float], k: int, metric: str = "euclidean") -> DataFrame:
    """The k rows nearest to one vector, with their distance; a top-k per task comes before the last sort."""
    q = F.array(*[F.lit(float(x)) for x in query])
    fits = df.filter(F.size(vector) == len(query))
    return fits.select(key, distance(F.col(vector), q, metric).alias("distance")).orderBy("distance", key).limit(k)


def postings(df: DataFrame, key: str, text: str, least: int = 2) -> DataFrame:
    """(term, key, frequency) of an inverted index over lower-case words of at least ``least`` characters."""
    words = F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))
    return df.select(key, words.alias("term")).filter(F.length("term") >= least).groupBy("term", key).agg(F.count("*").alias("frequency"))


def text_match(df: DataFrame, key: str, text: str, words: Sequence[str]) -> DataFrame:
    """Rows that hold all words, with the number of their occurrences."""
    hits = postings(df, key, text).filter(F.col("term").isin(*[w.lower() for w in words]))
    return hits.groupBy(key).agg(F.count("*").alias("n"), F.sum("frequency").alias("hits")).filter(F.col("n") == len({w.lower() for w in words})).select(key, "hits")


def character_ngrams(df: DataFrame, text: str, n: int = 3) -> DataFrame:
    """(gram, n_rows): number of rows that hold each character n-gram."""
    t = F.lower(text)
    grams = F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return df.select(F.explode(F.array_distinct(grams)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n_rows"))


def prefixes(df: DataFrame, text: str, shortest: int, longest: int) -> DataFrame:
    """(prefix, value, n): completions of every prefix of shortest to longest characters."""
    values = df.groupBy(F.lower(text).alias("value")).agg(F.count("*").alias("n"))
    sizes = F.sequence(F.lit(shortest), F.least(F.lit(longest), F.length("value")))
    return values.filter(F.length("value") >= shortest).select(F.explode(F.transform(sizes, lambda i: F.substring(F.col("value"), F.lit(1), i))).alias("prefix"), "value", "n")


def complete(df: DataFrame, text: str, shortest: int, longest: int, most: int) -> DataFrame:
    w = Window.partitionBy("prefix").orderBy(F.desc("n"), F.asc("value"))
    return prefixes(df, text, shortest, longest).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def grid_cell(longitude: Column, latitude: Column, level: int) -> Column:
    """Number of the cell of a Z-order grid with 2^level rows and columns that a point lies in."""
    side = 1 << level
    x = F.least(F.floor((longitude + 180) / 360 * side), F.lit(side - 1)).cast("long")
    y = F.least(F.floor((latitude + 90) / 180 * side), F.lit(side - 1)).cast("long")
    out = F.lit(0).cast("long")
    for i in range(level):
        out = out + F.shiftleft(F.shiftright(x, i).bitwiseAND(F.lit(1)), 2 * i) + F.shiftleft(F.shiftright(y, i).bitwiseAND(F.lit(1)), 2 * i + 1)
    return out
