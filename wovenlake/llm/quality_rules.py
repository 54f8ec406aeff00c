"""Quality rules with thresholds that adapt to each language and source (native Spark expressions only).

Every document gets four counts of its whole text (characters in words, symbols, repeated lines, words in
repeated five-word windows) and ratios of them. Fixed cutoffs are replaced by fences: for each (lang, source) and
ratio, quartiles are read from a quantile sketch, and a document is rejected whose ratio lies more than ``reach``
spreads beyond the upper (or lower) quartile.

The sketch is log-linear: a ratio in parts per million falls into the bucket of its three leading decimal digits,
so a bucket is at most 1 % wide, one group holds a few thousand buckets however many rows it has, and two sketches
merge by adding counts. Spark's partial aggregation builds it before the shuffle; a hot source costs no more than
its buckets. All arithmetic on sketches is on integers, so results don't depend on the order of merging.

Defined results: a null text counts as empty (0 words, base rule failed). A null lang or source is a group of its
own. Ties and repeated rows are judged alike. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WS, base_columns, materialise

#: ratio name, least spread (parts per million; word_length in thousandths), sides of the fence
RATIOS = (
    ("symbol_ratio", 10_000, "upper"),
    ("dup_line_ratio", 120_000, "upper"),
    ("word_length", 1_200, "both"),
)

BROADCAST_GROUPS = 20_000


@dataclass(frozen=True)
class QualityParameters:
    """min_words, max_repeat_percent: the base rule. reach: fence distance in spreads."""

    min_words: int = 10
    max_repeat_percent: int = 20
    reach: int = 3


def text_counts(text: Column | str) -> dict[str, Column]:
    """Expressions over a text column that need no intermediate columns."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return {"__words": F.array_remove(F.split(t, WS), ""), "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"), "__lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))}


def windows_by_hash(hashes: str) -> Column:
    """(hash, place) pairs in order of hash for texts that hold equal window hashes, else null."""
    h = F.col(hashes)
    return F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))


def repeat_words(ordered: str) -> Column:
    """Words of the text that lie in a five-word window found at least twice.

    The places of repeated windows, in order, each add the words that the window before didn't cover.
    """
    s = F.col(ordered)
    same = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
    places = F.sort_array(F.transform(F.filter(s, lambda _, i: same(i, i - 1) | same(i, i + 1)), lambda x: x["i"]))
    start = F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(places, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(5), i - a["last"])).alias("n")), lambda a: a["n"])
    return F.coalesce(covered, F.lit(0).cast("long"))


def measure(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' kept columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the ratios."""
    keep = keep if keep is not None else [c for c in docs.columns if c != text_col]
    counts = text_counts(text_col)
    one = docs.select(*keep, counts["n_symbols"].alias("n_symbols"), counts["__words"].alias("__words"), counts["__lines"].alias("__lines"))
    n = F.size("__words")
    w = F.col("__words")
    two = one.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "__n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__hashes": F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2), F.get(w, i + 3), F.get(w, i + 4)))),
        }
    ).drop("__words", "__lines")
    three = two.withColumn("__ordered", windows_by_hash("__hashes")).drop("__hashes").withColumn("n_repeat_words", repeat_words("__ordered")).drop("__ordered")
    part = lambda a, b: F.expr(f"{a} * 1000000 div greatest({b}, 1)")
    return three.withColumns({"symbol_ratio": part("n_symbols", "word_chars"), "dup_line_ratio": part("n_dup_lines", "__n_lines"), "word_length": F.expr("word_chars * 1000 div greatest(n_words, 1)")}).drop("__n_lines")


def bucket(value: Column) -> Column:
    """Least value of the sketch bucket: the three leading decimal digits of a value of at least 0."""
    width = F.pow(F.lit(10.0), F.greatest(F.length(value.cast("string")) - 3, F.lit(0))).cast("long")
    return value - F.pmod(value, width)


def sketches(measured: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, ratio, bucket, n): one mergeable sketch per group and ratio, over documents that pass the base rule."""
    long = measured.filter(~F.col("base_failed")).select(*groups, F.explode(F.array(*[F.struct(F.lit(r).alias("ratio"), bucket(F.col(r)).alias("bucket")) for r, _, _ in RATIOS])).alias("x"))
    return long.groupBy(*groups, "x.ratio", "x.bucket").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, groups: list[str], reach: int) -> DataFrame:
    """One row per group with lo_<ratio> and hi_<ratio>; the window runs over sketch buckets, never over documents."""
    w = Window.partitionBy(*groups, "ratio")
    ranked = sketch.withColumns({"upto": F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(w)})
    quartile = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("total") * k, F.col("bucket")))
    q = ranked.groupBy(*groups, "ratio").agg(quartile(1).alias("q1"), quartile(3).alias("q3"))
    least = F.create_map(*[F.lit(x) for r, s, _ in RATIOS for x in (r, s)])
    spread = F.greatest(F.col("q3") - F.col("q1"), F.element_at(least, F.col("ratio")))
    q = q.select(*groups, "ratio", (F.col("q1") - reach * spread).alias("lo"), (F.col("q3") + reach * spread).alias("hi"))
    pick = lambda r, c: F.max(F.when(F.col("ratio") == r, F.col(c))).alias(f"{c}_{r}")
    return q.groupBy(*groups).agg(*[pick(r, c) for r, _, sides in RATIOS for c in (("lo", "hi") if sides == "both" else ("hi",))])


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: list[str] | None = None, parameters: QualityParameters | None = None, names: list[str] | None = None) -> DataFrame:
    """carry columns (doc_id; called names, if given), the counts, base_failed and kept for every row of docs.

    The fences are joined back on (lang, source), by broadcast if their counted number is small.
    """
    p = parameters or QualityParameters()
    carry = carry if carry is not None else ["doc_id"]
    narrow = base_columns(docs, **{f"c{i}": c for i, c in enumerate(carry)}, text=text_col, lang=lang_col, source=source_col)
    held = [f"c{i}" for i in range(len(carry))]
    m = measure(narrow, "text", [*held, "lang", "source"]).withColumn("base_failed", (F.col("n_words") < p.min_words) | (100 * F.col("n_repeat_words") > p.max_repeat_percent * F.col("n_words")))
    # one string key: a null lang or source is a value like others, and the equality joins without null-safe keys
    m = m.withColumn("grp", F.to_json(F.struct("lang", "source"))).drop("lang", "source")
    # texts are read and measured once; the sketches and the join both read the narrow table of counts, and no
    # later filter can be pushed down into (and so repeat) the array expressions
    m = materialise(m, "quality")
    f = materialise(fences(sketches(m, ["grp"]), ["grp"], p.reach), "fences")
    # up to this many groups the fences go to all tasks; beyond, both sides are shuffled on the group
    j = m.join(F.broadcast(f) if f.count() <= BROADCAST_GROUPS else f, "grp", "left")
    inside = F.lit(True)
    for r, _, sides in RATIOS:
        inside = inside & F.coalesce(F.col(r) <= F.col(f"hi_{r}"), F.lit(True))
        if sides == "both":
            inside = inside & F.coalesce(F.col(r) >= F.col(f"lo_{r}"), F.lit(True))
    out = j.withColumn("kept", ~F.col("base_failed") & inside)
    return out.select(*[F.col(h).alias(c) for h, c in zip(held, names or carry, strict=True)], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
a AS (SELECT doc_id, lang, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
b AS (SELECT doc_id, lang, source, ws, len(ws)::BIGINT AS n_words,
  length(array_to_string(ws, ''))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines FROM a),
p AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 3), lambda i: {'i': i, 'w': array_to_string(ws[i:i+4], ' ')})) AS x FROM b WHERE n_words >= 5),
g AS (SELECT doc_id, x.i AS i, count(*) OVER (PARTITION BY doc_id, x.w) AS k FROM p),
r AS (SELECT doc_id, count(DISTINCT i + o)::BIGINT AS n FROM g, (SELECT unnest(range(0, 5)) AS o) WHERE k > 1 GROUP BY doc_id),
m AS (SELECT b.*, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
  n_words < 10 OR 100 * coalesce(r.n, 0) > 20 * n_words AS base_failed,
  n_symbols * 1000000 // greatest(word_chars, 1) AS symbol_ratio,
  n_dup_lines * 1000000 // greatest(n_lines, 1) AS dup_line_ratio,
  word_chars * 1000 // greatest(n_words, 1) AS word_length
  FROM b LEFT JOIN r USING (doc_id)),
u AS (SELECT lang, source, unnest([{'r': 'symbol_ratio', 's': 10000, 'v': symbol_ratio}, {'r': 'dup_line_ratio', 's': 120000, 'v': dup_line_ratio},
  {'r': 'word_length', 's': 1200, 'v': word_length}]) AS x FROM m WHERE NOT base_failed),
s AS (SELECT lang, source, x.r AS r, x.s AS s, x.v - x.v % (10 ** greatest(length(x.v::VARCHAR) - 3, 0))::BIGINT AS bk, count(*) AS n FROM u GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, r ORDER BY bk ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY lang, source, r) AS total FROM s),
q AS (SELECT lang, source, r, s, min(bk) FILTER (upto * 4 >= total) AS q1, min(bk) FILTER (upto * 4 >= total * 3) AS q3 FROM c GROUP BY ALL),
f AS (SELECT lang, source, max(CASE WHEN r = 'symbol_ratio' THEN q3 + 3 * greatest(q3 - q1, s) END) AS hs,
  max(CASE WHEN r = 'dup_line_ratio' THEN q3 + 3 * greatest(q3 - q1, s) END) AS hd,
  max(CASE WHEN r = 'word_length' THEN q3 + 3 * greatest(q3 - q1, s) END) AS hw,
  max(CASE WHEN r = 'word_length' THEN q1 - 3 * greatest(q3 - q1, s) END) AS lw FROM q GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(symbol_ratio <= hs, TRUE) AND coalesce(dup_line_ratio <= hd, TRUE)
  AND coalesce(word_length <= hw, TRUE) AND coalesce(word_length >= lw, TRUE) AS kept
FROM m LEFT JOIN f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source
"""
