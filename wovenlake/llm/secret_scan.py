"""Secret scan with a battery of randomness tests (native Spark expressions only).

Base patterns (fixed): assignments of secrets, cloud access keys, long hexadecimal runs. Beyond them every run of one
of the two base64 alphabets that mixes letter cases or digits is a candidate. Its encoding (the smallest alphabet that holds
it) is inferred, and three tests ask whether it looks drawn at random from that alphabet: chi-squared uniformity of
the characters, the number of runs above and below the middle of the alphabet, and the lag-one serial correlation of
the character codes. Three times the least of the three p-values is the candidate's p.

A candidate is called structured, and dropped, if the Benjamini-Hochberg step-up procedure rejects its randomness.
The procedure runs per encoding and length class (powers of two), so short strings, whose tests have little power,
don't set the level for long ones. It needs only counts of p-values in bins: one bounded row per stratum and bin,
summed with partial aggregation; the cut-offs (at most strata times one number) are then plain literals in the second
pass. What is left is added as spans of kind ``random`` where no base span overlaps.

Defined results: null or empty text has no spans and empty strings. Repeated rows give equal results. Ties between
spans that start together keep the order of kinds. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import base_columns, materialise

# fixed values: the base patterns; letters of the key words in either case, ASCII only
_WORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"({_WORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
# runs of these two are maximal and fail by length only, so the least length can stand in the pattern
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
# a run of one of the two base64 alphabets: where both kinds of marks mix, the leftmost such run of its own length
CANDIDATE = "[A-Za-z0-9+/]{20,}|[A-Za-z0-9_-]{20,}"
#: Cheap test before the costly one: nothing of a kind without this.
HINTS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "random": CANDIDATE}

# fixed values: alphabets of the inferred encodings, smallest first
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower36": "abcdefghijklmnopqrstuvwxyz0123456789",
    "UPPER36": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: Rows with random spans are broadcast up to so many rows and spans.
BROADCAST_SPANS = 100_000
#: p-values are counted in bins of a twentieth of a decade.
BINS_PER_DECADE, MOST_BINS = 20, 400


@dataclass(frozen=True)
class SecretParameters:
    """level: share of false rejections that the step-up procedure admits in each stratum."""

    level: float = 0.05


def _spans(text: Column, pattern: str, kind: int, hint: str, keep=None) -> Column:
    """array<struct<s, e, k, v>> of the leftmost non-overlapping matches.

    Ends are prefix sums of the lengths of gaps and matches, by doubling: a number of passes over the matches that is
    logarithmic in their number, where appending to an array match by match would be quadratic.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = F.zip_with(found, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda m, b: F.length(b) + F.length(m))
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(found) + 1.0)).cast("int"))
    ends = F.aggregate(rounds, lengths, lambda acc, k: F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - F.pow(F.lit(2), k).cast("int")), F.lit(0))))
    total = F.zip_with(found, ends, lambda m, e: F.struct((e - F.length(m)).alias("s"), e.alias("e"), F.lit(kind).alias("k"), m.alias("v")))
    if keep is not None:
        total = F.filter(total, keep)
    return F.when(text.rlike(hint), total).otherwise(F.array().cast("array<struct<s:int,e:int,k:int,v:string>>"))


def base_spans(text: Column) -> dict[str, Column]:
    value = lambda x: F.length(F.regexp_extract(x["v"], ASSIGN, 2)) >= 6
    return {
        "assign": _spans(text, ASSIGN, 0, HINTS["assign"], value),
        "access": _spans(text, ACCESS, 1, HINTS["access"]),
        "hex": _spans(text, HEX, 2, HINTS["hex"]),
    }


def encoding(v: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, letters in reversed(ALPHABETS.items()):
        pattern = "^[" + letters.replace("-", r"\-") + "]+$"
        out = F.when(v.rlike(pattern), name).otherwise(out)
    classes = v.rlike("[a-z]").cast("int") + v.rlike("[A-Z]").cast("int") + v.rlike("[0-9]").cast("int")
    return F.when(classes >= 2, out)


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal by the usual logistic approximation (error below 2e-4)."""
    return 1 / (1 + F.exp(1.5976 * z + 0.070566 * z * z * z))


def battery(candidates: DataFrame) -> DataFrame:
    """candidates (v) with encoding, length class and p-value bin; rows without an encoding go."""
    c = candidates.withColumn("enc", encoding(F.col("v"))).filter("enc is not null")
    c = c.withColumns({"letters": F.element_at(F.create_map(*[F.lit(x) for kv in ALPHABETS.items() for x in kv]), F.col("enc")), "n": F.length("v").cast("double")})
    c = c.withColumn("size", F.length("letters").cast("double"))
    codes = F.transform(F.filter(F.split("v", ""), lambda x: x != ""), lambda x: F.instr(F.col("letters"), x).cast("double"))
    c = c.withColumn("code", codes)
    sums = F.aggregate(F.array_distinct("code"), F.lit(0.0), lambda a, d: a + F.pow(F.size(F.filter("code", lambda y: y == d)).cast("double"), F.lit(2.0)))
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda a, y: a + y)
    c = c.withColumns(
        {
            "squares": sums,
            "high": add(F.transform("code", lambda x: (x > F.col("size") / 2).cast("double"))),
            "runs": 1 + add(F.transform("code", lambda x, i: F.when(i > 0, ((x > F.col("size") / 2) != (F.get(F.col("code"), i - 1) > F.col("size") / 2)).cast("double")).otherwise(0.0))),
            "mean": add(F.col("code")) / F.col("n"),
        }
    )
    c = c.withColumns({"var": add(F.transform("code", lambda x: (x - F.col("mean")) * (x - F.col("mean")))), "cov": add(F.transform("code", lambda x, i: F.when(i > 0, (x - F.col("mean")) * (F.get(F.col("code"), i - 1) - F.col("mean"))).otherwise(0.0)))})
    n, k, low = F.col("n"), F.col("size"), F.col("n") - F.col("high")
    chi = (F.col("squares") * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    expect = 2 * F.col("high") * low / n + 1
    spread = F.sqrt((expect - 1) * (expect - 2) / (n - 1))
    runs = F.when((F.col("high") > 0) & (low > 0) & (expect > 2), F.abs(F.col("runs") - expect) / spread).otherwise(F.sqrt(n))
    serial = F.when(F.col("var") > 0, F.abs(F.col("cov") / F.col("var")) * F.sqrt(n)).otherwise(F.sqrt(n))
    p = 3 * F.least(upper_tail(chi), 2 * upper_tail(runs), 2 * upper_tail(serial))
    bin_ = F.least(F.lit(MOST_BINS), F.floor(-F.log10(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-300))) * BINS_PER_DECADE)).cast("int")
    return c.withColumns({"stratum": F.concat_ws(":", "enc", F.floor(F.log2("n")).cast("string")), "bin": bin_})


def structured_from(tested: DataFrame, level: float) -> dict[str, int]:
    """Per stratum the least bin whose p-values the step-up procedure rejects; strata without rejection are absent."""
    counts: dict[str, dict[int, int]] = {}
    for r in tested.groupBy("stratum", "bin").agg(F.count("*").alias("n")).collect():  # at most strata * (MOST_BINS + 1) rows
        counts.setdefault(r["stratum"], {})[r["bin"]] = r["n"]
    out = {}
    for s, c in sorted(counts.items()):
        total, upto = sum(c.values()), 0
        for b in sorted(c, reverse=True):  # from the smallest p upwards
            upto += c[b]
            if 10 ** (-b / BINS_PER_DECADE) * total <= level * upto:
                out[s] = b
    return out


def scan(docs: DataFrame, parameters: SecretParameters | None = None, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """doc_id, carry columns (named kept_<column>) and found: array<struct<s, e, k, v>> of all spans in order."""
    p = parameters or SecretParameters()
    held = {f"kept_{c}": c for c in carry or []}
    d = base_columns(docs, doc_id=id_col, text=text_col, **held).withColumn("text", F.coalesce("text", F.lit("")))
    spans = d.select(F.monotonically_increasing_id().alias("row"), "doc_id", *held, *[c.alias(k) for k, c in base_spans(F.col("text")).items()], _spans(F.col("text"), CANDIDATE, 3, HINTS["random"]).alias("candidates"))
    # texts are scanned once; all later steps read the spans
    spans = materialise(spans, "secrets")
    base = F.concat("assign", "access", "hex")
    free = F.filter("candidates", lambda c: ~F.exists(F.col("base"), lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
    spans = spans.withColumn("base", base).withColumn("candidates", free)
    rows = spans.select(F.explode("candidates").alias("x")).select("x.v").distinct()
    tested = materialise(battery(rows).select("v", "stratum", "bin"), "battery")
    cut = structured_from(tested, p.level)
    limit = F.create_map(*[F.lit(x) for kv in cut.items() for x in kv]) if cut else None
    random = tested.filter(F.col("bin") < F.coalesce(F.element_at(limit, F.col("stratum")), F.lit(MOST_BINS + 1))) if cut else tested
    # candidates back to their rows: only rows that have any, joined on the candidate's text
    added = spans.select("row", F.explode("candidates").alias("x")).join(random.select(F.col("v").alias("__v")), F.col("x.v") == F.col("__v")).groupBy("row").agg(F.collect_list("x").alias("random"))
    added = materialise(added, "random")
    few = added.agg(F.count("*").alias("n"), F.sum(F.size("random")).alias("spans")).first()
    small = (few["spans"] or 0) + few["n"] <= BROADCAST_SPANS  # else both sides are shuffled on the row
    out = spans.join(F.broadcast(added) if small else added, "row", "left").withColumn("random", F.coalesce("random", F.array().cast("array<struct<s:int,e:int,k:int,v:string>>")))
    by_start = F.sort_array(F.concat("base", "random"))
    return out.select("doc_id", *held, "assign", "access", "hex", F.sort_array("base").alias("base"), by_start.alias("found"))


def joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame, parameters: SecretParameters | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans)."""
    s = scan(docs, parameters, id_col, text_col)
    # sort_array orders by start, then end; equal starts must follow the order of kinds
    order = lambda a: F.transform(F.sort_array(F.transform(a, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))), lambda x: x)
    size = lambda c: F.size(c).cast("long")
    return s.select("doc_id", size("assign").alias("n_assign"), size("access").alias("n_access"), size("hex").alias("n_hex"), F.sha2(joined(order(F.col("base"))), 256).alias("base_sha256"), joined(order(F.col("found"))).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", parameters: SecretParameters | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span of its text replaced by mark; overlapping spans are replaced as one."""
    s = scan(docs, parameters, id_col, text_col, carry=list(docs.columns))
    text = F.col(f"kept_{text_col}")
    cut = F.aggregate(
        F.col("found"),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.when(x["e"] <= a["at"], a).otherwise(F.struct(x["e"].alias("at"), F.when(x["s"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.substring(text, a["at"] + 1, x["s"] - a["at"]), F.lit(mark))).alias("out"))),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
    return s.select(*[F.when(text.isNull() | (F.size("found") == 0), text).otherwise(cut).alias(c) if c == text_col else F.col(f"kept_{c}").alias(c) for c in docs.columns])
