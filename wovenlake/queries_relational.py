"""Queries of the relational core and of federated Bases over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import mutations, relational
from .registry import Registry
from .sources import scratch, versioned
from .sources.readers import partitions, table

query = Registry()


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_all(spark: SparkSession, d: str) -> DataFrame:
    return relational.sorted_columns(table(spark, d, "nation"))


@query("SELECT n_name AS name, n_regionkey AS region, n_nationkey * 2 AS twice FROM nation")
def project_alias(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"), (F.col("n_nationkey") * 2).alias("twice"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filter_project(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.filter((F.col("o_totalprice") > 200000) & (F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR NOT (o_totalprice > 100000))")
def filter_not(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").filter(~((F.col("o_orderstatus") == "F") | ~(F.col("o_totalprice") > 100000))).select("o_orderkey")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000")
def param_query(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("SELECT c_custkey, c_acctbal FROM {customer} WHERE c_mktsegment = :segment AND c_acctbal > :least", args={"segment": "BUILDING", "least": 5000}, customer=table(spark, d, "customer"))


@query("""SELECT c_mktsegment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000
    GROUP BY c_mktsegment HAVING count(*) > 1""")
def join_agg(spark: SparkSession, d: str) -> DataFrame:
    """Revenue of orders above 1000 per market segment, large segments first."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    j = o.filter(F.col("o_totalprice") > 1000).join(c, F.col("o_custkey") == F.col("c_custkey"))
    g = j.groupBy("c_mktsegment").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))
    return g.filter("n_orders > 1").orderBy(F.desc("revenue"), "c_mktsegment")


@query("SELECT a.n_nationkey AS left_key, b.n_nationkey AS right_key FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def join_inner(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "nation").alias("lhs"), table(spark, d, "nation").alias("rhs")
    return a.join(b, F.col("lhs.n_regionkey") == F.col("rhs.n_regionkey")).select(F.col("lhs.n_nationkey").alias("left_key"), F.col("rhs.n_nationkey").alias("right_key"))


@query("SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey GROUP BY c_custkey")
def join_left(spark: SparkSession, d: str) -> DataFrame:
    """Extension: outer join. Orders are counted before the join, so the shuffle carries one row a customer."""
    n = table(spark, d, "orders").filter("o_totalprice > 400000").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return table(spark, d, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_anti(spark: SparkSession, d: str) -> DataFrame:
    """Extension: anti join."""
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT count(*) AS n FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 100000)")
def subquery_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").filter("o_totalprice > 100000").select("o_custkey").distinct().agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, sum(l_linenumber)::BIGINT AS total, avg(l_linenumber) AS mean, min(l_shipdate) AS first_day, max(l_quantity) AS most FROM lineitem")
def agg_global(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    relational.check_numeric(li, ["l_linenumber"])
    return li.agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("total"), F.avg("l_linenumber").alias("mean"), F.min("l_shipdate").alias("first_day"), F.max("l_quantity").alias("most"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
    round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY ALL""")
def agg_group(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"))


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, sum(DISTINCT l_linenumber)::BIGINT AS numbers, avg(DISTINCT l_linenumber) AS mean FROM lineitem GROUP BY 1")
def agg_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.sum_distinct("l_linenumber").alias("numbers"), F.expr("avg(DISTINCT l_linenumber)").alias("mean"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def agg_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Extension: grouping sets."""
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_order(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct().orderBy("o_orderstatus", "o_orderpriority")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def order_global(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
def topk(spark: SparkSession, d: str) -> DataFrame:
    return relational.limited(table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey"), 10, 5)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 21")
def page_first(spark: SparkSession, d: str) -> DataFrame:
    return relational.page(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), [("o_orderdate", True), ("o_orderkey", True)], 20)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 300000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 21")
def page_keyset(spark: SparkSession, d: str) -> DataFrame:
    """The page behind (300000.0, -1): the cursor becomes a filter at the scan."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice").filter("o_totalprice <> 300000")
    return relational.page(o, [("o_totalprice", False), ("o_orderkey", True)], 20, [300000.0, -1])


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS position FROM orders WHERE o_totalprice > 450000 QUALIFY position >= 100 AND position < 200")
def page_durable(spark: SparkSession, d: str) -> DataFrame:
    """Second page of 100 rows of a spooled result; later writes can't change it."""
    folder = f"{scratch.shared_folder(spark)}/wovenlake/spool-{uuid.uuid4().hex}"
    versioned.spool_pages(table(spark, d, "orders").filter("o_totalprice > 450000").select("o_orderkey"), folder, ["o_orderkey"], 100)
    return versioned.read_page(spark, folder, 1).select("o_orderkey", "position")


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'")
def partition_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter("event_type = 'purchase'").select("event_id", "user_id", "value")


@query("SELECT event_type, count(*) AS n_rows FROM events GROUP BY 1")
def partition_catalog(spark: SparkSession, d: str) -> DataFrame:
    return partitions(table(spark, d, "events"), ["event_type"])


@query("(SELECT n_regionkey AS k FROM nation WHERE n_nationkey < 20 INTERSECT SELECT r_regionkey FROM region) EXCEPT (SELECT 2) UNION (SELECT 99)")
def set_ops(spark: SparkSession, d: str) -> DataFrame:
    """Extension: INTERSECT, EXCEPT and UNION DISTINCT."""
    k = table(spark, d, "nation").filter("n_nationkey < 20").select(F.col("n_regionkey").alias("k"))
    return k.intersect(table(spark, d, "region").select("r_regionkey")).subtract(spark.sql("SELECT 2 AS k")).union(spark.sql("SELECT 99 AS k")).distinct()


def bases(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Two Bases of customers: even and odd nations."""
    c = table(spark, d, "customer")
    return {"primary": c.filter("c_nationkey % 2 = 0"), "secondary": c.filter("c_nationkey % 2 = 1")}


_BASES = "c AS (SELECT *, CASE WHEN c_nationkey % 2 = 0 THEN 'primary' ELSE 'secondary' END AS base_id FROM customer)"


@query(f"WITH {_BASES} SELECT c_custkey, c_mktsegment, base_id FROM c")
def composition_scan(spark: SparkSession, d: str) -> DataFrame:
    return relational.union_members(bases(spark, d)).select("c_custkey", "c_mktsegment", "base_id")


@query(f"""WITH {_BASES} SELECT base_id, c_mktsegment, n_customers, best_key FROM (SELECT base_id, c_mktsegment, count(*) AS n_customers, max(c_custkey) AS best_key FROM c GROUP BY 1, 2)""")
def base_local_join(spark: SparkSession, d: str) -> DataFrame:
    """Each Base joins only with itself: the Base is part of the key."""
    m = relational.union_members(bases(spark, d))
    n = m.groupBy("base_id", "c_mktsegment").agg(F.count("*").alias("n_customers"))
    best = m.groupBy("base_id", "c_mktsegment").agg(F.max("c_custkey").alias("best_key"))
    return n.join(best, ["base_id", "c_mktsegment"])


@query("""SELECT a.c_mktsegment, a.k AS left_key, b.k AS right_key, 'primary,secondary' AS origins FROM
    (SELECT c_mktsegment, max(c_custkey) AS k FROM customer WHERE c_nationkey % 2 = 0 GROUP BY 1) a JOIN
    (SELECT c_mktsegment, max(c_custkey) AS k FROM customer WHERE c_nationkey % 2 = 1 GROUP BY 1) b USING (c_mktsegment)""")
def cross_base_join(spark: SparkSession, d: str) -> DataFrame:
    b = bases(spark, d)
    l, r = (b[k].groupBy("c_mktsegment").agg(F.max("c_custkey").alias(n)) for k, n in (("primary", "left_key"), ("secondary", "right_key")))
    return l.join(r, "c_mktsegment").withColumn("origins", F.array_join(F.array_sort(F.array(F.lit("secondary"), F.lit("primary"))), ","))


@query(f"WITH {_BASES} SELECT count(*) AS n, sum(c_custkey)::BIGINT AS total, avg(c_custkey) AS mean, min(c_custkey) AS least, max(c_custkey) AS most, array_to_string(list_sort(list(DISTINCT base_id)), ',') AS origins FROM c")
def composition_agg(spark: SparkSession, d: str) -> DataFrame:
    m = relational.union_members(bases(spark, d))
    relational.check_numeric(m, ["c_custkey"])
    k = F.col("c_custkey")
    return m.agg(F.count("*").alias("n"), F.sum(k).alias("total"), F.avg(k).alias("mean"), F.min(k).alias("least"), F.max(k).alias("most"), F.array_join(F.array_sort(F.collect_set("base_id")), ",").alias("origins"))


@query(f"WITH {_BASES} SELECT c_mktsegment, c_nationkey % 7 AS slot, array_to_string(list_sort(list(DISTINCT base_id)), ',') AS origins, count(DISTINCT base_id) > 1 AS derived FROM c GROUP BY 1, 2")
def distinct_provenance(spark: SparkSession, d: str) -> DataFrame:
    m = relational.union_members(bases(spark, d)).select("c_mktsegment", (F.col("c_nationkey") % 7).alias("slot"), "base_id")
    return relational.distinct_with_contributors(m).withColumn("origins", F.array_join("origins", ","))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY')")
def ref_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose customer isn't among those outside one segment."""
    targets = table(spark, d, "customer").filter("c_mktsegment <> 'MACHINERY'")
    return mutations.dangling(table(spark, d, "orders"), "o_custkey", targets, "c_custkey").select("o_orderkey", "o_custkey")


@query("""SELECT 'r' || r_regionkey AS node, 0 AS depth FROM region WHERE r_regionkey = 1 UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation WHERE n_regionkey = 1
    UNION ALL SELECT 'c' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1
    UNION ALL SELECT 'o' || o_orderkey, 3 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1""")
def ref_cascade(spark: SparkSession, d: str) -> DataFrame:
    """What goes with region 1 under cascade rules."""
    r = lambda name, child, parent, a, b: table(spark, d, name).select(F.concat(F.lit(a), child).alias("child"), F.concat(F.lit(b), parent).alias("parent"))
    refs = r("nation", "n_nationkey", "n_regionkey", "n", "r").unionByName(r("customer", "c_custkey", "c_nationkey", "c", "n")).unionByName(r("orders", "o_orderkey", "o_custkey", "o", "c"))
    return mutations.cascade(refs, spark.createDataFrame([("r1",)], "node string"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 10 <> 9
    UNION ALL SELECT -1 - r_regionkey, 1.0, r_name FROM region""")
def entity_changes(spark: SparkSession, d: str) -> DataFrame:
    """One atomic set of inserts, updates and deletes as a full join with the old state."""
    base = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    change = base.filter("c_custkey % 10 = 9 OR c_custkey % 3 = 0").withColumn("action", F.when(F.col("c_custkey") % 10 == 9, "delete").otherwise("update")).withColumn("c_acctbal", F.lit(0.0))
    new = table(spark, d, "region").select((-1 - F.col("r_regionkey")).cast("long").alias("c_custkey"), F.lit(1.0).alias("c_acctbal"), F.col("r_name").alias("c_mktsegment"), F.lit("insert").alias("action"))
    return mutations.apply_changes(base, change.unionByName(new), "c_custkey")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN -1 ELSE o_custkey END AS o_custkey FROM orders")
def delete_nullify(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey")
    left = mutations.delete_with_rule(c, "c_custkey", c.filter("c_custkey % 5 = 0"), table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "nullify")[1]
    return left.select("o_orderkey", F.coalesce("o_custkey", F.lit(-1)).alias("o_custkey"))


@query("""SELECT * FROM (VALUES ('added', 'c_tier', TRUE), ('dropped', 'c_name', FALSE), ('retyped', 'c_acctbal', FALSE), ('retyped', 'c_nationkey', TRUE)) t("change", "column", compatible)""")
def schema_compat(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "customer")
    new = old.drop("c_name").withColumns({"c_nationkey": F.col("c_nationkey").cast("long"), "c_acctbal": F.col("c_acctbal").cast("string"), "c_tier": F.lit("a")})
    return spark.createDataFrame(mutations.schema_changes(old, new), "change string, column string, compatible boolean")


QUERIES, ORACLES = query.queries, query.oracles
