"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.operators.joins import asof_join, range_join, salted_join
from terrace.operators.windows import top_k
from terrace.queries import Book, table

BOOK = Book()


@BOOK.add("""
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' GROUP BY ALL""")
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact tables meet once on the order key; dimensions are joined after a partial sum by customer."""
    orders = table(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz '1997-01-01 00:00:00' and o_orderdate < timestamp_ntz '1999-01-01 00:00:00'")
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("price"))
    sold = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum("price").alias("price"), F.count("*").alias("n"))
    named = sold.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.groupBy("n_name").agg(F.round(F.sum("price"), 2).alias("revenue"), F.sum("n").alias("n"))


@BOOK.add("""
SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49) GROUP BY ALL""")
def orders_with_large_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "lineitem").where("l_quantity > 49")
    orders = table(spark, sf_dir, "orders")
    return orders.join(large, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@BOOK.add("""
SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def orders_without_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return orders.join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")


@BOOK.add("""
SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS orders, max(o_totalprice) AS most FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL""")
def orders_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are summed up before the outer join, so the join moves a row a customer."""
    sums = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("most"))
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    return customers.join(sums, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0).cast("long")).alias("orders"), "most")


@BOOK.add("""
SELECT coalesce(c, s) AS nation, c IS NULL AS no_customer, s IS NULL AS no_supplier, customers, suppliers
FROM (SELECT c_nationkey AS c, count(*) AS customers FROM customer WHERE c_acctbal > 5000 GROUP BY ALL)
FULL JOIN (SELECT s_nationkey AS s, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY ALL) ON c = s""")
def rich_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("c")).agg(F.count("*").alias("customers"))
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("s")).agg(F.count("*").alias("suppliers"))
    return c.join(s, F.col("c") == F.col("s"), "full").select(F.coalesce("c", "s").alias("nation"), F.col("c").isNull().alias("no_customer"), F.col("s").isNull().alias("no_supplier"), "customers", "suppliers")


@BOOK.add("""
SELECT c.event_id, c.user_id, v.event_id AS seen_id, v.value AS seen_value
FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v
  ON c.user_id = v.user_id AND c.ts >= v.ts""")
def last_view_before_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", "event_type")
    views = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("seen_id"), F.col("value").alias("seen_value"))
    return asof_join(events.where("event_type = 'click'"), views, "ts", ["user_id"], ["seen_id", "seen_value"]).select("event_id", "user_id", "seen_id", "seen_value")


@BOOK.add("""
SELECT p_brand, band, count(*) AS n FROM part JOIN (SELECT band, 850.0 + band * 120.5 AS lo, 850.0 + band * 120.5 + 200.25 AS hi FROM range(10) t(band))
  ON p_retailprice >= lo AND p_retailprice < hi GROUP BY ALL""")
def price_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = spark.range(10).select(F.col("id").alias("band"), (850.0 + F.col("id") * 120.5).alias("lo"), (850.0 + F.col("id") * 120.5 + 200.25).alias("hi"))
    return range_join(table(spark, sf_dir, "part"), bands, "p_retailprice", "lo", "hi", 200.0).groupBy("p_brand", "band").agg(F.count("*").alias("n"))


@BOOK.add("""
SELECT s_nationkey, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL""")
def sales_by_supplier_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_orderkey", "l_extendedprice")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return salted_join(line, supplier, "s_suppkey", 4, F.col("l_orderkey")).groupBy("s_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@BOOK.add("""
SELECT c_custkey, o_orderkey, o_totalprice FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey
  ORDER BY o_totalprice DESC, o_orderkey LIMIT 1)""")
def dearest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lateral top-1 as a rank over one shuffle."""
    best = top_k(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 1)
    return best.join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey", "o_totalprice")


BOOK.sql(
    "absent_nations",
    "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)",
    "SELECT n_nationkey, n_name FROM {nation} WHERE n_nationkey NOT IN (SELECT c_nationkey FROM {customer} WHERE c_acctbal > 9900)",
    "nation",
    "customer",
)


@BOOK.add("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).exceptAll(table(spark, sf_dir, "supplier").select("s_nationkey"))


@BOOK.add("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersectAll(table(spark, sf_dir, "supplier").select("s_nationkey"))


@BOOK.add("SELECT o_custkey AS k, 'order' AS kind FROM orders UNION SELECT c_custkey, 'customer' FROM customer")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.lit("order").alias("kind"))
    return a.unionByName(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit("customer").alias("kind"))).distinct()


@BOOK.add("SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0 INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 100000")
def intersect_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("k"))
    return a.intersect(table(spark, sf_dir, "orders").where("o_totalprice > 100000").select("o_custkey"))
