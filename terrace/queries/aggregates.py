"""Aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions.grouped import moments, weighted_mean
from terrace.queries import Book, table

BOOK = Book()


@BOOK.add("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
       round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
       round(avg(l_quantity), 6) AS avg_qty, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan, partial aggregates, a shuffle of a few groups."""
    line = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz '2001-09-02 00:00:00'")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return line.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
        F.round(F.sum(price), 2).alias("sum_disc_price"),
        F.round(F.sum(price * (1 + F.col("l_tax"))), 2).alias("sum_charge"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
        F.count("*").alias("count_order"),
    )


@BOOK.add("""
SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(*) AS n
FROM lineitem GROUP BY ALL""")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct counts in one pass (an Expand)."""
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"), F.count("*").alias("n"))


BOOK.sql(
    "filtered_aggregates",
    """SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, count(*) FILTER (WHERE value <= 50) AS low,
       round(sum(value) FILTER (WHERE user_id % 2 = 0), 4) AS even_total FROM events GROUP BY ALL""",
    """SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, count(*) FILTER (WHERE value <= 50) AS low,
       round(sum(value) FILTER (WHERE user_id % 2 = 0), 4) AS even_total FROM {events} GROUP BY event_type""",
    "events",
)
BOOK.sql(
    "grouping_sets",
    """SELECT c_nationkey, c_mktsegment, CAST(grouping_id(c_nationkey, c_mktsegment) AS BIGINT) AS level, count(*) AS n,
       round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY GROUPING SETS ((c_nationkey, c_mktsegment), (c_mktsegment), ())""",
    """SELECT c_nationkey, c_mktsegment, CAST(grouping_id(c_nationkey, c_mktsegment) AS BIGINT) AS level, count(*) AS n,
       round(sum(c_acctbal), 2) AS balance FROM {customer} GROUP BY GROUPING SETS ((c_nationkey, c_mktsegment), (c_mktsegment), ())""",
    "customer",
)


@BOOK.add("""
SELECT o_orderstatus, o_orderpriority, CAST(grouping_id(o_orderstatus, o_orderpriority) AS BIGINT) AS level, count(*) AS n
FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def order_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"))


@BOOK.add("""
SELECT p_brand, p_type, count(*) AS n, round(avg(p_retailprice), 8) AS price FROM part GROUP BY ROLLUP (p_brand, p_type)""")
def part_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").rollup("p_brand", "p_type").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 8).alias("price"))


@BOOK.add("""
SELECT l_linestatus, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_extendedprice), 2) AS variance,
       median(l_quantity) AS mid, quantile_disc(l_quantity, 0.9) AS p90, round(corr(l_quantity, l_extendedprice), 8) AS r,
       min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY ALL""")
def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(
        F.round(F.stddev_samp("l_quantity"), 6).alias("sd"),
        F.round(F.var_pop("l_extendedprice"), 2).alias("variance"),
        F.median("l_quantity").alias("mid"),
        F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY l_quantity)").alias("p90"),
        F.round(F.corr("l_quantity", "l_extendedprice"), 8).alias("r"),
        F.min("l_shipdate").alias("first_ship"),
        F.max("l_shipdate").alias("last_ship"),
    )


@BOOK.add("""
SELECT user_id % 50 AS bucket, bool_and(value > 1) AS all_high, bool_or(value > 99) AS any_top, bit_xor(event_id) AS mix,
       arg_max(event_id, value) AS best, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS clicks
FROM events GROUP BY ALL""")
def logical_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.groupBy((F.col("user_id") % 50).alias("bucket")).agg(
        F.bool_and(F.col("value") > 1).alias("all_high"),
        F.bool_or(F.col("value") > 99).alias("any_top"),
        F.bit_xor("event_id").alias("mix"),
        F.max_by("event_id", "value").alias("best"),
        F.count_if(F.col("event_type") == "click").alias("clicks"),
    )


@BOOK.add("""
SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, count(*) AS n FROM nation GROUP BY ALL""")
def listed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("names"), F.count("*").alias("n"))


@BOOK.add("""
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(skewness(value), 6) AS skewness,
       round(kurtosis_pop(value), 6) AS kurtosis FROM events GROUP BY ALL""")
def event_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = moments(table(spark, sf_dir, "events"), ["event_type"], "value")
    return found.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("mean", "skewness", "kurtosis")))


@BOOK.add("""
SELECT l_suppkey, round(sum(l_discount * l_quantity) / sum(l_quantity), 8) AS discount FROM lineitem GROUP BY ALL""")
def weighted_discount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grouped pandas aggregate; its rows move by the group, so it is for many groups, not for hot ones."""
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy("l_suppkey").agg(weighted_mean("l_discount", "l_quantity").alias("w")).select("l_suppkey", F.round("w", 8).alias("discount"))


@BOOK.add(None)
def approximate_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HyperLogLog sketches by month, merged by priority; tests hold them within 5 % of the exact numbers."""
    parts = table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.month("o_orderdate").alias("m")).agg(F.hll_sketch_agg("o_custkey", F.lit(14)).alias("s"))
    return parts.groupBy("o_orderpriority").agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("customers"))
