"""Windows, top-k and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.operators.windows import distinct_over, fill_forward, groups_frame_sum, sessions, top_k
from terrace.queries import Book, table

BOOK = Book()


@BOOK.add("""
SELECT * FROM (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, CAST(row_number() OVER
  (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_quantity) AS INTEGER) AS rn FROM lineitem) WHERE rn <= 3""")
def top_lines_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    order = [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_quantity")]
    return top_k(line, ["l_suppkey"], order, 3).drop("l_quantity")


@BOOK.add("""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def dearest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25)


@BOOK.add("""
SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS running, round(avg(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving,
       lag(o_totalprice) OVER w AS before, lead(o_orderkey, 2) OVER w AS later, nth_value(o_totalprice, 2) OVER w AS second
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def running_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.round(F.sum("o_totalprice").over(w), 2).alias("running"),
        F.round(F.avg("o_totalprice").over(w.rowsBetween(-2, 0)), 4).alias("moving"),
        F.lag("o_totalprice").over(w).alias("before"),
        F.lead("o_orderkey", 2).over(w).alias("later"),
        F.nth_value("o_totalprice", 2).over(w).alias("second"),
    )


@BOOK.add("""
SELECT p_partkey, CAST(rank() OVER w AS INTEGER) AS r, CAST(dense_rank() OVER w AS INTEGER) AS d, round(percent_rank() OVER w, 8) AS pr,
       round(cume_dist() OVER w, 8) AS cd, CAST(ntile(4) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS INTEGER) AS quarter
FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)""")
def part_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.rank().over(w).alias("r"),
        F.dense_rank().over(w).alias("d"),
        F.round(F.percent_rank().over(w), 8).alias("pr"),
        F.round(F.cume_dist().over(w), 8).alias("cd"),
        F.ntile(4).over(Window.partitionBy("p_brand").orderBy("p_size", "p_partkey")).alias("quarter"),
    )


BOOK.sql(
    "day_totals",
    """SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW), 4) AS total FROM events""",
    """SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW), 4) AS total FROM {events}""",
    "events",
)


@BOOK.add("""
SELECT p_partkey, round(sum(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW), 2) AS near FROM part""")
def peer_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups_frame_sum(table(spark, sf_dir, "part"), ["p_brand"], "p_size", "p_retailprice", 1, "near").select("p_partkey", F.round("near", 2).alias("near"))


@BOOK.add("""
SELECT event_id, CAST(count(DISTINCT event_type) OVER (PARTITION BY user_id) AS BIGINT) AS kinds,
       last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_purchase FROM events""")
def user_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("paid", F.when(F.col("event_type") == "purchase", F.col("value")))
    filled = fill_forward(events, ["user_id"], ["ts", "event_id"], "paid", "last_purchase")
    return filled.select("event_id", distinct_over("event_type", ["user_id"]).alias("kinds"), "last_purchase")


@BOOK.add("""
WITH marked AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
numbered AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM marked)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM numbered GROUP BY user_id, s""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", "30 minutes")
