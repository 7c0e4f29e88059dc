"""Projections, pivots, nested data and recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.queries import Book, table

BOOK = Book()
STATUS = ["F", "O", "P"]


@BOOK.add("""
SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band
FROM orders WHERE o_orderpriority LIKE '1%' AND o_orderdate >= TIMESTAMP '1998-01-01'""")
def order_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both predicates reach the scan; three columns are read."""
    orders = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").like("1%") & (F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")))
    price = F.col("o_totalprice")
    return orders.select("o_orderkey", F.when(price > 300000, "high").when(price > 100000, "mid").otherwise("low").alias("band"))


@BOOK.add("""
SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O,
       count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY ALL""")
def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the values given, no extra pass looks for them."""
    found = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", STATUS).count()
    return found.select("o_orderpriority", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in STATUS))


@BOOK.add("""
SELECT l_orderkey, l_linenumber, l_partkey, measure, amount FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_discount AS discount, l_tax AS tax FROM lineitem)
UNPIVOT (amount FOR measure IN (discount, tax))""")
def line_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return line.unpivot(["l_orderkey", "l_linenumber", "l_partkey"], ["discount", "tax"], "measure", "amount")


@BOOK.add("""
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'signup'""")
def signup_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("event_type = 'signup'")
    return events.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@BOOK.add("""
SELECT vec_id, label, i - 1 AS i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) t(i)""")
def dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).select("vec_id", "label", F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x"))


@BOOK.add("""
SELECT o_custkey, list_sort(list_distinct(list(o_orderstatus))) AS states, map_keys(map {'n': count(*)})[1] AS key, count(*) AS n,
       CAST(list_sum(list_transform(list(o_orderkey), lambda x: x % 7)) AS BIGINT) AS sevens FROM orders GROUP BY o_custkey""")
def nested_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s"), F.collect_list("o_orderkey").alias("keys"), F.count("*").alias("n"))
    sevens = F.aggregate(F.transform("keys", lambda x: x % 7), F.lit(0).cast("long"), lambda a, x: a + x)
    return grouped.select("o_custkey", F.sort_array("s").alias("states"), F.map_keys(F.create_map(F.lit("n"), "n"))[0].alias("key"), "n", sevens.alias("sevens"))


_RECURSION = "WITH RECURSIVE t(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM t WHERE n < 50) SELECT n, total FROM t"
BOOK.sql("triangular_numbers", _RECURSION, _RECURSION)
BOOK.sql(
    "piped_query",
    "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey > 3 GROUP BY r_name",
    "FROM {nation} |> JOIN {region} ON n_regionkey = r_regionkey |> WHERE n_nationkey > 3 |> AGGREGATE count(*) AS n GROUP BY r_name",
    "nation",
    "region",
)
