"""Semi-structured data, maps, sketches, user-defined functions, merging and row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions import user
from terrace.operators.tables import upsert, with_row_index
from terrace.queries import Book, table
from terrace.sources import sequence

BOOK = Book()


@BOOK.add("""
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS variant_k, CAST(json_extract(props, '$.k') AS INTEGER) + 1 AS csv_k,
       CAST(json_extract(props, '$.k') AS INTEGER) AS path_k, '{"k":' || CAST(user_id AS VARCHAR) || '}' AS made FROM events""")
def semi_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.variant_get(F.parse_json("props"), "$.k", "int")
    return table(spark, sf_dir, "events").select(
        "event_id",
        k.alias("variant_k"),
        F.from_csv(F.concat_ws(",", k + 1, F.lit("x")), "a int, b string")["a"].alias("csv_k"),
        F.get_json_object("props", "$.k").cast("int").alias("path_k"),
        F.to_json(F.struct(F.col("user_id").alias("k"))).alias("made"),
    )


@BOOK.add("""
SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') * 10 AS f, count(*) FILTER (WHERE o_orderstatus = 'F') > 0 AS has_f,
       count(*) AS n, count(DISTINCT o_orderstatus) AS states FROM orders GROUP BY o_custkey""")
def map_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    maps = counts.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("m"))
    tens = F.transform_values("m", lambda k, v: v * 10)
    total = F.aggregate(F.map_values(F.map_zip_with("m", "m", lambda k, a, b: (a + b) / 2)), F.lit(0.0), lambda a, x: a + x)
    return maps.select("o_custkey", F.coalesce(tens["F"], F.lit(0).cast("long")).alias("f"), F.map_contains_key("m", "F").alias("has_f"), total.cast("long").alias("n"), F.size(F.map_filter("m", lambda k, v: v > 0)).cast("long").alias("states"))


@BOOK.add(None)
def approximate_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians from sketches of bounded size; tests hold them between the exact 47th and 53rd percentiles."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.percentile_approx("value", 0.5, 1000).alias("median"), F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double("value"), F.lit(0.5)).alias("kll_median")
    )


@BOOK.add("SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS host, regexp_extract(url, '^([a-z]+):', 1) AS scheme, coalesce(nullif(regexp_extract(url, '[?]([^#]*)', 1), ''), '') AS query FROM pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda name: F.parse_url("url", F.lit(name))
    return table(spark, sf_dir, "pages").select("page_id", part("HOST").alias("host"), part("PROTOCOL").alias("scheme"), F.coalesce(part("QUERY"), F.lit("")).alias("query"))


@BOOK.add("""
SELECT l_orderkey, l_linenumber, l_partkey, round(sign(l_quantity) * ln(1 + abs(l_quantity)), 8) AS scaled, round(l_extendedprice * (1 - l_discount), 4) AS price,
       list_sum(list_transform(string_split(CAST(l_orderkey AS VARCHAR), ''), lambda c: CAST(c AS INTEGER)))::BIGINT AS digits FROM lineitem""")
def user_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    user.register(spark)
    return spark.sql(
        """SELECT l_orderkey, l_linenumber, l_partkey, round(log_scale(l_quantity), 8) AS scaled, round(discounted(l_extendedprice, l_discount), 4) AS price,
           digit_sum(l_orderkey) AS digits FROM {line}""",
        line=table(spark, sf_dir, "lineitem"),
    )


@BOOK.add("SELECT n_nationkey, n FROM nation, generate_series(1, n_nationkey % 4) t(n)")
def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lateral call of a Python table function."""
    user.register(spark)
    return spark.sql("SELECT n_nationkey, n FROM {nation}, LATERAL spread(1, n_nationkey % 4)", nation=table(spark, sf_dir, "nation"))


@BOOK.add("""
SELECT coalesce(a.k, b.k) AS nation, round(coalesce(x, 0) - coalesce(y, 0), 2) AS difference
FROM (SELECT c_nationkey AS k, sum(c_acctbal) AS x FROM customer GROUP BY ALL) a FULL JOIN (SELECT s_nationkey AS k, sum(s_acctbal) AS y FROM supplier GROUP BY ALL) b ON a.k = b.k""")
def cogrouped_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("v"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("v"))
    return user.cogroup_difference(a, b, "nation", "v").select("nation", F.round("difference", 2).alias("difference"))


@BOOK.add("""
SELECT c_custkey, CASE WHEN c_custkey % 10 = 1 THEN 'MOVED' ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 10 <> 2
UNION ALL SELECT c_custkey + 10000000, 'NEW' FROM customer WHERE c_custkey % 10 = 3""")
def merged_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    row = lambda key, segment, gone, at: base.select(key.alias("c_custkey"), F.lit(segment).alias("segment"), F.lit(gone).alias("gone"), F.lit(at).alias("at"))
    digit, key = F.col("c_custkey") % 10, F.col("c_custkey")
    changes = row(key, "OLD", False, 1).where(digit == 1).union(row(key, "MOVED", False, 2).where(digit == 1)).union(row(key, "X", True, 1).where(digit == 2))
    new = base.where(digit == 3).select((key + 10_000_000).alias("c_custkey"), F.lit("NEW").alias("segment"), F.lit(False).alias("gone"), F.lit(1).alias("at"))
    return upsert(base, changes.union(new), ["c_custkey"], ["at"], "gone")


@BOOK.add("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS place FROM orders")
def order_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey")
    return with_row_index(rows, ["o_totalprice", "o_orderkey"], "place").select("o_orderkey", "place")


@BOOK.add("SELECT i, 7 + 3 * i AS value FROM range(1000) t(i)")
def generated_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    sequence.register(spark)
    return spark.read.format("sequence").option("start", 7).option("step", 3).option("count", 1000).load()


@BOOK.add("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 30")
def page_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").orderBy("o_orderkey").offset(30).limit(20)


@BOOK.add("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderdate FROM orders ORDER BY o_custkey, o_orderdate")
def first_order_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("o_orderdate"))
