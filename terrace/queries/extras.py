"""Further aggregates, windows, set operations, functions, formats and user-defined functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  makes pa.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from terrace.operators.tables import hash_sample
from terrace.queries import Book, table
from terrace.sources import files

BOOK = Book()


@BOOK.add("""
SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.25), 6) AS lower_price, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 2) AS base, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY ALL""")
def supplier_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.round(F.percentile("l_extendedprice", 0.25), 6).alias("lower_price"),
        F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"),
        F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 2).alias("base"),
        F.round(F.regr_r2("l_extendedprice", "l_quantity"), 6).alias("r2"),
    )


@BOOK.add("SELECT user_id % 10 AS digit, mode(event_type) AS usual FROM (SELECT user_id, event_type FROM events UNION ALL SELECT user_id, 'view' FROM events) GROUP BY ALL")
def usual_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mode: the counts by value are partial sums, so no group is gathered."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type")
    both = events.union(events.select("user_id", F.lit("view")))
    return both.groupBy((F.col("user_id") % 10).alias("digit")).agg(F.mode("event_type").alias("usual"))


@BOOK.add(None)
def sketched_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates from sketches of bounded size: HyperLogLog++, theta, count-min and the most frequent values."""
    events = table(spark, sf_dir, "events").withColumn("user", F.col("user_id").cast("string"))
    return events.groupBy("event_type").agg(
        F.approx_count_distinct("user_id", 0.02).alias("users_hll"),
        F.theta_sketch_estimate(F.theta_sketch_agg("user_id", F.lit(12))).alias("users_theta"),
        F.hex(F.count_min_sketch("user_id", F.lit(0.01), F.lit(0.95), F.lit(1))).alias("user_counts"),
        F.expr("approx_top_k(user, 3)").alias("most"),
    )


@BOOK.add("""
SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW), 2) AS others,
       max(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS last_peer FROM orders""")
def orders_but_this(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXCLUDE CURRENT ROW as the frame's sum less the row's own value; the default frame ends with the row's peers."""
    all_ = Window.partitionBy("o_custkey")
    upto = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    others = F.when(F.count("*").over(all_) > 1, F.sum("o_totalprice").over(all_) - F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(others, 2).alias("others"), F.max("o_orderkey").over(upto).alias("last_peer"))


@BOOK.add("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, last_value(l_extendedprice) OVER
  (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS so_far FROM lineitem""")
def last_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.last_value("l_extendedprice").over(w).alias("so_far"))


@BOOK.add("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def except_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select("s_nationkey")
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).subtract(suppliers)


@BOOK.add("SELECT a.r_name AS a, b.n_name AS b FROM region a CROSS JOIN nation b")
def region_nation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cross join, of two dimensions of fixed size."""
    return table(spark, sf_dir, "region").select(F.col("r_name").alias("a")).crossJoin(table(spark, sf_dir, "nation").select(F.col("n_name").alias("b")))


@BOOK.add("""SELECT 'r_name' AS key, max(r_name) FILTER (WHERE r_regionkey = 0) AS "0", max(r_name) FILTER (WHERE r_regionkey = 1) AS "1", max(r_name) FILTER (WHERE r_regionkey = 2) AS "2",
max(r_name) FILTER (WHERE r_regionkey = 3) AS "3", max(r_name) FILTER (WHERE r_regionkey = 4) AS "4" FROM region""")
def transposed_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select("r_regionkey", "r_name").transpose()


@BOOK.add("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return windows.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@BOOK.add("""
SELECT w AS window_start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR, time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 2 HOUR]) AS w FROM events) GROUP BY ALL""")
def sliding_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = table(spark, sf_dir, "events").groupBy(F.window("ts", "3 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return windows.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n")


@BOOK.add("""
SELECT c_custkey, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS title, url_encode(c_name) AS encoded, url_decode(url_encode(c_name)) AS decoded,
       regexp_replace(regexp_replace(regexp_replace(c_name, '[A-Z]', 'X', 'g'), '[a-wyz]', 'x', 'g'), '[0-9]', 'n', 'g') AS hidden, lower(c_mktsegment) = 'building' AS builds FROM customer""")
def more_string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.initcap("c_mktsegment").alias("title"),
        F.url_encode("c_name").alias("encoded"),
        F.url_decode(F.url_encode("c_name")).alias("decoded"),
        F.mask("c_name").alias("hidden"),
        (F.collate("c_mktsegment", "UTF8_LCASE") == F.lit("building")).alias("builds"),
    )


@BOOK.add(None)
def sounds_and_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.soundex("c_mktsegment").alias("sound"), F.sentences(F.concat_ws(". ", "c_mktsegment", "c_name")).alias("words"))


@BOOK.add("SELECT event_id, user_id AS k, event_type AS kind FROM events")
def xml_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.to_xml(F.struct(F.col("user_id").alias("k"), F.col("event_type").alias("kind")))
    return table(spark, sf_dir, "events").select("event_id", F.from_xml(made, "k long, kind string").alias("x")).select("event_id", "x.k", "x.kind")


@BOOK.add("SELECT f AS format, p_partkey, p_name, p_size, p_retailprice FROM part, (VALUES ('parquet'), ('orc'), ('json'), ('csv'), ('xml')) t(f)")
def formats_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written and read back in each format; formats without a schema get it on reading."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    out = None
    for fmt in ("parquet", "orc", "json", "csv", "xml"):
        options = {"rowTag": "part"} if fmt == "xml" else {}
        path = files.scratch(spark, fmt)
        files.write(part, path, fmt, **options)
        back = files.read(spark, path, fmt, part.schema, **options).select(F.lit(fmt).alias("format"), *part.columns)
        out = back if out is None else out.union(back)
    return out


@BOOK.add("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def partitioned_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written a directory a status; the filter reads one."""
    path = files.scratch(spark, "orders")
    files.write(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), path, partition_by=["o_orderstatus"])
    return files.read(spark, path).where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@BOOK.add("SELECT count(*) AS n FROM nation")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = files.scratch(spark, "lines")
    files.write(table(spark, sf_dir, "nation").select(F.col("n_name").alias("value")), path, "text")
    return files.read(spark, path, "text").agg(F.count("value").alias("n"))


@BOOK.add(None)
def sampled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the orders by a hash of the key: a sampling operator, the same rows on every run."""
    return hash_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 0.1)


@BOOK.add(None)
def stratified_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of rows by kind: Spark's own stratified sample."""
    return table(spark, sf_dir, "events").select("event_id", "event_type").sampleBy("event_type", {"purchase": 0.5, "error": 0.2}, seed=7)


@F.arrow_udf(DoubleType())
def doubled(x: pa.Array) -> pa.Array:
    return pa.compute.multiply(x, 2.0)


@BOOK.add("""
SELECT p_partkey, p_retailprice * 2 AS twice, CAST(length(p_name) AS BIGINT) AS letters, round(p_retailprice - avg(p_retailprice) OVER (PARTITION BY p_brand, p_size), 4) AS above FROM part""")
def python_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An Arrow function, a pandas function of batches, and one of many small groups."""

    def letters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(letters=b["p_name"].str.len().astype("int64"))

    def centred(group: pd.DataFrame) -> pd.DataFrame:
        return group.assign(above=group["p_retailprice"] - group["p_retailprice"].mean())

    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice", doubled("p_retailprice").alias("twice"))
    kinds = "p_partkey long, p_name string, p_brand string, p_size int, p_retailprice double, twice double, letters long"
    grouped = part.mapInPandas(letters, kinds).groupBy("p_brand", "p_size").applyInPandas(centred, f"{kinds}, above double")
    return grouped.select("p_partkey", "twice", "letters", F.round("above", 4).alias("above"))
