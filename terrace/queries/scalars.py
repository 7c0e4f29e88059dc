"""Scalar functions: strings, times, numbers, hashes, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions.vectors import cosine, norm
from terrace.queries import Book, table

BOOK = Book()


@BOOK.add("""
SELECT c_custkey, lower(c_name) AS low, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS padded, replace(c_name, '#', '-') AS dashed,
       CAST(levenshtein(c_name, c_mktsegment) AS INTEGER) AS distance, split_part(c_name, '#', 2) AS part, reverse(c_mktsegment) AS turned,
       substr(c_name, 1, 4) AS head, CAST(instr(c_name, '0') AS INTEGER) AS zero, regexp_extract(c_name, '([0-9]+)', 1) AS digits,
       regexp_replace(c_name, '[0-9]', 'd', 'g') AS masked, md5(c_name) AS hash, sha256(c_name) AS sha FROM customer""")
def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.lower("c_name").alias("low"),
        F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("padded"),
        F.replace("c_name", F.lit("#"), F.lit("-")).alias("dashed"),
        F.levenshtein("c_name", "c_mktsegment").alias("distance"),
        F.split_part("c_name", F.lit("#"), F.lit(2)).alias("part"),
        F.reverse("c_mktsegment").alias("turned"),
        F.substring("c_name", 1, 4).alias("head"),
        F.instr("c_name", "0").alias("zero"),
        F.regexp_extract("c_name", "([0-9]+)", 1).alias("digits"),
        F.regexp_replace("c_name", "[0-9]", "d").alias("masked"),
        F.md5("c_name").alias("hash"),
        F.sha2("c_name", 256).alias("sha"),
    )


@BOOK.add("""
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy,
       CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days,
       CAST(last_day(o_orderdate) AS DATE) AS month_end, CAST(o_orderdate + INTERVAL 3 MONTH AS DATE) AS later, CAST(dayofweek(o_orderdate) AS INTEGER) + 1 AS dow
FROM orders""")
def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.year(d).alias("y"),
        F.month(d).alias("m"),
        F.dayofyear(d).alias("doy"),
        F.trunc(d, "month").alias("month_start"),
        F.datediff(d, F.lit("1995-01-01").cast("date")).alias("days"),
        F.last_day(d).alias("month_end"),
        F.add_months(d, 3).alias("later"),
        F.dayofweek(d).alias("dow"),
    )


@BOOK.add("""
SELECT event_id, round(sqrt(value), 6) AS root, round(ln(value + 1), 6) AS natural, round(log10(value + 1), 6) AS ten, CAST(floor(value) AS BIGINT) AS whole,
       CAST(ceil(value) AS BIGINT) AS up, round(pow(value, 1.5), 4) AS power, user_id % 7 AS rest, CAST(sign(value - 50) AS DOUBLE) AS side,
       CASE WHEN user_id % 5 = 0 THEN NULL ELSE round(value / (user_id % 5), 6) END AS share, greatest(value, 50.0) AS most, least(value, 50.0) AS least
FROM events""")
def number_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, u = F.col("value"), F.col("user_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.round(F.sqrt(v), 6).alias("root"),
        F.round(F.ln(v + 1), 6).alias("natural"),
        F.round(F.log10(v + 1), 6).alias("ten"),
        F.floor(v).alias("whole"),
        F.ceil(v).alias("up"),
        F.round(F.pow(v, F.lit(1.5)), 4).alias("power"),
        (u % 7).alias("rest"),
        F.signum(v - 50).alias("side"),
        F.round(F.try_divide(v, u % 5), 6).alias("share"),
        F.greatest(v, F.lit(50.0)).alias("most"),
        F.least(v, F.lit(50.0)).alias("least"),
    )


@BOOK.add("""
SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS length,
       round(list_max(embedding)::DOUBLE, 6) AS most,
       round(list_sum(list_transform(list_zip(embedding, list_reverse(embedding)), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) / list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS turned FROM embeddings""")
def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(norm(e), 6).alias("length"), F.round(F.array_max(e).cast("double"), 6).alias("most"), F.round(cosine(e, F.reverse(e)), 6).alias("turned"))
