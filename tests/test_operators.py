"""Operators on hand-made rows: nulls, ties, empty sides, and the plans that they give."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from terrace.functions.vectors import cosine
from terrace.operators.joins import asof_join, range_join, salted_join
from terrace.operators.windows import fill_forward, groups_frame_sum, sessions, top_k
from terrace.plans import inspect
from terrace.sources import files


def test_asof_join(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, None, 9), (5, "a", None), (6, "a", 5)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 2, 10), ("a", 5, 20), ("a", 5, 21), ("a", None, 99), ("b", 10, 30), (None, 1, 40)], "k string, t int, v int")
    found = {r["id"]: r["v"] for r in asof_join(left, right, "t", ["k"], ["v"]).collect()}
    assert found == {1: 21, 2: None, 3: None, 4: None, 5: None, 6: 21}
    assert asof_join(left, right.limit(0), "t", ["k"], ["v"]).where("v is not null").count() == 0


def test_range_join_equals_nested_loop(spark):
    points = spark.createDataFrame([(i, float(x)) for i, x in enumerate([0, 1, 2.5, 2.5, 7, -3, 10])] + [(99, None)], "i int, x double")
    ranges = spark.createDataFrame([("p", 0.0, 2.5), ("q", 2.5, 9.0), ("r", -5.0, 20.0), ("s", 3.0, 3.0), ("t", None, 4.0)], "n string, lo double, hi double")
    found = range_join(points, ranges, "x", "lo", "hi", 2.0)
    assert not inspect.has_nested_loop(found)
    expected = points.crossJoin(ranges).where("lo <= x and x < hi")
    assert sorted(found.select("i", "n").collect()) == sorted(expected.select("i", "n").collect())


def test_salted_join_keeps_all_pairs(spark):
    left = spark.range(1000).select(F.when(F.col("id") < 900, 1).otherwise(F.col("id")).alias("k"), "id")
    right = spark.createDataFrame([(1, "hot"), (950, "cold"), (None, "none")], "k long, name string")
    assert {r["name"]: r["count"] for r in salted_join(left, right, "k", 8, F.col("id")).groupBy("name").count().collect()} == {"hot": 900, "cold": 1}


def test_top_k_limits_before_the_shuffle(spark):
    rows = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
    found = top_k(rows, ["g"], [F.col("id").desc()], 2)
    assert inspect.nodes(found)["WindowGroupLimit"] >= 1
    assert sorted((r["g"], r["id"]) for r in found.collect()) == [(0, 96), (0, 99), (1, 94), (1, 97), (2, 95), (2, 98)]


def test_windows_with_nulls(spark):
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("a", 3, None), ("b", 1, None)], "k string, t int, v int")
    found = {(r["k"], r["t"]): r["f"] for r in fill_forward(rows, ["k"], ["t"], "v", "f").collect()}
    assert found == {("a", 1): None, ("a", 2): 5, ("a", 3): 5, ("b", 1): None}
    peers = spark.createDataFrame([(1, 1), (1, 2), (3, 4), (7, 8)], "g int, v int").withColumn("k", F.lit(0))
    assert sorted((r["g"], r["s"]) for r in groups_frame_sum(peers, ["k"], "g", "v", 1, "s").collect()) == [(1, 3), (1, 3), (3, 7), (7, 12)]


def test_sessions(spark):
    at = [dt.datetime(2024, 1, 1, 0, m) for m in (0, 10, 50)]
    found = sessions(spark.createDataFrame([(1, t) for t in at], "u int, t timestamp"), ["u"], "t", "30 minutes").orderBy("session_start").collect()
    assert [(r["n"], r["session_end"].minute) for r in found] == [(2, 40), (1, 20)]


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0, None]


def test_scan_is_pruned_and_filtered(spark, sf_dir):
    from terrace import catalog

    df = catalog.QUERIES["order_bands"](spark, sf_dir)
    assert set(inspect.read_columns(df)[0]) == {"o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority"}
    assert "StringStartsWith(o_orderpriority,1)" in inspect.pushed_filters(df)[0]


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_files_round_trip(spark, tmp_path, fmt):
    rows = spark.createDataFrame([(1, "a", 1.5), (2, None, None), (3, "ü,\"x\"", -0.5)], "i int, s string, d double")
    files.write(rows, f"{tmp_path}/t", fmt, header="true") if fmt == "csv" else files.write(rows, f"{tmp_path}/t", fmt)
    back = files.read(spark, f"{tmp_path}/t", fmt, rows.schema, **({"header": "true", "escape": '"'} if fmt == "csv" else {}))
    assert sorted(back.collect()) == sorted(rows.collect()) if fmt != "csv" else back.count() == 3


def test_partitioned_write_prunes(spark, tmp_path):
    rows = spark.range(100).select("id", (F.col("id") % 4).alias("p"))
    files.write(rows, f"{tmp_path}/t", partition_by=["p"])
    back = files.read(spark, f"{tmp_path}/t").where("p = 2")
    assert back.count() == 25
    assert "PartitionFilters: [isnotnull(p" in inspect.plan_text(back)


def test_formats_need_a_schema(spark, tmp_path):
    with pytest.raises(ValueError, match="schema"):
        files.read(spark, str(tmp_path), "json")


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    for name in ("bucket_a", "bucket_b"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        files.write_bucketed(spark.range(100).withColumn(f"x_{name}", F.col("id") * 2), name, ["id"], 4, "overwrite")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("bucket_a").join(spark.table("bucket_b"), "id")
        assert inspect.exchanges(joined) == 0
        assert joined.count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("bucket_a", "bucket_b"):
            spark.sql(f"DROP TABLE {name}")


def test_upsert(spark):
    from terrace.operators.tables import upsert

    target = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n"), (4, None)], "k int, v string")
    changes = spark.createDataFrame([(1, "x", False, 1), (1, "y", False, 2), (2, "z", True, 5), (3, "new", False, 1), (None, "m", False, 1), (9, "never", True, 1)], "k int, v string, gone boolean, at int")
    assert sorted(upsert(target, changes, ["k"], ["at"], "gone").collect(), key=repr) == sorted([(1, "y"), (3, "new"), (None, "m"), (4, None)], key=repr)
    assert sorted(upsert(target, changes.limit(0), ["k"], ["at"], "gone").collect(), key=repr) == sorted(target.collect(), key=repr)
    assert upsert(target.limit(0), changes, ["k"], ["at"]).count() == 5


def test_row_index(spark):
    from terrace.operators.tables import with_row_index

    rows = spark.createDataFrame([(x, i) for i, x in enumerate([5.0, None, 1.0, 1.0, 1.0, 9.0, -2.0, None])], "x double, i int").repartition(3)
    found = sorted(with_row_index(rows, ["x", "i"], "n", 4).collect(), key=lambda r: r["n"])
    assert [r["n"] for r in found] == list(range(8))
    assert [r["i"] for r in found] == [1, 7, 6, 2, 3, 4, 0, 5]
    assert with_row_index(rows.limit(0), ["x", "i"], "n").collect() == []


def test_hash_sample_is_the_same_every_time(spark):
    from terrace.operators.tables import hash_sample

    rows = spark.range(10_000)
    a = {r[0] for r in hash_sample(rows, ["id"], 0.2).collect()}
    assert a == {r[0] for r in hash_sample(rows.repartition(7), ["id"], 0.2).collect()}
    assert 1700 < len(a) < 2300


def test_map_batches(spark):
    from terrace.functions.user import map_batches

    rows = spark.createDataFrame([(3, "c"), (1, "a"), (2, None)], "n int, s string").coalesce(1)
    assert sorted(map_batches(rows, "n", "r").collect()) == [(1, "a", 1), (2, None, 2), (3, "c", 3)]
