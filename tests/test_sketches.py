"""Estimates and samples, which SQL can't give, against exact results and their bounds."""

import pytest
from pyspark.sql import functions as F

from terrace import catalog


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_distinct_customers(spark, sf_dir):
    exact = by(spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderpriority").agg(F.countDistinct("o_custkey").alias("n")), "o_orderpriority")
    found = by(catalog.QUERIES["approximate_customers"](spark, sf_dir), "o_orderpriority")
    assert set(found) == set(exact)
    assert all(r["customers"] == pytest.approx(exact[k]["n"], rel=0.05) for k, r in found.items())


def test_medians(spark, sf_dir):
    bounds = by(spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.percentile("value", 0.47).alias("lo"), F.percentile("value", 0.53).alias("hi")), "event_type")
    for k, r in by(catalog.QUERIES["approximate_quantiles"](spark, sf_dir), "event_type").items():
        assert bounds[k]["lo"] <= r["median"] <= bounds[k]["hi"]
        assert bounds[k]["lo"] <= r["kll_median"] <= bounds[k]["hi"]


def test_users_and_most_frequent(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    exact = by(events.groupBy("event_type").agg(F.countDistinct("user_id").alias("n")), "event_type")
    counts = {(r["event_type"], str(r["user_id"])): r["count"] for r in events.groupBy("event_type", "user_id").count().collect()}
    for k, r in by(catalog.QUERIES["sketched_events"](spark, sf_dir), "event_type").items():
        assert r["users_hll"] == pytest.approx(exact[k]["n"], rel=0.1)
        assert r["users_theta"] == pytest.approx(exact[k]["n"], rel=0.05)
        assert len(r["user_counts"]) > 100
        assert [n for _, n in r["most"]] == sorted((n for (e, _), n in counts.items() if e == k), reverse=True)[:3]
        assert all(counts[k, user] == n for user, n in r["most"])


def test_samples(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    assert catalog.QUERIES["sampled_orders"](spark, sf_dir).count() == pytest.approx(0.1 * orders, rel=0.35)
    events = by(spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count(), "event_type")
    found = by(catalog.QUERIES["stratified_events"](spark, sf_dir).groupBy("event_type").count(), "event_type")
    assert set(found) == {"purchase", "error"}
    assert found["purchase"]["count"] == pytest.approx(0.5 * events["purchase"]["count"], rel=0.35)


def plain_soundex(word):
    code = {c: d for d, letters in enumerate(["BFPV", "CGJKQSXZ", "DT", "L", "MN", "R"], 1) for c in letters}
    out, last = word[0], code.get(word[0])
    for c in word[1:]:
        if (d := code.get(c)) and d != last:
            out += str(d)
        if c not in "HW":
            last = d
    return (out + "000")[:4]


def test_sounds(spark, sf_dir):
    names = {r["c_custkey"]: r["c_mktsegment"] for r in spark.read.parquet(f"{sf_dir}/customer.parquet").collect()}
    for r in catalog.QUERIES["sounds_and_sentences"](spark, sf_dir).collect():
        assert r["sound"] == plain_soundex(names[r["c_custkey"]])
        assert r["words"][0] == [names[r["c_custkey"]]]
