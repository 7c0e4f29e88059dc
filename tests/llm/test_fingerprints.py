"""Bottom-k sketches against the same sketches in plain Python."""

import hashlib
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from terrace.llm import fingerprints as fp
from terrace.plans import inspect
from tests.llm.conftest import pairs


def xx(values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<Q", v), seed)
    return seed


def shingles(text):
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split(r"[ \t\n\x0b\f\r]+", lower(text)) if w]
    if len(words) < 5:
        return {xx(words)} if words else set()
    return {xx(words[i : i + 5]) for i in range(len(words) - 4)}


def lower(text):
    return text.lower()


def sketch(text):
    return sorted(h - 2**64 if h >> 63 else h for h in shingles(text))[: fp.K]


def near(a, b):
    union = sorted({*a, *b})[: fp.K]
    return len({*union} & {*a} & {*b}) / len(union) if union else 1.0


def text_of(s):
    return "".join(f"{h % 2**64:016x}" for h in s)


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = sketch(text), sketch(edited), sketch(after)
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), text_of(a), text_of(b), near(a, b), near(a, c)))
    return sorted(out, key=repr)


def result(df):
    cols = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def query(spark, monkeypatch, df):
    monkeypatch.setattr(fp, "table", lambda *_: df)
    return fp.op1_fingerprints(spark, "")


def test_equals_brute_force(spark, docs, monkeypatch):
    found = query(spark, monkeypatch, docs)
    assert not any("Python" in n or "Arrow" in n or "Pandas" in n for n in inspect.nodes(found))
    assert result(found) == brute(pairs(docs))


def test_odd_rows(spark, odd, monkeypatch):
    unique = odd.where("doc_id is not null").dropDuplicates(["doc_id"]).where(~F.coalesce(F.col("text"), F.lit("")).contains("İ"))  # Java and Python lower it differently
    assert result(query(spark, monkeypatch, unique)) == brute(pairs(unique))
    assert query(spark, monkeypatch, odd).count() == odd.count()  # repeated and missing ids: ties, but no row is lost
    by_text = odd.withColumn("__n", F.lit(1))
    assert fp.with_sketch(by_text, "text", "s").groupBy("text").agg(F.countDistinct("s").alias("n")).where("n > 1").count() == 0


@pytest.mark.parametrize("spread", [1, 10**12])
def test_ids_far_apart_in_bounded_buckets(spark, monkeypatch, spread):
    """No window over all rows, no bucket much above the others, documents read at most twice besides a count."""
    import random

    r = random.Random(2)
    ids = r.sample(range(-500, 500), 600)
    rows = [(i * spread, " ".join(r.choice("abc") for _ in range(r.randint(0, 12)))) for i in ids]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = query(spark, monkeypatch, df)
    assert "SinglePartition" not in inspect.plan_text(found)
    assert result(found) == brute(rows)


def test_repeated_and_missing_ids_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(fp, "BUCKET", 8)
    rows = [(None, f"text {i}") for i in range(300)] + [(7, f"more {i}") for i in range(300)] + [(i, "x") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = df.withColumns({"id": F.coalesce("doc_id", F.lit(-(1 << 63))), "th": F.xxhash64("text")})
    firsts = fp.bounds(keyed)
    sizes = keyed.groupBy(fp.bucket_of(firsts).alias("b")).count().collect()
    assert len(sizes) == len(firsts) + 1 and max(r["count"] for r in sizes) <= 16
    found = query(spark, monkeypatch, df).collect()
    assert sorted(r["n_chars"] for r in found) == sorted(len(t) for _, t in rows)


def test_empty_and_single(spark, empty, odd, monkeypatch):
    assert query(spark, monkeypatch, empty).collect() == []
    (row,) = query(spark, monkeypatch, odd.where("text = 'one two'")).collect()
    assert row["near_next"] == 1.0 and row["edited_sha256"] == hashlib.sha256(b"one one").hexdigest()


@pytest.mark.parametrize("share", [0.2, 0.5, 0.9])
def test_estimates(spark, share):
    n = 4000
    a = [f"w{i}" for i in range(n)]
    b = [f"w{i + int(n * (1 - share))}" for i in range(n)]
    rows = spark.createDataFrame([(" ".join(a), " ".join(b), " ".join(a[: n // 2]), " ".join(a[n // 2 - 4 :]))], "a string, b string, c string, d string")
    for c in "abcd":
        rows = fp.with_sketch(rows, c, f"s{c}")
    s = {c: F.col(f"s{c}") for c in "abcd"}
    got = rows.select(fp.resemblance(s["a"], s["b"]).alias("r"), fp.containment(s["a"], s["b"]).alias("c"), fp.distinct_shingles(s["a"]).alias("n"), (fp.merge(s["c"], s["d"]) == s["a"]).alias("merged")).first()
    assert got["r"] == pytest.approx(share / (2 - share), abs=0.13)
    assert got["c"] == pytest.approx(share, abs=0.2)
    assert got["n"] == pytest.approx(n - 4, rel=0.3)
    assert got["merged"]
