"""The index against plain search, and hits against windows in sets."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from terrace.llm import fmindex
from tests.llm.conftest import pairs


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, n=10):
    windows = defaultdict(set)
    for place, (_, text) in enumerate(items):
        own = words(text)
        for i in range(max(1, len(own) - n + 1)) if own else ():
            windows[tuple(own[i : i + n])].add(place)
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in rows:
        own, hit, found = words(text), set(), set()
        for size in lengths:
            for i in range(len(own) - size + 1):
                if (w := tuple(own[i : i + size])) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[w]
        ids = ",".join(sorted(str(items[p][0]) for p in found if items[p][0] is not None))
        out.append((doc, len(own), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def query(spark, monkeypatch, docs, benchmark):
    monkeypatch.setattr(fmindex, "table", lambda _, __, name: {"documents": docs, "benchmark": benchmark}[name])
    return sorted((tuple(r) for r in fmindex.op9_decontamination(spark, "").collect()), key=repr)


@pytest.mark.parametrize("size", [fmindex.SHARD_WORDS, 100, 12])
def test_equals_windows(spark, docs, sf_dir, monkeypatch, size):
    monkeypatch.setattr(fmindex, "SHARD_WORDS", size)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    items = [tuple(r) for r in benchmark.collect()]
    got = query(spark, monkeypatch, docs, benchmark)
    assert got == brute(pairs(docs), items)
    assert any(r[-1] for r in got)


def test_odd_rows(spark, odd, empty, monkeypatch):
    texts = [t for _, t in pairs(odd) if t and len(t) < 2000]
    items = [(1, "the same text again and again and again"), (2, "One, TWO!"), (3, None), (4, ""), (5, "..."), (None, "a"), (7, texts[5]), (7, texts[6]), (8, "not in any of them at all is this text here"), (9, "long " * 12), (10, "日本語")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert query(spark, monkeypatch, odd, benchmark) == brute(pairs(odd), items)
    monkeypatch.setattr(fmindex, "BLOCK_WORDS", 12)  # an item is cut, and there are several blocks
    monkeypatch.setattr(fmindex, "HELD", 2)
    assert query(spark, monkeypatch, odd, benchmark) == brute(pairs(odd), items)
    assert query(spark, monkeypatch, empty, benchmark) == []
    assert not any(r[-1] for r in query(spark, monkeypatch, odd, benchmark.limit(0)))


def test_clean_leaves_no_window(spark, odd, docs, sf_dir):
    benchmark = spark.createDataFrame([(1, "the same text again and again and again"), (2, "B c d e")], "item_id long, text string")
    out = fmindex.clean(odd, benchmark)
    assert out.columns == odd.columns
    by = dict(pairs(out))
    assert "A \r\nf" in by.values()
    assert out.count() == odd.count() - 5
    real = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert fmindex.find(docs, real).where("n_hit > 0").count() > 0
    assert fmindex.find(fmindex.clean(docs, real), real).where("n_hit > 0").count() == 0
    nested = spark.createDataFrame([(1, "x a a b b c y")], "doc_id long, text string")
    assert [t for _, t in pairs(fmindex.clean(nested, spark.createDataFrame([(1, "a b")], "item_id long, text string")))] == ["x  c y"]
    untouched = dict(pairs(docs))
    changed = {d for d, t in pairs(fmindex.clean(docs, real)) if untouched[d] != t}
    assert changed <= {r["doc_id"] for r in fmindex.find(docs, real).where("n_hit > 0").collect()}


@pytest.mark.parametrize("seed", range(6))
def test_index(seed):
    r = np.random.default_rng(seed)
    n, words = int(r.integers(1, 400)), int(r.integers(1, 6))
    text = np.append(np.where(r.random(n) < r.choice([0.02, 0.3]), 0, r.integers(1, words + 1, n)), 0)
    if seed == 5:
        text = np.tile(np.append(np.ones(30, np.int64), 0), 20)
    order = fmindex.suffix_array(text)
    ends = np.flatnonzero(text == 0)
    suffix = lambda i: [*text[i : (e := ends[np.searchsorted(ends, i)])].tolist(), -1e9 + e]
    assert order.tolist() == sorted(range(len(text)), key=suffix)
    index = fmindex.FMIndex(text, sample=4)
    phrases = r.integers(1, max(1, int(text.max())) + 1, (50, 5))
    phrases[:10, :3] = 0
    low, high = index.search(phrases)
    for p, a, b in zip(phrases, low, high, strict=True):
        p = p[p > 0]
        expected = [i for i in range(len(text) - len(p) + 1) if (text[i : i + len(p)] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == expected
