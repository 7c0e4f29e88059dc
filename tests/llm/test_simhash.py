"""Fingerprints, links and components against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from terrace.llm import simhash
from tests.llm.conftest import pairs


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c if c not in "\t\n\x0b\x0c\r" else " " for c in text or "").split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius=2):
    """Least place reachable from each, by all pairs."""
    f = np.array(fps, np.uint64)
    label = np.arange(len(f))
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= radius
    while True:
        new = np.array([label[near[i]].min() for i in range(len(f))])
        if (new == label).all():
            return label.tolist()
        label = new


def result(df):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect()), key=repr)


def query(spark, monkeypatch, df):
    monkeypatch.setattr(simhash, "table", lambda *_: df)
    return simhash.op5_simhash(spark, "")


@pytest.mark.parametrize("shard", [simhash.SHARD, (25, 25)])
def test_equals_all_pairs(spark, docs, monkeypatch, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "LEAF", 8)
    rows = sorted(pairs(docs))
    fps = [plain_fingerprint(t) for _, t in rows]
    assert result(query(spark, monkeypatch, docs)) == sorted(((d, f"{f:016x}", rows[c][0]) for (d, _), f, c in zip(rows, fps, plain_components(fps), strict=True)), key=repr)


def test_odd_rows(spark, odd, empty, monkeypatch):
    rows = sorted((r for r in pairs(odd)), key=lambda r: (r[0] is None, r[0] or 0))
    fps = [plain_fingerprint(t) for _, t in rows]
    least = {}
    labels = plain_components(fps)
    for (d, _), c in zip(rows, labels, strict=True):
        if d is not None:
            least[c] = min(d, least.get(c, d))
    expected = sorted(((d, f"{f:016x}", least.get(c)) for (d, _), f, c in zip(rows, fps, labels, strict=True)), key=repr)
    assert result(query(spark, monkeypatch, odd)) == expected
    assert query(spark, monkeypatch, empty).collect() == []


def test_hubs_are_not_dealt_by_their_key(spark, monkeypatch):
    """A star whose hub has nearly all edges: no task of a join gets them, and the rounds leave no table but the last."""
    from terrace.llm import common

    edges = spark.createDataFrame([(1, i) for i in range(2, 3000)] + [(5000, 5001)], "u long, v long").repartition(8)
    found = simhash.with_least(edges, 3000)
    assert found.where("u = 1 and m = 2").count() == 2998 and found.count() == 2999
    before = set(common._MADE)
    with common.scratch():
        roots = simhash.components(edges)
        assert len(set(common._MADE) - before) == 1
        assert roots.groupBy("root").count().orderBy("root").collect() == [(1, 2998), (5000, 1)]
    assert set(common._MADE) == before


@pytest.mark.parametrize("seed", range(3))
def test_shards_find_every_pair(seed):
    """Clusters of close fingerprints, a dense ball among them, dealt and joined as a task would."""
    r = random.Random(seed)
    points = set()
    for _ in range(60):
        centre = r.getrandbits(64)
        for _ in range(r.choice([1, 2, 40])):
            x = centre
            for _ in range(r.randint(0, 4)):
                x ^= 1 << r.randrange(64)
            points.add(x)
    points = np.array(sorted(points), np.uint64)
    nodes = simhash.tree(np.random.default_rng(seed).permutation(points)[:200], 9)
    at, leaf, query = simhash.route(points, nodes, 2)
    assert (np.bincount(at[~query], minlength=len(points)) == 1).all()
    forest = simhash.Forest(len(points))
    for n in np.unique(leaf):
        own = leaf == n
        simhash.join(points, at[own & ~query], at[own & query], 2, forest)
    got = forest.find(np.arange(len(points))).tolist()
    assert got == plain_components(points)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 300)] + [(500, 400), (450, 500)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {100 + i: 100 for i in range(1, 300)} | {500: 400, 450: 400}
