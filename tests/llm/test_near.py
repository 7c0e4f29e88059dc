"""The pipeline's near copies against all pairs of plain shingle sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terrace.llm import near
from tests.llm.conftest import pairs


def plain_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_kept(rows):
    """The (doc_id, text) that stay, by all pairs."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    sets = [plain_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if label[i] != label[j] and a.__len__() * 5 >= 4 * len(b) and len(b) * 5 >= 4 * len(a) and (not a and not b or 5 * len(a & b) >= 4 * len(a | b)):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return sorted({rows[x] for x in label}, key=repr)


def made(seed):
    """Unlike texts, copies with from none to many words changed, and a common line."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    line = [word() for _ in range(12)]
    out = []
    for _ in range(40):
        base = [word() for _ in range(r.choice([3, 8, 40, 120, 200]))]
        for _ in range(r.choice([1, 2, 3, 40])):
            own = list(base)
            for _ in range(r.randint(0, 1 + len(own) // 40)):
                own[r.randrange(len(own))] = word()
            out.append(" ".join(own + (line if r.random() < 0.3 else [])))
    return list(enumerate(out))


@pytest.mark.parametrize(("star", "frequent"), [(24, 3), (2, 10**9)])
def test_equals_all_pairs(spark, monkeypatch, star, frequent):
    monkeypatch.setattr(near, "STAR", star)
    monkeypatch.setattr(near, "FREQUENT", frequent)
    rows = made(5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(pairs(corpus_pipeline.near_duplicates(spark, df, "")), key=repr) == plain_kept(rows)


def test_copy_beyond_two_bits_goes(spark):
    words = [f"w{i}" for i in range(60)]
    edited = [*words[:30], "other", *words[31:]]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edited)), (3, "something else")], "doc_id long, text string")
    assert sorted(d for d, _ in pairs(corpus_pipeline.near_duplicates(spark, df, ""))) == [1, 3]


@pytest.fixture
def joined(monkeypatch):
    """How many rows each join of prefix shingles made."""
    made, paired = [], near.paired

    def counting(*args):
        out = paired(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(near, "paired", counting)
    return made


def test_large_group_of_near_copies_makes_few_pairs(spark, joined):
    r = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(400):
        own = list(base)
        for _ in range(r.randint(1, 4)):
            own[r.randrange(len(own))] = f"x{r.random()}"
        texts.append(" ".join(own))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(pairs(near.first_of_each(df)), key=repr) == plain_kept(rows)
    assert max(joined) < 400 * 400 / 4


def test_pair_meets_once_whatever_is_shared(spark, monkeypatch, joined):
    monkeypatch.setattr(near, "FREQUENT", 10**9)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(passage + [f"w{i}_{k}" for k in range(40)])) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(pairs(near.first_of_each(df))) == 20
    assert sum(joined) <= 20 * 19 / 2


def test_parity_differs_in_no_more_than_the_sets(spark):
    r = np.random.default_rng(2)
    rows, sizes = [], []
    for n in (0, 1, 2, 31, 33, 100, 127, 129, 1000, 5000):
        own = np.unique(r.integers(0, 1 << 62, n))
        for cut, more in ((0, 0), (n // 5, 0), (n // 9, n // 9), (0, n // 4)):
            other = np.unique(np.concatenate([own[cut:], r.integers(0, 1 << 62, more)]))
            rows.append((near.parity(own).tolist(), near.parity(other).tolist()))
            sizes.append(len(np.setxor1d(own, other)))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>").coalesce(1)
    found = [x[0] for x in df.select(near.differing(F.col("a"), F.col("b"))).collect()]
    assert all(0.6 * n <= d <= n for d, n in zip(found, sizes, strict=True))


def test_documents(spark, docs):
    assert sorted(pairs(near.first_of_each(docs)), key=repr) == plain_kept(pairs(docs))


def test_odd_and_empty(spark, odd, empty):
    rows = [(1, "a text"), (1, "an unlike one"), (None, "no id"), (None, "no id"), (7, "NO  id"), (None, "only null"), (None, "only null"), (9, None), (8, "")]
    kept = near.first_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(pairs(kept), key=repr) == sorted([(1, "a text"), (1, "an unlike one"), (7, "NO  id"), (None, "only null"), (8, "")], key=repr)
    out = near.first_of_each(odd)
    assert out.columns == odd.columns and out.where("text = 'no id'").count() == 1
    assert near.first_of_each(empty).collect() == []
