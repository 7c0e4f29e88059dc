"""Counts against the library on whole texts."""

import pytest

from terrace.llm import tokencount
from tests.llm.conftest import pairs, texts


@pytest.fixture(scope="module")
def model():
    return tokencount.load(tokencount.default_path())


@pytest.mark.parametrize("sizes", [(tokencount.SHARD_BYTES, tokencount.SHARD_DOCS), (2000, 3)])
def test_equals_library(spark, docs, odd, empty, model, monkeypatch, sizes):
    monkeypatch.setattr(tokencount, "SHARD_BYTES", sizes[0])
    monkeypatch.setattr(tokencount, "SHARD_DOCS", sizes[1])
    for df in (docs, odd):
        got = sorted((tuple(r) for r in tokencount.count(df).collect()), key=repr)
        assert got == sorted(((d, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for d, t in pairs(df)), key=repr)
    assert tokencount.count(empty).collect() == []


def test_frequencies_above_an_int_are_split(spark, model):
    text = "a " * 70_000 + "b"
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert tokencount.count(rows).first()["n_tokens"] == len(model.encode(text))


def test_pretokens(model):
    import random

    r = random.Random(5)
    cases = [t for t in texts() if t and len(t) < 1000] + ["".join(r.choice("ab é▁\n\t.日\x00") for _ in range(r.randint(1, 25))) for _ in range(2000)]
    for text in cases:
        found = tokencount.pretokens(text)
        pieces = tokencount.count_pieces(model, list(found)) if found else []
        assert sum(found[t] * n for t, n in zip(found, pieces, strict=True)) == len(model.encode(text)), repr(text)
