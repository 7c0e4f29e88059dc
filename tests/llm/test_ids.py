"""Token ids, packing and shards against the tokenizers library."""

import io
import random
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from terrace.llm import packing, sstable, wordids
from terrace.llm.wordids import WordEncoder, default_path
from tests.llm.conftest import pairs, texts


@pytest.fixture(scope="module")
def encode():
    return WordEncoder(default_path())


def ids_of(encode, text):
    return [*encode.tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(array("I", ids).tobytes())


def test_encoder_equals_library(encode, docs):
    for _, text in [*pairs(docs), *enumerate(texts())]:
        assert encode(text) == array("I", ids_of(encode, text)[:-1]).tobytes()
    r = random.Random(1)
    for _ in range(3000):
        text = "".join(r.choice("aA'sSt é́ßÉİΣ.!,<|1٠ \n\xa0　 ǅﬁ日ー\x1f_-") for _ in range(r.randint(1, 30)))
        assert encode(text) == array("I", ids_of(encode, text)[:-1]).tobytes(), text


@pytest.mark.parametrize("size", [wordids.SLICE, 300])
def test_batches_equal_library(encode, docs, monkeypatch, size):
    monkeypatch.setattr(wordids, "SLICE", size)
    r = random.Random(2)
    all_ = [t for _, t in pairs(docs)[:60]] + texts() + ["".join(r.choice("aA'sSt é́ßÉİΣ.!,<|1٠ \n\xa0　\u2028\x85 ǅﬁ日ー\x1f\x1c_-") for _ in range(r.randint(0, 30))) for _ in range(500)]
    for many in (all_, all_[3:4], [None], []):
        got = list(encode.batch(pa.array(many, pa.string())))
        assert [x.tolist() for x in got] == [ids_of(encode, t)[:-1] for t in many]
    assert [x.tolist() for x in encode.batch(pa.array(all_, pa.string()).slice(5, 20))] == [ids_of(encode, t)[:-1] for t in all_[5:25]]


def test_encoder_forgets(encode, docs, monkeypatch):
    monkeypatch.setattr(wordids, "CACHE_ENTRIES", 50)
    small = WordEncoder(default_path())
    for _, text in pairs(docs)[:40]:
        assert small(text) == encode(text)
    assert len(small.known) <= 50 and len(small.known.words) <= 50


def check_packed(rows, expected, encode):
    ids = defaultdict(list)
    for doc, text in expected:
        ids[doc].append(ids_of(encode, text))
    spans, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own = [x for x in ids[r["doc_id"]] if crc(x[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] and len(x) == r["doc_tokens"]]
        assert own
        spans[r["doc_id"], r["start"], r["length"], r["doc_tokens"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(len(x) for own in ids.values() for x in own)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= packing.CAPACITY
    return len(sequences) * packing.CAPACITY - sum(r["length"] for r in rows)


def test_packing(spark, docs, odd, empty, encode):
    rows = packing.pack(docs).collect()
    padding = check_packed(rows, pairs(docs), encode)
    assert padding < 0.05 * sum(r["length"] for r in rows)
    check_packed(packing.pack(odd).collect(), pairs(odd), encode)
    assert packing.pack(empty).collect() == []


def test_repeated_rows_are_dealt_out(spark, encode, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 40)
    monkeypatch.setattr(packing, "MOST", 90)
    rows = [(None, "")] * 700 + [(7, "the same text")] * 200
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    check_packed(found, rows, encode)
    assert max(sum(r["sequence_id"] >> 32 == g for r in found) for g in {r["sequence_id"] >> 32 for r in found}) <= 90


@pytest.mark.parametrize("seed", range(5))
def test_differencing(seed):
    r = np.random.default_rng(seed)
    sizes = r.integers(1, 513, r.integers(1, 400))
    for k in (1, 2, 7, 50):
        found = packing.differencing(sizes, k)
        assert sorted(i for w in found for i in w) == list(range(len(sizes)))
        assert len(found) <= k
    for w in (found := packing.windows(sizes)):
        assert sizes[w].sum() <= packing.CAPACITY
    assert sorted(i for w in found for i in w) == list(range(len(sizes)))


def test_differencing_small_cases():
    assert sorted(sorted(np.array([8, 7, 6, 5, 4])[w].sum() for w in packing.differencing(np.array([8, 7, 6, 5, 4]), 2))) == [14, 16]  # the textbook's two-way result
    assert len(packing.windows(np.array([1500, 1500, 1500]))) == 3  # two by their sum, more by the capacity


def test_shards(spark, docs, odd, empty, encode):
    for df in (docs, odd):
        expected, at = [], 0
        rows = sorted(pairs(df), key=lambda r: (r[0] is not None, r[0] or 0))
        got = sstable.encode_documents(df).orderBy("start").collect()
        assert len(got) == len(rows)
        for doc, text in rows:
            ids = ids_of(encode, text)
            expected.append((doc, len(ids), crc(ids)))
        assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=repr) == sorted(expected, key=repr)
        for r in got:
            assert r["start"] == at
            at += r["n_tokens"]
        assert [r["doc_id"] for r in got] == [d for d, _ in rows]
    assert sstable.encode_documents(empty).collect() == []


def test_lookup(monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK", 256)
    r = np.random.default_rng(0)
    docs = {int(i): r.integers(0, 49408, r.integers(1, 40)) for i in np.unique(r.integers(-(2**62), 2**62, 500))} | {5: np.arange(10), 6: np.arange(3000)}
    for width in (2, 4):
        out = io.BytesIO()
        w = sstable.Writer(out, width)
        w.add(sstable.key_of(None), np.array([7]))
        for i in sorted(docs):
            w.add(sstable.key_of(i), docs[i])
        w.close()
        reader = sstable.Reader(io.BytesIO(out.getvalue()), len(out.getvalue()))
        assert len(reader.where) > 10
        assert reader.get(None).tolist() == [7]
        for i, ids in docs.items():
            assert reader.get(i).tolist() == ids.tolist()
        missing = [i for i in range(1000, 3000) if reader.get(i) is not None]
        assert missing == []
        assert [i for i, _ in reader] == [None, *sorted(docs)]
        assert reader.n_ids == 1 + sum(map(len, docs.values()))
    with pytest.raises(ValueError, match="ascend"):
        w.add(sstable.key_of(-(2**63)), np.array([1]))


def test_manifest_and_lookup_of_shards(spark, docs, odd, encode, monkeypatch, tmp_path):
    monkeypatch.setattr(sstable, "SHARD_DOCS", 20)
    many = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(spark.createDataFrame([(7_777_777, f"copy {i}") for i in range(100)], "doc_id long, text string"))
    sstable.write(many, f"file://{tmp_path}/s", default_path())
    rows = sstable.manifest_of(spark, f"file://{tmp_path}/s")
    assert len(rows) > 10 and max(r["n_docs"] for r in rows) < many.count() / 3
    keys = [(sstable.key_of(r["first"]), sstable.key_of(r["last"])) for r in rows]
    assert all(a <= b for a, b in keys) and all(x[1] <= y[0] for x, y in zip(keys, keys[1:], strict=False))
    assert sum(r["first"] == r["last"] == 7_777_777 for r in rows) > 1  # repeated ids don't meet in one shard
    texts_of = defaultdict(list)
    for d, t in pairs(many):
        texts_of[d].append(ids_of(encode, t))
    asked = [*texts_of, 987_654_321_987, -3, 10**18]
    found = {r["doc_id"]: r["tokens"] for r in sstable.lookup(spark.createDataFrame([(d,) for d in asked], "doc_id long"), f"file://{tmp_path}/s").collect()}
    assert set(found) == set(asked)
    for d, tokens in found.items():
        assert tokens in texts_of[d] if d in texts_of else tokens is None


def test_repeated_keys_across_blocks(monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK", 16)
    out = io.BytesIO()
    w = sstable.Writer(out, 4)
    for n in range(5):
        w.add(sstable.key_of(9), np.arange(n, n + 6))
    w.close()
    assert sstable.Reader(io.BytesIO(out.getvalue()), len(out.getvalue())).get(9).tolist() == [0, 1, 2, 3, 4, 5]
