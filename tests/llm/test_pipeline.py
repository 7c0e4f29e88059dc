"""The stages on small tables against their operators' plain versions."""

import re

import corpus_pipeline
from terrace.llm.common import materialise
from tests.llm.conftest import pairs
from tests.llm.test_fmindex import words
from tests.llm.test_near import plain_kept


def staged(spark, docs, sf_dir):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], sf_dir), name))
    return out


def test_stages(spark, docs, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "packing"]
    first, known, unique, clean, redacted, packed = staged(spark, docs, sf_dir)
    for df in (known, unique, clean, redacted):
        assert df.dtypes == first.dtypes
    has_letter = {d for d, t in pairs(first) if any(c.isalpha() for c in t or "")}
    assert {d for d, _ in pairs(known)} <= has_letter
    assert known.count() >= 0.99 * len(has_letter)
    assert sorted(pairs(unique), key=repr) == plain_kept(pairs(known))
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        own = words(r["text"])
        windows |= {tuple(own[i : i + 10]) for i in range(len(own) - 9)}
    hits = lambda t: any(tuple(w[i : i + 10]) in windows for w in [words(t)] for i in range(len(w) - 9))
    before, after = dict(pairs(unique)), dict(pairs(clean))
    assert any(map(hits, before.values())) and not any(map(hits, after.values()))
    assert {d for d in before if d not in after or after[d] != before[d]} == {d for d, t in before.items() if hits(t)}
    assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[a-z]", t) for _, t in pairs(redacted))
    assert {r["doc_id"] for r in packed.collect()} == {d for d, _ in pairs(redacted)}
    assert corpus_pipeline.run(spark, sf_dir).count() == packed.count()


def test_odd_and_empty_tables(spark, odd, empty, sf_dir):
    for docs in (odd, empty):
        *stages, packed = staged(spark, docs, sf_dir)
        assert all(s.columns == odd.columns for s in stages)
        assert packed.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert packed.count() == 0
