"""Held-out accuracy of the learned operators, and their defined results."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.llm import language, quality


def patched(monkeypatch, module, **tables):
    monkeypatch.setattr(module, "table", lambda _, __, name: tables[name])


def test_language_of_held_out_documents(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    patched(monkeypatch, language, documents=docs)
    rows = language.op6_language(spark, "").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_held_out_languages_teach_nothing(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lied = docs.withColumn("lang", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit(None))
    got = []
    for df in (docs, lied):
        patched(monkeypatch, language, documents=df)
        got.append(sorted((r["doc_id"], r["lang_pred"], round(r["score"], 6)) for r in language.op6_language(spark, "").collect()))
    assert got[0] == got[1]


def test_language_odd_rows(spark, odd, empty, monkeypatch):
    patched(monkeypatch, language, documents=odd)
    rows = language.op6_language(spark, "").collect()
    assert len(rows) == odd.count()
    text = {r["doc_id"]: r["text"] for r in odd.collect()}
    for r in rows:
        if r["doc_id"] is not None:
            has = any(c.isalpha() for c in text[r["doc_id"]] or "")
            assert (r["lang_pred"] == "und") == (not has)
    patched(monkeypatch, language, documents=empty)
    assert language.op6_language(spark, "").collect() == []
    patched(monkeypatch, language, documents=odd.withColumn("lang", F.lit(None).cast("string")))
    assert {(r["lang_pred"], r["score"]) for r in language.op6_language(spark, "").collect()} == {("und", 0.0)}


def plain_grams(text):
    """n-gram -> count of the lower-cased letters with one blank between runs of them."""
    out, last = "", ""
    for c in (text or "").lower():
        c = c if c.isalpha() else " "
        if c != " " or last.isalpha():
            out += c
        last = c
    found = {}
    for n in (1, 2, 3):
        for i in range(len(out) - n + 1):
            found[out[i : i + n]] = found.get(out[i : i + n], 0) + 1
    return found if out.strip() else {}


def place(gram):
    m, key = 2**32, ord(gram[0]) * 0x9E3779B1 % 2**32
    for c in gram[1:]:
        key = ((key ^ key >> 13) * 0x85EBCA6B + ord(c) * 0xC2B2AE35) % m
    return key >> 17


def plain_vector(text):
    out = {}
    for gram, n in plain_grams(text).items():
        out[place(gram)] = out.get(place(gram), 0) + n
    return out


def plain_ftrl(sample, k, idf):
    """FTRL-proximal, a coordinate at a time, over (class, {place: count}) in order; temperature from the last fifth."""
    from math import exp, log, sqrt

    bias = language.DIMENSIONS
    z, n = {}, {}

    def x_of(c):
        x = {i: (1 + log(v)) * idf(i) for i, v in c.items()}
        length = sqrt(sum(v * v for v in x.values()))
        return {i: v / length for i, v in x.items()} | {bias: 1.0}

    def weight(i, y):
        a, b = z.get((i, y), 0.0), n.get((i, y), 0.0)
        return 0.0 if abs(a) <= language.L1 else ((language.L1 if a > 0 else -language.L1) - a) / ((language.BETA + sqrt(b)) / language.ALPHA + language.L2)

    def soft(logits, t=1.0):
        e = [exp((v - max(logits)) / t) for v in logits]
        return [v / sum(e) for v in e]

    logits = lambda x: [sum(v * weight(i, y) for i, v in x.items()) for y in range(k)]
    last = len(sample) - len(sample) // 5
    for _ in range(language.EPOCHS):
        for own, c in sample[:last]:
            x = x_of(c)
            p = soft(logits(x))
            for i, v in x.items():
                for y in range(k):
                    g, w = v * (p[y] - (y == own)), weight(i, y)
                    old = n.get((i, y), 0.0)
                    z[i, y] = z.get((i, y), 0.0) + g - (sqrt(old + g * g) - sqrt(old)) / language.ALPHA * w
                    n[i, y] = old + g * g
    held = [(y, logits(x_of(c))) for y, c in sample[last:]]
    m = len(held)
    loss = {t: sum(-(m / (m + 1) * (y == j) + 1 / k / (m + 1)) * log(p) for y, zs in held for j, p in enumerate(soft(zs, t))) for t in np.geomspace(0.02, 5, 80)}
    t = min(loss, key=loss.get)
    return lambda c: soft(logits(x_of(c)), t)


def test_language_equals_plain_ftrl(spark, docs):
    train = language.training_part(docs)
    model = language.fit(train)
    keyed = train.select("doc_id", "text", "lang", F.xxhash64("doc_id", "text").alias("key")).collect()
    rows = sorted((r["key"], r["lang"], plain_vector(r["text"])) for r in keyed)
    df = {}
    for _, _, c in rows:
        for i in c:
            df[i] = df.get(i, 0) + 1
    total = sum(bool(c) for _, _, c in rows)
    languages = sorted({lang for _, lang, _ in rows})
    assert model.languages == languages
    predict = plain_ftrl([(languages.index(lang), c) for _, lang, c in rows if c], len(languages), lambda i: np.log((1 + total) / (1 + df.get(i, 0))) + 1)
    for r in docs.collect():
        if c := plain_vector(r["text"]):
            p = predict(c)
            got, score = model.predict(r["text"])
            assert languages.index(got) == int(np.argmax(p)) and score == pytest.approx(max(p), abs=1e-3)


@pytest.mark.parametrize("n", [1, 800, 801, 838_860_801, 10**12, 10**15])
def test_sample_of_a_language_of_any_size(n):
    """The expected sample is whole, or some 800 documents: the share never becomes 0."""
    expected = n * (language.sample_bar(n, 4) + 1) / 2**63
    assert expected == pytest.approx(min(n, 800), rel=1e-2)


def test_languages_larger_than_the_sample(spark, docs, monkeypatch):
    monkeypatch.setattr(language, "PER_LANGUAGE", 5)
    model = language.fit(language.training_part(docs))
    assert model.languages == sorted(r[0] for r in docs.select("lang").distinct().collect())
    monkeypatch.setattr(language, "LANGUAGES", 2)
    assert len(language.fit(language.training_part(docs)).languages) == 2


def test_weights_are_sparse_and_scores_calibrated():
    r = np.random.default_rng(0)
    model = language.Model(["a", "b"], np.ones(language.DIMENSIONS))
    sample = []
    for _ in range(600):
        y = int(r.random() < 0.5)
        at = np.unique(np.append(r.integers(100, 2000, 20), (y if r.random() < 0.8 else 1 - y)))
        sample.append((y, at, np.ones(len(at), int)))
    language.train(model, sample)
    assert (model.weights != 0).any(axis=1).sum() < 1000
    p = [language.softmax(model.logits(at, n) / model.temperature) for _, at, n in sample[-120:]]
    right = np.mean([x.argmax() == y for x, (y, _, _) in zip(p, sample[-120:], strict=True)])
    assert np.mean([x.max() for x in p]) == pytest.approx(right, abs=0.12)


def test_quality_of_held_out_documents(spark, monkeypatch):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet").where("doc_id < 4000"), spark.read.parquet(f"{base}/labels.parquet").where("doc_id < 4000")
    patched(monkeypatch, quality, documents=docs, labels=labels)
    rows = quality.op7_quality(spark, "").join(labels, "doc_id").where("held_out").collect()
    y, score = np.array([r["quality"] for r in rows]), np.array([r["score"] for r in rows])
    rank = score.argsort().argsort()
    auc = (rank[y == 1].sum() - (n := (y == 1).sum()) * (n - 1) / 2) / (n * (len(y) - n))
    assert auc > 0.97
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95


def test_quality_odd_rows(spark, odd, empty, monkeypatch):
    labels = spark.createDataFrame([(1, 0), (7, 1), (None, 1), (13, None), (999, 0)], "doc_id long, quality int")
    patched(monkeypatch, quality, documents=odd, labels=labels)
    rows = quality.op7_quality(spark, "").collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    patched(monkeypatch, quality, documents=odd, labels=labels.limit(0))
    assert {r["score"] for r in quality.op7_quality(spark, "").collect()} == {0.5}
    patched(monkeypatch, quality, documents=empty, labels=labels)
    assert quality.op7_quality(spark, "").collect() == []


def plain_statistics(text):
    """The statistics a character at a time, over the UTF-8 bytes."""
    from math import log, log1p, sqrt

    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * len(quality.STATISTICS)
    blank = lambda b: b < 128 and chr(b).isspace()
    shown = sum(not blank(b) for b in data)
    share = lambda f: sqrt(sum(map(f, (chr(b) for b in data if b < 128 and not blank(b)))) / shown)
    lines = [x for x in data.split(b"\n") if x.strip()]
    distinct = set(words)
    short, mean = sum(map(len, distinct)) / len(distinct), shown / len(words)
    odd = lambda c: not (c.isdigit() or c.isalpha() or c in ".,;:?'\"()-|!")
    entropy = -sum((n := data.count(b)) / len(data) * log(n / len(data)) for b in {bytes([b]) for b in data})
    return [
        log1p(len(words)), log(mean), log(short) - log(mean), share(odd), share(lambda c: c in ".,;:?'\"()-"), share(str.isdigit), share(str.isupper),
        sqrt((len(lines) - len(set(lines))) / len(lines)), log(len(words) / len(distinct)) / log1p(len(words)), log1p(len(words) / len(lines)),
        share(lambda c: c == "|"), share(lambda c: c == "!"), sqrt(len(distinct) / len(words)), entropy,
    ]


def test_quality_equals_plain_discriminant(spark, sf_dir, docs):
    """Scores of the whole table against statistics, covariances and inverses taken plainly."""
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    x = {r["doc_id"]: np.array(plain_statistics(r["text"])) for r in docs.collect()}
    taught = [(y, x[d]) for d, y in labels.items() if zlib.crc32(str(d).encode()) % 5]
    n = [sum(y == k for y, _ in taught) for k in (0, 1)]
    mean = [np.mean([v for y, v in taught if y == k], axis=0) for k in (0, 1)]
    own = [np.cov(np.array([v for y, v in taught if y == k]).T, bias=True) for k in (0, 1)]
    pooled = (n[0] * own[0] + n[1] * own[1]) / sum(n)
    logs = []
    for k in (0, 1):
        c = (1 - quality.TO_POOLED) * own[k] + quality.TO_POOLED * pooled
        c = (1 - quality.TO_DIAGONAL) * c + quality.TO_DIAGONAL * np.diag(np.diag(c)) + quality.RIDGE * np.diag(np.maximum(np.diag(pooled), 1e-6))
        logs.append(lambda v, k=k, inverse=np.linalg.inv(c), det=np.linalg.slogdet(c)[1]: -0.5 * (v - mean[k]) @ inverse @ (v - mean[k]) - 0.5 * det)
    difference = lambda v: float(np.clip(logs[1](v) - logs[0](v), -quality.SPAN, quality.SPAN))
    prior = np.log(n[1] / n[0])
    binned = [(y, round(difference(v) * 4) / 4) for y, v in taught]
    loss = lambda t: sum(np.log1p(np.exp(np.clip(prior + t * d, -50, 50) * (1 - 2 * y))) for y, d in binned)
    factor = min(np.geomspace(0.02, 2, 60), key=loss)
    for r in quality.op7_quality(spark, sf_dir).collect():
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-(prior + factor * difference(x[r["doc_id"]])))), abs=1e-6)
        assert r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_discriminant_equals_the_formula():
    r = np.random.default_rng(1)
    d = len(quality.STATISTICS)
    x = [r.normal(0, 1, (500, d)), r.normal(0.5, 2, (300, d))]
    model = quality.model_of(np.array([500.0, 300.0]), np.array([a.sum(0) for a in x]), np.array([a.T @ a for a in x]))
    at = r.normal(0, 1, (5, d))
    logs = []
    for k in (0, 1):
        c = model.factors[k] @ model.factors[k].T
        diff = at - x[k].mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(c), diff) - 0.5 * np.linalg.slogdet(c)[1])
    assert np.allclose(model.difference(at), np.clip(logs[1] - logs[0], -quality.SPAN, quality.SPAN))
