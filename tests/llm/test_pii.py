"""Spans against Python's regular expressions and plain validators."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from terrace.llm import pii
from terrace.plans import inspect
from tests.llm.conftest import pairs

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(n):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(n))) % 10 == 0


def good(kind, m):
    n = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 14 <= len(n) <= 19 and luhn(n)
    return kind == "email" or 10 <= len(n) <= 15


def brute(text):
    spans, counts = [], []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        found = [m for m in re.finditer(pattern, text or "") if good(kind, m[0])]
        counts.append(len(found))
        spans += [(m.start(), k, kind, m.end()) for m in found]
    return *counts, hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans)).encode()).hexdigest()


HARD = [
    "a@b.c_d@e.f a@b.c.d@e.f. @x.y x@y %+@a-b.c-d.e",
    "1.2.3.4.5.6.7.8 01.002.0003.255 1.2.3.256 1.2.3 0000000000000000000001.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1111 1111 37828224631000 5 6 7 - 8",
    "+1 (017) 555-7713+44 20 7946 0958 +1 2 +1234567890123456 + 1 2",
    "é" * 50 + "mail x.y@z.co 日本 10.0.0.1 \U0001f600 +49 (0) 30-901820",
    "9" * 5000 + " " + "a" * 5000 + " a@" + "b" * 3000 + ".c" * 3000,
    " ".join(f"u{i}@h{i}.org" for i in range(700)),
    "+1 " + " " * 3000 + "x +1" + "." * 2000 + "2345678901",
]


def query(spark, monkeypatch, df):
    monkeypatch.setattr(pii, "table", lambda *_: df)
    return pii.op4_pii(spark, "")


def check(found, rows):
    got = sorted(((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in found.collect()), key=repr)
    assert got == sorted(((d, *brute(t)) for d, t in rows), key=repr)


def test_equals_python(spark, docs, monkeypatch):
    found = query(spark, monkeypatch, docs)
    assert not any("Python" in n or "Arrow" in n or "Pandas" in n for n in inspect.nodes(found))
    check(found, pairs(docs))


def test_hard_and_odd_texts(spark, odd, monkeypatch):
    hard = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    check(query(spark, monkeypatch, hard), pairs(hard))
    check(query(spark, monkeypatch, odd), pairs(odd))


def test_random_texts(spark, monkeypatch):
    import random

    r = random.Random(3)
    rows = [(i, "".join(r.choice("aZ09@.+-_% ()é1234567.@") for _ in range(r.randint(0, 120)))) for i in range(400)]
    check(query(spark, monkeypatch, spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_empty(spark, empty, monkeypatch):
    assert query(spark, monkeypatch, empty).collect() == []
    assert pii.redact(empty).collect() == []


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("pay to DE89 3704 0044 0532 0130 00 please", "iban:7:34"),
        ("pay to DE89370400440532013000, not DE88370400440532013000", "iban:7:29"),
        ("my ssn is 078-05-1120", "ssn:10:21"),
        ("part 078-05-1120", ""),
        ("ssn 1078-05-1120 ssn 078-05-11201", ""),
        ("tel 212-555-0100, étel 212.555.0101, IBAN xDE89370400440532013000", "local_phone:4:16,local_phone:23:35"),
        ("call (212) 555-0100 now", "local_phone:5:19"),
        ("(212) 555-0100", ""),
        ("call +1 (212) 555-0100", "phone:5:22"),
    ],
)
def test_own_kinds(spark, monkeypatch, text, spans):
    assert query(spark, monkeypatch, spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["spans"] == spans


def test_equals_sql(spark, docs, monkeypatch, tmp_path):
    import duckdb

    from tests.compare import rows

    texts = [*HARD, "pay DE89 3704 0044 0532 0130 00 or DE89370400440532013000x GB82WEST12345698765432", "my ssn is 078-05-1120", "part 078-05-1120", "call (212) 555-0100 now; call +1 (212) 555-0100", "tel: 212-555-0100 order 212-555-0199", None, ""]
    made = spark.createDataFrame([(100_000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    made.write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    found = con.execute(pii.ORACLES["op4_pii"])
    df = query(spark, monkeypatch, spark.read.parquet(f"{tmp_path}/d"))
    got = df.collect()
    assert sum("iban" in r["spans"] for r in got) == 1 and sum("ssn" in r["spans"] for r in got) == 1
    assert rows(df.columns, got) == rows([c[0] for c in found.description], found.fetchall())


def test_redact(spark, odd):
    rows = spark.createDataFrame([(1, "x a@b.co, 10.0.0.1!", 19, "clash"), (2, None, None, None), (3, "none", 4, None)], "doc_id long, text string, n_chars int, spans string")
    assert [tuple(r) for r in pii.redact(rows).orderBy("doc_id").collect()] == [(1, "x <EMAIL>, <IP>!", 16, "clash"), (2, None, None, None), (3, "none", 4, None)]
    out = pii.redact(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert out.where(F.col("text").contains("a.b@c.de")).count() == 0


def plain_redacted(text, spans):
    out, at = "", 0
    for kind, a, b in spans:
        if a >= at:
            out += text[at:a] + f"<{kind.upper()}>"
        at = max(at, b)
    return out + text[at:]


def test_redact_long_texts_in_chunks(spark, docs, monkeypatch):
    """Spans of all kinds, overlapping ones too, before, on and behind the edges of chunks, and in two blocks of a scan."""
    import random

    r = random.Random(4)
    bits = ["a.b@c.de", "10.0.0.1", "call 212-555-0100", "+1 (017) 555-7713", "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00", "ssn 078-05-1120", "1.2.3.4@x.yz", "word", "日本😀 é", "\n", "tel 4111 1111 1111 1111 212-555-0100"]
    rows = [(i, "".join(r.choice(bits) + r.choice([" ", ", ", "  x "]) for _ in range(r.choice([3, 300, 1500])))) for i in range(12)]
    monkeypatch.setattr(pii, "BLOCK", 4)
    monkeypatch.setattr(pii, "CHUNK", 5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(query(spark, monkeypatch, df), rows)
    found = {x["doc_id"]: [(y.split(":")[0], *map(int, y.split(":")[1:])) for y in x["spans"].split(",") if y] for x in query(spark, monkeypatch, df).collect()}
    assert {k for x in found.values() for k, _, _ in x} == set(pii.KINDS)
    base = [s for x in found.values() for s in x if s[0] in pii.BASE]
    assert base and not any(a < d and c < b for x in found.values() for k, a, b in x if k in pii.OWN for j, c, d in x if j in pii.BASE)
    assert dict(pairs(pii.redact(df))) == {d: plain_redacted(t, found[d]) for d, t in rows}


def test_time_a_match_stays(spark):
    """A hundred thousand matches in one text take about the time a match of ten thousand."""
    import time

    def run(n):
        df = spark.createDataFrame([(1, " ".join(f"u{i}@h{i}.org" for i in range(n)))], "doc_id long, text string").coalesce(1)
        began = time.time()
        assert pii.redact(df).where(F.col("text").contains("@")).count() == 0
        return time.time() - began

    run(1_000)
    small, large = run(10_000), run(100_000)
    assert large < 2 * 10 * small


def test_names_cannot_clash(spark):
    names = ["doc_id", "text", "row", "chunks", "base", "spans", "email", "new", "a.b", "m", "x`y", "__text"]
    df = spark.createDataFrame([(1, "x a@b.co", *names[2:])], ", ".join(f"`{n.replace('`', '``')}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    out = pii.redact(df)
    assert out.columns == names and tuple(out.first()) == (1, "x <EMAIL>", *names[2:])


FULL_GROUPS = [
    ("pay to BE68 5390 0754 7034 Thanks", "iban:7:26"),
    ("pay to BE68 5390 0754 7034 EUR 5", "iban:7:26"),
    ("pay to BE68 5390 0754 7034 NOW PLEASE", "iban:7:26"),
    ("AT61 1904 3002 3457 3201 Danke", "iban:0:24"),
    ("ES91 2100 0418 4502 0005 1332 Gracias", "iban:0:29"),
    ("PL61 1090 1014 0000 0712 1981 2874 Bank", "iban:0:34"),
    ("BE68 5390 0754 7034 DE89 3704 0044 0532 0130 00 x", "iban:0:19,iban:20:47"),
    ("BE68 5390 0754 7035 Thanks", ""),
    ("xBE68 5390 0754 7034 BE68 5390 0754 7034x", ""),
]


def test_full_groups_before_a_word(spark, monkeypatch):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(FULL_GROUPS)], "doc_id long, text string")
    assert {r["doc_id"]: r["spans"] for r in query(spark, monkeypatch, df).collect()} == {i: x for i, (_, x) in enumerate(FULL_GROUPS)}
    assert pii.redact(df.where("doc_id = 0")).first()["text"] == "pay to <IBAN> Thanks"
