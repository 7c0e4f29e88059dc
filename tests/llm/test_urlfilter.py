"""Verdicts against DuckDB SQL and plain rules; cascades against sets."""

import random

import numpy as np
import pytest

from terrace.llm import urlfilter
from tests.compare import duck, rows


def plain(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i, c in enumerate(rest) if c in "/?#"] + [len(rest)])
        host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        if rest[:1] == "/":
            path = rest[: min([i for i, c in enumerate(rest) if c in "?#"] + [len(rest)])]
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.com/en/x", "http://example.com", "http://example.com?x/en/", "https://www.example.com/en/", "x://a.www.example.com/en/y?z#t", "http://notexample.com/en/",
    "http://a.net/es/1", "http://a.net/fr", "http://net/fr/", "http://.com/", "http://com/", "http://user@a.com/", "http://a.com:80/", "http://ÉA.com/", "http://a.com/en/://b.net/es/", "://c.net/es/", "http://" + "a." * 20_000 + "com/" + "x" * 50_000, "http://a.b#/en/",
]


def query(spark, pages, rules=urlfilter.RULES):
    found = urlfilter.judge(pages, rules)
    return sorted((tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict")) for r in found.collect()), key=repr)


@pytest.mark.parametrize("sizes", [None, (7, 2, 5)])
def test_urls(spark, monkeypatch, sizes):
    """Also with several shards, blocks and slices."""
    for name, n in zip(("SHARD_KEYS", "BLOCK_KEYS", "SLICE"), sizes or (), strict=False):
        monkeypatch.setattr(urlfilter, name, n)
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(URLS)] + [(None, URLS[4], None, None), (3, URLS[4], "c", "c")], "page_id long, url string, host string, keys string")
    expected = sorted(((r["page_id"], *plain(r["url"], urlfilter.RULES)) for r in pages.collect()), key=repr)
    assert query(spark, pages) == expected
    assert query(spark, pages.limit(0)) == []
    assert {r[-1] for r in query(spark, pages, [])} == {"allow"}


def test_equals_sql(spark, sf_dir):
    df = urlfilter.op2_url_filter(spark, sf_dir)
    found = duck(sf_dir).execute(urlfilter.ORACLES["op2_url_filter"])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in found.description], found.fetchall())


def test_many_rules(spark):
    r = random.Random(0)
    host = lambda: ".".join(r.choice(["a", "b", "c", "x1"]) for _ in range(r.randint(1, 4)))
    path = lambda: "/" + "/".join(r.choice(["p", "q", "rr"]) for _ in range(r.randint(0, 3)))
    rules = sorted({(h, p): v for v, h, p in ((r.choice(["allow", "block"]), host(), path()) for _ in range(150))}.items())
    rules = [(v, h, p) for (h, p), v in rules]
    pages = spark.createDataFrame([(i, f"http://{host()}{path()}{path()}") for i in range(1500)], "page_id long, url string")
    # rules of one length can fit one url: then any of them is the longest
    got = query(spark, pages, rules)
    for (i, h, p, rule, verdict), u in zip(sorted(got), [x["url"] for x in sorted(pages.collect())], strict=True):
        want = plain(u, rules)
        assert (h, p, len(rule or "")) == (*want[:2], len(want[2] or ""))
        assert rule is None or (verdict, rule) in {(v, a + b) for v, a, b in rules}


def test_cascade_is_exact_on_its_universe():
    keys = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, (200_000, 2))
    cascade = urlfilter.build_cascade(keys[:3000], keys[3000:])
    assert len(cascade.levels) > 2
    assert cascade.has(keys[:, 0], keys[:, 1]).tolist() == [i < 3000 for i in range(200_000)]


def test_two_million_rules(spark):
    """A table of rules that one block doesn't hold."""
    n = 2_000_000
    rules = spark.range(n).selectExpr("CASE WHEN id % 3 = 0 THEN 'block' ELSE 'allow' END AS verdict", "concat('h', id, '.org') AS host", "CASE WHEN id % 2 = 0 THEN '/' ELSE '/en/' END AS path")
    pages = [(i, f"http://www.h{i * 40_009 % (2 * n)}.org/{'en/' if i % 5 else 'x'}") for i in range(3000)]
    got = query(spark, spark.createDataFrame(pages, "page_id long, url string"), rules)
    want = []
    for i, u in pages:
        k = i * 40_009 % (2 * n)
        path = "/en/" if i % 5 else "/x"
        rule = f"h{k}.org/" + ("" if k % 2 == 0 else "en/")
        listed = k < n and (k % 2 == 0 or path == "/en/")
        want.append((i, f"www.h{k}.org", path, rule if listed else None, ("block" if k % 3 == 0 else "allow") if listed else "allow"))
    assert got == sorted(want, key=repr)
