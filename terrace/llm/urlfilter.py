"""URL filters by Bloom filter cascades (operator 2).

A rule is a key, host plus the beginning of a path; it fits its host and all subdomains.  A url's
candidate keys are its host's suffixes and its path's beginnings in the numbers of labels and characters
that some rule has, so their number is bounded by the rules' shapes and not by the url.

Keys are dealt into shards by hash.  For each shard and list (block, allow) a cascade is built over the
corpus's complete universe of candidate keys there: level 1 encodes the listed keys; level 2 the keys of
the universe that level 1 wrongly passes; level 3 the listed keys that level 2 passes; and so on until no
key is passed wrongly.  On that universe membership is exact, without a join of urls and lists.  A
shard's task builds its cascades by itself, so lists and universe may have any size.  The cascades are
written in blocks of bounded size; a worker holds one block at a time and judges a large slice of urls by
each block in turn (one block that is all there is stays with it).  Of a url's listed candidates the
longest wins; a url without any gets the method's verdict for unlisted keys, allow.

Defined results: a null url, or one without ://, has an empty host and path and no rule; a rule listed
both ways blocks; of listed candidates of one length, which can't be one key, the greater by bytes wins;
an empty list lists nothing; repeated pages are judged alike; an empty table gives no rows; columns other
than page_id and url are not read.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from terrace.llm.common import buckets, materialise, read_block, table, worker_cache, write_blocks

#: (verdict, host, path): the production rules.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
UNLISTED = "allow"
#: Keys of the universe and the lists in a shard, about; listed keys whose cascades share a block; candidates judged together.
SHARD_KEYS = 500_000
BLOCK_KEYS = 1_000_000
SLICE = 2_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*(/[^?#]*)", 1)


def candidates(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Keys by falling length, for the (labels, length of path) that rules have."""
    parts = F.split(host, r"\.")
    keys = [
        F.when((host != "") & (F.size(parts) >= n) & (F.length(path) >= m), F.concat(F.array_join(F.slice(parts, -n, n), "."), F.substring(path, 1, m)))
        for n, m in shapes
    ]
    if not keys:
        return F.array().cast("array<string>")
    by_length = F.sort_array(F.transform(F.array_compact(F.array(*keys)), lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))), asc=False)
    return F.transform(by_length, lambda k: k["key"])


def hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit(1), key)


class Bloom:
    def __init__(self, h1: np.ndarray, h2: np.ndarray, rate: float, level: int):
        n = max(1, len(h1))
        self.level = level
        self.k = max(1, round(-math.log2(rate)))
        self.bits = np.zeros((int(n * self.k * 1.45) + 64) // 8 + 1, np.uint8)
        for at in self._places(h1, h2):
            np.bitwise_or.at(self.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))

    @classmethod
    def of(cls, level: int, k: int, bits: bytes) -> Bloom:
        out = cls.__new__(cls)
        out.level, out.k, out.bits = level, k, np.frombuffer(bits, np.uint8)
        return out

    def _places(self, h1: np.ndarray, h2: np.ndarray) -> Iterator[np.ndarray]:
        m = np.uint64(8 * len(self.bits))
        a, b = h1.view(np.uint64), h2.view(np.uint64)
        salt = np.uint64(0x9E3779B97F4A7C15 * (2 * self.level + 1) % 2**64)
        a, b = (a ^ salt) * np.uint64(0xFF51AFD7ED558CCD), (b ^ salt) * np.uint64(0xC4CEB9FE1A85EC53) | np.uint64(1)
        for i in range(self.k):
            x = a + np.uint64(i) * b
            yield ((x ^ x >> np.uint64(31)) % m).astype(np.int64)

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.ones(len(h1), bool)
        for at in self._places(h1, h2):
            out &= (self.bits[at >> 3] >> (at & 7) & 1).astype(bool)
        return out


class Cascade:
    """Levels of filters: the odd ones encode listed keys, the even ones false positives."""

    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(h1), bool), np.arange(len(h1))
        for i, level in enumerate(self.levels):
            passed = level.has(h1[open_], h2[open_])
            out[open_[passed]] = i % 2 == 0  # until the next level says otherwise
            open_ = open_[passed]
        return out


def build_cascade(listed: np.ndarray, others: np.ndarray) -> Cascade:
    """listed, others: rows of two hashes; others are the universe's keys that aren't listed.

    Level 1 is so sharp that fewer of the others are expected to pass than there are listed keys.
    """
    if not len(listed):
        return Cascade([])
    levels = [Bloom(listed[:, 0], listed[:, 1], min(0.5, len(listed) / max(1, len(others))), 1)]
    wrong, right = others[levels[0].has(others[:, 0], others[:, 1])], listed
    while len(wrong):  # level 2, 4, ... encode wrong ones and test right ones; 3, 5, ... the other way
        levels.append(Bloom(wrong[:, 0], wrong[:, 1], 0.5, len(levels) + 1))
        wrong, right = right[levels[-1].has(right[:, 0], right[:, 1])], wrong
    return Cascade(levels)


def build_shard(blocks: int):
    """A shard's rows (shard, h1, h2, verdict: 1 blocks, 0 allows, null for the universe) -> its two cascades in a row."""

    def run(rows: pa.Table) -> pa.Table:
        keys = np.stack([rows.column(c).to_numpy() for c in ("h1", "h2")], axis=1)
        verdict = rows.column("verdict").fill_null(-1).to_numpy()
        found: dict[str, Cascade] = {}
        known = {tuple(k) for k in keys[verdict >= 0].tolist()}
        free = keys[verdict < 0]
        free = free[np.fromiter((tuple(k) not in known for k in free.tolist()), bool, len(free))] if known else free
        for name, v in (("block", 1), ("allow", 0)):
            own = keys[verdict == v]
            found[name] = build_cascade(own, np.concatenate([free, keys[verdict == 1 - v]]))
        plain = {name: [(x.level, x.k, x.bits.tobytes()) for x in c.levels] for name, c in found.items()}
        shard = rows.column("shard")[0].as_py()
        return pa.table({"block": pa.array([shard % blocks], pa.int64()), "shard": pa.array([shard], pa.int64()), "cascades": pa.array([pickle.dumps(plain)], pa.binary())})

    return run


def load_block(path: str, block: int) -> dict[int, dict[str, Cascade]]:
    """shard -> its cascades, of one block of the table that write_cascades() wrote."""
    found = read_block(path, block, ["shard", "cascades"])
    return {shard: {verdict: Cascade([Bloom.of(*level) for level in levels]) for verdict, levels in pickle.loads(packed).items()} for shard, packed in found}


def write_cascades(listed: DataFrame, universe: DataFrame) -> tuple[str, int, int]:
    """listed: key, verdict; universe: key, distinct.  The table's path, and how many shards and blocks it has."""
    n = listed.count()
    shards, blocks = buckets(n + universe.count(), SHARD_KEYS), buckets(n, BLOCK_KEYS)
    hashed = lambda df, verdict: df.select(*(h.alias(f"h{i}") for i, h in enumerate(hashes(F.col("key")), 1)), verdict.cast("byte").alias("verdict"))
    rows = hashed(listed, (F.col("verdict") == "block").cast("int")).union(hashed(universe, F.lit(None)))
    rows = rows.select(shard_of(F.col("h2"), shards).alias("shard"), "h1", "h2", "verdict")
    built = rows.groupBy("shard").applyInArrow(build_shard(blocks), "block long, shard long, cascades binary")
    return write_blocks(built, "cascades", blocks), shards, blocks


def shard_of(h2: Column, shards: int) -> Column:
    return F.pmod(F.shiftright(h2, 7), F.lit(shards).cast("long"))


def as_rules(spark: SparkSession, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """(verdict, host, path) rows; a table of them may have any size."""
    return rules if isinstance(rules, DataFrame) else spark.createDataFrame(rules, "verdict string, host string, path string")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    spark = pages.sparkSession
    rules = as_rules(spark, rules)
    labels = F.length("host") - F.length(F.replace("host", F.lit("."))) + 1
    shapes = sorted(map(tuple, rules.select(labels, F.length("path")).distinct().collect()))  # a few hundred for any list
    listed = materialise(rules.groupBy(F.concat("host", "path").alias("key")).agg(F.max("verdict").alias("verdict")), "listed")
    host, path = host_and_path(F.col("url").cast("string"))
    parsed = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    parsed = materialise(parsed.withColumn("keys", candidates(F.col("host"), F.col("path"), shapes)), "candidates")
    universe = materialise(parsed.select(F.explode("keys").alias("key")).distinct(), "universe")
    folder, shards, blocks = write_cascades(listed, universe)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds at: 1 + the place of the first listed key, negative if it blocks, 0 if none is listed."""
        for batch in slices(batches):
            h1, h2 = (batch.column(c).combine_chunks().flatten().to_numpy() for c in ("h1", "h2"))
            size = pa.compute.list_value_length(batch.column("h1")).to_numpy().astype(np.int64)
            shard = (h2 >> 7) % shards
            blocked, allowed = np.zeros(len(h1), bool), np.zeros(len(h1), bool)
            for block in range(blocks):
                own = worker_cache("urlfilter", f"{folder}:{block}", lambda b=block: load_block(folder, b)) if blocks == 1 else load_block(folder, block)
                there = np.flatnonzero(shard % blocks == block) if blocks > 1 else np.arange(len(h1))
                by = there[np.argsort(shard[there], kind="stable")]
                edges = np.flatnonzero(np.diff(shard[by], prepend=-1, append=-1))
                for a, b in zip(edges, edges[1:], strict=False):
                    at, lists = by[a:b], own.get(int(shard[by[a]]))
                    if lists:
                        blocked[at], allowed[at] = lists["block"].has(h1[at], h2[at]), lists["allow"].has(h1[at], h2[at])
            hit = np.flatnonzero(blocked | allowed)
            row = np.repeat(np.arange(len(size)), size)[hit]
            rows, first = np.unique(row, return_index=True)
            at = np.zeros(len(size), np.int32)
            place = hit[first] - (np.cumsum(size) - size)[rows] + 1
            at[rows] = np.where(blocked[hit[first]], -place, place)
            yield from batch.drop_columns(["h1", "h2"]).append_column("at", pa.array(at)).to_batches()

    h1, h2 = F.transform("keys", lambda k: hashes(k)[0]), F.transform("keys", lambda k: hashes(k)[1])
    judged = parsed.select("*", h1.alias("h1"), h2.alias("h2")).mapInArrow(best, StructType([*parsed.schema.fields, StructField("at", IntegerType())]))
    rule = F.when(F.col("at") != 0, F.element_at("keys", F.abs("at")))
    verdict = F.when(F.col("at") < 0, "block").when(F.col("at") > 0, "allow").otherwise(UNLISTED)
    return judged.select("page_id", "host", "path", F.when(F.col("at") != 0, rule).alias("rule"), verdict.alias("verdict"))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches in tables of about SLICE candidate keys."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch.column("h1").flatten())
        if size >= SLICE:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


_VALUES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
ORACLES = {
    "op2_url_filter": f"""
WITH rules(verdict, rhost, rpath) AS (VALUES {_VALUES}),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parsed AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
                  regexp_extract(r, '^[^/?#]*(/[^?#]*)', 1) AS path FROM rest),
best AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
         FROM parsed JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, '{UNLISTED}') AS verdict FROM parsed LEFT JOIN best USING (page_id)"""
}
QUERIES = {"op2_url_filter": op2_url_filter}
