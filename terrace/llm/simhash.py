"""SimHash near-duplicates by vantage-point trees (operator 5).

Fingerprints: A-Z lower-cased, words between ASCII white space, 3-word shingles with repeats (the
whole sequence if there are fewer words), XXH64 with seed 42 of their UTF-8, and a bit set where over
half of the hashes have it.  Texts without words have the fingerprint zero.

Links: equal fingerprints collapse first (a partial aggregate), so a group of copies costs one row.  A
vantage-point tree over a bounded sample of the distinct fingerprints deals all of them into shards:
at a node with vantage point v and bound m a fingerprint goes left if d(v, x) <= m, else right.  Left
of the bound by less than the radius, it also goes right as a query; a query goes to both sides where
|d(v, x) - m| lets the triangle inequality put a neighbour there.  So each pair within the radius meets
in exactly the shard that is the home of its right-hand member, or of both.  In a shard the same rule recurses
down to small leaves, where distances are taken.  A shard links the rows of each of its components to the
least of them: one edge a row, never all pairs.  Connected components of these edges come from alternating
large-star and small-star rounds, written to the shared folder, until all are stars around their least node.  The graph's
nodes are fingerprints, so what the ids are doesn't matter to it.

Defined results: a null text is an empty one; a row with a null doc_id links like any other (its
component_id is the least id there, null if there is none); repeated rows are copies, and rows that share
an id but not a text are rows of their own; an empty table gives no rows; columns other than doc_id and
text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.common import buckets, materialise, partitions, release, table, worker_cache

SEED = 42
SHINGLE = 3
RADIUS = 2
#: Fingerprints that shape the tree, whatever the input.
SAMPLE = 200_000
#: Fingerprints in a shard, as expected from the sample: so many that there are some four shards a
#: partition, within these bounds.  More shards than that would only repeat more queries.
SHARD = (2_000, 1_000_000)
#: Below this many fingerprints distances are taken directly.
LEAF = 192
#: Nodes with more than this share of all edges, and more than so many, are hubs: 2 * HUBS at most.
HUBS, HUB_EDGES = 1000, 64


def fingerprint(text: str | None) -> int:
    """As a signed 64-bit integer."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(b" ".join(x), SEED) for x in zip(words, words[1:], words[2:], strict=False)]
    h = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[i : i + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view(">i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("simhash", "nothing", lambda: None)  # lets go of another operator's
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def distances(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def tree(points: np.ndarray, leaves: int) -> list[tuple]:
    """A vantage-point tree of about leaves equal leaves: nodes (vantage, bound, left, right), a leaf is (number,)."""
    nodes: list[tuple] = []
    number = 0
    todo = [(points, leaves, -1, 0)]
    while todo:
        own, n, parent, side = todo.pop()
        me = len(nodes)
        if parent >= 0:
            at = list(nodes[parent])
            at[2 + side] = me
            nodes[parent] = tuple(at)
        if n > 1 and len(own) > 1:
            bound, vantage = split(own)
            if bound is not None:
                d = distances(own, vantage)
                nodes.append((vantage, bound, None, None))
                todo += [(own[d <= bound], n - n // 2, me, 0), (own[d > bound], n // 2, me, 1)]
                continue
        nodes.append((number,))
        number += 1
    return nodes


def split(points: np.ndarray) -> tuple[int | None, np.uint64]:
    """A bound and a vantage point that leave rows on either side; the bound is None if points are all equal."""
    vantage = points[0]
    d = distances(points, vantage)
    if not d.any():
        return None, vantage
    bound = int(np.median(d))
    if bound == d.max():
        bound -= 1
    return bound, vantage


def route(points: np.ndarray, nodes: list[tuple], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each point goes: (place in points, leaf, whether as a query)."""
    out = []
    todo = [(0, np.arange(len(points)), np.zeros(len(points), bool))]
    while todo:
        node, at, query = todo.pop()
        if not len(at):
            continue
        if len(nodes[node]) == 1:
            out.append((at, np.full(len(at), nodes[node][0]), query))
            continue
        vantage, bound, left, right = nodes[node]
        d = distances(points[at], vantage)
        go_left = (d <= bound) & ~query | query & (d - radius <= bound)
        stay_right = (d > bound) & ~query
        visit = (d <= bound) & (d + radius > bound) & ~query | query & (d + radius > bound)
        todo.append((left, at[go_left], query[go_left]))
        todo.append((right, at[stay_right | visit], (query | visit)[stay_right | visit]))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(bool)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Forest:
    """Union-find over arrays of links.

    A dense group has very many links, so links within a set are dropped together, and each round hooks
    every set that is left onto a smaller one that it has a link to.
    """

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        up = self.up
        root = up[x]
        while ((next_ := up[root]) != root).any():
            root = next_
        up[x] = root
        return root

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            p, q = self.find(a), self.find(b)
            apart = p != q
            a, b, p, q = a[apart], b[apart], p[apart], q[apart]
            high, first = np.unique(np.maximum(p, q), return_index=True)
            self.up[high] = np.minimum(p, q)[first]


def join(points: np.ndarray, home: np.ndarray, query: np.ndarray, radius: int, forest: Forest) -> None:
    """Links all pairs within radius of home x home and query x home (places in points)."""
    todo = [(home, query)]
    while todo:
        home, query = todo.pop()
        if not len(home) or len(home) + len(query) < 2:
            continue
        bound = None
        if len(home) > LEAF:
            bound, vantage = split(points[home])
        if bound is None:
            both = np.concatenate([home, query])
            for i in range(0, len(home), LEAF):  # blocks of rows bound the memory
                a, b = np.nonzero(distances(points[home[i : i + LEAF], None], points[both][None, :]) <= radius)
                keep = b > a + i
                forest.link(home[i : i + LEAF][a[keep]], both[b[keep]])
            continue
        dh, dq = distances(points[home], vantage), distances(points[query], vantage)
        left = dh <= bound
        near = home[left & (dh + radius > bound)]
        todo.append((home[left], query[dq - radius <= bound]))
        todo.append((home[~left], np.concatenate([near, query[dq + radius > bound]])))


def shard_links(radius: int):
    """The rows of one shard (leaf, fp, node, query) -> edges u < v between nodes."""

    def run(rows: pa.Table) -> pa.Table:
        points = rows.column("fp").to_numpy().view(np.uint64)
        node, query = rows.column("node").to_numpy(), rows.column("query").to_numpy().astype(bool)
        forest = Forest(len(points))
        join(points, np.flatnonzero(~query), np.flatnonzero(query), radius, forest)
        root = forest.find(np.arange(len(points)))
        least = np.full(len(points), np.iinfo(np.int64).max)
        np.minimum.at(least, root, node)
        centre = least[root]
        return pa.table({"u": centre[centre < node], "v": node[centre < node]})

    return run


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) of a graph over nodes whose components are those of all pairs within radius.

    distinct: fp, node; a fingerprint has one row.
    """
    spark = distinct.sparkSession
    rows = distinct.count()
    keep = max(1, min(1 << 30, rows and (1 << 30) * SAMPLE // rows))
    sample = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < keep).select("fp").limit(2 * SAMPLE).toPandas()["fp"].to_numpy(np.int64)
    sample = np.random.default_rng(0).permutation(np.sort(sample)).view(np.uint64)
    size = min(SHARD[1], max(SHARD[0], rows // (4 * partitions(spark))))
    nodes = tree(sample, buckets(rows, size)) if len(sample) else [(0,)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at, leaf, query = route(fp.view(np.uint64), nodes, radius)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(fp[at]), pa.array(node[at]), pa.array(query.astype(np.int8))], names=["leaf", "fp", "node", "query"])

    dealt = distinct.select("fp", "node").mapInArrow(deal, "leaf long, fp long, node long, query byte")
    return dealt.groupBy("leaf").applyInArrow(shard_links(radius), "u long, v long")


def with_least(edges: DataFrame, total: int) -> DataFrame:
    """edges (u, v) with m, the least v of u's edges; total: how many edges there are.

    A join on u would bring all edges of a hub to one task.  Hubs are the nodes with more than a
    HUBS-th of all edges, so there are fewer than HUBS of them: these few rows are broadcast and their
    edges stay where they are; the others are dealt by u, none with more than that share.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    bar = max(HUB_EDGES, total // HUBS)
    hubs = F.broadcast(least.where(F.col("n") > bar).select("u", "m"))
    others = least.where(F.col("n") <= bar).select("u", "m")
    return edges.join(hubs, "u").unionByName(edges.join(hubs, "u", "left_anti").join(others, "u"))


def state(edges: DataFrame) -> tuple[int, bool]:
    """How many edges (u, v < u) there are, and whether all components are stars around their least node."""
    ends = edges.select(F.inline(F.array(*(F.struct(F.col(x).alias("x"), F.lit(up).alias("up")) for x, up in (("u", 1), ("v", 0))))))
    nodes = ends.groupBy("x").agg(F.sum("up").alias("ups"), F.count("*").alias("n"))
    total, bent = nodes.agg(F.sum("ups"), F.max((F.col("ups") > 0) & (F.col("n") > 1))).first()
    return total or 0, not bent


def components(edges: DataFrame) -> DataFrame:
    """Per node of the edges (u, v): its component's smallest node; by large-star and small-star rounds.

    Each round is a table in the shared folder; it goes when the next one is written.
    """
    edges = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    total, done = state(edges)
    while not done:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = with_least(both, 2 * total).select("u", "v", F.least("u", "m").alias("m"))
        large = materialise(near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        small = with_least(large, total)  # v < u here; no more of them than edges
        new = materialise(small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        release(large)
        release(edges)
        edges = new
        total, done = state(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def classes(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    fps = materialise(fingerprints(docs), "fingerprints")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp", F.col("fp").alias("node")), radius))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(F.coalesce("root", "fp").alias("u"), F.col("least").alias("v"), F.col("fp").alias("fp_"))
    rooted = materialise(rooted, "rooted")
    named = with_least(rooted, rooted.count()).select("fp_", F.col("m").alias("component_id"))
    return fps.join(named, F.col("fp") == F.col("fp_"), "left").select("doc_id", "fp", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op5_simhash": op5_simhash}
ORACLES: dict[str, str] = {}
