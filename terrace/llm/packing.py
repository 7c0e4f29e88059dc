"""Packing by Karmarkar-Karp multiway differencing (operator 3).

A document's ids are cut into whole windows and a rest; the rest is cut into near-equal pieces of at
most PIECE ids.  Whole windows are sequences of their own.  The pieces are dealt by a hash of what they are
and of their place in the table of pieces, so that repeated rows are dealt out too, into groups of about
GROUP pieces, and each group is partitioned into windows: every piece starts as a
partial partition of its own, the two partial partitions with the largest spread are merged, the
fullest window of one with the emptiest of the other, until one is left.  Its windows are near-equal;
where one exceeds the capacity, the number of windows rises and the group is partitioned again.

Defined results: a null text is an empty one, and an empty one has the end id alone; rows with a null
or repeated doc_id are packed like any other row; an empty table gives no pieces; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.common import buckets, materialise, table
from terrace.llm.wordids import default_path, encoder

CAPACITY = 2048
END = np.array([1], "<u4")
#: Longest piece of a document's rest, and pieces in a group.
PIECE = 512
GROUP = 2048
#: No group is larger: 45 standard deviations above GROUP.
MOST = 2 * GROUP

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cuts(n: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole windows, then near-equal parts of the rest."""
    whole, rest = divmod(n, capacity)
    out = [(i * capacity, capacity) for i in range(whole)]
    if rest:
        k = -(-rest // piece)
        at = [n - rest + rest * i // k for i in range(k + 1)]
        out += [(a, b - a) for a, b in zip(at, at[1:], strict=False)]
    return out


def differencing(sizes: np.ndarray, k: int) -> list[list[int]]:
    """The items of each of k windows, by the largest differencing method.

    A partial partition is the ascending sums of its windows that hold anything (the others of its k
    are empty) and a node for each of them; nodes form a forest over the items.  Single items wait in
    falling order: while they are the largest, merging them one by one fills a partition's empty
    windows in that order, so it is done for all of them at once.
    """
    if k == 1:
        return [list(range(len(sizes)))]
    left, right = [-1] * len(sizes), [-1] * len(sizes)
    order = np.argsort(-sizes, kind="stable")
    single, n, p = sizes[order].astype(np.int64), len(sizes), 0
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []

    def put(sums: np.ndarray, nodes: np.ndarray) -> None:
        heapq.heappush(heap, (-int(sums[-1] - (sums[0] if len(sums) == k else 0)), int(nodes[0]), sums, nodes))

    while len(heap) + n - p > 1 or not heap:
        spread = -heap[0][0] if heap else 0
        q = min(k, int(np.searchsorted(-single[p:], -spread, "right")))
        if q > 1 or not heap:
            put(single[p : p + q][::-1], order[p : p + q][::-1])
            p += q
            continue
        _, _, sa, na = heapq.heappop(heap)
        if heap and (p == n or -heap[0][0] >= single[p]):
            _, _, sb, nb = heapq.heappop(heap)
        else:
            sb, nb = single[p : p + 1], order[p : p + 1]
            p += 1
        over = len(sa) + len(sb) - k
        if over > 0:  # besides empty ones, the over emptiest windows of both meet, in opposite order
            first = len(left)
            left += na[:over].tolist()
            right += nb[:over][::-1].tolist()
            sums = np.concatenate([sa[:over] + sb[:over][::-1], sa[over:], sb[over:]])
            nodes = np.concatenate([np.arange(first, first + over), na[over:], nb[over:]])
        else:
            sums, nodes = np.concatenate([sa, sb]), np.concatenate([na, nb])
        by = np.argsort(sums, kind="stable")
        put(sums[by], nodes[by])
    out = []
    for node in heap[0][3].tolist():
        items, todo = [], [node]
        while todo:
            x = todo.pop()
            if left[x] < 0:
                items.append(x)
            else:
                todo += (left[x], right[x])
        out.append(items)
    return out


def windows(sizes: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """The items of windows within capacity; as few as the sum allows, more where one would exceed it."""
    k = -(-int(sizes.sum()) // capacity)
    while True:
        found = differencing(sizes, k)
        most = max(int(sizes[w].sum()) for w in found)
        if most <= capacity:
            return [w for w in found if w]
        k = max(k + 1, k * most // (capacity + (most - capacity) * 3 // 4))


def cut_documents(path: str):
    """Arrow batches of doc_id, text -> batches of PIECES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode.batch(batch.column(1)), strict=True):
                ids = np.append(ids, END)
                rows += [(doc, at, size, zlib.crc32(ids[at : at + size]), len(ids)) for at, size in cuts(len(ids))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5, schema=PIECES)

    return run


def pack_group(group: pd.DataFrame) -> pd.DataFrame:
    """A group's pieces with sequence_id (the group's number above 32 bits, the window's below) and offset."""
    if len(group) > MOST:
        raise ValueError("a group of pieces is larger than any hash deals out")
    group = group.sort_values(["doc_id", "start", "ids_crc32", "doc_tokens"], ignore_index=True, na_position="first")
    size = group["length"].to_numpy()
    whole = np.flatnonzero(size == CAPACITY)
    parts = np.flatnonzero(size < CAPACITY)
    window, offset = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
    window[whole] = np.arange(len(whole))
    for w, items in enumerate(windows(size[parts]) if len(parts) else []):
        rows = parts[np.sort(items)]
        window[rows] = len(whole) + w
        offset[rows] = np.cumsum(size[rows]) - size[rows]
    group["sequence_id"] = (group["g"].to_numpy() << 32) + window
    group["offset"] = offset
    return group.drop(columns="g")


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Pieces of all documents with their place: the columns of PACKED.

    One pass over the texts cuts them and takes each piece's checksum; from then on only lengths move.
    Groups have a bounded expected size whatever the input, so no task grows with it.
    """
    pieces = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut_documents(path or default_path()), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"), "pieces")
    n = buckets(pieces.count(), GROUP)
    place = F.monotonically_increasing_id()  # of a row in files that don't change: the same for a repeated task
    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", place), F.lit(n)))
    return dealt.groupBy("g").applyInPandas(pack_group, PACKED)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op3_packing": op3_packing}
ORACLES: dict[str, str] = {}
