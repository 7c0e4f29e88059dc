"""Token counts from pre-token frequencies (operator 8).

No piece of the vocabulary goes on behind a word: each is blanks followed by other characters.  So a
text's pieces are those of its pre-tokens: cut before each run of blanks and around each line feed
(checked against the vocabulary when the model is loaded).

Documents are read in shards.  A shard's distinct pre-tokens, with the places of the documents that
have them and how often, are dealt by hash into BUCKETS packed rows.  A bucket's task gets these from
GROUP shards, so it has all uses of its pre-tokens there: it counts each distinct one once by the
library, joins the count to the frequencies and sums per document.  The buckets' sums then meet per
shard.  No ids are made for documents and no vocabulary is broadcast; a hot pre-token has one entry a
document and GROUP bounds how many of these a task gets.

Defined results: a null or empty text has no bytes and no tokens; rows with a null or repeated doc_id
are counted like any other row; an empty table gives no rows; columns other than doc_id and text are
not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.common import table, worker_cache

LIMIT = 4096
#: A shard ends at so many bytes of text or documents; a document's place must fit 16 bits.
SHARD_BYTES = 24 << 20
SHARD_DOCS = 1 << 15
#: Rows that a shard's pre-tokens are packed into, and shards whose buckets meet in a task.
BUCKETS = 32
GROUP = 64
#: Frequencies share 32 bits with the place; larger ones are split.
LOW = (1 << 16) - 1

#: A shard's bucket: pre-tokens joined by blanks, and how many documents each has, their places and
#: frequencies as little-endian integers; its documents are bucket -1.
PACKED = "grp long, bucket int, shard long, tokens string, sizes binary, places binary, counts binary, doc_ids array<long>, n_bytes array<long>"
SUMS = "shard long, sums binary, doc_ids array<long>, n_bytes array<long>"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load(path: str):
    """The library's model, if its pieces allow the cut into pre-tokens."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.vocab_size()))
    if not all(re.fullmatch("▁*[^▁\n]*", p) for p in pieces):
        raise ValueError("a piece goes on behind a word or holds a line feed: texts can't be cut into pre-tokens")
    return model


def pretokens(text: str) -> Counter:
    """How often each pre-token is in text, with blanks written as U+2581; the library puts one before a text."""
    out: Counter = Counter()
    if not text:
        return out
    lines = ("▁" + text.replace("▁", " ")).split("\n")
    if len(lines) > 1:
        out["\n"] = len(lines) - 1
    for line in lines:
        if "  " in line or line[-1:] == " " or line[:2] == "▁ ":
            out.update(re.findall("▁+[^▁]*|[^▁]+", line.replace(" ", "▁")))
        elif line:
            first, *rest = line.split(" ")
            if first:
                out[first] += 1
            out.update(["▁" + w for w in rest])
    return out


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def pack_shard(shard: int, uses: dict[str, list[int]], doc_ids: list, n_bytes: list[int]) -> pa.RecordBatch:
    """The rows of one shard."""
    tokens = list(uses)
    sizes = np.fromiter(map(len, uses.values()), np.int64, len(uses))
    flat = np.fromiter(chain.from_iterable(uses.values()), np.uint32, int(sizes.sum()))
    bucket = np.fromiter((zlib.crc32(t.encode("utf-8", "surrogatepass")) % BUCKETS for t in tokens), np.int64, len(tokens))
    order = np.argsort(bucket, kind="stable")
    begin = (np.cumsum(sizes) - sizes)[order]
    sizes, edges = sizes[order], np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
    at = np.cumsum(sizes) - sizes
    flat = flat[np.repeat(begin - at, sizes) + np.arange(len(flat))]
    ends = np.append(at, len(flat))
    rows = [((shard >> 32) // GROUP << 32 | shard & 0xFFFFFFFF, -1, shard, None, None, None, None, doc_ids, n_bytes)]
    for k in range(BUCKETS):
        a, b = int(edges[k]), int(edges[k + 1])
        if a < b:
            own = flat[ends[a] : ends[b]]
            rows.append((rows[0][0], k, shard, " ".join([tokens[i] for i in order[a:b].tolist()]), sizes[a:b].astype("<u4").tobytes(), (own >> 16).astype("<u2").tobytes(), (own & LOW).astype("<u2").tobytes(), None, None))
    schema = _schema(PACKED)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of doc_id, text -> rows of PACKED; shards are numbered by the task and within it."""
    number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
    uses: dict[str, list[int]] = {}
    doc_ids, n_bytes, size = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or ""
            place = len(doc_ids) << 16
            for token, n in pretokens(text).items():
                while n > LOW:
                    uses.setdefault(token, []).append(place | LOW)
                    n -= LOW
                if (own := uses.get(token)) is None:
                    uses[token] = [place | n]
                else:
                    own.append(place | n)
            doc_ids.append(doc)
            n_bytes.append(len(text.encode("utf-8", "surrogatepass")))
            size += n_bytes[-1]
            if size >= SHARD_BYTES or len(doc_ids) >= SHARD_DOCS:
                yield pack_shard(number, uses, doc_ids, n_bytes)
                uses, doc_ids, n_bytes, size, number = {}, [], [], 0, number + 1
    if doc_ids:
        yield pack_shard(number, uses, doc_ids, n_bytes)


def count_pieces(model, tokens: list[str]) -> list[int]:
    """The number of pieces of each pre-token."""
    line_feed = len(model.encode("\n"))  # with the blank that the library puts first
    texts = [t[1:] if t[0] == "▁" and len(t) > 1 else f"\n{t}" for t in tokens]
    return [len(x) - (line_feed if t[0] == "\n" else 0) for t, x in zip(texts, model.encode(texts, num_threads=1), strict=True)]


def sum_bucket(path: str):
    """A bucket's rows of a group of shards -> per shard the sums over its documents."""

    def run(rows: pa.Table) -> pa.Table:
        if rows.column("bucket")[0].as_py() < 0:
            return rows.select(["shard", "doc_ids", "n_bytes"]).add_column(1, "sums", pa.nulls(rows.num_rows, pa.binary()))
        model = worker_cache("tokencount", path, lambda: load(path))
        lists = [x.as_py().split(" ") for x in rows.column("tokens")]
        distinct = list(set(chain.from_iterable(lists)))
        pieces = dict(zip(distinct, count_pieces(model, distinct), strict=True))
        sums = []
        for tokens, sizes, places, counts in zip(lists, *(rows.column(c).to_pylist() for c in ("sizes", "places", "counts")), strict=True):
            each = np.repeat(np.fromiter(map(pieces.__getitem__, tokens), np.int64, len(tokens)), np.frombuffer(sizes, "<u4"))
            sums.append(np.bincount(np.frombuffer(places, "<u2"), each * np.frombuffer(counts, "<u2")).astype("<u4").tobytes())
        n = rows.num_rows
        return pa.Table.from_arrays([rows.column("shard").cast(pa.int64()), pa.array(sums, pa.binary()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))], schema=_schema(SUMS))

    return run


def sum_shard(limit: int):
    """A shard's sums from all buckets, and its documents -> a row a document."""

    def run(rows: pa.Table) -> pa.Table:
        (docs,) = [i for i, x in enumerate(rows.column("doc_ids")) if x.is_valid]
        doc_ids, n_bytes = rows.column("doc_ids")[docs].values, rows.column("n_bytes")[docs].values
        total = np.zeros(len(doc_ids), np.int64)
        for x in rows.column("sums"):
            if x.is_valid:
                own = np.frombuffer(x.as_py(), "<u4")
                total[: len(own)] += own
        return pa.Table.from_arrays([doc_ids, n_bytes, pa.array(total), pa.array(total > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = texts.mapInArrow(read_shards, PACKED)
    sums = packed.groupBy("grp", "bucket").applyInArrow(sum_bucket(path or default_path()), SUMS)
    return sums.groupBy("shard").applyInArrow(sum_shard(limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(table(spark, sf_dir, "documents"))


QUERIES = {"op8_token_counts": op8_token_counts}
ORACLES: dict[str, str] = {}
