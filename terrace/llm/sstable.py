"""Token ids in sorted-string-table shards (operator 10).

A shard holds the documents of one range of ids, in ascending order, in its own file:

    data blocks | block index | Bloom filter | footer

Shards are ranges of (id, text hash) of about SHARD_BYTES of text or SHARD_DOCS documents, at least as many as
the session's partitions.  The manifest, a table beside them, has each shard's file, counts, first and last
id, so a lookup opens one file.

A key is the document id as 8 big-endian bytes with the sign bit flipped, so bytes sort as numbers;
a null id is the empty key, which sorts first.  An entry is varint(shared), varint(unshared),
varint(value length), the unshared key bytes and the value; a block's first key shares nothing.  A
value is the document's ids, little-endian, 2 bytes each where the vocabulary allows it, else 4.
The index has each block's first key, offset and length; the footer says where index and filter lie,
and how many documents and ids there are.  A lookup bisects the manifest, asks the shard's filter, bisects
its index and reads one block.

Defined results: a null text is an empty one, and an empty one has the end id alone; repeated ids lie
side by side, ordered by their text's hash (in neighbouring shards, if there are many), and a lookup gives the
first; an id that isn't there gives a null; an empty table gives no files; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.common import buckets, file_system, partitions, scratch_path, ship, table
from terrace.llm.wordids import default_path, encoder

MAGIC = b"TRCSST01"
FOOTER = "<QQQQQQI8s"
#: A block is closed at so many bytes; the filter has so many bits a key.
BLOCK = 1 << 16
BLOOM_BITS = 10
HASHES = 7
END_ID = 1
MANIFEST = "shard int, path string, n_docs long, n_ids long, first long, last long"
#: Bytes of text and documents in a shard, about.
SHARD_BYTES = 256 << 20
SHARD_DOCS = 4 << 20


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & (2**64 - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 0x7F) << shift
        if x < 0x80:
            return n, at
        shift += 7


def _hashes(key: bytes) -> tuple[int, int]:
    return zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = _hashes(key)
    return [(a + i * b) % bits for i in range(HASHES)]


class Writer:
    """Writes entries, given in ascending key order, to an open binary stream; holds one block, the index and 8 bytes a key for the filter."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.block, self.last, self.first = bytearray(), b"", b""
        self.index: list[bytes] = []
        self.hashes = array("I")
        self.n_docs = self.n_ids = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.n_docs and key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if not self.block:
            self.first = key
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        value = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.hashes.extend(_hashes(key))
        self.n_docs += 1
        self.n_ids += len(ids)
        if len(self.block) >= BLOCK:
            self._close_block()

    def _close_block(self) -> None:
        if self.block:
            self.out.write(bytes(self.block))
            self.index.append(_varint(len(self.first)) + self.first + struct.pack("<QQ", self.at, len(self.block)))
            self.at += len(self.block)
            self.block = bytearray()

    def close(self) -> None:
        self._close_block()
        index = b"".join(self.index)
        bits = max(64, BLOOM_BITS * self.n_docs + 7 & ~7)
        bloom = np.zeros(bits // 8, np.uint8)
        a, b = np.frombuffer(self.hashes, np.uint32).astype(np.uint64).reshape(-1, 2).T
        for i in range(HASHES):
            p = (a + np.uint64(i) * b) % np.uint64(bits)
            np.bitwise_or.at(bloom, (p >> np.uint64(3)).astype(np.int64), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))
        self.out.write(index)
        self.out.write(bloom.tobytes())
        self.out.write(struct.pack(FOOTER, self.at, len(index), self.at + len(index), len(bloom), self.n_docs, self.n_ids, self.width, MAGIC))


class Reader:
    """Reads a shard from a seekable binary stream of size bytes, a block at a time."""

    def __init__(self, stream, size: int):
        self.stream = stream
        at, n, bloom_at, bloom_n, self.n_docs, self.n_ids, self.width, magic = struct.unpack(FOOTER, self._read(size - struct.calcsize(FOOTER), struct.calcsize(FOOTER)))
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        self.bloom = self._read(bloom_at, bloom_n)
        index, i = self._read(at, n), 0
        self.firsts: list[bytes] = []
        self.where: list[tuple[int, int]] = []
        while i < n:
            k, i = _read_varint(index, i)
            self.firsts.append(index[i : i + k])
            self.where.append(struct.unpack_from("<QQ", index, i + k))
            i += k + 16

    def _read(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(n)

    def _entries(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        b, i, key = self._read(*self.where[block]), 0, b""
        while i < len(b):
            shared, i = _read_varint(b, i)
            own, i = _read_varint(b, i)
            size, i = _read_varint(b, i)
            key = key[:shared] + b[i : i + own]
            i += own
            yield key, np.frombuffer(b, "<u2" if self.width == 2 else "<u4", size // self.width, i)
            i += size

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for block in range(len(self.where)):
            for key, ids in self._entries(block):
                yield id_of(key), ids

    def get(self, doc_id: int | None) -> np.ndarray | None:
        key = key_of(doc_id)
        if any(not self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, 8 * len(self.bloom))):
            return None
        block = max(0, bisect_right(self.firsts, key) - 1)
        while block and self.firsts[block] == key:  # repeated ids may begin in the block before
            block -= 1
        for k in range(block, len(self.where)):
            if k > block and self.firsts[k] > key:
                break
            for found, ids in self._entries(k):
                if found == key:
                    return ids
        return None


def write_shards(folder: str, vocabulary: str):
    """Each partition's sorted rows -> one file; gives its MANIFEST row.

    The name has the attempt's number and only the attempt that Spark accepts reports its file, so a
    lost or repeated task leaves nothing half-written in the manifest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, context, writer, stream = encoder(vocabulary), TaskContext.get(), None, None
        width = 2 if encode.tokenizer.get_vocab_size() <= 1 << 16 else 4
        end = np.array([END_ID], "<u4")
        path = f"{folder}/part-{context.partitionId():05d}-{context.taskAttemptId()}.sst"
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), encode.batch(batch.column(1)), strict=True):
                if writer is None:
                    system, name = file_system(path)
                    system.create_dir(name.rpartition("/")[0], recursive=True)
                    stream = system.open_output_stream(name)
                    writer, first = Writer(stream, width), doc
                writer.add(key_of(doc), np.append(ids, end))
        if writer is not None:
            writer.close()
            stream.close()
            ids = {"n_docs": writer.n_docs, "n_ids": writer.n_ids, "first": first, "last": id_of(writer.last)}
            yield pa.RecordBatch.from_pydict({"shard": pa.array([context.partitionId()], pa.int32()), "path": [path]} | {k: pa.array([v], pa.int64()) for k, v in ids.items()})

    return run


def write(docs: DataFrame, folder: str, vocabulary: str, shards: int | None = None) -> None:
    """Writes docs' ids as shards below folder, and their manifest."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not shards:
        size, n = rows.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
        shards = max(partitions(docs.sparkSession), buckets(size or 0, SHARD_BYTES), buckets(n, SHARD_DOCS))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    ordered.mapInArrow(write_shards(folder, vocabulary), MANIFEST).write.parquet(f"{folder}/manifest")


def manifest_of(spark: SparkSession, folder: str) -> list:
    """The manifest's rows, one a shard, in ascending order of ids."""
    return sorted(spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").collect(), key=lambda r: r["shard"])


def read_shards(batches: Iterator[list[tuple[str, int]]]) -> Iterator[pa.RecordBatch]:
    """path and start (ids before the shard) of shards -> doc_id, start, n_tokens, ids_crc32 of all their documents."""
    for shards in batches:
        for path, start in shards:
            system, name = file_system(path)
            with system.open_input_file(name) as stream:
                rows = []
                for doc, ids in Reader(stream, system.get_file_info(name).size):
                    rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 4, names=names)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All documents of the shards below folder, a task a shard; what is sent is a path and a number a shard."""
    at, before = [], 0
    for row in manifest_of(spark, folder):
        at.append((row["path"], before))
        before += row["n_ids"]
    sent = ship(spark, at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = sent()
        yield from read_shards([at[i] for i in batch.column(0).to_pylist()] for batch in batches)

    return spark.range(0, len(at), 1, max(1, len(at))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(ids: DataFrame, folder: str) -> DataFrame:
    """ids (column doc_id) with tokens, the ids of that document (null if there is none); a shard's file is opened once."""
    rows = [r for r in manifest_of(ids.sparkSession, folder)]
    sent = ship(ids.sparkSession, ([key_of(r["last"]) for r in rows], [r["path"] for r in rows]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lasts, _ = sent()
        for batch in batches:
            at = [bisect_left(lasts, key_of(x)) for x in batch.column(0).to_pylist()]  # the first shard that may have it
            yield batch.append_column("at", pa.array(at, pa.int64()))

    def search(found: pa.Table) -> pa.Table:
        _, paths = sent()
        at, docs, tokens = found.column("at")[0].as_py(), found.column("doc_id").to_pylist(), [None] * found.num_rows
        if at < len(paths):
            system, name = file_system(paths[at])
            with system.open_input_file(name) as stream:
                reader = Reader(stream, system.get_file_info(name).size)
                tokens = [None if (x := reader.get(d)) is None else x.astype(np.int64) for d in docs]
        return pa.table({"doc_id": pa.array(docs, pa.int64()), "tokens": pa.array(tokens, pa.list_(pa.int64()))})

    wanted = ids.select(F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(place, "doc_id long, at long")
    return wanted.groupBy("at", F.pmod(F.xxhash64("doc_id"), F.lit(16))).applyInArrow(search, "doc_id long, tokens array<long>")


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """docs written as shards in the shared folder and read back."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "sst")
    write(docs, folder, vocabulary or default_path())
    return read(spark, folder)


def op10_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op10_sstable": op10_sstable}
ORACLES: dict[str, str] = {}
