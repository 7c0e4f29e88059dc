"""Benchmark decontamination with FM-indexes (operator 9).

Documents are gathered into shards of about SHARD_WORDS words (a longer document is cut, with the
cuts overlapping by a window less a word).  A shard's words are numbered; its text is the documents' words, each document closed by a
separator of its own, so no match crosses documents.  Over the whole text the shard gets an FM-index:
the suffix array by prefix doubling, the Burrows-Wheeler transform in a wavelet matrix whose bit
vectors have rank directories, and suffix positions sampled every SAMPLE words and after every
separator.  All phrases whose words the shard has are searched backwards at once; the rows that are
left walk by the last-to-first mapping to a sampled position; overlapping occurrences merge into
removal spans.

Defined results: a null or empty text has no words and no hit; an item without words has no window; a
shorter item than a window is one window; repeated items each count; an empty benchmark hits nothing;
rows with a null or repeated doc_id are handled like any other row.  A null item_id counts in n_items
and is left out of the list of ids.  Columns other than doc_id, text and item_id are not read, and clean()
keeps them whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.common import buckets, materialise, read_block, table, worker_cache, write_blocks

WINDOW = 10
SHARD_WORDS = 500_000
SAMPLE = 8
#: Benchmark words in a block (some 40 MB while it is made), and shards that a block is searched in.
BLOCK_WORDS = 200_000
HELD = 8

#: Bytes that belong to no word become blanks, A-Z their lower case.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split() if text else []


def phrases_of(items: list[tuple], window: int = WINDOW) -> tuple[dict[bytes, int], list[tuple[int, ...]], list[list]]:
    """Of (place, item_id, text): word -> number from 1, the distinct windows, and the (place, item_id) of each."""
    numbers: dict[bytes, int] = {}
    found: dict[tuple[int, ...], list[tuple]] = {}
    for place, item, text in items:
        own = [numbers.setdefault(w, len(numbers) + 1) for w in words_of(text)]
        for phrase in {tuple(own[i : i + window]) for i in range(max(1, len(own) - window + 1))} if own else ():
            found.setdefault(phrase, []).append((place, item))
    return numbers, list(found), list(found.values())


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Of a text whose symbols 0 are separators, each lower than every word and, among them, than later ones."""
    n = len(text)
    bits = max(1, int(text.max()).bit_length() if n else 1)
    width = max(1, 62 // bits) if bits < 31 else 1
    padded = np.concatenate([text, np.zeros(width, text.dtype)]).astype(np.int64)
    key = np.zeros(n, np.int64)
    ended = np.zeros(n, bool)
    for i in range(width):  # what stands behind a separator doesn't count
        key = key << bits | np.where(ended, 0, padded[i : i + n])
        ended |= padded[i : i + n] == 0
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    # a suffix with a separator within width is told apart by that separator's place
    closed = ended[order]
    rank = np.empty(n, np.int64)
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    rank[order] = first
    # groups of equal keys that hold separators: equal up to it, so the place decides, which the stable sort kept
    rank[order[closed]] = np.flatnonzero(closed)
    size = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
    open_rows = np.flatnonzero(~closed & (size > 1))
    step = width
    while len(open_rows):
        at = order[open_rows]
        group = rank[at]
        follow = at + step
        next_rank = np.where(follow < n, rank[np.minimum(follow, n - 1)], -1)
        by = np.lexsort((next_rank, group))
        order[open_rows] = at = at[by]
        group, next_rank = group[by], next_rank[by]
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (next_rank[1:] != next_rank[:-1])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(at)))
        head = np.repeat(start, size)
        rank[at] = open_rows[head]
        open_rows = open_rows[np.repeat(size, size) > 1]
        step *= 2
    return order


class BitVector:
    """Bits with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(self.n // 64 + 1, "<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (values >> level & 1).astype(bool)
            self.levels.append(BitVector(bit))
            values = np.concatenate([values[~bit], values[bit]])
            self.zeros.append(len(bit) - int(bit.sum()))

    def rank(self, symbol: np.ndarray, at: np.ndarray, start: np.ndarray) -> np.ndarray:
        """How often symbol stands before at; start[symbol]: where its block begins on the last level."""
        for i, (level, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            ones = level.rank(at)
            at = np.where(symbol >> (self.bits - 1 - i) & 1 == 1, zeros + ones, at - ones)
        return at - start[symbol]

    def access_rank(self, at: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before."""
        symbol = np.zeros(len(at), np.int64)
        for level, zeros in zip(self.levels, self.zeros, strict=True):
            bit, ones = level.get(at), level.rank(at)
            at = np.where(bit, zeros + ones, at - ones)
            symbol = symbol << 1 | bit
        return symbol, at - start[symbol]


class FMIndex:
    """Of a text of words from 1 and separators 0."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        self.n = len(text)
        bits = max(1, int(text.max()).bit_length())
        order = suffix_array(text)
        last = text[order - 1]
        last[order == 0] = 0
        self.bwt = WaveletMatrix(last, bits)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << bits))])
        # the matrix ends with symbols in bit-reversed order
        count = np.bincount(last, minlength=1 << bits)
        flipped = np.zeros(1 << bits, np.int64)
        for i in range(bits):
            flipped = flipped << 1 | np.arange(1 << bits) >> i & 1
        by = np.argsort(flipped)
        self.start = np.empty(1 << bits, np.int64)
        self.start[by] = np.concatenate([[0], np.cumsum(count[by])[:-1]])
        marked = (order % sample == 0) | (last == 0)
        self.marked, self.samples = BitVector(marked), order[marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range of each row of phrases, whose words end the row and 0 fills it from the left."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            live = live[phrases[live, column] != 0]
            if not len(live):
                break
            word = phrases[live, column]
            ends = self.bwt.rank(np.tile(word, 2), np.concatenate([low[live], high[live]]), self.start)
            low[live], high[live] = self.first[word] + ends[: len(live)], self.first[word] + ends[len(live) :]
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        at, rows, todo = np.zeros(len(rows), np.int64), rows.copy(), np.arange(len(rows))
        steps = 0
        while len(todo):
            hit = self.marked.get(rows[todo])
            done = todo[hit]
            at[done] = self.samples[self.marked.rank(rows[done])] + steps
            todo = todo[~hit]
            if len(todo):
                symbol, before = self.bwt.access_rank(rows[todo], self.start)
                rows[todo] = self.first[symbol] + before
            steps += 1
        return at


class Block:
    """A block of the benchmark, ready to be searched for in shards."""

    def __init__(self, items: list[tuple], window: int):
        numbers, phrases, self.items = phrases_of(items, window)
        self.words = list(numbers)
        self.sizes = np.array([len(p) for p in phrases], np.int64)
        self.phrases = np.zeros((len(phrases), window), np.int64)
        for i, p in enumerate(phrases):
            self.phrases[i, window - len(p) :] = p


class _Numbers(dict):
    """word -> number from 1, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1
        return n


class Shard:
    """The FM-index over the words of documents, each followed by a separator."""

    def __init__(self, docs: list[list[bytes]]):
        self.numbers = _Numbers()
        number, end = self.numbers.__getitem__, np.zeros(1, np.int64)
        parts = [x for words in docs for x in (np.fromiter(map(number, words), np.int64, len(words)), end)]
        self.index = FMIndex(np.concatenate(parts))

    def occurrences(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all the block's phrases: (place among words and separators, length, phrase)."""
        get = self.numbers.get
        own = np.array([0, *(get(w, -1) for w in block.words)], np.int64)[block.phrases]
        there = np.flatnonzero((own >= 0).all(axis=1))
        low, high = self.index.search(own[there])
        count = high - low
        phrase = np.repeat(there, count)
        rows = np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count - low, count)
        return self.index.locate(rows), block.sizes[phrase], phrase


def parts_of(docs: list[list[bytes]], size: int, overlap: int) -> Iterator[list[tuple[int, int, list[bytes]]]]:
    """Shards of (document, place of its first word, words) with about size words; long documents are cut.

    Neighbouring cuts share overlap words, so any phrase of at most one word more lies within one cut.
    """
    shard, total = [], 0
    for d, words in enumerate(docs):
        for a in range(0, max(1, len(words) - overlap), size):
            part = words[a : a + size + overlap]
            if shard and total + len(part) > size + overlap:
                yield shard
                shard, total = [], 0
            shard.append((d, a, part))
            total += len(part) + 1
    if shard:
        yield shard


def scan(texts: list[str | None], blocks: Benchmark, size: int) -> list[tuple[int, list[tuple[int, int]], list]]:
    """Of texts: number of words, merged spans of words, and the items found."""
    docs = [words_of(t) for t in texts]
    spans: list[list[tuple[int, int]]] = [[] for _ in docs]
    items: list[set] = [set() for _ in docs]

    def search(held: list[list[tuple[int, int, list[bytes]]]]) -> None:
        shards = [(parts, Shard([words for _, _, words in parts])) for parts in held]
        for block in blocks:
            for parts, shard in shards:
                sizes = np.array([len(words) + 1 for _, _, words in parts], np.int64)
                begin = np.cumsum(sizes) - sizes
                place, length, phrase = shard.occurrences(block)
                part = np.searchsorted(begin, place, "right") - 1
                for i, a, n, p in zip(part.tolist(), (place - begin[part]).tolist(), length.tolist(), phrase.tolist(), strict=True):
                    d, at, _ = parts[i]
                    spans[d].append((at + a, at + a + n))
                    items[d].update(block.items[p])

    held = []
    for parts in parts_of(docs, size, blocks.window - 1) if blocks.n else ():
        if any(words for _, _, words in parts):
            held.append(parts)
        if len(held) == HELD:
            search(held)
            held = []
    if held:
        search(held)
    out = []
    for words, own, found in zip(docs, spans, items, strict=True):
        merged: list[list[int]] = []
        for a, b in sorted(own):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        out.append((len(words), [tuple(x) for x in merged], [item for _, item in found]))
    return out


def cleaned(text: str, spans: list[tuple[int, int]], blocks: Benchmark, size: int) -> str | None:
    """text without spans and whatever windows there are then; None if no word is left."""
    while spans:
        text = without(text, spans)
        ((n, spans, _),) = scan([text], blocks, size)
        if not n:
            return None
    return text


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of spans and what stands between them."""
    at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return "".join([*out, text[last:]])


def shards(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Rows in slices of at most about size words (6 bytes a word), or of one row."""
    for batch in batches:
        n = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, first = 0, 0
        for i, x in enumerate(n):
            if total and total + x > 6 * size:
                yield batch.slice(first, i - first)
                total, first = 0, i
            total += int(x)
        if first < len(n):
            yield batch.slice(first)


def item_parts(window: int):
    """Batches of place, item_id, text -> the same with items of more than BLOCK_WORDS words cut, and their numbers of words."""
    step = max(BLOCK_WORDS, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for place, item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                for a in range(0, max(1, len(words) - window + 1), step) if words else ():
                    part = words[a : a + step + window - 1]
                    rows.append((place, item, b" ".join(part).decode("utf-8", "surrogatepass"), len(part)))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["place", "item", "text", "words"])

    return run


class Benchmark:
    """The blocks of a benchmark in the shared folder; a worker gets them one after the other."""

    def __init__(self, path: str, n: int, window: int):
        self.path, self.n, self.window = path, n, window

    def __iter__(self) -> Iterator[Block]:
        make = lambda k: Block(read_block(self.path, k, ["place", "item", "text"]), self.window)
        if self.n == 1:
            yield worker_cache("fmindex", f"{self.window}:{self.path}", lambda: make(0))
            return
        for k in range(self.n):
            if (block := make(k)).words:
                yield block


def write_benchmark(benchmark: DataFrame, window: int = WINDOW) -> Benchmark:
    """The benchmark's items, each row with a number of its own, as blocks in the shared folder."""
    numbered = materialise(benchmark.select(F.monotonically_increasing_id().alias("place"), F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")), "benchmark")
    parts = materialise(numbered.mapInArrow(item_parts(window), "place long, item string, text string, words long"), "items")
    total = parts.agg(F.sum("words")).first()[0] or 0
    n = buckets(total, BLOCK_WORDS) if total else 0
    return Benchmark(write_blocks(parts.withColumn("block", F.pmod(F.xxhash64("place", "text"), F.lit(max(1, n)))), "blocks", n), n, window)


HITS = "doc_id long, n_words long, n_hit long, items array<string>, n_items long, spans array<struct<start:long,end:long>>"


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: words, hit words, the items whose windows occur, and merged removal spans (in words)."""
    blocks = write_benchmark(benchmark, window)
    size = SHARD_WORDS
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shards(batches, 1, size * (HELD if blocks.n > 1 else 1)):
            found = scan(batch.column(1).to_pylist(), blocks, size)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for n, _, _ in found], pa.int64()),
                    pa.array([sum(b - a for a, b in s) for _, s, _ in found], pa.int64()),
                    pa.array([[x for x in i if x is not None] for _, _, i in found], pa.list_(pa.string())),
                    pa.array([len(i) for _, _, i in found], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in s] for _, s, _ in found], span),
                ],
                names=["doc_id", "n_words", "n_hit", "items", "n_items", "spans"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, HITS)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs, all columns, without the words in removal spans, until no window is left; n_chars follows; documents left without a word go."""
    blocks = write_benchmark(benchmark, window)
    size = SHARD_WORDS
    names = docs.columns
    at = names.index("text")
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))  # names with dots aren't for mapInArrow

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shards(batches, at, size * (HELD if blocks.n > 1 else 1)):
            texts = batch.column(at).to_pylist()
            found = scan(texts, blocks, size)
            texts = [cleaned(t, s, blocks, size) if s else t for t, (_, s, _) in zip(texts, found, strict=True)]
            gone = [bool(s) and t is None for t, (_, s, _) in zip(texts, found, strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                old = batch.column(k).to_pylist()
                columns[k] = pa.array([len(t or "") if s else o for t, (_, s, _), o in zip(texts, found, old, strict=True)], batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array([not g for g in gone]))

    return plain.mapInArrow(run, plain.schema).toDF(*names)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.sha2(F.array_join(F.sort_array("items"), ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

QUERIES = {"op9_decontamination": op9_decontamination}
ORACLES = {
    "op9_decontamination": f"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT row_number() OVER () AS place, item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT place, item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i : i + {WINDOW} - 1], ' ') AS g
        FROM b, unnest(range(1, greatest(len(w) - {WINDOW} + 2, 2))) r(i) WHERE len(w) > 0),
pos AS (SELECT k, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM t, (SELECT DISTINCT n FROM win) s, unnest(range(1, len(w) - n + 2)) r(i)),
hit AS (SELECT k, i, n, place, item_id FROM pos JOIN win USING (n, g)),
words AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM hit) GROUP BY k),
items AS (SELECT k, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
          FROM (SELECT DISTINCT k, place, item_id FROM hit) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM t LEFT JOIN words USING (k) LEFT JOIN items USING (k)"""
}
