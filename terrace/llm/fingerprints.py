"""Document fingerprints: bottom-k sketches of shingle hashes (operator 1), DataFrame functions only.

Words are what stands between white space, lower-cased; a shingle is SHINGLE words in a row (a shorter
text is one shingle).  Its hash is XXH64 over its words' XXH64.  The sketch is the K smallest distinct
hashes, ascending.  The sketch of a document's parts' union is the merge of the parts' sketches, where
parts overlap by SHINGLE - 1 words.  From sketches alone come resemblance, containment and the number
of distinct shingles.

Defined results: a null text is an empty one; an empty text has an empty sketch; two empty sketches
resemble each other by 1, an empty and another by 0; equal texts have equal sketches.  In the order of
documents a null doc_id counts as the least number, and repeated ids follow one another by their text's
hash (rows equal in id and text stand in any order, as they are the same); a sole row's next document
is itself; an empty table gives no rows.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.llm.common import table

SHINGLE = 5
K = 128
#: Neighbouring rows that are ordered together, about; and keys of rows that bound such buckets, at most.
BUCKET = 64
SAMPLE = 400_000


def word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(text), r"\s+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def sketch_of(hashes: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """The sketch of a text from a column (not an expression: it is used per shingle) of its words' hashes."""
    n = F.size(hashes)
    rows = F.transform(F.slice(hashes, 1, F.greatest(n - (shingle - 1), F.lit(0))), lambda h, i: F.xxhash64(h, *(F.get(hashes, i + j) for j in range(1, shingle))))
    all_ = F.when(n >= shingle, rows).when(n > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))
    return F.slice(F.sort_array(F.array_distinct(all_)), 1, k)


def with_sketch(df: DataFrame, text: str, out: str, k: int = K) -> DataFrame:
    """df with the sketch of column text; a null text counts as empty."""
    hashed = df.withColumn("__words", word_hashes(F.coalesce(F.col(text), F.lit(""))))
    return hashed.withColumn(out, sketch_of(F.col("__words"), k)).drop("__words")


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what two sketches stand for."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all of both: that among the k least of the union."""
    union = merge(a, b, k)
    common = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, 1.0).otherwise(common / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Exact below k; above, (k - 1) over the share of the hash range that the k least take up."""
    share = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, from resemblance and the numbers of shingles."""
    r, both = resemblance(a, b, k), distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), r * both / distinct_shingles(a, k)))


def text_of(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def bounds(keyed: DataFrame) -> list[tuple[int, int]]:
    """The first keys (id, th) of buckets of about BUCKET rows each, or more where SAMPLE is too small for that.

    They are keys that rows have, from a bounded sample by hash, the least of the sample left out: so no
    bucket is empty, whatever the ids are.  The sample shapes the work only, never the result.
    """
    rows = keyed.count()
    wanted = min(rows, 16 * rows // BUCKET + 16, SAMPLE // 2)
    share = (1 << 30) * wanted // max(1, rows)
    sample = keyed.select("id", "th").where(F.pmod(F.xxhash64("id", "th"), F.lit(1 << 30)) < share).distinct()
    keys = sorted(map(tuple, sample.orderBy(F.xxhash64("th", "id")).limit(SAMPLE).collect()))
    step = max(1, len(keys) * BUCKET // max(1, rows), 4 if rows > SAMPLE else 1)
    return keys[step::step]


def bucket_of(firsts: list[tuple[int, int]]) -> Column:
    """How many of the keys aren't above the row's (id, th): a binary search in two constant arrays."""
    if not firsts:
        return F.lit(0)
    ids, hashes = (F.split(F.lit(",".join(str(k[i]) for k in firsts)), ",").cast("array<bigint>") for i in (0, 1))
    n = len(firsts)
    steps = F.array(*(F.lit(1 << i) for i in range(n.bit_length() - 1, -1, -1)))

    def move(at: Column, step: Column) -> Column:
        k = at + step - 1
        i = F.get(ids, k)
        return F.when((at + step <= n) & ((i < F.col("id")) | (i == F.col("id")) & (F.get(hashes, k) <= F.col("th"))), at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), move)


def with_next(docs: DataFrame, enrich: Callable[[DataFrame], DataFrame], columns: list[str]) -> DataFrame:
    """enrich(docs)'s doc_id and columns with next_<column> of the next row by doc_id; the last row's is the first.

    docs has doc_id and text; enrich works row by row.  Rows are dealt once, into buckets of neighbours in
    the order, which are as large for ids that lie far apart, repeat or are missing as for any others.
    Only a bucket's last row needs another bucket's first, and as no bucket is empty that is the next one.
    """
    low = -(1 << 63)
    keyed = docs.withColumns({"id": F.coalesce("doc_id", F.lit(low)), "th": F.xxhash64("text")})
    firsts = bounds(keyed)
    dealt = enrich(keyed.withColumn("b", bucket_of(firsts))).select("b", "id", "th", "doc_id", *columns)
    w = Window.partitionBy("b").orderBy("id", "th")
    numbered = dealt.withColumns({"first": F.lag(F.lit(1)).over(w).isNull(), "last": F.lead(F.lit(1)).over(w).isNull()} | {f"next_{c}": F.lead(c).over(w) for c in columns})
    # a null doc_id has id low, so the condition always holds: with it both sides read the same columns, and Spark deals the rows once
    before = F.when(F.col("doc_id").isNotNull() | (F.col("id") == low), F.pmod(F.col("b") - 1, F.lit(len(firsts) + 1)))
    patch = numbered.where("first").select(before.alias("from"), *(F.col(c).alias(f"first_{c}") for c in columns))
    joined = numbered.join(patch, (F.col("b") == F.col("from")) & F.col("last"), "left")
    found = {f"next_{c}": F.when(F.col("last"), F.col(f"first_{c}")).otherwise(F.col(f"next_{c}")) for c in columns}
    return joined.withColumns(found).select("doc_id", *columns, *found)


def compare_edited(docs: DataFrame) -> DataFrame:
    """Each document, its edited text (the second half replaced by the next one's beginning), and their sketches."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(texts, lambda df: with_sketch(df, "text", "sketch"), ["text", "sketch"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    return with_sketch(rows, "edited", "edited_sketch")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compare_edited(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        text_of(F.col("sketch")).alias("fingerprint"),
        text_of(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("edited_sketch"), F.col("sketch")).alias("edited_in_own"),
        distinct_shingles(F.col("sketch")).alias("distinct_shingles"),
    )


QUERIES = {"op1_fingerprints": op1_fingerprints}
ORACLES: dict[str, str] = {}
