"""Language by sparse multinomial logistic regression on TF-IDF character n-grams (operator 6).

Letters are lower-cased, everything between them is one blank; n-grams of 1 to 3 letters and blanks are
hashed to DIMENSIONS; a document's vector is (1 + ln tf) * idf, of length 1.  Document frequencies are
counted over all training documents; the weights are trained on a bounded sample of labelled ones
(about PER_LANGUAGE documents a language, TRAINING in all, those whose 63-bit hash of id and text is least)
by follow-the-regularised-leader with elastic-net penalties, which leaves most weights zero; a temperature
is then fitted on a part of the sample that trained nothing.  The LANGUAGES labels with most training
documents are learned (by name where as many), so that a column with dirt in it can't swell the model.

Defined results: a text that is null or has no letter is `und` with score 1; without any labelled
training document everything is `und` with score 0; with one language everything else is that one.  A
label beyond LANGUAGES, or whose sampled documents have no letter, is never predicted.
Training documents are those whose crc32(doc_id as text) mod 4 is not 2 (a null id is none); a null
lang teaches document frequencies only.  Repeated rows count in these each time and are in the sample once;
an empty table gives no rows; columns other than doc_id, text and lang are not read, and predict() keeps
them in row whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from terrace.llm.common import crc_mod, materialise, quoted, ship, table, worker_cache

FOLDS, HELD_OUT = 4, 2
DIMENSIONS = 1 << 15
#: Bounds of the labelled sample: documents a language, and in all.
PER_LANGUAGE, TRAINING = 800, 8000
#: Labels that are learned, at most.
LANGUAGES = 256
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.5, 0.5
UNKNOWN = "und"


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and counts of the n-grams of a whole text; none if it has no letter."""
    letters = worker_cache("language", "letters", _letters)
    c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters[c]
    if not is_letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.where(is_letter, c, np.uint32(32))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # of blanks in a row the first
    c = c[keep]
    found = np.zeros(DIMENSIONS, np.int64)
    key = c * np.uint32(0x9E3779B1)
    for n in range(3):
        if n:
            if len(c) <= n:
                break
            key = (key[:-1] ^ key[:-1] >> np.uint32(13)) * np.uint32(0x85EBCA6B) + c[n:] * np.uint32(0xC2B2AE35)
        found += np.bincount(key >> np.uint32(17), minlength=DIMENSIONS)
    at = np.flatnonzero(found)
    return at, found[at]


class Model:
    """idf, the weights of each language, and a temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray):
        self.languages, self.idf = languages, idf.astype(np.float32)
        self.weights = np.zeros((DIMENSIONS, len(languages)), np.float32)
        self.bias = np.zeros(len(languages), np.float32)
        self.temperature = 1.0

    def vector(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = (1 + np.log(n)) * self.idf[at]
        length = float(np.sqrt((x * x).sum()))
        return x / length if length else x

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.vector(at, n) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        at, n = counts(text)
        if not self.languages or not len(at):
            return UNKNOWN, float(bool(self.languages))
        p = softmax(self.logits(at, n) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(model: Model, sample: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
    """FTRL-proximal over (language, places, counts), the last fifth of which sets the temperature."""
    k = len(model.languages)
    last = len(sample) - len(sample) // 5
    z, n = np.zeros((DIMENSIONS + 1, k)), np.zeros((DIMENSIONS + 1, k))
    vectors = [(y, np.append(at, DIMENSIONS), np.append(model.vector(at, c), 1.0)) for y, at, c in sample]

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for y, at, x in vectors[:last]:
            w = weights(z[at], n[at])
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / ALPHA * w
            n[at] = more
    w = weights(z, n)
    model.weights, model.bias = w[:-1].astype(np.float32), w[-1].astype(np.float32)
    held = vectors[last:] or vectors
    logits = np.array([x @ w[at] for _, at, x in held])
    truth = np.array([y for y, _, _ in held])
    # one document more counts as spread over all languages, so that a faultless part doesn't say "never wrong"
    aim = np.full(logits.shape, 1 / k / (len(truth) + 1))
    aim[np.arange(len(truth)), truth] += len(truth) / (len(truth) + 1)
    losses = {float(t): -(aim * np.log(np.maximum(softmax(logits / t), 1e-300))).sum(axis=1).mean() for t in np.geomspace(0.02, 5, 80)}
    model.temperature = min(losses, key=losses.get)


#: The hashes by which documents are sampled are from 0 to this.
HASHES = (1 << 63) - 1


def sample_bar(n: int, languages: int) -> int:
    """The greatest hash with which a document of a language with n documents is in the sample, whatever n is."""
    each = min(PER_LANGUAGE, max(1, TRAINING // max(1, languages)))
    return HASHES if n <= each else HASHES * each // n


def fit(docs: DataFrame) -> Model:
    """docs: doc_id, text and lang of the training documents."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = rows.where("lang is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    found = {lang: n for lang, n in sizes.collect()}  # LANGUAGES rows at most
    bars = [(lang, sample_bar(n, len(found))) for lang, n in found.items()]
    share = F.broadcast(docs.sparkSession.createDataFrame(bars, "lang_ string, bar long"))
    key = F.xxhash64("doc_id", "text")
    taken = F.coalesce(key.bitwiseAND(F.lit(HASHES)) <= F.col("bar"), F.lit(False))
    dealt = rows.join(share, F.col("lang") == F.col("lang_"), "left").select("text", "lang", key.alias("key"), taken.alias("taken"))
    schema = "lang string, key long, at array<int>, n array<int>, vector binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document of the sample, and at the end one of document frequencies, with no lang."""
        numbers = pa.list_(pa.int32())
        schema = pa.schema([("lang", pa.string()), ("key", pa.int64()), ("at", numbers), ("n", numbers), ("vector", pa.binary())])

        def rows(*found: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

        frequency, total = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            out = []
            for text, lang, key, taken in zip(batch.column(0), *(c.to_pylist() for c in batch.columns[1:]), strict=True):
                at, n = counts(text.as_py())
                frequency[at] += 1
                total += len(at) > 0
                if taken and len(at):
                    out.append((lang, key, None, None, np.array([at, n], "<i4").tobytes()))
            if out:
                yield rows(*out)
        at = np.flatnonzero(frequency)
        yield rows((None, total, at, frequency[at], None))

    seen = materialise(dealt.mapInArrow(read, schema), "languages")
    tasks = seen.where("lang is null")
    total = tasks.agg(F.sum("key")).first()[0] or 0
    df = tasks.select(F.explode(F.arrays_zip("at", "n")).alias("x")).groupBy("x.at").agg(F.sum("x.n").alias("n")).toPandas()
    idf = np.zeros(DIMENSIONS)
    idf[df["at"].to_numpy(int)] = df["n"].to_numpy(float)
    sample = sorted(seen.where("lang is not null").select("lang", "key", "vector").dropDuplicates(["lang", "key"]).collect(), key=lambda r: (r["key"], r["lang"], r["vector"]))
    languages = sorted({r["lang"] for r in sample})
    model = Model(languages, np.log((1 + total) / (1 + idf)) + 1)
    if languages:
        train(model, [(languages.index(r["lang"]), *np.frombuffer(r["vector"], "<i4").reshape(2, -1)) for r in sample])
    return model


def training_part(docs: DataFrame) -> DataFrame:
    fold = crc_mod("doc_id", FOLDS)
    return docs.where((fold != HELD_OUT) & (fold >= 0)).select("doc_id", "text", "lang")


def predict(docs: DataFrame, model: Model, columns: list[str] | None = None) -> DataFrame:
    """row (a struct of the given columns of docs, all if none are), lang_pred and score; of a row only its text is looked at."""
    sent = ship(docs.sparkSession, model)
    columns = docs.columns if columns is None else columns
    rows = docs.select(F.struct(*(F.col(quoted(c)) for c in columns)).alias("row"), F.col("text").cast("string").alias("text"))
    schema = StructType([rows.schema["row"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent()
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, fit(training_part(docs)), ["doc_id"])
    return found.select("row.doc_id", (crc_mod("row.doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")


QUERIES = {"op6_language": op6_language}
ORACLES: dict[str, str] = {}
