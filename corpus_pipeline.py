"""The corpus pipeline: STAGES in order, each a function of (spark, docs, sf_dir) that returns a DataFrame.

run() writes each stage's rows as Parquet in the shared folder and rereads them as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrace.llm import fmindex, language, near, packing, pii
from terrace.llm.common import materialise, table


#: A document stays if its language is at least this likely: of a few letters none can be sure, and they are no fault.
SURE = 0.3
#: Rows that go to a Python worker at once: texts may be long, and executors hold several such batches.
BATCH_ROWS = 2000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded(spark: SparkSession) -> None:
    """Sets the session's batches to BATCH_ROWS where they are larger (0: unbounded); results don't depend on it."""
    if not 0 < int(spark.conf.get(_ROWS)) <= BATCH_ROWS:
        spark.conf.set(_ROWS, str(BATCH_ROWS))


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has no letter, or is of no learned language, go; all stay where no language can be learned."""
    bounded(spark)
    model = language.fit(language.training_part(docs))
    if not model.languages:
        return docs
    found = language.predict(docs, model)
    return found.where((found["lang_pred"] != language.UNKNOWN) & (found["score"] >= SURE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts alike by 0.8 in 5-word shingles stays: SimHash links, and the pairs beyond its radius."""
    bounded(spark)
    return near.first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words of benchmark windows are cut out of the texts."""
    bounded(spark)
    return fmindex.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to their kind."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences."""
    bounded(spark)
    return packing.pack(docs)


STAGES = [
    ("language", languages),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: Token ids, XXH64 and the learned model are beyond SQL: tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
