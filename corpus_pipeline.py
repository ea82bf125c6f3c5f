"""A corpus pipeline over ``documents``: each stage works on all that the one before it kept.

Language identification, near-duplicate removal by the n-gram Jaccard join, benchmark
decontamination and masking of personal data return the columns of ``documents``; the last stage
packs the rest into token sequences.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentlab.llm import decontaminate, jaccard_join, langid, packing, pii
from incidentlab.llm.common import bounded_batches, stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Below this mean probability no language of the model fits, and the document is rejected.
MIN_SCORE = 0.3
NEAR = jaccard_join.Join(words=5, percent=80, filter="prefix")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the learned languages; ``lang`` becomes the predicted one.

    The model is fitted on the labelled rows of ``docs`` that are not held out. Null, empty and
    letterless texts are rejected, and so are texts that no language fits (``MIN_SCORE``).
    """
    bounded_batches(spark)
    learn = ~langid.held_out("doc_id") & F.col("doc_id").isNotNull()
    model = langid.train(docs, learn=learn)
    named = langid.predict(docs, model)
    good = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_SCORE)
    return named.where(good).withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of linked documents (five words,
    similarity 0.8). Documents without words or without an id have no group and stay."""
    bounded_batches(spark)
    groups = jaccard_join.link(docs, NEAR)
    extra = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(stage(extra), "doc_id", "left_anti").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage like a benchmark item."""
    bounded_batches(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes placeholders over personal data; ``n_chars`` follows. Null texts stay null."""
    bounded_batches(spark)
    mask = pii.masker()
    text, size = docs.columns.index("text"), docs.columns.index("n_chars")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, texts = list(batch.columns), mask(batch.column(text).to_pylist())
            columns[text] = pa.array(texts, pa.string())
            columns[size] = pa.array([None if t is None else len(t) for t in texts],
                                     batch.column(size).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(rewrite, docs.schema)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and places in them."""
    bounded_batches(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("jaccard_join", one_of_each_group),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("best_fit_packing", packed),
]

#: Token sequences cannot be computed in SQL; tests compare the run with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
