"""Corpus pipeline: five stages over ``documents``, each written as Parquet and reread as the next one's input.

1. toxicity: documents that the conditional random field scores at 0.5 or more go;
2. near-dedup: of documents linked by word shingles (five words, similarity of 0.8 or more) the smallest doc_id stays;
3. decontamination: documents that hold a benchmark window go;
4. secrets: secret spans in texts are replaced by marks, n_chars follows; every document stays;
5. mixing: words that the mix takes of each document, by source weights (rows refer to documents by doc_id).

Null texts count as empty and pass every stage. Near-duplicates are rows, not ids: of linked rows the first in the
order of doc_id (null last) stays, also where ids repeat or are null. Empty tables give empty tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.llm import decontaminate, mixing, near_dedup, secrets_scan, toxicity
from kinelake.llm.frames import remove, shared_dir

WIDTH, PERCENT = 5, 80


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs, WIDTH, PERCENT)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    safe = secrets_scan.find_secrets(docs, redacted=True)
    return safe.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminated),
    ("secrets", redact_secrets),
    ("mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another; each is written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
        if k:  # the next stage's input is all that is read from now on
            remove(spark, f"{folder}/{k - 1}_{STAGES[k - 1][0]}")
    return docs


#: the field's scores, near-duplicates of what it left and the balanced sample have no SQL form
ORACLE_SQL = None
