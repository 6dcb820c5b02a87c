"""The corpus pipeline: reject toxic texts, near duplicates and contamination, redact personal data, mix the rest.

STAGES lists (name, function) in order.  Each function takes (spark, docs,
sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as Parquet into
the shared folder and reads them back as the next one's docs; a folder goes when
the stage that read it has been written.  All stages but the last return the
columns of documents, others that docs may have are carried along.  No stage
fails on nulls, empty or very long texts, repeated rows or empty tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontaminate, mixing, neardup, pii, toxicity
from quire.llm.common import remove_folder, shared_folder, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score less than 0.5; the model learns from the labelled ones among docs.

    Null and empty texts are calm and stay; repeated rows share their fate.
    """
    return toxicity.remove_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is connected by similarities of 0.8 or more, that with the least doc_id (null last).

    Of repeated rows one stays; null texts and texts without words all stay.
    """
    return neardup.remove_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is shared with benchmark items; null and empty texts share nothing and stay."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and n_chars corrected; null texts stay null."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes, in the order of training: the document, the words taken and its position.

    Texts without words, null ones among them, are never taken.
    """
    return mixing.mix(docs, keep=docs.columns).filter("taken > 0")


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
]
#: The classifier's and the forest's stages have no SQL; tests hold run() against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; the last one's rows lie in a folder of this run in spark.checkpoint.dir."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, read = table(spark, sf_dir, "documents"), None
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if read is not None:
            remove_folder(spark, read)
        read = path
    return docs
