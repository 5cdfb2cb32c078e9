"""A corpus pipeline of five stages, each applying one operator of sparkwright.llm to all rows its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.

Defined results: a null or empty text is civil but in no language, so it goes at language ID; a null doc_id is in no
training row or group of duplicates and stays if its text does; rows that repeat id and text are one document after
near-dedup; of a group the least id stays; texts of any length are read whole; columns of other names stay as
they are until the last stage; an empty table gives no rows in every stage.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession

from sparkwright.llm import bpe, decontam, dedup, language, toxicity
from sparkwright.llm.shared import documents, folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more for toxicity go."""
    return toxicity.civil_documents(docs, toxicity.trained(docs, documents(spark, sf_dir, "labels")))


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no learned language, or whose language scores below 0.5, go."""
    return language.known_language(docs, language.trained(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays."""
    return dedup.kept_documents(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window that is similar to a benchmark item go."""
    return decontam.clean_documents(docs, documents(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("language ID", drop_unidentified),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]

#: Toxicity and language ID apply trained models and the BPE a vocabulary, none of which SQL can express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is a table in the shared folder."""
    base, docs = f"{folder(spark)}/pipeline-{uuid.uuid4().hex}", documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            removed(spark, f"{base}/{k - 1}")
    return docs


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a stage's table that its successor has read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
