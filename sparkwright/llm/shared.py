"""What the operators share: columns, folds, samples and cutting lineage."""

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Whether a query's shuffle files are removed when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key as long and the text as string; other columns, of whatever names, stay out."""
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def fold(column, of: int):
    """crc32 of the id as text, modulo ``of``; null for a null id."""
    return F.crc32(column.cast("string").cast("binary")) % of


def folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only in local mode, where there is one machine, one of our own if none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        own = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not own and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(own or tempfile.mkdtemp(prefix="sparkwright-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder; the shuffle files that they came from go at once."""
    spark = df.sparkSession
    folder(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def chosen(rows: DataFrame, key: str, most: int) -> DataFrame:
    """A bounded sample for fitting: the ``most`` keys that hash lowest, one row each (of repeated keys the row that sorts first).

    Each task finds its lowest distinct hashes, so that neither texts nor all keys are gathered to find the cut.
    """

    def lowest(batches):
        held = np.zeros(0, np.int64)
        for batch in batches:
            held = np.unique(np.concatenate([held, np.asarray(batch.column(0))]))[:most]
        yield pa.RecordBatch.from_arrays([pa.array(held)], ["h"])

    order = F.xxhash64(F.col(key))
    few = rows.select(order.alias("h")).mapInArrow(lowest, "h long").distinct().orderBy("h").limit(most)
    edge = few.agg(F.max("h")).first()[0]
    if edge is None:
        return rows.limit(0)
    rest = [c for c in rows.columns if c != key]
    one = rows.filter(order <= F.lit(edge)).groupBy(key)
    return one.agg(F.min(F.struct(*rest)).alias("row")).select(key, "row.*") if rest else one.agg(F.count("*").alias("n")).select(key)
