"""Continuous queries: windowed counts with watermarks, and a view kept by increments in foreachBatch."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(stream: DataFrame, ts: str, width: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, ts: str, gap: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n"))


class AggregateView:
    """count and sums by key over a stream of rows (or of deltas with _weight). Each batch merges into a new version of the state's table.

    The batch's number names the version, so a batch that runs again writes the same one: exactly once.
    """

    def __init__(self, path: str, keys: list[str], sums: dict[str, str]):
        self.path, self.keys, self.sums = path, keys, sums

    def state(self, spark, version: int) -> DataFrame:
        return spark.read.parquet(f"{self.path}/v{version}")

    def __call__(self, batch: DataFrame, number: int) -> None:
        from ..operators import changes

        delta = batch if changes.W in batch.columns else changes.weighted(batch)
        if number:
            new = changes.delta_aggregate(self.state(batch.sparkSession, number - 1), delta, self.keys, self.sums)
        else:
            new = delta.groupBy(*self.keys).agg(F.sum(changes.W).alias("n"), *(F.sum(F.col(c) * F.col(changes.W)).alias(s) for s, c in self.sums.items()))
        new.write.mode("overwrite").parquet(f"{self.path}/v{number}")
