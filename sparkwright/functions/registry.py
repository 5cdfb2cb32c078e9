"""User-defined functions by name, for SQL: scalar and aggregate ones over Arrow batches, and table functions."""

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def scalar(spark: SparkSession, name: str, function: Callable, kind: str, deterministic: bool = True) -> None:
    """``function`` takes and returns pandas Series. One that is not deterministic is neither folded nor moved."""
    udf = F.pandas_udf(function, kind)
    spark.udf.register(name, udf if deterministic else udf.asNondeterministic())


def aggregate(spark: SparkSession, name: str, function: Callable, kind: str) -> None:
    """``function`` takes the Series of a group and returns a value. A group is one batch of one worker: for groups of bounded size."""
    spark.udf.register(name, F.pandas_udf(function, kind))


def table_function(spark: SparkSession, name: str, rows: Callable, schema: str) -> None:
    """``rows(*arguments)`` yields the tuples of each call; in SQL after LATERAL."""

    class Own:
        def eval(self, *arguments):
            yield from rows(*arguments)

    spark.udtf.register(name, F.udtf(Own, returnType=schema))
