"""Window frames that Spark's syntax lacks: GROUPS, and EXCLUDE."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def groups_frame(df: DataFrame, partition: list[str], order: list, preceding: int | None, following: int | None, **aggregates: Column) -> DataFrame:
    """Aggregates over GROUPS BETWEEN preceding AND following: a RANGE frame over the dense rank of the peers. None: unbounded."""
    ranked = df.withColumn("__peer", F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))
    low = Window.unboundedPreceding if preceding is None else -preceding
    high = Window.unboundedFollowing if following is None else following
    frame = Window.partitionBy(*partition).orderBy("__peer").rangeBetween(low, high)
    return ranked.select("*", *(a.over(frame).alias(n) for n, a in aggregates.items())).drop("__peer")


def excluding(df: DataFrame, partition: list[str], order: list, value: str, exclude: str, rows: tuple | None = None) -> DataFrame:
    """count and sum of ``value`` over a frame without the current row, its group (peers and itself) or its ties (peers only).

    ``rows``: bounds of a ROWS frame; without, the default RANGE frame up to the current peers. Prefix-sum algebra: the frame's
    aggregate less the excluded part of it, so no frame is ever collected.
    """
    by = Window.partitionBy(*partition)
    peers = by.orderBy("__peer").rangeBetween(0, 0)
    df = df.withColumn("__peer", F.dense_rank().over(by.orderBy(*order)))
    value_or_0, one = F.coalesce(F.col(value), F.lit(0)), F.col(value).isNotNull().cast("long")
    if rows is None:
        frame, part = by.orderBy("__peer").rangeBetween(Window.unboundedPreceding, 0), peers
        gone = {"current row": (one, value_or_0), "group": (F.sum(one).over(part), F.sum(value_or_0).over(part))}
    else:
        # the rows of the current peers inside a ROWS frame: those within the bounds of the row's place among its peers
        # rows are numbered once, so that both frames see peers in one order
        df = df.withColumn("__row", F.row_number().over(by.orderBy(*order)))
        frame = by.orderBy("__row").rowsBetween(*rows)
        inside = Window.partitionBy(*partition, "__peer").orderBy("__row").rowsBetween(*rows)
        gone = {"current row": (one, value_or_0), "group": (F.coalesce(F.sum(one).over(inside), F.lit(0)), F.coalesce(F.sum(value_or_0).over(inside), F.lit(0)))}
        holds = F.lit(rows[0] <= 0 <= rows[1])
        gone["current row"] = tuple(F.when(holds, x).otherwise(0) for x in gone["current row"])
    gone["ties"] = tuple(g - c for g, c in zip(gone["group"], gone["current row"], strict=True))
    gone["no others"] = (F.lit(0), F.lit(0))
    n = F.coalesce(F.sum(one).over(frame), F.lit(0)) - gone[exclude][0]
    total = F.coalesce(F.sum(value_or_0).over(frame), F.lit(0)) - gone[exclude][1]
    return df.withColumn("n", n.cast("long")).withColumn("total", F.when(n > 0, total)).drop("__peer", "__row")


def excluding_aggregates(df: DataFrame, partition: list[str], order: list, value: str, exclude: str) -> DataFrame:
    """count, sum, min, max and avg of ``value`` over the default RANGE frame under EXCLUDE: the parts of the frame that stay, put together."""
    by = Window.partitionBy(*partition)
    df = df.withColumn("__peer", F.dense_rank().over(by.orderBy(*order))).withColumn("__row", F.row_number().over(by.orderBy(*order)))
    ahead = by.orderBy("__peer").rangeBetween(Window.unboundedPreceding, -1)
    peers = Window.partitionBy(*partition, "__peer").orderBy("__row")
    parts = {
        "no others": [by.orderBy("__peer").rangeBetween(Window.unboundedPreceding, 0)],
        "group": [ahead],
        "ties": [ahead, peers.rowsBetween(0, 0)],
        "current row": [ahead, peers.rowsBetween(Window.unboundedPreceding, -1), peers.rowsBetween(1, Window.unboundedFollowing)],
    }[exclude]
    none = F.lit(None)
    n = sum((F.count(value).over(w) for w in parts), F.lit(0))
    total = sum((F.coalesce(F.sum(value).over(w), F.lit(0)) for w in parts), F.lit(0))
    low, high = (f(none.cast(df.schema[value].dataType), none.cast(df.schema[value].dataType), *(g(value).over(w) for w in parts)) for f, g in ((F.least, F.min), (F.greatest, F.max)))
    df = df.withColumn("n", n.cast("long")).withColumn("total", F.when(F.col("n") > 0, total)).withColumn("low", low).withColumn("high", high)
    return df.withColumn("mean", F.col("total") / F.nullif(F.col("n"), F.lit(0))).drop("__peer", "__row")


def ntile_by_row(df: DataFrame, partition: list[str], order: list, buckets: str, name: str = "tile") -> DataFrame:
    """ntile(N) with N from a column: the first count mod N buckets hold one row more."""
    by = Window.partitionBy(*partition)
    r, c, n = F.row_number().over(by.orderBy(*order)) - 1, F.count("*").over(by), F.col(buckets)
    wide, small = F.floor(c / n) + 1, F.greatest(F.floor(c / n), F.lit(1))
    large = c % n * wide
    return df.withColumn(name, F.when(r < large, F.floor(r / wide)).otherwise(c % n + F.floor((r - large) / small)) + 1)
