"""Sinks: CREATE TABLE AS and INSERT ... SELECT into folders of Parquet files, copies of all tables, attached folders, and the shell's output modes."""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def create_table_as(df: DataFrame, path: str, partition: list[str] | None = None) -> DataFrame:
    """Writes the rows as a new table; fails if there is one."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def insert_select(df: DataFrame, path: str) -> DataFrame:
    """Appends the rows, by the names of the table's columns, to the table at a path."""
    spark = df.sparkSession
    schema = spark.read.parquet(path).schema
    df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema)).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def vacuum_into(tables: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """A copy of all tables in a folder; each in as few files as its partitions."""
    return {name: create_table_as(df, f"{folder}/{name}.parquet") for name, df in tables.items()}


def attach(spark: SparkSession, folder: str, schema: str, names: list[str]) -> None:
    """Tables of a folder as schema_name; ``detach`` removes them."""
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(f"{schema}_{name}")


def detach(spark: SparkSession, schema: str, names: list[str]) -> None:
    for name in names:
        spark.catalog.dropTempView(f"{schema}_{name}")


def fresh(folder: str, name: str) -> str:
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def shown(df: DataFrame, mode: str = "list", separator: str = "|", null: str = "") -> Column:
    """A row as the shell prints it: list, csv, tabs, line, quote, insert or json."""
    text = {f.name: F.coalesce(F.col(f.name).cast("string"), F.lit(null)) for f in df.schema}
    if mode in ("list", "tabs"):
        return F.concat_ws("\t" if mode == "tabs" else separator, *text.values())
    if mode == "line":
        wide = max(map(len, text))
        return F.concat_ws("\n", *(F.concat(F.lit(f"{name:>{wide}} = "), value) for name, value in text.items()))
    if mode == "csv":
        return F.concat_ws(",", *(F.when(v.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v) for v in text.values()))
    if mode in ("quote", "insert"):
        own = [F.coalesce(F.concat(F.lit("'"), F.replace(F.col(f.name), F.lit("'"), F.lit("''")), F.lit("'")) if f.dataType.typeName() == "string" else F.col(f.name).cast("string"), F.lit("NULL")) for f in df.schema]
        return F.concat_ws(",", *own) if mode == "quote" else F.concat(F.lit("INSERT INTO tab VALUES("), F.concat_ws(",", *own), F.lit(");"))
    if mode == "json":
        return F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    raise ValueError(f"unknown mode {mode!r}")
