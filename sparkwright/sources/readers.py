"""Sources: series, values, CSV, text copies, JSON tables, and a virtual-table protocol on Python data sources."""

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def generate_series(spark: SparkSession, start: int, stop: int, step: int = 1) -> DataFrame:
    """start to stop, both included; empty if the step leads away; a step of 0 is refused."""
    if step == 0:
        raise ValueError("step must not be 0")
    return spark.range(start, stop + (1 if step > 0 else -1), step).withColumnRenamed("id", "value")


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def read_csv(spark: SparkSession, path: str, schema: str | None = None, header: bool = True) -> DataFrame:
    reader = spark.read.option("header", header).option("escape", '"').option("multiLine", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def csv_data(spark: SparkSession, data: str, schema: str | None = None, header: bool = True) -> DataFrame:
    """An inline CSV text."""
    reader = spark.read.option("header", header).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(spark.sparkContext.parallelize(data.splitlines(), 1))


def import_csv(spark: SparkSession, path: str, schema: str, skip: int = 0) -> DataFrame:
    """CSV without the first records of each file; quoted line breaks are part of their field."""
    rows = spark.read.schema(schema).option("escape", '"').option("multiLine", True).csv(path)
    if not skip:
        return rows
    # a file that may hold quoted line breaks is read by one task, in which its records are numbered
    number = F.monotonically_increasing_id()
    rows = rows.select("*", F.col("_metadata.file_path").alias("_f"), number.alias("_i"))
    first = rows.groupBy("_f").agg(F.min("_i").alias("_first"))
    return rows.join(first, "_f").filter(F.col("_i") >= F.col("_first") + skip).drop("_f", "_i", "_first")


def copy_from(spark: SparkSession, path: str, schema: str, delimiter: str = "\t", null: str = "\\N", header: bool = False, columns: list[str] | None = None) -> DataFrame:
    """COPY's text format; a bad row fails the whole read. ``columns``: those that the file has, in its order; the others are null."""
    from pyspark.sql import types as T

    every = T.StructType.fromDDL(schema)
    own = T.StructType([every[c] for c in columns]) if columns else every
    rows = spark.read.schema(own).option("sep", delimiter).option("nullValue", null).option("header", header).option("mode", "FAILFAST").csv(path)
    return rows.select(*(F.col(f.name) if f.name in own.names else F.lit(None).cast(f.dataType).alias(f.name) for f in every))


def json_each(df: DataFrame, column: str, path: str = "$") -> DataFrame:
    """The columns of df and the 8 of json_each for each member of a JSON column's top level (or of the value at a path): key, value, type, atom, id, parent, fullkey, path."""
    nodes = df.withColumn("_n", F.explode(json_tree(F.col(column) if path == "$" else F.get_json_object(column, path))))
    member = nodes.filter("_n.parent = 0 or (_n.parent is null and _n.type not in ('array', 'object'))")
    names = ("key", "value", "type", "atom", "id", "fullkey", "path")
    return member.select(*df.columns, *(F.col(f"_n.{c}").alias(c) for c in names[:5]), F.lit(None).cast("int").alias("parent"), *(F.col(f"_n.{c}").alias(c) for c in names[5:]))


def tree(text: str | None) -> list[tuple]:
    """id, parent, key, value, type, atom, fullkey, path of every node, depth first; the value of an array or object is its JSON text."""
    out: list[tuple] = []

    def visit(v, key, parent, full, path):
        me = len(out)
        kind = "null" if v is None else {bool: str(v).lower(), int: "integer", float: "real", str: "text", list: "array", dict: "object"}[type(v)]
        own = None if v is None else v if isinstance(v, str) else json.dumps(v, separators=(",", ":"), ensure_ascii=False)
        out.append((me, parent, key, own, kind, None if isinstance(v, list | dict) else own, full, path))
        items = v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ()
        for k, x in items:
            visit(x, str(k), me, f"{full}.{k}" if isinstance(v, dict) else f"{full}[{k}]", full)

    if text is not None:
        visit(json.loads(text), None, None, "$", "$")
    return out


def json_tree(column: Column) -> Column:
    """An array of the nodes of a JSON text (to be exploded), by an Arrow UDF: ids need a depth-first walk."""
    import pandas as pd

    @F.pandas_udf("array<struct<id:int,parent:int,key:string,value:string,type:string,atom:string,fullkey:string,path:string>>")
    def run(x: pd.Series) -> pd.Series:
        names = ("id", "parent", "key", "value", "type", "atom", "fullkey", "path")
        return x.map(lambda t: [dict(zip(names, n, strict=True)) for n in tree(t)])

    return run(column)


def catalog(spark: SparkSession, name: str) -> DataFrame:
    """table_info: cid, name, type, notnull of a table or view."""
    fields = spark.table(name).schema.fields
    return spark.createDataFrame([(i, f.name, f.dataType.simpleString(), int(not f.nullable)) for i, f in enumerate(fields)], "cid int, name string, type string, notnull int")


def virtual_table(spark: SparkSession, name: str, schema: str, partitions, rows) -> None:
    """Registers a table whose partitions are given by ``partitions(options)`` and rows by ``rows(partition)``; read with spark.read.format(name)."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.options = options

        def partitions(self):
            return [InputPartition(p) for p in partitions(self.options)]

        def read(self, partition):
            yield from rows(partition.value)

    class Source(DataSource):
        def schema(self):
            return schema

        def reader(self, schema):
            return Reader(dict(self.options))

    Source.name = classmethod(lambda cls: name)
    spark.dataSource.register(Source)
