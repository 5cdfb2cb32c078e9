"""Sessions, tables and the SQL entry point."""

from pyspark.sql import DataFrame, SparkSession

from .dialect import normalise, tokens

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(name: str = "sparkwright", **conf) -> SparkSession:
    """A session with the settings that the library's semantics need; sizes are left to the cluster."""
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.parquet.aggregatePushdown": "true", "spark.sql.cbo.enabled": "true", "spark.sql.cbo.joinReorder.enabled": "true"}
    return SparkSession.builder.appName(name).config(map=fixed | conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str, args: dict | None = None) -> DataFrame:
    """A query in the dialect over the tables of a folder; only those that the text names as words are opened.

    A plan is resolved at once, so that a later call for another folder does not reach it. ``args``: values of
    the parameters :a, @a and $a by name, of ?1 as p1.
    """
    words = {w.lower() for w in tokens(text)}
    opened = {name: table(spark, sf_dir, name) for name in TABLES if name in words}
    for name, df in opened.items():
        df.createOrReplaceTempView(name)
    integers = {f.name.lower() for df in opened.values() for f in df.schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long")}
    return spark.sql(normalise(text, integers), args=args or None)


def explain(spark: SparkSession, sf_dir: str, text: str, mode: str = "formatted") -> DataFrame:
    """EXPLAIN: line, text of a query's plan; mode simple, extended, codegen, cost or formatted."""
    df = sql(spark, sf_dir, text)
    plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
    return spark.createDataFrame(list(enumerate(plan.splitlines())), "line int, text string")


def analyse(df: DataFrame, name: str) -> DataFrame:
    """ANALYZE: a row for each column: table, column, rows, values that are not null, distinct ones (approximate), least and greatest as text."""
    from pyspark.sql import functions as F

    found = df.agg(F.count("*").alias("n"), *(f(c).cast("string").alias(f"{k}_{c}") for c in df.columns for k, f in (("v", F.count), ("d", F.approx_count_distinct), ("lo", F.min), ("hi", F.max))))
    columns = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"v_{c}").cast("long").alias("given"), F.col(f"d_{c}").cast("long").alias("distinct"), F.col(f"lo_{c}").alias("least"), F.col(f"hi_{c}").alias("greatest")) for c in df.columns)))
    return found.select(F.lit(name).alias("table"), "n", columns.alias("c")).select("table", "n", "c.*")
