"""Weighted deltas (views maintained by increments), change data capture, DML, constraints and versions.

A delta is a DataFrame with a column ``_weight``: +1 for a row that comes, -1 for one that goes.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .recursion import _cut

W = "_weight"


def consolidate(delta: DataFrame) -> DataFrame:
    """Weights of equal rows are summed; zeros go."""
    return delta.groupBy(*(c for c in delta.columns if c != W)).agg(F.sum(W).alias(W)).filter(F.col(W) != 0)


def weighted(df: DataFrame, weight: int = 1) -> DataFrame:
    return df.withColumn(W, F.lit(weight).cast("long"))


def delta_filter(delta: DataFrame, condition) -> DataFrame:
    return delta.filter(condition)


def delta_project(delta: DataFrame, *columns) -> DataFrame:
    return delta.select(*columns, W)


def delta_join(left: DataFrame, d_left: DataFrame, right: DataFrame, d_right: DataFrame, on: list[str]) -> DataFrame:
    """The change of an inner join: dL with R, L with dR, dL with dR; weights multiply. left and right are weighted states before the change."""

    def one(a, b):
        b = b.withColumnRenamed(W, "_other")
        return a.join(b, on).withColumn(W, F.col(W) * F.col("_other")).drop("_other")

    return one(d_left, right).unionByName(one(left, d_right)).unionByName(one(d_left, d_right))


def delta_union(*deltas: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, deltas)


def delta_distinct(state: DataFrame, delta: DataFrame) -> DataFrame:
    """The change of a UNION's rows: a row appears when its weight turns positive, and goes when it no longer is."""
    keys = [c for c in delta.columns if c != W]
    before = consolidate(state).withColumnRenamed(W, "_before")
    touched = consolidate(delta).join(before, keys, "left").withColumn("_before", F.coalesce("_before", F.lit(0)))
    turn = (F.col("_before") + F.col(W) > 0).cast("long") - (F.col("_before") > 0).cast("long")
    return touched.withColumn(W, turn).filter(F.col(W) != 0).select(*keys, W)


def delta_aggregate(state: DataFrame, delta: DataFrame, keys: list[str], sums: dict[str, str]) -> DataFrame:
    """New state (keys, n, sums) of count and sums by group; a group with no rows left goes. Only partial sums of the delta are shuffled."""
    change = delta.groupBy(*keys).agg(F.sum(W).alias("n"), *(F.sum(F.col(c) * F.col(W)).alias(name) for name, c in sums.items()))
    both = state.select(*keys, "n", *sums).unionByName(change)
    return both.groupBy(*keys).agg(F.sum("n").alias("n"), *(F.sum(s).alias(s) for s in sums)).filter("n > 0")


def delta_averages(state: DataFrame, delta: DataFrame, keys: list[str], value: str) -> DataFrame:
    """New state (keys, n, total, mean) of an average by group, kept as count and sum."""
    return delta_aggregate(state, delta, keys, {"total": value}).withColumn("mean", F.col("total") / F.col("n"))


def delta_extremes(rows_after: DataFrame, state: DataFrame, delta: DataFrame, keys: list[str], value: str) -> DataFrame:
    """New state (keys, lo, hi) of minimum and maximum: only touched groups are aggregated anew."""
    touched = delta.select(*keys).distinct()
    anew = rows_after.join(touched, keys, "left_semi").groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return state.join(touched, keys, "left_anti").unionByName(anew)


def apply_delta(table: DataFrame, delta: DataFrame) -> DataFrame:
    """The table's rows after a delta, as often as their weights say."""
    rest = consolidate(weighted(table).unionByName(delta)).filter(F.col(W) > 0)
    return rest.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col(W).cast("int")))).drop("_i", W)


# --- change data capture ---


def changes(before: DataFrame, after: DataFrame, key: list[str], mode: str = "full") -> DataFrame:
    """change_type (1 insert, 0 update, -1 delete), the key, and by mode: id nothing more, before, after, or full both as JSON."""
    rest = [c for c in before.columns if c not in key]
    a = before.select(F.struct(*key).alias("_key"), F.struct(*key, *rest).alias("_old"))
    b = after.select(F.struct(*key).alias("_at"), F.struct(*key, *rest).alias("_new"))
    joined = a.join(b, reduce(lambda x, y: x & y, (F.col(f"_key.{k}").eqNullSafe(F.col(f"_at.{k}")) for k in key)), "full")
    kind = F.when(F.col("_old").isNull(), 1).when(F.col("_new").isNull(), -1).when(~F.col("_old").eqNullSafe(F.col("_new")), 0)
    out = [kind.alias("change_type"), *(F.coalesce(f"_key.{k}", f"_at.{k}").alias(k) for k in key)]
    out += [F.to_json("_old").alias("before")] if mode in ("before", "full") else []
    out += [F.to_json("_new").alias("after")] if mode in ("after", "full") else []
    return joined.select(*out).filter("change_type is not null")


def change_log(before: DataFrame, after: DataFrame, key: list[str], name: str, mode: str = "full", txn: int = 1, first: int = 1) -> DataFrame:
    """The capture table's 9 columns: change_id, change_time, change_txn_id, change_type, table_name, id, before, after, updates. The last row (type 2) is the commit.

    ``updates``: of an update the new values, as text, of the columns that it changed, in mode full.
    """
    if mode not in ("id", "before", "after", "full"):
        raise ValueError(f"unknown mode {mode!r}")
    rest = [c for c in before.columns if c not in key]
    found = changes(before.select(*key, *rest), after.select(*key, *rest), key, "full")
    number = F.get_json_object
    pairs = F.array(*(F.when(~number("before", f"$.{c}").eqNullSafe(number("after", f"$.{c}")), F.struct(F.lit(c).alias("k"), number("after", f"$.{c}").alias("v"))) for c in rest))
    changed = F.to_json(F.map_from_entries(F.array_compact(pairs)), {"ignoreNullFields": "false"})
    blank = F.lit(None).cast("string")
    found = found.select(
        "change_type", F.lit(name).alias("table_name"), F.to_json(F.struct(*key)).alias("id") if len(key) > 1 else F.col(key[0]).cast("string").alias("id"),
        (F.col("before") if mode in ("before", "full") else blank).alias("before"), (F.col("after") if mode in ("after", "full") else blank).alias("after"),
        (F.when(F.col("change_type") == 0, changed) if mode == "full" else blank).alias("updates"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)),
    )
    order = [f"_k{i}" for i in range(len(key))]
    numbered = next_values(found, order, first, 1, "change_id").drop(*order)
    commit = numbered.agg((F.coalesce(F.max("change_id"), F.lit(first - 1)) + 1).alias("change_id"))
    commit = commit.select("change_id", F.lit(2).alias("change_type"), *(blank.alias(c) for c in ("table_name", "id", "before", "after", "updates")))
    both = numbered.unionByName(commit)
    return both.select("change_id", F.unix_seconds(F.current_timestamp()).alias("change_time"), F.lit(txn).cast("long").alias("change_txn_id"), "change_type", "table_name", "id", "before", "after", "updates")


def row_diff(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """What a comparison of two tables reports: the key, and only_left, only_right or differs."""
    kind = F.when(F.col("change_type") == -1, "only_left").when(F.col("change_type") == 1, "only_right").otherwise("differs")
    return changes(left, right, key, "id").select(*key, kind.alias("status"))


# --- DML: a table's next version ---


def with_defaults(table: DataFrame, rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """rows with the columns that they lack: DEFAULT values, else null."""
    return rows.select(*(F.col(c) if c in rows.columns else defaults.get(c, F.lit(None)).cast(table.schema[c].dataType).alias(c) for c in table.columns))


def generated(table: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Generated columns, each of which may use those before it; computed anew for every version of a table."""
    for name, value in columns.items():
        table = table.withColumn(name, value)
    return table


def delete_cascade(parent: DataFrame, child: DataFrame, key: str, foreign: str, where: Column, action: str = "cascade") -> tuple[DataFrame, DataFrame]:
    """DELETE of parent rows and what a foreign key then does to the child: cascade, set null or restrict."""
    gone = parent.filter(F.coalesce(where, F.lit(False))).select(F.col(key).alias(foreign)).distinct()
    rest = delete(parent, where)
    if action == "cascade":
        return rest, child.join(gone, foreign, "left_anti").select(child.columns)
    if action == "set null":
        marked = child.join(gone.withColumn("_gone", F.lit(True)), foreign, "left")
        return rest, marked.select(*(F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == foreign else F.col(c) for c in child.columns))
    if not child.join(gone, foreign, "left_semi").limit(1).isEmpty():
        raise ValueError("FOREIGN KEY constraint failed")
    return rest, child


def insert(table: DataFrame, rows: DataFrame, key: list[str], conflict: str = "abort") -> DataFrame:
    """INSERT OR abort / fail / rollback / ignore / replace. A statement's next version is all or nothing, so that fail and rollback are abort."""
    conflict = "abort" if conflict in ("fail", "rollback") else conflict
    if conflict == "replace":
        return table.join(rows, key, "left_anti").unionByName(rows)
    fresh = rows.join(table, key, "left_anti")
    if conflict == "abort":
        clash = rows.join(table.select(*key), key, "left_semi").select(F.raise_error("UNIQUE constraint failed").alias("e"))
        if not clash.limit(1).isEmpty():
            raise ValueError("UNIQUE constraint failed")
    return table.unionByName(fresh)


def upsert(table: DataFrame, rows: DataFrame, key: list[str], update: dict[str, Column] | None, where: Column | None = None) -> DataFrame:
    """ON CONFLICT DO NOTHING (update None) or DO UPDATE SET; the columns of rows are visible as ``excluded.name``."""
    t, e = table.alias("t"), rows.alias("excluded")
    same = [F.col(f"t.{k}") == F.col(f"excluded.{k}") for k in key]
    hit = F.col(f"excluded.{key[0]}").isNotNull()
    own = hit & (F.lit(True) if where is None else where) if update else F.lit(False)
    kept = t.join(e, same, "left").select(*(F.when(own, update[c]).otherwise(F.col(f"t.{c}")).alias(c) if update and c in update else F.col(f"t.{c}").alias(c) for c in table.columns))
    return kept.unionByName(rows.join(table, key, "left_anti"))


def update_from(table: DataFrame, source: DataFrame, on: list[str], values: dict[str, Column], where: Column | None = None) -> DataFrame:
    """UPDATE ... SET ... FROM: source rows are visible as ``s.name``; one row at most for each key."""
    t, s = table.alias("t"), source.alias("s")
    hit = F.col(f"s.{on[0]}").isNotNull() & (F.lit(True) if where is None else where)
    return t.join(s, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in on], "left").select(*(F.when(hit, values[c]).otherwise(F.col(f"t.{c}")).alias(c) if c in values else F.col(f"t.{c}").alias(c) for c in table.columns))


def delete(table: DataFrame, where: Column) -> DataFrame:
    return table.filter(~F.coalesce(where, F.lit(False)))


def returning(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Rows that a statement inserted or updated."""
    names = before.columns
    return after.select(names).exceptAll(before.select(names))


def violations(table: DataFrame, checks: dict[str, Column] | None = None, not_null: list[str] = (), unique: list[list[str]] = (), foreign: list[tuple[str, DataFrame, str]] = ()) -> DataFrame:
    """constraint, row (JSON) of what breaks CHECK, NOT NULL, UNIQUE and FOREIGN KEY; a null check passes."""
    row = F.to_json(F.struct(*table.columns))
    out = [table.filter(~F.coalesce(c, F.lit(True))).select(F.lit(f"CHECK {n}").alias("constraint"), row.alias("row")) for n, c in (checks or {}).items()]
    out += [table.filter(F.col(c).isNull()).select(F.lit(f"NOT NULL {c}").alias("constraint"), row.alias("row")) for c in not_null]
    for key in unique:
        twice = table.dropna(subset=key).groupBy(*key).count().filter("count > 1").drop("count")
        out.append(table.join(twice, key, "left_semi").select(F.lit(f"UNIQUE {', '.join(key)}").alias("constraint"), row.alias("row")))
    for c, parent, pk in foreign:
        orphans = table.filter(F.col(c).isNotNull()).join(parent.select(F.col(pk).alias(c)).distinct(), c, "left_anti")
        out.append(orphans.select(F.lit(f"FOREIGN KEY {c}").alias("constraint"), F.to_json(F.struct(*table.columns)).alias("row")))
    return reduce(DataFrame.unionAll, out)


def next_values(df: DataFrame, order: list, start: int = 1, increment: int = 1, name: str = "nextval") -> DataFrame:
    """Sequence numbers for all rows in an order: ranks within range partitions and the partitions' sizes before, no single task for all rows."""
    from pyspark.sql import Window

    # ranges are sampled, so that the rows' partitions are written down before both branches read them
    dealt = _cut((df.repartitionByRange(*order) if order else df).withColumn("_p", F.spark_partition_id()))
    ranked = dealt.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*(order or ["_p"]))))
    sizes = ranked.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranked.join(F.broadcast(sizes.select("_p", "_before")), "_p").withColumn(name, F.lit(start) + F.lit(increment) * (F.col("_before") + F.col("_r") - 1)).drop("_p", "_r", "_before")


def table_hash(df: DataFrame) -> DataFrame:
    """n and an order-free hash of all rows."""
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash"))


class Versions:
    """Transactions over tables: a stack of immutable versions, savepoints by name."""

    def __init__(self, **tables: DataFrame):
        self.tables, self.stack = dict(tables), []

    def begin(self, name: str = ""):
        self.stack.append((name, dict(self.tables)))

    def put(self, name: str, table: DataFrame):
        self.tables[name] = table

    def commit(self):
        self.stack.clear()

    def rollback(self, to: str | None = None):
        while self.stack:
            name, state = self.stack.pop()
            self.tables = dict(state)
            if to is not None and name == to:
                self.stack.append((name, state))
                return
        if to is not None:
            raise KeyError(f"no such savepoint: {to}")


class Sequence:
    """CREATE SEQUENCE: take numbers a frame's rows in an order; currval is the last number given, setval sets it."""

    def __init__(self, start: int = 1, increment: int = 1):
        self.next, self.increment, self.last = start, increment, None

    def take(self, df: DataFrame, order: list, name: str = "nextval") -> DataFrame:
        out = _cut(next_values(df, order, self.next, self.increment, name))
        n = out.count()
        if n:
            self.last = self.next + self.increment * (n - 1)
            self.next = self.last + self.increment
        return out

    def currval(self) -> int:
        if self.last is None:
            raise ValueError("currval of a sequence before its first nextval")
        return self.last

    def setval(self, value: int, called: bool = True) -> int:
        self.last, self.next = value, value + self.increment if called else value
        return value


def alter_table(table: DataFrame, add: dict[str, Column] | None = None, drop: list[str] = (), rename: dict[str, str] | None = None) -> DataFrame:
    """ALTER TABLE: columns dropped, then renamed, then added with a value for the rows that are there."""
    for c in [*drop, *(rename or {})]:
        if c not in table.columns:
            raise ValueError(f"no such column: {c}")
    table = table.drop(*drop).withColumnsRenamed(rename or {})
    for c, value in (add or {}).items():
        if c.lower() in (x.lower() for x in table.columns):
            raise ValueError(f"duplicate column name: {c}")
        table = table.withColumn(c, value)
    return table
