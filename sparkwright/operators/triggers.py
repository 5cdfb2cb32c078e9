"""Row triggers over sets: the rows of all triggers of a statement in one pass over its changes.

A change is a row of a table's version before or after a statement that the other lacks or
has with other values; an update that changes nothing is none. UPDATE OF takes the columns
that differ.
"""

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Trigger:
    """AFTER event [OF columns] [WHEN when] INSERT values; expressions see ``old.name`` and ``new.name``."""

    event: str
    values: dict[str, Column]
    when: Column | None = None
    of: list[str] = field(default_factory=list)


def row_changes(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """event (insert, update, delete), old, new: structs of all columns, null where there is no such row."""
    names = before.columns
    a, b = before.select(F.struct(*names).alias("old")), after.select(F.struct(*names).alias("new"))
    joined = a.join(b, reduce(lambda x, y: x & y, (F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in key)), "full")
    event = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(~F.col("old").eqNullSafe(F.col("new")), "update")
    return joined.select(event.alias("event"), "old", "new").filter("event is not null")


def fired(changes: DataFrame, triggers: list[Trigger]) -> DataFrame:
    """The rows that the triggers, all of one target, insert for the changes."""

    def condition(t: Trigger) -> Column:
        of = [~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) for c in t.of]
        return reduce(lambda x, y: x & y, [F.col("event") == t.event, *([reduce(lambda x, y: x | y, of)] if of else []), *([t.when] if t.when is not None else [])])

    rows = F.array(*(F.when(condition(t), F.struct(*(v.alias(n) for n, v in t.values.items()))) for t in triggers))
    return changes.select(F.explode(rows).alias("row")).filter("row is not null").select("row.*")
