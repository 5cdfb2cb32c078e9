"""The registered queries, by name, and the SQL that DuckDB checks them with."""

from ..session import sql
from . import functional, relational, surface  # noqa: F401

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _add(name, text, oracle):
    QUERIES[name] = lambda spark, sf_dir: sql(spark, sf_dir, text)
    ORACLE_SQL[name] = oracle


for _name, _text in relational.BOTH.items():
    _add(_name, _text, _text)
for _name, (_text, _oracle) in relational.PAIRS.items():
    _add(_name, _text, _oracle or _text)
for _name, (_run, _oracle) in functional.ENTRIES.items():
    QUERIES[_name] = _run
    if _oracle:
        ORACLE_SQL[_name] = _oracle
