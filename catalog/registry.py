"""Registered queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidyloom.session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")

    def prepared(spark: SparkSession, folder: str) -> DataFrame:
        return query(configure(spark), folder)

    QUERIES[name] = prepared
    if sql is not None:
        ORACLES[name] = sql


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Orders as a person might have kept them: gaps, blanks, stray spaces, local money
# and dates. The expressions mean the same in Spark and in the checking SQL.
_MONEY = (
    "replace(replace(replace(format_number({x}, 2), ',', '#'), '.', ','), '#', '.')",
    "replace(replace(replace(format('{{:,.2f}}', {x}), ',', '#'), '.', ','), '#', '.')",
)
MESSY = """
    o_orderkey, o_custkey, o_totalprice, o_orderdate,
    CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN NULL WHEN '5-LOW' THEN '  ' ELSE o_orderpriority END AS priority,
    CASE WHEN o_orderstatus = 'F' THEN '  f ' ELSE o_orderstatus END AS status,
    CASE WHEN o_totalprice >= 50000 THEN o_totalprice END AS price
"""
MESSY_SQL = f"(SELECT {MESSY} FROM orders) AS messy"


def messy(spark: SparkSession, folder: str) -> DataFrame:
    table(spark, folder, "orders").createOrReplaceTempView("messy_orders")
    return spark.sql(f"SELECT {MESSY} FROM messy_orders")


def spark_money(x: str) -> str:
    """Local money text of a number, as a Spark expression."""
    return _MONEY[0].format(x=x)


def check_money(x: str) -> str:
    """The same as a DuckDB expression."""
    return _MONEY[1].format(x=x)


def condition(column: str, operator: str, **more) -> dict:
    return {"type": "condition", "column": column, "operator": operator, **more}


def group(*children: dict, logic: str = "AND", **more) -> dict:
    return {"type": "group", "logic": logic, "children": list(children), **more}


def keep(tree: dict) -> dict:
    """Filter step for a tree."""
    return {"kind": "filter", "filter": tree if tree["type"] == "group" else group(tree)}


def recipe(*steps: dict, metrics: list[dict] | None = None) -> dict:
    return {"version": 1, "steps": list(steps), "metrics": metrics or []}
