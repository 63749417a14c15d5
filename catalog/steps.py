"""Queries for the recipe steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import (
    MESSY_SQL, check_money, condition as c, keep, messy, recipe, register, spark_money, table,
)
from tidyloom.operators import access
from tidyloom.plans import recipe as recipes


def _steps(name, source, steps, sql, order_by=None):
    def query(spark, folder):
        df = source(spark, folder) if callable(source) else table(spark, folder, source)
        return recipes.run(df, recipe(*steps), order_by=order_by).visible()

    register(name, query, sql)


def _select(*names):
    return {"kind": "select_columns", "columns": list(names)}


def _distinct(keep_rows, *names):
    return {"kind": "drop_duplicates", "columns": list(names), "keep": keep_rows}


register(
    "t_filter",
    lambda spark, folder: recipes.run(
        messy(spark, folder), recipe(keep(c("price", "greater_than", value=450000)))
    ).visible(),
    f"SELECT * FROM {MESSY_SQL} WHERE price > 450000",
)

# Duplicates. The first two have their order from a key, the third from the file.
_RANKED = "SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS place FROM {table}) WHERE place = 1"
_steps("t_dedup_first", "orders", [_distinct("first", "o_custkey")],
       _RANKED.format(cols="* EXCLUDE place", key="o_custkey", order="o_orderkey", table="orders"), ["o_orderkey"])
_steps("t_dedup_last", "orders", [_distinct("last", "o_custkey", "o_orderpriority")],
       _RANKED.format(cols="* EXCLUDE place", key="o_custkey, o_orderpriority", order="o_orderkey DESC", table="orders"),
       ["o_orderkey"])
_steps("t_dedup_file_order", "events", [_distinct("first", "user_id", "event_type"), _select("event_id", "user_id", "event_type", "value")],
       _RANKED.format(cols="event_id, user_id, event_type, value", key="user_id, event_type", order="event_id", table="events"))
_steps("t_dedup_none", "lineitem", [_distinct("none", "l_orderkey", "l_linenumber")],
       "SELECT * EXCLUDE n FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1")
_steps("t_dedup_all", "documents", [{"kind": "drop_columns", "columns": ["doc_id"]}, _distinct("first")],
       "SELECT DISTINCT text, lang, source, n_chars FROM documents")

_steps("t_drop_empty_any", messy, [{"kind": "drop_empty_rows", "columns": ["priority", "price"], "mode": "any"}],
       f"SELECT * FROM {MESSY_SQL} WHERE NOT (priority IS NULL OR trim(priority) = '' OR price IS NULL)")
_steps("t_drop_empty_all", messy, [{"kind": "drop_empty_rows", "columns": ["priority", "price"], "mode": "all"}],
       f"SELECT * FROM {MESSY_SQL} WHERE NOT ((priority IS NULL OR trim(priority) = '') AND price IS NULL)")
_steps("t_select", "part", [_select("p_type", "p_partkey", "p_type")], "SELECT p_type, p_partkey FROM part")
_steps("t_drop", "part", [{"kind": "drop_columns", "columns": ["p_retailprice", "p_size"]}],
       "SELECT p_partkey, p_name, p_brand, p_type FROM part")
_steps("t_rename_swap", "part",
       [{"kind": "rename_columns", "mapping": [{"from": "p_name", "to": "p_brand"}, {"from": "p_brand", "to": "p_name"}, {"from": "p_size", "to": " Size. "}]}],
       'SELECT p_partkey, p_name AS p_brand, p_brand AS p_name, p_type, p_size AS "Size.", p_retailprice FROM part')


# Sorting shows in the places of all rows.
def _sorted(*steps):
    def query(spark, folder):
        frame = recipes.run(messy(spark, folder), recipe(*steps), order_by=["o_orderkey"])
        return access.numbered(frame).select(F.col(access.PLACE).alias("place"), *frame.schema.names)

    return query


_BY_PRICE = {"kind": "sort", "by": [{"column": "price", "direction": "desc"}]}
_BY_PRIORITY = {"kind": "sort", "by": [{"column": "priority", "direction": "desc"}, {"column": "price", "direction": "asc"}]}
register("t_sort_top", _sorted(_BY_PRICE), f"SELECT row_number() OVER (ORDER BY price DESC NULLS LAST, o_orderkey) - 1 AS place, * FROM {MESSY_SQL}")
register("t_sort_two_keys", _sorted(_BY_PRIORITY),
         f"SELECT row_number() OVER (ORDER BY priority DESC NULLS LAST, price ASC NULLS LAST, o_orderkey) - 1 AS place, * FROM {MESSY_SQL}")
register(
    "t_sort_then_cast",
    _sorted(_BY_PRICE, {"kind": "cast", "column": "price", "to": "text"}, _select("o_orderkey", "price")),
    f"SELECT row_number() OVER (ORDER BY messy.price DESC NULLS LAST, o_orderkey) - 1 AS place, o_orderkey, CAST(price AS VARCHAR) AS price FROM {MESSY_SQL}",
)


# Casts, on text made from typed columns.
def _texts(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.expr(f"concat('R$ ', {spark_money('o_totalprice')})").alias("money"),
        F.date_format("o_orderdate", "d/M/yyyy").alias("day"),
        F.concat(F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit(" 10:30")).alias("iso"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN ' SIM' WHEN 'O' THEN 'não' ELSE 'talvez' END").alias("flag"),
    )


_TEXTS_SQL = f"""(SELECT o_orderkey, o_totalprice, o_orderdate, o_orderstatus, 'R$ ' || {check_money('o_totalprice')} AS money,
    strftime(o_orderdate, '%-d/%-m/%Y') AS day FROM orders) AS texts"""
_steps("t_cast_number", _texts, [{"kind": "cast", "column": "money", "to": "number"}, _select("o_orderkey", "money")],
       f"SELECT o_orderkey, TRY_CAST(replace(replace(replace(money, 'R$', ''), '.', ''), ',', '.') AS DOUBLE) AS money FROM {_TEXTS_SQL}")
_steps("t_cast_date", _texts, [{"kind": "cast", "column": "day", "to": "date", "format": "DD/MM/YYYY"}, _select("o_orderkey", "day")],
       f"SELECT o_orderkey, CAST(try_strptime(day, '%d/%m/%Y') AS TIMESTAMP) AS day FROM {_TEXTS_SQL}")
_steps("t_cast_date_strptime", _texts, [{"kind": "cast", "column": "day", "to": "date", "format": "%d/%m/%Y"}, _select("o_orderkey", "day")],
       f"SELECT o_orderkey, CAST(try_strptime(day, '%d/%m/%Y') AS TIMESTAMP) AS day FROM {_TEXTS_SQL}")
_steps("t_cast_date_iso", _texts, [{"kind": "cast", "column": "iso", "to": "date"}, _select("o_orderkey", "iso")],
       f"SELECT o_orderkey, TRY_CAST(strftime(o_orderdate, '%Y/%m/%d') || ' 10:30' AS TIMESTAMP) AS iso FROM {_TEXTS_SQL}")
_steps("t_cast_boolean", _texts, [{"kind": "cast", "column": "flag", "to": "boolean"}, _select("o_orderkey", "flag")],
       f"SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS flag FROM {_TEXTS_SQL}")
_steps("t_cast_text", "customer", [{"kind": "cast", "column": "c_acctbal", "to": "text"}, _select("c_custkey", "c_acctbal")],
       "SELECT c_custkey, CAST(c_acctbal AS VARCHAR) AS c_acctbal FROM customer")


def _scaled(spark, folder):
    return table(spark, folder, "lineitem").select(
        (F.col("l_extendedprice") * 1e12).alias("large"), (F.col("l_discount") / 1e5).alias("small"), "l_quantity", "l_shipdate",
    )


_steps("t_cast_text_exponents", _scaled,
       [{"kind": "cast", "column": n, "to": "text"} for n in ("large", "small", "l_quantity", "l_shipdate")],
       "SELECT CAST(l_extendedprice * 1e12 AS VARCHAR) AS large, CAST(l_discount / 1e5 AS VARCHAR) AS small, "
       "CAST(l_quantity AS VARCHAR) AS l_quantity, CAST(l_shipdate AS VARCHAR) AS l_shipdate FROM lineitem")

# Replacing and filling.
_steps("t_replace_exact_chain", messy,
       [{"kind": "replace_values", "column": "status", "mode": "exact",
         "replacements": [{"from": "f", "to": "P"}, {"from": "P ", "to": "pending"}, {"from": "O", "to": "open"}]}, _select("o_orderkey", "status")],
       f"SELECT o_orderkey, CASE trim(status) WHEN 'f' THEN 'pending' WHEN 'P' THEN 'pending' WHEN 'O' THEN 'open' ELSE status END AS status FROM {MESSY_SQL}")
_steps("t_replace_contains", "part",
       [{"kind": "replace_values", "column": "p_name", "mode": "contains", "replacements": [{"from": "i", "to": "e"}, {"from": "e", "to": "ee"}]},
        _select("p_partkey", "p_name")],
       "SELECT p_partkey, replace(replace(p_name, 'i', 'e'), 'e', 'ee') AS p_name FROM part")
_steps("t_replace_number", "customer",
       [{"kind": "replace_values", "column": "c_acctbal", "mode": "contains", "replacements": [{"from": ".", "to": ","}]}, _select("c_custkey", "c_acctbal")],
       "SELECT c_custkey, replace(CAST(c_acctbal AS VARCHAR), '.', ',') AS c_acctbal FROM customer")
_steps("t_fill_text", messy, [{"kind": "fill_empty", "column": "priority", "value": "none"}, _select("o_orderkey", "priority")],
       f"SELECT o_orderkey, CASE WHEN priority IS NULL OR trim(priority) = '' THEN 'none' ELSE priority END AS priority FROM {MESSY_SQL}")
_steps("t_fill_number", messy, [{"kind": "fill_empty", "column": "price", "value": "1.000,50"}, _select("o_orderkey", "price")],
       f"SELECT o_orderkey, coalesce(price, 1000.5) AS price FROM {MESSY_SQL}")


def _gaps(spark, folder):
    return table(spark, folder, "events").select("event_id", F.expr("CASE WHEN event_type = 'view' THEN NULL ELSE ts END").alias("ts"))


_steps("t_fill_date", _gaps, [{"kind": "fill_empty", "column": "ts", "value": "2024-02-29"}],
       "SELECT event_id, CASE WHEN event_type = 'view' THEN TIMESTAMP '2024-02-29' ELSE ts END AS ts FROM events")

# A whole recipe.
FLAGSHIP = recipe(
    keep({"type": "group", "logic": "AND", "children": [
        c("o_orderstatus", "equals", value=" f"), c("o_totalprice", "greater_than", value="100.000,00")]}),
    _distinct("first", "o_custkey"),
    _select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"),
    {"kind": "sort", "by": [{"column": "o_totalprice", "direction": "desc"}]},
    metrics=[
        {"id": "rows", "operation": "count"}, {"id": "total", "operation": "sum", "column": "o_totalprice"},
        {"id": "kept", "operation": "percentage"},
    ],
)
FLAGSHIP_SQL = """SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM (
    SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders
    WHERE lower(trim(o_orderstatus)) = 'f' AND o_totalprice > 100000) WHERE place = 1"""


def flagship(spark, folder):
    return recipes.run(table(spark, folder, "orders"), FLAGSHIP).visible()


register("t_recipe", flagship, FLAGSHIP_SQL)
_steps(
    "t_recipe_messy", messy,
    [
        {"kind": "replace_values", "column": "status", "mode": "exact", "replacements": [{"from": "f", "to": "FILLED"}]},
        {"kind": "fill_empty", "column": "priority", "value": "0-NONE"},
        {"kind": "drop_empty_rows", "columns": ["price"], "mode": "any"},
        {"kind": "rename_columns", "mapping": [{"from": "price", "to": "Valor"}]},
        keep(c("status", "in", values=["filled", "o"])),
        _distinct("last", "o_custkey", "priority"),
        _select("o_orderkey", "priority", "status", "Valor"),
    ],
    f"""SELECT o_orderkey, priority, status, price AS "Valor" FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey, priority ORDER BY o_orderkey DESC) AS place FROM (
            SELECT o_orderkey, o_custkey, price, CASE trim(status) WHEN 'f' THEN 'FILLED' ELSE status END AS status,
                CASE WHEN priority IS NULL OR trim(priority) = '' THEN '0-NONE' ELSE priority END AS priority
            FROM {MESSY_SQL} WHERE price IS NOT NULL)
        WHERE lower(trim(status)) IN ('filled', 'o')) WHERE place = 1""",
    ["o_orderkey"],
)
register(
    "t_referenced_columns",
    lambda spark, folder: table(spark, folder, "orders").select(*recipes.referenced_columns(FLAGSHIP)),
    "SELECT o_orderstatus, o_totalprice, o_custkey, o_orderkey, o_orderdate FROM orders",
)
