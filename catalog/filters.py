"""Queries for the filter operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import MESSY_SQL, condition as c, group, keep, messy, recipe, register, table
from tidyloom.errors import RecipeError
from tidyloom.model import schema_of
from tidyloom.operators import filters
from tidyloom.plans import recipe as recipes


def _filter(name: str, source, columns: list[str], tree: dict, sql_from: str, where: str) -> None:
    def query(spark, folder):
        df = source(spark, folder) if callable(source) else table(spark, folder, source)
        steps = [keep(tree), {"kind": "select_columns", "columns": columns}]
        return recipes.run(df, recipe(*steps)).visible()

    register(name, query, f"SELECT {', '.join(columns)} FROM {sql_from} WHERE {where}")


def _orders(name, tree, where):
    _filter(name, messy, ["o_orderkey", "priority", "status", "price"], tree, MESSY_SQL, where)


def _plain(name, tree, where):
    _filter(name, "orders", ["o_orderkey", "o_custkey", "o_totalprice"], tree, "orders", where)


def _events(name, tree, where):
    _filter(name, "events", ["event_id", "ts"], tree, "events", where)


# Text equality and lists.
_orders("f_text_ci_equals", c("status", "equals", value=" F "), "lower(trim(status)) = 'f'")
_orders("f_text_cs_equals", c("status", "equals", value="  f ", caseSensitive=True), "status = '  f '")
_orders("f_equals_null", c("priority", "equals", value=None), "priority IS NULL")
_orders("f_not_equals_null", c("priority", "not_equals", value="1-urgent"),
        "lower(trim(priority)) <> '1-urgent' OR priority IS NULL")
_orders("f_not_equals_missing", c("priority", "not_equals", value=None), "priority IS NOT NULL")
_orders("f_in", c("priority", "in", values=["1-urgent", " 2-HIGH"]), "lower(trim(priority)) IN ('1-urgent', '2-high')")
_orders("f_not_in_null", c("priority", "not_in", values=["1-urgent", "2-high"]),
        "lower(trim(priority)) NOT IN ('1-urgent', '2-high') OR priority IS NULL")
_orders("f_not_in_with_null", c("priority", "not_in", values=["1-urgent", None]),
        "lower(trim(priority)) NOT IN ('1-urgent', NULL) OR priority IS NULL")
_plain("f_in_numbers", c("o_custkey", "in", values=[8, "21", "1.044,00"]), "o_custkey IN (8, 21, 1044)")

# Text inside text.
_filter("f_contains", "part", ["p_partkey", "p_name"], c("p_name", "contains", value="RING"), "part",
        "contains(lower(p_name), 'ring')")
_filter("f_contains_case", "customer", ["c_custkey", "c_name"], c("c_name", "contains", value="Customer#0", caseSensitive=True),
        "customer", "contains(c_name, 'Customer#0')")
_filter("f_contains_number", "customer", ["c_custkey", "c_acctbal"], c("c_acctbal", "contains", value="99."),
        "customer", "contains(CAST(c_acctbal AS VARCHAR), '99.')")
_filter("f_contains_date", "events", ["event_id", "ts"], c("ts", "contains", value=" 12:"), "events",
        "contains(CAST(ts AS VARCHAR), ' 12:')")
_orders("f_not_contains_null", c("priority", "not_contains", value="HIGH"),
        "priority IS NULL OR NOT contains(lower(priority), 'high')")
_filter("f_starts", "part", ["p_partkey", "p_name"], c("p_name", "starts_with", value="Small"), "part",
        "starts_with(lower(p_name), 'small')")
_filter("f_ends", "part", ["p_partkey", "p_type"], c("p_type", "ends_with", value="ard"), "part",
        "ends_with(lower(p_type), 'ard')")
_filter("f_wildcard_literal", "documents", ["doc_id", "n_chars"], c("text", "contains", value="%"), "documents",
        "contains(text, '%')")

# Numbers.
_plain("f_gt", c("o_totalprice", "greater_than", value=250000.5), "o_totalprice > 250000.5")
_plain("f_ge", c("o_totalprice", "greater_or_equal", value="250000.5"), "o_totalprice >= 250000.5")
_plain("f_lt", c("o_totalprice", "less_than", value=2500), "o_totalprice < 2500")
_plain("f_le", c("o_totalprice", "less_or_equal", value=2500), "o_totalprice <= 2500")
_plain("f_gt_whole", c("o_custkey", "greater_than", value=750.5), "o_custkey > 750.5")
_plain("f_le_whole", c("o_custkey", "less_or_equal", value="750,5"), "o_custkey <= 750.5")
_plain("f_between_swapped", c("o_totalprice", "between", range=[300000, 100000]), "o_totalprice BETWEEN 100000 AND 300000")
_plain("f_br_number_literal", c("o_totalprice", "greater_than", value="R$ 400.000,00"), "o_totalprice > 400000")
_filter("f_text_order", "customer", ["c_custkey", "c_mktsegment"], c("c_mktsegment", "greater_than", value="FURNITURE"),
        "customer", "c_mktsegment > 'FURNITURE'")
_orders("f_missing_number", c("price", "less_than", value=100000), "price < 100000")

# Dates, on a column with times of day.
_events("f_date_equals", c("ts", "date_equals", value="2024-01-05"), "CAST(ts AS DATE) = DATE '2024-01-05'")
_events("f_date_before", c("ts", "date_before", value="2024/01/05 10:30"), "ts < TIMESTAMP '2024-01-05 10:30:00'")
_events("f_date_after", c("ts", "date_after", value="2024-01-05"), "ts >= TIMESTAMP '2024-01-06 00:00:00'")
_events("f_date_between", c("ts", "date_between", range=["2024-01-03", "2024-01-05"]),
        "ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-06'")
_events("f_date_malformed", c("ts", "date_equals", value="05/01/2024"), "false")

# Empty cells and yes/no.
_orders("f_empty", c("priority", "is_empty"), "priority IS NULL OR trim(priority) = ''")
_orders("f_not_empty", c("priority", "is_not_empty"), "trim(priority) <> ''")


def _flags(spark, folder):
    return table(spark, folder, "labels").select("doc_id", (F.col("quality") == 1).alias("good"))


_FLAGS = "(SELECT doc_id, quality = 1 AS good FROM labels) AS flags"
_filter("f_is_true", _flags, ["doc_id"], c("good", "is_true"), _FLAGS, "good")
_filter("f_is_false", _flags, ["doc_id"], c("good", "is_false"), _FLAGS, "NOT good")
_filter("f_boolean_text", _flags, ["doc_id"], c("good", "equals", value="Sim"), _FLAGS, "good = true")

# Trees.
_orders(
    "f_nested_or_and",
    group(
        group(c("status", "equals", value="f"), c("price", "greater_than", value=300000)),
        group(c("priority", "equals", value="2-high"), c("price", "less_than", value=100000)),
        logic="OR",
    ),
    "(lower(trim(status)) = 'f' AND price > 300000) OR (lower(trim(priority)) = '2-high' AND price < 100000)",
)
_orders(
    "f_negate_null",
    group(c("priority", "contains", value="high"), c("price", "greater_than", value=200000), logic="OR", negate=True),
    "NOT (contains(lower(priority), 'high') OR price > 200000)",
)
_orders("f_empty_group", group(negate=True), "true")
_orders(
    "f_pruned",
    filters.prune(group(c("status", "equals", value=""), group(c("price", "between", range=[1, None])), c("status", "equals", value="o"))),
    "lower(trim(status)) = 'o'",
)


# Whole numbers beyond what a double holds exactly.
def _large_keys(spark, folder):
    return table(spark, folder, "orders").select((F.col("o_orderkey") + F.lit(2**53)).alias("k"), "o_orderkey")


_KEYS_SQL = f"(SELECT o_orderkey + {2**53} AS k, o_orderkey FROM orders) AS large"
_filter("f_bigint_equals", _large_keys, ["k", "o_orderkey"], c("k", "equals", value=2**53 + 7), _KEYS_SQL, f"k = {2**53 + 7}")
_filter("f_bigint_in", _large_keys, ["k", "o_orderkey"], c("k", "in", values=[2**53 + 1, str(2**53 + 5), 2**70]), _KEYS_SQL, f"k IN ({2**53 + 1}, {2**53 + 5})")
_filter("f_bigint_between", _large_keys, ["k", "o_orderkey"], c("k", "between", range=[str(2**53 + 9), 2**53 + 3]), _KEYS_SQL, f"k BETWEEN {2**53 + 3} AND {2**53 + 9}")


def _strict(spark, folder):
    """Each operator asked of each column type, refused or applied: one row per pair, with the rows it leaves."""
    source = table(spark, folder, "orders").select("o_orderstatus", "o_totalprice", "o_orderdate")
    asked = [
        (name, op, {"value": "2000-01-01" if name == "o_orderdate" else "5"})
        for name in source.columns for op in ("equals", "contains", "greater_than", "date_after", "is_true")
    ]
    rows = []
    for name, op, more in asked:
        told = [F.lit(name).alias("name"), F.lit(op).alias("op")]
        try:
            recipes.run(source, recipe(keep(c(name, op, **more))), strict_types=True)
            left = F.count_if(filters.predicate(c(name, op, **more), schema_of(source), strict_types=True))
            rows.append(F.struct(*told, F.lit(True).alias("ok"), left.alias("n")))
        except RecipeError:
            rows.append(F.struct(*told, F.lit(False).alias("ok"), F.lit(None).cast("long").alias("n")))
    # All predicates are counted in one scan.
    return source.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


register("f_strict_types", _strict, """SELECT name, op, ok, CASE WHEN ok THEN (SELECT CASE name || op
        WHEN 'o_orderstatusequals' THEN count(*) FILTER (lower(o_orderstatus) = '5') WHEN 'o_orderstatuscontains' THEN count(*) FILTER (o_orderstatus LIKE '%5%')
        WHEN 'o_totalpriceequals' THEN count(*) FILTER (o_totalprice = 5) WHEN 'o_totalpricegreater_than' THEN count(*) FILTER (o_totalprice > 5)
        ELSE count(*) FILTER (o_orderdate >= TIMESTAMP '2000-01-02') END FROM orders) END AS n FROM (VALUES
    ('o_orderstatus', 'equals', true), ('o_orderstatus', 'contains', true), ('o_orderstatus', 'greater_than', false), ('o_orderstatus', 'date_after', false), ('o_orderstatus', 'is_true', false),
    ('o_totalprice', 'equals', true), ('o_totalprice', 'contains', false), ('o_totalprice', 'greater_than', true), ('o_totalprice', 'date_after', false), ('o_totalprice', 'is_true', false),
    ('o_orderdate', 'equals', false), ('o_orderdate', 'contains', false), ('o_orderdate', 'greater_than', false), ('o_orderdate', 'date_after', true), ('o_orderdate', 'is_true', false)) AS t(name, op, ok)""")


def _nested(levels: int) -> dict:
    tree = c("o_totalprice", "greater_than", value=1000)
    for _ in range(levels):
        tree = group(tree)
    return tree


def _refused(spark, folder):
    """Recipes at and past their limits: refused, or applied with the rows they leave."""
    source = table(spark, folder, "orders")
    price = c("o_totalprice", "greater_than", value=200000)
    status = lambda op, **more: recipe(keep(c("o_orderstatus", op, **more)))
    asked = {
        "deep": recipe(keep(_nested(filters.MAX_DEPTH - 1))), "too deep": recipe(keep(_nested(filters.MAX_DEPTH))),
        "many": recipe(keep(group(*[price] * (filters.MAX_NODES - 1)))), "too many": recipe(keep(group(*[price] * filters.MAX_NODES))),
        "long list": status("in", values=["F"] + ["x"] * (filters.MAX_LIST - 1)), "too long list": status("in", values=["F"] * (filters.MAX_LIST + 1)),
        "no list": status("in", values=[]), "long text": status("not_equals", value="x" * filters.MAX_TEXT), "too long text": status("not_equals", value="x" * (filters.MAX_TEXT + 1)),
        "no value": status("equals"), "one end": recipe(keep(c("o_totalprice", "between", range=[1]))), "both ends": recipe(keep(c("o_totalprice", "between", range=[100000, 50000]))),
        "unknown operator": status("resembles", value="F"), "unknown column": recipe(keep(c("missing", "equals", value=1))), "no column": recipe(keep(c("", "equals", value=1))),
        "odd logic": recipe({"kind": "filter", "filter": group(price, logic="XOR")}), "bare condition": recipe({"kind": "filter", "filter": price}),
        "nothing": recipe({"kind": "filter", "filter": group()}), "unknown step": recipe({"kind": "explode"}), "odd value": status("equals", value={"a": 1}),
    }
    rows = []
    for name, wanted in asked.items():
        try:
            frame = recipes.run(source, wanted)
            left = F.count_if(F.coalesce(filters.predicate(wanted["steps"][0]["filter"], frame.schema), F.lit(False)))
            rows.append(F.struct(F.lit(name).alias("name"), F.lit(True).alias("ok"), left.alias("n")))
        except RecipeError:
            rows.append(F.struct(F.lit(name).alias("name"), F.lit(False).alias("ok"), F.lit(None).cast("long").alias("n")))
    return source.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


register("f_refused", _refused, """SELECT name, test IS NOT NULL AS ok, CASE test WHEN 'price' THEN (SELECT count(*) FROM orders WHERE o_totalprice > 200000)
    WHEN 'low' THEN (SELECT count(*) FROM orders WHERE o_totalprice > 1000) WHEN 'F' THEN (SELECT count(*) FROM orders WHERE o_orderstatus = 'F')
    WHEN 'span' THEN (SELECT count(*) FROM orders WHERE o_totalprice BETWEEN 50000 AND 100000) WHEN 'all' THEN (SELECT count(*) FROM orders) END AS n
    FROM (VALUES ('deep', 'low'), ('too deep', NULL), ('many', 'price'), ('too many', NULL), ('long list', 'F'), ('too long list', NULL), ('no list', NULL),
    ('long text', 'all'), ('too long text', NULL), ('no value', NULL), ('one end', NULL), ('both ends', 'span'), ('unknown operator', NULL), ('unknown column', NULL),
    ('no column', NULL), ('odd logic', NULL), ('bare condition', NULL), ('nothing', 'all'), ('unknown step', NULL), ('odd value', NULL)) AS t(name, test)""")
