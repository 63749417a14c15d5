"""Queries for metrics, pages, type inference, profiles, exports, sources, history and fleets."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog.registry import (
    MESSY_SQL, condition as c, group, keep, messy, recipe, register, spark_money, table,
)
from tidyloom.operators import access, fleet, history, metrics, profile
from tidyloom.operators.infer import coerce, infer, infer_files, normalize_missing, restored, stored
from tidyloom.plans import recipe as recipes
from tidyloom.plans.ingest import ingest
from tidyloom.session import shared_folder, written
from tidyloom.sinks import export
from tidyloom.sources import admission, delimited, records
from tidyloom.sources.headers import normalize_headers
from tidyloom.streaming import reapply as streaming

HIGH = keep(c("o_totalprice", "greater_than", value=250000))


def _scratch(spark) -> str:
    """A new folder in the place all executors share."""
    return f"{shared_folder(spark)}/tidyloom-{uuid.uuid4()}"


# --- metrics ---------------------------------------------------------------

def _large_sum(spark, folder):
    """Sums past 64 bits, beside a metric that cannot be computed."""
    rec = recipe(metrics=[{"id": "s", "operation": "sum", "column": "large"}, {"id": "bad", "operation": "sum", "column": "l_returnflag"}, {"id": "n", "operation": "count"}])
    lines = table(spark, folder, "lineitem").select((F.col("l_orderkey") * F.lit(10**12)).alias("large"), "l_returnflag")
    return metrics.compute(recipes.run(lines, rec), rec["metrics"]).select("id", "value", F.col("error").isNotNull().alias("refused"))


def _measured(df, rec, **options):
    rows = metrics.compute(recipes.run(df, rec), rec["metrics"], **options)
    return rows.select("id", F.round("value", 2).alias("value"))


def _rows(*pairs: tuple[str, str], source: str) -> str:
    """SQL for one row per metric from one aggregate."""
    inner = ", ".join(f"CAST({sql} AS DOUBLE) AS {name}" for name, sql in pairs)
    return " UNION ALL ".join(
        f"SELECT '{name}' AS id, round({name}, 2) AS value FROM (SELECT {inner} FROM {source})" for name, _ in pairs
    )


ALL_METRICS = [
    {"id": "n", "operation": "count"}, {"id": "d", "operation": "count_distinct", "column": "l_suppkey"},
    {"id": "e", "operation": "count_empty", "column": "l_returnflag"},
    {"id": "s", "operation": "sum", "column": "l_quantity"}, {"id": "a", "operation": "avg", "column": "l_extendedprice"},
    {"id": "lo", "operation": "min", "column": "l_discount"}, {"id": "hi", "operation": "max", "column": "l_extendedprice"},
    {"id": "m", "operation": "median", "column": "l_extendedprice"}, {"id": "p", "operation": "percentage"},
]
_ALL_SQL = _rows(
    ("n", "count(*)"), ("d", "count(DISTINCT l_suppkey)"),
    ("e", "sum(CASE WHEN l_returnflag IS NULL OR trim(l_returnflag) = '' THEN 1 ELSE 0 END)"),
    ("s", "sum(l_quantity)"), ("a", "avg(l_extendedprice)"), ("lo", "min(l_discount)"), ("hi", "max(l_extendedprice)"),
    ("m", "median(l_extendedprice)"), ("p", "count(*) * 100.0 / (SELECT count(*) FROM lineitem)"),
    source="lineitem WHERE l_quantity > 25",
)
_OVER_25 = keep(c("l_quantity", "greater_than", value=25))
register("m_all", lambda spark, folder: _measured(table(spark, folder, "lineitem"), recipe(_OVER_25, metrics=ALL_METRICS)), _ALL_SQL)
# The way taken beyond a million rows, forced here.
register("m_median_spans", lambda spark, folder: _measured(
    table(spark, folder, "lineitem"), recipe(_OVER_25, metrics=ALL_METRICS[7:8])),
    _rows(("m", "median(l_extendedprice)"), source="lineitem WHERE l_quantity > 25"))
register("m_median", lambda spark, folder: _measured(
    table(spark, folder, "orders"), recipe(metrics=[{"id": "m", "operation": "median", "column": "o_totalprice"}])),
    _rows(("m", "median(o_totalprice)"), source="orders"))
register("m_percentage", lambda spark, folder: _measured(
    table(spark, folder, "orders"), recipe(HIGH, metrics=[{"id": "p", "operation": "percentage"}])),
    _rows(("p", "count(*) * 100.0 / (SELECT count(*) FROM orders)"), source="orders WHERE o_totalprice > 250000"))
_NOTHING = keep(c("o_totalprice", "less_than", value=0))
register("m_empty_result", lambda spark, folder: _measured(table(spark, folder, "orders"), recipe(_NOTHING, metrics=[
    {"id": "n", "operation": "count"}, {"id": "e", "operation": "count_empty", "column": "o_orderpriority"},
    {"id": "s", "operation": "sum", "column": "o_totalprice"}, {"id": "m", "operation": "median", "column": "o_totalprice"}])),
    _rows(("n", "count(*)"), ("e", "sum(CASE WHEN o_orderpriority IS NULL THEN 1 ELSE 0 END)"), ("s", "sum(o_totalprice)"),
          ("m", "median(o_totalprice)"), source="orders WHERE o_totalprice < 0"))
register("m_missing_cells", lambda spark, folder: _measured(messy(spark, folder), recipe(metrics=[
    {"id": "e", "operation": "count_empty", "column": "priority"}, {"id": "g", "operation": "count_empty", "column": "price"},
    {"id": "d", "operation": "count_distinct", "column": "priority"}])),
    _rows(("e", "sum(CASE WHEN priority IS NULL OR trim(priority) = '' THEN 1 ELSE 0 END)"),
          ("g", "sum(CASE WHEN price IS NULL THEN 1 ELSE 0 END)"), ("d", "count(DISTINCT priority)"), source=MESSY_SQL))


def _labelled(spark, folder):
    wanted = [
        {"id": "n", "operation": "count"}, {"id": "bad", "operation": "avg", "column": "o_orderstatus"},
        {"id": "gone", "operation": "sum", "column": "nope"}, {"id": "s", "operation": "sum", "column": "o_custkey", "label": "keys", "format": "integer"},
    ]
    rows = metrics.compute(recipes.run(table(spark, folder, "orders"), recipe()), wanted)
    return rows.select("id", "label", "operation", "column", "value", "format", F.col("error").isNotNull().alias("failed"))


register("m_errors_apart", _labelled, """
    SELECT 'n' AS id, 'Contagem de registros' AS label, 'count' AS operation, NULL::VARCHAR AS "column", count(*)::DOUBLE AS value, NULL::VARCHAR AS format, false AS failed FROM orders
    UNION ALL SELECT 'bad', 'Media de o_orderstatus', 'avg', 'o_orderstatus', NULL, NULL, count(*) < 0 OR true FROM orders
    UNION ALL SELECT 'gone', 'Soma de nope', 'sum', 'nope', NULL, NULL, count(*) < 0 OR true FROM orders
    UNION ALL SELECT 's', 'keys', 'sum', 'o_custkey', sum(o_custkey)::DOUBLE, 'integer', false FROM orders""")


def _suggested(spark, folder):
    df = table(spark, folder, "orders")
    frame = recipes.run(df, recipe())
    rows = metrics.compute(frame, metrics.suggest(frame.schema))
    return rows.select("id", "label", F.round("value", 2).alias("value"))


register("p_suggested_metrics", _suggested, """
    SELECT 'count' AS id, 'Registros no resultado' AS label, count(*)::DOUBLE AS value FROM orders
    UNION ALL SELECT 'sum', 'Soma de o_totalprice', round(sum(o_totalprice), 2) FROM orders
    UNION ALL SELECT 'avg', 'Media de o_totalprice', round(avg(o_totalprice), 2) FROM orders""")


# --- pages, search, values -------------------------------------------------

def _page(name, number, size, **options):
    def query(spark, folder):
        by_balance = {"kind": "sort", "by": [{"column": "c_acctbal", "direction": "asc"}]}
        frame = recipes.run(table(spark, folder, "customer"), recipe(by_balance), order_by=["c_custkey"])
        return access.page(frame, number, size, **options)

    register(name, query, f"SELECT * FROM customer ORDER BY c_acctbal, c_custkey LIMIT {size} OFFSET {(number - 1) * size}")


_page("r_page_2", 2, 100)
_page("r_page_deep", 9, 150)


def _deep_ties(spark, folder):
    """Three pages far into lines ordered by a column with fifty values; equal keys are put in order by the other columns."""
    by_quantity = {"kind": "sort", "by": [{"column": "l_quantity", "direction": "desc"}]}
    frame = recipes.run(table(spark, folder, "lineitem"), recipe(by_quantity), order_by=["l_quantity"])
    pages = [access.page(frame, n, 500) for n in (11, 12, 13)]
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


register("r_page_deep_ties", _deep_ties, """SELECT * FROM lineitem ORDER BY l_quantity DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber,
    l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate LIMIT 1500 OFFSET 5000""")
register("r_page_file_order", lambda spark, folder: access.page(recipes.run(table(spark, folder, "events"), recipe(), ordered=True), 3, 250),
         "SELECT * FROM events ORDER BY event_id LIMIT 250 OFFSET 500")


def _search(name, text, where, **options):
    def query(spark, folder):
        return access.search(recipes.run(table(spark, folder, "customer"), recipe()), text, **options).visible()

    haystack = "lower(concat_ws(' ', CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR), CAST(c_acctbal AS VARCHAR), c_mktsegment))"
    register(name, query, f"SELECT * FROM customer WHERE {where.format(h=haystack)}")


_search("r_search", "8 machin", "contains({h}, '8 machin')")
_search("r_search_wildcards", "#%9_1 1", "{h} LIKE '%#%9_1 1%'", wildcards=True)
register("r_search_literal", lambda spark, folder: access.search(
    recipes.run(table(spark, folder, "documents"), recipe()), "%").visible().select("doc_id", "source"),
    "SELECT doc_id, source FROM documents WHERE contains(text, '%')")
register("r_total_rows", lambda spark, folder: access.total_rows(access.search(recipes.run(table(spark, folder, "customer"), recipe()), "AUTO")),
         "SELECT count(*) AS total_rows FROM customer WHERE contains(lower(c_mktsegment), 'auto')")
_VALUES = 'SELECT CAST({col} AS VARCHAR) AS value, count(*) AS "count" FROM {table} WHERE {col} IS NOT NULL AND {where} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {limit}'
register("r_values", lambda spark, folder: access.column_values(table(spark, folder, "lineitem"), "l_quantity", limit=30),
         _VALUES.format(col="l_quantity", table="lineitem", where="true", limit=30))
register("r_values_search", lambda spark, folder: access.column_values(table(spark, folder, "customer"), "c_name", "001", limit=200),
         _VALUES.format(col="c_name", table="customer", where="contains(lower(c_name), '001')", limit=200))
register("r_wire", lambda spark, folder: access.wire_values(table(spark, folder, "events").select(
    "event_id", "ts", F.expr("CASE WHEN event_type = 'error' THEN double('NaN') ELSE value END").alias("value"))),
    "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || strftime(ts, '%f') END AS ts, "
    "CASE WHEN event_type <> 'error' THEN value END AS value FROM events")


def _preview(spark, folder):
    rec = recipe(HIGH, metrics=[{"id": "s", "operation": "sum", "column": "o_totalprice"}])
    shown = access.preview(recipes.run(table(spark, folder, "orders"), rec, order_by=["o_orderkey"]), rec["metrics"], 2, 50)
    return shown.rows.select(
        "o_orderkey", shown.metrics.select(F.round("value", 2)).scalar().alias("total"),
        shown.total_rows.scalar().alias("total_rows"), shown.input_rows.scalar().alias("input_rows"),
    )


register("r_preview", _preview, """
    SELECT o_orderkey, (SELECT round(sum(o_totalprice), 2) FROM orders WHERE o_totalprice > 250000) AS total,
        (SELECT count(*) FROM orders WHERE o_totalprice > 250000) AS total_rows, (SELECT count(*) FROM orders) AS input_rows
    FROM orders WHERE o_totalprice > 250000 ORDER BY o_orderkey LIMIT 50 OFFSET 50""")


# --- type inference --------------------------------------------------------

def _raw_orders(spark, folder):
    """Orders as a text file might bring them."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.expr(f"concat(' R$ ', {spark_money('o_totalprice')})").alias("Valor"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("Data"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'Sim' WHEN 'O' THEN ' NÃO ' ELSE 'N/A' END").alias("Fechado"),
        F.expr("CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 'Nao informado' ELSE concat('  ', o_orderpriority) END").alias("Prioridade"),
        F.lpad(F.col("o_custkey").cast("string"), 20, "0").alias("Conta"),
        F.lit("--").alias("Vazia"),
    )


_TYPED_SQL = """SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, o_totalprice AS "Valor", o_orderdate AS "Data",
    CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS "Fechado",
    CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS "Prioridade",
    lpad(CAST(o_custkey AS VARCHAR), 20, '0') AS "Conta", NULL::VARCHAR AS "Vazia" FROM orders"""
register("i_coerce_frame", lambda spark, folder: coerce(_raw_orders(spark, folder)), _TYPED_SQL)


def _round_trip(name, source, sql):
    register(name, lambda spark, folder: coerce(source(spark, folder)), sql)


_round_trip("i_br_money", lambda spark, folder: table(spark, folder, "customer").select(
    "c_custkey", F.expr(f"CASE WHEN c_acctbal < 0 THEN concat('(', {spark_money('-c_acctbal')}, ')') ELSE concat('R$ ', {spark_money('c_acctbal')}) END").alias("Saldo")),
    'SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, c_acctbal AS "Saldo" FROM customer')
_round_trip("i_us_number", lambda spark, folder: table(spark, folder, "customer").select(
    F.col("c_custkey").cast("string").alias("c_custkey"), F.expr("format_number(c_acctbal, 2)").alias("v")),
    "SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, c_acctbal AS v FROM customer")
_round_trip("i_date_time", lambda spark, folder: table(spark, folder, "events").select(
    "event_id", F.date_format("ts", "d/M/yyyy H:m:s").alias("quando")),
    "SELECT CAST(event_id AS DOUBLE) AS event_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS quando FROM events")
_round_trip("i_date_iso", lambda spark, folder: table(spark, folder, "events").select(
    "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("quando")),
    "SELECT CAST(event_id AS DOUBLE) AS event_id, CAST(date_trunc('second', ts) AS TIMESTAMP) AS quando FROM events")
_round_trip("i_bool_tokens", lambda spark, folder: table(spark, folder, "labels").select(
    "doc_id", F.expr("CASE quality WHEN 1 THEN 'Verdadeiro' ELSE 'falso ' END").alias("bom")),
    "SELECT CAST(doc_id AS DOUBLE) AS doc_id, quality = 1 AS bom FROM labels")
_round_trip("i_bits_are_numbers", lambda spark, folder: table(spark, folder, "labels").select(
    "doc_id", F.col("quality").cast("string").alias("bom")),
    "SELECT CAST(doc_id AS DOUBLE) AS doc_id, CAST(quality AS DOUBLE) AS bom FROM labels")
_round_trip("i_identifier_text", lambda spark, folder: table(spark, folder, "orders").select(
    F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("agencia"), (F.col("o_orderkey") + F.lit(10**16)).cast("string").alias("codigo")),
    "SELECT lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS agencia, CAST(o_orderkey + 10000000000000000 AS VARCHAR) AS codigo FROM orders")
_round_trip("i_native_types", lambda spark, folder: table(spark, folder, "lineitem"),
            "SELECT " + ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in (
                "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"))
            + ", l_returnflag, l_linestatus, l_shipdate FROM lineitem")
register("i_null_tokens", lambda spark, folder: table(spark, folder, "documents").select(
    "doc_id", normalize_missing(F.expr("CASE lang WHEN 'en' THEN ' #N/D ' WHEN 'fr' THEN 'não informado' ELSE concat(' ', source, ' ') END")).alias("source")),
    "SELECT doc_id, CASE WHEN lang NOT IN ('en', 'fr') THEN source END AS source FROM documents")


def _inferred_types(spark, folder):
    raw = _raw_orders(spark, folder)
    kinds = infer(raw)
    typed = coerce(raw, kinds)
    counts = typed.agg(*(F.count(f"`{n}`").alias(n) for n in kinds))
    rows = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(s.type).alias("type"), F.col(n).alias("filled")) for n, s in kinds.items()))
    return counts.select(F.inline(rows))


register("i_types", _inferred_types, f"""
    SELECT name, type, filled FROM (
        SELECT 'o_orderkey' AS name, 'number' AS type, count(o_orderkey) AS filled FROM ({_TYPED_SQL})
        UNION ALL SELECT 'Valor', 'currency', count("Valor") FROM ({_TYPED_SQL})
        UNION ALL SELECT 'Data', 'date', count("Data") FROM ({_TYPED_SQL})
        UNION ALL SELECT 'Fechado', 'boolean', count("Fechado") FROM ({_TYPED_SQL})
        UNION ALL SELECT 'Prioridade', 'text', count("Prioridade") FROM ({_TYPED_SQL})
        UNION ALL SELECT 'Conta', 'text', count("Conta") FROM ({_TYPED_SQL})
        UNION ALL SELECT 'Vazia', 'empty', count("Vazia") FROM ({_TYPED_SQL}))""")


# --- profile ---------------------------------------------------------------

def _stat_sql(source, columns):
    parts = []
    for i, (name, kind) in enumerate(columns):
        numeric, date = kind in ("number", "currency"), kind == "date"
        n = f"CAST({name} AS DOUBLE)"
        parts.append(
            f"SELECT {i} AS position, '{name}' AS name, '{kind}' AS type, count(*) - count({name}) AS \"nullCount\", count(DISTINCT {name}) AS \"distinctCount\", "
            + (f"min({n}) AS min, max({n}) AS max, round(sum({n}), 2) AS sum, round(avg({n}), 2) AS avg, " if numeric
               else "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS sum, NULL::DOUBLE AS avg, ")
            + (f'min({name}) AS "minDate", max({name}) AS "maxDate"' if date else 'NULL::TIMESTAMP AS "minDate", NULL::TIMESTAMP AS "maxDate"')
            + f" FROM {source}"
        )
    return " UNION ALL ".join(parts)


def _rounded(stats):
    return stats.withColumns({"sum": F.round("sum", 2), "avg": F.round("avg", 2)})


_EVENT_COLUMNS = [("event_id", "number"), ("ts", "date"), ("user_id", "number"), ("event_type", "text"), ("value", "number"), ("props", "text")]
_MESSY_COLUMNS = [("o_orderkey", "number"), ("o_custkey", "number"), ("o_totalprice", "currency"), ("o_orderdate", "date"), ("priority", "text"), ("status", "text"), ("price", "currency")]
register("p_columns", lambda spark, folder: _rounded(profile.column_statistics(table(spark, folder, "events"))), _stat_sql("events", _EVENT_COLUMNS))
register("p_columns_missing", lambda spark, folder: _rounded(profile.column_statistics(messy(spark, folder))), _stat_sql(MESSY_SQL, _MESSY_COLUMNS))
register("p_duplicates", lambda spark, folder: profile.row_counts(table(spark, folder, "documents").drop("doc_id")),
         'SELECT count(*) AS "rowCount", 4 AS "columnCount", count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source, n_chars FROM documents)) AS "duplicateRowCount", '
         'count(CASE WHEN text IS NULL OR lang IS NULL OR source IS NULL OR n_chars IS NULL THEN 1 END) AS "rowsWithEmptyCount" FROM documents')
register("p_rows_with_empty", lambda spark, folder: profile.row_counts(messy(spark, folder).drop("o_orderkey", "o_orderdate", "o_totalprice")),
         f'SELECT count(*) AS "rowCount", 4 AS "columnCount", count(*) - (SELECT count(*) FROM (SELECT DISTINCT o_custkey, priority, status, price FROM {MESSY_SQL})) AS "duplicateRowCount", '
         f'count(CASE WHEN priority IS NULL OR price IS NULL THEN 1 END) AS "rowsWithEmptyCount" FROM {MESSY_SQL}')


def _top_sql(source, names):
    return " UNION ALL ".join(
        f"""SELECT name, rank, value, "count" FROM (SELECT '{n}' AS name, CAST(row_number() OVER (ORDER BY count(*) DESC, {n}) AS INTEGER) AS rank,
        {n} AS value, count(*) AS "count", count(*) OVER () AS groups FROM {source} WHERE {n} IS NOT NULL GROUP BY {n}) WHERE groups <= 60 AND rank <= 15"""
        for n in names)


register("p_top_values", lambda spark, folder: profile.top_values(table(spark, folder, "documents")), _top_sql("documents", ["text", "lang", "source"]))
register("p_category_share", lambda spark, folder: profile.category_shares(profile.profile(table(spark, folder, "customer"))).select(
    "name", "value", "count", F.round("percent", 2).alias("percent")),
    "SELECT 'c_mktsegment' AS name, c_mktsegment AS value, count(*) AS \"count\", round(count(*) * 100.0 / (SELECT count(*) FROM customer), 2) AS percent FROM customer GROUP BY c_mktsegment")
register("p_primary_measure", lambda spark, folder: profile.primary_measure(profile.column_statistics(table(spark, folder, "lineitem"))).select(
    "name", "type", F.round("sum", 2).alias("sum")),
    "SELECT 'l_extendedprice' AS name, 'currency' AS type, round(sum(l_extendedprice), 2) AS sum FROM lineitem")
register("p_quality", lambda spark, folder: profile.quality(profile.profile(messy(spark, folder))).select(
    "name", F.round("nullPercent", 2).alias("nullPercent"), "duplicatePercent", F.round("emptyPercent", 2).alias("emptyPercent")),
    " UNION ALL ".join(
        f"""SELECT '{n}' AS name, round((count(*) - count({n})) * 100.0 / count(*), 2) AS "nullPercent", 0.0::DOUBLE AS "duplicatePercent",
        round(count(CASE WHEN priority IS NULL OR price IS NULL THEN 1 END) * 100.0 / count(*), 2) AS "emptyPercent" FROM {MESSY_SQL}"""
        for n, _ in _MESSY_COLUMNS))


def _profiled(name):
    def query(spark, folder):
        whole = profile.profile(table(spark, folder, name))
        tops = F.coalesce(F.to_json(F.transform("topValues", lambda t: F.array(t["value"], t["count"].cast("string")))), F.lit("[]"))
        return whole.select("position", "name", "type", "nullCount", "distinctCount", "min", "max", F.round("sum", 2).alias("sum"),
                            tops.alias("tops"), "rowCount", "columnCount", "duplicateRowCount", "rowsWithEmptyCount")

    return query


def _profile_sql(source, columns):
    """Every statistic and all top values of every column."""
    def tops(name, kind):
        if kind == "number":
            return "'[]'"
        ranked = f"""(SELECT {name} AS v, count(*) AS n, count(*) OVER () AS groups, row_number() OVER (ORDER BY count(*) DESC, {name}) AS r
            FROM {source} WHERE {name} IS NOT NULL GROUP BY {name})"""
        return f"""(SELECT coalesce('[' || string_agg(CAST(to_json([v, CAST(n AS VARCHAR)]) AS VARCHAR), ',' ORDER BY r) || ']', '[]')
            FROM {ranked} WHERE groups <= 60 AND r <= 15)"""

    return " UNION ALL ".join(
        f"""SELECT {i} AS position, '{n}' AS name, '{k}' AS type, count(*) - count({n}) AS "nullCount", count(DISTINCT {n}) AS "distinctCount",
        {f'min({n})::DOUBLE' if k == 'number' else 'NULL::DOUBLE'} AS min, {f'max({n})::DOUBLE' if k == 'number' else 'NULL::DOUBLE'} AS max,
        {f'round(sum({n})::DOUBLE, 2)' if k == 'number' else 'NULL::DOUBLE'} AS sum, {tops(n, k)} AS tops,
        count(*) AS "rowCount", {len(columns)} AS "columnCount", 0::BIGINT AS "duplicateRowCount", 0::BIGINT AS "rowsWithEmptyCount" FROM {source}"""
        for i, (n, k) in enumerate(columns))


_CUSTOMER = [("c_custkey", "number"), ("c_name", "text"), ("c_nationkey", "number"), ("c_acctbal", "number"), ("c_mktsegment", "text")]
_DOCUMENTS = [("doc_id", "number"), ("text", "text"), ("lang", "text"), ("source", "text"), ("n_chars", "number")]
register("p_profile", _profiled("customer"), _profile_sql("customer", _CUSTOMER))
register("p_profile_documents", _profiled("documents"), _profile_sql("documents", _DOCUMENTS))


# --- export ----------------------------------------------------------------

def _comma(x):
    return f"replace(format('{{:.2f}}', {x}), '.', ',')"


register("w_csv_projection", lambda spark, folder: export.formatted(recipes.run(table(spark, folder, "events"), recipe(), order_by=["event_id"]), ["event_id", "ts", "event_type", "value"]),
         f"SELECT CAST(event_id AS VARCHAR) AS event_id, strftime(ts, '%d/%m/%Y') AS ts, event_type, {_comma('value')} AS value FROM events")
register("w_csv_booleans", lambda spark, folder: export.formatted(recipes.run(
    table(spark, folder, "labels").select("doc_id", (F.col("toxic") == 1).alias("toxic")), recipe())),
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN toxic = 1 THEN 'Sim' ELSE 'Nao' END AS toxic FROM labels")
_SIGNED = "CASE lang WHEN 'en' THEN '=' WHEN 'fr' THEN '@' WHEN 'de' THEN '-' ELSE '' END"
register("w_formula_guard", lambda spark, folder: table(spark, folder, "documents").select(
    "doc_id", export.neutralize(F.expr(f"concat({_SIGNED}, text)")).alias("text")),
    f"SELECT doc_id, CASE WHEN substr(t, 1, 1) IN ('=', '+', '-', '@', chr(9), chr(13)) THEN '''' || t ELSE t END AS text FROM (SELECT doc_id, {_SIGNED} || text AS t FROM documents)")


def _summary(spark, folder):
    rec = recipe(HIGH, metrics=[{"id": "s", "operation": "sum", "column": "o_totalprice", "format": "currency"}, {"id": "n", "operation": "count"}, {"id": "bad", "operation": "sum", "column": "o_orderstatus"}])
    frame = recipes.run(table(spark, folder, "orders"), rec)
    return export.summary(frame, metrics.compute(frame, rec["metrics"]), "=orders", "01/01/2026 10:00").select("position", "label", "text", F.round("value", 2).alias("value"))


_KEPT = "FROM orders WHERE o_totalprice > 250000"
register("w_summary", _summary, f"""
    SELECT 0 AS position, 'Planilha de origem' AS label, '''=orders' AS text, NULL::DOUBLE AS value
    UNION ALL SELECT 1, 'Gerado em', '01/01/2026 10:00', NULL
    UNION ALL SELECT 2, 'Registros exportados', CAST(count(*) AS VARCHAR), count(*)::DOUBLE {_KEPT}
    UNION ALL SELECT 3, 'Soma de o_totalprice', 'R$ ' || {_comma('sum(o_totalprice)')}, round(sum(o_totalprice), 2) {_KEPT}
    UNION ALL SELECT 4, 'Contagem de registros', {_comma('count(*)::DOUBLE')}, count(*)::DOUBLE {_KEPT}""")


_MANY = ["l_quantity", "l_discount", "l_returnflag", "l_shipdate", "l_partkey", "l_linenumber"]
register("m_distinct_many", lambda spark, folder: _measured(table(spark, folder, "lineitem"), recipe(
    keep(c("l_quantity", "less_than", value=20)), metrics=[{"id": n, "operation": "count_distinct", "column": n} for n in _MANY])),
    " UNION ALL ".join(f"SELECT '{n}' AS id, CAST(count(DISTINCT {n}) AS DOUBLE) AS value FROM lineitem WHERE l_quantity < 20" for n in _MANY))


register("m_sum_large", _large_sum, """SELECT 's' AS id, CAST(sum(CAST(l_orderkey AS HUGEINT) * 1000000000000) AS DOUBLE) AS value, false AS refused FROM lineitem
    UNION ALL SELECT 'bad', NULL, true UNION ALL SELECT 'n', CAST(count(*) AS DOUBLE), false FROM lineitem""")


# --- sources ---------------------------------------------------------------

def _csv_round_trip(spark, folder):
    """Export, then admit, sniff, read and type the files again."""
    path = _scratch(spark)
    frame = recipes.run(table(spark, folder, "orders"), recipe(), order_by=["o_orderkey"])
    export.write_delimited(frame, path, rows_per_file=4000)
    (_, raw), = delimited.scan_folder(spark, path)
    return coerce(raw)


register("s_csv_round_trip", _csv_round_trip, """SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey,
    o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders""")


def _document_files(spark, folder):
    """Documents as files held in a table."""
    content = F.encode(F.concat(F.lit("título;"), F.regexp_replace("lang", "^", "col_"), F.lit("\n"), "text"), "UTF-8")
    return table(spark, folder, "documents").select(
        F.concat(F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.expr("CASE WHEN source = 'src1' THEN '.txt' ELSE '.csv' END")).alias("path"),
        F.octet_length(content).cast("long").alias("length"), content.alias("content"),
    )


register("s_admission", lambda spark, folder: admission.admit_contents(_document_files(spark, folder)).select("path", "kind", "encoding", "header", "ok", "reason"),
         """SELECT lpad(CAST(doc_id AS VARCHAR), 9, '0') || CASE WHEN source = 'src1' THEN '.txt' ELSE '.csv' END AS path,
         CASE WHEN source <> 'src1' THEN 'csv' END AS kind, CASE WHEN source <> 'src1' THEN 'UTF-8' END AS encoding,
         CASE WHEN source <> 'src1' THEN 'título;col_' || lang END AS header, source <> 'src1' AS ok,
         CASE WHEN source = 'src1' THEN 'extension is not supported' END AS reason FROM documents""")


def _text_files(spark, folder):
    content = F.encode("text", "UTF-8")
    return table(spark, folder, "documents").select(
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.octet_length(content).cast("long").alias("length"), content.alias("content"))


register("s_fingerprint", lambda spark, folder: admission.fingerprints(_text_files(spark, folder)),
         "SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, CAST(octet_length(encode(text)) AS BIGINT) AS length, sha256(text) AS sha256 FROM documents")
register("s_repeated_files", lambda spark, folder: admission.repeated_files(_text_files(spark, folder)).select("path", "first_path"),
         """SELECT path, first_path FROM (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path,
         min(lpad(CAST(doc_id AS VARCHAR), 12, '0')) OVER (PARTITION BY text) AS first_path FROM documents) WHERE path <> first_path""")


def _separated(spark, folder):
    """Orders as files of one line each after a header, a file per order, with the sign its status asks for."""
    sign = F.expr("CASE o_orderstatus WHEN 'F' THEN ';' WHEN 'O' THEN '|' ELSE chr(9) END")
    line = F.concat_ws("\n", F.concat_ws("", F.lit("id"), sign, F.lit("valor")),
                       F.concat_ws("", "o_orderkey", sign, F.expr("replace(cast(o_totalprice AS STRING), '.', ',')")), F.lit(""))
    content = F.encode(line, "UTF-8")
    files = table(spark, folder, "orders").select(
        F.concat(F.col("o_orderkey").cast("string"), F.lit(".csv")).alias("path"), F.octet_length(content).cast("long").alias("length"), content.alias("content"))
    return admission.admit_contents(files).select("path", "separator", "header", "ok")


_SIGN = "CASE o_orderstatus WHEN 'F' THEN ';' WHEN 'O' THEN '|' ELSE chr(9) END"
register("s_separator", _separated, f"""SELECT o_orderkey || '.csv' AS path, {_SIGN} AS separator, 'id' || {_SIGN} || 'valor' AS header, true AS ok FROM orders""")


def _late(spark, folder):
    """Documents whose last byte alone tells the encoding, far behind any prefix."""
    odd = F.expr("CASE doc_id % 3 WHEN 0 THEN X'E7' WHEN 1 THEN X'C3A7' ELSE X'81' END")
    content = F.concat(F.encode(F.concat(F.lit("a;b\n"), F.regexp_replace("text", "[^ -~\n]", "x"), F.lit("\n;")), "UTF-8"), odd)
    files = table(spark, folder, "documents").select(
        F.concat(F.col("doc_id").cast("string"), F.lit(".csv")).alias("path"), F.octet_length(content).cast("long").alias("length"), content.alias("content"))
    return admission.admit_contents(files).select("path", "encoding", "ok")


register("s_encoding_late", _late, """SELECT doc_id || '.csv' AS path,
    CASE doc_id % 3 WHEN 0 THEN 'windows-1252' WHEN 1 THEN 'UTF-8' ELSE 'ISO-8859-1' END AS encoding, true AS ok FROM documents""")


# Spaces at the ends of a cell are part of it. Not all cells are quoted: empty texts are, missing ones are not, which tells them apart.
_CELLS_AS_THEY_ARE = {"header": "true", "sep": ";", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _large_file(spark, folder):
    """All documents in text files, written by range, admitted and read as a folder."""
    path = _scratch(spark)
    docs = table(spark, folder, "documents").select("doc_id", "lang", F.regexp_replace("text", "[\r\n]", " ").alias("text"))
    docs.repartitionByRange("doc_id").write.options(**_CELLS_AS_THEY_ARE).csv(path)
    (_, raw), = delimited.scan_folder(spark, path)
    return raw.select("doc_id", "lang", F.length("text").cast("long").alias("n"))


register("s_large_file", _large_file, "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, length(text)::BIGINT AS n FROM documents")


def _headers(spark, folder):
    """Part names as the raw headers of a file; blanks and repeats get names of their own."""
    names = [r[0] for r in table(spark, folder, "region").orderBy("r_regionkey").select("r_name").collect()]
    raw = [f" {names[0]} ", "", names[0], None, "__UNNAMED__4", names[1]]
    wide = table(spark, folder, "nation").select(*(F.concat_ws(":", F.lit(i), "n_name").alias(f"c{i}") for i in range(len(raw))))
    return wide.toDF(*normalize_headers(raw)).select(
        "Coluna 2", "Coluna 4", "Coluna 5", F.col(f"{names[0]} (2)").alias("again"), F.col(names[0]).alias("first"), F.col(names[1]).alias("other"))


register("s_headers", _headers, """SELECT '1:' || n_name AS "Coluna 2", '3:' || n_name AS "Coluna 4", '4:' || n_name AS "Coluna 5",
    '2:' || n_name AS again, '0:' || n_name AS first, '5:' || n_name AS other FROM nation""")


def _ingested(spark, folder):
    """Raw text saved as a typed dataset and read back; its types come from the file."""
    saved, _ = ingest(spark, _raw_orders(spark, folder), _scratch(spark))
    return saved


register("i_ingest_round_trip", _ingested, _TYPED_SQL)


# --- history ---------------------------------------------------------------

def _executions(spark, folder):
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("user_id"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("amount"))


def _users(spark, folder):
    """Priorities as users; the urgent one has left."""
    return table(spark, folder, "orders").where("o_orderpriority <> '1-URGENT'").groupBy(F.col("o_orderpriority").alias("id")).agg(
        F.min("o_orderstatus").alias("display_name"))


def _listed(name, owner, page):
    register(name, lambda spark, folder: history.execution_listing(_executions(spark, folder), _users(spark, folder), owner, page, 100),
             f"""SELECT o_orderkey AS id, o_orderpriority AS user_id, o_orderdate AS created_at, o_totalprice AS amount, display_name AS created_by_name
             FROM orders LEFT JOIN (SELECT o_orderpriority AS owner, min(o_orderstatus) AS display_name FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1) ON owner = o_orderpriority
             WHERE o_orderpriority = '{owner}' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100 OFFSET {(page - 1) * 100}""")


_listed("h_history_join", "2-HIGH", 2)
_listed("h_history_unknown_user", "1-URGENT", 1)
register("h_history_total", lambda spark, folder: history.listing_total(_executions(spark, folder), "user_id", "2-HIGH"),
         "SELECT count(*) AS total FROM orders WHERE o_orderpriority = '2-HIGH'")
register("h_dataset_listing", lambda spark, folder: history.listing(
    table(spark, folder, "events"), "event_type", "purchase", "ts", "event_id", 3, 100),
    "SELECT * FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id LIMIT 100 OFFSET 200")
register("h_dataset_listing_far", lambda spark, folder: history.listing(
    table(spark, folder, "lineitem"), "l_linestatus", "O", "l_shipdate", "l_orderkey", 27, 200),
    """SELECT * FROM lineitem WHERE l_linestatus = 'O' ORDER BY l_shipdate DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber,
    l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag LIMIT 200 OFFSET 5200""")


def _detail(spark, folder):
    """Busiest run of all: its lines are the metrics."""
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("execution_id"), F.col("l_partkey").alias("metric_key"), F.col("l_quantity").alias("value"))
    busiest = lines.groupBy("execution_id").count().orderBy(F.desc("count"), "execution_id").first()["execution_id"]
    runs = _executions(spark, folder)
    owner = runs.where(F.col("id") == busiest).first()["user_id"]
    return history.execution_detail(runs, lines, busiest, owner)


register("h_execution_detail", _detail, """SELECT o_orderkey AS id, o_orderpriority AS user_id, o_orderdate AS created_at, o_totalprice AS amount,
    l_partkey AS metric_key, l_quantity AS value FROM orders JOIN lineitem ON l_orderkey = o_orderkey
    WHERE o_orderkey = (SELECT l_orderkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""")
register("h_latest_version", lambda spark, folder: history.latest_versions(
    table(spark, folder, "customer").select(F.col("c_custkey").alias("recipe_id"), F.col("c_name").alias("name")),
    table(spark, folder, "orders").select(F.col("o_custkey").alias("recipe_id"), F.col("o_orderkey").cast("int").alias("version_number"), F.col("o_orderpriority").alias("definition"))),
    """SELECT c_custkey AS recipe_id, c_name AS name, version_number, definition, CAST(coalesce(version_number, 0) + 1 AS INTEGER) AS next_version_number
    FROM customer LEFT JOIN (SELECT o_custkey, CAST(max(o_orderkey) AS INTEGER) AS version_number, arg_max(o_orderpriority, o_orderkey) AS definition FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
register("h_expired", lambda spark, folder: history.expired(
    table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("expires_at"),
                                          F.expr("CASE WHEN o_orderstatus = 'F' THEN 'expired' ELSE 'ready' END").alias("status")), datetime(1996, 1, 1)),
    """SELECT o_orderkey AS id, o_orderdate AS expires_at, 'ready' AS status FROM orders
    WHERE o_orderdate <= TIMESTAMP '1996-01-01' AND o_orderstatus <> 'F' ORDER BY o_orderdate, o_orderkey LIMIT 200""")


def _logged(spark, folder):
    path = _scratch(spark)
    rec = recipe(HIGH, metrics=[{"id": "s", "operation": "sum", "column": "o_totalprice"}, {"id": "bad", "operation": "sum", "column": "x"}])
    history.logged(spark, path, rec, lambda: recipes.run(table(spark, folder, "orders"), rec), user_id="u", dataset_name="orders")
    runs = spark.read.parquet(f"{path}/executions").drop("created_at", "user_id")
    measured = spark.read.parquet(f"{path}/execution_metrics")
    return runs.join(measured, F.col("id") == F.col("execution_id"), "left").select(
        "dataset_name", "status", "input_row_count", "output_row_count", "metric_key", F.round("value", 2).alias("value"))


register("h_logged_run", _logged, """SELECT 'orders' AS dataset_name, 'succeeded' AS status, (SELECT count(*) FROM orders) AS input_row_count,
    count(*) AS output_row_count, 's' AS metric_key, round(sum(o_totalprice), 2) AS value FROM orders WHERE o_totalprice > 250000""")


def _logged_export(spark, folder):
    """A logged export in order: one pass writes the rows and counts them with the metrics."""
    path = _scratch(spark)
    wanted = ["count", "sum", "avg", "min", "max", "percentage", "count_distinct", "median"]
    rec = recipe(HIGH, {"kind": "sort", "by": [{"column": "o_totalprice", "direction": "desc"}]}, metrics=[{"id": o, "operation": o, "column": "o_totalprice"} for o in wanted])
    history.logged(
        spark, path, rec, lambda: recipes.run(table(spark, folder, "orders"), rec, order_by=["o_orderkey"]),
        watched=lambda frame, watch: export.write_delimited(frame, f"{path}/csv", ["o_orderkey"], watch=watch), dataset_name="orders")
    exported = spark.read.option("header", "true").csv(f"{path}/csv").agg(F.count(F.lit(1)))
    runs, measured = (spark.read.parquet(f"{path}/{name}") for name in ("executions", "execution_metrics"))
    return runs.join(measured, F.col("id") == F.col("execution_id")).select(
        "input_row_count", "output_row_count", exported.scalar().alias("exported"), "metric_key", F.round("value", 2).alias("value"))


_EXPORTED = "FROM orders WHERE o_totalprice > 250000"
register("h_logged_export", _logged_export, " UNION ALL ".join(
    f"""SELECT (SELECT count(*) FROM orders) AS input_row_count, (SELECT count(*) {_EXPORTED}) AS output_row_count,
    (SELECT count(*) {_EXPORTED}) AS exported, '{name}' AS metric_key, round(CAST({value} AS DOUBLE), 2) AS value {_EXPORTED}"""
    for name, value in (("count", "count(*)"), ("sum", "sum(o_totalprice)"), ("avg", "avg(o_totalprice)"), ("min", "min(o_totalprice)"),
                        ("max", "max(o_totalprice)"), ("percentage", "100.0 * count(*) / (SELECT count(*) FROM orders)"),
                        ("count_distinct", "count(DISTINCT o_totalprice)"), ("median", "median(o_totalprice)"))))


# --- many datasets ---------------------------------------------------------

def _pairs(spark, folder):
    """Customers as datasets, whose columns are the priorities they used; statuses as recipes."""
    orders = table(spark, folder, "orders")
    pairs = orders.select(F.col("o_orderstatus").alias("recipe_id"), F.col("o_custkey").alias("dataset_id")).distinct()
    wanted = orders.select(F.col("o_orderstatus").alias("recipe_id"), F.col("o_orderpriority").alias("column")).distinct()
    present = orders.select(F.col("o_custkey").alias("dataset_id"), F.col("o_orderpriority").alias("column")).distinct()
    return pairs, wanted, present


_MISSING_SQL = """SELECT p.recipe_id, p.dataset_id, w."column" FROM (SELECT DISTINCT o_orderstatus AS recipe_id, o_custkey AS dataset_id FROM orders) p
    JOIN (SELECT DISTINCT o_orderstatus AS recipe_id, o_orderpriority AS "column" FROM orders) w ON w.recipe_id = p.recipe_id
    WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = p.dataset_id AND o.o_orderpriority = w."column")"""
register("fleet_missing_columns", lambda spark, folder: fleet.missing_columns(*_pairs(spark, folder)), _MISSING_SQL)
register("fleet_compatibility", lambda spark, folder: fleet.compatibility(*_pairs(spark, folder)),
         f"""SELECT p.recipe_id, p.dataset_id, count(m."column") AS missing FROM (SELECT DISTINCT o_orderstatus AS recipe_id, o_custkey AS dataset_id FROM orders) p
         LEFT JOIN ({_MISSING_SQL}) m ON m.recipe_id = p.recipe_id AND m.dataset_id = p.dataset_id GROUP BY ALL""")


def _recipe_columns(spark, folder):
    """A stored recipe per part: sort by its name, sum of its type."""
    text = F.to_json(F.struct(
        F.lit(1).alias("version"),
        F.array(F.struct(F.lit("sort").alias("kind"), F.array(F.struct(F.col("p_name").alias("column"))).alias("by"))).alias("steps"),
        F.array(F.struct(F.lit("s").alias("id"), F.lit("sum").alias("operation"), F.col("p_type").alias("column"))).alias("metrics")))
    return fleet.recipe_columns(table(spark, folder, "part").select(F.col("p_partkey").alias("recipe_id"), text.alias("definition")))


def _deep_recipes(spark, folder):
    """A stored recipe per part with every kind of step and a filter six levels deep; some definitions are cut off."""
    leaf = '{"type":"condition","column":"', '","operator":"is_empty"}'
    tree = F.concat(F.lit(leaf[0]), "p_name", F.lit(leaf[1]))
    for level in range(5):
        extra = f'{leaf[0]}L{level}{leaf[1]},' if level % 2 else ""
        tree = F.concat(F.lit('{"type":"group","logic":"AND","children":[' + extra), tree, F.lit("]}"))
    steps = F.concat(
        F.lit('{"version":1,"steps":[{"kind":"filter","filter":'), tree,
        F.lit('},{"kind":"rename_columns","mapping":[{"from":"old","to":"new"}]},{"kind":"sort","by":[{"column":"'), "p_type",
        F.lit('","direction":"asc"}]},{"kind":"fill_empty","column":"gap","value":1},{"kind":"select_columns","columns":["a","'), "p_type",
        F.lit('"]}],"metrics":[{"id":"n","operation":"count"},{"id":"s","operation":"sum","column":"'), "p_brand", F.lit('"}]}'))
    cut = F.when(F.col("p_partkey") % 7 == 0, F.substr(steps, F.lit(1), F.lit(50))).when(F.col("p_partkey") % 11 == 0, F.lit(None)).otherwise(steps)
    return table(spark, folder, "part").select(F.col("p_partkey").alias("recipe_id"), cut.alias("definition"))


_NAMED_SQL = "(SELECT DISTINCT p_partkey AS recipe_id, unnest([p_name, 'L1', 'L3', 'old', 'gap', 'a', p_type, p_brand]) AS \"column\" FROM part)"
register("fleet_recipe_columns_deep", lambda spark, folder: fleet.recipe_columns(_deep_recipes(spark, folder)),
         f"SELECT * FROM {_NAMED_SQL} WHERE recipe_id % 7 <> 0 AND recipe_id % 11 <> 0")
register("fleet_bad_recipe", lambda spark, folder: fleet.refused_recipes(_deep_recipes(spark, folder)), """
    SELECT p_partkey AS recipe_id, CASE WHEN p_partkey % 7 = 0 THEN 'definition is not valid JSON' ELSE 'definition is missing' END AS reason
    FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 11 = 0""")


register("fleet_recipe_columns", _recipe_columns,
         'SELECT p_partkey AS recipe_id, p_name AS "column" FROM part UNION ALL SELECT p_partkey, p_type FROM part')


def _resolved(spark, folder):
    """Brands as datasets, part names as their columns; people ask for the last word or shout."""
    part = table(spark, folder, "part")
    present = part.select(F.col("p_brand").alias("dataset_id"), F.lit(0).alias("position"), F.col("p_name").alias("column")).distinct()
    word = F.substring_index("p_name", " ", -1)
    asked = part.select("p_partkey", F.col("p_size").alias("size"), F.col("p_brand").alias("dataset_id"),
                        F.when(F.col("p_type") == "PROMO", F.concat(F.lit(" "), F.upper("p_name"))).when(F.col("p_type") == "LARGE", "Nope").otherwise(word).alias("name"))
    return fleet.resolve_names(asked.drop("size"), present)


register("fleet_resolve", _resolved, """
    WITH present AS (SELECT DISTINCT p_brand AS d, p_name AS col FROM part),
    asked AS (SELECT p_partkey, p_brand AS dataset_id, CASE p_type WHEN 'PROMO' THEN ' ' || upper(p_name) WHEN 'LARGE' THEN 'Nope'
        ELSE list_last(string_split(p_name, ' ')) END AS name FROM part)
    SELECT p_partkey, dataset_id, name, coalesce(max(CASE WHEN lower(col) = lower(trim(name)) THEN col END),
        CASE WHEN count(CASE WHEN contains(lower(col), lower(trim(name))) OR contains(lower(trim(name)), lower(col)) THEN 1 END) = 1
        THEN max(CASE WHEN contains(lower(col), lower(trim(name))) OR contains(lower(trim(name)), lower(col)) THEN col END) END) AS resolved
    FROM asked LEFT JOIN present ON d = dataset_id GROUP BY p_partkey, dataset_id, name""")

GROUPED = recipe(
    {"kind": "drop_duplicates", "columns": ["o_custkey"]},
    keep(c("o_totalprice", "greater_than", value=100000)),
    metrics=[
        {"id": "n", "operation": "count"}, {"id": "s", "operation": "sum", "column": "o_totalprice"},
        {"id": "m", "operation": "median", "column": "o_totalprice"}, {"id": "p", "operation": "percentage"},
    ],
)
_FIRSTS = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {g} o_custkey ORDER BY o_orderkey) AS place FROM orders) WHERE place = 1 AND o_totalprice > 100000)"""


def _grouped(name, **options):
    def query(spark, folder):
        frame = recipes.run(table(spark, folder, "orders"), GROUPED, order_by=["o_orderkey"], group_by=["o_orderpriority"])
        rows = metrics.compute(frame, GROUPED["metrics"], **options)
        # The mean of two amounts in cents has three decimals.
        value = F.when(F.col("id") == "m", F.round("value", 3)).otherwise(F.round("value", 2))
        return rows.select("o_orderpriority", "id", value.alias("value"))

    firsts = _FIRSTS.format(g="o_orderpriority,")
    register(name, query, f"""
        WITH kept AS (SELECT o_orderpriority, count(*)::DOUBLE AS n, sum(o_totalprice) AS s, median(o_totalprice) AS m FROM {firsts} GROUP BY 1),
        whole AS (SELECT o_orderpriority, count(*) AS rows FROM orders GROUP BY 1)
        SELECT o_orderpriority, id, CASE id WHEN 'm' THEN round(value, 3) ELSE round(value, 2) END AS value FROM (
            SELECT o_orderpriority, 'n' AS id, n AS value FROM kept UNION ALL SELECT o_orderpriority, 's', s FROM kept
            UNION ALL SELECT o_orderpriority, 'm', m FROM kept UNION ALL SELECT o_orderpriority, 'p', n * 100.0 / rows FROM kept JOIN whole USING (o_orderpriority))""")


_grouped("fleet_metrics_by_group")
_grouped("fleet_median_spans")


def _files(spark, folder):
    rows = fleet.metrics_by_source(fleet.reapply(spark, GROUPED, f"{folder}/orders.parquet"), GROUPED)
    return rows.select(F.regexp_extract("source", r"(orders\.parquet)", 1).alias("source"), "id", F.round("value", 2).alias("value"))


register("fleet_reapply_files", _files, "SELECT 'orders.parquet' AS source, id, value FROM (" + _rows(
    ("n", "count(*)"), ("s", "sum(o_totalprice)"), ("m", "median(o_totalprice)"), ("p", "count(*) * 100.0 / (SELECT count(*) FROM orders)"),
    source=_FIRSTS.format(g="")) + ")")


def _stream(spark, folder, name):
    # Written as a pattern, the path may be a single file as well as a folder.
    schema = table(spark, folder, name).schema
    return streaming.read_arriving(spark, f"{folder}/{name}.parque[t]", schema)


def _arriving(spark, folder):
    out = _scratch(spark)
    arriving = _stream(spark, folder, "orders")
    query = streaming.reapply_arriving(arriving, GROUPED, out, f"{out}/state", once=True)
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rows").drop("source_file", "batch")


register("stream_reapply", _arriving, f"SELECT * EXCLUDE place FROM {_FIRSTS.format(g='')}")


TEXT_RECIPE = recipe(
    {"kind": "drop_duplicates", "columns": ["cliente"], "keep": "first"}, keep(c("Valor", "greater_than", value="100.000,00")),
    metrics=[{"id": "n", "operation": "count"}, {"id": "s", "operation": "sum", "column": "Valor"}],
)
# Keys of one file of a priority, so that files keep their size while their number grows.
FILE_KEYS = 100_000
_TEXT_FIRSTS = f"""(SELECT *, o_orderkey // {FILE_KEYS} AS f FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_orderkey // {FILE_KEYS}, o_custkey ORDER BY o_orderkey) = 1)"""


def _local_files(spark, folder, mixed=False):
    """Orders as text files, some per priority, money and dates as people write them; if ``mixed``, every second priority in another way."""
    path = _scratch(spark)
    orders = table(spark, folder, "orders").select(
        F.substring("o_orderpriority", 1, 1).alias("p"), F.floor(F.col("o_orderkey") / FILE_KEYS).alias("f"), "o_orderkey",
        F.col("o_custkey").cast("string").alias("cliente"), "o_totalprice", "o_orderdate")
    # Each file holds its rows in the order of their keys.
    orders = orders.repartition("p", "f").sortWithinPartitions("p", "f", "o_orderkey")
    local = [F.expr(f"concat('R$ ', {spark_money('o_totalprice')})").alias("Valor"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("Dia")]
    plain = [F.format_number("o_totalprice", 2).alias("Valor"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("Dia"), F.lit("x\ny").alias("nota")]
    other = F.col("p").isin("2", "4") if mixed else F.lit(False)
    files = lambda df, sep, **more: df.write.mode("append").partitionBy("p", "f").options(header="true", sep=sep, escape='"', **more).csv(path)
    files(orders.where(~other).select("p", "f", "cliente", *local), ";", encoding="ISO-8859-1")
    if mixed:
        files(orders.where(other).select("p", "f", *plain[:2], "cliente", plain[2]), ",", quoteAll="true")
    return path


def _file_metrics(rows):
    place = [F.regexp_extract("source", f"{x}=([0-9]+)", 1).alias(x) for x in "pf"]
    return rows.select(*place, "id", F.round("value", 2).alias("value"))


_FILE_SQL = f"""WITH kept AS (SELECT substr(o_orderpriority, 1, 1) AS p, f::VARCHAR AS f, count(*)::DOUBLE AS n, round(sum(o_totalprice), 2) AS s
    FROM {_TEXT_FIRSTS} WHERE o_totalprice > 100000 GROUP BY 1, 2)
    SELECT p, f, 'n' AS id, n AS value FROM kept UNION ALL SELECT p, f, 's', s FROM kept"""


def _first_way(spark, path):
    """Strategies of the files of one priority, kept for all others."""
    sample = delimited.scan_delimited(spark, f"{path}/p=1", ["cliente", "Valor", "Dia"], ";").select("cliente", "Valor", "Dia")
    return restored(stored(infer(sample)))


def _text_reapplied(spark, folder):
    path = _local_files(spark, folder)
    frame = fleet.reapply_text(spark, TEXT_RECIPE, path, strategies=_first_way(spark, path))
    return _file_metrics(fleet.metrics_by_source(frame, TEXT_RECIPE))


register("fleet_reapply_text", _text_reapplied, _FILE_SQL)


def _text_mixed(spark, folder):
    """Files with different decimal signs, date orders, separators, column orders and headers, each typed by its own cells."""
    frame = fleet.reapply_text(spark, TEXT_RECIPE, _local_files(spark, folder, mixed=True))
    return frame.df.select(
        F.regexp_extract(frame.group[0], "p=([0-9])", 1).alias("p"), F.col("cliente").cast("long").alias("cliente"),
        F.round("Valor", 2).alias("valor"), "Dia", F.length("nota").cast("long").alias("nota")).withColumnRenamed("Dia", "dia")


register("fleet_reapply_mixed", _text_mixed, f"""SELECT substr(o_orderpriority, 1, 1) AS p, o_custkey AS cliente, round(o_totalprice, 2) AS valor,
    date_trunc('day', o_orderdate)::TIMESTAMP AS dia, CASE WHEN substr(o_orderpriority, 1, 1) IN ('2', '4') THEN 3 END::BIGINT AS nota
    FROM {_TEXT_FIRSTS} WHERE o_totalprice > 100000""")


def _file_types(spark, folder):
    """Type, decimal sign and date format of every column of every file."""
    found = records.read_records(spark, _local_files(spark, folder, mixed=True))
    rows = infer_files(found.rows, found.headers)
    place = [F.regexp_extract("source", f"{x}=([0-9]+)", 1).alias(x) for x in "pf"]
    return rows.select(*place, "position", "name", "type", "decimal", "date_format")


register("fleet_file_types", _file_types, f"""WITH files AS (SELECT DISTINCT substr(o_orderpriority, 1, 1) AS p, (o_orderkey // {FILE_KEYS})::VARCHAR AS f FROM orders),
    ways AS (SELECT * FROM (VALUES (false, 0, 'cliente', 'number', '.', NULL), (false, 1, 'Valor', 'currency', ',', NULL), (false, 2, 'Dia', 'date', NULL, 'd/M/yyyy'),
    (true, 0, 'Valor', 'currency', '.', NULL), (true, 1, 'Dia', 'date', NULL, 'yyyy-M-d'), (true, 2, 'cliente', 'number', '.', NULL), (true, 3, 'nota', 'text', NULL, NULL))
    AS w(other, position, name, type, decimal, date_format))
    SELECT p, f, position, name, type, decimal, date_format
    FROM files JOIN ways ON other = (p IN ('2', '4'))""")


def _text_streamed(spark, folder):
    """The same files as they arrive, two at a time; each by its own layout and types."""
    path, out = _local_files(spark, folder, mixed=True), _scratch(spark)
    arriving = streaming.read_arriving_lines(spark, path, files_per_batch=2)
    wanted = {"cliente": "number", "Valor": "currency", "Dia": "date"}
    streaming.reapply_arriving_text(
        arriving, TEXT_RECIPE, out, f"{out}/state", columns=list(wanted), types=wanted, once=True).awaitTermination()
    return _file_metrics(spark.read.parquet(f"{out}/metrics"))


register("stream_reapply_text", _text_streamed, _FILE_SQL)


def _shares(df) -> int:
    """Tasks that read a table, and so in how many parts to write it, that no part grows with it."""
    return df.rdd.getNumPartitions()


def _multiline_split(spark, folder):
    """Documents with their line ends in quoted cells, in files of many tasks each."""
    path = _scratch(spark)
    docs = table(spark, folder, "documents").select("doc_id", "lang", F.regexp_replace("text", "\r", " ").alias("text"))
    docs.repartitionByRange(max(2, _shares(docs)), "doc_id").write.options(**_CELLS_AS_THEY_ARE).csv(path)
    # Only the files are read in small pieces, not the tables that follow.
    found = records.read_records(spark, path, pieces="64k")
    rows = written(records.columns_of(found, ["doc_id", "lang", "text"]))
    return rows.select("doc_id", "lang", F.length("text").cast("long").alias("n"), F.md5("text").alias("h"))


register("s_multiline_split", _multiline_split, """SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, length(text)::BIGINT AS n, md5(replace(text, chr(13), ' ')) AS h
    FROM documents""")


def _streamed_rows(spark, folder):
    out = _scratch(spark)
    rec = recipe(keep(group(c("event_type", "in", values=["CLICK", "error"]), c("value", "greater_than", value="5,5"))),
                 {"kind": "cast", "column": "value", "to": "text"}, {"kind": "select_columns", "columns": ["event_id", "value"]})
    rows = streaming.stream_rows(_stream(spark, folder, "events"), rec)
    query = rows.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows")
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rows")


register("stream_rows", _streamed_rows, "SELECT event_id, CAST(value AS VARCHAR) AS value FROM events WHERE event_type IN ('click', 'error') AND value > 5.5")


def _admitted(spark, folder):
    """Documents as text files longer than the limit for whole files, which only bounds readers that hold one.

    ``files`` is the number of verdicts on each file of a language, null if they differ.
    """
    path = _scratch(spark)
    docs = table(spark, folder, "documents").select("lang", "doc_id", F.regexp_replace("text", "[\r\n]", " ").alias("text"))
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(_shares(docs)))
    docs.repartition("lang", part).write.partitionBy("lang").options(header="true", sep="|", quoteAll="true", escape='"').csv(path)
    most = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(most, "1000")
    try:
        verdicts = written(admission.admit(spark, path))
    finally:
        spark.conf.unset(most)
    judged = admission.list_files(spark, path).select("path").join(verdicts.withColumn("judged", F.lit(1)), "path", "left")
    judged = judged.withColumn("verdicts", F.count("judged").over(Window.partitionBy("path")))
    lang = F.regexp_extract("path", "lang=([a-z]+)", 1).alias("lang")
    return judged.groupBy(lang).agg(
        F.when(F.min("verdicts") == F.max("verdicts"), F.max("verdicts")).alias("files"), F.every("ok").alias("ok"), F.min("separator").alias("separator"), F.min("encoding").alias("encoding"),
        F.every(F.col("length") > 1000).alias("long"))


register("s_admission_mixed", _admitted, """SELECT lang, 1::BIGINT AS files, true AS ok, '|' AS separator, 'UTF-8' AS encoding, true AS long
    FROM documents GROUP BY lang""")
register("p_top_values_all", lambda spark, folder: profile.top_values(
    table(spark, folder, "documents").select("source", "text"), limit=None, max_distinct=None).select("name", F.md5("value").alias("value"), "count"),
    """SELECT 'source' AS name, md5(source) AS value, count(*) AS count FROM documents WHERE source IS NOT NULL GROUP BY source
    UNION ALL SELECT 'text', md5(text), count(*) FROM documents WHERE text IS NOT NULL GROUP BY text""")


def _wide_mean(spark, folder):
    """A mean beyond the range of decimals, beside metrics that can be computed."""
    asked = [{"id": o, "operation": o, "column": "wide"} for o in ("avg", "sum", "count_empty")] + [{"id": "n", "operation": "count"}]
    lines = table(spark, folder, "lineitem").select(F.expr("cast(repeat('9', 37) AS decimal(38,0)) - l_orderkey").alias("wide"))
    rows = metrics.compute(recipes.run(lines, recipe(metrics=asked)), asked)
    return rows.select("id", "value", F.col("error").isNotNull().alias("refused"))


register("m_avg_decimal_overflow", _wide_mean, """SELECT id, CASE id WHEN 'n' THEN (SELECT count(*) FROM lineitem)::DOUBLE WHEN 'count_empty' THEN 0::DOUBLE END AS value,
    id IN ('avg', 'sum') AS refused FROM (VALUES ('avg'), ('sum'), ('count_empty'), ('n')) AS t(id)""")
