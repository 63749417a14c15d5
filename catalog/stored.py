"""Queries that keep what they learnt of files: grown profiles, file indexes, sorted copies."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.registry import recipe, register, table
from tidyloom.operators import file_index, page_index, profile, sketches
from tidyloom.plans import recipe as recipes
from tidyloom.session import shared_folder, written
from tidyloom.sources.seen_files import listing


def _scratch(spark) -> str:
    """A new folder in the place all executors share."""
    return f"{shared_folder(spark)}/tidyloom-{uuid.uuid4()}"


def _grown(spark, folder):
    """Orders that arrive in two parts; the second refresh reads the new files alone."""
    path, store = _scratch(spark), _scratch(spark)
    orders = table(spark, folder, "orders")
    early = F.col("o_orderdate") < "1997-01-01"
    orders.where(early).repartitionByRange(3, "o_orderkey").write.parquet(path)
    sketches.refresh(spark, path, store)
    before = written(listing(spark, path))
    orders.where(~early).repartitionByRange(2, "o_orderkey").write.mode("append").parquet(path)
    read = sketches.refresh(spark, path, store)
    # One row: whether no file was read that was there before.
    none_again = read.join(before, read.columns, "left_semi").agg((F.count(F.lit(1)) == 0).alias("none_again"))
    exact = profile.column_statistics(orders).select("name", F.col("distinctCount").alias("exact"))
    near = F.abs(F.col("distinctCount") - F.col("exact")) <= F.col("exact") * 0.04 + 1
    shown = F.array_join(F.transform("topValues", lambda x: F.concat_ws(":", x["value"], x["count"])), ";")
    rows = sketches.profile(spark, path, store).join(exact, "name")
    return rows.select("name", "rowCount", "nullCount", "min", "max", near.alias("distinct_near"), shown.alias("top"), none_again.scalar().alias("none_again"))


def _grown_sql(name: str, number: bool, top: bool) -> str:
    of = "min({0})::DOUBLE AS min, max({0})::DOUBLE AS max" if number else "NULL::DOUBLE AS min, NULL::DOUBLE AS max"
    tops = f"""(SELECT string_agg(v || ':' || n, ';' ORDER BY n DESC, v) FROM (SELECT {name} AS v, count(*) AS n FROM orders WHERE {name} IS NOT NULL GROUP BY 1))"""
    return f"""SELECT '{name}' AS name, count(*) AS "rowCount", count(*) - count({name}) AS "nullCount", {of.format(name)}, true AS distinct_near,
        {tops if top else 'NULL::VARCHAR'} AS top, true AS none_again FROM orders"""


register("p_profile_grown", _grown, " UNION ALL ".join(
    _grown_sql(name, number, top) for name, number, top in (
        ("o_orderkey", True, False), ("o_custkey", True, False), ("o_orderstatus", False, True), ("o_totalprice", True, False),
        ("o_orderdate", False, False), ("o_orderpriority", False, True))))


def _told(spark, path, files):
    """One row: whether the index leaves out some file of the folder, and keeps some."""
    return files.agg(F.count(F.lit(1)).between(1, listing(spark, path).agg(F.count(F.lit(1))).scalar() - 1).alias("skips")).scalar().alias("skips")


def _equal_skipping(spark, folder):
    """Documents of two sources, asked for in other cases and with spaces, in files of a few sources each."""
    path, store = _scratch(spark), _scratch(spark)
    docs = table(spark, folder, "documents").select("doc_id", F.concat(F.lit(" "), F.upper("source")).alias("source"), "text")
    docs.repartitionByRange(8, "source").write.parquet(path)
    file_index.refresh(spark, path, store, columns=["source"], rows=False)
    wanted = ["src3", "Src5 "]
    rows = file_index.equal_rows(spark, path, store, "source", wanted).visible()
    return rows.select("doc_id", "source", F.md5("text").alias("h"), _told(spark, path, file_index.files_with(spark, path, store, "source", wanted)))


register("f_equals_skipping", _equal_skipping, """SELECT doc_id, ' ' || upper(source) AS source, md5(text) AS h, true AS skips
    FROM documents WHERE source IN ('src3', 'src5')""")


def _search_index(spark, folder):
    """Customers that show a text, in files of one segment each."""
    path, store, text = _scratch(spark), _scratch(spark), "8 Machin"
    table(spark, folder, "customer").repartitionByRange(5, "c_mktsegment").write.parquet(path)
    file_index.refresh(spark, path, store)
    rows = file_index.found_rows(spark, path, store, text).visible()
    return rows.select("*", _told(spark, path, file_index.files_showing(spark, path, store, text)))


register("r_search_index", _search_index, """SELECT *, true AS skips FROM customer
    WHERE contains(lower(concat_ws(' ', CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR), CAST(c_acctbal AS VARCHAR), c_mktsegment)), '8 machin')""")


def _page_index(spark, folder):
    """Three pages far into lines ordered by a column with fifty values, from one sort."""
    path = _scratch(spark)
    by_quantity = {"kind": "sort", "by": [{"column": "l_quantity", "direction": "desc"}]}
    page_index.build(recipes.run(table(spark, folder, "lineitem"), recipe(by_quantity), order_by=["l_quantity"]), path)
    pages = [page_index.page(spark, path, n, 500) for n in (11, 12, 13)]
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


register("r_page_index", _page_index, """SELECT * FROM lineitem ORDER BY l_quantity DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber,
    l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate LIMIT 1500 OFFSET 5000""")
