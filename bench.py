"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog.registry import condition, keep, recipe, spark_money, table  # noqa: E402
from tidyloom.operators import access, fleet, metrics, profile  # noqa: E402
from tidyloom.operators.infer import coerce  # noqa: E402
from tidyloom.plans import recipe as recipes  # noqa: E402
from tidyloom.session import configure, shared_folder  # noqa: E402
from tidyloom.sinks import export  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3


def drain(df) -> None:
    """Compute every row and column without keeping them."""
    df.write.format("noop").mode("overwrite").save()


def text_orders(spark):
    return table(spark, FOLDER, "orders").select(
        "o_orderkey",
        F.expr(f"concat('R$ ', {spark_money('o_totalprice')})").alias("Valor"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("Data"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'Sim' ELSE 'Nao' END").alias("Fechado"),
        "o_orderpriority",
    )


def headline(spark, scratch: str) -> dict:
    lines = table(spark, FOLDER, "lineitem")
    orders = table(spark, FOLDER, "orders")
    returned = keep(condition("l_returnflag", "equals", value="R", caseSensitive=True))
    large = keep(condition("l_extendedprice", "greater_than", value=50000))
    total = [{"id": "s", "operation": "sum", "column": "l_extendedprice"}]
    every = [
        {"id": o, "operation": o, "column": "l_extendedprice"} for o in ("sum", "avg", "min", "max", "median", "count_distinct")
    ] + [{"id": "n", "operation": "count"}, {"id": "p", "operation": "percentage"}]
    by_price = {"kind": "sort", "by": [{"column": "l_extendedprice", "direction": "desc"}]}
    first = {"kind": "drop_duplicates", "columns": ["l_orderkey"], "keep": "first"}
    alone = {"kind": "drop_duplicates", "columns": ["l_orderkey", "l_linenumber"], "keep": "none"}

    def filtered_sum():
        metrics.compute(recipes.run(lines, recipe(returned)), total).collect()

    def preview():
        shown = access.preview(recipes.run(lines, recipe(large, by_price), ordered=True), every, 1, 100)
        shown.rows.collect()
        shown.metrics.collect()

    def export_text():
        path = f"{scratch}/out-{time.time_ns()}"
        export.write_delimited(recipes.run(orders, recipe(), ordered=True), path)

    grouped = recipe(metrics=[{"id": "s", "operation": "sum", "column": "l_extendedprice"}, {"id": "n", "operation": "count"}])
    return {
        "filtered_sum": filtered_sum,
        "text_filter": lambda: recipes.run(lines, recipe(keep(condition("l_linestatus", "equals", value=" o ")))).df.count(),
        "preview": preview,
        "search": lambda: access.search(recipes.run(orders, recipe()), "urgent").df.count(),
        "column_values": lambda: access.column_values(lines, "l_quantity").collect(),
        "dedup_first": lambda: drain(recipes.run(lines, recipe(first)).visible()),
        "dedup_none": lambda: drain(recipes.run(lines, recipe(alone)).visible()),
        "coerce_text": lambda: drain(coerce(text_orders(spark))),
        "column_profile": lambda: profile.column_statistics(lines).collect(),
        "row_counts": lambda: profile.row_counts(lines).collect(),
        "full_profile": lambda: profile.profile(orders).collect(),
        "metrics_by_file": lambda: fleet.metrics_by_source(
            fleet.reapply(spark, grouped, f"{FOLDER}/lineitem.parquet"), grouped).collect(),
        "export_text": export_text,
    }


def main() -> None:
    spark = configure(
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    scratch = shared_folder(spark)
    times = {}
    for name, run in headline(spark, scratch).items():
        taken = []
        for _ in range(RUNS):
            start = time.perf_counter()
            run()
            taken.append(time.perf_counter() - start)
        times[name] = round(min(taken), 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
