"""What the plans look like, and how they take skewed data."""

import pytest
from pyspark.sql import functions as F

from tidyloom.operators import access, fleet, history, metrics, profile
from tidyloom.plans import recipe as recipes


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def orders(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet")


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows."""
    key = F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(-1))
    return spark.range(0, 20_000, 1, 16).select("id", key.alias("k"), (F.col("id") % 7).alias("v"))


@pytest.mark.parametrize("keep", ["first", "last"])
def test_dedup_cuts_groups_before_the_shuffle(skewed, keep):
    step = {"kind": "drop_duplicates", "columns": ["k"], "keep": keep}
    df = recipes.run(skewed, {"steps": [step]}, order_by=["id"]).visible()
    before_shuffle = plan_of(df).split("Exchange hashpartitioning")[1]
    assert "WindowGroupLimit" in before_shuffle
    ids = {r["id"] for r in df.collect()}
    hot = 1 if keep == "first" else 19_999
    assert ids == {hot, *range(0, 20_000, 10)}


def test_dedup_none_combines_before_the_shuffle(skewed):
    step = {"kind": "drop_duplicates", "columns": ["k"], "keep": "none"}
    df = recipes.run(skewed, {"steps": [step]}).visible()
    assert "partial_count" in plan_of(df).split("Exchange hashpartitioning")[1]
    assert {r["id"] for r in df.collect()} == set(range(0, 20_000, 10))


def test_no_cross_joins(orders):
    recipe = {"steps": [], "metrics": [
        {"id": "p", "operation": "percentage"}, {"id": "m", "operation": "median", "column": "o_totalprice"},
        {"id": "d", "operation": "count_distinct", "column": "o_custkey"}]}
    frame = recipes.run(orders, recipe, ordered=True)
    for df in (metrics.compute(frame, recipe["metrics"]), profile.profile(orders), access.page(frame, 2, 10)):
        text = plan_of(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_page_keeps_only_its_rows(orders):
    sort = {"kind": "sort", "by": [{"column": "o_totalprice"}]}
    frame = recipes.run(orders, {"steps": [sort, {"kind": "select_columns", "columns": ["o_orderkey"]}]}, ordered=True)
    text = plan_of(access.page(frame, 2, 10))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text
    assert "o_orderpriority" not in text.split("ReadSchema")[1]


def test_metrics_read_only_their_columns(orders):
    frame = recipes.run(orders, {"steps": []}, ordered=True)
    text = plan_of(metrics.compute(frame, [{"id": "s", "operation": "sum", "column": "o_totalprice"}]))
    read = text.split("ReadSchema: struct<o_totalprice:double")[1]
    assert "o_orderkey" not in read and "o_orderpriority" not in read


def test_whole_number_filters_reach_the_scan(orders):
    tree = {"type": "group", "logic": "AND", "children": [
        {"type": "condition", "column": "o_custkey", "operator": "greater_than", "value": 10.5}]}
    text = plan_of(recipes.run(orders, {"steps": [{"kind": "filter", "filter": tree}]}).visible())
    assert "GreaterThan(o_custkey,10)" in text


def test_listing_sorts_one_page(spark, orders):
    users = spark.createDataFrame([("2-HIGH", "x")], "id string, display_name string")
    runs = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("user_id"), F.col("o_orderdate").alias("created_at"))
    text = plan_of(history.execution_listing(runs, users, "2-HIGH"))
    assert "TakeOrderedAndProject" in text and "SortMergeJoin" not in text and "hashpartitioning" not in text


def test_names_asked_of_one_dataset_are_spread(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        asked = spark.range(5000).select(F.lit("d").alias("dataset_id"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("name"))
        present = spark.range(100).select(F.lit("d").alias("dataset_id"), F.col("id").cast("int").alias("position"), F.concat(F.lit("X"), F.col("id").cast("string")).alias("column"))
        found = fleet.resolve_names(asked, present)
        tasks = found.groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) > 3
        assert found.where("resolved is not null").count() >= 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
