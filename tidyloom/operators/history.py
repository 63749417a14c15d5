"""History of runs, recipe versions and retention, kept as append-only Parquet tables."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidyloom.errors import RecipeError
from tidyloom.operators import access
from tidyloom.operators import metrics as metric_ops
from tidyloom.plans.frame import Frame, OrderKey, frame_of

EXECUTIONS = (
    "id string, user_id string, dataset_id string, dataset_name string, recipe_id string, "
    "recipe_version_id string, recipe_name string, definition string, status string, "
    "input_row_count long, output_row_count long, duration_ms long, error_message string, "
    "created_at timestamp_ntz, completed_at timestamp_ntz"
)
EXECUTION_METRICS = (
    "execution_id string, metric_key string, label string, operation string, column_name string, "
    "value double, format string"
)
# Fixed value: datasets expired in one go.
EXPIRY_BATCH = 200
# Metric that counts the rows of a result beside those of the recipe.
ROWS = "__rows"


# --- writing ---------------------------------------------------------------

def logged(
    spark: SparkSession, folder: str, recipe: dict, frame_for: Callable[[], Frame],
    action: Callable[[Frame], None] = lambda frame: None,
    watched: Callable[[Frame, metric_ops.Watch], None] | None = None, **context: str,
) -> str:
    """Run ``action`` on a recipe result and append the run to the history.

    An action that reads the whole result once, such as an export, is given as ``watched`` and
    puts the watch into its plan; then rows and simple metrics come from that pass and the
    recipe does not run again for them. Failures are written down too, then raised again.
    ``context`` fills the columns that tell user, dataset and recipe.
    """
    run_id = str(uuid.uuid4())
    started, clock = _now(), time.perf_counter()
    record = {**context, "id": run_id, "definition": json.dumps(recipe, ensure_ascii=False), "created_at": started}
    try:
        frame = frame_for()
        action(frame)
        # All metrics and the rows of the result, as one small row each.
        wanted = [*(recipe.get("metrics") or []), {"id": ROWS, "operation": "count"}]
        if watched:
            watch = metric_ops.Watch(frame, wanted)
            watched(frame, watch)
            counted = watch.metrics()
        else:
            counted = metric_ops.compute(frame, wanted)
        found = counted.collect()
        rows = int(found[-1]["value"])
        read = frame.base.agg(F.count(F.lit(1))).first()[0]
        append_metrics(folder, run_id, spark.createDataFrame(found[:-1], counted.schema))
        record.update(status="succeeded", input_row_count=read, output_row_count=rows)
    except Exception as error:
        record.update(status="failed", input_row_count=0, output_row_count=0, error_message=str(error)[:2000])
        raise
    finally:
        record.update(duration_ms=int((time.perf_counter() - clock) * 1000), completed_at=_now())
        append_execution(spark, folder, record)
    return run_id


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def append_execution(spark: SparkSession, folder: str, record: dict) -> None:
    names = [part.split()[0] for part in EXECUTIONS.split(", ")]
    unknown = set(record) - set(names)
    if unknown:
        raise RecipeError(f"Unknown history fields: {', '.join(sorted(unknown))}.")
    row = tuple(record.get(name) for name in names)
    df = spark.createDataFrame([row], EXECUTIONS).coalesce(1)
    df.write.mode("append").parquet(f"{folder}/executions")


def append_metrics(folder: str, execution_id: str, measured: DataFrame) -> None:
    """One row per metric that could be computed; a null value is a legitimate result."""
    if "id" not in measured.columns:
        return
    rows = measured.where(F.col("error").isNull()).select(
        F.lit(execution_id).alias("execution_id"), F.col("id").alias("metric_key"), "label", "operation",
        F.col("column").alias("column_name"), "value", "format",
    )
    rows.coalesce(1).write.mode("append").parquet(f"{folder}/execution_metrics")


# --- reading ---------------------------------------------------------------

def listing(
    rows: DataFrame, owner_column: str, owner, created_column: str, key_column: str,
    page: int = 1, size: int = 50,
) -> DataFrame:
    """One page of what an owner has, newest first, at any depth."""
    own = frame_of(rows.where(F.col(owner_column) == F.lit(owner)), anchored=False)
    newest = replace(own, anchor=(OrderKey(created_column, descending=True), OrderKey(key_column)))
    return access.page(newest, page, size)


def execution_listing(
    executions: DataFrame, users: DataFrame, user_id, page: int = 1, size: int = 50,
) -> DataFrame:
    """Runs of a user, newest first, with the user's name where it is known.

    The page is cut before the join, and only one user can match it, so neither
    table is shuffled.
    """
    shown = listing(executions, "user_id", user_id, "created_at", "id", page, size)
    owner = users.where(F.col("id") == F.lit(user_id)).limit(1)
    named = F.broadcast(owner.select(F.col("id").alias("owner_id"), F.col("display_name").alias("created_by_name")))
    joined = shown.join(named, F.col("user_id") == F.col("owner_id"), "left").drop("owner_id")
    return joined.orderBy(F.col("created_at").desc(), F.col("id").asc())


def listing_total(rows: DataFrame, owner_column: str, owner) -> DataFrame:
    return rows.where(F.col(owner_column) == F.lit(owner)).agg(F.count(F.lit(1)).alias("total"))


def execution_detail(executions: DataFrame, metrics: DataFrame, execution_id, user_id) -> DataFrame:
    """A run of a user with its metrics, one row per metric; the filter reaches both scans."""
    run = executions.where((F.col("id") == F.lit(execution_id)) & (F.col("user_id") == F.lit(user_id)))
    own = metrics.where(F.col("execution_id") == F.lit(execution_id))
    return run.join(own, F.col("id") == F.col("execution_id"), "left").drop("execution_id")


def latest_versions(recipes: DataFrame, versions: DataFrame) -> DataFrame:
    """Every recipe with its newest version, if it has one, and the number the next one gets.

    The rank limit is applied before the shuffle, so a recipe with very many
    versions sends one row per task.
    """
    order = Window.partitionBy("recipe_id").orderBy(F.col("version_number").desc())
    newest = (
        versions.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == 1).drop("rank")
        .withColumnRenamed("recipe_id", "version_of")
    )
    joined = recipes.join(newest, F.col("recipe_id") == F.col("version_of"), "left").drop("version_of")
    following = F.coalesce(F.col("version_number"), F.lit(0)) + 1
    return joined.withColumn("next_version_number", following.cast("int"))


def expired(datasets: DataFrame, now: datetime, limit: int = EXPIRY_BATCH) -> DataFrame:
    """Datasets past their date that are not marked yet, the oldest first, a batch at a time."""
    due = datasets.where(
        (F.col("expires_at") <= F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")) & (F.col("status") != "expired")
    )
    return due.orderBy("expires_at", "id").limit(limit)
