"""Export, history, many datasets at once, and arriving files."""

import glob
import json
import statistics
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidyloom.errors import RecipeError
from tidyloom.functions.quantile import exact_medians, of_key, sort_key
from tidyloom.operators import fleet, history, metrics, profile
from tidyloom.plans import recipe as recipes
from tidyloom.sinks import export
from tidyloom.streaming import reapply as streaming


@pytest.fixture(scope="module")
def odd_rows(spark):
    rows = [
        (1, "=1+1", 1234.5, datetime(2026, 9, 1, 10), True), (2, "a;b \"c\"", -0.125, None, False),
        (3, None, None, datetime(2026, 1, 2), None), (-4, "  spaced ", float("nan"), None, True),
        (5, "@x", 1e12, None, None),
    ]
    return spark.createDataFrame(rows, "n int, `+text` string, v double, d timestamp_ntz, b boolean")


def test_export(odd_rows, tmp_path):
    sort = {"kind": "sort", "by": [{"column": "n", "direction": "asc"}]}
    frame = recipes.run(odd_rows, {"steps": [sort]}, order_by=["n"])
    export.write_delimited(frame, str(tmp_path / "out"), rows_per_file=3)
    parts = sorted(glob.glob(str(tmp_path / "out" / "*.csv")))
    texts = [open(p, encoding="utf-8").read() for p in parts]
    assert len(parts) >= 2
    assert all(t.startswith("﻿n;'+text;v;d;b\n") for t in texts)
    lines = [line for t in texts for line in t.splitlines()[1:]]
    assert lines == [
        "-4;  spaced ;nan;;Sim", "1;'=1+1;1234,50;01/09/2026;Sim", '2;"a;b ""c""";-0,13;;Nao',
        "3;;;02/01/2026;", "5;'@x;1000000000000,00;;",
    ]


def test_export_of_chosen_columns(odd_rows):
    frame = recipes.run(odd_rows, {"steps": []}, order_by=["n"])
    assert export.formatted(frame, ["v", "n"]).columns == ["v", "n"]
    with pytest.raises(RecipeError):
        export.formatted(frame, ["nope"])


def test_summary(odd_rows):
    frame = recipes.run(odd_rows, {"steps": []}, order_by=["n"])
    wanted = [
        {"id": "a", "operation": "max", "column": "v", "format": "currency", "label": "=x"},
        {"id": "b", "operation": "sum", "column": "+text"},
        {"id": "c", "operation": "median", "column": "n"},
    ]
    rows = export.summary(frame, metrics.compute(frame, wanted), "@f.csv", "01/01/2026 10:00").orderBy("position")
    got = [(r["label"], r["text"]) for r in rows.collect()]
    assert got[:3] == [("Planilha de origem", "'@f.csv"), ("Gerado em", "01/01/2026 10:00"), ("Registros exportados", "5")]
    assert got[3][0] == "'=x" and got[4] == ("Mediana de n", "2,00")
    assert len(got) == 5


# --- history ---------------------------------------------------------------

def test_logged_runs(spark, odd_rows, tmp_path):
    folder = str(tmp_path)
    recipe = {"version": 1, "steps": [], "metrics": [{"id": "n", "operation": "count"}, {"id": "x", "operation": "sum", "column": "zz"}]}
    run_id = history.logged(spark, folder, recipe, lambda: recipes.run(odd_rows, recipe), user_id="u1", dataset_name="d")
    bad = {"version": 1, "steps": [{"kind": "nope"}]}
    with pytest.raises(RecipeError):
        history.logged(spark, folder, bad, lambda: recipes.run(odd_rows, bad), user_id="u1", dataset_name="d")
    executions = spark.read.parquet(f"{folder}/executions")
    measured = spark.read.parquet(f"{folder}/execution_metrics")
    users = spark.createDataFrame([("u1", "Ana")], "id string, display_name string")
    listed = history.execution_listing(executions, users, "u1").collect()
    assert [(r["status"], r["created_by_name"]) for r in listed] == [("failed", "Ana"), ("succeeded", "Ana")]
    assert listed[1]["input_row_count"] == 5 and json.loads(listed[1]["definition"]) == recipe
    assert listed[0]["error_message"]
    detail = history.execution_detail(executions, measured, run_id, "u1").collect()
    assert [(r["metric_key"], r["value"]) for r in detail] == [("n", 5.0)]
    assert history.execution_detail(executions, measured, run_id, "other").count() == 0
    assert history.listing_total(executions, "user_id", "u1").first()[0] == 2
    assert history.execution_listing(executions, users, "u1", page=2, size=1).first()["status"] == "succeeded"


@pytest.mark.parametrize("steps", [[], [{"kind": "filter", "filter": {"type": "group", "logic": "AND", "children": [
    {"type": "condition", "column": "n", "operator": "greater_than", "value": 10**6}]}}]])
def test_watched_export(spark, odd_rows, tmp_path, steps):
    """The watch sees what a metric computed afterwards sees, also of an empty result and of unwritten columns."""
    wanted = [{"id": f"{o}-{c}", "operation": o, "column": c} for o in metrics.OPERATIONS for c in ("n", "v", "+text")]
    frame = recipes.run(odd_rows, {"version": 1, "steps": steps}, order_by=["n"])
    for ordered in (True, False):
        watch = metrics.Watch(frame, wanted)
        export.write_delimited(frame, f"{tmp_path}/{ordered}", ["n", "v"], ordered=ordered, watch=watch)
        assert watch.rows == frame.df.count() == spark.read.option("header", "true").csv(f"{tmp_path}/{ordered}").count()
        seen, computed = watch.metrics(), metrics.compute(frame, wanted)
        assert seen.orderBy("position").collect() == computed.orderBy("position").collect()
        summed = [export.summary(frame, seen, "s", "now", rows).orderBy("position").collect() for rows in (watch.rows, None)]
        assert summed[0] == summed[1]


def test_watched_export_counts_each_row_once(spark, tmp_path):
    """Sorting samples its input in a pass of its own, which the watch must not count."""
    frame = recipes.run(spark.range(20_000).repartition(7), {"version": 1, "steps": []}, order_by=["id"])
    wanted = [{"id": "s", "operation": "sum", "column": "id"}]
    history.logged(spark, str(tmp_path), {"metrics": wanted}, lambda: frame, watched=lambda f, w: export.write_delimited(f, f"{tmp_path}/csv", watch=w))
    run = spark.read.parquet(f"{tmp_path}/executions").first()
    assert (run.input_row_count, run.output_row_count) == (20_000, 20_000)
    assert [r.value for r in spark.read.parquet(f"{tmp_path}/execution_metrics").collect()] == [sum(range(20_000))]


def test_versions(spark):
    recipes_df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "recipe_id int, name string")
    versions = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z")], "recipe_id int, version_number int, definition string")
    got = {r["recipe_id"]: (r["definition"], r["next_version_number"]) for r in history.latest_versions(recipes_df, versions).collect()}
    assert got == {1: ("y", 3), 2: ("z", 2), 3: (None, 1)}


def test_expired(spark):
    rows = [(1, datetime(2026, 1, 1), "ready"), (2, datetime(2026, 1, 1), "expired"), (3, None, "ready"), (4, datetime(2027, 1, 1), "ready")]
    df = spark.createDataFrame(rows, "id int, expires_at timestamp_ntz, status string")
    assert [r["id"] for r in history.expired(df, datetime(2026, 6, 1)).collect()] == [1]


# --- many datasets ---------------------------------------------------------

def test_missing_columns(spark):
    recipe = {"version": 1, "steps": [{"kind": "sort", "by": [{"column": "a"}]}], "metrics": [{"id": "s", "operation": "sum", "column": "b"}]}
    definitions = spark.createDataFrame([(1, json.dumps(recipe)), (2, '{"version": 1}')], "recipe_id int, definition string")
    wanted = fleet.recipe_columns(definitions)
    assert sorted(map(tuple, wanted.collect())) == [(1, "a"), (1, "b")]
    present = spark.createDataFrame([("x", "a"), ("y", "a"), ("y", "b")], "dataset_id string, column string")
    pairs = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "recipe_id int, dataset_id string")
    assert [tuple(r) for r in fleet.missing_columns(pairs, wanted, present).collect()] == [(1, "x", "b")]
    assert sorted(map(tuple, fleet.compatibility(pairs, wanted, present).collect())) == [(1, "x", 1), (1, "y", 0), (2, "x", 0)]


def test_lacking_names_beyond_one_word_of_bits(spark):
    needs = {r: {f"c{i}" for i in range(0, 400, r)} for r in (1, 3, 7)} | {9: set()}
    holds = {d: {f"c{i}" for i in range(500) if i % d} for d in (2, 5)} | {6: set(), 8: {"c63", "c64", None}}
    pairs = spark.createDataFrame([(r, d) for r in needs for d in holds], "recipe_id int, dataset_id int")
    wanted = spark.createDataFrame([(r, c) for r, cs in needs.items() for c in [*cs, None] * 2], "recipe_id int, column string")
    present = spark.createDataFrame([(d, c) for d, cs in holds.items() for c in cs], "dataset_id int, column string").repartition(3)
    lacking = {(r, d): needs[r] - holds[d] for r in needs for d in holds}
    assert sorted(map(tuple, fleet.compatibility(pairs, wanted, present).collect())) == sorted((r, d, len(x)) for (r, d), x in lacking.items())
    got = sorted(map(tuple, fleet.missing_columns(pairs, wanted, present).collect()))
    assert got == sorted((r, d, c) for (r, d), x in lacking.items() for c in x)
    none = wanted.where("false")
    assert fleet.missing_columns(pairs, none, present).count() == 0
    assert {r["missing"] for r in fleet.compatibility(pairs, none, present).collect()} == {0}


def test_resolve_names(spark):
    boat = ["Hull", "Mast height", "Sail", "Sail maker"]
    present = spark.createDataFrame(
        [(d, i, c) for d, names in (("yawl", boat), ("raft", boat[:3])) for i, c in enumerate(names)] + [("wide", i, f"c{i}") for i in range(9)],
        "dataset_id string, position int, column string",
    )
    want = {
        ("yawl", "HULL"): "Hull", ("yawl", " mast "): "Mast height", ("yawl", "the hull of it"): "Hull", ("yawl", "sail"): "Sail",
        ("yawl", "sai"): None, ("raft", "sai"): "Sail", ("yawl", "anchor"): None, ("none", "hull"): None, ("wide", "c1"): None,
    }
    asked = spark.createDataFrame(list(want) + [("yawl", "HULL")], "dataset_id string, name string")
    got = fleet.resolve_names(asked, present, max_columns=8).collect()
    assert len(got) == len(want) + 1 and {(r["dataset_id"], r["name"]): r["resolved"] for r in got} == want


@pytest.fixture(scope="module")
def two_files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("fleet")
    for name, rows in (("one", [("a", 1.0), ("a", 2.0), ("b", 3.0)]), ("two", [("a", 10.0), ("c", None)])):
        df = spark.createDataFrame(rows, "k string, v double").coalesce(1)
        df.write.parquet(str(folder / name))
        part, = glob.glob(str(folder / name / "*.parquet"))
        (folder / f"{name}.parquet").write_bytes(open(part, "rb").read())
    return [str(folder / "one.parquet"), str(folder / "two.parquet")], folder


RECIPE = {
    "version": 1,
    "steps": [{"kind": "drop_duplicates", "columns": ["k"]}, {"kind": "filter", "filter": {
        "type": "group", "logic": "AND", "children": [{"type": "condition", "column": "v", "operator": "is_not_empty"}]}}],
    "metrics": [
        {"id": "n", "operation": "count"}, {"id": "s", "operation": "sum", "column": "v"},
        {"id": "m", "operation": "median", "column": "v"}, {"id": "p", "operation": "percentage"},
    ],
}


def test_reapply_to_files(spark, two_files):
    frame = fleet.reapply(spark, RECIPE, *two_files[0])
    rows = metrics.compute(frame, RECIPE["metrics"]).collect()
    got = {(r["source"].rsplit("/", 1)[1], r["id"]): r["value"] for r in rows}
    assert {k: round(v, 2) for k, v in got.items()} == {
        ("one.parquet", "n"): 2, ("one.parquet", "s"): 4, ("one.parquet", "m"): 2, ("one.parquet", "p"): 66.67,
        ("two.parquet", "n"): 1, ("two.parquet", "s"): 10, ("two.parquet", "m"): 10, ("two.parquet", "p"): 50,
    }


def test_reapply_to_arriving_files(spark, two_files, tmp_path):
    paths, folder = two_files
    schema = spark.read.parquet(paths[0]).schema
    arriving = streaming.read_arriving(spark, str(folder / "*.parquet"), schema, files_per_batch=1)
    out = str(tmp_path / "out")
    query = streaming.reapply_arriving(arriving, RECIPE, out, str(tmp_path / "state"), once=True)
    query.awaitTermination(120)
    assert query.exception() is None
    measured = spark.read.parquet(f"{out}/metrics").where("id = 's'").collect()
    assert sorted(r["value"] for r in measured) == [4.0, 10.0]
    assert sorted(r["v"] for r in spark.read.parquet(f"{out}/rows").collect()) == [1.0, 3.0, 10.0]
    with pytest.raises(RecipeError):
        streaming.stream_rows(arriving, RECIPE)
    plain = streaming.stream_rows(arriving, {"version": 1, "steps": RECIPE["steps"][1:]})
    assert plain.isStreaming and plain.columns == ["k", "v"]


# --- exact medians and profile ---------------------------------------------

def test_exact_median(spark):
    import random

    rng = random.Random(7)
    data = {
        "even": [rng.gauss(0, 1) for _ in range(4000)],
        "odd": [rng.expovariate(1) * 10 ** rng.randint(-8, 8) for _ in range(4001)],
        "hot": [5.0] * 3000 + [float(i) for i in range(2000)],
        "split": [0.0] * 2000 + [1.0] * 2000,
        "one": [3.5],
        "wide": [-1e300, 1e300] * 150 + [float("inf")] * 3,
        "huge": [1.7e308, 1.7e308, -1.7e308],
        "tiny": [5e-324, 1e-310, -5e-324, 2.3e-308, 0.0, -0.0, 1e-320],
        None: [-1.5, -2.5, 7.0],
    }
    rows = [(g, v) for g, values in data.items() for v in values]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(8)
    got = {r["g"]: r["median"] for r in exact_medians(df, ["g"]).collect()}
    assert got == {g: statistics.median(v) for g, v in data.items()}
    empty = exact_medians(df.limit(0), ["g"])
    assert empty.columns == ["g", "median"] and empty.count() == 0


def test_numbers_that_sort_like_doubles(spark):
    import random
    import struct

    rng = random.Random(1)
    values = [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(3000)]
    values += [s * 2.0**e * f for e in range(-1074, 1024, 7) for s in (1, -1) for f in (1.0, 1.0 + 2**-52)] + [0.0, float("inf"), float("-inf"), float("nan")]
    values += [2.0**e * (1 - 2**-53) for e in range(-1021, 1024)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", sort_key(F.col("v")).alias("k")).select("v", "k", of_key(F.col("k")).alias("back")).collect()
    assert all(r.v == r.back or (r.v != r.v and r.back != r.back) for r in rows)
    plain = sorted((r.k, r.v) for r in rows if r.v == r.v)
    assert all(a[1] < b[1] if a[0] < b[0] else a[1] == b[1] for a, b in zip(plain, plain[1:]))
    assert max(r.k for r in rows if r.v == r.v) < next(r.k for r in rows if r.v != r.v)


def test_mean_beyond_the_range_leaves_other_metrics(spark):
    wide = spark.createDataFrame([("a", "9" * 38), ("b", "9" * 38), ("c", "1")], "k string, t string").select("k", F.col("t").cast("decimal(38,0)").alias("v"))
    asked = [{"id": o, "operation": o, "column": "v"} for o in ("avg", "sum", "max", "count_empty")] + [{"id": "n", "operation": "count"}]
    got = {r["id"]: (r["value"], r["error"]) for r in metrics.compute(recipes.run(wide, {"steps": []}), asked).collect()}
    assert got["n"] == (3.0, None) and got["max"] == (1e38, None) and got["count_empty"] == (0.0, None)
    for o in ("avg", "sum"):
        assert got[o][0] is None and "too large" in got[o][1]


def test_profile(spark):
    rows = [("a", 1.0, True, datetime(2026, 1, 1)), ("a", 1.0, True, datetime(2026, 1, 1)), ("a", 1.0, True, datetime(2026, 1, 1)),
            ("b", float("inf"), None, None), (None, -0.0, False, datetime(2026, 3, 1)), (None, 0.0, False, datetime(2026, 3, 1))]
    df = spark.createDataFrame(rows, "t string, `Valor total` double, b boolean, d timestamp_ntz")
    got = {r["name"]: r for r in profile.profile(df).collect()}
    first = got["t"]
    assert (first["rowCount"], first["columnCount"], first["duplicateRowCount"], first["rowsWithEmptyCount"]) == (6, 4, 3, 3)
    assert (first["nullCount"], first["distinctCount"]) == (2, 2)
    assert [tuple(v) for v in first["topValues"]] == [("a", 3), ("b", 1)]
    money = got["Valor total"]
    assert (money["type"], money["distinctCount"], money["min"], money["max"], money["sum"]) == ("currency", 3, 0.0, None, None)
    assert [tuple(v) for v in got["b"]["topValues"]] == [("true", 3), ("false", 2)]
    assert got["d"]["minDate"] == datetime(2026, 1, 1) and got["d"]["maxDate"] == datetime(2026, 3, 1)
    shares = {(r["name"], r["value"]): round(r["percent"], 2) for r in profile.category_shares(profile.profile(df)).collect()}
    assert shares[("t", "a")] == 50 and shares[("b", "false")] == 33.33
    assert profile.primary_measure(profile.column_statistics(df)).count() == 0
    assert profile.quality(profile.profile(df)).where("name = 't'").first()["nullPercent"] == pytest.approx(33.33, abs=0.01)


def test_approximate_profile_is_close(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet")
    exact = {r["name"]: r for r in profile.column_statistics(df).collect()}
    rough = {r["name"]: r for r in profile.column_statistics(df, approximate=True).collect()}
    for name, row in exact.items():
        assert rough[name]["distinctCount"] == pytest.approx(row["distinctCount"], rel=0.1)
        assert rough[name]["max"] == row["max"] and rough[name]["minDate"] == row["minDate"]


def test_all_columns_of_a_wide_table(spark):
    df = spark.range(20).select(*(F.concat(F.lit("t"), (F.col("id") % (i + 1)).cast("string")).alias(f"c{i}") for i in range(300)))
    rows = profile.column_statistics(df).collect()
    assert {r["name"]: r["distinctCount"] for r in rows} == {f"c{i}": min(i + 1, 20) for i in range(300)}


def test_long_frequent_texts_are_shown_whole(spark):
    long, other = "word " * 500, "other " * 300
    df = spark.createDataFrame([(long,), (long,), (other,), ("short",), (None,)], "t string")
    assert [tuple(r)[1:] for r in profile.top_values(df).orderBy("rank").collect()] == [(1, long, 2), (2, other, 1), (3, "short", 1)]
    row = profile.profile(df, limit=2).first()
    assert [tuple(t) for t in row["topValues"]] == [(long, 2), (other, 1)] and (row["distinctCount"], row["nullCount"]) == (3, 1)
    assert profile.top_values(df, max_distinct=2).count() == 0
    rough = profile.profile(df, approximate=True).first()
    assert (rough["rowCount"], rough["duplicateRowCount"], rough["distinctCount"]) == (5, 1, 3)


def test_rows_that_differ_in_the_place_of_a_null(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", None), ("", "a"), (None, None)], "x string, y string")
    row = profile.row_counts(df).first()
    assert (row["rowCount"], row["duplicateRowCount"], row["rowsWithEmptyCount"]) == (5, 1, 4)
