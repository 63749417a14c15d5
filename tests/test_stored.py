"""What is kept of files: profiles from sketches, indexes that skip files, sorted copies."""

import os

import pytest
from pyspark.sql import functions as F

from tidyloom.errors import RecipeError
from tidyloom.operators import access, file_index, page_index, sketches
from tidyloom.plans import recipe as recipes
from tidyloom.sources.seen_files import PATH, listing


def names(files):
    return sorted(r[0].rsplit("/", 1)[1] for r in files.select(PATH).collect())


def opened(df):
    """Number of files that the scans of an executed plan read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found, waiting = [], [plan]
    while waiting:
        node = waiting.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            waiting.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            waiting.append(node.plan())
        elif kind == "FileSourceScanExec":
            found.append(node.metrics().apply("numFiles").value())
        else:
            waiting += [node.children().apply(i) for i in range(node.children().size())]
    return sum(found)


def write(spark, path, rows, schema="k long, t string, u string, n double"):
    """One file with the rows."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def folder(spark, tmp_path):
    path = str(tmp_path / "data")
    write(spark, path, [(i, f" Name {i} ", f"x{i}y", float(i)) for i in range(10_000)])
    write(spark, path, [(i, f"other {i}", None, None) for i in range(50)])
    write(spark, path, [(1, "", "straße ÇÃO 😀é", float("nan")), (2, None, "", float("inf")), (3, " ÁGUA", "a\nb", -1.5)])
    return path


def test_equal_values_are_found_in_the_files_that_can_hold_them(spark, folder, tmp_path):
    store = str(tmp_path / "store")
    assert len(names(file_index.refresh(spark, folder, store, columns=["t"], rows=False))) == 3
    # Several bitmaps for the large file.
    assert spark.read.parquet(store).agg(F.max("bitmaps")).first()[0] == 4
    for values, keys, files in ((["NAME 77"], [77], 1), (["name 9999", "Other 3 "], [3, 9999], 2), ([""], [1], 1), (["água"], [3], 1), (["absent"], [], 0)):
        found = file_index.equal_rows(spark, folder, store, "t", values).visible()
        assert sorted(r["k"] for r in found.collect()) == keys
        assert opened(found) <= files + (files == 0)
    every = [f"name {i}" for i in range(0, 10_000, 997)]
    assert file_index.equal_rows(spark, folder, store, "t", every).df.count() == len(every)


def test_absent_values_seldom_pass(spark, folder, tmp_path):
    store = str(tmp_path / "store")
    file_index.refresh(spark, folder, store, columns=["t"], rows=False)
    big = spark.read.parquet(store).where("keys = 10000")
    absent = spark.range(2000).select(F.concat(F.lit("name "), F.col("id"), F.lit("x")).alias("key"))
    passed = absent.crossJoin(big).where(file_index._hit(F.col("key"))).count()
    assert passed < 2000 * 0.05


def test_texts_are_found_as_by_the_plain_search(spark, folder, tmp_path):
    store = str(tmp_path / "store")
    file_index.refresh(spark, folder, store)
    whole = recipes.run(spark.read.parquet(folder), {"steps": []})
    for text in ("STRASSE", "Straße ção 😀É", "😀é", "a\nb", "x77Y", "77", "", "other", "nothing here"):
        found = file_index.found_rows(spark, folder, store, text)
        plain = access.search(whole, text)
        assert sorted(map(repr, found.visible().collect())) == sorted(map(repr, plain.visible().collect())), text
    assert len(names(file_index.files_showing(spark, folder, store, "x77y"))) == 1


def test_new_and_changed_files_are_read_and_indexed_alone(spark, folder, tmp_path):
    store = str(tmp_path / "store")
    file_index.refresh(spark, folder, store, columns=["t"])
    before = names(listing(spark, folder))
    write(spark, folder, [(7, "name 77", "z", 0.0)])
    # Not indexed yet, and so read.
    assert file_index.equal_rows(spark, folder, store, "t", ["name 77"]).df.count() == 2
    assert not set(names(file_index.refresh(spark, folder, store, columns=["t"]))) & set(before)
    assert names(file_index.refresh(spark, folder, store, columns=["t"])) == []
    target = next(x for x in os.listdir(folder) if x.endswith(".parquet"))
    os.utime(f"{folder}/{target}", (1, 1))
    assert names(file_index.refresh(spark, folder, store, columns=["t"])) == [target]
    assert file_index.equal_rows(spark, folder, store, "t", ["name 77"]).df.count() == 2


def test_keys_are_combined_by_hash_before_the_shuffle(spark, folder, tmp_path, monkeypatch):
    """Sorting all keys of a task took memory that grew with its rows."""
    plans, plain = [], file_index.written
    monkeypatch.setattr(file_index, "written", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or plain(df))
    file_index.refresh(spark, folder, str(tmp_path / "store"), columns=["t"])
    keyed = [p for p in plans if "Generate explode" in p]
    assert keyed and all("HashAggregate" in p and "SortAggregate" not in p for p in keyed)


def test_what_cannot_be_looked_up_is_refused(spark, folder, tmp_path):
    with pytest.raises(RecipeError):
        file_index.refresh(spark, folder, str(tmp_path / "a"), columns=["n"])
    with pytest.raises(RecipeError):
        file_index.refresh(spark, folder, str(tmp_path / "a"), rows=False)
    with pytest.raises(RecipeError):
        file_index.files_with(spark, folder, str(tmp_path / "a"), "t", [None])


def test_profile_from_sketches(spark, folder, tmp_path):
    store = str(tmp_path / "store")
    assert sketches.profile(spark, folder, store).count() == 0
    sketches.refresh(spark, folder, store)
    rows = {r["name"]: r for r in sketches.profile(spark, folder, store).collect()}
    assert list(sorted(rows)) == ["k", "n", "t", "u"]
    n, t, u = rows["n"], rows["t"], rows["u"]
    assert (n["rowCount"], n["nullCount"], n["min"], n["max"]) == (10_053, 50, -1.5, 9999.0)
    assert abs(n["median"] - 5000) < 100 and abs(n["sum"] - (9999 * 5000 - 1.5)) < 1e-6
    assert abs(t["distinctCount"] - 10_052) < 400 and t["nullCount"] == 1 and t["min"] is None and t["topValues"] is None
    assert u["nullCount"] == 50

    few = str(tmp_path / "few")
    for part in ([("a", None), ("b", True)] * 3, [("a", False), (None, None), ("x" * 100, None)], []):
        write(spark, few, part, "t string, b boolean")
    first = sketches.refresh(spark, few, f"{store}2")
    assert len(names(first)) == 3
    found = {r["name"]: r for r in sketches.profile(spark, few, f"{store}2", limit=2).collect()}
    assert [tuple(x) for x in found["t"]["topValues"]] == [("a", 4), ("b", 3)]
    assert (found["t"]["rowCount"], found["t"]["nullCount"], found["t"]["distinctCount"], found["t"]["median"]) == (9, 1, 3, None)
    assert [x["count"] for x in found["b"]["topValues"]] == [3, 1]


def test_grown_and_shrunk_folders_need_only_new_files(spark, folder, tmp_path):
    store = str(tmp_path / "store")
    sketches.refresh(spark, folder, store)
    before = {x for x in os.listdir(folder) if x.endswith(".parquet")}
    write(spark, folder, [(1, "late", None, 1e6)])
    new = {x for x in os.listdir(folder) if x.endswith(".parquet")} - before
    assert set(names(sketches.refresh(spark, folder, store))) == new
    grown = sketches.profile(spark, folder, store)
    assert grown.where("name = 'n'").first()["max"] == 1e6
    os.remove(f"{folder}/{new.pop()}")
    assert sketches.profile(spark, folder, store).where("name = 'n'").first()["max"] == 9999.0


def test_every_page_of_a_sorted_copy(spark, tmp_path):
    path = str(tmp_path / "copy")
    df = spark.range(2_345).select((F.col("id") % 7).alias("a"), (F.col("id") % 1000).alias("b"), F.lit(None).cast("string").alias("c"))
    sort = {"kind": "sort", "by": [{"column": "a", "direction": "desc"}]}
    frame = recipes.run(df.repartition(5), {"steps": [sort]}, order_by=["a"])
    page_index.build(frame, path)
    for number in (0, 1, 2, 7, 15, 16, 17, 400):
        got = page_index.page(spark, path, number, 150)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in access.page(frame, number, 150).collect()]
        assert opened(got) <= 2
    assert page_index.total_rows(spark, path).first()[0] == 2_345
    with pytest.raises(RecipeError):
        page_index.page(spark, path, 1, 501)

    empty = str(tmp_path / "empty")
    page_index.build(recipes.run(df.where("a > 99"), {"steps": [sort]}, order_by=["a"]), empty)
    assert page_index.page(spark, empty).count() == 0 and page_index.total_rows(spark, empty).first()[0] == 0
