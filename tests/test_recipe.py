"""Recipes end to end on a bird ringer's notebook; each case is held against a plain Python test of the rows."""

from datetime import datetime as D
from statistics import median

import pytest
from pyspark.sql import types as T

from catalog.registry import condition as cond, group, keep
from tidyloom.errors import RecipeError
from tidyloom.model import schema_of
from tidyloom.operators import access, filters, metrics
from tidyloom.plans import recipe as recipes

TYPES = {"ring": "text", "species": "text", "grams": "number", "seen": "date", "adult": "boolean", "remark": "text"}
ROWS = [
    ("K7", "Robin", 18.5, D(2031, 4, 2, 7, 30), True, "wet"),
    ("K9", "wren ", 9.25, D(2031, 4, 2), False, None),
    ("M1", "Heron", 1620.0, D(2030, 11, 30, 23, 59, 59), True, "ring 50% worn"),
    ("K7", "Robin", 18.5, D(2031, 4, 2, 7, 30), True, "wet"),
    ("M4", "robin", 17.0, D(2032, 1, 1), None, "  "),
    ("P2", "Owl_barn", 310.75, None, False, "Wet wing"),
    ("P3", None, None, D(2031, 4, 3), True, "none"),
    ("P5", "Heron", 1455.0, D(2031, 12, 24, 18), False, ""),
    ("Q8", "Wren", 1000.0, D(2030, 11, 30), True, "x"),
]
COLUMNS = list(TYPES)


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    kinds = (T.StringType(), T.StringType(), T.DoubleType(), T.TimestampNTZType(), T.BooleanType(), T.StringType())
    schema = T.StructType([T.StructField(n, k) for n, k in zip(COLUMNS, kinds, strict=True)])
    path = str(tmp_path_factory.mktemp("base") / "rows")
    spark.createDataFrame(ROWS, schema).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def run(base, *steps, **options):
    return recipes.run(base, {"version": 1, "steps": list(steps)}, types=TYPES, **options)


def count(base, *steps):
    return run(base, *steps).visible().count()


def column(frame, name):
    return [r[name] for r in frame.ordered().collect()]


def rows_where(test):
    return [r for r in (dict(zip(COLUMNS, row, strict=True)) for row in ROWS) if test(r)]


def folded(value):
    return None if value is None else value.strip(" ").lower()


HERON = cond("species", "equals", value="heron")
CASES = [
    (cond("species", "equals", value=" ROBIN"), lambda r: folded(r["species"]) == "robin"),
    (cond("species", "equals", value="Robin", caseSensitive=True), lambda r: r["species"] == "Robin"),
    (cond("species", "equals", value=None), lambda r: r["species"] is None),
    (cond("species", "not_equals", value=None), lambda r: r["species"] is not None),
    (cond("remark", "not_equals", value="wet"), lambda r: folded(r["remark"]) != "wet"),
    (cond("species", "in", values=["owl_barn", " Wren"]), lambda r: folded(r["species"]) in ("owl_barn", "wren")),
    (cond("remark", "not_in", values=["wet", "x"]), lambda r: folded(r["remark"]) not in ("wet", "x")),
    # A missing value in the list makes every other answer unknown.
    (cond("remark", "not_in", values=["wet", None]), lambda r: r["remark"] is None),
    (cond("grams", "in", values=["1.620,00", 17]), lambda r: r["grams"] in (1620.0, 17.0)),
    (cond("grams", "greater_than", value="1.000,00"), lambda r: r["grams"] is not None and r["grams"] > 1000),
    (cond("grams", "greater_or_equal", value="R$ 1.000"), lambda r: r["grams"] is not None and r["grams"] >= 1.0),
    (cond("grams", "less_than", value=17), lambda r: r["grams"] is not None and r["grams"] < 17),
    (cond("grams", "less_or_equal", value="17"), lambda r: r["grams"] is not None and r["grams"] <= 17),
    (cond("grams", "between", range=[400, "9,25"]), lambda r: r["grams"] is not None and 9.25 <= r["grams"] <= 400),
    (cond("remark", "is_empty"), lambda r: not (r["remark"] or "").strip(" ")),
    (cond("remark", "is_not_empty"), lambda r: bool((r["remark"] or "").strip(" "))),
    (cond("adult", "is_true"), lambda r: r["adult"] is True),
    (cond("adult", "is_false"), lambda r: r["adult"] is False),
    (cond("adult", "equals", value="yes"), lambda r: r["adult"] is True),
    (cond("adult", "equals", value="perhaps"), lambda r: r["adult"] is False),
    (cond("remark", "contains", value="WET"), lambda r: "wet" in (r["remark"] or "").lower()),
    (cond("remark", "contains", value="Wet", caseSensitive=True), lambda r: "Wet" in (r["remark"] or "")),
    (cond("remark", "contains", value=""), lambda r: r["remark"] is not None),
    (cond("remark", "contains", value="%"), lambda r: "%" in (r["remark"] or "")),
    (cond("species", "contains", value="_"), lambda r: "_" in (r["species"] or "")),
    (cond("remark", "not_contains", value="wet"), lambda r: "wet" not in (r["remark"] or "").lower()),
    (cond("grams", "contains", value="0.0"), lambda r: r["grams"] is not None and "0.0" in str(r["grams"])),
    (cond("species", "starts_with", value="ro"), lambda r: (r["species"] or "").lower().startswith("ro")),
    (cond("species", "ends_with", value="RON"), lambda r: (r["species"] or "").lower().endswith("ron")),
    (cond("seen", "date_equals", value="2031/4/2"), lambda r: r["seen"] and r["seen"].date() == D(2031, 4, 2).date()),
    (cond("seen", "date_before", value="2031-04-02"), lambda r: r["seen"] and r["seen"] < D(2031, 4, 2)),
    (cond("seen", "date_after", value="2031-04-02"), lambda r: r["seen"] and r["seen"] >= D(2031, 4, 3)),
    (cond("seen", "date_between", range=["2030-11-30", "2031-04-02"]), lambda r: r["seen"] and D(2030, 11, 30) <= r["seen"] < D(2031, 4, 3)),
    (cond("seen", "date_between", range=["2031-04-02", "2030-11-30"]), lambda r: False),
    (cond("seen", "date_equals", value="02/04/2031"), lambda r: False),
    (cond("seen", "date_equals", value="2031-04"), lambda r: False),
    (group(HERON, cond("grams", "less_than", value=1500)), lambda r: r["species"] == "Heron" and r["grams"] < 1500),
    (group(group(HERON, cond("adult", "is_true")), group(cond("grams", "less_than", value=10)), logic="OR"),
     lambda r: (r["species"] == "Heron" and r["adult"]) or (r["grams"] or 99) < 10),
    # Unknown stays unknown under negation.
    (group(HERON, negate=True), lambda r: r["species"] is not None and r["species"] != "Heron"),
    (group(cond("remark", "contains", value="wet"), negate=True), lambda r: r["remark"] is not None and "wet" not in r["remark"].lower()),
    (group(), lambda r: True),
    (group(negate=True), lambda r: True),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_filters(base, case):
    tree, test = CASES[case]
    got = run(base, keep(tree)).visible().collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(tuple(r.values())) for r in rows_where(test))


def test_refused_recipes(base):
    wrong = [
        cond("grams", "greater_than", value="heavy"), cond("grams", "equals", value=False), cond("seen", "less_than", value="soon"),
        cond("ring", "in", values=[]), cond("wing", "is_empty"), cond("ring", "rhymes_with", value="x"), cond("grams", "between", range=3),
        cond("ring", "contains"), cond("grams", "equals", value=float("inf")), cond("ring", "equals", value=["K7"]),
    ]
    for tree in wrong:
        with pytest.raises(RecipeError):
            run(base, keep(tree))
    for step in ({"kind": "sing"}, {"kind": "drop_columns", "columns": COLUMNS}, {"kind": "cast", "column": "ring", "to": "bird"},
                 {"kind": "fill_empty", "column": "seen", "value": "later"}, {"kind": "fill_empty", "column": "seen", "value": None},
                 {"kind": "sort", "by": []}, {"kind": "select_columns", "columns": []}):
        with pytest.raises(RecipeError):
            run(base, step)


def test_strict_types(base):
    fits, unfit = keep(cond("grams", "equals", value=17)), keep(cond("grams", "contains", value="7"))
    assert run(base, fits, strict_types=True).visible().count() == 1
    assert run(base, unfit).visible().count() > 0
    with pytest.raises(RecipeError):
        run(base, unfit, strict_types=True)


def test_size_of_trees():
    leaf = cond("ring", "is_empty")
    nested = leaf
    for level in range(1, 7):
        nested = group(nested)
        if level < 6:
            filters.validate(nested)
    assert filters.measure(nested) == (7, 7)
    with pytest.raises(RecipeError):
        filters.validate(nested)
    filters.validate(group(*[leaf] * (filters.MAX_NODES - 1)))
    with pytest.raises(RecipeError):
        filters.validate(group(*[leaf] * filters.MAX_NODES))


@pytest.mark.parametrize("node, stays", [
    (cond("a", "is_false"), True), (cond("a", "equals", value=0), True), (cond("a", "equals", value=""), False), (cond("a", "equals"), False),
    (cond("a", "in", values=["", 1]), True), (cond("a", "in", values=[]), False), (cond("a", "in"), False),
    (cond("a", "between", range=[0, 0]), True), (cond("a", "between", range=[5]), False), (cond("a", "date_between", range=["2031-01-01", ""]), False),
    (group(), False), (group(cond("a", "contains", value=None), group()), False),
])
def test_half_filled_conditions(node, stays):
    assert filters.prune(node) == (node if stays else None)
    full = cond("b", "is_empty")
    assert filters.prune(group(node, full, logic="OR")) == group(*([node, full] if stays else [full]), logic="OR")


def test_whole_numbers_stay_exact(spark):
    ids = spark.createDataFrame([(2**53 + 1,), (2**53 + 2,), (-(2**63),)], "id long")
    one = lambda tree: [r.id for r in recipes.run(ids, {"steps": [keep(tree)]}).visible().collect()]
    assert one(cond("id", "equals", value=2**53 + 1)) == [2**53 + 1]
    assert one(cond("id", "in", values=[str(2**53 + 2), 2**70])) == [2**53 + 2]
    assert one(cond("id", "greater_than", value=str(2**53 + 1))) == [2**53 + 2]
    assert one(cond("id", "less_than", value=-(2.0**62))) == [-(2**63)]
    assert sorted(one(cond("id", "less_than", value=2**64))) == [-(2**63), 2**53 + 1, 2**53 + 2]
    money = spark.createDataFrame([("12345678901234567890.12",)], "m string").selectExpr("cast(m AS decimal(38,2)) AS m")
    exact = recipes.run(money, {"steps": [keep(cond("m", "equals", value="12345678901234567890.12"))]})
    assert exact.visible().count() == 1
    assert recipes.run(money, {"steps": [keep(cond("m", "equals", value="12345678901234567890.13"))]}).visible().count() == 0


def test_pushdown_reaches_the_scan(base):
    tree = group(cond("grams", "less_than", value=500), cond("seen", "date_equals", value="2031-04-02"))
    frame = run(base, keep(tree), {"kind": "select_columns", "columns": ["ring"]})
    plan = frame.visible()._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(grams,500.0)" in plan and "GreaterThanOrEqual(seen,2031-0" in plan
    assert "adult" not in plan.split("ReadSchema")[1]


# --- steps -----------------------------------------------------------------

def distinct(names, which):
    """Plain removal of repeated keys; ``which`` picks from the places of a key."""
    places = {}
    for i, row in enumerate(ROWS):
        places.setdefault(tuple(row[COLUMNS.index(n)] for n in names), []).append(i)
    return sorted(p for found in places.values() for p in which(found))


@pytest.mark.parametrize("keep_", ["first", "last", "none"])
@pytest.mark.parametrize("names", [["ring"], ["species"], ["species", "adult"], []])
def test_duplicates(base, names, keep_):
    which = {"first": lambda p: p[:1], "last": lambda p: p[-1:], "none": lambda p: p if len(p) == 1 else []}[keep_]
    want = [ROWS[i] for i in distinct(names or COLUMNS, which)]
    by_weight = {"kind": "sort", "by": [{"column": "grams", "direction": "desc"}]}
    for before in ((), (by_weight,)):
        frame = run(base, *before, {"kind": "drop_duplicates", "columns": names, "keep": keep_})
        assert sorted(map(repr, map(tuple, frame.visible().collect()))) == sorted(map(repr, want))


def test_empty_rows(base):
    blank = lambda v: v is None or (isinstance(v, str) and not v.strip(" "))
    for mode, every in (("any", any), ("all", all)):
        for names in (["remark"], ["remark", "adult"], COLUMNS):
            want = len(rows_where(lambda r: not every(blank(r[n]) for n in names)))
            assert count(base, {"kind": "drop_empty_rows", "columns": names, "mode": mode}) == want


def test_column_steps(base):
    assert run(base, {"kind": "select_columns", "columns": ["seen", "ring", "seen"]}).visible().columns == ["seen", "ring"]
    assert run(base, {"kind": "drop_columns", "columns": ["ring", "adult"]}).visible().columns == ["species", "grams", "seen", "remark"]


def renaming(**mapping):
    return {"kind": "rename_columns", "mapping": [{"from": a, "to": b} for a, b in mapping.items()]}


def test_rename(base):
    swapped = run(base, renaming(ring="remark", remark="ring")).visible()
    assert swapped.columns == ["remark", "species", "grams", "seen", "adult", "ring"]
    assert swapped.where("remark = 'M1' AND ring LIKE '%worn'").count() == 1
    odd = 'weight `in` "g".'
    assert run(base, renaming(grams=odd), keep(cond(odd, "less_than", value=10))).visible().count() == 1
    assert run(base, renaming(grams="RING")).visible().columns[:3] == ["ring", "species", "RING"]
    for bad in ({"grams": "ring"}, {"grams": " "}, {"wing": "x"}):
        with pytest.raises(RecipeError):
            run(base, renaming(**bad))


def sort(*pairs):
    return {"kind": "sort", "by": [{"column": c, "direction": d} for c, d in pairs]}


@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_sort(base, direction):
    known = sorted((r[2] for r in ROWS if r[2] is not None), reverse=direction == "desc")
    assert column(run(base, sort(("grams", direction)), ordered=True), "grams") == [*known, None]
    rings = [r[0] for r in sorted(ROWS, key=lambda r: (r[4] is None, not r[4] if r[4] is not None else 0))]
    assert column(run(base, sort(("adult", "desc")), ordered=True), "ring") == rings


def test_sort_outlives_later_steps(base):
    order = [r[0] for r in sorted(ROWS, key=lambda r: (r[2] is None, r[2]))]
    steps = (sort(("grams", "asc")), {"kind": "cast", "column": "grams", "to": "text"}, {"kind": "select_columns", "columns": ["ring"]})
    assert column(run(base, *steps, ordered=True), "ring") == order
    assert column(run(base, *steps, sort(("ring", "desc")), ordered=True), "ring") == sorted(order, reverse=True)
    as_text = column(run(base, steps[1], sort(("grams", "asc")), ordered=True), "grams")
    assert as_text == [*sorted(str(r[2]) for r in ROWS if r[2] is not None), None]


def test_casts(spark):
    rows = [("R$ 1.234,56", "01/09/2026", " SIM ", "2026-1-5"), ("abc", "31/02/2026", "não", "2026/01/05 10:30"),
            ("12d", "1/9/2026", "talvez", "2026"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "n string, d string, b string, i string").coalesce(1)
    steps = [
        {"kind": "cast", "column": "n", "to": "number"},
        {"kind": "cast", "column": "d", "to": "date", "format": "%d/%m/%Y"},
        {"kind": "cast", "column": "b", "to": "boolean"},
        {"kind": "cast", "column": "i", "to": "date"},
    ]
    frame = recipes.run(df, {"steps": steps})
    out = [tuple(r) for r in frame.visible().collect()]
    assert out == [
        (1234.56, D(2026, 9, 1), True, D(2026, 1, 5)),
        (None, None, False, D(2026, 1, 5, 10, 30)),
        (None, D(2026, 9, 1), None, None),
        (None, None, None, None),
    ]
    assert [c.type for c in frame.schema.columns] == ["number", "date", "boolean", "date"]
    spelled = {"kind": "cast", "column": "d", "to": "date", "format": "DD/MM/YYYY"}
    assert recipes.run(df, {"steps": [spelled]}).visible().where("d is not null").count() == 2


def test_cast_to_number_leaves_numbers_alone(base):
    assert column(run(base, {"kind": "cast", "column": "grams", "to": "number"}, ordered=True), "grams") == [r[2] for r in ROWS]


def replacing(mode, *pairs):
    return {"kind": "replace_values", "column": "species", "mode": mode, "replacements": [{"from": a, "to": b} for a, b in pairs]}


def test_replace(base):
    chain = replacing("exact", ("Robin", "Wren"), ("Wren", "small bird"), (" wren", "Wren"))
    assert column(run(base, chain, ordered=True), "species") == [
        "small bird", "Wren", "Heron", "small bird", "robin", "Owl_barn", None, "Heron", "small bird"]
    parts = replacing("contains", ("ro", "RO"), ("RO", "-"), ("_", " "))
    assert column(run(base, parts, ordered=True), "species") == [
        "Robin", "wren ", "He-n", "Robin", "-bin", "Owl barn", None, "He-n", "Wren"]
    long = replacing("exact", *((f"v{i}", f"v{i + 1}") for i in range(200)))
    assert count(base, long) == len(ROWS)
    with pytest.raises(RecipeError):
        run(base, replacing("regex", ("a", "b")))


def test_fill(base):
    filled = {"kind": "fill_empty", "column": "remark", "value": "?"}
    assert column(run(base, filled, ordered=True), "remark") == [r[5] if (r[5] or "").strip(" ") else "?" for r in ROWS]
    assert count(base, filled, keep(cond("remark", "is_empty"))) == 0
    assert column(run(base, {"kind": "fill_empty", "column": "grams", "value": "1,5"}, ordered=True), "grams")[6] == 1.5
    assert column(run(base, {"kind": "fill_empty", "column": "seen", "value": "2030-01-02"}, ordered=True), "seen")[5] == D(2030, 1, 2)


def test_chain(base):
    steps = (keep(cond("grams", "less_than", value=1500)), {"kind": "drop_duplicates", "columns": ["ring"]},
             {"kind": "select_columns", "columns": ["grams", "ring"]}, sort(("grams", "desc")))
    want = sorted({(r[2], r[0]) for r in ROWS if r[2] is not None and r[2] < 1500}, reverse=True)
    assert [tuple(r) for r in run(base, *steps).ordered().collect()] == want


@pytest.mark.parametrize("partitions", [1, 8])
def test_result_does_not_depend_on_partitions(spark, sf, partitions):
    df = spark.read.parquet(f"{sf}/orders.parquet").repartition(partitions)
    steps = [
        {"kind": "drop_duplicates", "columns": ["o_custkey"], "keep": "first"},
        {"kind": "sort", "by": [{"column": "o_orderpriority"}]},
    ]
    frame = recipes.run(df, {"steps": steps}, order_by=["o_orderkey"])
    got = [r["o_orderkey"] for r in access.page(frame, 2, 20).collect()]
    rows = sorted(spark.read.parquet(f"{sf}/orders.parquet").collect(), key=lambda r: r["o_orderkey"])
    firsts = {}
    for row in rows:
        firsts.setdefault(row["o_custkey"], row)
    ranked = sorted(firsts.values(), key=lambda r: (r["o_orderpriority"], r["o_orderkey"]))
    assert got == [r["o_orderkey"] for r in ranked[20:40]]


# --- metrics ---------------------------------------------------------------

def measured(base, wanted, *steps, **options):
    rows = metrics.compute(run(base, *steps), wanted, **options).collect()
    return {r["id"]: (r["value"], r["error"]) for r in rows}


NUMBERS = ("sum", "avg", "min", "max", "median")
ALL = [{"id": o, "operation": o, "column": "grams"} for o in NUMBERS] + [
    {"id": "n", "operation": "count"}, {"id": "d", "operation": "count_distinct", "column": "species"},
    {"id": "e", "operation": "count_empty", "column": "remark"}, {"id": "p", "operation": "percentage"},
]


def plain(rows):
    grams = [r["grams"] for r in rows if r["grams"] is not None]
    blank = [not (r["remark"] or "").strip(" ") for r in rows]
    numbers = dict(zip(NUMBERS, (sum(grams), sum(grams) / len(grams), min(grams), max(grams), median(grams)), strict=True)) if grams else dict.fromkeys(NUMBERS)
    return numbers | {"n": len(rows), "d": len({r["species"] for r in rows} - {None}), "e": sum(blank) if rows else None, "p": 100 * len(rows) / len(ROWS)}


@pytest.mark.parametrize("case", [None, 0, 10, 33])
def test_metrics(base, case):
    tree, test = CASES[case] if case is not None else (group(), lambda r: True)
    got = {k: v for k, (v, _) in measured(base, ALL, keep(tree)).items()}
    assert got == pytest.approx(plain(rows_where(test)))


def test_sum_beyond_64_bits(spark):
    df = spark.createDataFrame([(2**63 - 5,), (2**63 - 7,)], "id long")
    got = measured(df, [{"id": "s", "operation": "sum", "column": "id"}, {"id": "n", "operation": "count"}])
    assert got == {"s": (float(2**64 - 12), None), "n": (2.0, None)}


def test_a_bad_metric_leaves_the_others_alone(base):
    wanted = [{"id": "t", "operation": "avg", "column": "species"}, {"id": "g", "operation": "max", "column": "wing"},
              {"id": "d", "operation": "median", "column": "seen"}, {"id": "n", "operation": "count"}]
    got = measured(base, wanted)
    assert got.pop("n") == (len(ROWS), None)
    assert all(value is None and error for value, error in got.values())


def test_labels_and_suggestions(base):
    row = metrics.compute(run(base), [{"id": "a", "operation": "sum", "column": "grams", "format": "integer"}]).first()
    assert (row["label"], row["format"]) == ("Soma de grams", "integer")
    kinds = lambda types: [(m["operation"], m.get("column")) for m in metrics.suggest(schema_of(base, types))]
    assert kinds(TYPES) == [("count", None)]
    assert kinds(TYPES | {"grams": "currency"}) == [("count", None), ("sum", "grams"), ("avg", "grams")]


def test_metrics_of_a_group_that_lost_all_rows(base):
    frame = run(base, keep(cond("grams", "less_than", value=10)), group_by=["adult"])
    rows = metrics.compute(frame, [{"id": "p", "operation": "percentage"}, {"id": "n", "operation": "count"}])
    got = {(r["adult"], r["id"]): r["value"] for r in rows.collect()}
    assert got == pytest.approx({(True, "p"): 0, (True, "n"): 0, (False, "p"): 100 / 3, (False, "n"): 1, (None, "p"): 0, (None, "n"): 0})


# --- pages, search, values -------------------------------------------------

@pytest.mark.parametrize("near", [True, False])
def test_pages(base, monkeypatch, near):
    if not near:
        monkeypatch.setattr(access, "TOP_PAGES", 0)
    frame = run(base, sort(("grams", "asc")), ordered=True)
    order = [r[0] for r in sorted(ROWS, key=lambda r: (r[2] is None, r[2]))]
    for number in (1, 2, 3, 4):
        assert [r["ring"] for r in access.page(frame, number, 4).collect()] == order[4 * number - 4 : 4 * number]
    assert access.total_rows(frame).first()[0] == len(ROWS)
    with pytest.raises(RecipeError):
        access.page(frame, 1, access.MAX_PAGE + 1)


@pytest.mark.parametrize("near", [True, False])
def test_pages_whose_keys_tie(spark, monkeypatch, near):
    if not near:
        monkeypatch.setattr(access, "TOP_PAGES", 0)
    rows = [(i % 4, i // 8, "same") for i in range(40)]
    df = spark.createDataFrame(rows, "k int, v int, s string").repartition(5)
    frame = recipes.run(df, {"steps": []}, order_by=["k"])
    pages = [[tuple(r) for r in access.page(frame, n, 7).collect()] for n in range(1, 7)]
    assert [r for p in pages for r in p] == sorted(rows)


def test_search(base):
    frame = run(base, ordered=True)
    found = lambda text, **more: [r["ring"] for r in access.search(frame, text, **more).visible().collect()]
    assert found("OWL_BARN 310.75") == ["P2"] and found("50%") == ["M1"] and found("heron 1455.0 2031-12-24 18:00") == ["P5"]
    assert found("r_n", wildcards=False) == [] and set(found("h_ron", wildcards=True)) == {"M1", "P5"}


def test_column_values(base):
    got = [tuple(r) for r in access.column_values(base, "species", types=TYPES).collect()]
    assert got == [("Heron", 2), ("Robin", 2), ("Owl_barn", 1), ("Wren", 1), ("robin", 1), ("wren ", 1)]
    assert [r["value"] for r in access.column_values(base, "species", "WREN", limit=1, types=TYPES).collect()] == ["Wren"]


def test_preview(base):
    shown = access.preview(run(base, keep(HERON), ordered=True), ALL[:1], 1, 1, text="worn")
    assert [r["ring"] for r in shown.rows.collect()] == ["M1"]
    assert (shown.total_rows.first()[0], shown.input_rows.first()[0]) == (1, len(ROWS))
    assert shown.rows.first()["seen"] == "2030-11-30T23:59:59"
    assert [r["value"] for r in shown.metrics.collect()] == [3075.0]


def test_referenced_columns():
    steps = [
        keep(group(HERON, group(cond("adult", "is_true"), HERON, logic="OR"))), renaming(seen="day", ring="mark"), sort(("day", "asc"), ("mark", "desc")),
        {"kind": "fill_empty", "column": "remark", "value": "-"}, {"kind": "drop_duplicates", "columns": ["mark", "sex"]},
    ]
    recipe = {"version": 1, "steps": steps, "metrics": [{"id": "a", "operation": "max", "column": "grams"}, {"id": "b", "operation": "count"}]}
    assert recipes.referenced_columns(recipe) == ["species", "adult", "seen", "ring", "day", "mark", "remark", "sex", "grams"]
