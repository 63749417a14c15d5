"""Type inference on a greenhouse's notebook, one text column at a time."""

from datetime import datetime as D

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyloom.model import METADATA_KEY
from tidyloom.operators.infer import coerce, infer

#: Column: its cells, the type they should get, and the values.
CASES = {
    "Custo do adubo": (["R$ 12,90", "R$ 3.400,05", "R$ 0,10"], "currency", [12.9, 3400.05, 0.1]),
    "folhas": (["2.310,5", "41", "7.000"], "number", [2310.5, 41.0, 7000.0]),
    "raizes": (["7,020.25", "3.5"], "number", [7020.25, 3.5]),
    "sementes": (["9,876.5", "4,321"], "number", [9876.5, 4321.0]),
    "Saldo da estufa": (["(87,20)", "19,00", "(2.000,00)"], "currency", [-87.2, 19.0, -2000.0]),
    "vasos": (["3", "44", "505"], "number", [3.0, 44.0, 505.0]),
    "Preço da muda": (["6.75", "8.00"], "currency", [6.75, 8.0]),
    "altura": ([f"{i * 3},2" for i in range(10, 21)] + ["sem medida"], "number", [i * 3 + 0.2 for i in range(10, 21)] + [None]),
    "canteiro": (["norte-2", "sul-9", "8"], "text", ["norte-2", "sul-9", "8"]),
    "plantio": (["28/02/2031", "5/11/2030"], "date", [D(2031, 2, 28), D(2030, 11, 5)]),
    "poda": (["2029-12-31", "2030-01-02"], "date", [D(2029, 12, 31), D(2030, 1, 2)]),
    "rega": (["17/06/2030 06:05:04"], "date", [D(2030, 6, 17, 6, 5, 4)]),
    "rega curta": (["17/06/2030 06:05"], "date", [D(2030, 6, 17, 6, 5)]),
    "sensor": (["2030-06-17T23:59:58"], "date", [D(2030, 6, 17, 23, 59, 58)]),
    "colheita": (["3-4-2030"], "date", [D(2030, 4, 3)]),
    "embalagem": (["30.11.2030"], "date", [D(2030, 11, 30)]),
    "antigo": (["12/12/71", "12/12/31"], "date", [D(1971, 12, 12), D(2031, 12, 12)]),
    "nunca": (["30/02/2030"], "text", ["30/02/2030"]),
    "nota": (["murcha", "--", "n/a", "Não informado", " "], "text", ["murcha", None, None, None, None]),
    "vazia": ([" ", None, "null"], "empty", [None, None, None]),
    "praga": (["\tpulgão ", "pulgão"], "text", ["pulgão", "pulgão"]),
    "floriu": (["n", "SIM", "Verdadeiro", "Não"], "boolean", [False, True, True, False]),
    "zeros": (["1", "0", "0"], "number", [1.0, 0.0, 0.0]),
    "frete": (["€ 7", "12"], "currency", [7.0, 12.0]),
    "lote": (["0017", "2040", "0003"], "text", ["0017", "2040", "0003"]),
    "etiqueta": (["9" * 31, "8" * 31], "text", ["9" * 31, "8" * 31]),
    "umidade": (["0,05", "0,61"], "number", [0.05, 0.61]),
    "mistura": (["40R", "41"], "text", ["40R", "41"]),
    "literal": (["6f", "3_000"], "text", ["6f", "3_000"]),
}


@pytest.fixture(scope="module")
def typed(spark):
    """All cases side by side in one table, so that inference takes one job."""
    height = max(len(cells) for cells, _, _ in CASES.values())
    rows = [(i, *(cells[i] if i < len(cells) else None for cells, _, _ in CASES.values())) for i in range(height)]
    schema = T.StructType([T.StructField("__tl_n", T.IntegerType()), *(T.StructField(h, T.StringType()) for h in CASES)])
    return coerce(spark.createDataFrame(rows, schema))


def test_types(typed):
    kinds = {f.name: f.metadata[METADATA_KEY] for f in typed.schema.fields if f.metadata}
    assert kinds == {header: kind for header, (_, kind, _) in CASES.items()}


def test_values(typed):
    rows = typed.orderBy("__tl_n").collect()
    for header, (cells, _, expected) in CASES.items():
        assert [r[header] for r in rows][: len(cells)] == pytest.approx(expected, abs=1e-9) if isinstance(expected[0], float) and None not in expected \
            else [r[header] for r in rows][: len(cells)] == expected, header


def test_compat_reads_ambiguous_cells_with_a_comma(spark):
    df = spark.createDataFrame([("9,876.5",), ("4,321",)], "v string")
    assert (infer(df)["v"].decimal, infer(df, compat=True)["v"].decimal) == (".", ",")


def test_native_types_are_kept(spark):
    df = spark.range(2).select(
        F.col("id").alias("vasos"), F.lit(2.5).cast("decimal(9,2)").alias("Custo"), F.lit("2030-06-17").cast("date").alias("dia"), (F.col("id") > 0).alias("ok"),
    )
    assert [s.type for s in infer(df).values()] == ["number", "currency", "date", "boolean"]
    assert [f.dataType.simpleString() for f in coerce(df).schema.fields] == ["double", "double", "timestamp_ntz", "boolean"]


def test_exact_money(spark):
    out = coerce(spark.createDataFrame([("R$ 0,30",), ("R$ 9.000,75",)], "Custo string"), decimal_scale=2)
    assert out.schema["Custo"].dataType == T.DecimalType(38, 2)
    assert [str(r[0]) for r in out.collect()] == ["0.30", "9000.75"]


def test_late_cells_decide_too(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2500, F.col("id").cast("string")).otherwise("abc").alias("v"))
    assert infer(df)["v"].type == "text"


def test_types_survive_parquet(spark, tmp_path):
    from tidyloom.model import schema_of
    from tidyloom.plans.ingest import ingest

    saved, _ = ingest(spark, spark.createDataFrame([("R$ 7,25", "n/a"), ("R$ 1,00", "-")], "x string, y string"), str(tmp_path / "out"))
    assert [c.type for c in schema_of(saved).columns] == ["currency", "empty"]
