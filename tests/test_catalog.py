"""Every registered query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as contract
from catalog.registry import ORACLES, QUERIES
from tests.conftest import SF
from tidyloom.sources import delimited

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def plain(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else value


def rows_of(rows, order):
    return sorted(repr(tuple(plain(row[i]) for i in order)) for row in rows)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    first = contract.entry(spark).collect()
    assert len(first) > 10
    totals = [r["o_totalprice"] for r in first]
    assert totals == sorted(totals, reverse=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = rows_of(df.collect(), [df.columns.index(c) for c in columns])
    answer = duck.execute(ORACLES[name])
    names = [d[0] for d in answer.description]
    kinds = {d[0]: str(d[1]) for d in answer.description}
    assert sorted(names) == columns
    assert {f.name: KINDS[f.dataType.simpleString()] for f in df.schema.fields} == kinds
    assert got == rows_of(answer.fetchall(), [names.index(c) for c in columns])


@pytest.mark.parametrize("name, least", [("s_admission_mixed", 5), ("s_multiline_split", 3)])
def test_no_file_grows_with_the_table(spark, duck, name, least, tmp_path, monkeypatch):
    """Files are written in as many parts as the table is read in; one file a language, or two in all, were one task each."""
    monkeypatch.setattr("catalog.results._scratch", lambda spark: str(tmp_path / "files"))
    # Small shuffles would be written by one task.
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b"}
    settings = {"spark.sql.files.maxPartitionBytes": "120k", "spark.sql.files.openCostInBytes": "0", **small}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        df = QUERIES[name](spark, SF)
        got = rows_of(df.collect(), range(len(df.columns)))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert len(list((tmp_path / "files").rglob("*.csv"))) >= least
    columns = ", ".join(df.columns)
    assert got == rows_of(duck.execute(f"SELECT {columns} FROM ({ORACLES[name]})").fetchall(), range(len(df.columns)))


ODD_TEXTS = ["plain", "", None, " ", " lead", "trail \t", "\ttab", "\r", "a\r\nb", '"', '""', 'say "hi"', '"a";"b', ";", "x\\", '\\"', "#", "\x0b", "\x01", "y\u0085z", "é 😀", "null"]


@pytest.mark.parametrize("name", ["s_large_file", "s_multiline_split"])
def test_cells_of_any_text_survive_a_file(spark, tmp_path, name):
    """Empty texts were read as missing, and spaces at the ends of a text were not written."""
    langs = ["en", " en ", "", None, 'p"t', "d;e"]
    rows = [(i, text, langs[i % len(langs)]) for i, text in enumerate(ODD_TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES[name](spark, str(tmp_path))
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = sql.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})").fetchall()
    assert rows_of(df.collect(), range(len(df.columns))) == rows_of(expected, range(len(df.columns)))


def test_empty_and_missing_cells_of_a_file_differ(spark, tmp_path):
    (tmp_path / "n.csv").write_text('a;b\n1;""\n2;\n3;" "\n')
    (_, df), = delimited.scan_folder(spark, str(tmp_path))
    assert {tuple(r) for r in df.collect()} == {("1", ""), ("2", None), ("3", " ")}
