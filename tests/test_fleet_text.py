"""Recipes on text files that differ in layout, columns and ways to write cells."""

from datetime import datetime

import pytest

from tidyloom.errors import SourceError
from tidyloom.model import schema_of
from tidyloom.operators import fleet
from tidyloom.operators.infer import Strategy
from tidyloom.sources.records import read_records
from tidyloom.streaming import reapply as streaming

RECIPE = {
    "steps": [
        {"kind": "filter", "filter": {"type": "group", "logic": "AND", "children": [
            {"type": "condition", "column": "Valor", "operator": "greater_than", "value": "10,00"}]}},
        {"kind": "drop_duplicates", "columns": ["Cliente"], "keep": "first"},
    ],
    "metrics": [{"id": "s", "operation": "sum", "column": "Valor"}],
}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "br.csv").write_bytes("Cliente;Valor;Dia\nAna;R$ 1.234,56;31/12/2024\nAna;20,00;01/02/2025\nBia;5,00;\n".encode("cp1252"))
    (tmp_path / "us.csv").write_bytes(b'Dia,Valor,Cliente,Extra\n2024-12-31,"1,234.56","Ana","two\nlines"\n2025-02-01,11.5,Caio,x\n')
    (tmp_path / "none.csv").write_bytes(b"Cliente|Valor\nDudu|\n")
    return tmp_path


def rows_of(frame):
    rows = frame.df.select(*frame.schema.names, frame.group[0]).collect()
    return sorted((tuple(r)[-1].rsplit("/", 1)[1], *tuple(r)[:-1]) for r in rows)


def test_each_file_is_typed_by_its_own_cells(spark, folder):
    frame = fleet.reapply_text(spark, RECIPE, str(folder), columns=["Cliente", "Valor", "Dia", "Extra"])
    assert {c.name: c.type for c in schema_of(frame.df.select(*frame.schema.names)).columns} == {
        "Cliente": "text", "Valor": "currency", "Dia": "date", "Extra": "text",
    }
    assert rows_of(frame) == [
        ("br.csv", "Ana", 1234.56, datetime(2024, 12, 31), None),
        ("us.csv", "Ana", 1234.56, datetime(2024, 12, 31), "two\nlines"), ("us.csv", "Caio", 11.5, datetime(2025, 2, 1), "x"),
    ]
    totals = {r["source"].rsplit("/", 1)[1]: r["value"] for r in fleet.metrics_by_source(frame, RECIPE).collect()}
    assert totals == {"br.csv": 1234.56, "us.csv": 1246.06}


def test_files_that_disagree_on_a_type(spark, folder):
    (folder / "odd.csv").write_bytes(b"Cliente;Valor\nEva;much\nFabi;little\n")
    with pytest.raises(SourceError, match='odd.csv .*"Valor" is text, in most files number'):
        fleet.reapply_text(spark, RECIPE, str(folder))
    assert {r[0] for r in rows_of(fleet.reapply_text(spark, RECIPE, str(folder), refused="skip"))} == {"br.csv", "us.csv"}
    forced = fleet.reapply_text(spark, {"steps": []}, str(folder), columns=["Valor"], types={"Valor": "text"})
    assert ("odd.csv", "much") in rows_of(forced) and ("br.csv", "R$ 1.234,56") in rows_of(forced)


def test_strategies_of_an_earlier_file(spark, folder):
    kept = {"Cliente": Strategy("text"), "Valor": Strategy("number", decimal=",")}
    frame = fleet.reapply_text(spark, {"steps": []}, str(folder), strategies=kept)
    assert ("us.csv", "Ana", 1.23456) in rows_of(frame)


def test_too_many_different_columns(spark, tmp_path):
    (tmp_path / "w.csv").write_text("a;b;c;d\n1;2;3;4\n")
    found = read_records(spark, str(tmp_path))
    with pytest.raises(SourceError, match="more than 3"):
        fleet.typed_records(found, max_columns=3)
    assert fleet.typed_records(found, ["d", "missing"]).select("d", "missing").first()[:] == (4.0, None)


def test_arriving_files_of_any_layout(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    (folder / "bad.csv").write_bytes(b"Cliente;Valor\nx;\x00\n")
    types = {"Cliente": "text", "Valor": "currency", "Dia": "date"}
    arriving = streaming.read_arriving_lines(spark, str(folder), files_per_batch=2)
    streaming.reapply_arriving_text(arriving, RECIPE, out, f"{out}/state", columns=list(types), types=types, once=True).awaitTermination()
    rows = spark.read.parquet(f"{out}/rows").collect()
    assert sorted((r.Cliente, r.Valor, r.Dia) for r in rows) == [
        ("Ana", 1234.56, datetime(2024, 12, 31)), ("Ana", 1234.56, datetime(2024, 12, 31)), ("Caio", 11.5, datetime(2025, 2, 1)),
    ]
    assert [r.source.rsplit("/", 1)[1] for r in spark.read.parquet(f"{out}/refused").collect()] == ["bad.csv"]
    assert {r.id for r in spark.read.parquet(f"{out}/metrics").collect()} == {"s"}


def test_waiting_batches_are_read_by_one_plan(spark, tmp_path, monkeypatch):
    """Each batch of two files took a dozen plans of its own. An interrupted run loses and doubles nothing."""
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for i in range(6):
        (folder / f"f{i}.csv").write_text("Cliente;Valor\n" + "".join(f"c{k % 3};{10 + i + k},50\n" for k in range(6)))
    judged, seen, fails = streaming.records.judged_files, [], [True]

    def counted(lines):
        seen.append(1)
        if fails:
            fails.pop()
            raise RuntimeError("lost")
        return judged(lines)

    monkeypatch.setattr(streaming.records, "judged_files", counted)
    types = {"Cliente": "text", "Valor": "currency"}

    def run():
        arriving = streaming.read_arriving_lines(spark, str(folder), files_per_batch=2)
        streaming.reapply_arriving_text(arriving, RECIPE, out, f"{out}/state", columns=list(types), types=types, once=True).awaitTermination()

    with pytest.raises(RuntimeError):
        run()
    (folder / "late.csv").write_text("Cliente;Valor\nx;1,00\n")
    run()
    assert len(seen) == 2 and not (tmp_path / "out" / "waiting").exists()
    run()
    rows = spark.read.parquet(f"{out}/rows").collect()
    assert len(rows) == 18 and {r.batch for r in rows} == {0, 1, 2}
    assert len({(r.source_file, r.Cliente) for r in rows}) == 18
    totals = {r.source.rsplit("/", 1)[1]: r.value for r in spark.read.parquet(f"{out}/metrics").collect()}
    assert totals == {f"f{i}.csv": 3 * (10.5 + i) + 3 for i in range(6)}
    assert spark.read.parquet(f"{out}/refused").count() == 0


def test_a_file_that_waits_twice(spark, tmp_path):
    """Each time it is a dataset of its own batch."""
    out = str(tmp_path)
    for batch, value in ((7, b"a;20,00"), (8, b"a;30,00")):
        lines = [("file:/a.csv", 0, 0, b"Cliente;Valor"), ("file:/a.csv", 0, 1, value)]
        spark.createDataFrame(lines, "source string, block long, row long, line binary").write.parquet(f"{out}/waiting/batch={batch}")
    types = {"Cliente": "text", "Valor": "currency"}
    streaming._reapply_waiting(spark, RECIPE, out, None, list(types), types)
    assert {(r.batch, r.Valor) for r in spark.read.parquet(f"{out}/rows").collect()} == {(7, 20.0), (8, 30.0)}
