"""Records of text files: states across lines and splits, cells, headers in any number."""

import csv
import io
import random

import pytest

from tidyloom.errors import SourceError
from tidyloom.sources import admission, records


def read(spark, *paths, **options):
    found = records.read_records(spark, *map(str, paths), **options)
    names = {r.source.rsplit("/", 1)[1]: r.names for r in found.headers.collect()}
    rows = {}
    for r in sorted(found.rows.collect(), key=lambda r: (r.source, r.block, r.row)):
        rows.setdefault(r.source.rsplit("/", 1)[1], []).append(r.cells)
    return names, rows


def plain(text, sep):
    rows = [[c or None for c in r] for r in csv.reader(io.StringIO(text), delimiter=sep) if any(c.strip() for c in r)]
    return rows[0], rows[1:]


@pytest.fixture
def small_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for key in keys:
        spark.conf.set(key, "300")
    yield
    for key in keys:
        spark.conf.unset(key)


def quoted(rng):
    words = ["a", "b;c", 'say "hi"', "x\ny", "", '"', "é;\n\n;", "plain text here", 'q"\n"q', ";", "\n"]
    return rng.choice(words) + rng.choice(["", "", "z"])


def test_quoted_line_ends_in_files_of_many_tasks(spark, tmp_path, small_splits):
    rng = random.Random(3)
    expected = {}
    for name, sep in (("a.csv", ";"), ("b.csv", ","), ("c.csv", "\t"), ("d.csv", "|")):
        out = io.StringIO()
        writer = csv.writer(out, delimiter=sep, lineterminator="\n")
        writer.writerow(["no", "text", "más"])
        for i in range(120):
            writer.writerow([f"r{i}", quoted(rng), quoted(rng)])
        (tmp_path / name).write_bytes(out.getvalue().encode())
        expected[name] = plain(out.getvalue(), sep)
    lines = records.text_lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() > 8
    assert lines.select("source", "block").distinct().count() > 20
    layouts = spark.createDataFrame(
        [(r.source, "UTF-8", {"a": ";", "b": ",", "c": "\t", "d": "|"}[r.source[-5]], True) for r in lines.select("source").distinct().collect()],
        "source string, encoding string, separator string, multiline boolean",
    )
    found = records.records(lines, layouts)
    for name, (head, rows) in expected.items():
        own = sorted((r for r in found.rows.collect() if r.source.endswith(name)), key=lambda r: (r.block, r.row))
        assert [r.cells for r in own] == [[c or None for c in r] for r in rows]
        assert [r.names for r in found.headers.collect() if r.source.endswith(name)] == [head]


def test_quotes_that_open_nothing(spark, tmp_path):
    text = 'part;size;note\npipe;5" long;x\n"two\nlines";6";"a;""b"""\nlast;7;"tail" more\n"";8;\n'
    (tmp_path / "q.csv").write_text(text)
    assert read(spark, tmp_path)[1]["q.csv"] == [
        ["pipe", '5" long', "x"], ["two\nlines", '6"', 'a;"b"'], ["last", "7", '"tail" more'], ["", "8", None],
    ]


def test_odd_files(spark, tmp_path):
    (tmp_path / "mark.csv").write_bytes("nome;valor\nAção;1\n".encode("utf-8-sig"))
    (tmp_path / "win.csv").write_bytes("nome;valor\r\nAção €;1\r\n\r\n".encode("cp1252"))
    (tmp_path / "latin.csv").write_bytes("nome;valor\nA\x81;é\n".encode("latin-1"))
    (tmp_path / "head.csv").write_bytes(b"only;header\n")
    (tmp_path / "twice.csv").write_bytes(b'"a\nb";;a;a\n1;2;3;4;5\n1\n')
    (tmp_path / "open.csv").write_bytes(b'a;b\n1;"never closed\n2;3\n')
    names, rows = read(spark, tmp_path)
    assert rows["mark.csv"] == [["Ação", "1"]] and names["mark.csv"] == ["nome", "valor"]
    assert rows["win.csv"] == [["Ação €", "1"]] and rows["latin.csv"] == [["A\x81", "é"]]
    assert names["head.csv"] == ["only", "header"] and "head.csv" not in rows
    assert names["twice.csv"] == ["a\nb", "Coluna 2", "a", "a (2)"] and rows["twice.csv"] == [["1", "2", "3", "4", "5"], ["1"]]
    assert rows["open.csv"] == [["1", '"never closed\n2;3']]


def test_refused_files_are_named_or_left_out(spark, tmp_path):
    (tmp_path / "ok.csv").write_bytes(b"a;b\n1;2\n")
    (tmp_path / "bad.csv").write_bytes(b"a;b\n1;\x00\n")
    with pytest.raises(SourceError, match="bad.csv"):
        read(spark, tmp_path)
    assert set(read(spark, tmp_path, refused="skip")[0]) == {"ok.csv"}


def test_thousands_of_headers_in_one_plan(spark, tmp_path):
    """The plan is the same for one file and for many with headers of their own."""
    for n in (1, 1200):
        folder = tmp_path / str(n)
        folder.mkdir()
        for i in range(n):
            (folder / f"f{i}.csv").write_text(f"key;own{i}\nk;{i}\n")
    plans, shown = [], []
    for n in (1, 1200):
        found = records.read_records(spark, str(tmp_path / str(n)))
        df = records.columns_of(found, ["key", "own0", "own7"])
        plans.append(df._jdf.queryExecution().optimizedPlan().toString().count("\n"))
        shown.append(df.select("key", "own0", "own7").collect())
    assert plans[0] == plans[1]
    assert len(shown[1]) == 1200 and {tuple(r) for r in shown[1]} == {("k", "0", None), ("k", None, "7"), ("k", None, None)}


def test_records_are_joined_and_split_once(spark, tmp_path):
    """Headers, types, rows and metrics read cells from a table; each used to join and split all lines again."""
    (tmp_path / "a.csv").write_text('a;b\n"x\ny";1\n')
    found = records.read_records(spark, str(tmp_path))
    plan = found.rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "split(" not in plan
    assert [r.cells for r in found.rows.collect()] == [["x\ny", "1"]]


def test_small_pieces_are_read_by_few_tasks_and_once(spark, tmp_path, monkeypatch):
    """Each piece of a file was a task of three scans, and so were the pieces of the tables made of them."""
    (tmp_path / "a.csv").write_text("n;t\n" + "".join(f'{i};"line\n{i}"\n' for i in range(20_000)))
    seen, placed = [], records.placed_lines
    monkeypatch.setattr(records, "placed_lines", lambda read: seen.append(read) or placed(read))
    monkeypatch.setattr(records, "admit", lambda *paths, lines, **more: seen.append(lines) or admission.admit(*paths, lines=lines, **more))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = records.read_records(spark, str(tmp_path), pieces="4k")
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    _, lines = seen
    assert lines.select("at.block").distinct().count() > 60
    assert len(lines.inputFiles()) <= 16 and all(f.endswith(".parquet") for f in lines.inputFiles())
    assert found.rows.count() == 20_000
    assert {r.cells[1] == f"line\n{r.cells[0]}" for r in found.rows.collect()} == {True}
