"""Admitting folders of files and reading delimited text."""

import io
import struct
import zipfile

import pytest

from tidyloom.errors import SourceError
from tidyloom.operators import access, profile
from tidyloom.plans import recipe as recipes
from tidyloom.plans.ingest import ingest
from tidyloom.sources import admission, delimited
from tidyloom.sources.headers import normalize_headers

def archive(entries: int, size: int = 10) -> bytes:
    """Archive with many small members."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for i in range(entries):
            z.writestr(f"xl/worksheets/part-of-a-long-name-{i:08d}.xml", b"x" * size)
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("files")
    (base / "a.csv").write_bytes("Documento;Valor;Data\nA1;R$ 1.234,56;01/09/2026\nA2;10,00\nA3;5,00;02/09/2026;sobra\n".encode("utf-8-sig"))
    (base / "b.csv").write_bytes("Documento;Valor;Data\nAção;7,00;03/09/2026\n".encode("cp1252"))
    (base / "copy.csv").write_bytes((base / "b.csv").read_bytes())
    (base / "c.csv").write_bytes(b'nome,texto\n1,"linha um\nlinha dois; ""x"""\n2,b\n')
    (base / "fake.csv").write_bytes(b"PK\x03\x04 not text")
    (base / "zero.csv").write_bytes(b"a;b\n1;\x00\n")
    (base / "fake.xlsx").write_bytes(b"a;b\n1;2\n")
    (base / "empty.csv").write_bytes(b"")
    (base / "notes.txt").write_bytes(b"hello")
    (base / "book.xlsx").write_bytes(archive(3))
    bomb = io.BytesIO()
    with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", b"0" * 5_000_000)
    (base / "bomb.xlsx").write_bytes(bomb.getvalue())
    (base / "big.csv").write_bytes(b"a;b\n" + b"1;2\n" * 5000)
    return base


def test_headers():
    assert normalize_headers([" a ", "", None, "__UNNAMED_3", "a", "a"]) == [
        "a", "Coluna 2", "Coluna 3", "Coluna 4", "a (2)", "a (3)",
    ]
    assert normalize_headers(["Valor", "Valor (2)", "Valor"]) == ["Valor", "Valor (2)", "Valor (3)"]


def test_admission(spark, folder):
    rows = admission.admit(spark, str(folder), max_bytes=15_000).collect()
    seen = {r["path"].rsplit("/", 1)[1]: r for r in rows}
    assert {n for n, r in seen.items() if r["ok"]} == {"a.csv", "b.csv", "copy.csv", "c.csv", "book.xlsx"}
    assert seen["big.csv"]["reason"] == "file is too large"
    assert seen["empty.csv"]["reason"] == "file is empty"
    assert seen["notes.txt"]["reason"] == "extension is not supported"
    assert seen["bomb.xlsx"]["ratio"] > 150 and "compressed" in seen["bomb.xlsx"]["reason"]
    for name in ("fake.csv", "zero.csv", "fake.xlsx"):
        assert seen[name]["reason"] == "content does not match the extension"
    assert (seen["a.csv"]["encoding"], seen["a.csv"]["separator"]) == ("UTF-8", ";")
    assert (seen["b.csv"]["encoding"], seen["b.csv"]["separator"]) == ("windows-1252", ";")
    assert seen["c.csv"]["separator"] == ","
    assert seen["a.csv"]["header"] == "Documento;Valor;Data"


def test_encoding_of_a_sample_cut_inside_a_character(spark, tmp_path):
    (tmp_path / "long.csv").write_bytes(("a;b\n" + "ç;ã\n" * 20_000).encode("utf-8"))
    assert admission.admit(spark, str(tmp_path)).first()["encoding"] == "UTF-8"


@pytest.mark.parametrize("text, sign", [
    ("a;b;c\n1;2;3\n", ";"), ("a\tb\n1\t2\n", "\t"), ("a|b\n1|2\n", "|"), ("coluna\nx\n", ","),
    ("n;v\n1;2,5\n2;3,75\n", ";"), ('a,b\n"x;y;z",1\n"p;q;r",2\n', ","), ("a;b\n1;2\n\n3;4;5\n", ";"),
])
def test_separators(spark, text, sign):
    files = spark.createDataFrame([("f.csv", len(text), bytearray(text.encode()))], "path string, length long, content binary")
    assert admission.admit_contents(files).first()["separator"] == sign


def test_last_byte_tells_the_encoding(spark, tmp_path):
    for name, end in (("w", b"\xe7"), ("u", "ç".encode()), ("l", b"\x81")):
        (tmp_path / f"{name}.csv").write_bytes(b"a;b\n" + b"1;2\n" * 60_000 + b"3;" + end)
    rows = admission.admit(spark, str(tmp_path)).collect()
    assert {r["path"][-5]: r["encoding"] for r in rows} == {"w": "windows-1252", "u": "UTF-8", "l": "ISO-8859-1"}
    late = {layout.encoding: df for layout, df in delimited.scan_folder(spark, str(tmp_path))}
    assert late["windows-1252"].where("a = '3'").first()["b"] == "ç"


def test_zero_byte_far_into_a_file(spark, tmp_path):
    (tmp_path / "z.csv").write_bytes(b"a;b\n" + b"1;2\n" * 60_000 + b"\x00\n")
    assert admission.admit(spark, str(tmp_path)).first()["reason"] == "content does not match the extension"
    with pytest.raises(SourceError, match="z.csv"):
        delimited.scan_folder(spark, str(tmp_path))
    assert delimited.scan_folder(spark, str(tmp_path), refused="skip") == []


def test_limit_names_what_it_refuses(spark, tmp_path):
    (tmp_path / "n.csv").write_bytes(b"a;b\n" + b"1;2\n" * 5000)
    (_, df), = delimited.scan_folder(spark, str(tmp_path))
    assert df.count() == 5000
    with pytest.raises(SourceError, match="too large"):
        delimited.scan_folder(spark, str(tmp_path), max_bytes=1000)


def test_header_with_a_line_end_in_quotes(spark, tmp_path):
    (tmp_path / "h.csv").write_bytes('"first\nname";"say ""hi""";b\n1;2;3\n'.encode("utf-8-sig"))
    (layout, df), = delimited.scan_folder(spark, str(tmp_path))
    assert layout.columns == ["first\nname", 'say "hi"', "b"] and [tuple(r) for r in df.collect()] == [("1", "2", "3")]


def test_long_directory_of_an_archive(spark, tmp_path):
    (tmp_path / "many.xlsx").write_bytes(archive(15_000, 1))
    (tmp_path / "cut.xlsx").write_bytes(archive(3)[:-30])
    rows = {r["path"].rsplit("/", 1)[1]: r for r in admission.admit(spark, str(tmp_path)).collect()}
    assert rows["many.xlsx"]["ok"] and rows["cut.xlsx"]["reason"] == "archive is damaged"


def test_repeated_files(spark, folder):
    rows = admission.repeated_files(admission.list_files(spark, str(folder))).collect()
    assert [(r["path"].rsplit("/", 1)[1], r["first_path"].rsplit("/", 1)[1]) for r in rows] == [("copy.csv", "b.csv")]


def test_folder_of_text_files(spark, folder):
    found = {(l.encoding, tuple(l.columns), l.multiline): df for l, df in delimited.scan_folder(spark, str(folder), refused="skip", max_bytes=15_000)}
    assert set(found) == {
        ("UTF-8", ("Documento", "Valor", "Data"), False), ("windows-1252", ("Documento", "Valor", "Data"), False),
        ("UTF-8", ("nome", "texto"), True),
    }
    rows = [tuple(r) for r in found["UTF-8", ("Documento", "Valor", "Data"), False].collect()]
    assert rows == [("A1", "R$ 1.234,56", "01/09/2026"), ("A2", "10,00", None), ("A3", "5,00", "02/09/2026")]
    latin = found["windows-1252", ("Documento", "Valor", "Data"), False]
    assert [r["Documento"] for r in latin.collect()] == ["Ação", "Ação"]
    texts = [r["texto"] for r in found["UTF-8", ("nome", "texto"), True].collect()]
    assert texts == ['linha um\nlinha dois; "x"', "b"]


def test_text_files_keep_their_order(spark, tmp_path):
    (tmp_path / "n.csv").write_text("n;g\n" + "".join(f"{i};{i % 3}\n" for i in range(50_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        df = delimited.scan_delimited(spark, str(tmp_path / "n.csv"), ["n", "g"], ";", multiline=False)
        assert df.rdd.getNumPartitions() > 4
        frame = recipes.run(df, {"steps": [{"kind": "drop_duplicates", "columns": ["g"]}]})
        assert sorted(r["n"] for r in frame.visible().collect()) == ["0", "1", "2"]
        frame = recipes.run(df, {"steps": []}, ordered=True)
        assert [r["n"] for r in access.page(frame, 90, 500).collect()] == [str(i) for i in range(44_500, 45_000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_damaged_directories():
    assert admission.directory_sizes(b"PK\x01\x02 cut") == (None, None)
    assert admission.directory_sizes(b"") == (None, None)


def test_archive_of_three_gigabytes_is_read_by_its_directory(spark, tmp_path):
    """A hole of 3 GiB in front of the archive, and one whose member needs sizes of 64 bits."""
    inner = archive(3)
    with open(tmp_path / "hole.xlsx", "wb") as f:
        f.write(b"PK\x03\x04")
        f.seek(3 * 1024**3)
        f.write(inner)
    name = b"xl/a.xml"
    wide = struct.pack("<HHQQ", 1, 16, 6 * 1024**3, 5 * 1024**3)
    entry = struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 45, 45, 0, 8, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(wide), 0, 0, 0, 0, 0) + name + wide
    end = struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, 1, 1, len(entry), 4, 0)
    (tmp_path / "wide.xlsx").write_bytes(b"PK\x03\x04" + entry + end)
    record = struct.pack("<4sQ2H2I4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, 3, 3, len(entry), 4)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, 4 + len(entry), 1)
    end = struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    (tmp_path / "very wide.xlsx").write_bytes(b"PK\x03\x04" + entry + record + locator + end)
    rows = {r["path"].rsplit("/", 1)[1]: r for r in admission.admit(spark, str(tmp_path)).collect()}
    assert rows["hole.xlsx"]["ok"] and rows["hole.xlsx"]["length"] > 3 * 1024**3
    for name in ("wide.xlsx", "very wide.xlsx"):
        assert rows[name]["reason"] == "archive is too large when expanded" and rows[name]["ratio"] == 6 / 5


def test_long_text_file_needs_no_whole_reader(spark, tmp_path):
    (tmp_path / "long.csv").write_bytes(b"a;b\n" + b"1;2\n" * 5000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        assert admission.admit(spark, str(tmp_path)).first()["ok"]
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_refused_ingest_leaves_the_place_free(spark, tmp_path):
    raw = spark.createDataFrame([("1", "x")], "a string, b string")
    with pytest.raises(SourceError, match="no rows"):
        ingest(spark, raw.limit(0), str(tmp_path / "d"))
    saved, _ = ingest(spark, raw, str(tmp_path / "d"))
    assert [tuple(r) for r in saved.collect()] == [(1.0, "x")]


def test_all_top_values_are_texts(spark):
    rows = [("long " * 30 + str(i % 3), "short") for i in range(9)]
    got = profile.top_values(spark.createDataFrame(rows, "a string, b string"), limit=None).collect()
    assert {(r.name, r.value, r["count"]) for r in got} == {("a", "long " * 30 + str(i), 3) for i in range(3)} | {("b", "short", 9)}
