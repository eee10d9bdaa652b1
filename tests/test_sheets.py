"""Sheets of any delimiter, and rows that don't parse."""

import datetime

import pytest

from barloom.sources.sheets import BOM, delimiter_of, names_of, read_sheet

ROWS = [["2020-01-02", "A", "1.5", "note; with, all\tkinds|of marks"], ["2020-01-03", "B", "", "x"], ["2020-01-04", "Ngân", "-2", ""]]
TYPES = {"signal_date": "date", "SCORE": "double"}


def sheet(path, delimiter, mark="", extra=(), header="signal_date ticker score note"):
    quoted = lambda v: f'"{v}"' if any(c in v for c in ";,\t|") else v
    lines = [mark + delimiter.join(header.split()), *[delimiter.join(map(quoted, r)) for r in ROWS], *extra]
    path.write_text("\n".join(lines) + "\n\n", encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("delimiter", [";", ",", "\t", "|"])
@pytest.mark.parametrize("mark", ["", BOM])
def test_any_delimiter_reads_alike(spark, tmp_path, delimiter, mark):
    bad = [delimiter.join(["2020-01-05", "C", "high", "x"]), delimiter.join(["2020-01-05", "C"]), delimiter.join(["2020-01-05", "C", "1", "x", "y"]), "stray words"]
    found = read_sheet(spark, sheet(tmp_path / "s.csv", delimiter, mark, bad), TYPES)
    assert found.delimiter == delimiter and found.header == ["signal_date", "ticker", "score", "note"]
    assert [tuple(r) for r in found.rows.orderBy("signal_date").collect()] == [(datetime.date(2020, 1, 2), "A", 1.5, ROWS[0][3]), (datetime.date(2020, 1, 3), "B", None, "x"), (datetime.date(2020, 1, 4), "Ngân", -2.0, None)]
    assert sorted(r["line"] for r in found.rejected.collect()) == sorted(bad)
    assert found.rejected.first()["path"].endswith("s.csv")


def test_delimiters_of_heads():
    assert delimiter_of(["a;b", "1,5;2,5", "3,1;4"]) == ";"  # decimal commas
    assert delimiter_of(["a,b", '"x;y;z",1', "2,3"]) == ","
    assert delimiter_of(["one", "two"]) == "," and delimiter_of([]) == ","
    assert delimiter_of(["a|b|c", "1|2|3", "1,2|3|4"]) == "|"
    assert names_of(" a ,,A, b", ",") == ["a_0", "column_1", "A_2", "b"]


def test_files_of_a_folder_share_their_header(spark, tmp_path):
    for n in range(3):
        sheet(tmp_path / f"{n}.csv", ";", BOM if n else "")
    found = read_sheet(spark, str(tmp_path), TYPES)
    assert found.rows.count() == 9 and found.rejected.count() == 0


def test_empty_sheets(spark, tmp_path):
    (tmp_path / "none.csv").write_text("")
    found = read_sheet(spark, str(tmp_path / "none.csv"), {"a": "int"})
    assert found.rows.count() == 0 and found.rows.columns == ["a"] and found.rejected.count() == 0
    (tmp_path / "head.csv").write_text("a;b\n")
    found = read_sheet(spark, str(tmp_path / "head.csv"))
    assert found.rows.count() == 0 and found.rows.columns == ["a", "b"]
