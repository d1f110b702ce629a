"""SDF records with LF and CRLF in one input, and marks that don't end a line."""

from __future__ import annotations

import re

import pytest

from descria.sources import readers

RECORD = "{}\n  tool\n\n  1  0  0  0  0  0  0  0  0  0999 V2000\n    0.0 0.0 0.0 C\nM  END\n"


def write(path, ends, records=None):
    own = records or [RECORD.format(f"{path.name}-{k}") for k in range(len(ends))]
    path.write_bytes("".join((r + "$$$$\n").replace("\n", e) for r, e in zip(own, ends, strict=True)).encode())
    return own


def read(spark, path):
    rows = readers.scan_sdf(spark, str(path)).orderBy("row_idx").collect()
    assert [r.row_idx for r in rows] == list(range(len(rows)))
    return [r.record for r in rows]


@pytest.mark.parametrize("ends", [("\n", "\r\n"), ("\r\n", "\n")])
def test_folder_with_one_file_of_each_kind(spark, tmp_path, ends):
    want = write(tmp_path / "a.sdf", [ends[0]] * 3) + write(tmp_path / "b.sdf", [ends[1]] * 3)
    assert read(spark, tmp_path) == want


def test_file_with_both_kinds(spark, tmp_path):
    path = tmp_path / "a.sdf"
    want = write(path, ["\n", "\r\n", "\r\n", "\n", "\r\n", "\n"])
    assert read(spark, path) == want
    assert readers.scan_sdf(spark, str(path)).where("valid").count() == 6


def test_marks_elsewhere_and_empty_records(spark, tmp_path):
    priced = RECORD.format("p") + "> <PRICE>\n$$$$ or $$$$ more\n\n"
    records = ["\n  no title\n", priced, "", "\n", RECORD.format("a"), "", priced, "$$$$ first\n"]
    path = tmp_path / "a.sdf"
    write(path, ["\n", "\r\n"] * 4, records)
    (tmp_path / "b.sdf").write_bytes(b"caf\xe9\n$$$$\nopen end\n$$$$")
    (tmp_path / "c.sdf").write_text("x\n$$$$\nno mark\n")
    assert read(spark, path) == records
    text = path.read_bytes().decode().replace("\r\n", "\n")
    assert records == re.split(r"(?m)\$\$\$\$\n", text)[:-1]
    assert read(spark, tmp_path)[-4:] == ["caf�\n", "open end\n", "x\n", "no mark\n"]


@pytest.mark.parametrize("size", [37, 61, 128, 1000])
def test_any_cut_into_splits(spark, tmp_path, size):
    path = tmp_path / "a.sdf"
    records = [RECORD.format(k) + ("> <P>\n" + "$$$$ x " * k + "\n" if k % 3 == 0 else "") for k in range(9)] + ["", "t\n"]
    write(path, ["\n", "\r\n", "\r\n"] * 3 + ["\n", "\r\n"], records)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")
        assert read(spark, path) == records
    finally:
        for n, v in zip(names, old, strict=True):
            spark.conf.set(n, v)
