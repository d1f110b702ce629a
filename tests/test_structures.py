"""Structure columns, sources, sinks, positional joins, screening."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from descria.errors import (
    DescriaError,
    MissingColumnError,
    RowCountMismatchError,
    UnknownCatalogError,
    UnsupportedFormatError,
)
from descria.functions import smiles
from descria.operators import align, screen, score, structures
from descria.operators.linear import fit_least_squares
from descria.sources import readers, sinks

KEPT = {
    "CCO", "c1ccccc1", "CC(=O)Oc1ccccc1C(=O)O", "CCn1cccc1", "c1cc[nH]c1", "Clc1ccccc1Br", "[13CH4]",
    "C[Si](C)(C)C", "O=[N+]([O-])c1ccccc1", "c1ccc2ccccc2c1", "N[C@@H](C)C(=O)O", "[Pt](Cl)(Cl)(N)N",
    "C/C=C/C", "CC%10CCCC%10", "[H][H]", "OS(=O)(=O)O",
}
DROPPED = {"CC(=O)[O-].[Na+]", "[Na+].[Cl-]", "[Fe]", "[Na].[K]", "CC(", "C1CC", "", "Xy", ")C(", None}


def table(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "SMILES string")


def test_structure_filter(spark):
    kept = structures.standardize_filter(table(spark, [*KEPT, *DROPPED]))
    assert {r["SMILES"] for r in kept.collect()} == KEPT


def test_structure_columns(spark):
    row = lambda s, c: table(spark, [s]).select(c(F.col("SMILES"))).first()[0]
    assert row("CCn1cccc1", smiles.elements) == ["C", "N"]
    assert row("[Na+].[Cl-]", smiles.fragments) == 2
    assert row("CC(=O)[O-].[Na+]", smiles.strip_salts) == "CC(=O)[O-]"
    assert row("O=[N+]([O-])c1ccccc1", smiles.normalize_nitro) == "O=N(=O)c1ccccc1"
    assert len(smiles.METALS) == 66 == len(set(smiles.METALS))


def test_descriptors_of_aspirin(spark):
    d = structures.constitutional_descriptors(table(spark, ["CC(=O)Oc1ccccc1C(=O)O"])).first()
    assert (d["n_C"], d["n_O"], d["n_heavy"], d["n_rings"], d["n_bonds"]) == (9, 4, 13, 1, 13)
    assert (d["n_aromatic"], d["n_double"], d["n_branches"]) == (6, 2, 2)
    assert d["mw"] == pytest.approx(9 * 12.011 + 4 * 15.999)


SDF = """m1
  toy

  2  1  0  0  0  0  0  0  0  0999 V2000
    0.0000    0.0000    0.0000 C   0  0
    1.0000    0.0000    0.0000 O   0  0
  1  2  1  0
M  END
> <ID>
first

$$$$
broken
$$$$
m2
  toy

  1  0  0  0  0  0  0  0  0  0999 V2000
    0.0000    0.0000    0.0000 Fe  0  0
M  END
$$$$
"""


def test_sdf_round_trip(spark, tmp_path):
    path = tmp_path / "in.sdf"
    path.write_text(SDF)
    records = readers.scan_sdf(spark, str(path)).orderBy("row_idx")
    assert [(r["row_idx"], r["valid"]) for r in records.collect()] == [(0, True), (1, False), (2, True)]
    assert [r["record"].split("\n")[0] for r in structures.standardize_filter(records).collect()] == ["m1"]
    wanted = spark.createDataFrame([(0,), (1,), (2,), (9,)], "idx bigint")
    out = screen.extract_molecules(records, wanted)
    assert [r["row_idx"] for r in out.molecules.collect()] == [0, 2]
    assert [r["row_idx"] for r in out.not_found.collect()] == [9]
    assert tuple(out.counts.first()) == (4, 2, 1)
    target = str(tmp_path / "out")
    sinks.sink_sdf(out.molecules, target)
    again = readers.scan_sdf(spark, target).orderBy("row_idx").collect()
    assert [r["record"] for r in again] == [r["record"] for r in out.molecules.orderBy("row_idx").collect()]
    d = structures.constitutional_descriptors(records.filter("row_idx = 0")).first()
    assert (d["n_C"], d["n_O"], d["n_bonds"], d["n_rings"]) == (1, 1, 1, 0)


def test_literals_in_csv(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text("ID,SMILES,Value,Desc1,Desc2,Desc3\nA,CCO,5.6,12.3,NaN,45.6\nB,c1ccccc1,8.1,78.9,10.1,inf\nC,CC,1.0,,2.0,-inf\n")
    df = readers.scan_csv(spark, str(path))
    assert dict(df.dtypes)["Desc3"] == "double"
    rows = {r["ID"]: r for r in df.collect()}
    assert rows["A"]["Desc2"] is None and rows["C"]["Desc1"] is None
    assert rows["B"]["Desc3"] == float("inf") and rows["C"]["Desc3"] == float("-inf")


def test_separators(spark, tmp_path):
    for k, text in enumerate(("a,b\n1,2\n", "a\tb\n1\t2\n", "a  b\n1   2\n")):
        path = tmp_path / f"f{k}.txt"
        path.write_text(text)
        got = readers.scan_sep_sniff(spark, str(path)).first()
        assert [str(v) for v in got] == ["1", "2"]


def test_row_index_follows_file_order(spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(20_000).repartitionByRange(7, "id").sortWithinPartitions("id").select(
        F.col("id").cast("string").alias("value")
    ).write.text(path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        indexed = align.with_row_index(spark.read.text(path))
        assert indexed.filter("row_idx <> cast(value as bigint)").count() == 0
        assert indexed.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_value_pairs(spark, tmp_path):
    (tmp_path / "s.smi").write_text("CCO\nCC\n")
    (tmp_path / "v.tsv").write_text("1.5\n2.5\n")
    (tmp_path / "w.tsv").write_text("1.5\n")
    pairs = readers.load_value_pairs(spark, str(tmp_path / "s.smi"), str(tmp_path / "v.tsv")).orderBy("row_idx")
    assert [tuple(r) for r in pairs.collect()] == [(0, "CCO", 1.5), (1, "CC", 2.5)]
    with pytest.raises(RowCountMismatchError):
        readers.load_value_pairs(spark, str(tmp_path / "s.smi"), str(tmp_path / "w.tsv"))
    (tmp_path / "ids.smi").write_text("x\tCCO\ny\tCC\n")
    (tmp_path / "ids.csv").write_text("ID,Value\ny,2.0\nx,1.0\n")
    keyed = readers.load_value_pairs(spark, str(tmp_path / "ids.smi"), str(tmp_path / "ids.csv"), "ID")
    assert {(r["SMILES"], r["value"]) for r in keyed.collect()} == {("CCO", 1.0), ("CC", 2.0)}


def test_plan_time_checks(spark, tmp_path):
    with pytest.raises(UnsupportedFormatError):
        readers.validate_format(spark, "x.txt")
    with pytest.raises(FileNotFoundError):
        readers.validate_format(spark, str(tmp_path / "no.csv"))
    with pytest.raises(UnknownCatalogError, match="one"):
        readers.Catalog({"one": ("a", "b")}).lookup("two")
    (tmp_path / "empty.txt").write_text("\n  \n")
    with pytest.raises(DescriaError):
        readers.scan_feature_list(spark, str(tmp_path / "empty.txt"))


def test_screening_rules(spark):
    df = spark.createDataFrame([(i, float(i), 2.0 * i) for i in range(10)], "row_idx bigint, x double, value double")
    model = fit_least_squares(df, ["x"], "value")
    dirty = df.withColumn("x", F.when(F.col("row_idx") == 3, float("inf")).otherwise(F.col("x"))).drop("value")
    out = screen.virtual_screening(model, dirty, ["x"], score.REGRESSION, 6.5)
    rows = {r["row_idx"]: r for r in out.compounds.collect()}
    # The median of the nine present values is 5, so row 3 scores 10; its cell stays as it was.
    assert sorted(rows) == [0, 1, 2]
    trained = screen.virtual_screening(model, dirty, ["x"], score.REGRESSION, 6.5, medians={"x": 3.0})
    kept = {r["row_idx"]: r["x"] for r in trained.compounds.collect()}
    assert sorted(kept) == [0, 1, 2, 3] and kept[3] == float("inf")
    nothing, extraction = screen.screen_and_extract(model, dirty, dirty, ["x"], score.REGRESSION, -100.0)
    assert extraction is None and nothing.compounds.isEmpty()
    with pytest.raises(MissingColumnError):
        screen.virtual_screening(model, dirty, ["y"], score.REGRESSION)
    with pytest.raises(MissingColumnError):
        screen.virtual_screening(model, dirty.drop("row_idx"), ["x"], score.REGRESSION)
    with pytest.raises(DescriaError):
        screen.virtual_screening(model, dirty, ["x"], "clustering")


def test_custom_screening_rejects_missing_structures(spark):
    compounds = spark.createDataFrame([(0, "CCO"), (1, None)], "row_idx bigint, SMILES string")
    train = structures.constitutional_descriptors(compounds.filter("SMILES IS NOT NULL")).withColumn("value", F.lit(1.0))
    model = fit_least_squares(train.unionByName(train.withColumn("mw", F.lit(1.0))), ["mw"], "value")
    with pytest.raises(DescriaError):
        screen.custom_screening(model, compounds, ["mw"], score.REGRESSION)
    out = screen.custom_screening(model, compounds.filter("row_idx = 0"), ["mw"], score.REGRESSION)
    assert out.columns == ["Original_Index", "Prediction"]


def test_scan_sdf_line_ends(spark, tmp_path):
    record = "name\n  tool\n\n  1  0  0  0  0  0  0  0  0  0999 V2000\n    0.0 0.0 0.0 C\nM  END\n"
    for end in ("\n", "\r\n"):
        path = tmp_path / f"lines{len(end)}.sdf"
        path.write_bytes(f"{record}$$$$\n\n$$$$\n{record}$$$$\n".replace("\n", end).encode())
        rows = readers.scan_sdf(spark, str(path)).orderBy("row_idx").collect()
        assert [(r.row_idx, r.record) for r in rows] == [(0, record), (1, "\n"), (2, record)]


def test_scan_sep_sniff_white_space_with_schema(spark, tmp_path):
    path = tmp_path / "cells.txt"
    path.write_text("a  b   c\n1 x  2.5\n2   y NaN\n\n3 z\n")
    got = readers.scan_sep_sniff(spark, str(path), "a int, b string, c double")
    assert got.dtypes == [("a", "int"), ("b", "string"), ("c", "double")]
    assert [tuple(r) for r in got.orderBy("a").collect()] == [(1, "x", 2.5), (2, "y", None), (3, "z", None)]
    assert readers.scan_sep_sniff(spark, str(path)).first()["c"] == "2.5"
