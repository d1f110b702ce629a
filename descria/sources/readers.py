"""Scans: delimited text, one-column structure files, SDF, lists and catalogues."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from descria.columns import is_fractional, quoted, require_columns
from descria.errors import DescriaError, UnknownCatalogError, UnsupportedFormatError
from descria.functions import sdf
from descria.operators.align import MAX_BROADCAST_CHUNKS, ROW, key_join, small_side, with_row_index, zip_join
from descria.storage import materialise, ship_package

SUFFIXES = (".smi", ".csv", ".sdf")
RECORD_MARK = "$$$$"
RECORD_END = f"{RECORD_MARK}\n"
# What may follow the mark in its line.
_LINE_REST = re.compile(rb"\$*\r?\n")
_LITERALS = {"nullValue": "", "nanValue": "NaN", "positiveInf": "inf", "negativeInf": "-inf"}


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence on whatever file system the path names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def supported(path: str) -> bool:
    return path.lower().endswith(SUFFIXES)


def supported_column(path):
    """Column form of :func:`supported` for tables that list paths."""
    lowered = F.lower(path)
    return lowered.endswith(".smi") | lowered.endswith(".csv") | lowered.endswith(".sdf")


def validate_format(spark: SparkSession, path: str) -> str:
    """The path, or an error when the suffix is not accepted or nothing is there."""
    if not supported(path):
        raise UnsupportedFormatError(f"{path}: use one of {', '.join(SUFFIXES)}")
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    return path


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN cells become NULL; infinities stay until ``replace_inf``."""
    return df.withColumns(
        {
            f.name: F.when(F.isnan(quoted(f.name)), F.lit(None)).otherwise(quoted(f.name))
            for f in df.schema.fields
            if is_fractional(f)
        }
    )


def scan_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = ",", indexed: bool = False
) -> DataFrame:
    """Delimited file with a header; empty and ``NaN`` cells are missing, ``inf`` is infinite.

    Without a schema the types are inferred, which reads the file once more: pass
    one for large inputs. ``indexed`` adds the row ordinal.
    """
    reader = spark.read.options(header=True, sep=sep, **_LITERALS)
    reader = reader.option("inferSchema", True) if schema is None else reader.schema(schema)
    table = reader.csv(path)
    return nan_to_null(with_row_index(table) if indexed else table)


def scan_smi(spark: SparkSession, path: str, id_first: bool = False, indexed: bool = False) -> DataFrame:
    """Headerless structure file, one SMILES per line; blank lines are skipped.

    ``id_first`` reads the two-column layout ``ID<TAB>SMILES`` as ``Name, SMILES``.
    """
    raw = spark.read.text(path)
    raw = with_row_index(raw) if indexed else raw
    rows = raw.filter(F.trim("value") != "")
    keep = [ROW] if indexed else []
    if id_first:
        parts = F.split(F.trim("value"), r"\t", 2)
        return rows.select(*keep, F.get(parts, F.lit(0)).alias("Name"), F.get(parts, F.lit(1)).alias("SMILES"))
    return rows.select(*keep, F.trim("value").alias("SMILES"))


def scan_tsv_single(
    spark: SparkSession, path: str, name: str, kind: str = "string", indexed: bool = True
) -> DataFrame:
    """Headerless tab-separated file with a single column of the given name and type."""
    table = spark.read.options(sep="\t", **_LITERALS).schema(f"`{name}` {kind}").csv(path)
    return nan_to_null(with_row_index(table) if indexed else table)


def _sdf_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(file, start, k, bare, record)`` from the pieces between ``$$$$``, which come in file order within a split.

    A piece that goes on within the line of the mark belongs to the record before it. Where that one is in an
    earlier split, ``k`` is -1. ``bare`` marks a piece that is a line end only: an empty record, or what follows the last mark.
    """
    split, k, now = None, 0, None

    def batch_of(rows: list) -> pa.RecordBatch:
        arrays = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.bool_()))]
        text = pa.array([RECORD_MARK.encode().join(r[4]).replace(b"\r\n", b"\n") for r in rows], pa.binary())
        return pa.RecordBatch.from_arrays([*arrays, text], names=["file", "start", "k", "bare", "record"])

    for batch in batches:
        done = []
        for file, start, value in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            end = _LINE_REST.match(value)
            fresh = (file, start) != split
            if fresh:
                split, k = (file, start), 0
            if not fresh and end is None:
                now[3] = False
                now[4].append(value)
                continue
            if now is not None:
                done.append(now)
            if fresh and start == 0:
                now, k = [file, start, k, False, [value]], k + 1
            elif end is None:
                now = [file, start, -1, False, [value]]
            else:
                now, k = [file, start, k, end.end() == len(value), [value[end.end() :]]], k + 1
        yield batch_of(done)
    if now is not None:
        yield batch_of([now])


def scan_sdf(spark: SparkSession, path: str) -> DataFrame:
    """``(row_idx, record, valid)``: one row per record; an unreadable record keeps its ordinal.

    Every line may end with LF or CRLF, also within one file; records hold LF. Ordinals follow
    (file path, offset in file).
    """
    ship_package(spark)
    raw = spark.read.option("lineSep", RECORD_MARK).text(path)
    raw = raw.select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary"))
    pieces = raw.mapInArrow(_sdf_pieces, "file string, start bigint, k bigint, bare boolean, record binary")
    splits = pieces.groupBy("file", "start").agg(
        F.count_if(F.col("k") >= 0).alias("n"), F.max_by("bare", "k").alias("bare"), F.count_if(F.col("k") < 0).alias("parts")
    )
    # One row per input split, so these windows order a table of that size only.
    order = Window.orderBy("file", "start")
    last = F.coalesce(F.lead("file").over(order) != F.col("file"), F.lit(True))
    splits = splits.withColumn("n", F.col("n") - F.when(last & F.col("bare"), 1).otherwise(0))
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = materialise(splits.select("file", "start", "n", "parts", before.alias("before")), "splits")
    placed = pieces.join(small_side(splits, MAX_BROADCAST_CHUNKS), ["file", "start"]).where("k < n")
    placed = placed.select((F.col("before") + F.col("k")).alias(ROW), "k", "start", F.col("record").cast("string").alias("record"))
    records = placed.where("k >= 0").select(ROW, "record")
    if not splits.where("parts > 0").isEmpty():
        # At most one part per input split.
        rest = placed.where("k < 0").groupBy(ROW).agg(F.array_sort(F.collect_list(F.struct("start", "record"))).alias("rest"))
        whole = F.concat(F.array("record"), F.coalesce(F.col("rest.record"), F.array().cast("array<string>")))
        records = records.join(rest, ROW, "left").select(ROW, F.array_join(whole, RECORD_MARK).alias("record"))
    return records.withColumn("valid", sdf.is_valid(F.col("record")))


def sniff_separator(header: str) -> str:
    """Comma, then tab, then runs of white space: the first that splits the header line."""
    if "," in header:
        return ","
    return "\t" if "\t" in header else " "


def scan_sep_sniff(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Delimited files whose separator is read off the header line of the first; all files have the same header.

    Runs of white space give text without a schema.
    """
    first = spark.read.text(path).head()
    if first is None:
        raise DescriaError(f"{path} is empty")
    header = first["value"]
    sep = sniff_separator(header)
    if sep != " " or " " not in header.strip():
        return scan_csv(spark, path, schema, sep)
    names = header.split()
    # Read as one column of whole lines: the reader takes the first line off each file and leaves rows that look like it.
    whole = spark.read.schema("value string").options(header=True, sep="\u0001", quote="", escape="", enforceSchema=True)
    rows = whole.csv(path).filter(F.trim("value") != "")
    parts = F.split(F.trim("value"), r"\s+")
    cells = [F.get(parts, F.lit(k)) for k in range(len(names))]
    if schema is None:
        return rows.select(*[c.alias(n) for c, n in zip(cells, names, strict=True)])
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    cells += [F.lit(None)] * (len(fields) - len(names))
    return nan_to_null(rows.select(*[c.try_cast(f.dataType).alias(f.name) for c, f in zip(cells, fields, strict=False)]))


def scan_feature_list(spark: SparkSession, path: str) -> DataFrame:
    """``(pos, feature)``: trimmed names, empty lines dropped, an empty list is an error."""
    lines = with_row_index(spark.read.text(path), "pos")
    table = lines.filter(F.trim("value") != "").select("pos", F.trim("value").alias("feature"))
    if table.isEmpty():
        raise DescriaError(f"no feature names in {path}")
    return table


def scan_index_list(spark: SparkSession, path: str) -> DataFrame:
    """``(idx)``: one integer per line."""
    return spark.read.schema("idx bigint").csv(path).filter(F.col("idx").isNotNull())


@dataclass(frozen=True)
class CatalogEntry:
    descriptor_path: str
    sdf_path: str


class Catalog:
    """Screening databases by name: descriptor table plus the matching structure file."""

    def __init__(self, entries: Mapping[str, CatalogEntry | tuple[str, str]], folder: str = "") -> None:
        base = folder.rstrip("/") + "/" if folder else ""
        self.entries = {
            name: CatalogEntry(*(base + p for p in (e if isinstance(e, tuple) else (e.descriptor_path, e.sdf_path))))
            for name, e in entries.items()
        }

    @classmethod
    def from_table(cls, table: DataFrame, folder: str = "") -> Catalog:
        """From a small ``(db, descriptor_path, sdf_path)`` table."""
        require_columns(table, ["db", "descriptor_path", "sdf_path"])
        return cls({r["db"]: (r["descriptor_path"], r["sdf_path"]) for r in table.collect()}, folder)

    def lookup(self, name: str) -> CatalogEntry:
        if name not in self.entries:
            raise UnknownCatalogError(f"unknown database {name!r}; choose from {sorted(self.entries)}")
        return self.entries[name]


def scan_compounds(spark: SparkSession, path: str, smiles_column: str = "SMILES") -> DataFrame:
    """Compounds of one file by suffix: ``SMILES`` rows, or SDF ``record`` rows."""
    validate_format(spark, path)
    if path.lower().endswith(".smi"):
        return scan_smi(spark, path)
    if path.lower().endswith(".sdf"):
        return scan_sdf(spark, path)
    table = scan_csv(spark, path)
    require_columns(table, [smiles_column])
    return table.withColumnRenamed(smiles_column, "SMILES")


def load_pos_neg(spark: SparkSession, positive: str, negative: str) -> DataFrame:
    """Both class files as one table with ``Label`` 1 and 0."""
    return scan_compounds(spark, positive).withColumn("Label", F.lit(1)).unionByName(
        scan_compounds(spark, negative).withColumn("Label", F.lit(0)), allowMissingColumns=True
    )


def count_compounds(compounds: DataFrame) -> DataFrame:
    """``(class, n)`` for positive, negative and total; unreadable SDF records do not count."""
    rows = compounds.filter("valid") if "valid" in compounds.columns else compounds
    name = F.when(F.col("Label") == 1, "positive").when(F.col("Label") == 0, "negative").otherwise("total")
    return rows.rollup("Label").agg(F.count(F.lit(1)).alias("n")).select(name.alias("class"), "n")


def load_value_pairs(
    spark: SparkSession, smiles_path: str, value_path: str, id_col: str | None = None
) -> DataFrame:
    """``(row_idx, SMILES, value)`` from a structure file and an activity file.

    Without identifiers the files pair by position and must be equally long; with
    ``id_col`` both carry that column and pair by it.
    """


    if id_col is not None:
        left = scan_smi(spark, smiles_path, id_first=True).withColumnRenamed("Name", id_col)
        right = scan_csv(spark, value_path)
        value = next(c for c in right.columns if c != id_col)
        return key_join(left, right.withColumnRenamed(value, "value"), id_col)
    left = scan_tsv_single(spark, smiles_path, "SMILES")
    return zip_join(left, scan_tsv_single(spark, value_path, "value", "double"))
