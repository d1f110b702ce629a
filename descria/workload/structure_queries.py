"""Sources, sinks, structures, positional joins, screening and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from descria.errors import UnsupportedFormatError
from descria.functions import numeric, sdf, smiles
from descria.operators import align, metrics, prune, screen, score, structures
from descria.operators.clean import drop_high_nan_rows
from descria.operators.impute import fill_values
from descria.operators.linear import fit_least_squares
from descria.plans.custom import standardise_describe_screen
from descria.plans.preparation import load_and_standardize
from descria.sources import readers, sinks
from descria.storage import fresh_path
from descria.streaming.scoring import score_stream, write_hits
from descria.workload.fixtures import (
    BASES,
    CUST_FEATURES,
    CUST_SQL,
    EMB_FEATURES,
    EMB_FINITE_SQL,
    EMB_SQL,
    ORD_FEATURES,
    ORD_FILLED_SQL,
    ORD_SQL,
    SDF_SQL,
    SMI_SQL,
    d_cust,
    d_emb,
    d_ord,
    d_sdf,
    d_smi,
    long_sql,
    names_sql,
    table,
)
from descria.workload.prep_queries import rounded
from descria.workload.registry import query

# --- SQL forms of the lexical structure rules -----------------------------------


def atoms_sql(s: str) -> str:
    token = f"regexp_extract_all({s}, '{smiles.TOKEN}', 1)"
    symbol = f"CASE WHEN t[1] = '[' THEN regexp_extract(t, '{smiles.BRACKET_ELEMENT}', 1) ELSE t END"
    named = f"list_transform({token}, lambda t: {symbol})"
    capital = f"list_transform({named}, lambda u: upper(substr(u, 1, 1)) || lower(substr(u, 2)))"
    return f"list_filter({capital}, lambda w: w <> '')"


def _bare_sql(s: str) -> str:
    return rf"regexp_replace({s}, '\[[^\]]*\]', '', 'g')"


def _rings_sql(s: str) -> str:
    return f"regexp_extract_all({_bare_sql(s)}, '{smiles.RING_LABEL}', 1)"


def valid_sql(s: str) -> str:
    steps = f"list_transform(regexp_extract_all({s}, '([()])', 1), lambda b: CASE WHEN b = '(' THEN 1 ELSE -1 END)"
    depth = f"list_reduce(list_prepend(0, {steps}), lambda acc, x: CASE WHEN acc < 0 THEN acc ELSE acc + x END)"
    rings = _rings_sql(s)
    odd = f"list_filter(list_distinct({rings}), lambda q: len(list_filter({rings}, lambda y: y = q)) % 2 = 1)"
    return (
        f"(regexp_replace({s}, '{smiles.LEGAL}', '', 'g') = '' AND len({atoms_sql(s)}) > 0 AND {depth} = 0"
        f" AND len({odd}) = 0)"
    )


def fragments_sql(s: str) -> str:
    return f"CASE WHEN trim({s}) = '' THEN 0 ELSE len(string_split({s}, '.')) END"


METALS_SQL = names_sql(smiles.METALS)


def keep_sql(s: str) -> str:
    non_metal = f"len(list_filter({atoms_sql(s)}, lambda m: NOT list_contains({METALS_SQL}, m))) > 0"
    return f"({valid_sql(s)} AND {non_metal} AND {fragments_sql(s)} = 1)"


_WEIGHT = "CASE a " + " ".join(f"WHEN '{e}' THEN {w}" for e, w in smiles.ATOMIC_WEIGHTS.items()) + " ELSE 0 END"


def nitro_sql(s: str) -> str:
    for pattern, plain in smiles.NITRO:
        s = f"regexp_replace({s}, '{pattern}', '{plain}', 'g')"
    return s


def strip_sql(s: str) -> str:
    ranked = f"list_transform(string_split({s}, '.'), lambda x: {{'a': len({atoms_sql('x')}), 'n': len(x), 's': x}})"
    return f"list_sort({ranked}, 'DESC')[1].s"


def descriptors_sql(source: str, s: str = "SMILES") -> str:
    """CTEs ``st`` (clean text, atoms, tokens) and ``ds`` (all descriptor columns) over ``source``."""

    def n(e: str) -> str:
        return f"len(list_filter(ats, lambda a: a = '{e}'))"

    halogens = " + ".join(n(e) for e in smiles.HALOGENS)
    heavy = "len(list_filter(ats, lambda a: a <> 'H'))"
    columns = {f"n_{e}": n(e) for e in smiles.COUNTED}
    columns |= {
        "n_heavy": heavy,
        "n_hetero": f"{heavy} - {n('C')}",
        "n_halogen": halogens,
        "n_aromatic": r"len(list_filter(tk, lambda t: regexp_matches(t, '^(\[[0-9]*)?[a-z]')))",
        "n_charged": r"len(list_filter(tk, lambda t: regexp_matches(t, '^\[.*[+-]')))",
        "n_rings": "len(rl) / 2.0",
        "n_bonds": f"len(ats) - ({fragments_sql('cl')}) + len(rl) / 2.0",
        "n_double": "len(bare) - len(replace(bare, '=', ''))",
        "n_triple": "len(bare) - len(replace(bare, '#', ''))",
        "n_branches": "len(bare) - len(replace(bare, '(', ''))",
        "mw": f"coalesce(list_sum(list_transform(ats, lambda a: {_WEIGHT})), 0)",
    }
    body = ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in columns.items())
    return (
        f"cl AS (SELECT *, {strip_sql(nitro_sql(s))} AS cl FROM {source}),"
        f" st AS (SELECT *, {atoms_sql('cl')} AS ats, regexp_extract_all(cl, '{smiles.TOKEN}', 1) AS tk,"
        f" {_rings_sql('cl')} AS rl, {_bare_sql('cl')} AS bare FROM cl), ds AS (SELECT *, {body} FROM st)"
    )


# --- sources ------------------------------------------------------------------------

_DIRTY = (
    "SELECT o_orderkey, o_totalprice AS d1, CASE WHEN o_orderkey % 7 = 3 THEN 'NaN' WHEN o_orderkey % 7 = 4 THEN ''"
    " ELSE CAST(o_custkey AS {t}) END AS d2, CASE o_orderkey % 9 WHEN 1 THEN 'inf' WHEN 2 THEN '-inf'"
    " ELSE CAST(o_custkey % 100 AS {t}) END AS d3 FROM {src}"
)


@query(
    "scan_csv",
    f"WITH d AS ({_DIRTY.format(t='VARCHAR', src='orders')}) SELECT o_orderkey, d1,"
    " CASE WHEN d2 IN ('NaN', '') THEN NULL ELSE CAST(d2 AS DOUBLE) END AS d2,"
    " CASE WHEN d3 LIKE '%inf' THEN NULL ELSE CAST(d3 AS DOUBLE) END AS d3,"
    " CAST(CASE d3 WHEN 'inf' THEN 1 WHEN '-inf' THEN -1 ELSE 0 END AS INT) AS d3_inf FROM d",
)
def scan_csv(spark, sf):
    source = table(spark, sf, "orders")
    dirty = spark.sql(_DIRTY.format(t="STRING", src="{src}"), src=source)
    path = sinks.sink_csv(dirty, fresh_path(spark, "csv"))
    got = readers.scan_csv(spark, path)
    infinite = F.coalesce(numeric.is_infinite(F.col("d3")), F.lit(False))
    return got.select(
        F.col("o_orderkey").cast("bigint").alias("o_orderkey"),
        "d1",
        F.col("d2").cast("double").alias("d2"),
        numeric.infinite_to_null(F.col("d3")).alias("d3"),
        F.when(infinite, F.signum("d3")).otherwise(0).cast("int").alias("d3_inf"),
    )


def _write_lines(spark, df, column, label):
    """One text line per row, in the order of ``df`` across the files."""
    path = fresh_path(spark, label)
    sinks.sink_lines(df, column, path)
    return path


@query(
    "scan_smi",
    f"WITH {SMI_SQL}, r AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx, SMILES FROM smi)"
    " SELECT row_idx, SMILES FROM r WHERE SMILES <> ''",
)
def scan_smi(spark, sf):
    path = _write_lines(spark, d_smi(spark, sf), "SMILES", "smi")
    return readers.scan_smi(spark, path, indexed=True)


@query(
    "scan_tsv_single",
    "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx, o_totalprice AS value FROM orders",
)
def scan_tsv_single(spark, sf):
    path = _write_lines(spark, table(spark, sf, "orders").orderBy("o_orderkey"), "o_totalprice", "tsv")
    return readers.scan_tsv_single(spark, path, "value", "double")


def _sdf_file(spark, sf):
    path = fresh_path(spark, "sdf")
    return sinks.sink_sdf(d_sdf(spark, sf), path)


@query("scan_sdf", f"WITH {SDF_SQL} SELECT row_idx, title, valid, CAST(o_totalprice AS DOUBLE) AS price FROM sdf")
def scan_sdf(spark, sf):
    records = readers.scan_sdf(spark, _sdf_file(spark, sf))
    r = F.col("record")
    return records.select("row_idx", sdf.title(r).alias("title"), "valid", sdf.tag(r, "VALUE").cast("double").alias("price"))


@query(
    "sdf_atoms",
    f"WITH {SDF_SQL} SELECT row_idx, CAST(n AS INT) AS n_atoms, CAST(m AS INT) AS n_bonds,"
    " CAST(n - m AS INT) AS fragments, array_to_string(list_sort(list_distinct(symbols)), ',') AS elements"
    " FROM sdfx WHERE valid",
)
def sdf_atoms(spark, sf):
    flagged = structures.sdf_flags(readers.scan_sdf(spark, _sdf_file(spark, sf)).filter("valid"))
    return flagged.select("row_idx", "n_atoms", "n_bonds", "fragments", F.array_join("elements", ",").alias("elements"))


def _sniffed(spark, sf, sep, header):
    """Customers written with a separator; the third column is text that no separator splits."""
    path = fresh_path(spark, "cells")
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", F.col("c_acctbal").cast("string").alias("c_acctbal"))
    if header:
        # A data row that reads like the header stays a row: its key is no number, hence null.
        extra = spark.createDataFrame([("c_custkey", "c_name", "c_acctbal")], "c_custkey string, c_name string, c_acctbal string")
        rows = rows.select(F.col("c_custkey").cast("string").alias("c_custkey"), "c_name", "c_acctbal").union(extra)
    rows.write.csv(path, header=True, sep=sep)
    return readers.scan_sep_sniff(spark, path, "c_custkey bigint, c_name string, c_acctbal double")


@query("scan_sep_sniff", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def scan_sep_sniff(spark, sf):
    return _sniffed(spark, sf, "\t", False)


@query("scan_sep_sniff_comma", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def scan_sep_sniff_comma(spark, sf):
    return _sniffed(spark, sf, ",", False)


@query(
    "scan_sep_sniff_space",
    "SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT NULL, 'c_name', NULL",
)
def scan_sep_sniff_space(spark, sf):
    return _sniffed(spark, sf, " ", True)


@query(
    "scan_feature_list",
    "WITH l AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS pos, c_custkey, c_name FROM customer)"
    " SELECT pos, c_name AS feature FROM l WHERE c_custkey % 7 <> 3",
)
def scan_feature_list(spark, sf):
    line = F.when(F.col("c_custkey") % 7 == 3, F.lit("  ")).otherwise(F.concat(F.lit(" "), "c_name", F.lit("  ")))
    names = table(spark, sf, "customer").select("c_custkey", line.alias("line"))
    return readers.scan_feature_list(spark, _write_lines(spark, names.orderBy("c_custkey"), "line", "names"))


@query("scan_index_list", "SELECT o_orderkey AS idx FROM orders WHERE o_totalprice > 100000")
def scan_index_list(spark, sf):
    wanted = table(spark, sf, "orders").filter("o_totalprice > 100000")
    return readers.scan_index_list(spark, sinks.sink_indices(wanted, fresh_path(spark, "idx"), "o_orderkey"))


@query("sink_indices", "SELECT o_orderkey AS idx FROM orders WHERE o_orderstatus = 'F'")
def sink_indices(spark, sf):
    wanted = table(spark, sf, "orders").filter("o_orderstatus = 'F'")
    return readers.scan_index_list(spark, sinks.sink_indices(wanted, fresh_path(spark, "idx"), "o_orderkey"))


@query("catalog_lookup", "SELECT 'large' AS db, o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def catalog_lookup(spark, sf):
    entries = {"small": ("customer.parquet", "customer.sdf"), "large": ("orders.parquet", "orders.sdf")}
    entry = readers.Catalog(entries, sf).lookup("large")
    library = spark.read.parquet(entry.descriptor_path)
    return library.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).withColumn("db", F.lit("large"))



_PATHS = "concat('lib/', source, '/', CAST(doc_id AS {t}), element_at(array('.smi','.CSV','.sdf','.txt'), CAST(doc_id % 4 AS INT) + 1))"


@query(
    "validate_format",
    "WITH p AS (SELECT doc_id, 'lib/' || source || '/' || doc_id || (['.smi','.CSV','.sdf','.txt'])[CAST(doc_id % 4 AS INT) + 1]"
    " AS path FROM documents) SELECT doc_id, path, lower(path) LIKE '%.smi' OR lower(path) LIKE '%.csv' OR"
    " lower(path) LIKE '%.sdf' AS supported FROM p",
)
def validate_format(spark, sf):
    """The path of every document, accepted if the operator takes a file of its suffix; files are written under all suffixes."""
    listed = table(spark, sf, "documents").select("doc_id", F.expr(_PATHS.format(t="STRING")).alias("path"))
    # Where a path has no suffix at all (no path, too), nothing is accepted or refused.
    listed = listed.withColumn("suffix", F.regexp_extract("path", r"(\.[^./]*)$", 1))
    base = fresh_path(spark, "formats")
    rows = []
    for suffix in (".smi", ".CSV", ".sdf", ".txt"):
        path = f"{base}/library{suffix}"
        listed.where(F.col("suffix") == suffix).select("doc_id").write.parquet(path)
        try:
            rows.append((suffix, readers.validate_format(spark, path) == path))
        except UnsupportedFormatError:
            rows.append((suffix, False))
    checked = spark.createDataFrame(rows, "suffix string, supported boolean")
    return listed.join(F.broadcast(checked), "suffix", "left").select("doc_id", "path", "supported")


def _class_files(spark, sf):
    data = d_smi(spark, sf)
    paths = []
    for label in (1, 0):
        path = fresh_path(spark, f"class{label}") + ".smi"
        sinks.sink_lines(data.filter(F.col("Label") == label), "SMILES", path)
        paths.append(path)
    return paths


@query(
    "count_compounds",
    f"WITH {SMI_SQL}, k AS (SELECT * FROM smi WHERE SMILES <> '') SELECT CASE Label WHEN 1 THEN 'positive'"
    " WHEN 0 THEN 'negative' ELSE 'total' END AS class, count(*) AS n FROM k GROUP BY ROLLUP (Label)",
)
def count_compounds(spark, sf):
    return readers.count_compounds(readers.load_pos_neg(spark, *_class_files(spark, sf)))


@query(
    "load_pos_neg",
    f"WITH {SMI_SQL} SELECT SMILES, CAST(Label AS INT) AS Label, count(*) AS n FROM smi WHERE SMILES <> '' GROUP BY ALL",
)
def load_pos_neg(spark, sf):
    both = readers.load_pos_neg(spark, *_class_files(spark, sf))
    return both.groupBy("SMILES", "Label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "load_and_standardize",
    f"WITH {SMI_SQL} SELECT CAST(Label AS INT) AS Label, count(*) FILTER ({keep_sql('SMILES')}) AS kept,"
    f" count(*) FILTER (NOT {keep_sql('SMILES')}) AS removed FROM smi WHERE SMILES <> '' GROUP BY Label",
)
def load_standardize(spark, sf):
    both = readers.load_pos_neg(spark, *_class_files(spark, sf))
    kept, _ = load_and_standardize(both)
    counts = structures.standardize_report(both, "Label")
    check = kept.groupBy("Label").agg(F.count(F.lit(1)).alias("kept_rows"))
    return counts.join(check, "Label").filter("kept = kept_rows").select("Label", "kept", "removed")


# --- sinks ----------------------------------------------------------------------------


@query("sink_csv", f"WITH {ORD_SQL} SELECT o_orderkey, n_lines, qty, round(ext, 2) AS ext, Label FROM ord")
def sink_csv(spark, sf):
    data = rounded(d_ord(spark, sf).select("o_orderkey", "n_lines", "qty", "ext", "Label"), ["ext"], 2)
    path = sinks.sink_csv(data, fresh_path(spark, "csv"))
    return readers.scan_csv(spark, path, data.schema)


@query(
    "sink_sdf",
    f"WITH {SDF_SQL} SELECT row_number() OVER (ORDER BY row_idx) - 1 AS row_idx, title FROM sdf WHERE valid",
)
def sink_sdf(spark, sf):
    """Keep the readable records, write them and read them again: ordinals are those of the new file."""
    records = readers.scan_sdf(spark, _sdf_file(spark, sf)).filter("valid")
    path = sinks.sink_sdf(records, fresh_path(spark, "sdf"))
    return readers.scan_sdf(spark, path).select("row_idx", sdf.title(F.col("record")).alias("title"))


@query(
    "sink_feature_list",
    f"WITH {EMB_FINITE_SQL}, {long_sql('fin', EMB_FEATURES)}, p AS (SELECT pos, feature FROM cells GROUP BY pos, feature"
    " HAVING var_pop(v) > 0.015) SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, feature FROM p",
)
def sink_feature_list(spark, sf):
    kept = prune.low_variance(d_emb(spark, sf), EMB_FEATURES, 0.015).kept
    return readers.scan_feature_list(spark, sinks.sink_feature_list(spark, kept, fresh_path(spark, "features")))


# --- structures -----------------------------------------------------------------------


@query(
    "smiles_elements",
    f"WITH {SMI_SQL} SELECT o_orderkey, array_to_string(list_sort(list_distinct({atoms_sql('SMILES')})), ',') AS elements"
    " FROM smi",
)
def smiles_elements(spark, sf):
    flagged = structures.structure_flags(d_smi(spark, sf))
    return flagged.select("o_orderkey", F.array_join("elements", ",").alias("elements"))


@query("smiles_fragments", f"WITH {SMI_SQL} SELECT o_orderkey, CAST({fragments_sql('SMILES')} AS INT) AS fragments FROM smi")
def smiles_fragments(spark, sf):
    return structures.structure_flags(d_smi(spark, sf)).select("o_orderkey", "fragments")


@query("smiles_valid", f"WITH {SMI_SQL} SELECT o_orderkey, {valid_sql('SMILES')} AS is_valid FROM smi")
def smiles_valid(spark, sf):
    return structures.structure_flags(d_smi(spark, sf)).select("o_orderkey", "is_valid")


@query("standardize_filter", f"WITH {SMI_SQL} SELECT o_orderkey, SMILES FROM smi WHERE {keep_sql('SMILES')}")
def standardize_filter(spark, sf):
    return structures.standardize_filter(d_smi(spark, sf)).select("o_orderkey", "SMILES")


_KEEP_SDF = f"valid AND n - m = 1 AND len(list_filter(symbols, lambda s: NOT list_contains({METALS_SQL}, s))) > 0"


@query("standardize_filter_sdf", f"WITH {SDF_SQL} SELECT row_idx, title FROM sdfx WHERE {_KEEP_SDF}")
def standardize_filter_sdf(spark, sf):
    kept = structures.standardize_filter(readers.scan_sdf(spark, _sdf_file(spark, sf)))
    return kept.select("row_idx", sdf.title(F.col("record")).alias("title"))


_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in smiles.DESCRIPTORS)


@query(
    "constitutional_descriptors",
    f"WITH {SMI_SQL}, {descriptors_sql('smi')} SELECT o_orderkey, {_ROUNDED} FROM ds",
)
def constitutional_descriptors(spark, sf):
    described = structures.constitutional_descriptors(d_smi(spark, sf))
    return rounded(described.select("o_orderkey", *smiles.DESCRIPTORS), list(smiles.DESCRIPTORS))


@query(
    "constitutional_descriptors_sdf",
    f"WITH {SDF_SQL} SELECT row_idx, CAST(n AS DOUBLE) AS n_heavy, CAST(m AS DOUBLE) AS n_bonds,"
    " CAST(len(list_filter(symbols, lambda s: s = 'C')) AS DOUBLE) AS \"n_C\","
    " CAST(len(list_filter(range(1, n), lambda k: k <> cut AND k % 2 = 1)) AS DOUBLE) AS n_double,"
    " CAST(0 AS DOUBLE) AS n_rings FROM sdfx WHERE valid",
)
def constitutional_descriptors_sdf(spark, sf):
    records = readers.scan_sdf(spark, _sdf_file(spark, sf)).filter("valid")
    described = structures.constitutional_descriptors(records)
    return described.select("row_idx", "n_heavy", "n_bonds", "n_C", "n_double", "n_rings")


@query("strip_salts", f"WITH {SMI_SQL} SELECT o_orderkey, {strip_sql('SMILES')} AS parent FROM smi")
def strip_salts(spark, sf):
    return d_smi(spark, sf).select("o_orderkey", smiles.strip_salts(F.col("SMILES")).alias("parent"))


@query("normalize_nitro", f"WITH {SMI_SQL} SELECT o_orderkey, {nitro_sql('SMILES')} AS plain FROM smi")
def normalize_nitro(spark, sf):
    return d_smi(spark, sf).select("o_orderkey", smiles.normalize_nitro(F.col("SMILES")).alias("plain"))


@query(
    "descriptor_log",
    f"WITH {CUST_SQL} SELECT c_custkey, round(sign(value) * ln(1 + abs(value)), 6) AS value,"
    " round(sign(sum_price) * ln(1 + abs(sum_price)), 6) AS sum_price FROM cust",
)
def descriptor_log(spark, sf):
    logged = structures.descriptor_log(d_cust(spark, sf), ["value", "sum_price"])
    return rounded(logged.select("c_custkey", "value", "sum_price"), ["value", "sum_price"])


@query(
    "union_labelled",
    f"WITH {SMI_SQL}, {descriptors_sql('smi')} SELECT CAST(Label AS INT) AS Label, count(*) AS n,"
    " round(sum(mw), 3) AS mw FROM ds GROUP BY Label",
)
def union_labelled(spark, sf):
    described = structures.constitutional_descriptors(d_smi(spark, sf)).select("o_orderkey", "Label", "mw")
    parts = [described.filter(F.col("Label") == k).drop("Label") for k in (1, 0)]
    both = structures.union_labelled(*parts)
    return both.groupBy("Label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("mw"), 3).alias("mw"))


# --- positional joins -------------------------------------------------------------------

_PAIR_SQL = f"{SMI_SQL}, r AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx, * FROM smi)"


def _indexed(spark, sf, column, kind="string"):
    """One column of the structure table written in key order and read back with ordinals."""
    path = _write_lines(spark, d_smi(spark, sf), column, "column")
    return readers.scan_tsv_single(spark, path, column, kind)


@query("zip_join", f"WITH {_PAIR_SQL} SELECT row_idx, nullif(SMILES, '') AS SMILES, value FROM r")
def zip_join(spark, sf):
    """Structures and activities in two files, paired by position."""
    smi = readers.with_row_index(
        spark.read.text(_write_lines(spark, d_smi(spark, sf), "SMILES", "smi"))
    ).select("row_idx", F.nullif(F.col("value"), F.lit("")).alias("SMILES"))
    return align.zip_join(smi, _indexed(spark, sf, "value", "double"))


@query(
    "zip_descriptors",
    f"WITH {_PAIR_SQL}, {descriptors_sql('r')} SELECT row_idx, value, n_heavy, round(mw, 6) AS mw FROM ds",
)
def zip_descriptors(spark, sf):
    data = d_smi(spark, sf)
    described = structures.constitutional_descriptors(data).select(F.lit("x").alias("Name"), "n_heavy", "mw")
    path = sinks.sink_csv(described, fresh_path(spark, "desc"))
    table_in = readers.scan_csv(spark, path, "Name string, n_heavy double, mw double", indexed=True)
    return rounded(structures.zip_descriptors(_indexed(spark, sf, "value", "double"), table_in), ["mw"])


@query(
    "attach_target",
    f"WITH {ORD_SQL} SELECT o_orderkey, n_lines, qty, Label FROM ord WHERE qty IS NOT NULL",
)
def attach_target(spark, sf):
    """Features whose sparse rows were dropped get the target of their own row back."""
    full = d_ord(spark, sf)
    reduced = drop_high_nan_rows(full.select("o_orderkey", "n_lines", "qty"), 0.4, ["n_lines", "qty"])
    return align.attach_target(reduced, full, "Label", "o_orderkey")


_WANTED = "SELECT DISTINCT o_orderkey * 3 AS row_idx FROM orders WHERE o_totalprice > 150000"


def _wanted(spark, sf):
    picked = table(spark, sf, "orders").filter("o_totalprice > 150000")
    return picked.select((F.col("o_orderkey") * 3).alias("idx"))


@query(
    "extract_by_index",
    f"WITH {SDF_SQL} SELECT row_idx, title FROM sdf WHERE valid AND row_idx IN ({_WANTED})",
)
def extract_by_index(spark, sf):
    records = readers.scan_sdf(spark, _sdf_file(spark, sf))
    found = align.extract_by_index(records, _wanted(spark, sf), "valid")
    return found.select("row_idx", sdf.title(F.col("record")).alias("title"))


@query(
    "indices_not_found",
    f"WITH {SDF_SQL}, w AS ({_WANTED}) SELECT row_idx FROM w WHERE row_idx NOT IN (SELECT row_idx FROM sdf)",
)
def indices_not_found(spark, sf):
    return align.indices_not_found(readers.scan_sdf(spark, _sdf_file(spark, sf)), _wanted(spark, sf))


@query(
    "extract_molecules",
    f"WITH {SDF_SQL}, w AS ({_WANTED}) SELECT count(*) AS requested, count(*) FILTER (valid) AS extracted,"
    " count(*) FILTER (valid IS NULL) AS not_found FROM w LEFT JOIN sdf ON sdf.row_idx = w.row_idx",
)
def extract_molecules(spark, sf):
    return screen.extract_molecules(readers.scan_sdf(spark, _sdf_file(spark, sf)), _wanted(spark, sf)).counts


# --- screening --------------------------------------------------------------------------

# Model of the screening queries: least squares of the order value on the line total,
# trained on filled orders with lines; the library is every order.
_SCREEN_SQL = (
    f"{ORD_FILLED_SQL}, fit AS (SELECT regr_slope(value, ext) AS b, regr_intercept(value, ext) AS a FROM ord),"
    " sc AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx, o_orderkey, a + b * ext AS p FROM ordf, fit)"
)
_CUTOFF = 249500.0


def _trained(spark, sf):
    train = d_ord(spark, sf).filter(F.col("ext").isNotNull())
    return fit_least_squares(train, ["ext"], "value")


def _library(spark, sf):
    """Descriptor rows with ordinals, written and read like a catalogue entry."""
    path = fresh_path(spark, "library")
    d_ord(spark, sf).select("o_orderkey", "ext").orderBy("o_orderkey").write.parquet(path)
    return align.with_row_index(spark.read.parquet(path))


@query(
    "virtual_screening",
    f"WITH {_SCREEN_SQL} SELECT row_idx, o_orderkey, round(p, 2) AS prediction_value FROM sc WHERE p <= {_CUTOFF}",
)
def virtual_screening(spark, sf):
    out = screen.virtual_screening(_trained(spark, sf), _library(spark, sf), ["ext"], score.REGRESSION, _CUTOFF)
    return rounded(out.compounds.drop("ext"), ["prediction_value"], 2)


@query(
    "screen_and_extract",
    f"WITH {_SCREEN_SQL}, {SDF_SQL} SELECT sdf.row_idx, title FROM sdf JOIN sc ON sc.row_idx = sdf.row_idx"
    f" WHERE valid AND p <= {_CUTOFF}",
)
def screen_and_extract(spark, sf):
    records = readers.scan_sdf(spark, _sdf_file(spark, sf))
    _, extracted = screen.screen_and_extract(
        _trained(spark, sf), _library(spark, sf), records, ["ext"], score.REGRESSION, _CUTOFF
    )
    # No row was selected, so nothing was extracted: no rows of the same columns.
    molecules = records.where("false") if extracted is None else extracted.molecules
    return molecules.select("row_idx", sdf.title(F.col("record")).alias("title"))


@query(
    "threshold_select",
    f"WITH {CUST_SQL} SELECT 'probability' AS rule, c_custkey FROM cust WHERE frac_f >= 0.25"
    " UNION ALL SELECT 'label', c_custkey FROM cust WHERE Label = 1"
    " UNION ALL SELECT 'value', c_custkey FROM cust WHERE value <= 10.0",
)
def threshold_select(spark, sf):
    cust = d_cust(spark, sf)
    rules = [
        ("probability", score.threshold_select(cust, score.CLASSIFICATION, 0.25, True, "frac_f")),
        ("label", score.threshold_select(cust, score.CLASSIFICATION, 1, False, "Label")),
        ("value", score.threshold_select(cust, score.REGRESSION, value="value")),
    ]
    return metrics.stack([hits.select(F.lit(rule).alias("rule"), "c_custkey") for rule, hits in rules])


@query(
    "attach_smiles",
    f"WITH {SMI_SQL} SELECT o_orderkey, SMILES, round(value, 2) AS value FROM smi WHERE value <= 100000",
)
def attach_smiles(spark, sf):
    """Structures stay on the screened rows, so nothing has to be joined back."""
    hits = score.threshold_select(d_smi(spark, sf), score.REGRESSION, 100000, value="value")
    return rounded(hits.select("o_orderkey", "SMILES", "value"), ["value"], 2)


_CUSTOM_SQL = (
    f"{SMI_SQL}, {descriptors_sql('smi')}, fit AS (SELECT regr_slope(value, mw) AS b, regr_intercept(value, mw) AS a"
    " FROM ds)"
)


def _described_model(spark, sf):
    return fit_least_squares(structures.constitutional_descriptors(d_smi(spark, sf)), ["mw"], "value")


@query(
    "custom_screening",
    f"WITH {_CUSTOM_SQL} SELECT 'cpd' || o_orderkey AS \"Name\", round(a + b * mw, 3) AS \"Prediction\" FROM ds, fit",
)
def custom_screening(spark, sf):
    named = F.concat(F.lit("cpd"), F.col("o_orderkey").cast("string")).alias("Name")
    compounds = d_smi(spark, sf).select(named, F.col("SMILES").alias("structure"))
    out = screen.custom_screening(_described_model(spark, sf), compounds, ["mw"], score.REGRESSION, "structure")
    return rounded(out, ["Prediction"], 3)


@query(
    "custom_screening_full",
    f"WITH {_CUSTOM_SQL} SELECT o_orderkey AS row_idx, SMILES FROM ds, fit WHERE {keep_sql('SMILES')}"
    " AND a + b * mw <= 249800",
)
def custom_screening_full(spark, sf):
    compounds = d_smi(spark, sf).select(F.col("o_orderkey").alias("row_idx"), "SMILES")
    run = standardise_describe_screen(_described_model(spark, sf), compounds, ["mw"], score.REGRESSION, 249800)
    return run.selected


# --- streaming --------------------------------------------------------------------------

_EVENT_STATS = "SELECT median(value) AS md FROM events WHERE event_type <> 'error'"
_EVENTS = (
    "SELECT event_id, CASE event_type WHEN 'error' THEN CAST(NULL AS DOUBLE) ELSE value END AS x,"
    " CAST(user_id AS DOUBLE) AS u FROM {src}"
)


@query(
    "stream_scoring",
    f"WITH ev AS ({_EVENTS.format(src='events')}), st AS ({_EVENT_STATS}), f AS (SELECT event_id, coalesce(x, md) AS x, u"
    " FROM ev, st), fit AS (SELECT regr_slope(u, x) AS b, regr_intercept(u, x) AS a FROM f)"
    " SELECT event_id, round(a + b * x, 6) AS prediction_value FROM f, fit WHERE a + b * x <= (SELECT avg(user_id) FROM events)",
)
def stream_scoring(spark, sf):
    """Model and fills from the batch table; the same file then arrives as a stream."""
    events = table(spark, sf, "events")
    batch = spark.sql(_EVENTS, src=events)
    fills = fill_values(batch, ["x"], "median")
    model = fit_least_squares(batch.fillna(fills), ["x"], "u")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    missing = F.when(F.col("event_type") != "error", F.col("value"))
    rows = stream.select("event_id", missing.alias("x"))
    cutoff = batch.agg(F.avg("u")).first()[0]
    hits = score_stream(rows, model, ["x"], fills, score.REGRESSION, cutoff, nan_threshold=1.0)
    path, state = fresh_path(spark, "hits"), fresh_path(spark, "stream")
    run = write_hits(hits.select("event_id", "prediction_value"), path, state)
    run.awaitTermination()
    got = spark.read.schema("event_id bigint, prediction_value double").parquet(path)
    return rounded(got, ["prediction_value"])


# --- scalar functions ---------------------------------------------------------------------


@query(
    "scalar_functions",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(abs(l_tax - l_discount), 6) AS gap,"
    " round(sqrt(l_quantity), 6) AS root, round(100 * l_tax / nullif(l_discount, 0), 6) AS share,"
    " round(l_extendedprice / nullif(l_tax, 0), 4) AS ratio, trim('  ' || l_returnflag || ' ') AS flag FROM lineitem",
)
def scalar_functions(spark, sf):
    line = table(spark, sf, "lineitem")
    return line.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(F.abs(F.col("l_tax") - F.col("l_discount")), 6).alias("gap"),
        F.round(F.sqrt("l_quantity"), 6).alias("root"),
        F.round(numeric.percent(F.col("l_tax"), F.col("l_discount")), 6).alias("share"),
        F.round(numeric.safe_ratio(F.col("l_extendedprice"), F.col("l_tax")), 4).alias("ratio"),
        F.trim(F.concat(F.lit("  "), "l_returnflag", F.lit(" "))).alias("flag"),
    )
